"""Chunked arrays against the arrays they were cut from."""

import gzip
import itertools
import json
import zlib

import numpy as np
import pytest
import zstandard

from isotherm.sources import chunked

CODECS = {None: bytes, "zlib": zlib.compress, "gzip": gzip.compress, "zstd": zstandard.ZstdCompressor().compress}


def store(folder, name, data, chunks, dims, codec="zlib", order="C", separator=".", fill="NaN", skip=(), **attributes):
    at = folder / name
    at.mkdir(parents=True)
    meta = {"zarr_format": 2, "shape": data.shape, "chunks": chunks, "dtype": data.dtype.str, "compressor": codec and {"id": codec}, "fill_value": fill, "order": order, "filters": None, "dimension_separator": separator}
    (at / ".zarray").write_text(json.dumps(meta))
    (at / ".zattrs").write_text(json.dumps({"_ARRAY_DIMENSIONS": dims, **attributes}))
    for key in itertools.product(*[range(-(-n // c)) for n, c in zip(data.shape, chunks, strict=True)]):
        if key in skip:
            continue
        part = data[tuple(slice(k * c, (k + 1) * c) for k, c in zip(key, chunks, strict=True))]
        whole = np.zeros(chunks, dtype=data.dtype)  # chunks at the edges are stored whole
        whole[tuple(slice(0, n) for n in part.shape)] = part
        file = at / separator.join(map(str, key))
        file.parent.mkdir(exist_ok=True, parents=True)
        file.write_bytes(CODECS[codec](whole.tobytes(order=order)))


@pytest.fixture
def cube(tmp_path):
    g = np.random.default_rng(2)
    data = g.normal(size=(7, 5, 11)).astype("<f4")
    data[g.random(data.shape) < 0.2] = np.nan
    for name, values in (("time", np.arange(7, dtype="<i8") * 24), ("lat", np.linspace(50, 46, 5)), ("lon", np.arange(11) / 2)):
        store(tmp_path, name, values, (4,), [name], fill=0, **({"units": "hours since 2000-02-27 00:00:00"} if name == "time" else {}))
    (tmp_path / ".zgroup").write_text('{"zarr_format": 2}')
    return tmp_path, data


def cells(df):
    return {(r.time_i, r.lat_i, r.lon_i): r.value for r in df.collect()}


@pytest.mark.parametrize(("codec", "order", "separator"), [("zlib", "C", "."), ("zstd", "F", "/"), (None, "C", "/"), ("gzip", "F", ".")])
def test_every_value_comes_back(spark, cube, codec, order, separator):
    folder, data = cube
    store(folder, "t2m", data, (3, 2, 4), ["time", "lat", "lon"], codec, order, separator, skip=[(1, 0, 2)])
    hole = data.copy()
    hole[3:6, 0:2, 8:11] = np.nan
    got = chunked.read_chunked(spark, str(folder), "t2m")
    assert cells(got) == {i: float(v) for i, v in np.ndenumerate(hole) if v == v}
    row = got.where("time_i = 6 and lat_i = 4").first()
    assert (row.time, row.lat, row.lon) == (144, 46, row.lon_i / 2)
    dated = got.select("time_i", chunked.dates_of("time", chunked.arrays(spark, str(folder))["time"].attributes["units"]).alias("d")).distinct().collect()
    assert {r.time_i: str(r.d) for r in dated}[3] == "2000-03-01"


def test_a_box_opens_its_chunks_alone(spark, cube):
    folder, data = cube
    store(folder, "t2m", data, (3, 2, 4), ["time", "lat", "lon"])
    (folder / "t2m" / "0.0.0").write_bytes(b"broken")
    got = chunked.read_chunked(spark, f"file://{folder}/", "t2m", box={"time": (4, 99), "lon": (-3, 5)})
    assert cells(got) == {i: float(v) for i, v in np.ndenumerate(data) if v == v and i[0] >= 4 and i[2] <= 5}


def test_missing_chunks_hold_the_fill_value(spark, cube):
    folder, _ = cube
    mask = np.arange(55, dtype="<i2").reshape(5, 11)
    store(folder, "mask", mask, (2, 4), ["lat", "lon"], fill=-1, skip=[(0, 0), (2, 2)])
    want = mask.copy()
    want[0:2, 0:4] = want[4:, 8:] = -1
    got = chunked.read_chunked(spark, str(folder), "mask", coordinates=False)
    assert {(r.lat_i, r.lon_i): r.value for r in got.collect()} == {i: float(v) for i, v in np.ndenumerate(want)} and got.columns == ["lat_i", "lon_i", "value"]
    store(folder, "none", mask, (2, 4), ["lat", "lon"], fill=None, skip=list(itertools.product(range(3), range(3))))
    assert chunked.read_chunked(spark, str(folder), "none").count() == 0


def test_metadata_in_one_file(spark, cube):
    folder, data = cube
    store(folder, "t2m", data, (7, 5, 11), ["time", "lat", "lon"])
    before = chunked.arrays(spark, str(folder))
    chunked.consolidate(spark, str(folder))
    held = json.loads((folder / ".zmetadata").read_text())
    assert held["zarr_consolidated_format"] == 1 and {"t2m/.zarray", "lat/.zattrs", ".zgroup"} <= held["metadata"].keys()
    for f in folder.glob("*/.zarray"):
        f.unlink()
    assert repr(chunked.arrays(spark, str(folder))) == repr(before) and len(cells(chunked.read_chunked(spark, str(folder), "t2m"))) == np.isfinite(data).sum()
    (folder / ".zmetadata").unlink()
    (folder / "t2m" / ".zarray").write_text(json.dumps({"zarr_format": 2, "compressor": {"id": "blosc"}, "shape": [1], "chunks": [1], "dtype": "<f4"}))
    with pytest.raises(ValueError, match="blosc"):
        chunked.arrays(spark, str(folder))
