"""Rasters written here strip by strip and tile by tile, and what comes back."""

import struct
import zlib

import numpy as np
import pytest
import zstandard

from isotherm.operators import zonal
from isotherm.sources import raster


def lzw(data):
    """Plain writer of the codes that the reader undoes."""
    out, bits, held, table, width = bytearray(), 0, 0, None, 9

    def put(code):
        nonlocal bits, held
        held, bits = held << width | code, bits + width
        while bits >= 8:
            out.append(held >> (bits - 8) & 255)
            bits -= 8
            held &= (1 << bits) - 1

    put(256)
    table, word = {bytes([i]): i for i in range(256)}, b""
    for byte in data:
        longer = word + bytes([byte])
        if longer in table:
            word = longer
            continue
        put(table[word])
        table[longer] = len(table) + 2
        n = len(table) + 2
        width = 9 + (n > 511) + (n > 1023) + (n > 2047)
        if n >= 4094:
            put(256)
            table, width = {bytes([i]): i for i in range(256)}, 9
        word = bytes([byte])
    if word:
        put(table[word])
    put(257)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


PACK = {1: bytes, 5: lzw, 8: zlib.compress, 50000: zstandard.ZstdCompressor().compress}


def predicted(block, predictor):
    """A block (rows, columns, bands) as stored."""
    if predictor == 2:
        return np.concatenate([block[:, :1], np.diff(block, axis=1)], axis=1).astype(block.dtype).tobytes()
    if predictor == 3:
        h, w, n = block.shape
        size = block.dtype.itemsize
        planes = np.ascontiguousarray(block.astype(block.dtype.newbyteorder(">"))).view(np.uint8).reshape(h, w * n, size).transpose(0, 2, 1).reshape(h, -1, n)
        return np.concatenate([planes[:, :1], np.diff(planes, axis=1)], axis=1).astype(np.uint8).tobytes()
    return block.tobytes()


def write(file, data, order="<", big=False, tile=None, rows=4, compression=1, predictor=1, nodata=None, extra=(), skip=(), apart=False):
    """``data``: (height, width, bands) in the file's byte order."""
    h, w, n = data.shape
    th, tw = tile or (rows, w)
    parts = []
    for band in range(n) if apart else (slice(None),):
        own = data[:, :, band : band + 1] if apart else data
        for i in range(0, h, th):
            for j in range(0, w, tw):
                part = own[i : i + th, j : j + tw]
                if tile:
                    whole = np.zeros((th, tw, own.shape[2]), dtype=data.dtype)
                    whole[: part.shape[0], : part.shape[1]] = part
                    part = whole
                parts.append(b"" if len(parts) in skip else PACK[compression](predicted(part, predictor)))
    kind = {"u": 1, "i": 2, "f": 3}[data.dtype.kind]
    tags = [(256, "H", [w]), (257, "I", [h]), (258, "H", [data.dtype.itemsize * 8] * n), (259, "H", [compression]), (277, "H", [n]), (284, "H", [1 + apart]), (317, "H", [predictor]), (339, "H", [kind] * n), *extra]
    tags += [(322, "H", [tw]), (323, "H", [th])] if tile else [(278, "H", [rows])]
    if nodata is not None:
        tags.append((42113, "s", [str(nodata).encode() + b"\0"]))
    body, places = bytearray(b"\0" * (16 if big else 8)), []
    for p in parts:
        places.append(len(body))
        body += p
    word = "Q" if big else "I"
    tags += [(324 if tile else 273, word, places), (325 if tile else 279, word, [len(p) for p in parts])]
    code = {"H": 3, "I": 4, "Q": 16, "d": 12, "s": 2}
    entries = b""
    for tag, t, values in sorted(tags, key=lambda x: x[0]):
        raw = values[0] if t == "s" else struct.pack(f"{order}{len(values)}{t}", *values)
        count = len(raw) if t == "s" else len(values)
        room = 8 if big else 4
        if len(raw) > room:
            where, raw = len(body), body.extend(raw) or b""
            raw = struct.pack(order + word, where)
        entries += struct.pack(order + "HH" + word, tag, code[t], count) + raw.ljust(room, b"\0")
    at = len(body)
    body += struct.pack(order + ("Q" if big else "H"), len(tags)) + entries + struct.pack(order + word, 0)
    head = struct.pack(order + "HHHQ", 43, 8, 0, at) if big else struct.pack(order + "HI", 42, at)
    body[: 2 + len(head)] = (b"II" if order == "<" else b"MM") + head
    file.write_bytes(bytes(body))


def placed(x=-180.0, y=90.0, step=0.5, epsg=4326, kind=1):
    return [(33550, "d", [step, step, 0.0]), (33922, "d", [0.0, 0.0, 0.0, x, y, 0.0]), (34735, "H", [1, 1, 0, 2, 1025, 0, 1, kind, 2048, 0, 1, epsg])]


def pixels(df):
    return {(r.row, r.col): r.value for r in df.collect()}


def plain(data, missing=None):
    return {i: float(v) for i, v in np.ndenumerate(data) if v == v and v != missing}


@pytest.mark.parametrize(
    ("dtype", "how"),
    [
        ("<u1", {}),
        (">i2", {"order": ">", "compression": 8, "predictor": 2}),
        ("<f4", {"big": True, "tile": (16, 16), "compression": 8, "predictor": 3}),
        (">f8", {"order": ">", "big": True, "compression": 50000, "rows": 100}),
        ("<u2", {"tile": (16, 32), "compression": 5, "predictor": 2}),
        ("<i4", {"compression": 5, "rows": 40}),
        (">u4", {"order": ">", "tile": (32, 16), "apart": True}),
    ],
)
def test_first_band_comes_back(spark, tmp_path, dtype, how):
    g = np.random.default_rng(4)
    data = g.integers(0, 120, (37, 45, 2)).astype(dtype)
    data[5:30, 3:40] = 7  # long codes
    write(tmp_path / "a.tif", data, nodata=7 if how.get("rows") == 40 else None, extra=placed(), **how)
    want = plain(data[:, :, 0], 7 if how.get("rows") == 40 else None)
    assert pixels(raster.read_raster(spark, str(tmp_path / "a.tif"))) == want


def test_codes_of_every_width():
    g = np.random.default_rng(5)
    for data in (b"", b"a" * 9_000, g.integers(0, 256, 30_000).astype(np.uint8).tobytes(), g.integers(0, 3, 60_000).astype(np.uint8).tobytes()):
        assert raster.unlzw(lzw(data)) == data


def test_places_and_what_a_directory_says(spark, tmp_path):
    data = np.arange(12, dtype="<f4").reshape(3, 4, 1)
    data[1, 1] = np.nan
    data[2, 3] = -200
    write(tmp_path / "a.tif", data, nodata=-200, extra=placed())
    write(tmp_path / "b.tif", data.astype("<i2"), extra=placed(10, 20, 2, 3035, kind=2))
    row = {r.path.rsplit("/", 1)[1]: r for r in raster.about(spark, str(tmp_path)).collect()}
    assert (row["a.tif"].width, row["a.tif"].height, row["a.tif"].epsg, row["a.tif"].nodata, row["a.tif"].transform) == (4, 3, 4326, -200, [-180, 0.5, 0, 90, 0, -0.5])
    got = {(r.path[-5], r.row, r.col): (r.x, r.y, r.value) for r in raster.read_raster(spark, str(tmp_path)).collect()}
    assert len([k for k in got if k[0] == "a"]) == 10 and ("a", 1, 1) not in got and ("a", 2, 3) not in got
    assert got["a", 0, 0] == (-179.75, 89.75, 0) and got["a", 2, 2] == (-178.75, 88.75, 10)
    assert got["b", 0, 0] == (10, 20, 0) and got["b", 2, 2] == (14, 16, 10)  # here the tie is a centre
    turned = [(34264, "d", [0.0, 2.0, 0.0, 5.0, 3.0, 0.0, 0.0, 6.0, *[0.0] * 7, 1.0])]
    write(tmp_path / "c.tif", data.astype("<i2"), extra=turned)
    assert [(r.x, r.y) for r in raster.read_raster(spark, str(tmp_path / "c.tif")).where("row = 1 and col = 2").collect()] == [(5 + 2 * 1.5, 6 + 3 * 2.5)]


def test_a_box_opens_its_blocks_alone(spark, tmp_path):
    data = np.arange(64 * 64, dtype="<i4").reshape(64, 64, 1)
    write(tmp_path / "a.tif", data, tile=(16, 16), compression=8, extra=placed())
    broken = bytearray((tmp_path / "a.tif").read_bytes())
    broken[8:12] = b"\xff" * 4  # the first tile
    (tmp_path / "a.tif").write_bytes(bytes(broken))
    box = (-170.0, 70.0, -160.0, 80.0)
    assert raster.blocks(spark, str(tmp_path / "a.tif"), box).count() == 4
    x, y = np.meshgrid(-180 + 0.5 * (np.arange(64) + 0.5), 90 - 0.5 * (np.arange(64) + 0.5))
    inside = (x >= box[0]) & (x <= box[2]) & (y >= box[1]) & (y <= box[3])
    assert pixels(raster.read_raster(spark, str(tmp_path / "a.tif"), box)) == {(int(i), int(j)): float(data[i, j, 0]) for i, j in zip(*np.nonzero(inside), strict=True)}


def test_blocks_that_are_not_stored(spark, tmp_path):
    data = np.ones((8, 6, 1), dtype="<u1")
    write(tmp_path / "a.tif", data, skip=(1,))
    assert pixels(raster.read_raster(spark, str(tmp_path / "a.tif"))) == plain(np.repeat([1, 0], 4)[:, None] * np.ones((8, 6)))
    write(tmp_path / "b.tif", data, skip=(1,), nodata=255)
    assert pixels(raster.read_raster(spark, str(tmp_path / "b.tif"))) == plain(np.ones((4, 6)))


def test_files_of_other_kinds_say_so(spark, tmp_path):
    (tmp_path / "a.tif").write_bytes(b"no raster")
    write(tmp_path / "b.tif", np.ones((2, 2, 1), dtype="<u1"))
    content = (tmp_path / "b.tif").read_bytes()
    with pytest.raises(ValueError, match="not a TIFF"):
        raster.layout((tmp_path / "a.tif").read_bytes())
    with pytest.raises(ValueError, match="compression 7"):
        raster.layout(content.replace(struct.pack("<HHIHH", 259, 3, 1, 1, 0), struct.pack("<HHIHH", 259, 3, 1, 7, 0)))


def test_pixels_are_the_input_of_reprojection(spark, tmp_path):
    """Pixels of an equal-area raster averaged per cell, missing ones left out."""
    data = np.arange(100, dtype="<f4").reshape(10, 10, 1)
    data[:5] = -1
    write(tmp_path / "built_2000.tif", data, nodata=-1, extra=placed(0, 1_000_000, 100_000, kind=1))
    points = raster.read_raster(spark, str(tmp_path)).selectExpr("x", "y", "cast(regexp_extract(path, '_([0-9]{4})', 1) as int) epoch", "value")
    got = zonal.reproject_built(points, step=10.0).collect()
    assert points.count() == 50 and {r.epoch for r in got} == {2000} and min(r.built_surface for r in got) >= 50
