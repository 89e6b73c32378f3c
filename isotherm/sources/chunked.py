"""Chunked arrays (Zarr, format 2) as long rows: a chunk is a file, and a task per file decodes it.

Metadata are small JSON files that the driver reads through Hadoop, so any store will do; chunks are read by Spark's
``binaryFile``.  A box on the indices becomes a pattern of file names, so other chunks are not opened.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: fixed values: names of the metadata files, and of the attribute that holds the dimensions' names
ARRAY, ATTRIBUTES, GROUP, ALL, DIMENSIONS = ".zarray", ".zattrs", ".zgroup", ".zmetadata", "_ARRAY_DIMENSIONS"


def _open(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _json(spark: SparkSession, path: str) -> dict | None:
    p, fs = _open(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


@dataclass(frozen=True)
class Array:
    """What the metadata say of one array."""

    shape: tuple[int, ...]
    chunks: tuple[int, ...]
    dtype: str
    order: str
    codec: str | None
    fill: float | None
    separator: str
    dims: tuple[str, ...]
    attributes: dict

    @property
    def counts(self) -> list[int]:
        return [-(-n // c) for n, c in zip(self.shape, self.chunks, strict=True)]

    def decode(self, content: bytes | None) -> np.ndarray:
        """A whole chunk; one that is not stored holds the fill value."""
        kind = np.dtype(self.dtype)
        if content is None:
            fill = self.fill if self.fill is not None else (np.nan if kind.kind == "f" else 0)
            return np.full(self.chunks, fill, dtype=kind)
        if self.codec in ("zlib", "gzip"):
            content = zlib.decompress(content, wbits=47)  # either header
        elif self.codec == "zstd":
            import zstandard

            content = zstandard.ZstdDecompressor().decompressobj().decompress(content)
        return np.frombuffer(content, dtype=kind).reshape(self.chunks, order=self.order)


def _array(meta: dict, attributes: dict | None) -> Array:
    codec = (meta.get("compressor") or {}).get("id")
    if meta.get("zarr_format") != 2 or meta.get("filters") or codec not in (None, "zlib", "gzip", "zstd"):
        raise ValueError(f"cannot read format {meta.get('zarr_format')}, filters {meta.get('filters')}, compressor {codec}")
    attributes = dict(attributes or {})
    dims = attributes.pop(DIMENSIONS, [f"dim_{i}" for i in range(len(meta["shape"]))])
    fill = meta.get("fill_value")
    return Array(tuple(meta["shape"]), tuple(meta["chunks"]), meta["dtype"], meta.get("order", "C"), codec, float(fill) if fill is not None else None, meta.get("dimension_separator", "."), tuple(dims), attributes)


def arrays(spark: SparkSession, path: str) -> dict[str, Array]:
    """The arrays of a store, from its consolidated metadata if it has them, else from each array's own."""
    found = (_json(spark, f"{path}/{ALL}") or {}).get("metadata") or collected(spark, path)
    names = [k[: -len(ARRAY) - 1] for k in found if k.endswith(f"/{ARRAY}")]
    return {n: _array(found[f"{n}/{ARRAY}"], found.get(f"{n}/{ATTRIBUTES}")) for n in names}


def collected(spark: SparkSession, path: str) -> dict[str, dict]:
    """Metadata of the store and of each array in it, by their names."""
    p, fs = _open(spark, path)
    folders = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()]
    names = [GROUP, ATTRIBUTES, *[f"{f}/{n}" for f in folders for n in (ARRAY, ATTRIBUTES)]]
    return {n: found for n in names if (found := _json(spark, f"{path}/{n}")) is not None}


def consolidate(spark: SparkSession, path: str) -> None:
    """All metadata in one file beside the arrays, so that opening the store takes one read."""
    text = json.dumps({"zarr_consolidated_format": 1, "metadata": collected(spark, path)})
    p, fs = _open(spark, f"{path}/{ALL}")
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def coordinate(spark: SparkSession, path: str, name: str, array: Array) -> np.ndarray:
    """A one-dimensional array whole; its length is that of an axis."""
    parts = {r["key"]: r["content"] for r in _chunks(spark, path, name, array, [range(array.counts[0])]).collect()}
    return np.concatenate([array.decode(parts.get(str(i))) for i in range(array.counts[0])] or [np.zeros(0)])[: array.shape[0]]


def _chunks(spark: SparkSession, path: str, name: str, array: Array, wanted: list[range]) -> DataFrame:
    """``key, content`` of the stored chunks among those wanted."""
    pattern = array.separator.join("{" + ",".join(map(str, r)) + "}" for r in wanted)
    schema = "path string, modificationTime timestamp, length long, content binary"
    p, fs = _open(spark, f"{path}/{name}/{pattern}")
    if not fs.globStatus(p):
        return spark.createDataFrame([], "key string, content binary")
    key = F.regexp_extract("path", "/" + re.escape(array.separator).join(["([0-9]+)"] * len(wanted)).replace("([0-9]+)", "[0-9]+") + "$", 0)
    return spark.read.schema(schema).format("binaryFile").load(f"{path}/{name}/{pattern}").select(F.substring(key, 2, 1 << 20).alias("key"), "content")


def read_chunked(spark: SparkSession, path: str, variable: str, box: dict[str, tuple[int, int]] | None = None, coordinates: bool = True, value: str = "value") -> DataFrame:
    """Rows ``<dim>_i`` (index) of each dimension, ``<dim>`` where the store has its coordinate, and ``value``; NaN is left out.

    ``box``: least and greatest index of some dimensions.  A chunk that is not stored counts with its fill value; if that is NaN or there is none, it has no rows.
    """
    path = path.rstrip("/")
    known = arrays(spark, path)
    array = known[variable]
    bounds = [(max(0, lo), min(n - 1, hi)) for n, (lo, hi) in zip(array.shape, [(box or {}).get(d, (0, n - 1)) for d, n in zip(array.dims, array.shape, strict=True)], strict=True)]
    wanted = [range(lo // c, hi // c + 1) for (lo, hi), c in zip(bounds, array.chunks, strict=True)]
    axes = {d: coordinate(spark, path, d, known[d]) for d in array.dims if coordinates and d in known and known[d].dims == (d,)}
    files = _chunks(spark, path, variable, array, wanted)
    if array.fill is not None and not math.isnan(array.fill):
        sizes = [len(r) for r in wanted]
        number, parts = F.col("id"), []
        for r, n in zip(reversed(wanted), reversed(sizes), strict=True):
            parts.insert(0, (number % n + r.start).cast("string"))
            number = F.floor(number / n)
        files = spark.range(math.prod(sizes)).select(F.concat_ws(array.separator, *parts).alias("key")).join(files, "key", "left")
    float_ = np.dtype(array.dtype).kind == "f"
    fields = [*[T.StructField(f"{d}_i", T.IntegerType()) for d in array.dims], *[T.StructField(d, T.DoubleType()) for d in axes], T.StructField(value, T.DoubleType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                chunk = array.decode(content.as_py())
                starts = [int(k) * c for k, c in zip(key.split(array.separator), array.chunks, strict=True)]
                inner = [slice(max(lo - s, 0), min(hi + 1 - s, c)) for (lo, hi), s, c in zip(bounds, starts, array.chunks, strict=True)]
                own = chunk[tuple(inner)]
                first = [s + i.start for s, i in zip(starts, inner, strict=True)]
                for at in range(0, len(own), max(1, (1 << 16) // max(1, own[:1].size))):  # some 65,000 values at a time
                    part = own[at : at + max(1, (1 << 16) // max(1, own[:1].size))]
                    index = [i.ravel() + f for i, f in zip(np.indices(part.shape), [first[0] + at, *first[1:]], strict=True)]
                    values = part.ravel()
                    keep = ~np.isnan(values) if float_ else np.ones(len(values), dtype=bool)
                    columns = [pa.array(i[keep].astype(np.int32)) for i in index]
                    columns += [pa.array(axes[d][i[keep]].astype(float)) for d, i in zip(array.dims, index, strict=True) if d in axes]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(values[keep].astype(float))], names=[f.name for f in fields])

    return files.mapInArrow(run, T.StructType(fields))


def dates_of(column: str, units: str):
    """Dates of a time axis in ``days since 1990-01-01`` or hours, minutes or seconds since."""
    unit, since = re.fullmatch(r"(days|hours|minutes|seconds) since ([0-9-]{10}).*", units).groups()
    seconds = {"days": 86_400, "hours": 3600, "minutes": 60, "seconds": 1}[unit]
    return F.date_add(F.lit(since).cast("date"), F.floor(F.col(column) * seconds / 86_400).cast("int"))
