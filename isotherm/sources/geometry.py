"""Polygons as binary: well-known binary of either byte order, and the header that geometry columns of feature files add.

The columns are arrays of polygons, each an array of rings (the outer one first), each an array of structs
lon, lat.  Decoding and encoding work on Arrow buffers, a geometry at a time, never a point at a time.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_POINT = T.StructType([T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType())])
POLYGONS = "array<array<array<struct<lon:double,lat:double>>>>"
#: fixed values: codes of the format; bytes of the envelope by its kind in the header of a feature file
POLYGON, MULTI = 3, 6
ENVELOPES = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}


class _Reader:
    def __init__(self, blob: bytes):
        self.blob, self.at, self.empty = blob, 0, False
        if blob[:2] == b"GP":
            flags = blob[3]
            self.at, self.empty = 8 + ENVELOPES[flags >> 1 & 7], bool(flags & 16)

    def number(self, order: str) -> int:
        self.at += 4
        return struct.unpack_from(f"{order}I", self.blob, self.at - 4)[0]

    def header(self) -> tuple[str, int, int]:
        """Byte order, kind of geometry and numbers per point; further dimensions and a reference system may be marked in two ways."""
        order = {0: ">", 1: "<"}[self.blob[self.at]]
        self.at += 1
        code = self.number(order)
        if code & 0x20000000:
            self.at += 4
        plain = code & 0x0FFFFFFF
        more = {0: 0, 1: 1, 2: 1, 3: 2}[plain // 1000] + bool(code & 0x80000000) + bool(code & 0x40000000)
        return order, plain % 1000, 2 + more

    def rings(self, order: str, width: int) -> list[np.ndarray]:
        out = []
        for _ in range(self.number(order)):
            n = self.number(order)
            out.append(np.frombuffer(self.blob, dtype=f"{order}f8", count=n * width, offset=self.at).reshape(n, width)[:, :2])
            self.at += 8 * n * width
        return out

    def polygons(self) -> list[list[np.ndarray]]:
        if self.empty:
            return []
        order, kind, width = self.header()
        if kind == POLYGON:
            one = self.rings(order, width)
            return [one] if one else []
        if kind != MULTI:
            raise ValueError(f"geometry {kind} is no polygon")
        out = []
        for _ in range(self.number(order)):
            inner, _, width = self.header()
            out.append(self.rings(inner, width))
        return out


def _offsets(sizes: list[int]) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int32), pa.int32())


def decode(blobs: pa.Array) -> pa.Array:
    """Arrow's nested lists of a column of blobs; null of null."""
    shapes = [None if b is None else _Reader(b).polygons() for b in blobs.to_pylist()]
    polygons = [p for s in shapes if s for p in s]
    rings = [r for p in polygons for r in p]
    points = np.concatenate([np.zeros((0, 2)), *rings]).astype(float)
    held = pa.StructArray.from_arrays([pa.array(points[:, 0]), pa.array(points[:, 1])], names=["lon", "lat"])
    by_ring = pa.ListArray.from_arrays(_offsets([len(r) for r in rings]), held)
    by_polygon = pa.ListArray.from_arrays(_offsets([len(p) for p in polygons]), by_ring)
    return pa.ListArray.from_arrays(_offsets([len(s or ()) for s in shapes]), by_polygon, mask=pa.array([s is None for s in shapes]))


def _blob(polygons: list[list[np.ndarray]], order: str) -> bytes:
    mark = b"\x01" if order == "<" else b"\x00"
    number = lambda *n: struct.pack(f"{order}{len(n)}I", *n)
    bodies = [number(len(rings)) + b"".join(number(len(r)) + r.astype(f"{order}f8").tobytes() for r in rings) for rings in polygons]
    if len(bodies) == 1:
        return mark + number(POLYGON) + bodies[0]
    return mark + number(MULTI, len(bodies)) + b"".join(mark + number(POLYGON) + b for b in bodies)


def _parts(lists: pa.Array) -> Iterator[tuple[int, int] | None]:
    """Bounds of each list within ``lists.values``; nothing of null."""
    ends = lists.offsets.to_numpy()
    return (None if null else (a, b) for a, b, null in zip(ends[:-1], ends[1:], lists.is_null().to_pylist(), strict=True))


def encode(column: pa.Array, order: str = "<") -> pa.Array:
    """Blobs of a column of polygons; a null ring or polygon within counts as empty."""
    by_polygon = column.values
    by_ring = by_polygon.values
    points = np.column_stack([by_ring.values.field(c).to_numpy(zero_copy_only=False) for c in ("lon", "lat")])
    rings = [points[slice(*(x or (0, 0)))] for x in _parts(by_ring)]
    polygons = [rings[slice(*(x or (0, 0)))] for x in _parts(by_polygon)]
    return pa.array([None if x is None else _blob(polygons[slice(*x)], order) for x in _parts(column)], pa.binary())


@F.arrow_udf(T.ArrayType(T.ArrayType(T.ArrayType(_POINT))))
def _decode(blobs: pa.Array) -> pa.Array:
    return decode(blobs)


@F.arrow_udf(T.BinaryType())
def _encode_little(column: pa.Array) -> pa.Array:
    return encode(column)


@F.arrow_udf(T.BinaryType())
def _encode_big(column: pa.Array) -> pa.Array:
    return encode(column, ">")


def polygons_of(blob: str | Column) -> Column:
    """Polygons of a binary column; a blob that is no polygon or multipolygon fails the query."""
    return _decode(blob)


def binary_of(polygons: str | Column, big_endian: bool = False) -> Column:
    """Well-known binary: a polygon if there is one, else a multipolygon."""
    return (_encode_big if big_endian else _encode_little)(polygons)
