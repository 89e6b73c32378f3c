"""Georeferenced rasters (TIFF, classic and big) as long rows of their first band.

A task per file reads its directory and cuts the file into its strips or tiles; these are dealt out by file and
number, still compressed, and decoded apart.  Of the blocks outside a box none is dealt out.  A file comes in
one ``binaryFile`` row, so 2 GB is the most that one may have.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: fixed values: field types of a directory
FIELDS = {1: "u1", 2: "S1", 3: "u2", 4: "u4", 6: "i1", 8: "i2", 9: "i4", 11: "f4", 12: "f8", 16: "u8", 17: "i8", 18: "u8"}
#: fixed values: tags
WIDTH, HEIGHT, BITS, COMPRESSION = 256, 257, 258, 259
STRIP_OFFSETS, SAMPLES, STRIP_ROWS, STRIP_BYTES = 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES = 284, 317, 322, 323, 324, 325
SAMPLE_FORMAT, PIXEL_SCALE, TIE_POINT, TRANSFORM, GEO_KEYS, NODATA = 339, 33550, 33922, 34264, 34735, 42113
#: fixed values: geographic keys
RASTER_TYPE, GEOGRAPHIC, PROJECTED = 1025, 2048, 3072
#: fixed values: compressions
PLAIN, LZW, DEFLATE, OLD_DEFLATE, ZSTD = 1, 5, 8, 32946, 50000
#: values of an Arrow batch
BATCH = 1 << 16

ABOUT = "path string, width int, height int, bands int, dtype string, epsg int, nodata double, transform array<double>"
BLOCK = "path string, number int, row int, col int, height int, width int, bottom int, right int, dtype string, bands int, compression int, predictor int, nodata double, transform array<double>, payload binary"


def directory(content: bytes | pa.Buffer) -> tuple[str, dict[int, np.ndarray]]:
    """Byte order, and the tags of the first image."""
    order = {b"II": "<", b"MM": ">"}.get(bytes(content[:2]))
    version = struct.unpack_from(order + "H", content, 2)[0] if order and len(content) >= 8 else 0
    if version not in (42, 43):
        raise ValueError("not a TIFF")
    count_kind, entry, word, inline = ("Q", 20, "Q", 8) if version == 43 else ("H", 12, "I", 4)
    at = struct.unpack_from(order + word, content, 8 if version == 43 else 4)[0]
    number = struct.unpack_from(order + count_kind, content, at)[0]
    at += struct.calcsize(count_kind)
    tags = {}
    for i in range(number):
        tag, kind, n = struct.unpack_from(order + "HH" + word, content, at + i * entry)
        if kind not in FIELDS:
            continue
        dtype = np.dtype(FIELDS[kind]).newbyteorder(order)
        place = at + (i + 1) * entry - inline
        if n * dtype.itemsize > inline:
            place = struct.unpack_from(order + word, content, place)[0]
        tags[tag] = np.frombuffer(content, dtype, n, place)
    return order, tags


@dataclass(frozen=True)
class Layout:
    """What a directory says of the first band."""

    width: int
    height: int
    bands: int
    dtype: str
    compression: int
    predictor: int
    block: tuple[int, int]
    tiled: bool
    offsets: np.ndarray
    sizes: np.ndarray
    epsg: int | None
    nodata: float | None
    transform: list[float]

    def blocks(self) -> Iterator[tuple[int, int, int, int, int]]:
        """Number, first row and column, rows and columns of each stored block; the last strip is short, tiles never are."""
        h, w = self.block
        across = -(-self.width // w)
        for i in range(-(-self.height // h) * across):
            row, col = i // across * h, i % across * w
            yield i, row, col, h if self.tiled else min(h, self.height - row), w

    def meets(self, row: int, col: int, height: int, width: int, box: tuple[float, float, float, float] | None) -> bool:
        """Whether pixels of a block may have centres in the box."""
        if box is None:
            return True
        x0, xc, xr, y0, yc, yr = self.transform
        bottom, right = min(row + height, self.height), min(col + width, self.width)
        xs = [x0 + xc * c + xr * r for c in (col, right) for r in (row, bottom)]
        ys = [y0 + yc * c + yr * r for c in (col, right) for r in (row, bottom)]
        return min(xs) <= box[2] and max(xs) >= box[0] and min(ys) <= box[3] and max(ys) >= box[1]


def _transform(tags: dict[int, np.ndarray], centred: bool) -> list[float]:
    """x = x0 + xc * column + xr * row, likewise y; at whole numbers the outer corner of a pixel."""
    if TRANSFORM in tags:
        m = tags[TRANSFORM].astype(float)
        x0, xc, xr, y0, yc, yr = m[3], m[0], m[1], m[7], m[4], m[5]
    elif PIXEL_SCALE in tags and TIE_POINT in tags:
        (sx, sy), (i, j, _, x, y, _) = tags[PIXEL_SCALE][:2].astype(float), tags[TIE_POINT][:6].astype(float)
        x0, xc, xr, y0, yc, yr = x - i * sx, sx, 0.0, y + j * sy, 0.0, -sy
    else:
        x0, xc, xr, y0, yc, yr = 0.0, 1.0, 0.0, 0.0, 0.0, 1.0
    if centred:
        x0, y0 = x0 - (xc + xr) / 2, y0 - (yc + yr) / 2
    return [float(v) for v in (x0, xc, xr, y0, yc, yr)]


def layout(content: bytes | pa.Buffer) -> Layout:
    order, tags = directory(content)
    one = lambda tag, default=None: int(tags[tag][0]) if tag in tags else default
    width, height, bands = one(WIDTH), one(HEIGHT), one(SAMPLES, 1)
    bits, sign = one(BITS, 1), one(SAMPLE_FORMAT, 1)
    compression, predictor = one(COMPRESSION, PLAIN), one(PREDICTOR, 1)
    kind = {1: "u", 2: "i", 3: "f"}.get(sign)
    if kind is None or bits not in (8, 16, 32, 64) or (kind == "f" and bits < 32):
        raise ValueError(f"cannot read samples of format {sign} and {bits} bits")
    if compression not in (PLAIN, LZW, DEFLATE, OLD_DEFLATE, ZSTD) or predictor not in (1, 2, 3):
        raise ValueError(f"cannot read compression {compression} with predictor {predictor}")
    tiled = TILE_OFFSETS in tags
    block = (one(TILE_HEIGHT), one(TILE_WIDTH)) if tiled else (min(one(STRIP_ROWS, height), height), width)
    keys = tags.get(GEO_KEYS, np.zeros(4, dtype=np.uint16)).astype(int)[4:].reshape(-1, 4)
    known = {int(k): int(v) for k, where, _, v in keys if where == 0}
    epsg = known.get(PROJECTED, known.get(GEOGRAPHIC))
    text = b"".join(tags[NODATA].tolist()).split(b"\0")[0].decode().strip() if NODATA in tags else ""
    apart = one(PLANAR, 1) == 2  # bands stored one after the other: the first blocks are the first band's
    return Layout(
        width, height, 1 if apart else bands, f"{order}{kind}{bits // 8}", compression, predictor, block, tiled,
        tags[TILE_OFFSETS if tiled else STRIP_OFFSETS], tags[TILE_BYTES if tiled else STRIP_BYTES],
        epsg if epsg != 32767 else None, float(text) if text else None, _transform(tags, known.get(RASTER_TYPE) == 2),
    )


# ---- decoding ------------------------------------------------------------------------------


def unlzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bits first; 256 clears the table, 257 ends; a code widens one entry early."""
    out, table, last = bytearray(), [], b""
    width, held, bits = 9, 0, 0
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            table, last, width = [bytes([i]) for i in range(256)] + [b"", b""], b"", 9
            continue
        if not last:
            word = table[code]
        else:
            word = table[code] if code < len(table) else last + last[:1]
            table.append(last + word[:1])
        out += word
        last = word
        width = 9 + (len(table) >= 511) + (len(table) >= 1023) + (len(table) >= 2047)
    return bytes(out)


def unpacked(payload: bytes, compression: int) -> bytes:
    if compression == LZW:
        return unlzw(payload)
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompress(payload)
    if compression == ZSTD:
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(payload)
    return payload


def first_band(payload: bytes, dtype: str, height: int, width: int, bands: int, compression: int, predictor: int) -> np.ndarray:
    """The pixels of a block: differences along a row are summed (2), of reals byte plane by byte plane (3)."""
    raw, kind = unpacked(payload, compression), np.dtype(dtype)
    if predictor == 3:
        planes = np.frombuffer(raw, np.uint8, height * width * bands * kind.itemsize).reshape(height, -1, bands)
        planes = np.cumsum(planes, axis=1, dtype=np.uint8).reshape(height, kind.itemsize, width * bands)
        data = np.ascontiguousarray(planes.transpose(0, 2, 1)).view(kind.newbyteorder(">")).reshape(height, width, bands)
    else:
        data = np.frombuffer(raw, kind, height * width * bands).reshape(height, width, bands)
        if predictor == 2:
            data = np.cumsum(data, axis=1, dtype=kind.newbyteorder("="))
    return data[:, :, 0]


# ---- readers -------------------------------------------------------------------------------


def _files(spark: SparkSession, path: str) -> DataFrame:
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.read.schema(schema).format("binaryFile").load(path).select("path", "content")


def about(spark: SparkSession, path: str) -> DataFrame:
    """A row per file: size, bands, type, code of the reference system, missing value, and x0, x per column, x per row, y0, y per column, y per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                at = layout(content.as_buffer())
                yield _batch([(name, at.width, at.height, at.bands, at.dtype, at.epsg, at.nodata, at.transform)], ABOUT)

    return _files(spark, path).mapInArrow(run, ABOUT)


ARROW = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "array<double>": pa.list_(pa.float64()), "binary": pa.binary()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, types = zip(*[x.split(" ") for x in schema.split(", ")], strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, ARROW[t]) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=list(names))


def blocks(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """A row per strip or tile that meets the box, compressed as stored; one that is not stored has a null payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = content.as_buffer()
                at = layout(data)
                for i, row, col, height, width in at.blocks():
                    if not at.meets(row, col, height, width, box):
                        continue
                    start, size = int(at.offsets[i]), int(at.sizes[i])
                    payload = data[start : start + size].to_pybytes() if size else None
                    yield _batch([(name, i, row, col, height, width, at.height, at.width, at.dtype, at.bands, at.compression, at.predictor, at.nodata, at.transform, payload)], BLOCK)

    return _files(spark, path).mapInArrow(run, BLOCK)


RESULT = "path string, row int, col int, x double, y double, value double"


def read_raster(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """``path, row, col, x, y, value`` of each pixel of the first band; x and y are its centre in the file's reference system.

    Pixels of the missing value, and NaN, are left out.  ``box`` (least x and y, greatest x and y) keeps the pixels whose
    centres lie in it, and opens only blocks that meet it.  ``path`` may be a file, a folder or a pattern; the files
    may differ in size, type and compression.  A file that is no raster of these kinds fails the read with its reason.
    """
    dealt = blocks(spark, path, box).repartition("path", "number")
    names = ["path", "row", "col", "height", "width", "bottom", "right", "dtype", "bands", "compression", "predictor", "nodata", "transform", "payload"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name, row, col, height, width, bottom, right, dtype, bands, compression, predictor, nodata, transform, payload = (batch.column(j)[i].as_py() for j in range(len(names)))
                if payload is None:
                    if nodata is not None:
                        continue
                    pixels = np.zeros((height, width), dtype=dtype)
                else:
                    pixels = first_band(payload, dtype, height, width, bands, compression, predictor)
                pixels = pixels[: bottom - row, : right - col]  # tiles reach over the edge
                step = max(1, BATCH // width)
                for top in range(0, len(pixels), step):
                    part = pixels[top : top + step]
                    r, c = np.indices(part.shape).reshape(2, -1)
                    r, c, v = r + row + top, c + col, part.reshape(-1).astype(float)
                    x0, xc, xr, y0, yc, yr = transform
                    x, y = x0 + xc * (c + 0.5) + xr * (r + 0.5), y0 + yc * (c + 0.5) + yr * (r + 0.5)
                    keep = ~np.isnan(v)
                    if nodata is not None:
                        keep &= part.reshape(-1) != np.dtype(dtype).type(nodata) if np.dtype(dtype).kind == "f" else v != nodata
                    if box is not None:
                        keep &= (x >= box[0]) & (x <= box[2]) & (y >= box[1]) & (y <= box[3])
                    columns = [pa.array([name] * int(keep.sum()), pa.string()), pa.array(r[keep].astype(np.int32)), pa.array(c[keep].astype(np.int32)), *[pa.array(a[keep]) for a in (x, y, v)]]
                    yield pa.RecordBatch.from_arrays(columns, names=["path", "row", "col", "x", "y", "value"])

    return dealt.select(*names).mapInArrow(run, RESULT)
