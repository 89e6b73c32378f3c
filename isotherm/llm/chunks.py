"""A corpus as packed chunks, and a distributed "how often is this key seen?".

Sorting every shingle or byte position of a corpus through a shuffle as rows
costs many times the corpus.  Here documents are packed into compressed chunks
once (a stage table, so a retried task sees the same chunks).  Each chunk *asks*
about its sorted distinct 64-bit keys, cut into hash ranges; each range
*answers* with one byte per key, in the order asked; the answers meet their
chunk again by ``chunk_id``.  A key that a third of all documents hold is asked
once per chunk, so no range grows with a hot key's document count.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isotherm.llm.store import stage

CHUNK_SCHEMA = "chunk_id long, ids array<long>, lens binary, data binary"
CHUNK_BYTES = 1 << 19
U64 = np.uint64
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)


# ---- hashing, on whole arrays -------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words."""
    x = x ^ (x >> U64(32))
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * U64(BASE))


class Rolling:
    """Hash of any substring of a byte array in O(1), from prefix sums."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        powers = np.full(n + 1, BASE, dtype=np.uint64)
        powers[0] = 1
        np.cumprod(powers, out=powers)
        inverse = np.full(n + 1, BASE_INVERSE, dtype=np.uint64)
        inverse[0] = 1
        np.cumprod(inverse, out=inverse)
        self.inverse = inverse
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(BYTE_CODES[data] * powers[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))

    def every(self, length: int) -> np.ndarray:
        n = len(self.sums) - 1 - length + 1
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        return mix((self.sums[length:] - self.sums[:n]) * self.inverse[:n] + U64(length))


# ---- chunks -------------------------------------------------------------------


def pack(texts: list[bytes]) -> tuple[bytes, bytes]:
    lens = np.array([len(t) for t in texts], dtype=np.int64)
    return lens.tobytes(), zstandard.ZstdCompressor(level=1).compress(b"".join(texts))


def unpack(lens: bytes, data: bytes) -> tuple[np.ndarray, bytes]:
    n = np.frombuffer(lens, dtype=np.int64)
    return n, zstandard.ZstdDecompressor().decompress(data, max_output_size=max(1, int(n.sum())))


def build_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per about ``chunk_bytes`` of text; null texts count as empty, one long text is a chunk of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        ids: list = []
        texts: list[bytes] = []
        size = 0

        def out():
            nonlocal made, ids, texts, size
            lens, data = pack(texts)
            row = pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) + made], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([lens], pa.binary()), pa.array([data], pa.binary())],
                names=["chunk_id", "ids", "lens", "data"],
            )
            made, ids, texts, size = made + 1, [], [], 0
            return row

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                t = (t.as_py() or "").encode("utf-8", "surrogatepass")
                ids.append(i)
                texts.append(t)
                size += len(t) + 32
                if size >= chunk_bytes:
                    yield out()
        if ids:
            yield out()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return stage(rows.mapInArrow(run, CHUNK_SCHEMA), "chunks")


# ---- ask and answer -----------------------------------------------------------

#: Bytes of a key that are asked.  Keys that agree in these get one answer, the same
#: everywhere; callers use answers as an order or to rule positions out, never as proof of equality.
SENT = 6

#: keys (sorted, distinct) and, per key, the same number of bytes of extra data
Asked = tuple[np.ndarray, np.ndarray]


def ranges_for(chunks: DataFrame, per_range: int = 16) -> int:
    return max(16, -(-chunks.count() // per_range))


def cut(keys: np.ndarray, n_ranges: int) -> np.ndarray:
    """Bounds of the ranges within sorted ``keys``."""
    edges = np.array([(i << 64) // n_ranges for i in range(1, n_ranges)], dtype=np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def ask(source: DataFrame, asked: Callable[[pd.Series], Asked], n_ranges: int) -> DataFrame:
    """For each chunk and range one row with that range's keys."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                yield ask_rows(row.chunk_id, *asked(row), n_ranges)

    return source.mapInPandas(run, "r int, chunk_id long, keys binary, extra binary")


def ask_rows(chunk_id: int, keys: np.ndarray, extra: np.ndarray, n_ranges: int) -> pd.DataFrame:
    at = cut(keys, n_ranges)
    full = np.flatnonzero(np.diff(at))
    return pd.DataFrame(
        {
            "r": full.astype(np.int32),
            "chunk_id": np.full(len(full), chunk_id, dtype=np.int64),
            "keys": [planes(keys[at[i] : at[i + 1]]) for i in full],
            "extra": [extra[at[i] : at[i + 1]].tobytes() for i in full],
        }
    )


def planes(keys: np.ndarray) -> bytes:
    """The first ``SENT`` bytes of sorted keys, plane by plane: the first planes compress well."""
    return keys.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :SENT].T.tobytes()


def unplanes(data: bytes) -> np.ndarray:
    a = np.frombuffer(data, dtype=np.uint8).reshape(SENT, -1)
    full = np.zeros((a.shape[1], 8), dtype=np.uint8)
    full[:, :SENT] = a.T
    return full.reshape(-1).view(">u8").astype(np.uint64)


def answer(asks: DataFrame, answered: Callable[[list[np.ndarray], list[bytes]], list[np.ndarray]], kind: int = 0) -> DataFrame:
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("chunk_id")  # rows arrive in any order; answers must not depend on it
        flags = answered([unplanes(k) for k in frame["keys"]], list(frame["extra"]))
        return pd.DataFrame(
            {
                "chunk_id": frame["chunk_id"],
                "kind": np.full(len(frame), kind, dtype=np.int32),
                "r": frame["r"],
                "flags": [np.ascontiguousarray(f, dtype=np.uint8).tobytes() for f in flags],
            }
        )

    return asks.groupBy("r").applyInPandas(run, "chunk_id long, kind int, r int, flags binary")


def flags_of(answers: pd.DataFrame, kind: int = 0) -> np.ndarray:
    """A chunk's answers, in the order of its keys."""
    own = answers[answers["kind"] == kind].sort_values("r")
    return np.frombuffer(b"".join(own["flags"]), dtype=np.uint8)


def with_answers(chunks: DataFrame, answers: DataFrame, fn: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    return chunks.groupBy("chunk_id").cogroup(answers.groupBy("chunk_id")).applyInPandas(fn, schema)
