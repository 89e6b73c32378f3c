"""Best-fit packing planned on a histogram of lengths.

Pieces of at most ``capacity`` tokens are packed by best-fit decreasing.  The
driver sees counts of lengths only (at most ``capacity`` numbers): bins that are
filled alike are one group with a count, so the plan's size depends on
``capacity`` and never on the number of documents.  A plan line says "pieces
of this length, from this rank on, take these bins, so many per bin, from this offset on";
pieces then take their slots by joining on length and rank within length.
Ranks come from counts per (length, salt) and a window within each, so a
length that a third of all pieces share is spread over ``SALTS`` tasks.

A null text counts as empty (its document is the closing id alone).  Rows that repeat a ``doc_id`` are
packed one by one.  Extra columns are ignored.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isotherm.llm.encoder import WordEncoder
from isotherm.llm.store import small, stage

CAPACITY = 2048
SALTS = 512
#: texts are tokenized in batches of about so many characters; longer texts are cut at white space for it
BATCH_CHARS = 250_000
SPACE = re.compile(r"[ \t\n\x0b\x0c\r]")
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def segments(text: str, size: int = BATCH_CHARS) -> Iterator[str]:
    """``text`` cut at the first white space after every ``size`` characters; no token reaches across one."""
    at = 0
    while len(text) - at > size:
        cut = SPACE.search(text, at + size)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def tokenize(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", close: int = 0, ids: bool = False) -> DataFrame:
    """Pieces of the token ids of each text and a closing id; with ``ids``, the ids themselves as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(tokenizer_path)
        end = np.array([close], dtype="<u4").tobytes()
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
        n = 6 if ids else 5

        def encoded(keys: list, texts: list[str]) -> pa.RecordBatch:
            if len(texts) == 1:
                found = [b"".join(encoder.encode([part])[0] for part in segments(texts[0]))]
            else:
                found = encoder.encode(texts)
            rows = []
            for key, own in zip(keys, found, strict=True):
                own += end
                for piece, at in enumerate(range(0, len(own), 4 * capacity)):
                    cut = own[at : at + 4 * capacity]
                    rows.append((key, piece, at // 4, len(cut) // 4, zlib.crc32(cut), cut))
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns[:n], types[:n], strict=True)], names=names[:n])

        keys, texts, size = [], [], 0
        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = value.as_py() or ""
                if keys and size + len(text) > BATCH_CHARS:
                    yield encoded(keys, texts)
                    keys, texts, size = [], [], 0
                keys.append(key)
                texts.append(text)
                size += len(text)
        if keys:
            yield encoded(keys, texts)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, PIECES + (", ids binary" if ids else ""))


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Lines ``length, first rank, pieces, first bin, pieces per bin, offset`` of best-fit decreasing over counts.

    Pieces of one line take ranks from ``first rank`` on: rank r goes to bin
    ``first bin + (r - first rank) // per bin`` at
    ``offset + length * ((r - first rank) % per bin)``.
    """
    free: dict[int, list[tuple[int, int]]] = {}  # room left: groups (first bin, number)
    rooms: list[int] = []  # sorted keys of free
    lines: list[tuple[int, int, int, int, int, int]] = []
    bins = 0

    def put(room: int, first: int, number: int) -> None:
        if room and number:
            if room not in free:
                free[room] = []
                bisect.insort(rooms, room)
            free[room].append((first, number))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                per = capacity // length
                put(capacity, bins, -(-left // per))
                bins += -(-left // per)
                continue
            room = rooms[at]
            first, number = free[room].pop()
            if not free[room]:
                del free[room]
                rooms.pop(at)
            per = room // length
            whole = min(number, left // per)
            if whole:
                lines.append((length, rank, whole * per, first, per, capacity - room))
                rank, left = rank + whole * per, left - whole * per
                put(room - per * length, first, whole)
            if left and whole < number:  # the rest fits one bin
                lines.append((length, rank, left, first + whole, left, capacity - room))
                put(room - left * length, first + whole, 1)
                put(room, first + whole + 1, number - whole - 1)
                rank, left = rank + left, 0
            elif whole < number:
                put(room, first + whole, number - whole)
    return lines


def pack(pieces: DataFrame, capacity: int = CAPACITY, salts: int = SALTS) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``.  ``pieces`` must be a stage table: it is read more than once."""
    spark = pieces.sparkSession
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    counts = stage(counts, "lengths")  # at most capacity x salts rows
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    lines = plan(histogram, capacity)
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "salt", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    if not lines:
        return pieces.withColumns({"sequence_id": F.lit(None).cast("long"), "offset": F.lit(None).cast("long")})
    # each (length, salt) takes along the few lines that its ranks cross
    table = spark.createDataFrame(lines, "length long, low long, pieces long, bin long, per long, at long")
    crossed = (F.col("low") < F.col("base") + F.col("n")) & (F.col("low") + F.col("pieces") > F.col("base"))
    spread = offsets.join(small(table, len(lines)), "length").where(crossed)
    spread = spread.groupBy("length", "salt", "base").agg(F.array_sort(F.collect_list(F.struct("low", "pieces", "bin", "per", "at"))).alias("lines"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("k", F.row_number().over(within) - 1).join(spread, ["length", "salt"]).withColumn("rank", F.col("base") + F.col("k"))
    found = F.element_at(F.filter("lines", lambda x: (x["low"] <= F.col("rank")) & (F.col("rank") < x["low"] + x["pieces"])), 1)
    placed = ranked.withColumn("line", found)
    step = F.col("rank") - F.col("line.low")
    return placed.select(
        *pieces.columns,
        (F.col("line.bin") + F.floor(step / F.col("line.per"))).cast("long").alias("sequence_id"),
        (F.col("line.at") + F.col("length") * (step % F.col("line.per"))).cast("long").alias("offset"),
    )


def best_fit_packing(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, **columns) -> DataFrame:
    return pack(stage(tokenize(docs, tokenizer_path, capacity, **columns), "pieces"), capacity)
