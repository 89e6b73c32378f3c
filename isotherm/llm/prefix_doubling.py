"""Removal of repeated byte strings by prefix doubling to the letter: every position is ranked, by DataFrame operations alone.

Positions begin with their first ``FIRST`` bytes as rank.  A round pairs the rank of a position with that of the position
one offset further, groups equal pairs, and reranks: the new rank is the least position of the group, so it needs no order among
groups.  Positions that are alone in their group leave; so do those whose further half has left.  Offsets double
until the next would pass ``length``; the last round overlaps.  What is left starts a string of ``length`` bytes that also starts elsewhere.

Exact: ranks are positions, not fingerprints.  It moves every position through three shuffles in the first round, some 25 bytes each,
which ``suffix_dedup`` avoids; README has both measured.  Groups of equal pairs are counted before they are shuffled, so a
prefix of a third of all positions is some rows per task.

Texts are whole; null is empty; matches never cross documents; rows that repeat a ``doc_id`` are documents of their own.
Extra columns are ignored.  A text under ``length`` bytes loses nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isotherm.llm.store import stage

FIRST = 8
#: bits of a position that hold the place within its text
PLACE = 31


def _reranked(pairs: DataFrame) -> DataFrame:
    """``row, at, rank`` of the positions whose pair of ranks is found elsewhere."""
    groups = pairs.groupBy("a", "b").agg(F.min(F.shiftleft("row", PLACE).bitwiseOR(F.col("at"))).alias("rank"), F.count("*").alias("n")).where("n > 1")
    return pairs.join(groups, ["a", "b"]).select("row", "at", "rank")


def repeated_starts(rows: DataFrame, length: int) -> DataFrame:
    """``row, at`` of each place in ``rows`` (row, data binary) where a string of ``length`` bytes starts that starts elsewhere as well."""
    if length < FIRST:
        raise ValueError(f"strings of {FIRST} bytes at least")
    places = F.explode(F.sequence(F.lit(0), F.octet_length("data") - FIRST))
    every = rows.where(F.octet_length("data") >= length).select("row", "data", places.alias("at"))
    first = F.conv(F.hex(F.expr(f"substring(data, at + 1, {FIRST // 2})")), 16, 10).cast("long")
    second = F.conv(F.hex(F.expr(f"substring(data, at + 1 + {FIRST // 2}, {FIRST // 2})")), 16, 10).cast("long")
    ranks = stage(_reranked(every.select("row", "at", first.alias("a"), second.alias("b"))), "ranks")
    reach = FIRST
    while reach < length:
        offset = min(reach, length - reach)
        further = ranks.select("row", (F.col("at") - offset).alias("at"), F.col("rank").alias("b"))
        ranks = stage(_reranked(ranks.select("row", "at", F.col("rank").alias("a")).join(further, ["row", "at"])), "ranks")
        reach += offset
    return ranks.select("row", "at")


def prefix_doubling_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200) -> DataFrame:
    """Per row ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``, as ``suffix_dedup`` has them."""
    data = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    rows = stage(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), data.alias("data")), "rows")
    # the ids hold their partition above 33 bits: counted on from partition to partition they are small enough to share a rank with the place
    part, within = F.shiftright("row", 33), F.col("row").bitwiseAND((1 << 33) - 1)
    sizes = {r.part: r.n for r in rows.groupBy(part.alias("part")).agg((F.max(within) + 1).alias("n")).collect()}  # a row per partition
    base, total = [F.lit(-1), F.lit(0)], 0
    for at in sorted(sizes):
        base, total = [*base, F.lit(at), F.lit(total)], total + sizes[at]
    if total >> (63 - PLACE):
        raise ValueError(f"at most {1 << (63 - PLACE)} rows")
    rows = rows.select((F.element_at(F.create_map(*base), part.cast("int")) + within).cast("long").alias("row"), "doc_id", "data")
    before = F.lag("at").over(Window.partitionBy("row").orderBy("at"))
    opens = (before.isNull() | (F.col("at") - before > length)).cast("int")
    runs = repeated_starts(rows, length).withColumn("opens", opens).withColumn("run", F.sum("opens").over(Window.partitionBy("row").orderBy("at")))
    spans = runs.groupBy("row", "run").agg(F.min("at").alias("start"), (F.max("at") + length).alias("end"))
    spans = spans.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    whole = rows.join(spans, "row", "left").withColumn("spans", F.coalesce("spans", F.expr("cast(array() as array<struct<start: int, end: int>>)")))
    n_bytes = F.octet_length("data").cast("long")
    closed = F.concat("spans", F.array(F.struct(F.octet_length("data").alias("start"), F.octet_length("data").alias("end"))))
    begin = F.struct(F.lit(b"").alias("kept"), F.lit(0).alias("at"))
    kept = F.aggregate(closed, begin, lambda s, x: F.struct(F.concat(s["kept"], F.substring(F.col("data"), s["at"] + 1, x["start"] - s["at"])).alias("kept"), x["end"].alias("at")))["kept"]
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return whole.select("doc_id", n_bytes.alias("n_bytes"), removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2(kept, 256).alias("kept_sha256"))
