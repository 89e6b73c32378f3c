"""Benchmark decontamination by size-partitioned MinHash containment search.

A short item inside a long document has a tiny Jaccard similarity with it, so
the search asks for containment: the share of the item's shingles that the
document has.  Items are partitioned by size, by doublings.  In a partition
with upper size u an item's signature is its ``floor((1 - t) u) + 1`` least
shingle hashes (a bottom-k MinHash).  A document with containment t or more lacks
at most ``floor((1 - t) n)`` of the item's n <= u shingles, hence holds at least one of the
signature: every true pair is a candidate.  Candidates are verified by exact containment of
the shingles themselves, as strings.

Shingles are ``width`` words, lower-cased; an item with fewer words is one
shingle of all of them and is sought among runs of as many words.  Only
widths that occur among the items are made.  DataFrame functions alone run here.
The signature table is broadcast while it is below ``store.BROADCAST_ROWS`` rows and
shuffled beyond; so are the candidates' ids.

Null or blank texts and items match nothing; so does a null id.  Rows that
repeat an id are one document (or item) with all their shingles.  Extra columns are ignored.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isotherm.llm.store import small, stage


def word_array(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def hashed_runs(words: Column, width: int) -> Column:
    """Hashes of all runs of ``width`` words."""
    at = F.when(F.size(words) >= width, F.sequence(F.lit(0), F.size(words) - width)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(width)]))


def string_runs(words: Column, width: int) -> Column:
    at = F.when(F.size(words) >= width, F.sequence(F.lit(0), F.size(words) - width)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.concat_ws(" ", *[F.get(words, i + k) for k in range(width)]))


def contaminated_pairs(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", width: int = 5, threshold: Fraction = Fraction(4, 5)) -> DataFrame:
    """``doc_id, item_id, n_item, n_shared, containment`` of every pair at or above the threshold."""
    t = Fraction(threshold)
    held = items.select(F.col(item_col).alias("item_id"), word_array(F.col(text_col)).alias("w")).where("item_id is not null and size(w) > 0")
    held = held.withColumn("width", F.least(F.size("w"), F.lit(width)))
    runs = F.coalesce(*[F.when(F.col("width") == k, string_runs(F.col("w"), k)) for k in range(1, width + 1)])
    shingles = held.select("item_id", "width", F.explode(runs).alias("shingle")).distinct()
    sized = shingles.join(shingles.groupBy("item_id").agg(F.count("*").alias("n_item")), "item_id")
    words = F.split("shingle", " ")
    hashed = F.coalesce(*[F.when(F.col("width") == k, F.xxhash64(*[F.get(words, F.lit(i)) for i in range(k)])) for k in range(1, width + 1)])
    table = stage(sized.withColumn("h", hashed), "items")
    upper = F.pow(F.lit(2.0), F.ceil(F.log2("n_item") - 1e-9)).cast("long")
    keep = F.floor(upper * (t.denominator - t.numerator) / t.denominator).cast("long") + 1
    ranked = table.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy("h", "shingle"))).where(F.col("rank") <= keep)
    signature = stage(ranked.select("h", "item_id", "width").distinct(), "signature")
    widths = [r.width for r in signature.select("width").distinct().collect()]  # at most ``width`` rows

    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    if not widths:
        empty = "doc_id long, item_id long, n_item long, n_shared long, containment double"
        return docs.sparkSession.createDataFrame([], empty)
    probes = own.select("doc_id", word_array(F.col("text")).alias("w"))
    probes = probes.select("doc_id", F.explode(F.concat(*[hashed_runs(F.col("w"), k) for k in sorted(widths)])).alias("h"))
    met = probes.join(small(signature.select("h", "item_id"), signature.count()), "h")
    candidates = stage(met.select("doc_id", "item_id").distinct(), "candidates")

    # exact verification, of the candidates' documents alone
    ids = candidates.select("doc_id").distinct()
    again = own.join(small(ids, candidates.count()), "doc_id", "left_semi")
    runs = F.array_distinct(F.concat(*[string_runs(F.col("w"), k) for k in sorted(widths)]))
    parts = again.select("doc_id", word_array(F.col("text")).alias("w")).select("doc_id", F.explode(runs).alias("shingle"))
    sought = table.select("shingle", "item_id", "n_item")
    shared = parts.join(small(sought, table.count()), "shingle").groupBy("doc_id", "item_id", "n_item").agg(F.countDistinct("shingle").alias("n_shared"))
    enough = shared.where(F.col("n_shared") * t.denominator >= F.col("n_item") * t.numerator)
    return enough.join(candidates, ["doc_id", "item_id"], "left_semi").withColumn("containment", F.col("n_shared") / F.col("n_item"))


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """``docs`` without those that contain an item."""
    bad = stage(contaminated_pairs(docs, items, id_col=id_col, **how).select(F.col("doc_id").alias(id_col)).distinct(), "contaminated")
    return docs.join(small(bad), id_col, "left_anti").select(*docs.columns)
