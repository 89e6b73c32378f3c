"""Mixing sources to target weights, to the word.

Each document gets a key from a hash of its id.  Documents are range-sorted by source and
key, and distributed running totals of their words say what comes before each one; a source is cut
where its budget ends, in the midst of a document if need be.  A budget above the source's size
takes whole passes (epochs) first, and what is left in the same order.

Targets: a share of all words, by weight; no source beyond ``most`` times its size, its excess going to the others
by weight until none is above.

Null texts have no words; a source without words gets none.  Sources stand in the order of code
points, null last.  Rows that repeat an id have one key and follow each other by
size; equal rows are interchangeable, so the result is the same in every run.  One source may
hold any share of the rows.  Extra columns are ignored.  No documents: no rows.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isotherm.llm.store import small, stage
from isotherm.llm.totals import running_totals

#: fixed values: weights of the sources in their order, again and again
WEIGHTS = (5, 2, 1)
#: words of the mix as a share of all words; passes of a source at most
SHARE, MOST = Fraction(3, 2), 2
SEED = "mix"
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_key(key: Column, seed: str) -> Column:
    """60 bits of a hash of the id."""
    digest = F.sha2(F.encode(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), "UTF-8"), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: Fraction = SHARE, most: int = MOST) -> DataFrame:
    """``source, source_size, weight, target`` from ``source, source_size`` (a stage table of one row per source).

    Where sources of together less than the share are all capped, each has its cap.  The driver sees two sums a round.
    """
    listed = sizes.select(F.lit(0).alias("all"), F.col("source").isNull().alias("last"), "source", "source_size", F.lit(1).alias("one"))
    ranked = running_totals(listed, "all", ["last", "source"], "one")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("before") % len(weights) + 1).cast("int"))
    table = stage(ranked.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * most).alias("cap")), "sources")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    wanted, level = float(share * total), 0.0
    while True:
        # sources that the level so far fills to the cap stay there
        full = F.col("weight") * F.lit(level) >= F.col("cap")
        held = table.agg(F.sum(F.when(full, F.col("cap"))).alias("caps"), F.sum(F.when(~full, F.col("weight"))).alias("weights")).first()
        if not held.weights:
            level = float("inf")
            break
        higher = (wanted - (held.caps or 0)) / held.weights
        if higher <= level:
            break
        level = higher
    target = F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(level)) if level < float("inf") else F.col("cap").cast("double")
    return table.select("source", "source_size", "weight", target.alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: Fraction = SHARE, most: int = MOST, seed: str = SEED) -> DataFrame:
    """``id, text_hash, source, size, source_size, target, epochs, cut, taken`` for every row.

    ``epochs``: times that the whole text is taken; ``cut``: words taken in the last pass, from the start of the text.
    """
    rows = docs.select(F.col(source_col).alias("source"), F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"), word_count(F.col(text_col)).alias("size"), random_key(F.col(id_col), seed).alias("key"))
    sized = stage(rows.withColumn("row", F.monotonically_increasing_id()), "sizes")
    targets = stage(source_targets(stage(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "sources"), weights, share, most), "targets")
    placed = running_totals(sized, "source", ["key", "id", "size", "text_hash", "row"], "size").drop("total")
    named = targets.select(F.col("source").alias("in_source"), "source_size", "target", F.rint("target").cast("long").alias("budget"))
    joined = placed.join(small(named), F.col("source").eqNullSafe(F.col("in_source")))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(0).cast("long")
    out = joined.withColumn("epochs", F.when(F.col("size") > 0, passes).otherwise(0).cast("long"))
    left = F.col("budget") - passes * F.col("source_size") - F.col("before")
    out = out.withColumn("cut", F.greatest(F.lit(0), F.least(left, F.col("size"))).cast("long"))
    return out.select("id", "text_hash", "source", "size", "source_size", "target", "epochs", "cut", (F.col("epochs") * F.col("size") + F.col("cut")).alias("taken"))


def first_words(text: Column, n: Column) -> Column:
    """A text up to the end of its ``n``-th word."""
    pieces = F.arrays_zip(F.split(text, WORD, -1).alias("gap"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("word"))
    return F.array_join(F.transform(F.slice(pieces, F.lit(1), n), lambda p: F.concat(p["gap"], p["word"])), "")


def mixed_texts(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The mix itself: ``id, source, epoch, text``, a row per pass that takes words of a document; the last text of a source may be cut.

    Rows that repeat an id and a text are one document here, taken as often as all of them.
    """
    taken = mixed.where("taken > 0").groupBy(F.col("id").alias("in_id"), F.col("text_hash").alias("in_hash")).agg(F.sum("taken").alias("words"), F.first("size").alias("size"), F.first("source").alias("source"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("hash")).dropDuplicates(["id", "hash"])
    both = texts.join(taken, F.col("id").eqNullSafe(F.col("in_id")) & (F.col("hash") == F.col("in_hash")))
    passes = F.ceil(F.col("words") / F.col("size")).cast("int")
    each = both.select("id", "source", "text", "words", "size", F.explode(F.sequence(F.lit(1), passes)).alias("epoch"))
    left = F.col("words") - (F.col("epoch") - 1) * F.col("size")
    return each.select("id", "source", "epoch", F.when(left >= F.col("size"), F.col("text")).otherwise(first_words(F.col("text"), left.cast("int"))).alias("text"))


def mixture(docs: DataFrame) -> DataFrame:
    return mix(docs).select(F.col("id").alias("doc_id"), "size", "source_size", F.round("target", 6).alias("target"), "taken")
