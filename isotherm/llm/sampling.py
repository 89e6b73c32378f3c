"""The bounded sample of labelled rows that a classifier is fitted on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isotherm.llm.store import stage

#: bytes of text of each class that a fit takes, and the longest text among them
SAMPLE_BYTES = 8 << 20
LONGEST = SAMPLE_BYTES // 16


def labelled_sample(
    docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, per_class: int, keep: Column | None = None, sample_bytes: int = SAMPLE_BYTES, longest: int = LONGEST
) -> tuple[DataFrame, DataFrame]:
    """``id, label, text`` of the sample, and all ``id, label`` that ``keep`` admits.

    Of each class (0 or 1) the ``per_class`` ids of least ``xxhash64`` are candidates; of these, in the same
    order, as many as fit ``sample_bytes`` of text.  Ids whose texts exceed ``longest`` bytes teach
    nothing.  So rows and bytes are bounded whatever the corpus.  Null ids and other labels are left
    out; each row of a repeated id is an example, and counts towards the bytes.
    """
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)")
    marked = marked if keep is None else marked.where(keep)
    by = [F.xxhash64("id"), F.col("id")]
    picked = [marked.where(F.col("label") == k).orderBy(*by).limit(per_class).distinct() for k in (0, 1)]
    picked = stage(picked[0].unionByName(picked[1]), "picked")  # at most 2 * per_class rows
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sizes = own.select("id", F.octet_length("text").cast("long").alias("n")).join(F.broadcast(picked), "id").groupBy("id", "label").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("label").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0))
    taken = stage(sizes.where(F.col("n") <= longest).withColumn("upto", upto).where(F.col("upto") <= sample_bytes).select("id", "label"), "taken")
    return own.join(F.broadcast(taken), "id").select("id", "label", "text"), marked
