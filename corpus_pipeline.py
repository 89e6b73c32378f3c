"""A corpus cleaned and packed, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
and read again as the next one's ``docs``; all but the last return the columns of ``docs``.

Null and blank texts stay to the end and are packed as the closing id alone; so do rows
without an id (they are no near copies of others but of their equals, and no benchmark
item is sought in them).  Rows that repeat an id are judged by their own texts.  Extra columns,
whatever their names, pass through.  No documents: no pieces.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isotherm.llm.decontaminate import decontaminate
from isotherm.llm.jaccard_join import keep_one
from isotherm.llm.packing import best_fit_packing
from isotherm.llm.queries import tokenizer_path
from isotherm.llm.secret_scan import redact_secrets
from isotherm.llm.store import release, staged_alone
from isotherm.llm.toxicity import below, train

SHINGLE_WORDS = 5
SIMILARITY = Fraction(4, 5)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores under one half."""
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return below(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the least id."""
    return keep_one(docs, width=SHINGLE_WORDS, threshold=SIMILARITY)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked; ``n_chars`` follows the text."""
    clean = redact_secrets(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece with its place in a training sequence."""
    return best_fit_packing(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("secret_scans", mask_secrets),
    ("best_fit_packing", pack_documents),
]

#: classifier and tokenizer are beyond SQL; tests hold the stages between against plain sets and patterns, and those two against recounts and the tokenizer itself
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, step in STAGES[:-1]:
        docs = staged_alone(lambda step=step, docs=docs: step(spark, docs, sf_dir), name)
        if before is not None:
            release(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
