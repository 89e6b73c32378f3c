"""Tiled runs that can be resumed: what is finished is listed in a manifest, and only that is ever read.

A run goes through its missing (tile, year) keys in batches.  A batch is one Spark job: it
writes its rows to a partition of its own, and only then adds its keys to the manifest, in one
file that Spark's commit renames into place.  A run that dies in between leaves a partition that
nothing lists, so it changes nothing.  A key that is run again is listed again, and its latest
entry counts: readers see its old rows or its new ones, never both.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isotherm.operators.zonal import last_wins


class TileRun:
    """Finished keys and their rows under ``path``; ``keys``: the key columns and their types, as ``tile string, year int``."""

    def __init__(self, spark: SparkSession, path: str, keys: str = "tile string, year int"):
        self.spark, self.path = spark, path.rstrip("/")
        self.schema = T.StructType.fromDDL(keys)
        self.keys = self.schema.names

    # ---- the manifest ------------------------------------------------------------------

    def entries(self) -> DataFrame:
        """Every entry ever made: the keys, ``batch``, ``place`` (its order) and ``n_rows``."""
        schema = T.StructType([*self.schema.fields, T.StructField("batch", T.StringType()), T.StructField("place", T.LongType()), T.StructField("n_rows", T.LongType())])
        folder = f"{self.path}/manifest"
        if not _exists(self.spark, folder):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(folder)

    def finished(self) -> DataFrame:
        """The latest entry of each key."""
        latest = F.max(F.struct("place", "batch", "n_rows")).alias("last")
        return self.entries().groupBy(*self.keys).agg(latest).select(*self.keys, "last.batch", "last.place", "last.n_rows")

    def missing(self, wanted: DataFrame) -> DataFrame:
        """Keys that are wanted and not finished."""
        return wanted.select(*self.keys).distinct().join(self.finished().select(*self.keys), self.keys, "left_anti")

    # ---- runs --------------------------------------------------------------------------

    def run(self, wanted: DataFrame, compute: Callable[[DataFrame], DataFrame], batch_keys: int = 256, again: bool = False, most_batches: int | None = None) -> int:
        """Computes what is missing of ``wanted`` and returns the number of batches that ran.

        ``compute`` gets a table of keys and returns rows with the key columns; a key without a row (a tile of sea) is
        finished as well.  Keys are not null.  ``again`` runs all wanted keys anew.  ``most_batches`` ends early, as a lost driver would.
        """
        plan = f"{self.path}/plan-{uuid.uuid4().hex}"
        left = wanted.select(*self.keys).distinct() if again else self.missing(wanted)
        # the plan is written: what is missing must not change under a batch that is running
        left.write.parquet(plan)
        left = self.spark.read.schema(self.schema).parquet(plan)
        n_batches = -(-left.count() // batch_keys)
        first = (self.entries().agg(F.max("place")).first()[0] or 0) + 1
        ran = 0
        for k in range(n_batches if most_batches is None else min(n_batches, most_batches)):
            part = left.where(F.pmod(F.xxhash64(*self.keys), F.lit(n_batches)) == k)
            self._batch(part, compute, first + k)
            ran += 1
        _delete(self.spark, plan)
        return ran

    def _batch(self, keys: DataFrame, compute: Callable[[DataFrame], DataFrame], place: int) -> None:
        name = uuid.uuid4().hex
        folder = f"{self.path}/data/batch={name}"
        out = compute(keys)
        # rows of a key lie together, so that a reader of some keys opens few files
        out.repartition(*self.keys).write.partitionBy(*self.keys).parquet(folder)
        rows = self.spark.read.schema(out.schema).parquet(folder).groupBy(*self.keys).agg(F.count("*").alias("n_rows"))
        entry = keys.join(rows, self.keys, "left").select(*self.keys, F.lit(name).alias("batch"), F.lit(place).cast("long").alias("place"), F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_rows"))
        entry.coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")  # one file: all keys of the batch, or none

    # ---- results -----------------------------------------------------------------------

    def read(self, schema: str, wanted: DataFrame | None = None) -> DataFrame:
        """Rows of the finished keys (of those wanted), with ``place``: the order in which they were written."""
        listed = self.finished().where("n_rows > 0").drop("n_rows")
        if wanted is not None:
            listed = listed.join(wanted.select(*self.keys).distinct(), self.keys, "left_semi")
        own = [f for f in T.StructType.fromDDL(schema).fields if f.name not in self.keys]
        full = T.StructType([*own, T.StructField("batch", T.StringType()), *self.schema.fields])
        folder = f"{self.path}/data"
        data = self.spark.read.schema(full).parquet(folder) if _exists(self.spark, folder) else self.spark.createDataFrame([], full)
        # batch and keys are partition columns: what is not listed is not opened
        return data.join(F.broadcast(listed), ["batch", *self.keys]).drop("batch")  # a row per finished key

    def merge(self, schema: str, cell: list[str], value: str, wanted: DataFrame | None = None) -> DataFrame:
        """One value per cell and key columns other than the tile's: where tiles overlap, the last write wins."""
        rows = self.read(schema, wanted)
        order = F.struct("place", *self.keys)
        return last_wins(rows.withColumn("_order", order), cell, "_order", value)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
