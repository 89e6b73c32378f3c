"""Stage tables in the folder that all executors share.

Lineage is cut by writing Parquet there and reading it again; nothing is ever
kept on an executor's own disk, so a lost executor costs a task and no data.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_KEPT: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset on a local master (tests) a temporary one is set, on a cluster it must be."""
    conf = spark.sparkContext.getConf()
    at = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        master = conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="isotherm-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


#: rows of an Arrow batch between Spark and Python, where the session sets none: with whole texts the
#: default of 10,000 takes hundreds of MB beside the heap of an executor
ARROW_ROWS = 500
_ARROW = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    if _ARROW not in spark.conf.getAll:
        spark.conf.set(_ARROW, ARROW_ROWS)


def new_folder(spark: SparkSession, name: str) -> str:
    small_batches(spark)
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if not _KEPT:
        atexit.register(_sweep)
    _KEPT.append(path)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stage_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes stage tables that nothing will read again."""
    for df in tables:
        drop(df.sparkSession, df.stage_path)


def staged_alone(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """``make()`` as a stage table; every other table that was staged on the way to it is deleted."""
    before = len(_KEPT)
    out = stage(make(), name)
    for path in _KEPT[before:-1]:
        drop(out.sparkSession, path)
    del _KEPT[before:-1]
    return out


#: rows up to which a table of ids or small keys is broadcast
BROADCAST_ROWS = 500_000


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` marked for broadcast if it is counted to be small; beyond that the join shuffles."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= BROADCAST_ROWS else df


def drop(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _sweep() -> None:
    spark = SparkSession.getActiveSession()
    if spark is None:
        return
    for path in _KEPT:
        try:
            drop(spark, path)
        except Exception:  # the session may be gone by now; the folder is only scratch
            return
