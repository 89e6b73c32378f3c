"""Running totals within groups, distributed: no group has to fit a task.

Rows are range-partitioned by group and order, so a group that holds a third of
all rows spreads over many partitions.  Each partition adds up its own rows; one
row per partition and group (at most partitions plus groups of them) then gives
what stands before.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isotherm.llm.store import small, stage


def running_totals(rows: DataFrame, by: str, order: list[str], value: str) -> DataFrame:
    """``rows`` with ``before``, the sum of ``value`` (whole numbers) over what ``order`` puts ahead within the group, and ``total``, the group's sum.

    ``rows`` is a stage table: its order must be the same whenever it is read, so ``order`` ends with
    a column that no two rows share.  Nulls of ``by`` are a group; nulls sort first.
    """
    fields = [*rows.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("ahead", T.LongType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, group, sum_ = TaskContext.get().partitionId(), (), 0
        for batch in batches:
            ahead = []
            for g, v in zip(batch.column(by).to_pylist(), batch.column(value).to_pylist(), strict=True):
                if group != (g,):
                    group, sum_ = (g,), 0
                ahead.append(sum_)
                sum_ += v
            new = [pa.array([part] * len(ahead), pa.int32()), pa.array(ahead, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, "part", "ahead"])

    dealt = rows.repartitionByRange(by, *order).sortWithinPartitions(by, *order)
    placed = stage(dealt.mapInArrow(run, T.StructType(fields)), "placed")
    parts = placed.groupBy(F.col("part").alias("in_part"), F.col(by).alias("in_group")).agg(F.sum(value).alias("own"))
    group = Window.partitionBy("in_group")
    base = F.coalesce(F.sum("own").over(group.orderBy("in_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = stage(parts.select("in_part", "in_group", base.alias("base"), F.sum("own").over(group).alias("total")), "bases")
    joined = placed.join(small(bases), (F.col("part") == F.col("in_part")) & F.col(by).eqNullSafe(F.col("in_group")))
    return joined.select(*rows.columns, (F.col("base") + F.col("ahead")).alias("before"), "total")
