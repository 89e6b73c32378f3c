"""Tiled runs that die and are taken up again."""

import pytest
from pyspark.sql import functions as F

from isotherm.sources.tiles import TileRun

SCHEMA = "cell int, v double"


def wanted(spark, tiles=8, years=(2000, 2003)):
    return spark.range(tiles).select(F.format_string("t%d", "id").alias("tile")).crossJoin(spark.range(*years).select(F.col("id").cast("int").alias("year")))


def worker(seen, value=1.0, fail_on=None):
    """Two cells a key, none for tile t3; notes the keys, and fails in the midst of writing when it meets ``fail_on``."""

    def compute(keys):
        seen.extend(tuple(r) for r in keys.collect())
        rows = keys.where("tile <> 't3'").withColumn("cell", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("v", F.lit(value) * (F.col("year") - 2000) + F.col("cell"))
        if fail_on and fail_on in [s[0] for s in seen]:
            return rows.withColumn("v", F.when(F.col("cell") == 1, F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("v")))
        return rows

    return compute


def result(run):
    return sorted((r.tile, r.year, r.cell, r.v) for r in run.read(SCHEMA).collect())


def expected(value=1.0):
    return sorted((f"t{i}", y, c, value * (y - 2000) + c) for i in range(8) if i != 3 for y in (2000, 2001, 2002) for c in (0, 1))


def test_a_killed_run_computes_only_the_rest(spark, tmp_path):
    run, seen = TileRun(spark, str(tmp_path)), []
    assert run.run(wanted(spark), worker(seen), batch_keys=6, most_batches=2) == 2
    first = set(seen)
    assert 0 < len(first) < 24 and {tuple(r) for r in run.finished().select("tile", "year").collect()} == first
    again = []
    TileRun(spark, str(tmp_path)).run(wanted(spark), worker(again), batch_keys=6)
    assert set(again) == {(f"t{i}", y) for i in range(8) for y in (2000, 2001, 2002)} - first and len(again) == len(set(again))
    assert result(run) == expected()
    last = []
    assert run.run(wanted(spark), worker(last)) == 0 and not last  # sea counts as finished


def test_a_batch_that_dies_leaves_nothing(spark, tmp_path):
    run, seen = TileRun(spark, str(tmp_path)), []
    with pytest.raises(Exception, match="lost"):
        run.run(wanted(spark), worker(seen, fail_on="t5"), batch_keys=4)
    done = {tuple(r) for r in run.finished().select("tile", "year").collect()}
    assert done < {tuple(r) for r in wanted(spark).collect()} and not any(t == "t5" for t, _ in done)
    assert {r[:2] for r in result(run)} <= done
    rest = []
    run.run(wanted(spark), worker(rest), batch_keys=4)
    assert not set(rest) & done and result(run) == expected()


def test_keys_are_replaced_whole(spark, tmp_path):
    run = TileRun(spark, str(tmp_path))
    run.run(wanted(spark), worker([]))
    part = wanted(spark).where("tile = 't1'")
    run.run(part, worker([], value=5.0), again=True)
    assert result(run) == sorted([r for r in expected() if r[0] != "t1"] + [r for r in expected(5.0) if r[0] == "t1"])
    assert {r.tile for r in run.read(SCHEMA, part).collect()} == {"t1"}
    # a row written beside the manifest is never read
    run.read(SCHEMA).limit(1).drop("place").withColumn("batch", F.lit("stray")).write.mode("append").partitionBy("batch", "tile", "year").parquet(f"{tmp_path}/data")
    assert len(result(run)) == len(expected())


def test_overlapping_tiles_merge_last(spark, tmp_path):
    run = TileRun(spark, str(tmp_path))
    run.run(wanted(spark, 2, (2000, 2001)).where("tile = 't0'"), worker([], 0.0))
    run.run(wanted(spark, 2, (2000, 2001)), lambda keys: worker([])(keys).withColumn("v", F.lit(9.0)))
    merged = {(r.year, r.cell): r.v for r in run.merge(SCHEMA, ["year", "cell"], "v").collect()}
    assert merged == {(2000, 0): 9.0, (2000, 1): 9.0}
    assert TileRun(spark, str(tmp_path / "none")).read(SCHEMA).count() == 0


def test_what_is_not_listed_is_not_opened(spark, tmp_path):
    run = TileRun(spark, str(tmp_path))
    run.run(wanted(spark), worker([]), batch_keys=5)
    df = run.read(SCHEMA, wanted(spark).where("tile = 't2' and year = 2001"))
    df.collect()
    assert "dynamicpruning" in df._jdf.queryExecution().executedPlan().toString().lower()
