"""Calendar-day thresholds and exceedance frequencies of long daily tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from isotherm.functions.calendar import CIRCLE, pooled_days
from isotherm.functions.percentile import METHODS
from isotherm.operators.panel import null_safe_left

#: percentiles of one sorted pool of values; the place is a fraction of its last index
POOLED = {
    "nearest": lambda pool, share: pool[int(np.rint(share * (len(pool) - 1)))],
    "linear": lambda pool, share: np.interp(share * (len(pool) - 1), np.arange(len(pool)), pool),
}


#: rows that a task sorts by cell at once before they are shuffled
PACK = 1 << 20
#: what a row is for: the climatology, the season; whether it has a value
BASE, SEASON, VALID = 1, 2, 4


def seen_days(daily: DataFrame, date: str, years: tuple[int, int], months: list[int]) -> list[int]:
    """Calendar days that fall in the months in any of the years; at most 366, found by a scan of the dates alone."""
    rows = daily.where(F.year(date).between(*years) & F.month(date).isin(months)).select(F.dayofyear(date).alias("doy")).distinct().collect()
    return sorted(r.doy for r in rows)


def _number_type(kind: T.DataType) -> np.dtype | None:
    """How values of a column are held in bytes; nothing for types that are not plain numbers."""
    found = {T.FloatType: "<f4", T.DoubleType: "<f8", T.ByteType: "<i1", T.ShortType: "<i2", T.IntegerType: "<i4", T.LongType: "<i8"}.get(type(kind))
    return np.dtype(found) if found else None


def packed(rows: DataFrame, cell: list[str]) -> DataFrame:
    """``cell..., _c, _v``: of ``rows`` (cell..., doy, year, use, value) a row per cell and task, days (``use``, day and year in one number) and values as bytes.

    So a cell's days are shuffled as a few rows of some eight bytes a day, not as rows of their own, and
    are never sorted by Spark.
    """
    kind = _number_type(rows.schema["value"].dataType)

    def pack(table: pa.Table) -> pa.RecordBatch:
        codes = [table.column(c).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy() for c in cell]
        order = np.lexsort(codes)
        new = np.zeros(len(order), dtype=bool)
        new[:1] = True
        for c in codes:
            new[1:] |= np.diff(c[order]) != 0
        starts = np.flatnonzero(new)
        parts = [table.column("code").to_numpy().astype("<i4"), table.column("value").fill_null(0).to_numpy().astype(kind)]
        first = pa.array(order[starts])
        keys = [table.column(c).combine_chunks().take(first) for c in cell]
        return pa.RecordBatch.from_arrays([*keys, *(_blobs(x[order], starts) for x in parts)], names=[*cell, "_c", "_v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= PACK:
                yield pack(pa.Table.from_batches(held))
                held, n = [], 0
        if n:
            yield pack(pa.Table.from_batches(held))

    schema = T.StructType([*[rows.schema[c] for c in cell], *[T.StructField(c, T.BinaryType()) for c in ("_c", "_v")]])
    code = F.col("use") + F.when(F.col("value").isNotNull(), VALID).otherwise(0) + F.col("doy") * 8 + F.col("year") * 4096
    return rows.select(*cell, code.cast("int").alias("code"), "value").mapInArrow(run, schema)


def _blobs(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    offsets = (np.append(starts, len(values)) * values.itemsize).astype("<i4")
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())])


def _unpacked(table: pa.Table, kind: np.dtype) -> tuple[np.ndarray, ...]:
    """Days, years, uses and values of a cell."""
    code, values = (np.frombuffer(b"".join(table.column(c).to_pylist()), dtype=t) for c, t in zip(("_c", "_v"), ("<i4", kind), strict=True))
    return code >> 3 & 511, code >> 12, code & 7, values


def _windows(doy: np.ndarray, values: np.ndarray, wanted: np.ndarray, share: float, half_width: int, method: str) -> tuple[np.ndarray, np.ndarray]:
    """Days with values in their window, and the percentile of each: values in the order of days, three times round the circle, so that a window is a slice."""
    pick = POOLED[method]
    order = np.argsort(doy, kind="stable")
    doy, values = doy[order].astype(np.int64), np.tile(values[order], 3)
    circle = np.concatenate([doy - CIRCLE, doy, doy + CIRCLE])
    low, high = np.searchsorted(circle, wanted - half_width, side="left"), np.searchsorted(circle, wanted + half_width, side="right")
    full = np.flatnonzero(high > low)
    return wanted[full], np.array([pick(np.sort(values[a:b]), share) for a, b in zip(low[full], high[full], strict=True)])


def thresholds(daily: DataFrame, cell: list[str], value: str, date: str, years: tuple[int, int], load_months: list[int], season_months: list[int], percent: float = 95.0, half_width: int = 7, method: str = "nearest", to: str = "threshold") -> DataFrame:
    """``cell..., doy, threshold``: percentile of all values within ``half_width`` calendar days, over all years.

    Target days are the calendar days seen in a season month in any year.  Values
    are shuffled once, by cell, packed (see ``packed``), and nulls leave before it.  Floats and integers
    then go cell by cell, as Arrow, to slices of a circle of days: a value is
    neither copied for each window nor kept beyond its cell (all days of the
    loaded months and years, some 3,000 values).  Other types and the
    approximate percentile explode each value to its windows instead.
    """
    base = daily.where(F.year(date).between(*years) & F.month(date).isin(load_months))
    targets = seen_days(base, date, years, season_months)
    held = base.where(F.col(value).isNotNull()).select(*cell, F.dayofyear(date).alias("doy"), F.col(value).alias("value"))
    kind = _number_type(daily.schema[value].dataType)
    if method in POOLED and kind is not None and 2 * half_width < CIRCLE:
        fields = [daily.schema[c] for c in cell] + [T.StructField("doy", T.IntegerType()), T.StructField(to, daily.schema[value].dataType if method == "nearest" else T.DoubleType())]
        schema = T.StructType(fields)
        arrow, wanted = to_arrow_schema(schema), np.array(targets, dtype=np.int64)

        def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            doy, _, _, values = _unpacked(table, kind)
            days, found = _windows(doy, values, wanted, percent / 100, half_width, method)
            own = [pa.array([k.as_py()] * len(days), f.type) for k, f in zip(key, arrow, strict=False)]
            return pa.table([*own, pa.array(days, pa.int32()), pa.array(found.astype(kind if method == "nearest" else float))], schema=arrow)

        rows = held.select("*", F.lit(0).alias("year"), F.lit(BASE).alias("use"))
        return packed(rows, cell).groupBy(*cell).applyInArrow(run, schema)
    pooled = pooled_days(held.repartition(*cell), "doy", half_width).where(F.col("target_doy").isin(targets))
    return pooled.groupBy(*cell, F.col("target_doy").alias("doy")).agg(METHODS[method]("value", percent).alias(to))


def heat_frequency(daily: DataFrame, cell: list[str], value: str, date: str, years: tuple[int, int], load_months: list[int], season_months: list[int], freq_years: tuple[int, int], percent: float = 95.0, half_width: int = 7, method: str = "nearest", year: Column | None = None, inclusive: bool = False, nodata: str = "zero") -> DataFrame:
    """``frequency`` over ``thresholds`` of the same table, in one shuffle: a cell's climatology, its thresholds and its season's days meet in one place.

    Only for floats and integers, and for ``nearest`` and ``linear``.
    """
    kind = _number_type(daily.schema[value].dataType)
    if kind is None or method not in POOLED or 2 * half_width >= CIRCLE:
        limits = thresholds(daily, cell, value, date, years, load_months, season_months, percent, half_width, method)
        return frequency(daily, limits, cell, value, date, season_months, freq_years, year, inclusive=inclusive, nodata=nodata)
    base = F.year(date).between(*years) & F.month(date).isin(load_months)
    own_year = F.year(date) if year is None else year
    season = F.month(date).isin(season_months) & own_year.between(*freq_years)
    use = F.when(base, BASE).otherwise(0) + F.when(season, SEASON).otherwise(0)
    rows = daily.where(base | season).select(*cell, F.dayofyear(date).alias("doy"), own_year.alias("year"), use.alias("use"), F.col(value).alias("value"))
    wanted = np.array(seen_days(daily.where(base), date, years, season_months), dtype=np.int64)
    counts = ("n_days", "n_exceed", "_n")
    schema = T.StructType([*[daily.schema[c] for c in cell], T.StructField("year", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in counts]])
    arrow = to_arrow_schema(schema)
    held = kind if method == "nearest" and kind.kind == "f" else np.dtype(float)

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        doy, years_, use, values = _unpacked(table, kind)
        of_base = use & (BASE | VALID) == (BASE | VALID)
        limit = np.full(CIRCLE + 1, np.nan, dtype=held)  # nothing exceeds a day without a threshold
        days, found = _windows(doy[of_base], values[of_base], wanted, percent / 100, half_width, method)
        limit[days] = found
        own = use & SEASON > 0
        valid, at = use[own] & VALID > 0, limit[doy[own]]
        hit = valid & (values[own] >= at if inclusive else values[own] > at)
        which, place = np.unique(years_[own], return_inverse=True)
        sums = [np.bincount(place, weights=w, minlength=len(which)).astype(np.int64) for w in (np.ones(len(place)), hit, valid)]
        keys = [pa.array([k.as_py()] * len(which), f.type) for k, f in zip(key, arrow, strict=False)]
        return pa.table([*keys, pa.array(which.astype(np.int32)), *map(pa.array, sums)], schema=arrow)

    out = packed(rows, cell).groupBy(*cell).applyInArrow(run, schema)
    freq = F.col("n_exceed") / F.col("n_days")
    return out.withColumn("freq", freq if nodata == "zero" else F.when(F.col("_n") > 0, freq)).drop("_n")


def exceeds(value: Column, limit: Column, inclusive: bool = False) -> Column:
    """Missing values and missing limits exceed nothing."""
    return F.coalesce(value >= limit if inclusive else value > limit, F.lit(False))


def frequency(daily: DataFrame, limits: DataFrame, cell: list[str], value: str, date: str, months: list[int], years: tuple[int, int], year: Column | None = None, limit: str = "threshold", inclusive: bool = False, nodata: str = "zero", limit_cell: list[str] | None = None) -> DataFrame:
    """``cell..., year, n_days, n_exceed, freq``: share of all days of the season, days without a value included.

    ``nodata="zero"``: a cell without any value has frequency 0; ``"null"``: none.
    ``limit_cell``: the columns of ``cell`` that limits have, all unless given.
    """
    year = F.year(date) if year is None else year
    days = daily.where(F.month(date).isin(months)).withColumns({"year": year, "doy": F.dayofyear(date)}).where(F.col("year").between(*years))
    hit = exceeds(F.col(value), F.col(limit), inclusive)
    out = null_safe_left(days, limits, [*(limit_cell or cell), "doy"]).groupBy(*cell, "year").agg(
        F.count("*").alias("n_days"), F.count_if(hit).alias("n_exceed"), F.count(value).alias("_n")
    )
    freq = F.col("n_exceed") / F.col("n_days")
    return out.withColumn("freq", freq if nodata == "zero" else F.when(F.col("_n") > 0, freq)).drop("_n")


def mean_frequency(freq: DataFrame, cell: list[str], n_years: int, value: str = "freq") -> DataFrame:
    """Mean over exactly ``n_years`` years; NULL as soon as one is missing."""
    return freq.groupBy(*cell).agg(F.when(F.count(value) == n_years, F.avg(value)).alias("mean_freq"))


def on_land(df: DataFrame, mask: DataFrame, cell: list[str], flag: str = "topo", land: int = 1) -> DataFrame:
    """Rows of ``df`` in cells that the mask calls land; cells that it lacks are none.  The mask joins as its size allows."""
    return df.join(mask.where(F.col(flag) == land).select(*cell), cell, "left_semi")


def valid_cells(df: DataFrame, cell: list[str], value: str) -> DataFrame:
    """Cells with a value on any day, and how many days."""
    return df.groupBy(*cell).agg(F.count(value).alias("n_valid")).where("n_valid > 0")
