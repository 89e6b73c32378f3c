"""Reading and writing: long Parquet tables, lookups, optional cube formats, stages that resume."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isotherm.schemas import SCHEMAS, nan_to_null
from isotherm.sources.geometry import binary_of, polygons_of


def read_table(spark: SparkSession, path: str, schema: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """A Parquet table, NaN as NULL; only the columns asked for are read."""
    reader = spark.read.schema(SCHEMAS.get(schema, schema)) if schema else spark.read
    df = reader.parquet(path)
    return nan_to_null(df.select(*columns) if columns else df)


def read_daily(spark: SparkSession, path: str, years: tuple[int, int], months: list[int], box: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Daily cells of some years and months (partition columns) and index box (row and column bounds, pushed to the scan)."""
    df = spark.read.schema(SCHEMAS["tmax_daily"]).parquet(path).where(F.col("year").between(*years) & F.col("month").isin(months))
    if box:
        df = df.where(F.col("lat_i").between(box[0], box[1]) & F.col("lon_i").between(box[2], box[3]))
    return nan_to_null(df)


def read_season(spark: SparkSession, path: str, years: tuple[int, int], months: list[int], **how) -> DataFrame:
    """``read_daily`` with ``season_year``: months from November on open the next year's season, so the year before is read as well."""
    late = [m for m in months if m >= 11]
    df = read_daily(spark, path, (years[0] - bool(late), years[1]), months, **how)
    season = F.col("year") + (F.col("month") >= 11).cast("int") if late and any(m < 11 for m in months) else F.col("year")
    return df.withColumn("season_year", season).where(F.col("season_year").between(*years))


def complete_seasons(df: DataFrame, months: list[int], year: str = "season_year", month: str = "month", policy: str = "drop_season") -> DataFrame:
    """Seasons with a month missing altogether: left out, or, with ``keep_partial``, kept as they are."""
    if policy == "keep_partial":
        return df
    full = df.groupBy(year).agg(F.countDistinct(month).alias("months")).where(F.col("months") == len(set(months))).select(year)
    return df.join(F.broadcast(full), year, "left_semi")  # a row per year


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return nan_to_null(spark.read.schema(SCHEMAS.get(schema, schema)).csv(path, header=True))


def read_vectors(spark: SparkSession, path: str, ignore: list[str] = (), geometry: str = "geometry", to: str = "polygons") -> DataFrame:
    """A table of units; ``ignore`` is never read, and a binary ``geometry`` is decoded to polygons."""
    df = spark.read.parquet(path)
    df = df.select(*[c for c in df.columns if c not in ignore])
    return df.withColumn(to, polygons_of(geometry)).drop(geometry) if dict(df.dtypes).get(geometry) == "binary" else df


def write_vectors(df: DataFrame, path: str, polygons: str = "polygons", geometry: str = "geometry") -> None:
    """Rows with polygons as Parquet with a binary geometry."""
    df.withColumn(geometry, binary_of(polygons)).drop(polygons).write.mode("overwrite").parquet(path)


def read_cube(spark: SparkSession, path: str, variable: str, fmt: str = "netcdf") -> DataFrame:
    """A NetCDF, GRIB or Zarr cube as long rows, where xarray is installed; files are opened on executors, one per task."""
    import xarray  # noqa: F401  only this optional reader needs it

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*").load(path).select("path")

    def run(frames):
        import xarray as xr

        for frame in frames:
            for p in frame["path"]:
                data = xr.open_dataset(p.removeprefix("file:"), engine={"grib": "cfgrib"}.get(fmt))
                yield data[variable or list(data.data_vars)[0]].to_dataframe("value").reset_index()[["time", "latitude", "longitude", "value"]]

    return files.mapInPandas(run, "time timestamp, latitude double, longitude double, value float")


def write_partitioned(df: DataFrame, path: str, by: list[str], mode: str = "overwrite") -> None:
    """Parquet by partition columns; an overwrite replaces the partitions present in ``df`` alone."""
    df.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def fixed_decimals(df: DataFrame, digits: int = 8) -> DataFrame:
    """Reals as text with so many decimals, missing as empty."""
    real = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    text = lambda c: F.when(F.col(c).isNull() | F.isnan(c), None).otherwise(F.format_string(f"%.{digits}f", F.col(c).cast("double")))
    return df.withColumns({c: text(c) for c in real}) if real else df


def write_report(df: DataFrame, path: str, digits: int = 8) -> None:
    """A small result table as one CSV file."""
    fixed_decimals(df, digits).coalesce(1).write.mode("overwrite").option("emptyValue", "").csv(path, header=True)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def scratch_table(spark: SparkSession, name: str) -> str:
    """Place of a table that lives as long as the session: in ``spark.checkpoint.dir``, else, on a local master alone, in the warehouse."""
    conf = spark.sparkContext.getConf()
    at = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not at and not conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(at or spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def built_once(spark: SparkSession, path: str, build: Callable[[], DataFrame], valid: Callable[[DataFrame], bool] | None = None) -> DataFrame:
    """The table at ``path`` if it was finished (and is valid), else built and written."""
    if exists(spark, path):
        df = spark.read.parquet(path)
        if valid is None or valid(df):
            return df
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def described(df: DataFrame, column: str, **attributes) -> DataFrame:
    """Attributes of a column, as metadata that Parquet keeps."""
    return df.withMetadata(column, attributes)


def sorted_panel(df: DataFrame, *keys: str) -> DataFrame:
    return df.orderBy(*[F.col(k).asc_nulls_last() for k in keys])


def equal_or_both_null(a: Column, b: Column) -> Column:
    """Join condition under which a missing key meets a missing key."""
    return a.eqNullSafe(b)
