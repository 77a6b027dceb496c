"""Table sources and sinks: CSV / Parquet scans, folders, projected samples, cleaning."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.exprs import columns_of, finite, q
from ..functions.quantiles import smallest

FORMATS = ("csv", "parquet", "json", "orc")
SAMPLE_SEED = 42  # fixed value: default seed of the sampled read
FLOAT_DECIMALS = 6  # fixed value: decimals of generated CSV output


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", schema=None) -> DataFrame:
    """Scan one table.  Pass ``schema`` for large CSV input: inference reads the file twice."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format: {fmt}")
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True).option("inferSchema", schema is None)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path)


def read_tables(spark: SparkSession, folder: str, fmt: str = "csv", names: list[str] | None = None) -> dict[str, DataFrame]:
    """Every table of a folder, keyed by file name without its extension."""
    if names is None:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files = [s.getPath().getName() for s in fs.listStatus(path)]
        names = sorted(f[: -len(fmt) - 1] for f in files if f.endswith("." + fmt))
    if not names:
        raise ValueError(f"no .{fmt} tables in {folder}")
    return {n: read_table(spark, f"{folder.rstrip('/')}/{n}.{fmt}", fmt) for n in names}


def clean_num(df: DataFrame) -> DataFrame:
    """NaN and infinities become null in every floating-point column."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return df.withColumns({c: finite(q(c)) for c in floats}) if floats else df


def iso_times(df: DataFrame) -> DataFrame:
    """Date and time columns as ISO text."""
    formats = {T.DateType: "yyyy-MM-dd"}
    out = {}
    for f in df.schema.fields:
        if f.name in columns_of(df, "datetime"):
            out[f.name] = F.date_format(q(f.name), formats.get(type(f.dataType), "yyyy-MM-dd'T'HH:mm:ss"))
    return df.withColumns(out) if out else df


def known_columns(df: DataFrame, cols: list[str] | None) -> list[str]:
    """Requested columns that exist; all columns when none of them does."""
    found = [c for c in (cols or []) if c in df.columns]
    return found or df.columns


def read_sample(df: DataFrame, columns: list[str] | None = None, n: int | None = None,
                seed: int = SAMPLE_SEED, key: list[str] | None = None) -> DataFrame:
    """Projected, JSON-safe rows; ``n`` reproducible random rows, those with the smallest keyed hash."""
    cols = known_columns(df, columns)
    if n is not None:
        order = F.xxhash64(*[q(c) for c in (key or df.columns)], F.lit(seed))
        df = smallest(df, order, n, [q(c) for c in (key or [])])
    return iso_times(clean_num(df.select(*[q(c) for c in cols])))


def shape(df: DataFrame) -> DataFrame:
    """Row count, column count and the type of every column."""
    kinds = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    cells = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(n).alias("column"), F.lit(t).alias("dtype"))
                      for i, n, t in kinds])
    counted = df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(kinds)))
    return counted.select("n_rows", "n_columns", F.inline(cells))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", decimals: int | None = None,
                partition_by: list[str] | None = None) -> None:
    """Overwrite ``path``; ``decimals`` fixes the number of decimals of floating-point columns."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format: {fmt}")
    plain = lambda p: re.sub("/+", "/", p.removeprefix("file:")).rstrip("/")
    here, target = [plain(p) for p in df.inputFiles()], plain(path)
    if any(p == target or p.startswith(target + "/") for p in here):
        raise ValueError("refusing to overwrite an input of the same job")
    if decimals is not None:
        floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
        df = df.withColumns({c: F.round(q(c), decimals) for c in floats}) if floats else df
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
