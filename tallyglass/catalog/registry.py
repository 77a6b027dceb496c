"""Registry of named queries over the driver tables, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Lazy access to the parquet tables of one folder: ``t.orders``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Registers ``fn(tables)`` under ``name``; ``sql`` is its independent twin."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def rounded(df: DataFrame, decimals: int = 6, **special: int) -> DataFrame:
    """Rounds every floating-point column and drops the sign of zero, so results compare by value."""
    from pyspark.sql import functions as F, types as T

    from ..functions.exprs import q

    cols = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            cols[f.name] = F.round(q(f.name).cast("double"), special.get(f.name, decimals)) + F.lit(0.0)
    return df.withColumns(cols) if cols else df
