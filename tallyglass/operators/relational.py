"""Projections, renames, casts and filters offered to users."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.exprs import q
from ..sources.tables import known_columns

def keep(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*[q(c) for c in known_columns(df, cols)])


def drop(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.drop(*cols)


def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed({a: b for a, b in mapping.items() if a in df.columns})


def cast(df: DataFrame, col: str, dtype: str) -> DataFrame:
    """Cast when every value survives; otherwise the column stays as it is."""
    lost = df.filter(q(col).isNotNull() & q(col).try_cast(dtype).isNull()).limit(1).count()
    return df if lost else df.withColumn(col, q(col).try_cast(dtype))


def derive(df: DataFrame, name: str, expression: str) -> DataFrame:
    return df.withColumn(name, F.expr(expression))


def filter_in(df: DataFrame, col: str, values: list) -> DataFrame:
    return df.filter(q(col).cast("string").isin([str(v) for v in values]))


def _contains(col: str, term: str) -> Column:
    return F.lower(q(col).cast("string")).contains(term.lower())


def search_values(df: DataFrame, col: str, term: str, limit: int | None = None) -> DataFrame:
    """Distinct values containing ``term`` in any case, in value order; the first ``limit`` for a pick list."""
    found = df.filter(_contains(col, term)).select(q(col).cast("string").alias("value")).distinct().orderBy("value")
    return found if limit is None else found.limit(limit)


def filter_search(df: DataFrame, col: str, term: str) -> DataFrame:
    """Rows whose value contains ``term`` in any case."""
    return df.filter(_contains(col, term))


def value_counts(df: DataFrame, col: str, n: int = 10) -> DataFrame:
    """Most frequent non-null values; ties by value.  ``pct`` is of all rows."""
    total = df.count()
    return (df.filter(q(col).isNotNull()).groupBy(q(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), "value").limit(n)
            .withColumn("pct", F.round(F.col("n") * 100.0 / F.lit(max(total, 1)), 4)))


def top_values(df: DataFrame, col: str, n: int = 10) -> DataFrame:
    top = F.broadcast(value_counts(df, col, n).select("value"))
    return df.join(top, q(col) == top["value"], "left_semi")


def filter_range(df: DataFrame, col: str, lo, hi) -> DataFrame:
    return df.filter(q(col).between(F.lit(lo), F.lit(hi)))


def to_numeric(col: Column) -> Column:
    """Number or null."""
    return F.trim(col.cast("string")).try_cast("double")
