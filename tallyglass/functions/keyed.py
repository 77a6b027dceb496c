"""Attach one row per key to every row of a table, whatever the key skew."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F, types as T

from .exprs import cells, q

BROADCAST_BYTES = 64 << 20
ROW_OVERHEAD = 48
HOT_SHARE = 256


def _on(left: DataFrame, right: DataFrame, keys: list[str]):
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right["_k_" + k]) for k in keys])


def key_count(df: DataFrame, keys: list[str]) -> int:
    """Approximate number of distinct keys: one scan, no shuffle of keys."""
    return df.agg(F.approx_count_distinct(F.struct(*[q(k) for k in keys]), 0.02)).first()[0]


def side_bytes(df: DataFrame, side: DataFrame, keys: list[str], n_keys: int | None) -> float:
    """Upper estimate of the size of the per-key side: key count times the longest key and a fixed
    width per payload column.  Numeric keys with a known count need no scan."""
    texts = [k for k in keys if not isinstance(df.schema[k].dataType, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType))]
    longest = 0
    if n_keys is None or texts:
        size = reduce(lambda a, b: a + b, [F.coalesce(F.length(q(k).cast("string")), F.lit(0)) for k in texts], F.lit(0))
        n, longest = df.agg(F.approx_count_distinct(F.struct(*[q(k) for k in keys]), 0.02), F.max(size)).first()
        n_keys = max(n, n_keys or 0)
    return 1.1 * n_keys * (ROW_OVERHEAD + 4 * (longest or 0) + 16 * len(side.columns))


def attach(df: DataFrame, stats: DataFrame, keys: list[str], how: str = "inner",
           broadcast_bytes: int | None = None, n_keys: int | None = None) -> DataFrame:
    """Null-safe join of ``df`` with per-key ``stats`` (one row per key of ``df``).

    A small side (its size is checked) is broadcast.  Otherwise keys holding more than 1/256 of the rows, at most
    256 of them, get their stats from a broadcast of those few rows and stay where they are; only the rows of the
    other keys shuffle, so no task receives a hot key.

    ``n_keys``: the number of keys when the caller has counted them already.
    """
    limit = BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes
    payload = [c for c in stats.columns if c not in keys]
    side = stats.select(*[q(k).alias("_k_" + k) for k in keys], *[q(c) for c in payload])
    drop = ["_k_" + k for k in keys]
    if side_bytes(df, side, keys, n_keys) <= limit:
        return df.join(F.broadcast(side), _on(df, side, keys), how).drop(*drop)
    total = df.count()
    hot = (df.groupBy(*[q(k).alias("_k_" + k) for k in keys]).agg(F.count(F.lit(1)).alias("_n"))
           .filter(F.col("_n") * HOT_SHARE > total).drop("_n"))
    if not hot.limit(1).count():
        return df.join(side, _on(df, side, keys), how).drop(*drop)
    hot = F.broadcast(hot)  # at most HOT_SHARE rows
    few = side.join(hot, reduce(lambda a, b: a & b, [side[c].eqNullSafe(hot[c]) for c in drop]), "left_semi")
    names = [*df.columns, *payload]
    held = df.join(F.broadcast(few), _on(df, few, keys), how).select(*[q(c) for c in names]) if how == "inner" else (
        df.join(hot, _on(df, hot, keys), "left_semi").join(F.broadcast(few), _on(df, few, keys), how).select(*[q(c) for c in names]))
    cold = df.join(hot, _on(df, hot, keys), "left_anti")
    return held.unionByName(cold.join(side, _on(cold, side, keys), how).select(*[q(c) for c in names]))


def frequency(df: DataFrame, keys: list[str], name: str = "n") -> DataFrame:
    return df.groupBy(*[q(k) for k in keys]).agg(F.count(F.lit(1)).alias(name))


def long_counts(df: DataFrame, cols: dict) -> DataFrame:
    """(column, value, n) of all columns in one shuffle with map-side combining."""
    return cells(df, cols).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
