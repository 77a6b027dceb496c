"""Semantic column kinds and key relationships between tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.exprs import collect_stats, kind, q, records

SEMANTIC = ("numeric", "categorical", "boolean", "datetime", "id", "nested")
DATE_SHARE = 0.8  # fixed value: share of parseable strings that makes a date column
ID_RATIO = 0.999


def detect_metadata(df: DataFrame, overrides: dict[str, str] | None = None, sequence_key: str | None = None,
                    sequence_index: str | None = None) -> DataFrame:
    """(column, dtype, kind, role).  Whole numbers and strings that are unique per row are ids:
    a cheap sketch first, then an exact count for the near-unique columns only."""
    overrides = overrides or {}
    for c, k in overrides.items():
        if c not in df.columns:
            raise ValueError(f"unknown column: {c}")
        if k not in SEMANTIC:
            raise ValueError(f"unknown kind: {k}")
    for c in (sequence_key, sequence_index):
        if c is not None and c not in df.columns:
            raise ValueError(f"unknown column: {c}")
    probes = {("n", ""): F.count(F.lit(1))}
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.LongType, T.IntegerType, T.ShortType, T.StringType)):
            probes["distinct", f.name] = F.approx_count_distinct(q(f.name), 0.02)
        if isinstance(f.dataType, T.StringType):
            probes["dates", f.name] = F.count(q(f.name).try_cast("timestamp"))
            probes["filled", f.name] = F.count(q(f.name))
    seen = collect_stats(df, probes)
    n = seen["n", ""]
    near = [c for what, c in seen if what == "distinct" and n > 1 and seen[what, c] >= 0.9 * n]
    exact = collect_stats(df, {c: F.count_distinct(q(c)) for c in near})
    rows = []
    for f in df.schema.fields:
        base = "boolean" if isinstance(f.dataType, T.BooleanType) else kind(f.dataType)
        if f.name in exact and exact[f.name] >= ID_RATIO * n:
            base = "id"
        elif ("dates", f.name) in seen and seen["dates", f.name] > DATE_SHARE * max(seen["filled", f.name], 1):
            base = "datetime"
        base = overrides.get(f.name, base)
        role = "value"
        if f.name == sequence_key:
            base, role = "id", "sequence_key"
        elif f.name == sequence_index:
            role = "sequence_index"
        rows.append((f.name, f.dataType.simpleString(), base, role))
    return records(df.sparkSession, rows, "column string, dtype string, kind string, role string")


def detect_relationships(tables: dict[str, DataFrame], key_suffix: str | None = None, same_name: bool = True) -> DataFrame:
    """Foreign keys: child column whose values all occur in a unique column of another table.

    Whole numbers and texts are candidates.  ``same_name``: names must agree after their table prefix (``o_custkey`` /
    ``c_custkey``); without it any name may refer to any other, and small numbers will.  ``key_suffix`` limits the names further.  One aggregate per table gives range, approximate distinct count and kind, which rule out
    most pairs (a child's range lies within the parent's, its distinct count is not larger).  The columns that are left are inverted: one shuffle
    of all tables finds for every value the columns that hold it; a child is included if all its values occur with the
    parent, and a parent is unique if no value repeats there."""
    spark = next(iter(tables.values())).sparkSession

    def stem(c):
        return c.split("_", 1)[1] if "_" in c else c

    def candidate(f):
        ok = isinstance(f.dataType, (T.IntegralType, T.StringType))
        return ok and (key_suffix is None or stem(f.name).endswith(key_suffix) or stem(f.name) == "id")

    def whole(df, c):
        return isinstance(df.schema[c].dataType, T.IntegralType)

    cols = {t: [f.name for f in df.schema.fields if candidate(f)] for t, df in tables.items()}
    stats = {}
    for t, df in tables.items():
        got = collect_stats(df, {"n": F.count(F.lit(1)), **{(c, k): f(q(c)) for c in cols[t] for k, f in (
            ("lo", F.min), ("hi", F.max), ("filled", F.count), ("distinct", lambda x: F.approx_count_distinct(x, 0.02)))}})
        stats.update({(t, c): (got["n"], *[got[c, k] for k in ("lo", "hi", "filled", "distinct")]) for c in cols[t]})

    def possible(parent, p, child, c):
        n, lo, hi, filled, distinct = stats[parent, p]
        _, low, high, present, kinds = stats[child, c]
        if parent == child or not present or not n or filled < n or distinct < 0.9 * n or whole(tables[parent], p) != whole(tables[child], c):
            return False
        if same_name and stem(p) != stem(c):
            return False
        return lo <= low and high <= hi and kinds <= 1.1 * distinct

    pairs = [(parent, p, child, c) for parent in tables for p in cols[parent] for child in tables for c in cols[child] if possible(parent, p, child, c)]
    schema = "parent_table string, parent_column string, child_table string, child_column string"
    if not pairs:
        return records(spark, [], schema)
    used = sorted({x for parent, p, child, c in pairs for x in ((parent, p), (child, c))})
    number = {x: i for i, x in enumerate(used)}
    parts = []
    for t, df in tables.items():
        own = [c for c in cols[t] if (t, c) in number]
        if own:
            parts.append(df.select(F.inline(F.array(*[F.struct(F.lit(number[t, c]).alias("c"), q(c).cast("string").alias("k")) for c in own]))))
    values = reduce(DataFrame.unionByName, parts).filter(F.col("k").isNotNull())
    held = values.groupBy("k").agg(*[F.count_if(F.col("c") == i).alias(f"n{i}") for i in range(len(used))])
    each = F.filter(F.array(*[F.struct(F.lit(i).alias("c"), F.col(f"n{i}").alias("n")) for i in range(len(used))]), lambda s: s["n"] > 0)
    both = held.select(each.alias("s")).select("s", F.explode("s").alias("child")).select("child", F.explode("s").alias("parent"))
    together = {(r["p"], r["c"]): (r["values"], r["most"]) for r in both.groupBy(F.col("parent.c").alias("p"), F.col("child.c").alias("c")).agg(
        F.count(F.lit(1)).alias("values"), F.max("parent.n").alias("most")).collect()}  # at most the square of the columns
    found = set()
    for parent, p, child, c in pairs:
        x, y = number[parent, p], number[child, c]
        if together[x, x][1] == 1 and together.get((x, y), (0, 0))[0] == together[y, y][0]:
            found.add((parent, p, child, c))
    # two equal unique columns include each other: keep one direction
    return records(spark, sorted(f for f in found if not ((f[2], f[3], f[0], f[1]) in found and f[:2] > f[2:])), schema)
