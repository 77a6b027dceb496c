"""Column models shared by the synthesisers: value tables, level shares, types and their inverses."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.exprs import collect_stats, kind, num, q
from ..functions.sequences import as_number
from ..functions.special import normal_cdf, normal_ppf_array

TABLE_POINTS = 1_001
MAX_LEVELS = 10_000


@dataclass
class Marginal:
    """``numeric``: quantile table; ``categorical``: levels by falling share; ``id``: running number."""

    name: str
    kind: str
    dtype: T.DataType
    null_share: float = 0.0
    values: np.ndarray | None = None  # quantile table
    levels: list = field(default_factory=list)
    shares: np.ndarray | None = None
    whole: bool = False

    def z_table(self):
        """Distinct table values with the normal score of their mean position."""
        p = np.linspace(0, 1, len(self.values))
        z = normal_ppf_array(np.clip(p, 0.5 / len(p), 1 - 0.5 / len(p)))
        v, inv = np.unique(self.values, return_inverse=True)
        return v, np.bincount(inv, z) / np.bincount(inv)

    def cuts(self):
        """Normal-score boundaries of the levels."""
        return normal_ppf_array(np.clip(np.cumsum(self.shares)[:-1], 1e-9, 1 - 1e-9)) if len(self.levels) > 1 else np.zeros(0)

    def score(self, series) -> np.ndarray:
        if self.kind == "numeric":
            v, z = self.z_table()
            x = series.astype(float).to_numpy()
            return np.where(np.isnan(x), np.nan, np.interp(x, v, z))
        top = np.cumsum(self.shares)
        mid = normal_ppf_array(top - self.shares / 2)
        code = {l: m for l, m in zip(self.levels, mid)}
        return series.map(code).astype(float).to_numpy()

    def invert(self, z: np.ndarray):
        if self.kind == "numeric":
            p = normal_cdf(z)
            x = np.interp(p, np.linspace(0, 1, len(self.values)), self.values)
            return np.rint(x) if self.whole else x
        if not self.levels:
            return np.full(len(z), None, object)
        return np.array(self.levels, object)[np.searchsorted(self.cuts(), z, "right")]


def model_kind(df: DataFrame, name: str, ids: set[str]) -> str:
    if name in ids:
        return "id"
    k = kind(df.schema[name].dataType)
    if k == "nested":
        raise ValueError(f"cannot model a nested column: {name}")
    return "categorical" if k == "categorical" else "numeric"


def as_model(df: DataFrame, name: str, model: str):
    """Column as the model sees it: double, or text level."""
    if model == "numeric":
        return num(df, name) if kind(df.schema[name].dataType) == "numeric" else as_number(df, name)
    return q(name).cast("string")


def fit_marginals(df: DataFrame, ids: list[str] | None = None, points: int = TABLE_POINTS, max_levels: int = MAX_LEVELS) -> list[Marginal]:
    """Quantile tables of all numeric columns in one aggregate, level shares in one shuffle.  Text columns
    with more than ``max_levels`` levels must be named as ids."""
    ids = set(ids or [])
    kinds = {c: model_kind(df, c, ids) for c in df.columns}
    stats = {"n": F.count(F.lit(1))}
    probs = F.array(*[F.lit(i / (points - 1)) for i in range(points)])
    for c, k in kinds.items():
        if k == "id":
            continue
        x = as_model(df, c, k)
        stats[c, "filled"] = F.count(x)
        if k == "numeric":
            stats[c, "table"] = F.percentile_approx(x, probs, F.lit(10_000))
            stats[c, "whole"] = F.bool_and(x == F.floor(x))
        else:
            stats[c, "levels"] = F.approx_count_distinct(x, 0.02)
    s = collect_stats(df, stats)
    texts = [c for c, k in kinds.items() if k == "categorical"]
    crowded = [c for c in texts if s[c, "levels"] > max_levels]
    if crowded:
        raise ValueError(f"more than {max_levels} levels, name them as ids: {crowded}")
    levels: dict[str, list] = {c: [] for c in texts}
    if texts:
        cells = F.array(*[F.struct(F.lit(c).alias("column"), as_model(df, c, "categorical").alias("value")) for c in texts])
        got = df.select(F.inline(cells)).filter(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
        for r in got.collect():  # at most max_levels per column
            levels[r["column"]].append((r["n"], r["value"]))
    out = []
    for c, k in kinds.items():
        dtype = df.schema[c].dataType
        if k == "id":
            out.append(Marginal(c, k, dtype))
            continue
        null = 1 - s[c, "filled"] / s["n"] if s["n"] else 0.0
        if k == "numeric":
            table = np.array(s[c, "table"] if s[c, "table"] is not None else [0.0, 0.0], float)
            out.append(Marginal(c, k, dtype, null, values=table, whole=bool(s[c, "whole"])))
        else:
            pairs = sorted(levels[c], key=lambda t: (-t[0], t[1]))
            counts = np.array([p[0] for p in pairs], float)
            out.append(Marginal(c, k, dtype, null, levels=[p[1] for p in pairs], shares=counts / counts.sum() if len(counts) else counts))
    return out


def restore(df: DataFrame, marginals: list[Marginal]) -> DataFrame:
    """Model columns back to the types of the source table."""
    cols = []
    for m in marginals:
        x = q(m.name)
        if isinstance(m.dtype, T.TimestampNTZType):
            x = F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(secs=F.round(x).cast("decimal(20,0)") / F.lit(1000000).cast("decimal(10,0)"))
        elif isinstance(m.dtype, T.TimestampType):
            x = F.timestamp_micros(F.round(x).cast("long"))
        elif isinstance(m.dtype, T.DateType):
            x = F.date_from_unix_date(F.round(x).cast("int"))
        elif m.kind == "id" and isinstance(m.dtype, T.StringType):
            x = F.concat(F.lit(m.name + "-"), x.cast("long").cast("string"))
        elif m.kind == "numeric" or m.kind == "id":
            x = (F.round(x) if isinstance(m.dtype, T.IntegralType) else x).cast(m.dtype)
        else:
            x = x.cast(m.dtype)
        cols.append(x.alias(m.name))
    return df.select(*cols, *[q(c) for c in df.columns if c not in {m.name for m in marginals}])


ROWS_PER_TASK = 500_000


def seeds(spark, n: int, width: int, seed: int) -> DataFrame:
    """``row_id`` with ``width`` standard normal columns.  The partition count depends on n alone, so a lost
    partition is redrawn identically."""
    parts = max(1, -(-n // ROWS_PER_TASK))
    base = spark.range(0, n, 1, parts).withColumnRenamed("id", "row_id")
    return base.select("row_id", *[F.randn(seed + i).alias(f"g{i}") for i in range(width)])


def model_schema(marginals: list[Marginal]) -> str:
    return ", ".join(f"`{m.name}` {'string' if m.kind == 'categorical' else 'double'}" for m in marginals)
