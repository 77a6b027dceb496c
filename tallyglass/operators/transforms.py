"""Cleaning, encoding, scaling, feature and privacy transforms.

Each transform is described by the statistics it needs and the columns it then adds, so a recipe can
gather the statistics of many steps in one aggregate and apply them as one projection."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.exprs import kind, num, q
from ..functions.keyed import attach, frequency, key_count
from ..functions.ordered import average_ranks
from ..functions.sequences import fill
from . import association
from .remediation import best_lambda, bin_column, bin_edges, equal_width_edges, yeo_johnson

# fixed values: defaults
OTHER = "Other"
REDACTED = "[REDACTED]"
MASK_SHARE = 0.5
MIN_FREQUENCY = 5
TOP_CATEGORIES = 10
BINS = 4
QUARTILES = ["Q1", "Q2", "Q3", "Q4"]
ONE_HOT_COLUMNS = 1_000
INTERACTION_R, INTERACTION_PAIRS = 0.4, 5
SORT_LEVELS = 1_000_000


@dataclass(frozen=True)
class Op:
    """``stats``: aggregates by name; ``quantiles``: probabilities wanted; ``build``: new columns."""

    build: Callable
    stats: Callable = lambda df, c, p: {}
    quantiles: Callable = lambda p: []
    numeric: bool = False
    nonneg: bool = False
    suffix: str = ""
    whole: Callable | None = None  # table-to-table form for transforms that join or sort

    def output(self, col: str) -> str:
        return col + self.suffix


def _safe_scale(df, c, p, s, centre, spread):
    """(x - centre) / spread with a zero spread taken as 1."""
    if centre is None:
        return F.lit(None).cast("double")
    return (num(df, c) - F.lit(float(centre))) / F.lit(float(spread) if spread else 1.0)


def _impute_stats(df, c, p):
    m = p.get("method", "mean")
    if m == "mean":
        return {"v": F.avg(num(df, c))}
    if m == "mode":
        return {"v": F.mode(q(c), True)}
    if m in ("median", "value"):
        return {}
    raise ValueError(f"unknown method: {m}")


def _impute(df, c, p, s):
    m = p.get("method", "mean")
    v = s["q"][0] if m == "median" else p.get("value") if m == "value" else s["v"]
    if v is None:
        return q(c)
    numeric = m in ("mean", "median")
    return F.coalesce(num(df, c), F.lit(float(v))) if numeric else F.coalesce(q(c), F.lit(v))


def _mode_small(df, c):
    """Most frequent value (ties: smallest) by a distributed count instead of an in-memory map."""
    top = df.filter(q(c).isNotNull()).groupBy(q(c).alias("v")).agg(F.count(F.lit(1)).alias("n")).orderBy(
        F.desc("n"), "v").limit(1).collect()
    return top[0]["v"] if top else None


def mask_text(x: Column, share: float) -> Column:
    """The last int(length * share) characters become ``*``."""
    n = F.floor(F.length(x) * F.lit(float(share))).cast("int")
    return F.concat(F.substring(x, F.lit(1), F.length(x) - n), F.repeat(F.lit("*"), n))


def word_count(x: Column) -> Column:
    return F.regexp_count(x, F.lit(r"\S+"))


def _one_hot(df, c, p):
    """0/1 column per sorted level.  Beyond ``max_columns`` levels (counted first) the columns become one sparse vector
    ``{c}_onehot``: its size and the place of its only 1, null where no level (or the dropped first one) stands."""
    drop_first, most = p.get("drop_first", True), p.get("max_columns", ONE_HOT_COLUMNS)
    levels = [r[0] for r in df.filter(q(c).isNotNull()).select(q(c)).distinct().orderBy(q(c)).limit(most + 1).collect()]
    if len(levels) > most:
        codes = level_codes(df, c)
        n = codes.count() - drop_first
        place = F.col("code") - int(drop_first)
        coded = attach(df, codes, [c], how="left", n_keys=n + drop_first)
        return coded.withColumn(f"{c}_onehot", F.struct(F.lit(n).cast("long").alias("size"), F.when(place >= 0, place).alias("index"))).drop(c, "code")
    shown = levels[1:] if drop_first else levels
    rest = [q(k) for k in df.columns if k != c]
    return df.select(*rest, *[F.coalesce(q(c) == F.lit(v), F.lit(False)).alias(f"{c}_{v}") for v in shown])


def level_codes(df: DataFrame, c: str, sort_levels: int = SORT_LEVELS, n: int | None = None) -> DataFrame:
    """(value, code): rank of each distinct value among the sorted values.  Many values are sorted in
    ranges between boundary values taken from a sample of the values."""
    levels = df.filter(q(c).isNotNull()).select(q(c)).distinct()
    n = key_count(df, [c]) if n is None else n
    ranges = -(-n // sort_levels)
    if ranges <= 1:
        cut = levels.withColumn("_range", F.lit(0))
    else:
        share = min(1.0, 200.0 * ranges / n)
        picked = sorted(r[0] for r in levels.filter(F.pmod(F.xxhash64(q(c)), F.lit(1_000_000)) < F.lit(int(share * 1_000_000))).collect())
        cuts = [picked[len(picked) * i // ranges] for i in range(1, ranges)] if picked else []
        spot = F.lit(0)
        for v in cuts:
            spot = spot + F.when(q(c) >= F.lit(v), 1).otherwise(0)
        cut = levels.withColumn("_range", spot)
    local = cut.withColumn("_i", F.row_number().over(Window.partitionBy("_range").orderBy(q(c))) - 1)
    totals = cut.groupBy(F.col("_range").alias("_r")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_r", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return local.join(F.broadcast(offsets), F.col("_range") == F.col("_r")).select(q(c), (F.col("_i") + F.col("_off")).cast("long").alias("code"))


def _label(df, c, p):
    out = p.get("out", f"{c}_le")
    n = key_count(df, [c])
    return attach(df, level_codes(df, c, n=n), [c], how="left", n_keys=n).withColumn(out, F.coalesce("code", F.lit(-1).cast("long"))).drop("code")


def _freq(df, c, p):
    total = df.agg(F.count(q(c))).first()[0]
    share = frequency(df.filter(q(c).isNotNull()), [c], "_n").withColumn(f"{c}_freq", F.col("_n") / F.lit(float(max(total, 1)))).drop("_n")
    return attach(df, share, [c], how="left")


def _generalize(df, c, p):
    text, least = p.get("replacement", OTHER), p.get("min_frequency", MIN_FREQUENCY)
    counts = frequency(df.filter(q(c).isNotNull()), [c], "_n")
    out = f"{c}_generalized"
    rows = attach(df, counts, [c], how="left")
    return rows.withColumn(out, F.when(F.col("_n") < least, F.lit(text)).otherwise(q(c).cast("string"))).drop("_n")


def _top(df, c, p):
    n, text = p.get("n", TOP_CATEGORIES), p.get("replacement", OTHER)
    top = [r["v"] for r in df.filter(q(c).isNotNull()).groupBy(q(c).alias("v")).agg(F.count(F.lit(1)).alias("n"))
           .orderBy(F.desc("n"), "v").limit(n).collect()]  # n values
    return df.withColumn(c, F.when(q(c).isin(top), q(c).cast("string")).otherwise(F.lit(text)))


def _rank(df, c, p):
    x = df.withColumn("_x", num(df, c))
    ranks = average_ranks(x.select("_x"), "_x").select("_x", F.col("rank").alias(f"{c}_rank"))
    return attach(x, ranks, ["_x"], how="left").drop("_x")


def _power(df, c, p):
    x = num(df, c)
    lam = p.get("lambda")
    if lam is None:
        jac = F.when(x >= 0, F.log1p(x)).otherwise(-F.log1p(-x))
        lam = best_lambda(df, x, yeo_johnson, jac)
    y = yeo_johnson(x, lam)
    m, s = df.agg(F.avg(y), F.stddev_pop(y)).first()
    return df.withColumn(f"{c}_power", (y - F.lit(m or 0.0)) / F.lit(s if s else 1.0))


def _bins(df, c, p):
    """Equal-width bins by default; quantile bins when the step asks for them."""
    n = p.get("n_bins", p.get("bins", BINS))
    edges = bin_edges(df, c, "quantile" if p.get("strategy") == "quantile" else "uniform", n)
    if len(edges) == 1:
        edges = equal_width_edges(edges[0], edges[0], 1)
    return df.withColumn(f"{c}_bin", bin_column(num(df, c), edges) if edges else F.lit(None).cast("int"))


def _quartile(df, c, p):
    edges = bin_edges(df, c, "quantile", 4)
    k = len(edges) - 1
    return df.withColumn(f"{c}_bin", bin_column(num(df, c), edges, QUARTILES[:k]) if k > 0 else F.lit(None).cast("string"))


def _tfidf(df, c, p):
    """Hashed term frequencies weighted by inverse document frequency."""
    from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer

    d = df.withColumn("_t", F.coalesce(q(c), F.lit("")))
    d = RegexTokenizer(inputCol="_t", outputCol="_w", pattern=r"\s+").transform(d)
    d = HashingTF(inputCol="_w", outputCol="_tf", numFeatures=p.get("features", 1 << 14)).transform(d)
    return IDF(inputCol="_tf", outputCol=f"{c}_emb").fit(d).transform(d).drop("_t", "_w", "_tf")


def _inverse_stats(df, c, p):
    return {"zeros": F.count_if(num(df, c) == 0)}


def _inverse(df, c, p, s):
    if s["zeros"]:
        raise ValueError("column contains zeros")
    return F.lit(1.0) / num(df, c)


def _z(df, c, s):
    return F.when(num(df, c).isNotNull(), F.lit(0.0)) if not s["s"] else (num(df, c) - F.lit(s["m"])) / F.lit(s["s"])


def _mean_sd(sd):
    return lambda df, c, p: {"m": F.avg(num(df, c)), "s": sd(num(df, c))}


def _hash(df, c, p, s):
    return F.sha2(F.concat(F.lit(p.get("salt") or ""), q(c).cast("string")), 256)


def _minmax(df, c, p, s):
    lo, hi = s["lo"], s["hi"]
    if lo is None:
        return F.lit(None).cast("double")
    return (num(df, c) - F.lit(lo)) / F.lit(hi - lo if hi > lo else 1.0)


OPS: dict[str, Op] = {
    "impute": Op(_impute, _impute_stats, lambda p: [0.5] if p.get("method") == "median" else []),
    "log_transform": Op(lambda df, c, p, s: F.log1p(num(df, c)), numeric=True, nonneg=True, suffix="_log"),
    "sqrt_transform": Op(lambda df, c, p, s: F.sqrt(num(df, c)), numeric=True, nonneg=True, suffix="_sqrt"),
    "standard_scaler": Op(lambda df, c, p, s: _safe_scale(df, c, p, s, s["m"], s["s"]), _mean_sd(F.stddev_pop), numeric=True, suffix="_scaled"),
    "zscore": Op(lambda df, c, p, s: _z(df, c, s), _mean_sd(F.stddev), numeric=True, suffix="_zscore"),
    "robust_scaler": Op(lambda df, c, p, s: _safe_scale(df, c, p, s, s["q"][1], (s["q"][2] - s["q"][0]) if s["q"][0] is not None else 0),
                        quantiles=lambda p: [0.25, 0.5, 0.75], numeric=True, suffix="_robust"),
    "minmax_scaler": Op(_minmax, lambda df, c, p: {"lo": F.min(num(df, c)), "hi": F.max(num(df, c))}, numeric=True, suffix="_minmax"),
    "inverse": Op(_inverse, _inverse_stats, numeric=True, suffix="_inv"),
    "square": Op(lambda df, c, p, s: F.pow(num(df, c), F.lit(2.0)), numeric=True, suffix="_squared"),
    "cube": Op(lambda df, c, p, s: F.pow(num(df, c), F.lit(3.0)), numeric=True, suffix="_cubed"),
    "outlier_flag": Op(lambda df, c, p, s: F.coalesce(F.abs(_z(df, c, s)) > 3, F.lit(False)), _mean_sd(F.stddev), numeric=True, suffix="_outlier"),
    "text_length": Op(lambda df, c, p, s: F.length(q(c)), suffix="_len"),
    "word_count": Op(lambda df, c, p, s: word_count(q(c)), suffix="_wordcount"),
    "redact": Op(lambda df, c, p, s: F.lit(p.get("replacement", REDACTED))),
    "hash": Op(_hash, suffix="_hashed"),
    "mask": Op(lambda df, c, p, s: mask_text(q(c).cast("string"), p.get("mask_percentage", MASK_SHARE)), suffix="_masked"),
    "cast": Op(lambda df, c, p, s: q(c).try_cast(p["dtype"]) if not s["lost"] else q(c),
               lambda df, c, p: {"lost": F.count_if(q(c).isNotNull() & q(c).try_cast(p["dtype"]).isNull())}),
    "power_transform": Op(None, numeric=True, suffix="_power", whole=_power),
    "bin": Op(None, numeric=True, suffix="_bin", whole=_bins),
    "quartile_bin": Op(None, numeric=True, suffix="_bin", whole=_quartile),
    "rank": Op(None, numeric=True, suffix="_rank", whole=_rank),
    "encode": Op(None, whole=_one_hot),
    "label_encode": Op(None, suffix="_le", whole=_label),
    "freq_encode": Op(None, suffix="_freq", whole=_freq),
    "generalize": Op(None, suffix="_generalized", whole=_generalize),
    "top_categories": Op(None, whole=_top),
    "tfidf": Op(None, suffix="_emb", whole=_tfidf),
    "drop": Op(None, whole=lambda df, c, p: df.drop(c)),
    "suppress": Op(None, whole=lambda df, c, p: df.drop(c)),
    "rename": Op(None, whole=lambda df, c, p: df.withColumnRenamed(c, p["to"])),
    "forward_fill": Op(None, whole=lambda df, c, p: fill(df, c, p["order_by"], "forward", p.get("group"))),
    "backward_fill": Op(None, whole=lambda df, c, p: fill(df, c, p["order_by"], "backward", p.get("group"))),
    "interact": Op(None, numeric=True, whole=lambda df, c, p: df.withColumn(f"{c}_x_{p['with']}", num(df, c) * num(df, p["with"]))),
    "derive": Op(None, whole=lambda df, c, p: df.withColumn(p.get("out", c), F.expr(p["expression"]))),
}


def apply_op(df: DataFrame, action: str, col: str, **params) -> DataFrame:
    """One transform outside a recipe; unlike a recipe it raises when it cannot be applied."""
    from ..plans.recipe import Step, fit_recipe

    out, log = fit_recipe(df, [Step(action, col, params)])
    if log[0]["status"] != "applied":
        raise ValueError(f"{action} of {col}: {log[0]['reason']}")
    return out(df)


def interactions(df: DataFrame, max_pairs: int = INTERACTION_PAIRS, limit: float = INTERACTION_R, cols=None) -> DataFrame:
    """Products of the most correlated numeric pairs with |r| above ``limit``."""
    top = association.top_pairs(df, max_pairs, cols).filter(F.abs("r") > limit).collect()  # column pairs
    return df.withColumns({f"{r['col_a']}_x_{r['col_b']}": num(df, r["col_a"]) * num(df, r["col_b"]) for r in top}) if top else df
