"""Column and table profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions import special
from ..functions.exprs import (collect_stats, columns_of, kind, kurt_g2, num, q, ratio, records, resolve,
                               skew_g1, text_columns, tidy)
from ..functions.keyed import long_counts
from ..functions.ordered import grouped_quantiles
from ..functions.quantiles import quantiles

# fixed values: profile settings
OUTLIER_Z = 3.0
RARE_COUNT = 5
HIGH_MISSING = 0.5
HIGH_CARDINALITY = 50
LOW_CARDINALITY = 3
SAMPLE_VALUES = 5
HISTOGRAM_BINS = 30
KDE_GRID = 200


def _text(df: DataFrame, name: str) -> Column:
    if kind(df.schema[name].dataType) == "nested":
        return F.to_json(q(name)) if not isinstance(df.schema[name].dataType, T.BinaryType) else F.hex(q(name))
    return q(name).cast("string")


def _value_table(df: DataFrame, cols: list[str]) -> DataFrame:
    return long_counts(df, {c: _text(df, c) for c in cols})


def profile_columns(df: DataFrame, cols: list[str] | None = None, approx: bool = False) -> DataFrame:
    """(column, dtype, n_rows, n_missing, pct_missing, n_unique, samples).

    Exact distinct counts of all columns come from one long (column, value) aggregation;
    ``approx=True`` replaces it by one sketch scan for very wide or long tables."""
    cols = resolve(df, cols, "numeric", "categorical", "datetime")
    dtypes = F.create_map(*[F.lit(x) for c in cols for x in (c, df.schema[c].dataType.simpleString())])
    if approx:
        rows = tidy(df, [F.struct(
            F.lit(c).alias("column"), F.count(F.lit(1)).alias("n_rows"), F.count_if(q(c).isNull()).alias("n_missing"),
            F.approx_count_distinct(q(c), 0.02).alias("n_unique"),
            F.lit(None).cast("string").alias("samples")) for c in cols])
    else:
        values = _value_table(df, cols)
        per_column = values.groupBy("column").agg(
            F.sum("n").alias("n_rows"),
            F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("n_missing"),
            F.count("value").alias("n_unique"))
        # row_number <= k is limited inside every task before the shuffle.
        first = Window.partitionBy("column").orderBy("value")
        samples = (values.filter(F.col("value").isNotNull()).withColumn("_r", F.row_number().over(first))
                   .filter(F.col("_r") <= SAMPLE_VALUES).groupBy("column")
                   .agg(F.concat_ws(" | ", F.sort_array(F.collect_list("value"))).alias("samples")))
        rows = per_column.join(F.broadcast(samples), "column", "left")
    return rows.select(
        "column", dtypes[F.col("column")].alias("dtype"), "n_rows", "n_missing",
        F.round(ratio(F.col("n_missing") * 100.0, F.col("n_rows")), 4).alias("pct_missing"), "n_unique", "samples")


def profile_numeric(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """min, max, mean, population std, bias-corrected skewness and excess kurtosis."""
    cols = resolve(df, cols, "numeric")
    xs = {c: num(df, c) for c in cols}
    return tidy(df, [F.struct(
        F.lit(c).alias("column"), F.count(x).alias("n"), F.min(x).alias("min"), F.max(x).alias("max"),
        F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), skew_g1(x).alias("skew"), kurt_g2(x).alias("kurtosis"))
        for c, x in xs.items()])


def profile_outliers(df: DataFrame, cols: list[str] | None = None, z: float = OUTLIER_Z) -> DataFrame:
    """Values beyond ``z`` population deviations; percentage of all rows."""
    cols = resolve(df, cols, "numeric")
    xs = {c: num(df, c) for c in cols}
    m = collect_stats(df, {(c, k): f(x) for c, x in xs.items() for k, f in (("m", F.avg), ("s", F.stddev_pop))})
    rows = []
    for c, x in xs.items():
        mean, sd = m[c, "m"], m[c, "s"]
        far = F.lit(False) if not sd else F.abs(x - F.lit(mean)) > F.lit(z * sd)
        n = F.count_if(far)
        rows.append(F.struct(F.lit(c).alias("column"), n.alias("n_outliers"),
                             ratio(n * 100.0, F.count(F.lit(1))).alias("pct_outliers")))
    return tidy(df, rows)


def profile_categorical(df: DataFrame, cols: list[str] | None = None, rare: int = RARE_COUNT) -> DataFrame:
    """Most and least common value (ties: smallest) and how many values are rarer than ``rare``.

    The rare values themselves are ``rare_values``: their number grows with the data."""
    cols = resolve(df, cols, "categorical")
    values = _value_table(df, cols).filter(F.col("value").isNotNull())
    down = F.struct((-F.col("n")).alias("n"), "value")
    up = F.struct("n", "value")
    return values.groupBy("column").agg(
        F.min(down).alias("_top"), F.min(up).alias("_low"),
        F.count_if(F.col("n") < rare).alias("n_rare"), F.count(F.lit(1)).alias("n_unique")).select(
        "column", "n_unique", F.col("_top.value").alias("most_common"), (-F.col("_top.n")).alias("most_common_n"),
        F.col("_low.value").alias("least_common"), F.col("_low.n").alias("least_common_n"), "n_rare")


def rare_values(df: DataFrame, cols: list[str] | None = None, rare: int = RARE_COUNT) -> DataFrame:
    cols = resolve(df, cols, "categorical")
    return _value_table(df, cols).filter(F.col("value").isNotNull() & (F.col("n") < rare))


SKETCH_ERROR = 0.02


def profile_against(df: DataFrame, limits: tuple[int, ...], cols: list[str] | None = None) -> DataFrame:
    """``profile_columns`` without samples, for comparing ``n_unique`` with the limits: one scan sketches all columns, and only
    those whose sketch is within five standard errors of a limit are counted exactly."""
    cols = resolve(df, cols, "numeric", "categorical", "datetime")
    rough = profile_columns(df, cols, approx=True).drop("samples")
    seen = {r["column"]: r["n_unique"] for r in rough.collect()}  # one row per column
    near = [c for c in cols if any(abs(seen[c] - v) <= 5 * SKETCH_ERROR * v + 1 for v in limits)]
    if not near:
        return rough
    exact = profile_columns(df, near).drop("samples")
    return exact.unionByName(rough.filter(~F.col("column").isin(near)))


def profile_summary(df: DataFrame) -> DataFrame:
    """One row: rows, columns, missing cells, and the names of problem columns."""
    cols = columns_of(df, "numeric", "categorical", "datetime")
    p = tidy(df, [F.struct(F.lit(c).alias("column"), F.count(F.lit(1)).alias("n_rows"), F.count_if(q(c).isNull()).alias("n_missing"),
                           F.coalesce(F.min(q(c)).eqNullSafe(F.max(q(c))), F.lit(True)).alias("constant")) for c in cols])
    def names(cond):
        return F.concat_ws(",", F.sort_array(F.collect_list(F.when(cond, F.col("column")))))
    return p.agg(
        F.max("n_rows").alias("n_rows"), F.count(F.lit(1)).alias("n_columns"),
        F.sum("n_missing").alias("missing_cells"), names(F.col("n_missing") > 0).alias("columns_with_missing"),
        names(F.col("constant")).alias("constant_columns"),
        names(F.col("n_missing") > HIGH_MISSING * F.col("n_rows")).alias("columns_high_missing"))


def duplicate_columns(df: DataFrame) -> DataFrame:
    """(column, duplicate_of): later column equal to an earlier one in every row.

    An order-free digest per column finds candidate pairs in one scan; the candidates are then
    compared null-safely cell by cell, so digest collisions never reach the result."""
    fields = [f for f in df.schema.fields if kind(f.dataType) != "nested"]
    row_sig = F.xxhash64(*[q(f.name) for f in fields])
    digest = collect_stats(df, {f.name: F.bit_xor(F.xxhash64(q(f.name), row_sig)) for f in fields})
    pairs = [(a.name, b.name) for i, a in enumerate(fields) for b in fields[i + 1:]
             if a.dataType == b.dataType and digest[a.name] == digest[b.name]]
    differ = collect_stats(df, {(a, b): F.count_if(~q(a).eqNullSafe(q(b))) for a, b in pairs})
    first: dict[str, str] = {}
    for a, b in pairs:
        if differ[a, b] == 0:
            first.setdefault(b, a)
    return records(df.sparkSession, sorted(first.items()), "column string, duplicate_of string")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows equal to an earlier row.  Grouping is null-safe and combined before the shuffle."""
    groups = df.groupBy(*[q(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("_copies"))
    total = F.coalesce(F.sum("_copies"), F.lit(0))
    dup = F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0))
    return groups.agg(total.alias("n_rows"), dup.alias("n_duplicates"),
                      F.coalesce(ratio(dup * 100.0, total), F.lit(0.0)).alias("pct_duplicates"))


def kpis(df: DataFrame) -> DataFrame:
    """Rows, cells, missing share and the number of columns per kind, in one scan."""
    cols = df.columns
    missing = [F.count_if(q(c).isNull()) for c in cols]
    n = F.count(F.lit(1))
    total = sum(missing[1:], missing[0])
    with_missing = sum([F.when(m > 0, 1).otherwise(0) for m in missing[1:]], F.when(missing[0] > 0, 1).otherwise(0))
    per_kind = {k: sum(kind(f.dataType) == k for f in df.schema.fields)
                for k in ("numeric", "categorical", "datetime", "nested")}
    return df.agg(n.alias("n_rows"), F.lit(len(cols)).alias("n_columns"), (n * len(cols)).alias("n_cells"),
                  total.alias("missing_cells"),
                  F.coalesce(ratio(total * 100.0, n * len(cols)), F.lit(0.0)).alias("pct_missing"),
                  with_missing.alias("columns_with_missing"),
                  *[F.lit(v).alias(f"n_{k}") for k, v in per_kind.items()])


def quality_score(df: DataFrame) -> DataFrame:
    """One row: score 0-100 with its deductions, a label, and severity codes of the issues."""
    texts = text_columns(df)
    const = collect_stats(df, {c: F.min(q(c)) == F.max(q(c)) for c in texts})
    n_const = sum(bool(v) for v in const.values())
    joined = kpis(df).select("pct_missing", "missing_cells").withColumn("_one", F.lit(1)).join(
        F.broadcast(duplicate_rows(df).select("n_duplicates", "pct_duplicates").withColumn("_one", F.lit(1))), "_one")
    score = F.lit(100.0) - F.least(F.col("pct_missing") * 2, F.lit(30.0)) \
        - F.least(F.col("pct_duplicates"), F.lit(20.0)) - F.lit(5.0 * n_const)
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))
    out = joined.withColumn("score", score)
    return out.select(
        "score",
        F.when(F.col("score") >= 90, "excellent").when(F.col("score") >= 70, "good")
        .when(F.col("score") >= 50, "fair").otherwise("needs_attention").alias("label"),
        "pct_missing", "pct_duplicates", F.lit(n_const).alias("constant_columns"),
        F.when(F.col("missing_cells") == 0, "none").when(F.col("pct_missing") < 5, "minor")
        .when(F.col("pct_missing") < 20, "moderate").otherwise("significant").alias("missing_issue"),
        F.when(F.col("n_duplicates") == 0, "none").when(F.col("pct_duplicates") < 5, "few")
        .otherwise("many").alias("duplicate_issue"))


def suggest_fixes(df: DataFrame) -> DataFrame:
    """(column, fix, method) rule rows over the profile.  Distinct counts are exact only where the sketch is near a limit."""
    p = profile_against(df, (1, LOW_CARDINALITY, HIGH_CARDINALITY))
    numeric = columns_of(df, "numeric")
    if numeric:
        shape = profile_numeric(df).select("column", "skew").join(profile_outliers(df), "column")
    else:
        shape = records(df.sparkSession, [], "column string, skew double, n_outliers bigint, pct_outliers double")
    t = p.join(F.broadcast(shape), "column", "left")
    dup = F.broadcast(duplicate_columns(df).select(F.col("column"), F.lit(True).alias("_dup")))
    t = t.join(dup, "column", "left")
    is_num = F.col("column").isin(numeric)
    is_text = F.col("dtype") == "string"
    def rule(cond, fix, method=None):
        return F.when(cond, F.struct(F.lit(fix).alias("fix"), (method if method is not None else F.lit(None).cast("string"))
                                     .alias("method")))
    way = F.when(~is_num, "mode").when(F.abs("skew") > 1, "median").otherwise("mean")
    rules = F.array(
        rule(F.col("n_missing") > 0, "impute", way),
        rule(is_text & (F.col("n_unique") > HIGH_CARDINALITY), "encode"),
        rule(is_text & (F.col("n_unique") < LOW_CARDINALITY), "review"),
        rule(F.col("n_outliers") > 0, "outlier"),
        rule(F.col("n_unique") <= 1, "drop_constant"),
        rule(F.col("_dup"), "drop_duplicate"),
        rule(F.col("n_missing") > HIGH_MISSING * F.col("n_rows"), "drop_high_missing"))
    return t.select("column", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("r")).select(
        "column", "r.fix", "r.method")


def describe(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Count, mean, sample std, quartiles, range, missing, skewness and kurtosis."""
    cols = resolve(df, cols, "numeric")
    xs = {c: num(df, c) for c in cols}
    quart = quantiles(df, {c: (x, [0.25, 0.5, 0.75]) for c, x in xs.items()})
    n_all = F.count(F.lit(1))
    return tidy(df, [F.struct(
        F.lit(c).alias("column"), F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev(x).alias("std"),
        F.min(x).alias("min"), *[F.lit(v).cast("double").alias(k) for k, v in zip(("q1", "median", "q3"), quart[c])],
        F.max(x).alias("max"), (n_all - F.count(x)).alias("n_missing"),
        ratio((n_all - F.count(x)) * 100.0, n_all).alias("pct_missing"), skew_g1(x).alias("skew"),
        kurt_g2(x).alias("kurtosis")) for c, x in xs.items()])


def value_counts_by(df: DataFrame, col: str, by: str, n: int = 10) -> DataFrame:
    """Counts of the ``n`` most frequent values, split by a second column."""
    from .relational import top_values

    return top_values(df, col, n).groupBy(q(col).alias("value"), q(by).alias("by")).agg(F.count(F.lit(1)).alias("n"))


def bin_index(x: Column, lo: float, hi: float, bins: int) -> Column:
    """Left-closed equal-width bin number; the last bin is closed on both sides."""
    if hi == lo:
        return F.when(x.isNotNull(), F.lit(0))
    return F.when(x.isNotNull(), F.least(F.floor((x - F.lit(lo)) / F.lit((hi - lo) / bins)).cast("int"), F.lit(bins - 1)))


def histogram(df: DataFrame, col: str, bins: int = HISTOGRAM_BINS, by: str | None = None) -> DataFrame:
    """(by, bin, lo, hi, n, density); empty bins appear with zero counts when ungrouped."""
    x = num(df, col)
    r = df.agg(F.min(x), F.max(x)).first()
    lo, hi = r[0], r[1]
    spark = df.sparkSession
    if lo is None:
        return records(spark, [], "bin int, lo double, hi double, n bigint, density double")
    width = (hi - lo) / bins if hi > lo else 1.0
    keys = [q(by).alias("by")] if by else []
    seen = (df.select(*keys, bin_index(x, lo, hi, bins).alias("bin")).filter(F.col("bin").isNotNull())
            .groupBy(*(["by"] if by else []), "bin").agg(F.count(F.lit(1)).alias("n")))
    if not by:
        seen = spark.range(bins).select(F.col("id").cast("int").alias("bin")).join(F.broadcast(seen), "bin", "left").fillna(0, ["n"])
        total = seen.agg(F.sum("n")).first()[0]
        dens = F.col("n") / F.lit(float(total) * width)
    else:
        sizes = seen.groupBy(F.col("by").alias("_by")).agg(F.sum("n").alias("_size"))
        seen = seen.join(sizes, F.col("by").eqNullSafe(F.col("_by"))).drop("_by")
        dens = F.col("n") / (F.col("_size") * F.lit(width))
    edge = F.lit(lo) + F.col("bin") * F.lit(width)
    return seen.select(*(["by"] if by else []), "bin", edge.alias("lo"), (edge + F.lit(width)).alias("hi"), "n",
                       dens.alias("density"))


def box_stats(df: DataFrame, cols: list[str] | None = None, by: str | None = None, fence: float = 1.5) -> DataFrame:
    """Quartiles, whisker ends inside the fences, mean and std; per group when ``by`` is given."""
    cols = resolve(df, cols, "numeric")
    if by is None:
        xs = {c: num(df, c) for c in cols}
        quart = quantiles(df, {c: (x, [0.25, 0.5, 0.75]) for c, x in xs.items()})
        rows = []
        for c, x in xs.items():
            q1, med, q3 = (F.lit(v).cast("double") for v in quart[c])
            lo, hi = q1 - F.lit(fence) * (q3 - q1), q3 + F.lit(fence) * (q3 - q1)
            rows.append(F.struct(
                F.lit(c).alias("column"), F.count(x).alias("n"), q1.alias("q1"), med.alias("median"), q3.alias("q3"),
                F.min(F.when(x >= lo, x)).alias("whisker_lo"), F.max(F.when(x <= hi, x)).alias("whisker_hi"),
                F.avg(x).alias("mean"), F.stddev(x).alias("std")))
        return tidy(df, rows)
    out = None
    for c in cols:
        t = df.select(q(by).alias("by"), num(df, c).alias("x"))
        quart = grouped_quantiles(t, "by", "x", {"q1": 0.25, "median": 0.5, "q3": 0.75}).withColumnRenamed("by", "_by")
        from ..functions.keyed import attach

        wide = attach(t, quart.drop("n").withColumnRenamed("_by", "by"), ["by"])
        span = F.col("q3") - F.col("q1")
        part = wide.groupBy("by").agg(
            F.count("x").alias("n"), F.first("q1").alias("q1"), F.first("median").alias("median"), F.first("q3").alias("q3"),
            F.min(F.when(F.col("x") >= F.col("q1") - fence * span, F.col("x"))).alias("whisker_lo"),
            F.max(F.when(F.col("x") <= F.col("q3") + fence * span, F.col("x"))).alias("whisker_hi"),
            F.avg("x").alias("mean"), F.stddev("x").alias("std")).withColumn("column", F.lit(c))
        out = part if out is None else out.unionByName(part)
    return out


def kde(df: DataFrame, col: str, grid: int = KDE_GRID, cells: int = 2048, bandwidth: float | None = None) -> DataFrame:
    """(x, density): Gaussian kernel on ``grid`` points, Scott bandwidth, over a fine histogram of
    all rows (``cells`` cells, each represented by its mean value)."""
    x = num(df, col)
    s = df.agg(F.count(x), F.min(x), F.max(x), F.stddev(x)).first()
    n, lo, hi, sd = s
    if not n or not sd:
        return records(df.sparkSession, [], "x double, density double")
    h = bandwidth if bandwidth is not None else sd * n ** (-0.2)
    fine = (df.select(bin_index(x, lo, hi, cells).alias("cell"), x.alias("v")).filter(F.col("cell").isNotNull())
            .groupBy("cell").agg(F.count("v").alias("n"), F.avg("v").alias("v")))
    step = (hi - lo) / (grid - 1)
    points = F.transform(F.sequence(F.lit(0), F.lit(grid - 1)), lambda i: F.struct(
        i.alias("i"), (F.col("n") * F.exp(-0.5 * F.pow((F.lit(lo) + i * F.lit(step) - F.col("v")) / F.lit(h), F.lit(2.0))))
        .alias("w")))
    norm = n * h * (2 * 3.141592653589793) ** 0.5
    return (fine.select(F.inline(points)).groupBy("i").agg((F.sum("w") / F.lit(norm)).alias("density"))
            .select((F.lit(lo) + F.col("i") * F.lit(step)).alias("x"), "density"))


def qq_points(df: DataFrame, col: str, points: int = 100) -> DataFrame:
    """(position, theoretical, sample, slope, intercept): normal quantile plot at (i-0.5)/points."""
    probs = [(i - 0.5) / points for i in range(1, points + 1)]
    got = quantiles(df, {"x": (num(df, col), probs)})["x"]
    schema = "position int, theoretical double, sample double, slope double, intercept double"
    if got[0] is None:
        return records(df.sparkSession, [], schema)
    theo = [special.normal_ppf(p) for p in probs]
    mt, ms = sum(theo) / points, sum(got) / points
    slope = sum((t - mt) * (v - ms) for t, v in zip(theo, got)) / sum((t - mt) ** 2 for t in theo)
    return records(df.sparkSession, [(i + 1, theo[i], float(got[i]), slope, ms - slope * mt) for i in range(points)], schema)
