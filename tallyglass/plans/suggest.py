"""Suggestion rules: utility and privacy transforms, conflicts, candidate features and fixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.exprs import collect_stats, columns_of, kurt_g2, num, q, records, resolve, skew_g1, text_columns
from ..operators import anonymity, association, pii
from ..operators.distributions import is_lognormal
from ..operators.outliers import iqr_fences

# fixed values: rule settings
DIRECT_PII = ["EMAIL", "SSN", "PHONE", "CREDIT_CARD", "PHONE_US"]
INDIRECT_PII = ["NAME", "ADDRESS", "URL", "IP_ADDRESS"]
DIRECT_IDENTIFIERS = ["EMAIL", "SSN", "PHONE", "CREDIT_CARD", "PHONE_US", "IP_ADDRESS"]
DESTRUCTIVE = ["redact", "suppress", "hash"]
PROTECTIONS = ["hash", "mask", "redact", "generalize", "suppress", "bin"]
MAX_PAIRS, PAIR_R = 5, 0.4
ONE_HOT_LEVELS = 12
EMBED_LENGTH = 15

UTILITY_SCHEMA = ("column string, transformation string, confidence double, skew double, kurtosis double, cv double, "
                  "outlier_pct double, variance_rank double")


# trainer settings
FULL_DEPTH, FOREST_MB = 30, 1024


def suggest_utility(df: DataFrame, cols=None, lognormal: bool = True) -> DataFrame:
    """First matching rule per numeric column, from one aggregate, one quantile pass and (optionally) a
    three-family fit."""
    cols = resolve(df, cols, "numeric")
    schema = UTILITY_SCHEMA
    if not cols:
        return records(df.sparkSession, [], schema)
    xs = {c: num(df, c) for c in cols}
    fences = iqr_fences(df, cols)
    stats = {}
    for c, x in xs.items():
        lo, hi = fences[c][2:]
        far = (x < F.lit(lo)) | (x > F.lit(hi)) if lo is not None else F.lit(False)
        stats.update({(c, "n"): F.count(x), (c, "skew"): skew_g1(x), (c, "kurt"): kurt_g2(x), (c, "mean"): F.avg(x), (c, "sd"): F.stddev(x),
                      (c, "var"): F.variance(x), (c, "lo"): F.min(x), (c, "hi"): F.max(x), (c, "far"): F.count_if(far)})
    s = collect_stats(df, stats)
    logn = {r["column"]: r["lognormal"] for r in is_lognormal(df, cols).collect()} if lognormal else {}
    variances = [s[c, "var"] for c in cols]
    rows = []
    for c in cols:
        n = s[c, "n"]
        if not n:
            continue
        skew, var, lo, hi = s[c, "skew"] or 0.0, s[c, "var"], s[c, "lo"], s[c, "hi"]
        cv = (s[c, "sd"] or 0.0) / s[c, "mean"] if s[c, "mean"] else 0.0
        pct = 100.0 * s[c, "far"] / n
        rank = sum(v is not None and var is not None and v > var for v in variances) / len(cols)
        rows.append((c, _utility_rule(skew=skew, outliers=pct, rank=rank, cv=cv, lo=lo, hi=hi, lognormal=logn.get(c, False)), skew, s[c, "kurt"], cv, pct, rank))
    flat = [(c, r[0], r[1], *rest) for c, r, *rest in rows if r]
    return records(df.sparkSession, [(c, t, float(k), *[None if v is None else float(v) for v in rest]) for c, t, k, *rest in flat], schema)


# fixed values: limits and confidences of the utility rules, in the order in which they are tried
HEAVY_SKEW, HEAVY_BASE, HEAVY_MOST, LOGNORMAL_BONUS, LOGNORMAL_MOST = 2.0, 5.0, 0.9, 0.15, 0.95
OUTLIER_PCT, OUTLIER_BASE, OUTLIER_MOST = 5.0, 20.0, 0.85
LOW_RANK, HIGH_CV, STANDARD_CONFIDENCE = 0.3, 1.0, 0.75
MILD_SKEW, SQRT_CONFIDENCE = 0.75, 0.70
FEW_OUTLIERS_PCT, MINMAX_CONFIDENCE = 2.0, 0.65


def _heavy_confidence(s):
    base = min(HEAVY_MOST, abs(s["skew"]) / HEAVY_BASE)
    return min(LOGNORMAL_MOST, base + LOGNORMAL_BONUS) if s["lognormal"] else base


def _heavy(s):
    return s["lo"] >= 0 and (s["lognormal"] or abs(s["skew"]) > HEAVY_SKEW)


#: (transformation, condition, confidence) on the statistics of a column; the first that holds is suggested.
UTILITY_RULES = [
    ("log_transform", lambda s: _heavy(s) and (s["lognormal"] or s["skew"] > 0), _heavy_confidence),
    ("power_transform", _heavy, _heavy_confidence),
    ("robust_scaler", lambda s: s["outliers"] > OUTLIER_PCT, lambda s: min(OUTLIER_MOST, s["outliers"] / OUTLIER_BASE)),
    ("standard_scaler", lambda s: s["rank"] < LOW_RANK and s["cv"] > HIGH_CV, lambda s: STANDARD_CONFIDENCE),
    ("sqrt_transform", lambda s: s["lo"] >= 0 and MILD_SKEW < abs(s["skew"]) <= HEAVY_SKEW, lambda s: SQRT_CONFIDENCE),
    ("minmax_scaler", lambda s: s["lo"] >= 0 and s["outliers"] < FEW_OUTLIERS_PCT and (s["lo"], s["hi"]) != (0, 1), lambda s: MINMAX_CONFIDENCE),
]


def _utility_rule(**stats):
    return next(((name, confidence(stats)) for name, holds, confidence in UTILITY_RULES if holds(stats)), None)


def suggest_privacy(df: DataFrame, scan: DataFrame | None = None, qis: DataFrame | None = None, every: bool = False) -> DataFrame:
    """(column, transformation, risk_level, pii_types, n_bins, confidence).  One suggestion per column:
    highest risk, then the order in which the rules are listed; ``every`` keeps all of them."""
    scan = pii.pii_scan(df) if scan is None else scan
    qis = anonymity.quasi_identifiers(df) if qis is None else qis
    numeric = columns_of(df, "numeric")
    types = F.split("pii_types", ",")
    direct = F.arrays_overlap(types, F.array(*[F.lit(t) for t in DIRECT_PII]))
    indirect = F.arrays_overlap(types, F.array(*[F.lit(t) for t in INDIRECT_PII]))

    def rule(cond, order, action, risk, bins=None):
        return F.when(cond, F.struct(F.lit(order).alias("ord"), F.lit(action).alias("transformation"), (F.lit(risk) if isinstance(risk, str) else risk).alias("risk_level"),
                                     (bins if bins is not None else F.lit(None).cast("int")).alias("n_bins")))

    def rows(src, rules, types_col, conf):
        return src.select("column", F.explode(F.filter(F.array(*rules), lambda r: r.isNotNull())).alias("r"), types_col.alias("pii_types"),
                          conf.cast("double").alias("confidence")).select("column", "r.*", "pii_types", "confidence")

    from_pii = rows(scan, [rule(direct, 1, "redact", "high"), rule(direct, 2, "hash", "high"), rule(~direct & indirect, 3, "mask", "medium")],
                    F.col("pii_types"), F.col("confidence"))
    risk = F.lower("risk_level")
    risky = risk.isin("medium", "high")
    base = F.when(risk == "high", 3).otherwise(5)
    bins = F.when(F.col("unique_values") < 10, F.least(base, F.lit(3))).when(F.col("unique_values") < 20, F.least(base, F.lit(4))).otherwise(base)
    is_num = F.col("column").isin(numeric)
    from_qi = rows(qis, [rule(risky & is_num, 4, "bin", risk, bins), rule(risky & ~is_num, 5, "generalize", risk),
                         rule((risk == "high") & (F.col("uniqueness_ratio") > 0.5), 6, "suppress", risk)], F.lit("QUASI_IDENTIFIER"), F.col("uniqueness_ratio"))
    allrows = from_pii.unionByName(from_qi)
    if every:
        return allrows.drop("ord")
    level = F.when(F.col("risk_level") == "high", 3).when(F.col("risk_level") == "medium", 2).otherwise(1)
    best = allrows.groupBy("column").agg(F.min_by(F.struct("transformation", "risk_level", "pii_types", "n_bins", "confidence"), F.struct(-level, "ord")).alias("b"))
    return best.select("column", "b.*")


def conflicts(utility: DataFrame, privacy: DataFrame) -> DataFrame:
    """Columns wanted by both sides, with type and severity."""
    u = utility.select("column", F.col("transformation").alias("utility"), F.col("confidence").alias("utility_confidence"))
    p = privacy.select("column", F.col("transformation").alias("privacy"), "risk_level")
    return u.join(p, "column").select(
        "column", "utility", "privacy", F.when(F.col("privacy").isin(DESTRUCTIVE), "direct").otherwise("indirect").alias("conflict_type"),
        F.when(F.col("risk_level") == "high", "high").when((F.col("risk_level") == "medium") | (F.col("utility_confidence") > 0.8), "medium")
        .otherwise("low").alias("severity"))


def non_conflicting(utility: DataFrame, privacy: DataFrame) -> DataFrame:
    """Suggestions of either side whose column the other side leaves alone."""
    u = utility.join(privacy.select("column"), "column", "left_anti").select("column", F.lit("utility").alias("side"), "transformation")
    p = privacy.join(utility.select("column"), "column", "left_anti").select("column", F.lit("privacy").alias("side"), "transformation")
    return u.unionByName(p)


def conflict_summary(found: DataFrame) -> DataFrame:
    n = lambda col, v: F.count_if(F.col(col) == v)
    return found.agg(F.count(F.lit(1)).alias("total_conflicts"), *[n("severity", s).alias(f"severity_{s}") for s in ("high", "medium", "low")],
                     *[n("conflict_type", t).alias(f"type_{t}") for t in ("direct", "indirect")],
                     F.concat_ws(",", F.sort_array(F.collect_list("column"))).alias("columns"),
                     F.concat_ws(",", F.sort_array(F.collect_list(F.when(F.col("severity") == "high", F.col("column"))))).alias("high_priority_columns"))


def suggest_all(df: DataFrame, lognormal: bool = True) -> dict[str, DataFrame]:
    """Both suggestion tables with their conflicts, the remainder and totals."""
    utility, privacy = suggest_utility(df, lognormal=lognormal), suggest_privacy(df)
    clash = conflicts(utility, privacy)
    total = utility.agg(F.count(F.lit(1)).alias("utility_suggestions")).withColumn("_k", F.lit(1))
    for name, t in (("privacy_suggestions", privacy), ("conflicts", clash)):
        total = total.join(t.agg(F.count(F.lit(1)).alias(name)).withColumn("_k", F.lit(1)), "_k")
    return {"utility": utility, "privacy": privacy, "conflicts": clash, "remaining": non_conflicting(utility, privacy),
            "conflict_summary": conflict_summary(clash), "totals": total.drop("_k")}


def protection_map(df: DataFrame, recipe: list | None = None) -> DataFrame:
    """Per column: risk class, suggested and applied protection, status."""
    scan, qis = pii.pii_scan(df), anonymity.quasi_identifiers(df)
    sug = suggest_privacy(df, scan, qis).select("column", F.col("transformation").alias("suggested"))
    used = {s.column: s.action.strip().lower() for s in (recipe or []) if s.action.strip().lower() in PROTECTIONS}
    cols = records(df.sparkSession, [(i, c, used.get(c)) for i, c in enumerate(df.columns)], "position int, column string, applied string")
    t = cols.join(scan.select("column", "pii_types", "confidence"), "column", "left").join(
        qis.select("column", "uniqueness_ratio"), "column", "left").join(sug, "column", "left")
    direct = F.arrays_overlap(F.split("pii_types", ","), F.array(*[F.lit(x) for x in DIRECT_IDENTIFIERS]))
    risk = F.when(F.col("pii_types").isNotNull(), F.when(direct, "direct_identifier").otherwise("sensitive")).when(
        F.col("uniqueness_ratio").isNotNull(), "quasi_identifier").otherwise("none")
    return t.withColumn("risk", risk).select(
        "position", "column", "risk", "pii_types", F.col("uniqueness_ratio").isNotNull().alias("is_quasi_identifier"),
        F.coalesce("confidence", "uniqueness_ratio", F.lit(0.0)).alias("confidence"), "suggested", "applied",
        F.when(F.col("risk") == "none", "none_needed").when(F.col("applied").isNotNull(), "protected")
        .when(F.col("suggested").isNotNull(), "unprotected").otherwise("needs_review").alias("status"))


def protection_totals(grid: DataFrame) -> DataFrame:
    risky, safe = F.col("risk") != "none", F.col("applied").isNotNull()
    n = F.count_if(risky)
    return grid.agg(F.count(F.lit(1)).alias("total_columns"), n.alias("risk_columns"), F.count_if(safe).alias("protected_columns"),
                    (n - F.count_if(safe)).alias("unprotected_columns"),
                    F.count_if((F.col("risk") == "direct_identifier") & ~safe).alias("unprotected_high_risk"),
                    F.coalesce(F.try_divide(F.count_if(safe) * 100.0, n), F.lit(100.0)).alias("protection_rate"))


def suggest_features(df: DataFrame, max_suggestions: int | None = None, per_kind: int | None = None) -> DataFrame:
    """(position, column, feature): candidate features in rule order, for all columns unless ``per_kind`` limits them."""
    numeric, texts = columns_of(df, "numeric")[:per_kind], text_columns(df)[:per_kind]
    stats = {}
    for c in numeric:
        x = num(df, c)
        stats.update({(c, "lo"): F.min(x), (c, "skew"): skew_g1(x), (c, "zeros"): F.count_if(x == 0), (c, "n"): F.approx_count_distinct(x, 0.02)})
    for c in texts:
        stats.update({(c, "n"): F.approx_count_distinct(q(c), 0.02), (c, "len"): F.avg(F.length(q(c)))})
    s = collect_stats(df, stats)
    rows = []
    for c in numeric:
        lo = s[c, "lo"]
        if lo is None:
            continue
        rows += [(c, "log")] * (lo > 0 and abs(s[c, "skew"] or 0) > 0.5) + [(c, "sqrt")] * (lo >= 0) + [(c, "inverse")] * (s[c, "zeros"] == 0)
        rows += [(c, "zscore"), (c, "minmax")] + [(c, "square"), (c, "cube")] * (s[c, "n"] > 5) + [(c, "quartile_bin"), (c, "rank"), (c, "outlier_flag")]
    allnum = columns_of(df, "numeric")
    if len(allnum) > 1:
        top = association.top_pairs(df, MAX_PAIRS, allnum).filter(F.abs("r") > PAIR_R).collect()  # column pairs
        rows += [(f"{r['col_a']},{r['col_b']}", "interact") for r in top]
    for c in texts:
        rows += [(c, "encode" if s[c, "n"] <= ONE_HOT_LEVELS else "label_encode"), (c, "freq_encode")]
    for c in texts:
        rows += [(c, "text_length"), (c, "word_count")] + [(c, "tfidf")] * ((s[c, "len"] or 0) > EMBED_LENGTH)
    rows = rows if max_suggestions is None else rows[:max_suggestions]
    return records(df.sparkSession, [(i, c, f) for i, (c, f) in enumerate(rows)], "position int, column string, feature string")


def feature_importance(df: DataFrame, target: str, trees: int = 30, top: int = 5, seed: int = 42, depth: int = FULL_DEPTH,
                       max_classes: int = 10, max_levels: int = 1_000) -> DataFrame:
    """(feature, importance): strongest one-hot encoded inputs of a random forest; a classifier when the
    target has at most ten classes, else a regressor.  Trees are grown in full, to the depth that the trainer allows.  Text columns with more levels than ``max_levels``
    are refused rather than cut."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    resolve(df, [target])
    numeric = [c for c in columns_of(df, "numeric") if c != target]
    texts = [c for c in text_columns(df) if c != target]
    sizes = collect_stats(df, {c: F.approx_count_distinct(q(c), 0.02) for c in [*texts, target]})
    wide = [c for c in texts if sizes[c] > max_levels]
    if wide:
        raise ValueError(f"too many levels to one-hot encode: {wide}")
    classify = sizes[target] <= max_classes
    rows = df.filter(q(target).isNotNull()).select(*[F.coalesce(num(df, c), F.lit(0.0)).alias(c) for c in numeric],
                                                   *[F.coalesce(q(c), F.lit("")).alias(c) for c in texts],
                                                   (q(target).cast("string") if classify else num(df, target)).alias("_target"))
    stages = []
    if texts:
        stages += [StringIndexer(inputCols=texts, outputCols=[c + "_i" for c in texts], handleInvalid="keep"),
                   OneHotEncoder(inputCols=[c + "_i" for c in texts], outputCols=[c + "_v" for c in texts], dropLast=False)]
    stages.append(VectorAssembler(inputCols=[*numeric, *[c + "_v" for c in texts]], outputCol="features"))
    label = "_target"
    if classify:
        stages.append(StringIndexer(inputCol="_target", outputCol="_label"))
        label = "_label"
    model = (RandomForestClassifier if classify else RandomForestRegressor)(labelCol=label, numTrees=trees, maxDepth=depth, seed=seed, maxMemoryInMB=FOREST_MB, cacheNodeIds=True)
    fitted = Pipeline(stages=[*stages, model]).fit(rows)
    names = list(numeric)
    if texts:
        for c, labels in zip(texts, fitted.stages[0].labelsArray):
            names += [f"{c}={v}" for v in labels] + [f"{c}=?"]
    weights = fitted.stages[-1].featureImportances.toArray()
    best = sorted(zip(weights, names[: len(weights)]), key=lambda t: (-t[0], t[1]))[:top]
    return records(df.sparkSession, [(n, float(w)) for w, n in best], "feature string, importance double")
