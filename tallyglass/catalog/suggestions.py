"""Suggestion rules, transform impact and distribution fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import distributions as dist
from ..plans import impact, suggest
from ..plans.recipe import Step, steps_of
from .privacy import _SCAN, contacts
from .registry import query, rounded


# Numeric columns of different shapes, one per rule.
_SHAPED = """d AS (SELECT event_id, value, value * value * value AS cubed, CAST(user_id AS DOUBLE) AS user_id, CASE WHEN value > 90 THEN 200 + value ELSE 100 + user_id / 20.0 END AS burst,
 value * 1.5 - 30 AS shifted FROM events)"""


def shaped(t):
    return t.events.selectExpr("event_id", "value", "value * value * value AS cubed", "double(user_id) AS user_id",
                               "CASE WHEN value > 90 THEN 200 + value ELSE 100 + user_id / 20.0D END AS burst", "value * 1.5D - 30 AS shifted")


_NUM = ["event_id", "value", "cubed", "user_id", "burst", "shifted"]


def _shape_row(c):
    return f"""SELECT '{c}' AS "column", count({c}) AS n, skewness({c}) AS skew, kurtosis({c}) AS kurtosis, stddev({c}) / avg({c}) AS cv, variance({c}) AS var, min({c}) AS lo, max({c}) AS hi,
 count(CASE WHEN {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1) THEN 1 END) * 100.0 / count({c}) AS outlier_pct
 FROM d, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM d) GROUP BY q1, q3"""


UTILITY = f"""{_SHAPED}, s AS ({" UNION ALL ".join(_shape_row(c) for c in _NUM)}),
 r AS (SELECT *, (SELECT count(*) FROM s b WHERE b.var > s.var) / 6.0 AS variance_rank FROM s),
 ut AS (SELECT *, CASE WHEN abs(skew) > 2 AND lo >= 0 THEN CASE WHEN skew > 0 THEN 'log_transform' ELSE 'power_transform' END WHEN outlier_pct > 5 THEN 'robust_scaler'
  WHEN variance_rank < 0.3 AND cv > 1 THEN 'standard_scaler' WHEN abs(skew) > 0.75 AND abs(skew) <= 2 AND lo >= 0 THEN 'sqrt_transform'
  WHEN lo >= 0 AND outlier_pct < 2 AND NOT (lo = 0 AND hi = 1) THEN 'minmax_scaler' END AS transformation,
  CASE WHEN abs(skew) > 2 AND lo >= 0 THEN least(0.9, abs(skew) / 5) WHEN outlier_pct > 5 THEN least(0.85, outlier_pct / 20) WHEN variance_rank < 0.3 AND cv > 1 THEN 0.75
  WHEN abs(skew) > 0.75 AND abs(skew) <= 2 AND lo >= 0 THEN 0.70 ELSE 0.65 END AS confidence FROM r),
 u AS (SELECT * FROM ut WHERE transformation IS NOT NULL)"""


@query("sug_utility", f"""WITH {UTILITY} SELECT "column", transformation, round(confidence, 6) AS confidence, round(skew, 5) AS skew, round(kurtosis, 5) AS kurtosis, round(cv, 5) AS cv,
 round(outlier_pct, 6) AS outlier_pct, round(variance_rank, 6) AS variance_rank FROM u""")
def _(t):
    return rounded(suggest.suggest_utility(shaped(t)), 6, skew=5, kurtosis=5, cv=5)


@query("sug_utility_lognormal")
def _(t):
    return rounded(suggest.suggest_utility(t.orders))


_PRIV = f"""{_SCAN}, qi AS (SELECT 'c_nationkey' AS "column", count(DISTINCT c_nationkey) AS u, count(DISTINCT c_nationkey) * 1.0 / count(*) AS ratio, true AS num FROM c UNION ALL SELECT 'c_mktsegment', count(DISTINCT c_mktsegment),
  count(DISTINCT c_mktsegment) * 1.0 / count(*), false FROM c), qr AS (SELECT *, round(ratio, 4) AS rr, CASE WHEN ratio < 0.01 THEN 'low' WHEN ratio < 0.1 THEN 'medium' ELSE 'high' END AS risk FROM qi WHERE u BETWEEN 2 AND 100),
 cand AS (SELECT "column", CASE WHEN regexp_matches(pii_types, 'EMAIL|SSN|PHONE|CREDIT_CARD') THEN 'redact' ELSE 'mask' END AS transformation, CASE WHEN regexp_matches(pii_types, 'EMAIL|SSN|PHONE|CREDIT_CARD') THEN 'high' ELSE 'medium' END AS risk_level,
  pii_types, CAST(NULL AS INTEGER) AS n_bins, confidence, 1 AS o FROM s WHERE regexp_matches(pii_types, 'EMAIL|SSN|PHONE|CREDIT_CARD|NAME|ADDRESS|URL')
  UNION ALL SELECT "column", CASE WHEN num THEN 'bin' ELSE 'generalize' END, risk, 'QUASI_IDENTIFIER', CASE WHEN num THEN CASE WHEN u < 10 THEN 3 WHEN u < 20 THEN least(4, CASE risk WHEN 'high' THEN 3 ELSE 5 END)
   ELSE CASE risk WHEN 'high' THEN 3 ELSE 5 END END END, rr, 2 FROM qr WHERE risk <> 'low'),
 pv AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY CASE risk_level WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, o) AS rn FROM cand) WHERE rn = 1)"""


@query("sug_privacy", f"WITH {_PRIV} SELECT \"column\", transformation, risk_level, pii_types, n_bins, round(CAST(confidence AS DOUBLE), 6) AS confidence FROM pv")
def _(t):
    return rounded(suggest.suggest_privacy(contacts(t)))


_DIRECT = "regexp_matches(pii_types, 'EMAIL|SSN|PHONE|CREDIT_CARD')"


@query("sug_privacy_every", f"""WITH {_PRIV}, every AS (
 SELECT "column", unnest(['redact', 'hash']) AS transformation, 'high' AS risk_level, pii_types, CAST(NULL AS INTEGER) AS n_bins, confidence FROM s WHERE {_DIRECT}
 UNION ALL SELECT "column", 'mask', 'medium', pii_types, NULL, confidence FROM s WHERE NOT {_DIRECT} AND regexp_matches(pii_types, 'NAME|ADDRESS|URL')
 UNION ALL SELECT "column", transformation, risk_level, pii_types, n_bins, confidence FROM cand WHERE pii_types = 'QUASI_IDENTIFIER'
 UNION ALL SELECT "column", 'suppress', risk, 'QUASI_IDENTIFIER', NULL, rr FROM qr WHERE risk = 'high' AND ratio > 0.5)
 SELECT "column", transformation, risk_level, pii_types, n_bins, round(CAST(confidence AS DOUBLE), 6) AS confidence FROM every""")
def _(t):
    return rounded(suggest.suggest_privacy(contacts(t), every=True))


# Both sides on the customers with a balance: the nation key is wanted by both.
_BOTH = f"""WITH {_PRIV}, d AS (SELECT CAST(c_custkey AS DOUBLE) AS c_custkey, CAST(c_nationkey AS DOUBLE) AS c_nationkey FROM c), sx AS ({_shape_row('c_custkey')} UNION ALL {_shape_row('c_nationkey')}),
 u AS (SELECT "column", 'minmax_scaler' AS transformation, 0.65 AS confidence FROM sx WHERE abs(skew) <= 0.75 AND outlier_pct < 2 AND lo >= 0 AND cv <= 1)"""
_CONFLICT = """, k AS (SELECT u."column", u.transformation AS utility, pv.transformation AS privacy, CASE WHEN pv.transformation IN ('redact', 'suppress', 'hash') THEN 'direct' ELSE 'indirect' END AS conflict_type,
 CASE WHEN risk_level = 'high' THEN 'high' WHEN risk_level = 'medium' OR u.confidence > 0.8 THEN 'medium' ELSE 'low' END AS severity FROM u JOIN pv USING ("column"))"""


@query("sug_conflicts", _BOTH + _CONFLICT + " SELECT * FROM k")
def _(t):
    return suggest.suggest_all(contacts(t))["conflicts"]


@query("sug_nonconflict", _BOTH + """ SELECT "column", 'utility' AS side, transformation FROM u WHERE "column" NOT IN (SELECT "column" FROM pv)
 UNION ALL SELECT "column", 'privacy', transformation FROM pv WHERE "column" NOT IN (SELECT "column" FROM u)""")
def _(t):
    return suggest.suggest_all(contacts(t))["remaining"]


@query("sug_conflict_summary", _BOTH + _CONFLICT + """ SELECT count(*) AS total_conflicts, count(CASE WHEN severity = 'high' THEN 1 END) AS severity_high, count(CASE WHEN severity = 'medium' THEN 1 END) AS severity_medium,
 count(CASE WHEN severity = 'low' THEN 1 END) AS severity_low, count(CASE WHEN conflict_type = 'direct' THEN 1 END) AS type_direct, count(CASE WHEN conflict_type = 'indirect' THEN 1 END) AS type_indirect,
 coalesce(string_agg("column", ',' ORDER BY "column"), '') AS columns, coalesce(string_agg(CASE WHEN severity = 'high' THEN "column" END, ',' ORDER BY "column"), '') AS high_priority_columns FROM k""")
def _(t):
    return suggest.suggest_all(contacts(t))["conflict_summary"]


@query("sug_all", _BOTH + _CONFLICT + " SELECT (SELECT count(*) FROM u) AS utility_suggestions, (SELECT count(*) FROM pv) AS privacy_suggestions, (SELECT count(*) FROM k) AS conflicts")
def _(t):
    return suggest.suggest_all(contacts(t))["totals"]


_MAP = _BOTH.replace("WITH ", "WITH ") + """, m AS (SELECT cols.position, cols.c AS "column", CASE WHEN s.pii_types IS NOT NULL THEN CASE WHEN regexp_matches(s.pii_types, 'EMAIL|SSN|PHONE|CREDIT_CARD|IP_ADDRESS') THEN 'direct_identifier' ELSE 'sensitive' END
 WHEN qr.u IS NOT NULL THEN 'quasi_identifier' ELSE 'none' END AS risk, s.pii_types, qr.u IS NOT NULL AS is_quasi_identifier, round(CAST(coalesce(s.confidence, qr.rr, 0) AS DOUBLE), 6) AS confidence, pv.transformation AS suggested,
 CASE WHEN cols.c = 'contact' THEN 'redact' END AS applied FROM (VALUES (0, 'c_custkey'), (1, 'c_name'), (2, 'c_mktsegment'), (3, 'c_nationkey'), (4, 'contact')) cols(position, c)
 LEFT JOIN s ON s."column" = cols.c LEFT JOIN qr ON qr."column" = cols.c LEFT JOIN pv ON pv."column" = cols.c),
 mm AS (SELECT *, CASE WHEN risk = 'none' THEN 'none_needed' WHEN applied IS NOT NULL THEN 'protected' WHEN suggested IS NOT NULL THEN 'unprotected' ELSE 'needs_review' END AS status FROM m)"""
_APPLIED = [Step("redact", "contact"), Step("log_transform", "c_nationkey")]


@query("priv_map", _MAP + " SELECT * FROM mm")
def _(t):
    return rounded(suggest.protection_map(contacts(t), _APPLIED))


@query("priv_map_totals", _MAP + """ SELECT count(*) AS total_columns, count(CASE WHEN risk <> 'none' THEN 1 END) AS risk_columns, count(applied) AS protected_columns, count(CASE WHEN risk <> 'none' THEN 1 END) - count(applied) AS unprotected_columns,
 count(CASE WHEN risk = 'direct_identifier' AND applied IS NULL THEN 1 END) AS unprotected_high_risk, round(count(applied) * 100.0 / count(CASE WHEN risk <> 'none' THEN 1 END), 6) AS protection_rate FROM mm""")
def _(t):
    return rounded(suggest.protection_totals(suggest.protection_map(contacts(t), _APPLIED)))


@query("sug_features", """WITH s AS (SELECT CASE WHEN min(p_size) > 0 AND abs(skewness(p_size)) > 0.5 THEN 1 ELSE 0 END AS has_log, CASE WHEN min(p_size) >= 0 THEN 1 ELSE 0 END AS has_sqrt, CASE WHEN min(p_size) > 0 THEN 1 ELSE 0 END AS has_inv,
 CASE WHEN count(DISTINCT p_size) > 5 THEN 1 ELSE 0 END AS has_pow, count(DISTINCT p_type) AS levels FROM part),
 f(o, "column", feature, keep) AS (SELECT 0, 'p_size', 'log', has_log FROM s UNION ALL SELECT 1, 'p_size', 'sqrt', has_sqrt FROM s UNION ALL SELECT 2, 'p_size', 'inverse', has_inv FROM s UNION ALL SELECT 3, 'p_size', 'zscore', 1 FROM s
 UNION ALL SELECT 4, 'p_size', 'minmax', 1 FROM s UNION ALL SELECT 5, 'p_size', 'square', has_pow FROM s UNION ALL SELECT 6, 'p_size', 'cube', has_pow FROM s UNION ALL SELECT 7, 'p_size', 'quartile_bin', 1 FROM s UNION ALL SELECT 8, 'p_size', 'rank', 1 FROM s
 UNION ALL SELECT 9, 'p_size', 'outlier_flag', 1 FROM s UNION ALL SELECT 10, 'p_type', CASE WHEN levels <= 12 THEN 'encode' ELSE 'label_encode' END, 1 FROM s UNION ALL SELECT 11, 'p_type', 'freq_encode', 1 FROM s
 UNION ALL SELECT 12, 'p_type', 'text_length', 1 FROM s UNION ALL SELECT 13, 'p_type', 'word_count', 1 FROM s)
 SELECT CAST(row_number() OVER (ORDER BY o) - 1 AS INTEGER) AS position, "column", feature FROM f WHERE keep = 1""")
def _(t):
    return suggest.suggest_features(t.part.select("p_size", "p_type"), None)


@query("sug_importance")
def _(t):
    return rounded(suggest.feature_importance(t.documents.join(t.labels, "doc_id").select("lang", "source", "n_chars", "toxic", "quality"), "quality"))


# ---- impact ----------------------------------------------------------------

_STEPS = [{"action": "log_transform", "column": "value"}, {"action": "sqrt_transform", "column": "value"}, {"action": "standard_scaler", "column": "user_id"},
          {"action": "log_transform", "column": "shifted"}, {"action": "robust_scaler", "column": "cubed"}]
_OUT = [("log_transform", "value", "value_log", "ln(1 + value)"), ("sqrt_transform", "value", "value_sqrt", "sqrt(value)"),
        ("standard_scaler", "user_id", "user_id_scaled", "(user_id - (SELECT avg(user_id) FROM d)) / (SELECT stddev_pop(user_id) FROM d)"),
        ("robust_scaler", "cubed", "cubed_robust", "(cubed - (SELECT median(cubed) FROM d)) / (SELECT quantile_cont(cubed, 0.75) - quantile_cont(cubed, 0.25) FROM d)")]
_WIDE = f"{_SHAPED}, w AS (SELECT *, {', '.join(f'{x} AS {o}' for _, _, o, x in _OUT)} FROM d)"


def _stat(c, table="w"):
    return f"""SELECT '{c}' AS "column", count({c}) AS n, avg({c}) AS mean, median({c}) AS median, stddev({c}) AS std, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max,
 skewness({c}) * (count({c}) - 2) / sqrt(CAST(count({c}) AS DOUBLE) * (count({c}) - 1)) AS skewness, kurtosis_pop({c}) AS kurtosis, count(CASE WHEN {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1) THEN 1 END) AS outlier_count,
 count(CASE WHEN {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1) THEN 1 END) * 100.0 / count({c}) AS outlier_pct FROM {table}, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {table}) GROUP BY q1, q3"""


@query("ti_stats", f"WITH {_WIDE}, s AS ({' UNION ALL '.join(_stat(c) for c in ('value', 'user_id', 'burst', 'shifted'))}) SELECT \"column\", n, " + ", ".join(
    f"round({c}, 4) AS {c}" for c in ("mean", "median", "std", "min", "max", "skewness", "kurtosis")) + ", outlier_count, round(outlier_pct, 4) AS outlier_pct, CAST(NULL AS VARCHAR) AS error FROM s")
def _(t):
    return rounded(impact.column_stats(shaped(t), ["value", "user_id", "burst", "shifted"]), 4)


_DELTAS = f"""WITH {_WIDE}, s AS ({' UNION ALL '.join(_stat(c) for c in ['value', 'user_id', 'cubed'] + [o for _, _, o, _ in _OUT])}),
 l AS (SELECT "column", unnest(['mean', 'median', 'std', 'skewness', 'kurtosis', 'outlier_pct']) AS metric, unnest([mean, median, std, skewness, kurtosis, outlier_pct]) AS v FROM s),
 p(action, "column", output) AS (VALUES {', '.join(f"('{a}', '{c}', '{o}')" for a, c, o, _ in _OUT)}),
 dl AS (SELECT p.action, p."column", p.output, b.metric, b.v AS "before", a.v AS "after", a.v - b.v AS change, CASE WHEN b.v = 0 THEN 0 ELSE (a.v - b.v) * 100 / b.v END AS pct_change
  FROM p JOIN l b ON b."column" = p."column" JOIN l a ON a."column" = p.output AND a.metric = b.metric)"""


@query("ti_recipe", _DELTAS + """ SELECT action, "column", output, metric, round("before", 4) AS "before", round("after", 4) AS "after", round(change, 4) AS change, round(pct_change, 4) AS pct_change FROM dl""")
def _(t):
    return rounded(impact.compare_recipe(shaped(t), steps_of(_STEPS))[0], 4)


@query("ti_deltas", _DELTAS + """ SELECT action, "column", output, metric, round("before", 4) AS "before", round("after", 4) AS "after", round(change, 4) AS change, round(pct_change, 4) AS pct_change FROM dl WHERE action = 'log_transform'""")
def _(t):
    from ..functions.exprs import records

    d = t.events.select("event_id", "value", F.log1p("value").alias("value_log"))
    pairs = records(t.spark, [("log_transform", "value", "value_log")], "action string, column string, output string")
    return rounded(impact.deltas(impact.column_stats(d, ["value"]), impact.column_stats(d, ["value_log"]), pairs), 4)


_SCORE = """, cut AS (SELECT action, "column", output, metric, greatest(CASE WHEN "before" = 0 THEN 0 ELSE (abs("before") - abs("after")) * 100 / abs("before") END, 0) AS r FROM dl),
 sc AS (SELECT action, "column", output, round(sum(CASE metric WHEN 'skewness' THEN least(r, 50) WHEN 'outlier_pct' THEN least(r / 2, 50) ELSE 0 END), 2) AS score FROM cut GROUP BY 1, 2, 3)"""


@query("ti_score", _DELTAS + _SCORE + """ SELECT *, CASE WHEN score >= 75 THEN 'excellent' WHEN score >= 50 THEN 'good' WHEN score >= 25 THEN 'moderate' WHEN score > 0 THEN 'minor' ELSE 'none' END AS label FROM sc""")
def _(t):
    return rounded(impact.improvement(impact.compare_recipe(shaped(t), steps_of(_STEPS))[0]), 2)


@query("ti_kpis", _DELTAS + """, k AS (SELECT action, "column", output, max(CASE WHEN metric = 'skewness' THEN change END) AS ds, max(CASE WHEN metric = 'outlier_pct' THEN change END) AS d_o, max(CASE WHEN metric = 'skewness' THEN "after" END) AS s,
 max(CASE WHEN metric = 'outlier_pct' THEN "after" END) AS o FROM dl GROUP BY 1, 2, 3)
 SELECT count(DISTINCT "column") AS n_transformed, round(count(DISTINCT "column") * 100.0 / 6, 5) AS pct_transformed, round(avg(ds), 5) AS avg_skewness_change, round(avg(d_o), 5) AS avg_outlier_change,
 count(CASE WHEN ds < -0.1 OR d_o < -1 THEN 1 END) AS improved, count(CASE WHEN NOT (ds < -0.1 OR d_o < -1) AND (ds > 0.1 OR d_o > 1) THEN 1 END) AS worsened,
 coalesce(string_agg(CASE WHEN abs(s) > 2 OR o > 10 THEN output END, ',' ORDER BY output), '') AS risky_columns FROM k""")
def _(t):
    d = shaped(t)
    return rounded(impact.impact_kpis(impact.compare_recipe(d, steps_of(_STEPS))[0], len(d.columns)), 5)


@query("ti_sample_first", "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderkey LIMIT 500")
def _(t):
    return impact.sample_rows(t.orders, "first", 500, ["o_orderkey"]).select("o_orderkey", "o_orderpriority")


@query("ti_sample_random", "SELECT 500 AS n, 500 AS n_known FROM orders HAVING count(*) > 500")
def _(t):
    s = impact.sample_rows(t.orders, "random", 500, ["o_orderkey"])
    return s.join(t.orders.select("o_orderkey", F.lit(1).alias("hit")), "o_orderkey", "left").agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("n_known"))


@query("ti_sample_strat", """WITH s AS (SELECT o_orderstatus, count(*) AS size FROM orders GROUP BY 1), b AS (SELECT *, (SELECT sum(size) FROM s) AS total FROM s),
 q AS (SELECT *, 500 * size // total AS base, row_number() OVER (ORDER BY 500 * size % total DESC, o_orderstatus) AS r FROM b)
 SELECT o_orderstatus, CAST(base + CASE WHEN r <= 500 - (SELECT sum(base) FROM q) THEN 1 ELSE 0 END AS BIGINT) AS n FROM q""")
def _(t):
    return impact.sample_rows(t.orders, "stratified", 500, ["o_orderkey"]).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


# ---- distributions ---------------------------------------------------------


@query("dist_fit")
def _(t):
    return rounded(dist.fit_distributions(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount"]).unionByName(
        dist.fit_distributions(t.events, ["value"])), 6)


_BASIC = ("norm", "lognorm", "expon", "uniform")


def _fit_sql(c, table, families=_BASIC):
    """Residual sum of squares of closed-form families on 50 bins."""
    return f"""SELECT '{c}' AS "column", any_value(n) AS n, family, sum(power(coalesce(h, 0) - pdf, 2)) AS rss FROM (
 SELECT n, family, k, CASE family WHEN 'norm' THEN exp(-0.5 * power((x - m) / s, 2)) / (s * sqrt(2 * pi())) WHEN 'lognorm' THEN CASE WHEN x > 0 THEN exp(-0.5 * power((ln(CASE WHEN x > 0 THEN x END) - lm) / ls, 2)) / (x * ls * sqrt(2 * pi())) ELSE 0 END
  WHEN 'expon' THEN exp(-(x - lo) / (m - lo)) / (m - lo) ELSE 1 / (hi - lo) END AS pdf FROM (SELECT range AS k, lo + (range + 0.5) * (hi - lo) / 50 AS x, st.* FROM range(50), st),
  (VALUES {", ".join(f"('{f}')" for f in families)}) f(family) WHERE family <> 'lognorm' OR positive)
 LEFT JOIN (SELECT least(floor(({c} - lo) / ((hi - lo) / 50)), 49) AS hk, count(*) / (any_value(n) * ((any_value(hi) - any_value(lo)) / 50)) AS h FROM {table}, st GROUP BY 1) ON hk = k GROUP BY family"""


def _fits(c, table, families=_BASIC):
    st = f"""st AS (SELECT count({c}) AS n, avg({c}) AS m, stddev_pop({c}) AS s, CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi, avg(CASE WHEN {c} > 0 THEN ln(CASE WHEN {c} > 0 THEN {c} END) END) AS lm,
 stddev_pop(CASE WHEN {c} > 0 THEN ln(CASE WHEN {c} > 0 THEN {c} END) END) AS ls, min({c}) > 0 AS positive, min({c}) < 0 AS neg, skewness({c}) AS skew, kurtosis({c}) AS kurt FROM {table})"""
    return f"WITH {st}, r AS ({_fit_sql(c, table, families)}), fit AS (SELECT r.*, neg AS has_negatives, skew, kurt AS kurtosis, lo, hi FROM r, st WHERE rss = (SELECT min(rss) FROM r))"


@query("dist_fit_basic", " UNION ALL ".join(f"""(SELECT * FROM ({_fits(c, tb)} SELECT "column", n, family, round(rss, 9) AS rss, has_negatives, round(skew, 6) AS skew, round(kurtosis, 6) AS kurtosis, lo, hi FROM fit))"""
                                            for c, tb in (("value", "events"), ("l_quantity", "lineitem"), ("l_extendedprice", "lineitem"))))
def _(t):
    a = dist.fit_distributions(t.events, ["value"], _BASIC).unionByName(dist.fit_distributions(t.lineitem, ["l_quantity", "l_extendedprice"], _BASIC))
    return rounded(a.drop("params"), 6, rss=9)


@query("dist_fingerprint", " UNION ALL ".join(f"""SELECT '{c}' AS "column", count({c}) AS n, min({c}) < 0 AS has_negatives, round(skewness({c}), 6) AS skew, round(kurtosis({c}), 5) AS kurtosis FROM {tb}"""
                                              for c, tb in (("value", "events"), ("c_acctbal", "customer"), ("n_chars", "documents"))))
def _(t):
    return rounded(dist.fingerprint(t.events, ["value"]).unionByName(dist.fingerprint(t.customer, ["c_acctbal"])).unionByName(
        dist.fingerprint(t.documents, ["n_chars"])), 6, kurtosis=5)


@query("dist_summary", f"""{_fits('value', 'events')} SELECT 1 AS n_columns, CASE WHEN abs(skew) > 1 THEN 'value' ELSE '' END AS skewed_columns, CASE WHEN abs(kurtosis) > 3 THEN 'value' ELSE '' END AS heavy_tailed_columns,
 concat(family, ':1') AS families FROM fit""")
def _(t):
    return dist.fit_summary(dist.fit_distributions(t.events, ["value"], _BASIC)).withColumn("n_columns", F.col("n_columns").cast("int"))


@query("dist_advice", f"""{_fits('value', 'events')} SELECT "column", 'time_between_events' AS advice FROM fit WHERE family = 'expon' UNION ALL SELECT "column", 'log_transform' FROM fit WHERE family = 'lognorm'
 UNION ALL SELECT "column", 'power_transform' FROM fit WHERE abs(skew) > 2""")
def _(t):
    return dist.fit_advice(dist.fit_distributions(t.events, ["value"], _BASIC))


@query("dist_curve", f"""{_fits('value', 'events')} SELECT round(lo + range * (hi - lo) / 199, 6) AS x, round(exp(-(range * (hi - lo) / 199) / (m - lo)) / (m - lo), 9) AS density FROM range(200), st WHERE (SELECT family FROM fit) = 'expon'""")
def _(t):
    return rounded(dist.fit_curve(dist.fit_distributions(t.events, ["value"], _BASIC), "value"), 6, density=9)


_THREE = ("lognorm", "norm", "expon")


@query("dist_lognormal", " UNION ALL ".join(f"""(SELECT * FROM ({_fits(c, tb, _THREE)} SELECT "column", family = 'lognorm' AND lo > 0 AS lognormal FROM fit))"""
                                            for c, tb in (("value", "events"), ("n_chars", "documents"), ("l_quantity", "lineitem"))))
def _(t):
    return dist.is_lognormal(t.events, ["value"]).unionByName(dist.is_lognormal(t.documents, ["n_chars"])).unionByName(
        dist.is_lognormal(t.lineitem, ["l_quantity"]))
