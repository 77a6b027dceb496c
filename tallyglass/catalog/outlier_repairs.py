"""Outlier detection and remediation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import outliers as out, remediation as rem
from .registry import query, rounded
from .tables import HOLED, holed

_E = f"WITH e AS {HOLED} "
_Z = "abs((value - (SELECT avg(value) FROM e)) / (SELECT stddev(value) FROM e)) > 3"
_FENCE = "f AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM e)"
_IQR = "(value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1))"
_MAD = "abs(0.6745 * (value - (SELECT median(value) FROM e)) / (SELECT mad(value) FROM e)) > 3.5"


@query("out_zscore", _E + f"SELECT event_id, value, coalesce({_Z}, false) AS value_outlier FROM e")
def _(t):
    return out.zscore(holed(t).select("event_id", "value"), ["value"])


@query("out_iqr", _E + f", {_FENCE} SELECT event_id, value, coalesce({_IQR}, false) AS value_outlier FROM e, f")
def _(t):
    return out.iqr(holed(t).select("event_id", "value"), ["value"])


@query("out_mad", _E + f"SELECT event_id, value, coalesce({_MAD}, false) AS value_outlier FROM e")
def _(t):
    return out.mad(holed(t).select("event_id", "value"), ["value"])


@query("out_all", _E + ", " + _FENCE + "".join(
    f""" {'UNION ALL' if i else ''} SELECT '{m}' AS method, 'value' AS "column", count(value) AS n, count(CASE WHEN {c} THEN 1 END) AS n_outliers,
 round(count(CASE WHEN {c} THEN 1 END) * 100.0 / count(value), 6) AS pct, CAST(NULL AS VARCHAR) AS error FROM e, f"""
    for i, (m, c) in enumerate((("zscore", _Z), ("iqr", _IQR), ("mad", _MAD)))))
def _(t):
    return rounded(out.detect_all(holed(t), ["value"], ["zscore", "iqr", "mad"])[1])


@query("out_all_methods", _E + ", " + _FENCE + "".join(
    f""" {'UNION ALL' if i else ''} SELECT '{m}' AS method, count(value) AS n, count(CASE WHEN {c} THEN 1 END) AS n_outliers FROM e, f"""
    for i, (m, c) in enumerate((("zscore", _Z), ("iqr", _IQR), ("mad", _MAD))))
    # by definition: the rows above the (1 - contamination) quantile of the scores, of the complete rows
    + " UNION ALL SELECT 'iforest', count(value), 0 FROM e UNION ALL SELECT 'lof', count(value), 0 FROM e")
def _(t):
    got = out.detect_all(holed(t), ["value"], key=["event_id"])[1]
    few = F.col("n_outliers").between(1, F.ceil(F.col("n") * 0.1))
    return got.select("method", "n", F.when(F.col("method").isin("iforest", "lof") & few, F.lit(0).cast("long")).otherwise(F.col("n_outliers")).alias("n_outliers"))


@query("out_all_rows", _E + f""", {_FENCE} SELECT event_id, coalesce({_Z}, false) AS value_zscore, coalesce({_IQR}, false) AS value_iqr,
 coalesce({_MAD}, false) AS value_mad FROM e, f""")
def _(t):
    return out.detect_all(holed(t).select("event_id", "value"), ["value"], ["zscore", "iqr", "mad"])[0].drop("value")


@query("out_drop", _E + f"SELECT event_id, value FROM e WHERE NOT coalesce({_Z}, false)")
def _(t):
    return out.drop_outliers(holed(t).select("event_id", "value"), ["value"])


@query("out_cooks", """WITH m AS (SELECT regr_slope(o_totalprice, o_custkey) AS b, regr_intercept(o_totalprice, o_custkey) AS a,
 avg(o_custkey) AS mx, regr_sxx(o_totalprice, o_custkey) AS sxx, count(*) AS n FROM orders),
 r AS (SELECT o_orderkey, o_totalprice - (a + b * o_custkey) AS e, least(1.0 / n + (o_custkey - mx) * (o_custkey - mx) / sxx, 0.9999) AS h, n
  FROM orders, m), s AS (SELECT sum(e * e) / (any_value(n) - 2) AS mse FROM r)
 SELECT o_orderkey, round(h, 9) AS leverage, round(e * e / greatest(mse * (1 - h), 1e-10) * h / (1 - h), 9) AS cooks_d,
 e * e / greatest(mse * (1 - h), 1e-10) * h / (1 - h) > 4.0 / n AS cooks_outlier FROM r, s""")
def _(t):
    got = out.cooks(t.orders, "o_totalprice", ["o_custkey"])
    return rounded(got.select("o_orderkey", "leverage", "cooks_d", "cooks_outlier"), 9)


@query("out_cooks_two", """WITH d AS (SELECT event_id, value AS y, CAST(user_id AS DOUBLE) AS x1, ln(1 + value) AS x2 FROM events),
 m AS (SELECT avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, covar_pop(x1, x1) AS a, covar_pop(x1, x2) AS b, covar_pop(x2, x2) AS c,
  covar_pop(x1, y) AS u, covar_pop(x2, y) AS v, count(*) AS n FROM d),
 k AS (SELECT *, (u * c - v * b) / (a * c - b * b) AS b1, (v * a - u * b) / (a * c - b * b) AS b2 FROM m),
 r AS (SELECT event_id, n, y - my - b1 * (x1 - m1) - b2 * (x2 - m2) AS e, 1.0 / n + (c * (x1 - m1) * (x1 - m1) - 2 * b * (x1 - m1) * (x2 - m2)
  + a * (x2 - m2) * (x2 - m2)) / (n * (a * c - b * b)) AS h FROM d, k), s AS (SELECT sum(e * e) / (any_value(n) - 3) AS mse FROM r)
 SELECT event_id, round(h, 8) AS leverage, round(e * e / (mse * (1 - h)) / 2 * h / (1 - h), 8) AS cooks_d FROM r, s""")
def _(t):
    d = t.events.select("event_id", "value", "user_id", F.log1p("value").alias("log_value"))
    return rounded(out.cooks(d, "value", ["user_id", "log_value"]).select("event_id", "leverage", "cooks_d"), 8)


_ORDERED = "o AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM e WHERE value IS NOT NULL)"
_WINSOR = f"""{_ORDERED}, b AS (SELECT (SELECT value FROM o WHERE i = CAST(floor(0.05 * n) AS BIGINT)) AS lo,
 (SELECT value FROM o WHERE i = n - 1 - CAST(floor(0.05 * n) AS BIGINT)) AS hi)"""


@query("rem_winsorize", _E + f", {_WINSOR} SELECT event_id, CASE WHEN value IS NULL THEN NULL ELSE greatest(least(value, hi), lo) END AS value FROM e, b")
def _(t):
    return rem.winsorize(holed(t).select("event_id", "value"), ["value"])[0]


@query("rem_stats", _E + f""", {_WINSOR}, {_FENCE}, c AS (SELECT 'winsorize' AS action, lo, hi FROM b
 UNION ALL SELECT 'iqr', q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1) FROM f
 UNION ALL SELECT 'percentile', quantile_cont(value, 0.01), quantile_cont(value, 0.99) FROM e)
 SELECT action, 'value' AS "column", round(lo, 6) AS lower, round(hi, 6) AS upper, count(CASE WHEN value < lo OR value > hi THEN 1 END) AS n_changed,
 round(count(CASE WHEN value < lo OR value > hi THEN 1 END) * 100.0 / count(value), 6) AS pct_changed FROM c, e GROUP BY action, lo, hi""")
def _(t):
    e = holed(t).select("event_id", "value")
    logs = [rem.winsorize(e, ["value"])[1], rem.cap(e, ["value"])[1], rem.cap(e, ["value"], "percentile")[1]]
    return rounded(logs[0].unionByName(logs[1]).unionByName(logs[2]))


def _clamped(lo, hi):
    return f"CASE WHEN value IS NULL THEN NULL ELSE round(greatest(least(value, {hi}), {lo}), 6) END"


@query("rem_cap_iqr", _E + f", {_FENCE} SELECT event_id, {_clamped('q1 - 1.5 * (q3 - q1)', 'q3 + 1.5 * (q3 - q1)')} AS value FROM e, f")
def _(t):
    return rounded(rem.cap(holed(t).select("event_id", "value"), ["value"])[0])


@query("rem_cap_pct", _E + f""", p AS (SELECT quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM e)
 SELECT event_id, {_clamped('lo', 'hi')} AS value FROM e, p""")
def _(t):
    return rounded(rem.cap(holed(t).select("event_id", "value"), ["value"], "percentile")[0])


def _two(t):
    d = t.documents.select("doc_id", "n_chars", F.length(F.regexp_replace("text", "[^0-9]", "")).alias("n_text"))
    return out.zscore(d, ["n_chars", "n_text"])


_TWO = """WITH d AS (SELECT doc_id, n_chars, length(regexp_replace(text, '[^0-9]', '', 'g')) AS n_text FROM documents),
 z AS (SELECT doc_id, n_chars, abs((n_chars - (SELECT avg(n_chars) FROM d)) / (SELECT stddev(n_chars) FROM d)) > 3 AS a,
  abs((n_text - (SELECT avg(n_text) FROM d)) / (SELECT stddev(n_text) FROM d)) > 3 AS b FROM d)"""


@query("rem_remove_union", _TWO + " SELECT doc_id, n_chars FROM z WHERE NOT (a OR b)")
def _(t):
    return rem.remove(_two(t), ["n_chars_outlier", "n_text_outlier"]).select("doc_id", "n_chars")


@query("rem_remove_intersection", _TWO + " SELECT doc_id, n_chars FROM z WHERE NOT (a AND b)")
def _(t):
    return rem.remove(_two(t), ["n_chars_outlier", "n_text_outlier"], "intersection").select("doc_id", "n_chars")


@query("rem_remove_keys", _E + f"SELECT event_id, user_id FROM events WHERE event_id NOT IN (SELECT event_id FROM e WHERE {_Z})")
def _(t):
    keys = out.zscore(holed(t), ["value"]).filter("value_outlier").select("event_id")
    return rem.remove_keys(t.events.select("event_id", "user_id"), keys)


def _cuts(n):
    return ", ".join(f"quantile_cont(value, {i / n!r}) AS e{i}" for i in range(n + 1))


def _qcase(n, label=lambda i: str(i)):
    return "CASE WHEN value IS NULL THEN NULL " + " ".join(f"WHEN value <= e{i + 1} THEN {label(i)}" for i in range(n)) + " END"


@query("rem_bin_quantile", _E + f", c AS (SELECT {_cuts(5)} FROM e) SELECT event_id, {_qcase(5)} AS value_binned FROM e, c")
def _(t):
    return rem.bin(holed(t), "value", "quantile").select("event_id", "value_binned")


@query("rem_bin_uniform", _E + """, c AS (SELECT min(value) AS lo, max(value) AS hi FROM e)
 SELECT event_id, CASE WHEN value IS NULL THEN NULL WHEN value <= lo + (hi - lo) * 1 / 5 THEN 'a' WHEN value <= lo + (hi - lo) * 2 / 5 THEN 'b'
 WHEN value <= lo + (hi - lo) * 3 / 5 THEN 'c' WHEN value <= lo + (hi - lo) * 4 / 5 THEN 'd' ELSE 'e' END AS value_binned FROM e, c""")
def _(t):
    return rem.bin(holed(t), "value", "uniform", labels=list("abcde")).select("event_id", "value_binned")


@query("rem_bin_kmeans")
def _(t):
    binned = rem.bin(holed(t), "value", "kmeans")
    return rounded(binned.groupBy("value_binned").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")))


@query("rem_log", "SELECT s_suppkey, round(ln(s_acctbal + (SELECT CASE WHEN min(s_acctbal) <= 0 THEN 1 - min(s_acctbal) ELSE 0 END FROM supplier) + 1), 6) AS s_acctbal_log FROM supplier")
def _(t):
    return rounded(rem.transform(t.supplier, "s_acctbal", "log")[0].select("s_suppkey", "s_acctbal_log"))


@query("rem_sqrt", "SELECT s_suppkey, round(sqrt(s_acctbal + (SELECT CASE WHEN min(s_acctbal) < 0 THEN -min(s_acctbal) ELSE 0 END FROM supplier)), 5) AS s_acctbal_sqrt FROM supplier")
def _(t):
    return rounded(rem.transform(t.supplier, "s_acctbal", "sqrt")[0].select("s_suppkey", "s_acctbal_sqrt"), 5)


@query("rem_zscore", _E + "SELECT event_id, round((value - (SELECT avg(value) FROM e)) / (SELECT stddev(value) FROM e), 6) AS value_zscore FROM e")
def _(t):
    return rounded(rem.transform(holed(t), "value", "zscore")[0].select("event_id", "value_zscore"))


def _grid(table, family, jacobian, rounds=4, points=15):
    """The same likelihood grid search in SQL (15 points per pass, range -2..2); the last best is ``best``."""
    parts, step = [], 4.0 / (points - 1)
    for k in range(rounds):
        base = f"SELECT -2.0 + range * {step!r} AS g FROM range({points})" if k == 0 else (
            f"SELECT (SELECT best FROM b{k - 1}) + (range - {points // 2}) * {step!r} AS g FROM range({points})")
        parts.append(f"""g{k} AS (SELECT CASE WHEN abs(g) < 1e-12 THEN 0.0 ELSE CAST(g AS DOUBLE) END AS g FROM ({base})),
 l{k} AS (SELECT g, -0.5 * count(x) * ln(var_pop({family})) + (g - 1) * sum({jacobian}) AS ll FROM {table}, g{k} GROUP BY g),
 b{k} AS (SELECT arg_max(g, ll) AS best FROM l{k})""")
        step = 2 * step / (points - 1)
    return ", ".join(parts) + f", bl AS (SELECT best FROM b{rounds - 1})"


_BOXCOX = "CASE WHEN g = 0 THEN ln(x) ELSE (power(x, g) - 1) / CASE WHEN g = 0 THEN 1 ELSE g END END"


@query("rem_boxcox", f"""WITH d AS (SELECT event_id, value, value + (SELECT CASE WHEN min(value) <= 0 THEN 1 - min(value) ELSE 0 END FROM events) AS x FROM events),
 {_grid('d', _BOXCOX, 'ln(x)')}
 SELECT event_id, round((SELECT best FROM bl), 6) AS lambda, round((power(x, best) - 1) / best, 5) AS value_boxcox FROM d, bl""")
def _(t):
    got, fit = rem.transform(t.events, "value", "boxcox")
    return rounded(got.select("event_id", F.lit(fit["lambda"]).alias("lambda"), "value_boxcox"), 5, **{"lambda": 6})


#: Every pair of cuts of a column of few values, by the sum of squares within.
_CUTS = """WITH v AS (SELECT l_quantity AS v, count(*) AS w FROM lineitem GROUP BY 1), c AS (SELECT a.v AS a, b.v AS b FROM v a, v b WHERE a.v < b.v AND b.v < (SELECT max(v) FROM v)),
 g AS (SELECT a, b, CASE WHEN v <= a THEN 0 WHEN v <= b THEN 1 ELSE 2 END AS bin, sum(w) AS n, sum(w * v) AS s, sum(w * v * v) AS t FROM c, v GROUP BY ALL),
 best AS (SELECT a, b FROM g GROUP BY a, b ORDER BY sum(t - s * s / n), a, b LIMIT 1)"""


@query("rem_bin_kmeans_small", _CUTS + """ SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN l_quantity <= a THEN 0 WHEN l_quantity <= b THEN 1 ELSE 2 END AS l_quantity_binned FROM lineitem, best""")
def _(t):
    return rem.bin(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity"), "l_quantity", "kmeans", 3)
