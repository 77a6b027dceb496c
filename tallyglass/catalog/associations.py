"""Correlation, contingency and mutual information."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import association as assoc
from .registry import query, rounded
from .tables import HOLED, holed


# Priced line items: net and charge follow the price, so some pairs are strong.
def priced(t):
    return t.lineitem.selectExpr("l_quantity", "l_extendedprice", "l_discount", "l_extendedprice * (1 - l_discount) AS net",
                                 "l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge")


PRICED = """p AS (SELECT l_quantity, l_extendedprice, l_discount, l_extendedprice * (1 - l_discount) AS net,
 l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge FROM lineitem)"""
_COLS = ["l_quantity", "l_extendedprice", "l_discount", "net", "charge"]
_PAIRS = [(a, b) for i, a in enumerate(_COLS) for b in _COLS[i + 1:]]


def _all_pairs(expr, pairs=_PAIRS, table="p"):
    return " UNION ALL ".join(f"SELECT '{a}' AS col_a, '{b}' AS col_b, {expr.format(a=a, b=b)} FROM {table}" for a, b in pairs)


# Events with gaps, so pairs are complete on different rows.
_EVENT_PAIRS = [("user_id", "value"), ("user_id", "late"), ("value", "late")]
_GAPS = f"e AS (SELECT user_id, value, CASE WHEN user_id < 20 THEN NULL ELSE ln(1 + value) * user_id END AS late FROM {HOLED})"


def gaps(t):
    return holed(t).select("user_id", "value", F.expr("CASE WHEN user_id < 20 THEN NULL ELSE ln(1 + value) * user_id END").alias("late"))


@query("corr_pearson", f"WITH {PRICED}, {_GAPS} " + _all_pairs("round(corr({a}, {b}), 3) AS r") + " UNION ALL " + _all_pairs(
    "round(corr({a}, {b}), 3) AS r", _EVENT_PAIRS, "e"))
def _(t):
    return rounded(assoc.corr_matrix(priced(t)).unionByName(assoc.corr_matrix(gaps(t))), 3)


def _rank_sql(a, b, table):
    return f"""SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr(ra, rb), 3) AS r FROM (SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0 AS ra,
 rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2.0 AS rb FROM {table} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"""


@query("corr_spearman", f"WITH {PRICED}, {_GAPS} " + " UNION ALL ".join(
    [_rank_sql(a, b, "p") for a, b in _PAIRS] + [_rank_sql(a, b, "e") for a, b in _EVENT_PAIRS]))
def _(t):
    return rounded(assoc.corr_matrix(priced(t), "spearman").unionByName(assoc.corr_matrix(gaps(t), "spearman")), 3)


@query("corr_kendall", """WITH d AS (SELECT p_size AS x, floor(p_retailprice / 50) AS y FROM part), c AS (SELECT x, y, count(*) AS w FROM d GROUP BY 1, 2),
 s AS (SELECT sum(a.w * b.w * sign(a.x - b.x) * sign(a.y - b.y)) / 2 AS s FROM c a, c b),
 tx AS (SELECT sum(n * (n - 1) / 2) AS t FROM (SELECT count(*) AS n FROM d GROUP BY x)), ty AS (SELECT sum(n * (n - 1) / 2) AS t FROM (SELECT count(*) AS n FROM d GROUP BY y)),
 n AS (SELECT count(*) * (count(*) - 1) / 2 AS n0 FROM d)
 SELECT 'p_size' AS col_a, 'price_band' AS col_b, round(s / sqrt((n0 - tx.t) * (n0 - ty.t)), 3) AS r FROM s, tx, ty, n""")
def _(t):
    return rounded(assoc.corr_matrix(t.part.select("p_size", F.floor(F.col("p_retailprice") / 50).alias("price_band")), "kendall"), 3)


@query("corr_kendall_wide", """WITH s AS (SELECT CAST(sum(CASE WHEN a.value < b.value THEN 1 WHEN a.value > b.value THEN -1 ELSE 0 END) AS DOUBLE) AS s FROM events a, events b WHERE a.user_id < b.user_id),
 tx AS (SELECT sum(n * (n - 1) / 2) AS t FROM (SELECT count(*) AS n FROM events GROUP BY user_id)), ty AS (SELECT sum(n * (n - 1) / 2) AS t FROM (SELECT count(*) AS n FROM events GROUP BY value)),
 n AS (SELECT count(*) AS n, count(*) * (count(*) - 1) / 2 AS n0 FROM events)
 SELECT 'user_id' AS col_a, 'value' AS col_b, n, round(s / sqrt((n0 - tx.t) * (n0 - ty.t)), 6) AS r FROM s, tx, ty, n""")
def _(t):
    return rounded(assoc.kendall(t.events, ["user_id", "value"], block_rows=2_000), 6)


@query("corr_top", f"WITH {PRICED}, r AS ({_all_pairs('count(*) AS n, corr({a}, {b}) AS r')}) SELECT col_a, col_b, n, round(r, 6) AS r FROM r ORDER BY abs(r) DESC LIMIT 5")
def _(t):
    return rounded(assoc.top_pairs(priced(t), 5))


@query("corr_leakage", f"WITH {PRICED}, r AS ({_all_pairs('count(*) AS n, corr({a}, {b}) AS r')}) SELECT col_a, col_b, n, round(r, 6) AS r FROM r WHERE abs(r) > 0.99")
def _(t):
    return rounded(assoc.leakage(priced(t)))


@query("corr_multicollinear", f"WITH {PRICED}, r AS ({_all_pairs('count(*) AS n, corr({a}, {b}) AS r')}) SELECT col_a, col_b, n, round(r, 6) AS r FROM r WHERE abs(r) >= 0.8")
def _(t):
    return rounded(assoc.strong_pairs(priced(t)))


_HALF = "l_shipdate < TIMESTAMP '1998-06-01'"


@query("corr_diff", f"""WITH h AS (SELECT *, l_extendedprice * (1 - l_discount) AS net, {_HALF} AS early FROM lineitem), r AS (""" + " UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, corr({a}, {b}) FILTER (WHERE early) AS r_real, corr({a}, {b}) FILTER (WHERE NOT early) AS r_synth FROM h"
    for a, b in (("l_quantity", "l_extendedprice"), ("l_quantity", "net"), ("l_extendedprice", "net"))) +
    ") SELECT col_a, col_b, round(r_real, 6) AS r_real, round(r_synth, 6) AS r_synth, round(abs(r_real - r_synth), 6) AS diff FROM r")
def _(t):
    h = t.lineitem.withColumn("net", F.expr("l_extendedprice * (1 - l_discount)"))
    return rounded(assoc.corr_diff(h.filter(_HALF.replace("TIMESTAMP", "TIMESTAMP_NTZ")), h.filter("NOT " + _HALF.replace("TIMESTAMP", "TIMESTAMP_NTZ")),
                                   ["l_quantity", "l_extendedprice", "net"]))


def _cramer_sql(a, b):
    return f"""SELECT '{a}' AS col_a, '{b}' AS col_b, round(chi2, 4) AS chi2, round(sqrt(greatest(0, chi2 / n - (k - 1) * (r - 1) / (n - 1))
 / least(k - power(k - 1, 2) / (n - 1) - 1, r - power(r - 1, 2) / (n - 1) - 1)), 6) AS v FROM (
 SELECT sum(power(abs(o - e) - CASE WHEN r = 2 AND k = 2 THEN least(0.5, abs(o - e)) ELSE 0 END, 2) / e) AS chi2, any_value(n) AS n, any_value(r) AS r, any_value(k) AS k FROM (
  SELECT coalesce(o, 0) AS o, na * nb / n AS e, n, r, k FROM (SELECT {a} AS a, CAST(count(*) AS DOUBLE) AS na FROM c WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1)
  CROSS JOIN (SELECT {b} AS b, CAST(count(*) AS DOUBLE) AS nb FROM c WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1)
  CROSS JOIN (SELECT CAST(count(*) AS DOUBLE) AS n, count(DISTINCT {a}) AS r, count(DISTINCT {b}) AS k FROM c WHERE {a} IS NOT NULL AND {b} IS NOT NULL)
  LEFT JOIN (SELECT {a} AS a2, {b} AS b2, count(*) AS o FROM c GROUP BY 1, 2) ON a = a2 AND b = b2))"""


_CATS = """c AS (SELECT CASE WHEN p_size < 5 THEN NULL ELSE p_type END AS p_type, CASE WHEN p_size < 25 THEN 'small' ELSE 'big' END AS size_band,
 CASE WHEN p_size < 20 OR p_brand = 'Brand#1' THEN 'low' ELSE 'high' END AS level, p_brand FROM part)"""
_CATCOLS = ["p_type", "size_band", "level", "p_brand"]


@query("corr_cramers_v", f"WITH {_CATS} " + " UNION ALL ".join(
    _cramer_sql(a, b) for i, a in enumerate(_CATCOLS) for b in _CATCOLS[i + 1:]))
def _(t):
    c = t.part.selectExpr("CASE WHEN p_size < 5 THEN NULL ELSE p_type END AS p_type", "CASE WHEN p_size < 25 THEN 'small' ELSE 'big' END AS size_band",
                          "CASE WHEN p_size < 20 OR p_brand = 'Brand#1' THEN 'low' ELSE 'high' END AS level", "p_brand", "p_name")
    return rounded(assoc.cramers_v(c, _CATCOLS), 6, chi2=4)


@query("corr_crosstab", """SELECT a, b, count(c) AS n FROM (SELECT DISTINCT p_brand AS a FROM part) CROSS JOIN (SELECT DISTINCT p_size AS b FROM part)
 LEFT JOIN (SELECT p_brand, p_size, 1 AS c FROM part) ON a = p_brand AND b = p_size GROUP BY 1, 2""")
def _(t):
    return assoc.crosstab(t.part, "p_brand", "p_size")


def _mi_case(c):
    edges = [f"quantile_cont({c}, {i / 10!r})" for i in range(11)]
    return f"(SELECT list_sort(list_distinct([{', '.join(edges)}])) AS e FROM m)"


_MI_COLS = ["user_id", "value", "bend"]
_MI_PAIRS = [("user_id", "value"), ("user_id", "bend"), ("value", "bend")]
# A parabola: strong dependence, almost no linear correlation.
_MI = "m AS (SELECT user_id, value, power(user_id - 74.5, 2) AS bend FROM events)"
_MI_SQL = f"WITH {_MI}, " + ", ".join(f"q_{c} AS {_mi_case(c)}" for c in _MI_COLS) + ", b AS (SELECT " + ", ".join(
    f"greatest(len(list_filter(q_{c}.e, lambda x: x < m.{c})) - 1, 0) AS {c}" for c in _MI_COLS) + " FROM m, " + ", ".join(f"q_{c}" for c in _MI_COLS) + "), mi AS (" + " UNION ALL ".join(
    f"""SELECT '{a}' AS col_a, '{b}' AS col_b, sum(o / n * ln(o * n / (na * nb))) AS mi FROM (SELECT CAST(o AS DOUBLE) AS o, CAST(sum(o) OVER (PARTITION BY {a}) AS DOUBLE) AS na,
 CAST(sum(o) OVER (PARTITION BY {b}) AS DOUBLE) AS nb, CAST(sum(o) OVER () AS DOUBLE) AS n FROM (SELECT {a}, {b}, count(*) AS o FROM b GROUP BY 1, 2))""" for a, b in _MI_PAIRS) + ")"


def bent(t):
    return t.events.selectExpr("user_id", "value", "power(user_id - 74.5, 2) AS bend")


@query("corr_mi", _MI_SQL + " SELECT col_a, col_b, round(mi / (SELECT max(mi) FROM mi), 6) AS mi FROM mi")
def _(t):
    return rounded(assoc.mi_matrix(bent(t)))


@query("corr_mi_raw", _MI_SQL + " SELECT col_a, col_b, round(mi, 6) AS mi FROM mi")
def _(t):
    return rounded(assoc.mi_matrix(bent(t), normalize=False))


@query("corr_mi_top", _MI_SQL + " SELECT col_a, col_b, round(mi / (SELECT max(mi) FROM mi), 6) AS mi FROM mi ORDER BY mi DESC LIMIT 2")
def _(t):
    return rounded(assoc.top_mi(bent(t), 2))


@query("corr_nonlinear", _MI_SQL + ", r AS (" + " UNION ALL ".join(f"SELECT '{a}' AS col_a, '{b}' AS col_b, abs(corr({a}, {b})) AS abs_r FROM m" for a, b in _MI_PAIRS) + """), j AS (
 SELECT col_a, col_b, mi / (SELECT max(mi) FROM mi) AS mi, abs_r FROM mi JOIN r USING (col_a, col_b))
 SELECT col_a, col_b, round(mi, 6) AS mi, round(abs_r, 6) AS abs_r, round(mi - abs_r, 6) AS gap FROM j WHERE mi > 0.3 AND abs_r < 0.3""")
def _(t):
    return rounded(assoc.nonlinear_pairs(bent(t)))


BENT = ["user_id", "value", "bend"]


def _near_sql(i, j):
    """Rows of a pair with the third smallest of the larger axis distances to all others."""
    return f"""SELECT '{BENT[i]}' AS col_a, '{BENT[j]}' AS col_b, a.i, a.x{i} AS u, a.x{j} AS v, min(greatest(abs(a.x{i} - b.x{i}), abs(a.x{j} - b.x{j})), 3)[3] AS eps
 FROM g a JOIN g b ON a.i <> b.i GROUP BY ALL"""


def _axis_sql(v):
    return f"count(*) OVER (PARTITION BY col_a, col_b ORDER BY {v} RANGE BETWEEN greatest(eps - 1, 0) PRECEDING AND greatest(eps - 1, 0) FOLLOWING) - 1"


#: Every distance of every pair; digamma from harmonic numbers.
_KNN_SQL = f"""WITH e AS (SELECT user_id::DOUBLE AS c0, value AS c1, power(user_id - 74.5, 2) AS c2 FROM events),
s AS (SELECT {", ".join(f"avg(c{i}) AS m{i}, stddev_pop(c{i}) AS s{i}" for i in range(3))} FROM e),
g AS (SELECT row_number() OVER () AS i, {", ".join(f"round((c{i} - m{i}) / s{i} * 1073741824)::BIGINT AS x{i}" for i in range(3))} FROM e, s),
k AS ({" UNION ALL ".join(_near_sql(i, j) for i, j in ((0, 1), (0, 2), (1, 2)))}),
r AS (SELECT col_a, col_b, eps, {_axis_sql("u")} AS nu, {_axis_sql("v")} AS nv FROM k),
h AS (SELECT range AS i, sum(CASE WHEN range = 0 THEN -0.57721566490153286 ELSE 1.0 / range END) OVER (ORDER BY range) AS psi FROM range(0, (SELECT count(*) FROM events))),
m AS (SELECT col_a, col_b, greatest(0, (SELECT psi FROM h WHERE i = 2) + (SELECT max(psi) FROM h) - avg(a.psi + b.psi)) AS mi
 FROM r JOIN h a ON a.i = CASE WHEN eps = 0 THEN 0 ELSE nu END JOIN h b ON b.i = CASE WHEN eps = 0 THEN 0 ELSE nv END GROUP BY col_a, col_b)
SELECT col_a, col_b, round(mi / (SELECT max(mi) FROM m), 6) AS mi FROM m"""


@query("corr_mi_knn", _KNN_SQL)
def _(t):
    return rounded(assoc.mi_matrix(bent(t), method="knn"))
