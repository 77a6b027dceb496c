"""Drift tests and two-table comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import drift as dr
from .registry import query, rounded


# Line items before and after a date; the later prices are raised by 30 %.
_CUT = "TIMESTAMP '1998-06-01'"
_COLS = ("l_quantity, l_extendedprice * {f} AS l_extendedprice, l_discount, l_returnflag, "
         "CASE WHEN l_quantity < 4 THEN NULL ELSE l_linestatus END AS l_linestatus")


def halves(t):
    cut = _CUT.replace("TIMESTAMP", "TIMESTAMP_NTZ")
    def side(cond, f):
        return t.lineitem.filter(cond).selectExpr(*[c.strip() for c in (
            "l_quantity", f"l_extendedprice * {f} AS l_extendedprice", "l_discount", "l_returnflag",
            "CASE WHEN l_quantity < 4 THEN NULL ELSE l_linestatus END AS l_linestatus")])
    return side(f"l_shipdate < {cut}", "1"), side(f"l_shipdate >= {cut}", "1.3D")


SIDES = f"""a AS (SELECT {_COLS.format(f='1')} FROM lineitem WHERE l_shipdate < {_CUT}),
 b AS (SELECT {_COLS.format(f='CAST(1.3 AS DOUBLE)')} FROM lineitem WHERE l_shipdate >= {_CUT})"""
NUMERIC = ("l_quantity", "l_extendedprice", "l_discount")
TEXTS = ("l_returnflag", "l_linestatus")


def ks_sql(c):
    return f"""SELECT '{c}' AS "column", max(abs(ca / na - cb / nb)) AS statistic, CAST(any_value(na) AS BIGINT) AS n_ref, CAST(any_value(nb) AS BIGINT) AS n_cur FROM (
 SELECT v, sum(a) OVER (ORDER BY v) AS ca, sum(b) OVER (ORDER BY v) AS cb, CAST(sum(a) OVER () AS DOUBLE) AS na, CAST(sum(b) OVER () AS DOUBLE) AS nb FROM (
  SELECT v, sum(a) AS a, sum(b) AS b FROM (SELECT {c} AS v, 1 AS a, 0 AS b FROM a WHERE {c} IS NOT NULL UNION ALL SELECT {c}, 0, 1 FROM b WHERE {c} IS NOT NULL) GROUP BY v))"""


#: Survival functions by their series: of the limit law of the distance, and of the chi-square distribution (half of the statistic, half of the degrees).
KS_P = "least(1, greatest(0, list_sum(list_transform(range(1, 1001), lambda k: 2 * power(-1, k - 1) * exp(-2 * k * k * power(statistic, 2) * (n_ref * n_cur * 1.0 / (n_ref + n_cur)))))))"
CHI_P = """CASE WHEN statistic <= 0 THEN 1 WHEN statistic > 1000 THEN 0 ELSE greatest(0, 1 - list_sum(list_transform(range(0, 1500),
 lambda k: exp(-statistic / 2 + (dof / 2 + k) * ln(statistic / 2) - lgamma(dof / 2 + k + 1))))) END"""
KS = "ks AS (" + " UNION ALL ".join(ks_sql(c) for c in NUMERIC) + ")"


@query("drift_ks", f"WITH {SIDES}, {KS}, m AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", (SELECT avg({c}) FROM a) AS ma, (SELECT avg({c}) FROM b) AS mb, (SELECT stddev({c}) FROM a) AS sa, (SELECT stddev({c}) FROM b) AS sb"
    for c in NUMERIC) + """) SELECT "column", n_ref, n_cur, round(statistic, 6) AS statistic, round(""" + KS_P + """, 5) AS p_value, statistic * sqrt(n_ref * n_cur * 1.0 / (n_ref + n_cur)) > 1.3580986 AS drift,
 round(ma, 5) AS mean_ref, round(mb, 5) AS mean_cur, round(sa, 5) AS std_ref, round(sb, 5) AS std_cur FROM ks JOIN m USING ("column")""")
def _(t):
    return rounded(dr.ks(*halves(t)), 5, statistic=6)


def chi_sql(cell, c, null=None, raw=None):
    src = "(SELECT {x} AS v, 1 AS a, 0 AS b FROM a UNION ALL SELECT {x}, 0, 1 FROM b)".format(x=cell)
    keep = "" if null else "WHERE v IS NOT NULL"
    return f"""SELECT '{c}' AS "column", sum(power(abs(o - e) - CASE WHEN k = 2 THEN least(0.5, abs(o - e)) ELSE 0 END, 2) / e) AS statistic, CAST(any_value(k) AS INTEGER) - 1 AS dof,
 CAST(any_value(na) AS BIGINT) AS n_ref, CAST(any_value(nb) AS BIGINT) AS n_cur, any_value(k) AS n_categories FROM (SELECT unnest([a, b]) AS o, unnest([(a + b) * na / (na + nb), (a + b) * nb / (na + nb)]) AS e, k, na, nb FROM (
 SELECT CAST(sum(a) AS DOUBLE) AS a, CAST(sum(b) AS DOUBLE) AS b, count(*) OVER () AS k, CAST(sum(sum(a)) OVER () AS DOUBLE) AS na, CAST(sum(sum(b)) OVER () AS DOUBLE) AS nb FROM {src} {keep} GROUP BY v))"""


_CHI = "chi AS (" + " UNION ALL ".join(chi_sql(c, c) for c in TEXTS) + ")"
# fixed values: 5 % points of the chi-square distribution at 1, 2 and 9 degrees of freedom
_CRIT = "CASE dof WHEN 1 THEN 3.841459 WHEN 2 THEN 5.991465 WHEN 9 THEN 16.918978 END"


@query("drift_chi2", f"WITH {SIDES}, {_CHI} SELECT \"column\", n_ref, n_cur, n_categories, dof, round(statistic, 6) AS statistic, round({CHI_P}, 6) AS p_value, statistic > {_CRIT} AS drift FROM chi")
def _(t):
    return rounded(dr.chi_square(*halves(t)))


def _chi_num(c):
    # the same literal bounds on both sides: bins of the reference table
    x = f"CASE WHEN {c} <= (SELECT max({c}) FROM a) AND {c} >= (SELECT min({c}) FROM a) THEN greatest(CAST(ceil(round(({c} - (SELECT min({c}) FROM a)) / ((SELECT max({c}) - min({c}) FROM a)) * 10, 9)) AS INTEGER) - 1, 0) END"
    return chi_sql(x, c)


@query("drift_chi2_num", f"WITH {SIDES}, chi AS (" + " UNION ALL ".join(_chi_num(c) for c in ("l_quantity", "l_extendedprice")) +
       f") SELECT \"column\", n_ref, n_cur, n_categories, dof, round(statistic, 4) AS statistic, round({CHI_P}, 4) AS p_value, statistic > {_CRIT} AS drift FROM chi")
def _(t):
    return rounded(dr.chi_square(*halves(t), cols=["l_quantity", "l_extendedprice"]), 4)


def _psi_sql(c):
    edges = "list_sort(list_distinct([" + ", ".join(f"quantile_cont({c}, {i / 10!r})" for i in range(11)) + "]))"
    binned = "CASE WHEN {c} < e[1] OR {c} > e[len(e)] THEN NULL ELSE greatest(len(list_filter(e, lambda x: x < {c})) - 1, 0) END".format(c=c)
    return f"""SELECT '{c}' AS "column", any_value(k) AS n_bins, sum((cp - rp) * ln(cp / rp)) AS psi FROM (SELECT greatest(a / sum(a) OVER (), 1e-10) AS rp,
 greatest(b / sum(b) OVER (), 1e-10) AS cp, k FROM (SELECT CAST(sum(a) AS DOUBLE) AS a, CAST(sum(b) AS DOUBLE) AS b, any_value(k) AS k FROM (
  SELECT {binned} AS bin, a, b, len(e) - 1 AS k FROM (SELECT {c}, 1 AS a, 0 AS b FROM a UNION ALL SELECT {c}, 0, 1 FROM b), (SELECT {edges} AS e FROM a) WHERE {c} IS NOT NULL)
 WHERE bin IS NOT NULL GROUP BY bin))"""


_PSI = "psi AS (" + " UNION ALL ".join(_psi_sql(c) for c in NUMERIC) + ")"


@query("drift_psi", f"""WITH {SIDES}, {_PSI} SELECT "column", (SELECT count(*) FROM a) AS n_ref, (SELECT count(*) FROM b) AS n_cur, CAST(n_bins AS INTEGER) AS n_bins,
 round(psi, 6) AS psi, psi >= 0.2 AS drift, CASE WHEN psi < 0.1 THEN 'none' WHEN psi < 0.2 THEN 'moderate' ELSE 'significant' END AS level FROM psi""")
def _(t):
    return rounded(dr.psi(*halves(t)))


@query("drift_all", f"""WITH {SIDES}, {KS}, {_CHI}, {_PSI} SELECT 'ks' AS method, "column", round(statistic, 6) AS statistic, round({KS_P}, 6) AS p_value, CAST(NULL AS INTEGER) AS dof, n_ref, n_cur,
 statistic * sqrt(n_ref * n_cur * 1.0 / (n_ref + n_cur)) > 1.3580986 AS drift, CAST(NULL AS VARCHAR) AS level, CAST(NULL AS VARCHAR) AS error FROM ks
 UNION ALL SELECT 'chi_square', "column", round(statistic, 6), round({CHI_P}, 6), dof, n_ref, n_cur, statistic > {_CRIT}, NULL, NULL FROM chi
 UNION ALL SELECT 'psi', "column", round(psi, 6), NULL, NULL, (SELECT count(*) FROM a), (SELECT count(*) FROM b), psi >= 0.2,
 CASE WHEN psi < 0.1 THEN 'none' WHEN psi < 0.2 THEN 'moderate' ELSE 'significant' END, NULL FROM psi""")
def _(t):
    return rounded(dr.analyze(*halves(t), methods=["ks", "chi_square", "psi"]))


@query("drift_by_method", f"""WITH {SIDES}, {KS}, {_PSI}, d AS (SELECT 'ks' AS method, "column", statistic * sqrt(n_ref * n_cur * 1.0 / (n_ref + n_cur)) > 1.3580986 AS drift FROM ks
 UNION ALL SELECT 'psi', "column", psi >= 0.2 FROM psi)
 SELECT method, count(*) AS n_columns, coalesce(string_agg(CASE WHEN drift THEN "column" END, ',' ORDER BY "column"), '') AS drifted_columns FROM d GROUP BY 1""")
def _(t):
    return dr.drifted(dr.analyze(*halves(t)))


@query("drift_classifier")
def _(t):
    return rounded(dr.drift_classifier(*halves(t)))


@query("cmp_columns", f"WITH {SIDES}, {KS} " + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", round((SELECT avg({c}) FROM a), 4) AS mean_real, round((SELECT avg({c}) FROM b), 4) AS mean_synth,
 round((SELECT stddev({c}) FROM a), 4) AS std_real, round((SELECT stddev({c}) FROM b), 4) AS std_synth, round(statistic, 4) AS ks FROM ks WHERE "column" = '{c}'""" for c in NUMERIC))
def _(t):
    return rounded(dr.compare_columns(*halves(t)), 4)


@query("cmp_drift_flags", f"WITH {SIDES}, {KS} SELECT \"column\", round(statistic, 6) AS statistic, round({KS_P}, 6) AS p_value, statistic > 0.2 AS drift FROM ks WHERE \"column\" <> 'l_quantity'")
def _(t):
    return rounded(dr.drift_flags(*halves(t), skip=["l_quantity"]))


SIMILAR = f"""WITH {SIDES}, {KS}, chi AS (""" + " UNION ALL ".join(chi_sql(f"coalesce({c}, '___NA___')", c, null=True) for c in TEXTS) + ")"


@query("cmp_similarity", SIMILAR + """ SELECT "column", 'numeric' AS type, round(statistic, 6) AS statistic, round(""" + KS_P + """, 6) AS p_value FROM ks
 UNION ALL SELECT "column", 'categorical', round(statistic, 6), round(""" + CHI_P + """, 6) FROM chi""")
def _(t):
    return rounded(dr.similarity(*halves(t)))


@query("cmp_hist", f"""WITH {SIDES}, u AS (SELECT l_extendedprice AS x, 'real' AS source FROM a UNION ALL SELECT l_extendedprice, 'synthetic' FROM b),
 r AS (SELECT min(x) AS lo, (max(x) - min(x)) / 30 AS w FROM u), s AS (SELECT source, count(*) AS size FROM u GROUP BY 1)
 SELECT bin, round(lo + bin * w, 6) AS lo, round(lo + bin * w + w, 6) AS hi, source, count(*) AS n, round(count(*) / (any_value(size) * any_value(w)), 9) AS density
 FROM (SELECT CAST(least(floor((x - lo) / w), 29) AS INTEGER) AS bin, u.source, size, lo, w FROM u JOIN s USING (source), r) GROUP BY bin, source, lo, w""")
def _(t):
    return rounded(dr.compare_hist(*halves(t), col="l_extendedprice"), 6, density=9)


@query("cmp_pairs", f"""WITH {SIDES}, u AS (SELECT l_quantity AS x, l_extendedprice AS y, 'real' AS source FROM a UNION ALL SELECT l_quantity, l_extendedprice, 'synthetic' FROM b),
 r AS (SELECT min(x) AS lx, (max(x) - min(x)) / 20 AS wx, min(y) AS ly, (max(y) - min(y)) / 20 AS wy FROM u)
 SELECT source, CAST(least(floor((x - lx) / wx), 19) AS INTEGER) AS bin_a, CAST(least(floor((y - ly) / wy), 19) AS INTEGER) AS bin_b, count(*) AS n FROM u, r GROUP BY 1, 2, 3""")
def _(t):
    return dr.compare_pairs(*halves(t), a="l_quantity", b="l_extendedprice")


def _box_sql(side, name):
    return f"""SELECT 'l_extendedprice' AS "column", count(l_extendedprice) AS n, round(q1, 5) AS q1, round(med, 5) AS median, round(q3, 5) AS q3,
 round(min(CASE WHEN l_extendedprice >= q1 - 1.5 * (q3 - q1) THEN l_extendedprice END), 5) AS whisker_lo, round(max(CASE WHEN l_extendedprice <= q3 + 1.5 * (q3 - q1) THEN l_extendedprice END), 5) AS whisker_hi,
 round(avg(l_extendedprice), 5) AS mean, round(stddev(l_extendedprice), 5) AS std, '{name}' AS source FROM {side}, (SELECT quantile_cont(l_extendedprice, 0.25) AS q1, median(l_extendedprice) AS med,
 quantile_cont(l_extendedprice, 0.75) AS q3 FROM {side}) GROUP BY q1, med, q3"""


@query("cmp_box", f"WITH {SIDES} {_box_sql('a', 'real')} UNION ALL {_box_sql('b', 'synthetic')}")
def _(t):
    return rounded(dr.compare_box(*halves(t), col="l_extendedprice"), 5)


@query("cmp_overview", f"""WITH {SIDES}, k AS (SELECT (SELECT count(*) FROM a) AS ra, (SELECT count(*) FROM b) AS rb,
 (SELECT (count(*) - count(l_linestatus)) * 100.0 / (5 * count(*)) FROM a) AS ma, (SELECT (count(*) - count(l_linestatus)) * 100.0 / (5 * count(*)) FROM b) AS mb,
 (SELECT count(*) FROM a) - (SELECT count(*) FROM (SELECT DISTINCT * FROM a)) AS da, (SELECT count(*) FROM b) - (SELECT count(*) FROM (SELECT DISTINCT * FROM b)) AS db)
 SELECT m.metric, round(CAST(m.x AS DOUBLE), 6) AS "real", round(CAST(m.y AS DOUBLE), 6) AS synthetic, m.x = m.y AS "match" FROM (
 SELECT 'rows' AS metric, ra AS x, rb AS y FROM k UNION ALL SELECT 'columns', 5, 5 UNION ALL SELECT 'pct_missing', ma, mb FROM k UNION ALL SELECT 'numeric_columns', 3, 3
 UNION ALL SELECT 'categorical_columns', 2, 2 UNION ALL SELECT 'duplicate_rows', da, db FROM k) m""")
def _(t):
    return rounded(dr.overview(*halves(t)))
