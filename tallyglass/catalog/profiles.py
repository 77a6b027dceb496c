"""Profiles, histograms and distribution shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile as prof
from .registry import query, rounded
from .tables import HOLED, holed


def _col(name, text=None, table="events", dtype="double"):
    text = text or name
    return f"""SELECT '{name}' AS "column", '{dtype}' AS dtype, count(*) AS n_rows, count(*) - count({name}) AS n_missing,
 round((count(*) - count({name})) * 100.0 / count(*), 4) AS pct_missing, count(DISTINCT {name}) AS n_unique,
 (SELECT string_agg(v, ' | ' ORDER BY v) FROM (SELECT DISTINCT CAST({name} AS VARCHAR) AS v FROM {table} WHERE {name} IS NOT NULL
   ORDER BY v LIMIT 5)) AS samples FROM {table}"""


_EV = f"WITH e AS {HOLED} "
_PROFILE_COLUMNS = _EV + " UNION ALL ".join(
    _col(c, table="e", dtype=d) for c, d in (("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"), ("event_type", "string"), ("value", "double")))


@query("prof_columns", _PROFILE_COLUMNS)
def _(t):
    return prof.profile_columns(holed(t))


@query("prof_columns_wide", " UNION ALL ".join(
    _col(c, table="lineitem", dtype=d) for c, d in (
        ("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"), ("l_linenumber", "int"), ("l_quantity", "double"),
        ("l_extendedprice", "double"), ("l_discount", "double"), ("l_tax", "double"), ("l_returnflag", "string"), ("l_linestatus", "string"),
        ("l_shipdate", "timestamp_ntz"))))
def _(t):
    return prof.profile_columns(t.lineitem)


def _numeric(col, table):
    return f"""SELECT '{col}' AS "column", count({col}) AS n, CAST(min({col}) AS DOUBLE) AS min, CAST(max({col}) AS DOUBLE) AS max,
 round(avg({col}), 5) AS mean, round(stddev_pop({col}), 5) AS std, round(skewness({col}), 5) AS skew,
 round(kurtosis({col}), 5) AS kurtosis FROM {table}"""


@query("prof_numeric", _EV + " UNION ALL ".join(
    [_numeric("value", "e")] + [_numeric(c, "lineitem") for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")]))
def _(t):
    a = prof.profile_numeric(holed(t), ["value"])
    b = prof.profile_numeric(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return rounded(a.unionByName(b), 5)


def _z(col, table):
    return f"""SELECT '{col}' AS "column", count(CASE WHEN abs({col} - m) > 3 * s THEN 1 END) AS n_outliers,
 round(count(CASE WHEN abs({col} - m) > 3 * s THEN 1 END) * 100.0 / count(*), 6) AS pct_outliers
 FROM {table}, (SELECT avg({col}) AS m, stddev_pop({col}) AS s FROM {table})"""


@query("prof_outliers", _EV + _z("value", "e") + " UNION ALL " + _z("n_chars", "documents"))
def _(t):
    return rounded(prof.profile_outliers(holed(t), ["value"]).unionByName(prof.profile_outliers(t.documents, ["n_chars"])))


def _cat(col, table):
    return f"""SELECT '{col}' AS "column", count(*) AS n_unique, (SELECT {col} FROM (SELECT {col}, count(*) AS n FROM {table}
 WHERE {col} IS NOT NULL GROUP BY 1) ORDER BY n DESC, {col} LIMIT 1) AS most_common, CAST(max(n) AS BIGINT) AS most_common_n,
 (SELECT {col} FROM (SELECT {col}, count(*) AS n FROM {table} WHERE {col} IS NOT NULL GROUP BY 1) ORDER BY n, {col} LIMIT 1)
 AS least_common, CAST(min(n) AS BIGINT) AS least_common_n, count(CASE WHEN n < 5 THEN 1 END) AS n_rare
 FROM (SELECT {col}, count(*) AS n FROM {table} WHERE {col} IS NOT NULL GROUP BY 1)"""


@query("prof_categorical", _EV + _cat("event_type", "e") + " UNION ALL " + " UNION ALL ".join(
    _cat(c, "part") for c in ("p_name", "p_brand", "p_type")))
def _(t):
    return prof.profile_categorical(holed(t)).unionByName(prof.profile_categorical(t.part))


@query("prof_rare", """SELECT 'text' AS "column", text AS value, count(*) AS n FROM conversations GROUP BY text HAVING count(*) < 5
 UNION ALL SELECT 'role', role, count(*) FROM conversations GROUP BY role HAVING count(*) < 5""")
def _(t):
    return prof.rare_values(t.conversations)


@query("prof_summary", _EV + """SELECT count(*) AS n_rows, 5 AS n_columns,
 CAST(count(*) * 2 - count(event_type) - count(value) AS BIGINT) AS missing_cells, 'event_type,value' AS columns_with_missing,
 'kind' AS constant_columns, 'value' AS columns_high_missing FROM
 (SELECT event_type, CASE WHEN value < 60 THEN NULL ELSE value END AS value FROM e)""")
def _(t):
    e = holed(t).select("event_id", "user_id", "event_type", F.expr("CASE WHEN value < 60 THEN NULL ELSE value END").alias("value"),
                        F.lit("a").alias("kind"))
    p = prof.profile_summary(e)
    return p.withColumn("n_columns", F.col("n_columns").cast("int"))


@query("prof_dup_columns", """SELECT 'again' AS "column", 's_suppkey' AS duplicate_of WHERE (SELECT count(*) FROM supplier) > 0
 UNION ALL SELECT 'also', 's_name' WHERE (SELECT count(*) FROM supplier) > 0""")
def _(t):
    return prof.duplicate_columns(t.supplier.withColumn("again", F.col("s_suppkey")).withColumn("also", F.col("s_name"))
                                  .withColumn("near", F.expr("CASE WHEN s_acctbal < 0 THEN 0 ELSE s_acctbal END")))


@query("prof_dup_rows", """SELECT CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(n - 1) AS BIGINT) AS n_duplicates,
 round(sum(n - 1) * 100.0 / sum(n), 6) AS pct_duplicates FROM (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2)""")
def _(t):
    return rounded(prof.duplicate_rows(t.lineitem.select("l_orderkey", "l_linenumber")))


@query("prof_dup_rows_whole", """SELECT CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(n - 1) AS BIGINT) AS n_duplicates, round(sum(n - 1) * 100.0 / sum(n), 6) AS pct_duplicates
 FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate)""")
def _(t):
    return rounded(prof.duplicate_rows(t.lineitem))


@query("prof_dup_texts", """SELECT CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(n - 1) AS BIGINT) AS n_duplicates,
 round(sum(n - 1) * 100.0 / sum(n), 6) AS pct_duplicates FROM (SELECT text, count(*) AS n FROM documents GROUP BY 1)""")
def _(t):
    return rounded(prof.duplicate_rows(t.documents.select("text")))


@query("prof_kpis", _EV + """SELECT count(*) AS n_rows, 5 AS n_columns, count(*) * 5 AS n_cells,
 count(*) * 2 - count(event_type) - count(value) AS missing_cells,
 round((count(*) * 2 - count(event_type) - count(value)) * 100.0 / (count(*) * 5), 6) AS pct_missing, 2 AS columns_with_missing,
 3 AS n_numeric, 1 AS n_categorical, 1 AS n_datetime, 0 AS n_nested FROM e""")
def _(t):
    return rounded(prof.kpis(holed(t)))


@query("prof_quality", _EV + """, d AS (SELECT user_id, event_type, value, count(*) AS n FROM e GROUP BY 1, 2, 3),
 m AS (SELECT (count(*) * 2 - count(event_type) - count(value)) * 100.0 / (count(*) * 4) AS pm,
  (SELECT sum(n - 1) * 100.0 / sum(n) FROM d) AS pd FROM e), s AS (SELECT *, 100 - least(2 * pm, 30) - least(pd, 20) - 5 AS score FROM m)
 SELECT round(score, 6) AS score, CASE WHEN score >= 90 THEN 'excellent' WHEN score >= 70 THEN 'good' WHEN score >= 50 THEN 'fair'
 ELSE 'needs_attention' END AS label, round(pm, 6) AS pct_missing, round(pd, 6) AS pct_duplicates, 1 AS constant_columns,
 CASE WHEN pm = 0 THEN 'none' WHEN pm < 5 THEN 'minor' WHEN pm < 20 THEN 'moderate' ELSE 'significant' END AS missing_issue,
 CASE WHEN pd = 0 THEN 'none' WHEN pd < 5 THEN 'few' ELSE 'many' END AS duplicate_issue FROM s""")
def _(t):
    return rounded(prof.quality_score(holed(t).select("user_id", "event_type", "value", F.lit("a").alias("kind"))))


@query("prof_suggestions", _EV + """, s AS (SELECT avg(value) AS m, stddev_pop(value) AS sd, skewness(value) AS sk FROM e)
 SELECT 'event_type' AS "column", 'impute' AS fix, 'mode' AS method FROM e WHERE event_type IS NULL GROUP BY 1
 UNION ALL SELECT 'value', 'impute', CASE WHEN abs(sk) > 1 THEN 'median' ELSE 'mean' END FROM s WHERE (SELECT count(*) > count(value) FROM e)
 UNION ALL SELECT 'value', 'outlier', NULL FROM s WHERE (SELECT count(*) FROM e WHERE abs(value - m) > 3 * sd) > 0
 UNION ALL SELECT 'twin', 'drop_duplicate', NULL UNION ALL SELECT 'kind', 'drop_constant', NULL
 UNION ALL SELECT 'kind', 'review', NULL
 UNION ALL SELECT 'name', 'encode', NULL FROM e HAVING count(DISTINCT user_id) > 50""")
def _(t):
    e = holed(t).select("event_id", "event_type", "value", F.col("event_id").alias("twin"), F.lit("a").alias("kind"),
                        F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("name"))
    return prof.suggest_fixes(e)


@query("prof_describe", _EV + """SELECT 'value' AS "column", count(value) AS n, round(avg(value), 6) AS mean, round(stddev(value), 6) AS std,
 min(value) AS min, round(quantile_cont(value, 0.25), 6) AS q1, round(median(value), 6) AS median,
 round(quantile_cont(value, 0.75), 6) AS q3, max(value) AS max, count(*) - count(value) AS n_missing,
 round((count(*) - count(value)) * 100.0 / count(*), 6) AS pct_missing, round(skewness(value), 6) AS skew,
 round(kurtosis(value), 6) AS kurtosis FROM e""")
def _(t):
    return rounded(prof.describe(holed(t), ["value"]))


@query("prof_value_counts", """SELECT p_brand AS value, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM part), 4) AS pct
 FROM part GROUP BY 1 ORDER BY n DESC, value LIMIT 10""")
def _(t):
    from ..operators.relational import value_counts

    return rounded(value_counts(t.part, "p_brand"), 4)


@query("prof_counts_by", """WITH top AS (SELECT p_brand FROM part GROUP BY 1 ORDER BY count(*) DESC, p_brand LIMIT 10)
 SELECT p_brand AS value, p_type AS "by", count(*) AS n FROM part WHERE p_brand IN (SELECT p_brand FROM top) GROUP BY 1, 2""")
def _(t):
    return prof.value_counts_by(t.part, "p_brand", "p_type")


_HIST = _EV + """, r AS (SELECT min(value) AS lo, max(value) AS hi, (max(value) - min(value)) / 30 AS w FROM e),
 b AS (SELECT CAST(least(floor((value - lo) / w), 29) AS INTEGER) AS bin, event_type FROM e, r WHERE value IS NOT NULL)"""


@query("prof_histogram", _HIST + """, c AS (SELECT CAST(range AS INTEGER) AS bin FROM range(30)), n AS (SELECT bin, count(*) AS n FROM b GROUP BY 1)
 SELECT c.bin, round(lo + c.bin * w, 6) AS lo, round(lo + c.bin * w + w, 6) AS hi, coalesce(n, 0) AS n,
 round(coalesce(n, 0) / ((SELECT count(value) FROM e) * w), 9) AS density FROM c LEFT JOIN n ON c.bin = n.bin, r""")
def _(t):
    return rounded(prof.histogram(holed(t), "value"), 6, density=9)


@query("prof_histogram_by", _HIST + """, s AS (SELECT event_type, count(value) AS size FROM e GROUP BY 1)
 SELECT event_type AS "by", bin, round(lo + bin * w, 6) AS lo, round(lo + bin * w + w, 6) AS hi, count(*) AS n,
 round(count(*) / (any_value(size) * any_value(w)), 9) AS density FROM b JOIN s USING (event_type), r GROUP BY event_type, bin, lo, w""")
def _(t):
    return rounded(prof.histogram(holed(t), "value", by="event_type"), 6, density=9)


def _box(col, table, group=""):
    key = f'{group} AS "by", ' if group else ""
    by = f"GROUP BY {group}" if group else ""
    on = f"ON t.{group} = f.{group}" if group else "ON true"
    keycol = f"{group}, " if group else ""
    tail = f"GROUP BY f.{group}, q1, med, q3" if group else "GROUP BY q1, med, q3"
    key = f'f.{group} AS "by", ' if group else ""
    return f"""SELECT '{col}' AS "column", {key}count({col}) AS n, round(q1, 6) AS q1, round(med, 6) AS median, round(q3, 6) AS q3,
 min(CASE WHEN {col} >= q1 - 1.5 * (q3 - q1) THEN {col} END) AS whisker_lo, max(CASE WHEN {col} <= q3 + 1.5 * (q3 - q1) THEN {col} END)
 AS whisker_hi, round(avg({col}), 6) AS mean, round(stddev({col}), 6) AS std FROM {table} t JOIN (SELECT {keycol}quantile_cont({col}, 0.25) AS q1,
 median({col}) AS med, quantile_cont({col}, 0.75) AS q3 FROM {table} {by}) f {on} {tail}"""


@query("prof_box", _EV + _box("value", "e"))
def _(t):
    return rounded(prof.box_stats(holed(t), ["value"]))


@query("prof_box_by", _box("value", "events", "event_type"))
def _(t):
    return rounded(prof.box_stats(t.events, ["value"], by="event_type"))


@query("prof_kde", """WITH r AS (SELECT count(value) AS n, min(value) AS lo, max(value) AS hi, stddev(value) * power(count(value), -0.2) AS h FROM events),
 f AS (SELECT least(floor((value - lo) / ((hi - lo) / 2048)), 2047) AS cell, count(*) AS c, avg(value) AS v FROM events, r GROUP BY 1),
 g AS (SELECT range AS i, lo + range * ((hi - lo) / 199) AS x FROM range(200), r)
 SELECT round(x, 6) AS x, round(sum(c * exp(-0.5 * power((x - v) / h, 2))) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 9) AS density
 FROM g, f, r GROUP BY x""")
def _(t):
    return rounded(prof.kde(t.events, "value"), 6, density=9)


def _qq_sql():
    from ..functions.special import normal_ppf

    rows = ",".join(f"({i}, {(i - 0.5) / 100!r}, {normal_ppf((i - 0.5) / 100)!r})" for i in range(1, 101))
    return f"""WITH p(position, p, theoretical) AS (VALUES {rows}),
 qs AS (SELECT quantile_cont(value, [{",".join(repr((i - 0.5) / 100) for i in range(1, 101))}]) AS a FROM events),
 s AS (SELECT position, CAST(theoretical AS DOUBLE) AS theoretical, a[position] AS sample FROM p, qs)
 SELECT position, round(theoretical, 6) AS theoretical, round(sample, 6) AS sample,
 round((SELECT regr_slope(sample, theoretical) FROM s), 6) AS slope, round((SELECT regr_intercept(sample, theoretical) FROM s), 6) AS intercept FROM s"""


@query("prof_qq", _qq_sql())
def _(t):
    return rounded(prof.qq_points(t.events, "value"))
