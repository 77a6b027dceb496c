"""Time-series queries on the event stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import timeseries as ts
from .registry import query, rounded


def stamped(df, col="time"):
    return df.withColumn(col, F.date_format(col, "yyyy-MM-dd HH:mm:ss"))


def _stamp(x):
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"


@query("ts_columns", f"""SELECT 'ts' AS "column", {_stamp('min(ts)')} AS first, {_stamp('max(ts)')} AS last FROM events
 UNION ALL SELECT 'day_text', {_stamp('min(date_trunc(\'day\', ts))')}, {_stamp('max(date_trunc(\'day\', ts))')} FROM events""")
def _(t):
    e = t.events.select("event_id", "ts", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("day_text"), "value")
    return ts.datetime_columns(e)


@query("ts_detect", f"""SELECT 'ts' AS time_column, {_stamp('min(ts)')} AS first, {_stamp('max(ts)')} AS last, count(ts) AS n_points, false AS is_regular, CAST(NULL AS VARCHAR) AS frequency,
 'medium' AS confidence, true AS is_timeseries, 'event_id,user_id,value' AS targets FROM events""")
def _(t):
    return ts.detect_series(t.events.drop("props"))


@query("ts_detect_regular", f"""SELECT 'time' AS time_column, {_stamp("min(date_trunc('hour', ts))")} AS first, {_stamp("max(date_trunc('hour', ts))")} AS last, count(DISTINCT date_trunc('hour', ts)) AS n_points,
 true AS is_regular, 'H' AS frequency, 'high' AS confidence, true AS is_timeseries, 'value' AS targets FROM events HAVING count(DISTINCT date_trunc('hour', ts)) = date_diff('hour', min(ts), max(ts)) + 1
 UNION ALL SELECT 'time', {_stamp("min(date_trunc('hour', ts))")}, {_stamp("max(date_trunc('hour', ts))")}, count(DISTINCT date_trunc('hour', ts)), true, 'H', 'medium', true, 'value' FROM events
 HAVING count(DISTINCT date_trunc('hour', ts)) <> date_diff('hour', min(ts), max(ts)) + 1""")
def _(t):
    return ts.detect_series(ts.resample(t.events, "ts", "value", "H"))


_QUARTERS = "SELECT DISTINCT time_bucket(INTERVAL 15 MINUTE, ts) AS time FROM events"


@query("ts_detect_15min", f"""WITH g AS ({_QUARTERS}), d AS (SELECT time - lag(time) OVER (ORDER BY time) AS gap FROM g),
 m AS (SELECT gap, count(*) AS n FROM d WHERE gap IS NOT NULL GROUP BY 1 ORDER BY n DESC, gap LIMIT 1)
 SELECT {_stamp('min(time)')} AS first, {_stamp('max(time)')} AS last, count(*) AS n_points, CASE WHEN (SELECT n FROM m) = (SELECT count(gap) FROM d) OR (SELECT n FROM m) > 0.8 * (SELECT count(gap) FROM d)
 THEN (SELECT CAST(CAST(epoch(gap) AS BIGINT) // 60 AS VARCHAR) || 'T' FROM m) END AS frequency FROM g""")
def _(t):
    quarter = F.timestamp_seconds(F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 900) * 900).cast("timestamp_ntz")
    got = ts.detect_series(t.events.select(quarter.alias("time"), F.lit(1.0).alias("x")).distinct(), "time")
    return got.select("first", "last", "n_points", "frequency")


@query("ts_detect_weekly", f"""WITH w AS (SELECT DISTINCT date_trunc('week', l_shipdate) + INTERVAL 2 DAY AS time FROM lineitem), d AS (SELECT time - lag(time) OVER (ORDER BY time) AS gap FROM w)
 SELECT {_stamp('min(time)')} AS first, {_stamp('max(time)')} AS last, count(*) AS n_points, (SELECT CASE WHEN min(gap) = max(gap) AND min(gap) = INTERVAL 7 DAY THEN 'W-WED' ELSE 'other' END FROM d) AS frequency FROM w""")
def _(t):
    day = F.date_add(F.to_date(F.date_trunc("week", F.col("l_shipdate"))), 2).cast("timestamp_ntz")
    got = ts.detect_series(t.lineitem.select(day.alias("time"), F.lit(1.0).alias("x")).distinct(), "time")
    return got.select("first", "last", "n_points", "frequency")


_GRID = {"D": "date_trunc('day', ts)", "H": "date_trunc('hour', ts)", "T": "date_trunc('minute', ts)",
         "W": "date_trunc('week', ts) + INTERVAL 6 DAY", "M": "CAST(last_day(ts) AS TIMESTAMP)"}
_AGG = {"mean": "avg(value)", "sum": "sum(value)", "median": "median(value)", "first": "arg_min(value, (ts, event_id))", "last": "arg_max(value, (ts, event_id))"}


@query("ts_resample", " UNION ALL ".join(
    f"SELECT '{g}' AS grid, '{a}' AS agg, {_stamp(_GRID[g])} AS time, round({_AGG[a]}, 6) AS value FROM events GROUP BY 3"
    for g, a in (("D", "mean"), ("H", "sum"), ("T", "median"), ("W", "first"), ("M", "last"), ("H", "median"))))
def _(t):
    parts = None
    for g, a in (("D", "mean"), ("H", "sum"), ("T", "median"), ("W", "first"), ("M", "last"), ("H", "median")):
        one = ts.resample(t.events, "ts", "value", g, a, tie="event_id").select(F.lit(g).alias("grid"), F.lit(a).alias("agg"), "time", "value")
        parts = one if parts is None else parts.unionByName(one)
    return rounded(stamped(parts))


@query("ts_resample_by", f"SELECT event_type, {_stamp(_GRID['D'])} AS time, round(avg(value), 6) AS value FROM events GROUP BY 1, 2")
def _(t):
    return rounded(stamped(ts.resample(t.events, "ts", "value", "D", "mean", series_key="event_type")))


# Smoothed stream: the running pull of the previous value gives real autocorrelation.
_X = "x AS (SELECT event_id, ts, value + 0.5 * coalesce(lag(value) OVER (ORDER BY event_id), 0) AS value FROM events)"


def smooth(t):
    e = t.events.select("event_id", "ts", "value")
    prev = e.select((F.col("event_id") + 1).alias("event_id"), F.col("value").alias("_p"))
    return e.join(prev, "event_id", "left").select("event_id", "ts", (F.col("value") + 0.5 * F.coalesce("_p", F.lit(0.0))).alias("value"))


_ACF = f"""{_X}, d AS (SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS i, value - (SELECT avg(value) FROM x) AS d FROM x),
 r AS (SELECT k AS lag, (SELECT count(*) FROM d) AS n, sum(a.d * b.d) / (SELECT sum(d * d) FROM d) AS r FROM (SELECT CAST(range AS INTEGER) AS k FROM range(41)), d a JOIN d b ON a.i = b.i + k GROUP BY k)"""


@query("ts_acf", f"""WITH {_ACF}, v AS (SELECT lag, n, r, CASE WHEN lag = 0 THEN 0 ELSE (1 + 2 * coalesce(sum(CASE WHEN lag > 0 THEN r * r ELSE 0 END) OVER (ORDER BY lag ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / n END AS var FROM r)
 SELECT lag, n, round(r, 6) AS acf, round(r - 1.959963984540054 * sqrt(var), 6) AS lower, round(r + 1.959963984540054 * sqrt(var), 6) AS upper FROM v""")
def _(t):
    return rounded(ts.acf(smooth(t), "ts", "value", tie="event_id", block=3_000))


_PACF = f"""WITH RECURSIVE {_ACF}, l AS (SELECT list(r ORDER BY lag) AS r, any_value(n) AS n FROM r WHERE lag > 0),
 p(k, phi, pac) AS (SELECT 1, [r[1]], r[1] FROM l UNION ALL
  SELECT k + 1, list_append(list_transform(range(1, k + 1), lambda j: phi[j] - a * phi[k + 1 - j]), a), a FROM (
   SELECT k, phi, (r[k + 1] - list_dot_product(phi, list_reverse(r[1:k]))) / (1 - list_dot_product(phi, r[1:k])) AS a FROM p, l WHERE k < 40))"""


@query("ts_pacf", _PACF + """ SELECT CAST(k AS INTEGER) AS lag, n, round(r[k], 6) AS acf, round(pac, 6) AS pacf, round(pac - 1.959963984540054 / sqrt(n), 6) AS lower, round(pac + 1.959963984540054 / sqrt(n), 6) AS upper FROM p, l
 UNION ALL SELECT 0, n, 1, 1, 1, 1 FROM l""")
def _(t):
    return rounded(ts.pacf(smooth(t), "ts", "value", tie="event_id"))


@query("ts_arma", _PACF + """ SELECT n, CAST(max(CASE WHEN abs(pac) > 1.96 / sqrt(n) THEN k END) AS INTEGER) AS ar_order, CAST(max(CASE WHEN abs(r[k]) > 1.96 / sqrt(n) THEN k END) AS INTEGER) AS ma_order,
 CASE WHEN max(CASE WHEN abs(pac) > 1.96 / sqrt(n) THEN k END) IS NOT NULL AND max(CASE WHEN abs(r[k]) > 1.96 / sqrt(n) THEN k END) IS NOT NULL THEN 'ARMA'
 WHEN max(CASE WHEN abs(pac) > 1.96 / sqrt(n) THEN k END) IS NOT NULL THEN 'AR' WHEN max(CASE WHEN abs(r[k]) > 1.96 / sqrt(n) THEN k END) IS NOT NULL THEN 'MA' ELSE 'none' END AS model FROM p, l GROUP BY n""")
def _(t):
    return ts.arma_orders(smooth(t), "ts", "value", tie="event_id")


def _decomposition(model, p=24):
    add = model == "additive"
    h = p // 2
    flat, seas, resid = ("value - trend", "s - avg(s) OVER ()", "value - trend - seasonal") if add else ("value / trend", "s / avg(s) OVER ()", "value / trend / seasonal")
    return f"""h AS (SELECT date_trunc('hour', ts) AS time, avg(value) AS value FROM events GROUP BY 1),
 o AS (SELECT row_number() OVER (ORDER BY time) - 1 AS idx, count(*) OVER () AS n, time, value FROM h),
 m AS (SELECT *, CASE WHEN idx >= {h} AND idx < n - {h} THEN (sum(value) OVER (ORDER BY idx ROWS BETWEEN {h - 1} PRECEDING AND {h - 1} FOLLOWING) + 0.5 * (lag(value, {h}) OVER (ORDER BY idx) + lead(value, {h}) OVER (ORDER BY idx))) / {p} END AS t0 FROM o),
 f AS (SELECT regr_slope(t0, idx) AS k, regr_intercept(t0, idx) AS b FROM m WHERE idx >= {h} AND idx < least({h} + {p}, n - 1 - {h})),
 g AS (SELECT regr_slope(t0, idx) AS k, regr_intercept(t0, idx) AS b FROM m WHERE idx >= greatest({h}, n - 1 - {h} - {p}) AND idx < n - 1 - {h}),
 t AS (SELECT idx, time, value, coalesce(t0, CASE WHEN idx < {h} THEN f.b + f.k * idx ELSE g.b + g.k * idx END) AS trend FROM m, f, g),
 ph AS (SELECT ph, {seas} AS seasonal FROM (SELECT idx % {p} AS ph, avg({flat}) AS s FROM t GROUP BY 1)),
 d AS (SELECT idx, time, value AS observed, trend, seasonal, {resid} AS residual FROM t JOIN ph ON idx % {p} = ph)"""


_DEC = f"SELECT idx, {_stamp('time')} AS time, round(observed, 6) AS observed, round(trend, 6) AS trend, round(seasonal, 6) AS seasonal, round(residual, 6) AS residual FROM d"


def hourly(t):
    return ts.resample(t.events, "ts", "value", "H", "mean")


@query("ts_decompose", f"WITH {_decomposition('additive')} {_DEC}")
def _(t):
    return rounded(stamped(ts.decompose(hourly(t), "time", "value", 24, block=200)))


@query("ts_decompose_mult", f"WITH {_decomposition('multiplicative')} {_DEC}")
def _(t):
    return rounded(stamped(ts.decompose(hourly(t), "time", "value", 24, "multiplicative")))


@query("ts_strength", f"""WITH {_decomposition('additive')}, s AS (SELECT greatest(0, 1 - var_pop(residual) / var_pop(observed - trend)) AS a, greatest(0, 1 - var_pop(residual) / var_pop(observed - seasonal)) AS b FROM d)
 SELECT round(a, 6) AS trend_strength, round(b, 6) AS seasonal_strength, CASE WHEN a > 0.7 THEN 'strong' WHEN a > 0.4 THEN 'moderate' ELSE 'weak' END AS trend_band,
 CASE WHEN b > 0.7 THEN 'strong' WHEN b > 0.4 THEN 'moderate' ELSE 'weak' END AS seasonal_band FROM s""")
def _(t):
    return rounded(ts.strength(ts.decompose(hourly(t), "time", "value", 24)))


@query("out_ts", f"WITH {_decomposition('additive')} " + _DEC.replace(" FROM d", """, round((residual - (SELECT avg(residual) FROM d)) / (SELECT stddev(residual) FROM d), 6) AS z,
 abs((residual - (SELECT avg(residual) FROM d)) / (SELECT stddev(residual) FROM d)) > 3 AS outlier FROM d"""))
def _(t):
    return rounded(stamped(ts.ts_outliers(t.events, "ts", "value")))


_BY = f"""h AS (SELECT event_type AS series, date_trunc('day', ts) AS time, avg(value) AS value FROM events GROUP BY 1, 2),
 o AS (SELECT series, row_number() OVER (PARTITION BY series ORDER BY time) - 1 AS idx, count(*) OVER (PARTITION BY series) AS n, time, value FROM h),
 m AS (SELECT *, CASE WHEN idx >= 3 AND idx < n - 3 THEN avg(value) OVER (PARTITION BY series ORDER BY idx ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) END AS t0 FROM o),
 f AS (SELECT series, regr_slope(t0, idx) AS k, regr_intercept(t0, idx) AS b FROM m WHERE idx >= 3 AND idx < least(10, n - 4) GROUP BY 1),
 g AS (SELECT series, regr_slope(t0, idx) AS k, regr_intercept(t0, idx) AS b FROM m WHERE idx >= greatest(3, n - 11) AND idx < n - 4 GROUP BY 1),
 t AS (SELECT m.series, idx, time, value, coalesce(t0, CASE WHEN idx < 3 THEN f.b + f.k * idx ELSE g.b + g.k * idx END) AS trend FROM m JOIN f ON m.series = f.series JOIN g ON m.series = g.series),
 ph AS (SELECT series, ph, s - avg(s) OVER (PARTITION BY series) AS seasonal FROM (SELECT series, idx % 7 AS ph, avg(value - trend) AS s FROM t GROUP BY 1, 2)),
 d AS (SELECT t.series, idx, time, value AS observed, trend, seasonal, value - trend - seasonal AS residual FROM t JOIN ph ON t.series = ph.series AND idx % 7 = ph),
 z AS (SELECT *, (residual - avg(residual) OVER (PARTITION BY series)) / stddev(residual) OVER (PARTITION BY series) AS z FROM d)"""


@query("out_ts_by", f"""WITH {_BY} SELECT series, idx, {_stamp('time')} AS time, round(observed, 6) AS observed, round(trend, 6) AS trend, round(seasonal, 6) AS seasonal, round(residual, 6) AS residual,
 round(z, 6) AS z, abs(z) > 3 AS outlier FROM z""")
def _(t):
    return rounded(stamped(ts.ts_outliers(ts.resample(t.events, "ts", "value", "D", series_key="event_type"), "time", "value",
                                          freq="D", series_key="event_type")))


def _robust_sql(rounds, period):
    """Rounds of local lines, phase means and bisquare weights, every sum over a self-join."""
    k = f"power(1 - power(abs(b.idx - a.idx) / {period + 1}.0, 3), 3)"
    ctes = ["o AS (SELECT row_number() OVER (ORDER BY time) - 1 AS idx, time, value FROM (SELECT date_trunc('hour', ts) AS time, avg(value) AS value FROM events GROUP BY 1))",
            "x0 AS (SELECT idx, time, value, 0.0::DOUBLE AS seasonal, 1.0::DOUBLE AS w FROM o)"]
    for r in range(1, rounds + 1):
        p = f"x{r - 1}"
        ctes += [f"""s{r} AS (SELECT a.idx, a.time, a.value, a.w, sum({k} * b.w) AS s0, sum({k} * b.w * (b.idx - a.idx)) AS s1, sum({k} * b.w * power(b.idx - a.idx, 2)) AS s2,
 sum({k} * b.w * (b.value - b.seasonal)) AS t0, sum({k} * b.w * (b.idx - a.idx) * (b.value - b.seasonal)) AS t1 FROM {p} a JOIN {p} b ON b.idx BETWEEN a.idx - {period} AND a.idx + {period} GROUP BY ALL)""",
                 f"l{r} AS (SELECT idx, time, value, w, (s2 * t0 - s1 * t1) / (s0 * s2 - s1 * s1) AS trend FROM s{r})",
                 f"h{r} AS (SELECT ph, s - avg(s) OVER () AS seasonal FROM (SELECT idx % {period} AS ph, sum(w * (value - trend)) / sum(w) AS s FROM l{r} GROUP BY 1))",
                 f"d{r} AS (SELECT idx, time, value, trend, seasonal, value - trend - seasonal AS residual FROM l{r} JOIN h{r} ON idx % {period} = ph)",
                 f"""x{r} AS (SELECT *, CASE WHEN abs(residual) < 6 * m THEN power(1 - power(residual / (6 * m), 2), 2) ELSE 0 END AS w
 FROM d{r}, (SELECT quantile_cont(abs(residual), 0.5) AS m FROM d{r}))"""]
    return ", ".join(ctes)


@query("out_ts_robust", f"""WITH {_robust_sql(2, 24)}, z AS (SELECT *, (residual - avg(residual) OVER ()) / stddev(residual) OVER () AS z FROM x2)
 SELECT idx, {_stamp('time')} AS time, round(value, 6) AS observed, round(trend, 6) AS trend, round(seasonal, 6) AS seasonal, round(residual, 6) AS residual, round(w, 6) AS weight,
 round(z, 6) AS z, abs(z) > 3 AS outlier FROM z""")
def _(t):
    return rounded(stamped(ts.ts_outliers(hourly(t), "time", "value", freq="H", robust=True)))
