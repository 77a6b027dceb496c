"""Time series: detection, resampling, autocorrelation, decomposition and residual outliers.

All functions take an optional ``series_key`` so that many series are handled side by side; a single
long series is cut into blocks with the neighbours each block needs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.exprs import collect_stats, columns_of, kind, num, q, ratio, records
from ..functions.keyed import attach
from ..functions.ordered import grouped_quantiles
from ..functions.sequences import BLOCK, blocks, row_index
from ..functions.store import materialise

# fixed values: settings
TIME_NAMES = ["date", "datetime", "timestamp", "time"]
PARSE_SHARE = 0.8
YEAR_RANGE = (1900, 2100)
MODE_SHARE = 0.8
INDEX_NAMES = ("id", "index", "row")
MAX_LAGS = 40
MIN_ACF_ROWS = 10
NORMAL_95 = 1.959963984540054
ORDER_Z = 1.96
MIN_OUTLIER_ROWS = 20
RESIDUAL_Z = 3.0
ROBUST_ROUNDS = 2
STRENGTH_BANDS = (0.7, 0.4)
# seasonal period by frequency code
PERIODS = {"D": 7, "B": 5, "W": 52, "M": 12, "MS": 12, "Q": 4, "Y": 1, "H": 24, "T": 60, "S": 60, "L": 1000, "U": 1000}
DEFAULT_PERIOD = 12
AGGREGATIONS = ("mean", "sum", "median", "first", "last")
GRIDS = ("D", "H", "T", "W", "M")


def _time(df: DataFrame, name: str) -> Column:
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.StringType):
        return q(name).try_cast("timestamp_ntz")
    return q(name).cast("timestamp_ntz")


def datetime_columns(df: DataFrame) -> DataFrame:
    """(column, first, last): date/time columns, and text columns that parse for more than 80 % of the
    rows into years 1900-2100.  One scan for all columns."""
    cands = [f.name for f in df.schema.fields if kind(f.dataType) == "datetime" or isinstance(f.dataType, T.StringType)]
    typed = set(columns_of(df, "datetime"))
    schema = "column string, first string, last string"
    if not cands:
        return records(df.sparkSession, [], schema)
    got = collect_stats(df, {"n": F.count(F.lit(1)), **{(c, k): f(_time(df, c)) for c in cands
                             for k, f in (("n", F.count), ("lo", F.min), ("hi", F.max))}})
    rows = []
    for c in cands:
        lo, hi, n = got[c, "lo"], got[c, "hi"], got[c, "n"]
        good = n > PARSE_SHARE * got["n"] and lo is not None and YEAR_RANGE[0] <= lo.year and hi.year <= YEAR_RANGE[1]
        if c in typed or good:
            rows.append((c, lo.strftime("%Y-%m-%d %H:%M:%S") if lo else None, hi.strftime("%Y-%m-%d %H:%M:%S") if hi else None))
    return records(df.sparkSession, rows, schema)


def primary_time(columns: list[str]) -> str | None:
    for word in TIME_NAMES:
        for c in columns:
            if word in c.lower():
                return c
    return columns[0] if columns else None


def _beside(rows: DataFrame, stats: DataFrame, keys: list[str], series_key: str | None, how: str = "inner") -> DataFrame:
    """Per-series values beside the rows.  Without a series key there is one series: its values (one row, or one per phase of
    the period) are broadcast.  With one, a long series is not gathered into one task."""
    return rows.join(F.broadcast(stats), keys, how) if series_key is None else attach(rows, stats, keys, how)


def _gaps(df: DataFrame, time: str, series_key: str | None) -> DataFrame:
    """(series, gap in seconds, previous time, time) between neighbouring distinct times."""
    keys = [q(series_key).alias("_series")] if series_key else [F.lit(0).alias("_series")]
    times = df.select(*keys, _time(df, time).alias("_t")).filter(F.col("_t").isNotNull()).distinct()
    idx = row_index(times, ["_t"], ["_series"])
    w = Window.partitionBy("_series", "_block").orderBy("idx")
    near = blocks(idx, 1, 0).withColumn("_prev", F.lag("_t").over(w)).filter(F.col("_own") & F.col("_prev").isNotNull())
    gap = F.expr("timestampdiff(MICROSECOND, _prev, _t)") / F.lit(1e6)
    return near.select("_series", gap.alias("gap"), "_prev", "_t")


#: units of a regular gap, the largest first
UNITS = {"W": 604800, "D": 86400, "H": 3600, "T": 60, "S": 1}
WEEK_DAYS = ("MON", "TUE", "WED", "THU", "FRI", "SAT", "SUN")


def _code(seconds: float, weekday: int | None = None) -> str:
    """The largest unit that divides the gap, with its multiple in front if that is not 1 (2H, 15T, 3D).  Weeks name
    the day on which all times fall, if there is one."""
    for unit, size in UNITS.items():
        times, rest = divmod(seconds, size)
        if times >= 1 and rest == 0:
            anchor = f"-{WEEK_DAYS[weekday]}" if unit == "W" and weekday is not None else ""
            return (f"{int(times)}" if times > 1 else "") + unit + anchor
    return f"{seconds:g}S"


def detect_series(df: DataFrame, time: str | None = None, series_key: str | None = None, gaps: DataFrame | None = None) -> DataFrame:
    """One row: time column, extent, regularity, frequency code, confidence and numeric targets.
    Gaps are taken between distinct times (per series when ``series_key`` is given); ``gaps``: when they are written already."""
    found = [r["column"] for r in datetime_columns(df).collect()]
    time = time or primary_time(found)
    schema = ("time_column string, first string, last string, n_points bigint, is_regular boolean, frequency string, "
              "confidence string, is_timeseries boolean, targets string")
    targets = [c for c in columns_of(df, "numeric") if c.lower() not in INDEX_NAMES]
    if time is None:
        return records(df.sparkSession, [(None, None, None, None, False, None, "low", False, ",".join(targets))], schema)
    t = _time(df, time)
    lo, hi, n = df.agg(F.min(t), F.max(t), F.count(t)).first()
    regular, freq, conf = False, None, "low"
    if n >= 2:
        gaps = materialise(_gaps(df, time, series_key), "gaps") if gaps is None else gaps
        day = lambda c: F.dayofmonth(c)
        midnight = F.date_format("_t", "HHmmss") == "000000"
        step = F.months_between(F.trunc("_t", "month"), F.trunc("_prev", "month"))
        both_first = (day(F.col("_t")) == 1) & (day(F.col("_prev")) == 1) & midnight
        both_last = (F.to_date("_t") == F.last_day("_t")) & (F.to_date("_prev") == F.last_day("_prev")) & midnight
        weekday = F.weekday("_t") < 5
        business = midnight & weekday & (((F.col("gap") == 86400) & (F.weekday("_t") > 0)) | ((F.col("gap") == 259200) & (F.weekday("_t") == 0)))
        s = gaps.agg(F.count(F.lit(1)).alias("n"), F.min("gap").alias("lo"), F.max("gap").alias("hi"),
                     *[F.count_if(both_first & (step == k)).alias(f"s{k}") for k in (1, 3, 12)],
                     *[F.count_if(both_last & (step == k)).alias(f"e{k}") for k in (1, 3, 12)],
                     F.count_if(business).alias("b"), F.min(F.weekday("_t")).alias("first_day"), F.max(F.weekday("_t")).alias("last_day")).first()
        if s["n"]:
            calendar = {"s1": "MS", "s3": "QS", "s12": "YS", "e1": "M", "e3": "Q", "e12": "Y", "b": "B"}
            day_of = s["first_day"] if s["first_day"] == s["last_day"] else None
            exact = _code(s["lo"], day_of) if s["lo"] == s["hi"] else next((c for k, c in calendar.items() if s[k] == s["n"]), None)
            if exact:
                regular, freq, conf = True, exact, "high"
            else:
                top = gaps.groupBy("gap").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "gap").limit(1).first()
                if top["n"] / s["n"] > MODE_SHARE:
                    regular, freq, conf = True, _code(top["gap"]), "medium"
    is_ts = bool(targets) and n >= 2
    if is_ts and conf == "low":
        conf = "medium"
    fmt = lambda v: v.strftime("%Y-%m-%d %H:%M:%S") if v else None
    return records(df.sparkSession, [(time, fmt(lo), fmt(hi), n, regular, freq, conf, is_ts, ",".join(targets))], schema)


def bucket(t: str, freq: str) -> Column:
    """Label of the grid cell: the start for D/H/T, the closing Sunday for W, the month end for M."""
    seconds = {"H": 3600, "T": 60}.get(freq)
    if seconds:
        past = F.expr(f"timestampdiff(SECOND, timestamp_ntz'1900-01-01 00:00:00', {t})")
        return F.expr("timestamp_ntz'1900-01-01 00:00:00'") + F.make_dt_interval(secs=past - F.pmod(past, F.lit(seconds)))
    day = F.to_date(t)
    if freq == "D":
        return day.cast("timestamp_ntz")
    if freq == "W":
        return F.date_add(day, 6 - F.weekday(day)).cast("timestamp_ntz")
    if freq == "M":
        return F.last_day(day).cast("timestamp_ntz")
    raise ValueError(f"unknown grid: {freq}")


def auto_grid(df: DataFrame, time: str) -> str:
    lo, hi = df.agg(F.min(_time(df, time)), F.max(_time(df, time))).first()
    days = (hi - lo).days if lo is not None else 0
    return "D" if days > 365 else "H" if days > 7 else "T"


def resample(df: DataFrame, time: str, value: str, freq: str | None = None, agg: str = "mean",
             series_key: str | None = None, tie: str | None = None) -> DataFrame:
    """(series, time, value) on a regular grid; empty cells do not appear."""
    freq = freq or auto_grid(df, time)
    if freq not in GRIDS:
        raise ValueError(f"unknown grid: {freq}")
    if agg not in AGGREGATIONS:
        raise ValueError(f"unknown aggregation: {agg}")
    keys = [q(series_key).alias(series_key)] if series_key else []
    t = _time(df, time)
    rows = df.select(*keys, t.alias("_t"), num(df, value).alias("_v"), (q(tie) if tie else F.lit(0)).alias("_tie"))
    rows = rows.filter(F.col("_t").isNotNull() & F.col("_v").isNotNull())
    cells = rows.withColumn("time", bucket("_t", freq))
    by = [*([series_key] if series_key else []), "time"]
    if agg == "median":
        # exact per-cell medians through the global value order: a crowded cell is not gathered
        one = cells.select(F.struct(*by).alias("_cell"), F.col("_v").alias("value"))
        got = grouped_quantiles(one, "_cell", "value", {"value_": 0.5})
        return got.select(*[F.col("_cell")[k].alias(k) for k in by], F.col("value_").alias("value"))
    how = {"mean": F.avg("_v"), "sum": F.sum("_v"), "first": F.min_by("_v", F.struct("_t", "_tie")),
           "last": F.max_by("_v", F.struct("_t", "_tie"))}[agg]
    return cells.groupBy(*by).agg(how.alias("value"))


def series(df: DataFrame, time: str, value: str, series_key: str | None = None, tie: str | None = None) -> DataFrame:
    """(series, idx, time, value): complete rows numbered in time order."""
    rows = df.select((q(series_key) if series_key else F.lit(0)).alias("series"), _time(df, time).alias("time"),
                     num(df, value).alias("value"), *([q(tie).alias("tie")] if tie else []))
    rows = rows.filter(F.col("time").isNotNull() & F.col("value").isNotNull())
    return row_index(rows, ["time", "tie"] if tie else ["time"], ["series"])


def acf(df: DataFrame, time: str, value: str, lags: int = MAX_LAGS, series_key: str | None = None, tie: str | None = None,
        block: int = BLOCK) -> DataFrame:
    """(series, lag, n, acf, lower, upper) with Bartlett 95 % bounds; series below ten points are left out."""
    s = series(df, time, value, series_key, tie)
    stats = s.groupBy("series").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("m")).filter(F.col("n") >= MIN_ACF_ROWS)
    s = _beside(s, stats, ["series"], series_key).withColumn("d", F.col("value") - F.col("m"))
    w = Window.partitionBy("series", "_block").orderBy("idx")
    wide = blocks(s, lags, 0, block=block).select(
        "series", "n", "d", "_own", *[F.lag("d", k).over(w).alias(f"_l{k}") for k in range(1, lags + 1)]).filter("_own")
    sums = wide.groupBy("series", "n").agg(F.sum(F.col("d") * F.col("d")).alias("_c0"), *[
        F.coalesce(F.sum(F.col("d") * F.col(f"_l{k}")), F.lit(0.0)).alias(f"_c{k}") for k in range(1, lags + 1)])
    cells = F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"_c{k}").alias("_c")) for k in range(lags + 1)])
    rows = sums.select("series", "n", "_c0", F.inline(cells)).filter(F.col("lag") <= F.least(F.lit(lags), F.col("n") - 1)).select(
        "series", "n", "lag", ratio(F.col("_c"), F.col("_c0")).alias("acf"))
    # Bartlett: the variance at a lag grows with the squares of the lags before it (at most ``lags`` rows per series)
    before = Window.partitionBy("series").orderBy("lag").rowsBetween(Window.unboundedPreceding, -1)
    spread = F.coalesce(F.sum(F.when(F.col("lag") > 0, F.col("acf") * F.col("acf"))).over(before), F.lit(0.0))
    half = F.lit(NORMAL_95) * F.sqrt(F.when(F.col("lag") == 0, F.lit(0.0)).otherwise((1 + 2 * spread) / F.col("n")))
    out = rows.withColumn("_h", half).select("series", "n", "lag", "acf", (F.col("acf") - F.col("_h")).alias("lower"),
                                             (F.col("acf") + F.col("_h")).alias("upper"))
    return out if series_key else out.drop("series")


def _levinson(r: list[float]) -> list[float]:
    """Partial autocorrelations of lags 0.. from autocorrelations (Durbin-Levinson)."""
    pac, phi = [1.0], []
    for k in range(1, len(r)):
        den = 1 - sum(p * r[j + 1] for j, p in enumerate(phi))
        top = r[k] - sum(p * r[k - 1 - j] for j, p in enumerate(phi))
        a = top / den if den else 0.0
        phi = [p - a * phi[k - 2 - j] for j, p in enumerate(phi)] + [a]
        pac.append(a)
    return pac


def pacf(df: DataFrame, time: str, value: str, lags: int = MAX_LAGS, series_key: str | None = None, tie: str | None = None) -> DataFrame:
    """(series, lag, n, acf, pacf, lower, upper): Yule-Walker partial autocorrelation.  Each group handed
    to Python is the lag table of one series (at most ``lags`` + 1 rows)."""
    import pandas as pd

    a = acf(df, time, value, lags, series_key, tie)
    a = a if series_key else a.withColumn("series", F.lit(0))
    dtype = a.schema["series"].dataType.simpleString()

    def one(pdf):
        pdf = pdf.sort_values("lag")
        p = _levinson(pdf["acf"].astype(float).fillna(0.0).tolist())
        half = [0.0 if k == 0 else NORMAL_95 / math.sqrt(n) for k, n in zip(pdf["lag"], pdf["n"])]
        return pd.DataFrame({"series": pdf["series"], "lag": pdf["lag"], "n": pdf["n"], "acf": pdf["acf"], "pacf": p,
                             "lower": [x - h for x, h in zip(p, half)], "upper": [x + h for x, h in zip(p, half)]})

    out = a.select("series", "lag", "n", "acf").groupBy("series").applyInPandas(
        one, f"series {dtype}, lag int, n bigint, acf double, pacf double, lower double, upper double")
    return out if series_key else out.drop("series")


def arma_orders(df: DataFrame, time: str, value: str, lags: int = MAX_LAGS, series_key: str | None = None, tie: str | None = None) -> DataFrame:
    """Last significant lag of the partial (AR) and plain (MA) autocorrelation, and the model they suggest."""
    p = pacf(df, time, value, lags, series_key, tie)
    p = p if series_key else p.withColumn("series", F.lit(0))
    limit = F.lit(ORDER_Z) / F.sqrt("n")
    far = F.col("lag") > 0
    o = p.groupBy("series").agg(F.max("n").alias("n"), F.max(F.when(far & (F.abs("pacf") > limit), F.col("lag"))).alias("ar_order"),
                                F.max(F.when(far & (F.abs("acf") > limit), F.col("lag"))).alias("ma_order"))
    o = o.withColumn("model", F.when(F.col("ar_order").isNotNull() & F.col("ma_order").isNotNull(), "ARMA")
                     .when(F.col("ar_order").isNotNull(), "AR").when(F.col("ma_order").isNotNull(), "MA").otherwise("none"))
    return o if series_key else o.drop("series")


def period_of(freq: str | None) -> int:
    if not freq:
        return DEFAULT_PERIOD
    unit = freq.upper().split("-")[0].lstrip("0123456789.")
    return PERIODS.get(unit, PERIODS.get(unit[:1], DEFAULT_PERIOD))


def decompose(df: DataFrame, time: str, value: str, period: int, model: str = "additive", series_key: str | None = None,
              tie: str | None = None, block: int = BLOCK) -> DataFrame:
    """(series, idx, time, observed, trend, seasonal, residual).

    Trend: centred moving average (half weights at both ends for an even period); the first and last
    half period follow the straight line through the nearest ``period`` trend values.  Seasonal: mean
    of the detrended values per phase, centred.  Series shorter than two periods are left out."""
    if model not in ("additive", "multiplicative"):
        raise ValueError(f"unknown model: {model}")
    if period < 2:
        raise ValueError("period must be at least 2")
    s = materialise(series(df, time, value, series_key, tie), "series")
    sizes = s.groupBy("series").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= 2 * period)
    s = _beside(s, sizes, ["series"], series_key)
    half = period // 2
    w = Window.partitionBy("series", "_block").orderBy("idx")
    near = blocks(s, half, half, block=block)
    if period % 2:
        mean = F.avg("value").over(w.rowsBetween(-half, half))
    else:
        inner = F.sum("value").over(w.rowsBetween(-(half - 1), half - 1))
        mean = (inner + 0.5 * (F.lag("value", half).over(w) + F.lead("value", half).over(w))) / period
    whole = (F.col("idx") >= half) & (F.col("idx") < F.col("n") - half)
    t = materialise(near.withColumn("trend", F.when(whole, mean)).filter("_own").drop("_block", "_own"), "trend")
    # straight lines through the first and the last trend values
    x, y = F.col("idx").cast("double"), F.col("trend")
    first, last = F.lit(half), F.col("n") - 1 - half
    head = whole & (F.col("idx") < F.least(first + period, last))
    tail = whole & (F.col("idx") >= F.greatest(first, last - period)) & (F.col("idx") < last)
    lines = t.filter(head | tail).groupBy("series").agg(*[f(F.when(c, y), F.when(c, x)).alias(name) for name, f, c in (
        ("_k0", F.regr_slope, head), ("_b0", F.regr_intercept, head), ("_k1", F.regr_slope, tail), ("_b1", F.regr_intercept, tail))])
    t = _beside(t, lines, ["series"], series_key, "left")
    ends = F.when(F.col("idx") < half, F.col("_b0") + F.col("_k0") * x).otherwise(F.col("_b1") + F.col("_k1") * x)
    t = t.withColumn("trend", F.coalesce("trend", ends)).drop("_k0", "_b0", "_k1", "_b1")
    add = model == "additive"
    flat = F.col("value") - F.col("trend") if add else ratio(F.col("value"), F.col("trend"))
    t = t.withColumn("_phase", F.col("idx") % period)
    phases = t.groupBy("series", "_phase").agg(F.avg(flat).alias("_s"))
    middle = phases.groupBy("series").agg(F.avg("_s").alias("_m"))
    phases = phases.join(middle, "series").select("series", "_phase", (F.col("_s") - F.col("_m") if add else ratio(F.col("_s"), F.col("_m"))).alias("seasonal"))
    t = _beside(t, phases, ["series", "_phase"], series_key)
    resid = F.col("value") - F.col("trend") - F.col("seasonal") if add else ratio(ratio(F.col("value"), F.col("trend")), F.col("seasonal"))
    out = t.select("series", "idx", "time", F.col("value").alias("observed"), "trend", "seasonal", resid.alias("residual"))
    return out if series_key else out.drop("series")


def _local_lines(reach: int):
    """Per block: the value at each point of the line fitted to the ``reach`` points on both sides, by tricube weights times the
    robustness weights ``w``; where those leave nothing, by tricube weights alone."""
    import numpy as np

    step = np.arange(-reach, reach + 1)
    kernel = (1 - (np.abs(step) / (reach + 1.0)) ** 3) ** 3

    def sums(values, power):
        return np.convolve(values, (kernel * step ** power)[::-1], "full")[reach:reach + len(values)]

    def fit(y, w):
        s0, s1, s2 = (sums(w, p) for p in range(3))
        t0, t1 = (sums(w * y, p) for p in range(2))
        det = s0 * s2 - s1 * s1
        with np.errstate(all="ignore"):
            return np.where(det > 1e-9 * s0 * s0, (s2 * t0 - s1 * t1) / det, np.where(s0 > 1e-9, t0 / s0, np.nan))

    def run(pdf):
        pdf = pdf.sort_values("idx")
        y, w = pdf["flat"].to_numpy(float), pdf["w"].to_numpy(float)
        robust, plain = fit(y, w), fit(y, np.ones(len(y)))
        pdf["trend"] = np.where(np.isnan(robust), plain, robust)
        return pdf[pdf["_own"]].drop(columns=["_block", "_own", "flat"])

    return run


def decompose_robust(df: DataFrame, time: str, value: str, period: int, rounds: int = ROBUST_ROUNDS, series_key: str | None = None,
                     tie: str | None = None, block: int = BLOCK) -> DataFrame:
    """(series, idx, time, observed, trend, seasonal, residual, weight): additive, by ``rounds`` of local regression.

    In every round the trend is a local line over ``period`` points on both sides of the value less its seasonal part, the seasonal
    part the weighted mean per phase of the value less its trend, centred; then a point gets the bisquare weight of its residual over
    six times the median absolute residual of the series.  So single spikes bend neither the trend nor the season.  Blocks carry
    the neighbours they need; series shorter than two periods are left out."""
    if period < 2 or rounds < 1:
        raise ValueError("period must be at least 2 and rounds at least 1")
    s = materialise(series(df, time, value, series_key, tie).select("series", "idx", "time", "value"), "series")
    sizes = s.groupBy("series").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= 2 * period)
    now = _beside(s, sizes, ["series"], series_key).drop("n").withColumn("seasonal", F.lit(0.0)).withColumn("w", F.lit(1.0))
    for _ in range(rounds):
        near = blocks(now.drop("trend", "residual"), period, period, block=block).withColumn("flat", F.col("value") - F.col("seasonal"))
        kept = [f for f in near.schema.fields if f.name not in ("_block", "_own", "flat")]
        schema = T.StructType([*kept, T.StructField("trend", T.DoubleType())])
        t = near.groupBy("series", "_block").applyInPandas(_local_lines(period), schema).drop("seasonal").withColumn("_phase", F.col("idx") % period)
        t = materialise(t, "local")
        phases = t.groupBy("series", "_phase").agg(F.coalesce(ratio(F.sum(F.col("w") * (F.col("value") - F.col("trend"))), F.sum("w")), F.lit(0.0)).alias("_s"))
        middle = phases.groupBy("series").agg(F.avg("_s").alias("_m"))
        phases = phases.join(middle, "series").select("series", "_phase", (F.col("_s") - F.col("_m")).alias("seasonal"))
        now = _beside(t, phases, ["series", "_phase"], series_key).drop("_phase").withColumn("residual", F.col("value") - F.col("trend") - F.col("seasonal"))
        now = materialise(now, "round")
        scale = grouped_quantiles(now.withColumn("_a", F.abs("residual")), "series", "_a", {"_mid": 0.5}).select("series", "_mid")
        u = ratio(F.col("residual"), 6 * F.col("_mid"))
        bisquare = F.when(F.col("_mid") == 0, F.lit(1.0)).when(F.abs(u) < 1, F.pow(1 - u * u, F.lit(2.0))).otherwise(F.lit(0.0))
        now = _beside(now, scale, ["series"], series_key).withColumn("w", bisquare).drop("_mid")
    out = now.select("series", "idx", "time", F.col("value").alias("observed"), "trend", "seasonal", "residual", F.col("w").alias("weight"))
    return out if series_key else out.drop("series")


def strength(parts: DataFrame) -> DataFrame:
    """Trend and seasonal strength max(0, 1 - var(residual) / var(observed - component)), with bands."""
    by = ["series"] if "series" in parts.columns else []
    def power(c):
        rest = F.var_pop(F.col("observed") - F.col(c))
        return F.coalesce(F.greatest(F.lit(0.0), 1 - ratio(F.var_pop("residual"), rest)), F.lit(0.0))
    s = parts.groupBy(*by).agg(power("trend").alias("trend_strength"), power("seasonal").alias("seasonal_strength"))
    def band(c):
        return F.when(F.col(c) > STRENGTH_BANDS[0], "strong").when(F.col(c) > STRENGTH_BANDS[1], "moderate").otherwise("weak")
    return s.withColumn("trend_band", band("trend_strength")).withColumn("seasonal_band", band("seasonal_strength"))


def ts_outliers(df: DataFrame, time: str, value: str, freq: str | None = None, period: int | None = None,
                series_key: str | None = None, limit: float = RESIDUAL_Z, tie: str | None = None, robust: bool = False) -> DataFrame:
    """Decomposition residuals with their z-score flag; ``robust``: those of local regression.  Without ``freq`` an irregular series is first
    averaged on the grid its median gap suggests."""
    rows, t, v = df, time, value
    if freq is None:
        gaps = materialise(_gaps(df, time, series_key), "gaps")
        found = detect_series(df, time, series_key, gaps).first()
        freq = found["frequency"] if found["is_regular"] else None
        if freq is None:
            from ..functions.quantiles import one_column

            mid = one_column(gaps, F.col("gap"), [0.5])[0]
            if mid is None:
                raise ValueError("no time gaps to infer a grid from")
            freq = next((c for c, s in (("T", 60), ("H", 3600), ("D", 86400), ("W", 604800)) if mid <= s), "M")
            rows, t, v = resample(df, time, value, freq, series_key=series_key), "time", "value"
    s = series(rows, t, v, series_key, tie if rows is df else None)
    n = s.groupBy("series").agg(F.count(F.lit(1)).alias("n")).agg(F.min("n"), F.max("n")).first()
    if n[1] is None or n[1] < MIN_OUTLIER_ROWS:
        raise ValueError(f"at least {MIN_OUTLIER_ROWS} observations are needed")
    period = period or period_of(freq)
    if n[0] < 2 * period:
        period = max(7, n[0] // 3)
    parts = materialise((decompose_robust if robust else decompose)(rows, t, v, period, series_key=series_key, tie=tie if rows is df else None), "parts")
    keyed = parts if series_key else parts.withColumn("series", F.lit(0))
    stats = keyed.groupBy("series").agg(F.avg("residual").alias("_m"), F.stddev("residual").alias("_s"))
    out = _beside(keyed, stats, ["series"], series_key).withColumn("z", ratio(F.col("residual") - F.col("_m"), F.col("_s"))).withColumn(
        "outlier", F.coalesce(F.abs("z") > limit, F.lit(False))).drop("_m", "_s")
    return out if series_key else out.drop("series")
