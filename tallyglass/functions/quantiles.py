"""Exact linear-interpolated quantiles without sorting or gathering a column.

The first scan counts, takes the ends and one mergeable sketch per column, which brackets every wanted order statistic.  The
second counts what lies between the brackets and every distinct value inside them, all columns at once; running counts of the
brackets that hold a wanted rank then give the values.  Brackets hold a small share of the rows, cut into pieces of bounded
size, so two scans and a shuffle of a small share serve any number of rows and columns.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from .exprs import collect_stats

#: Sketch size, and three times its rank error at that size (about 2.4 / SKETCH ** 0.94).
SKETCH, SKETCH_ERROR = 8192, 0.0015
#: Columns of up to so many values are one bracket.
SMALL_COLUMN = 5_000
BRACKET_VALUES = 50_000


def quantiles(df: DataFrame, wanted: dict[str, tuple[Column, list[float]]], bracket_values: int = BRACKET_VALUES) -> dict[str, list[float | None]]:
    """``wanted`` maps a name to (double column, probabilities).  ``bracket_values``: about so many values are ordered together."""
    if not wanted:
        return {}
    first = {}
    for name, (x, ps) in wanted.items():
        first[name, "n"], first[name, "lo"], first[name, "hi"] = F.count(x), F.min(x), F.max(x)
        if any(0 < p < 1 for p in ps):
            near = sorted({min(1.0, max(0.0, p + e)) for p in ps for e in (-SKETCH_ERROR, SKETCH_ERROR)})
            sketch = F.kll_sketch_get_quantile_double(F.kll_sketch_agg_double(x, F.lit(SKETCH)), F.array(*[F.lit(v) for v in near]))
            first[name, "cuts"] = F.when(F.count(x) > 0, F.map_from_arrays(F.array(*[F.lit(v) for v in near]), sketch))
    base = collect_stats(df, first)
    known: dict[tuple[str, int], float] = {}
    open_: dict[str, dict[int, tuple[float, float]]] = {}
    for name, (_, ps) in wanted.items():
        n, lo, hi = (base[name, k] for k in ("n", "lo", "hi"))
        for p in ps if n else ():
            h = _position(n, p)
            for r in {math.floor(h), math.ceil(h)}:
                if r in (0, n - 1) or lo == hi:
                    known[name, r] = lo if r == 0 else hi
                elif n <= SMALL_COLUMN:
                    open_.setdefault(name, {})[r] = (lo, hi)
                else:
                    cuts = base[name, "cuts"]
                    open_.setdefault(name, {})[r] = tuple(cuts[min(1.0, max(0.0, p + e))] for e in (-SKETCH_ERROR, SKETCH_ERROR))
    known.update(_solve(df, {name: wanted[name][0] for name in open_}, open_, {name: base[name, "n"] for name in open_}, bracket_values))
    out = {}
    for name, (_, ps) in wanted.items():
        n, out[name] = base[name, "n"], []
        for p in ps:
            if not n:
                out[name].append(None)
                continue
            h = _position(n, p)
            a, b = known[name, math.floor(h)], known[name, math.ceil(h)]
            out[name].append(a + (b - a) * (h - math.floor(h)))
    return out


def _position(n: int, p: float) -> float:
    h = (n - 1) * p
    return float(round(h)) if abs(h - round(h)) < 1e-9 * max(1.0, h) else h


def _merged(brackets) -> list[tuple[float, float]]:
    """Disjoint closed intervals in order."""
    out: list[tuple[float, float]] = []
    for a, b in sorted(brackets):
        if out and a <= math.nextafter(out[-1][1], math.inf):
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _search(x: Column, edges: list[float], lo: int, hi: int) -> Column:
    """Number of ``edges`` that are at most ``x``, between lo and hi, as nested comparisons."""
    if lo == hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    return F.when(x < F.lit(edges[mid]), _search(x, edges, lo, mid)).otherwise(_search(x, edges, mid + 1, hi))


def _solve(df: DataFrame, columns: dict[str, Column], open_: dict[str, dict[int, tuple[float, float]]], sizes: dict[str, int], per_piece: int) -> dict[tuple[str, int], float]:
    """Values at the ranks of ``open_`` (name -> rank -> bracket), from one scan."""
    if not columns:
        return {}
    names, parts = list(columns), []
    flat = df.select(*[columns[c].alias(f"x{i}") for i, c in enumerate(names)])
    intervals = [_merged(open_[c].values()) for c in names]
    places = []
    for i, own in enumerate(intervals):
        edges = [e for a, b in own for e in (a, math.nextafter(b, math.inf))]
        places.append(F.when(F.col(f"x{i}").isNotNull(), _search(F.col(f"x{i}"), edges, 0, len(edges))).alias(f"b{i}"))
    flat = flat.select("*", *places)
    for i, c in enumerate(names):
        x, b = F.col(f"x{i}"), F.col(f"b{i}")
        pieces = max(1, math.ceil(2 * SKETCH_ERROR * sizes[c] / per_piece)) if sizes[c] > SMALL_COLUMN else max(1, math.ceil(sizes[c] / per_piece))
        piece = F.lit(0)
        if pieces > 1:  # equal widths of the bracket
            low, high = (F.element_at(F.array(*[F.lit(v[k]) for v in intervals[i]]), F.shiftright(b + 1, 1)) for k in (0, 1))
            piece = F.when(b % 2 == 1, F.least(F.floor((x - low) / F.greatest(high - low, F.lit(5e-324)) * pieces), F.lit(pieces - 1))).otherwise(0).cast("int")
        parts.append(F.struct(F.lit(i).alias("c"), b.alias("b"), piece.alias("s"), F.when(b % 2 == 1, x).alias("v")))
    freq = flat.select(F.inline(F.array(*parts))).filter("b is not null").groupBy("c", "b", "s", "v").agg(F.count(F.lit(1)).alias("n"))
    ranks = df.sparkSession.createDataFrame([(i, r) for i, c in enumerate(names) for r in open_[c]], "rc int, rank long")
    before = Window.partitionBy("c").orderBy("b", "s").rowsBetween(Window.unboundedPreceding, -1)
    sums = freq.groupBy("c", "b", "s").agg(F.sum("n").alias("t")).withColumn("off", F.coalesce(F.sum("t").over(before), F.lit(0)))
    hold = sums.join(F.broadcast(ranks), (F.col("c") == F.col("rc")) & F.col("rank").between(F.col("off"), F.col("off") + F.col("t") - 1))
    hold = hold.groupBy(F.col("c").alias("hc"), F.col("b").alias("hb"), F.col("s").alias("hs"), "off", "t").agg(F.collect_list("rank").alias("ranks"))  # at most the wanted ranks
    held = freq.join(F.broadcast(hold), (F.col("c") == F.col("hc")) & (F.col("b") == F.col("hb")) & (F.col("s") == F.col("hs")))
    upto = F.col("off") + F.sum("n").over(Window.partitionBy("c", "b", "s").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    hit = held.withColumn("upto", upto).withColumn("rank", F.explode("ranks")).filter((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
    found, again, name_of = {}, {}, {}
    for r in hit.select("c", "b", "v", "rank", "off", "t").collect():
        c, rank = names[r["c"]], r["rank"]
        if r["b"] % 2:
            found[c, rank] = r["v"]
            continue
        # the sketch missed: the rank lies between two brackets, and is looked for among the values there
        own, k = intervals[r["c"]], r["b"] // 2
        x = columns[c]
        left = x > F.lit(own[k - 1][1]) if k else F.lit(True)
        right = x < F.lit(own[k][0]) if k < len(own) else F.lit(True)
        key = f"{len(again)}"
        again[key] = (F.when(left & right, x), [(rank - r["off"]) / max(r["t"] - 1, 1)])
        name_of[key] = (c, rank)
    for key, values in quantiles(df, again, per_piece).items():
        found[name_of[key]] = values[0]
    return found


def order_statistics(df: DataFrame, wanted: dict[str, tuple[Column, list[int]]]) -> dict[str, list[float | None]]:
    """Values at 0-based ranks among the non-null values of each column."""
    n = collect_stats(df, {name: F.count(x) for name, (x, _) in wanted.items()})
    # A probability that lands exactly on a rank: the bracket search snaps to it.
    return quantiles(df, {name: (x, [r / max(n[name] - 1, 1) for r in rs]) for name, (x, rs) in wanted.items()})


def one_column(df: DataFrame, x: Column, probs: list[float]) -> list[float | None]:
    return quantiles(df, {"x": (x, probs)})["x"]


def smallest(df: DataFrame, order: Column, n: int, ties: list[Column]) -> DataFrame:
    """The ``n`` rows with the smallest ``order`` (a 64-bit hash), whatever n: rows below the n-th smallest value are filtered, and
    only rows that share that value are ordered, by ``order`` and ``ties``."""
    if n >= df.count():
        return df
    if n <= 0:
        return df.limit(0)
    x = order.cast("double")
    cut = F.lit(order_statistics(df, {"x": (x, [n - 1])})["x"][0])
    below = df.filter(x < cut)
    return below.unionByName(df.filter(x == cut).orderBy(order, *ties).limit(n - below.count()))
