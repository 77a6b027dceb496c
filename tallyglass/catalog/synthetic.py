"""Synthetic data and its evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import records
from ..operators.drift import similarity
from ..plans.recipe import Step, apply_recipe
from ..synthesis import evaluate as ev
from ..synthesis.bayesnet import PrivBayes
from ..synthesis.copula import GaussianCopula, MultiTable
from ..synthesis.sequence import SequenceSynth
from ..synthesis.tree import TreeSynth
from .drifts import NUMERIC, SIDES, SIMILAR, TEXTS, halves
from .registry import query, rounded


def people(t):
    return t.customer.select("c_custkey", "c_nationkey", "c_acctbal", F.expr("CASE WHEN c_acctbal < 0 THEN NULL ELSE c_mktsegment END").alias("c_mktsegment"))


@query("syn_copula")
def _(t):
    real = people(t)
    return GaussianCopula.fit(real, ids=["c_custkey"]).sample(real.count())


@query("syn_copula_quality")
def _(t):
    real = people(t).drop("c_custkey")
    return rounded(ev.evaluate(real, GaussianCopula.fit(real).sample(real.count())))


@query("syn_privbayes")
def _(t):
    real = people(t)
    return PrivBayes.fit(real, epsilon=2.0, ids=["c_custkey"]).sample(real.count())


@query("syn_tree")
def _(t):
    real = people(t)
    return TreeSynth.fit(real, ids=["c_custkey"]).sample(real.count())


@query("syn_sequence")
def _(t):
    e = t.events.select("user_id", "ts", "event_id", "event_type", "value")
    return SequenceSynth.fit(e, "user_id", "ts", tie="event_id").sample(20, 50)


@query("syn_multi", """SELECT 'orphans' AS "check", 0 AS n WHERE (SELECT count(*) FROM orders) > 0 UNION ALL SELECT 'repeated_keys', 0 UNION ALL SELECT 'parents', count(*) FROM customer""")
def _(t):
    tables = {"customer": people(t), "orders": t.orders}
    made = MultiTable.fit(tables, {"orders": ("o_custkey", "customer", "c_custkey")}, {"customer": "c_custkey", "orders": "o_orderkey"}).sample()
    parents, children = made["customer"], made["orders"]
    orphans = children.join(parents, F.col("o_custkey") == F.col("c_custkey"), "left_anti").agg(F.lit("orphans").alias("check"), F.count(F.lit(1)).alias("n"))
    repeated = children.agg(F.lit("repeated_keys").alias("check"), (F.count(F.lit(1)) - F.count_distinct("o_orderkey")).alias("n"))
    return orphans.unionByName(repeated).unionByName(parents.agg(F.lit("parents").alias("check"), F.count(F.lit(1)).alias("n")))


@query("syn_multi_between", """SELECT 'price' AS "column", true AS depends, true AS near UNION ALL SELECT 'noise', false, true""")
def _(t):
    """Share of a child column's variance between parents, drawn against real."""
    def share(df):
        out = {}
        for c in ("price", "noise"):
            per = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.avg(c).alias("m"), F.var_pop(c).alias("v"))
            r = per.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("g"), F.sum(F.col("n") * F.col("v")).alias("inside")).first()
            whole = df.agg(F.var_pop(c)).first()[0]
            out[c] = 1 - r["inside"] / (r["n"] - r["g"]) / whole  # unbiased for parents of few rows
        return out

    orders = t.orders.selectExpr("o_orderkey", "o_custkey", "o_totalprice * (1 + o_custkey % 5) AS price", "double(pmod(xxhash64(o_orderkey), 1000)) AS noise")
    made = MultiTable.fit({"customer": people(t), "orders": orders}, {"orders": ("o_custkey", "customer", "c_custkey")}, {"customer": "c_custkey", "orders": "o_orderkey"}).sample()
    real, drawn = share(orders.withColumnRenamed("o_custkey", "k")), share(made["orders"].withColumnRenamed("o_custkey", "k"))
    return records(t.spark, [(c, real[c] > 0.2, abs(real[c] - drawn[c]) < 0.1) for c in real], "column string, depends boolean, near boolean")


@query("syn_repair", """SELECT CAST(l_quantity AS BIGINT) AS l_quantity, CASE WHEN l_discount > 0.09 THEN NULL ELSE l_discount END AS l_discount, l_linenumber FROM lineitem""")
def _(t):
    d = t.lineitem.selectExpr("l_quantity", "CASE WHEN l_discount > 0.09 THEN double('Infinity') ELSE l_discount END AS l_discount", "l_linenumber")
    return ev.repair_types(d)


@query("syn_repair_like", "SELECT o_orderkey, o_custkey, round(o_totalprice, 2) AS o_totalprice FROM orders")
def _(t):
    d = t.orders.selectExpr("double(o_orderkey) + 0.2 AS o_orderkey", "string(o_custkey) AS o_custkey", "o_totalprice")
    return rounded(ev.repair_types(d, t.orders), 2)


@query("syn_from_recipe")
def _(t):
    real = people(t)
    safe, _ = apply_recipe(real, [Step("impute", "c_mktsegment", {"method": "mode"}), Step("log_transform", "c_nationkey"), Step("drop", "c_nationkey")])
    return GaussianCopula.fit(safe, ids=["c_custkey"]).sample(real.count())


# ---- evaluation over the two halves of the line items ----------------------

def _coded(c):
    return f"""(SELECT v, dense_rank() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT coalesce({c}, 'nan') AS v FROM (SELECT {c} FROM a UNION ALL SELECT {c} FROM b)))"""


_CODES = ", ".join(f"code_{c} AS {_coded(c)}" for c in TEXTS)


def _side(s):
    cols = ", ".join(NUMERIC) + ", " + ", ".join(f"(SELECT code FROM code_{c} WHERE v = coalesce({s}.{c}, 'nan')) AS {c}" for c in TEXTS)
    return f"e{s} AS (SELECT {cols} FROM {s})"


_ENCODED = f"WITH {SIDES}, {_CODES}, {_side('a')}, {_side('b')}"


def _cdf(c):
    return f"""(SELECT v, sum(a) OVER (ORDER BY v) / CAST(sum(a) OVER () AS DOUBLE) AS fa, sum(b) OVER (ORDER BY v) / CAST(sum(b) OVER () AS DOUBLE) AS fb, lead(v) OVER (ORDER BY v) AS nv FROM (
 SELECT v, sum(a) AS a, sum(b) AS b FROM (SELECT {c} AS v, 1 AS a, 0 AS b FROM ea UNION ALL SELECT {c}, 0, 1 FROM eb) WHERE v IS NOT NULL GROUP BY v))"""


_ALL = NUMERIC + TEXTS


@query("ev_encode", _ENCODED + " SELECT 'real' AS source, l_returnflag, l_linestatus, count(*) AS n FROM ea GROUP BY 2, 3 UNION ALL SELECT 'synthetic', l_returnflag, l_linestatus, count(*) FROM eb GROUP BY 2, 3")
def _(t):
    a, b = ev.encode_pair(*halves(t))
    count = lambda d, s: d.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n")).withColumn("source", F.lit(s))
    return count(a, "real").unionByName(count(b, "synthetic"))


@query("ev_ks", _ENCODED + " " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(max(abs(fa - fb)), 6) AS value FROM {_cdf(c)}" for c in _ALL))
def _(t):
    return rounded(ev.ks_by_column(*halves(t)))


@query("ev_wasserstein", _ENCODED + " " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(coalesce(sum(abs(fa - fb) * (nv - v)), 0), 4) AS value FROM {_cdf(c)}" for c in _ALL))
def _(t):
    return rounded(ev.wasserstein_by_column(*halves(t)), 4)


def _bins(c):
    if c in TEXTS:
        cell, lo = f"coalesce({c}, 'nan')", ""
    else:
        cell, lo = f"CAST(least(floor(({c} - lo) / ((hi - lo) / 20)), 19) AS VARCHAR)", f", (SELECT min(x) AS lo, max(x) AS hi FROM (SELECT {c} AS x FROM a UNION ALL SELECT {c} FROM b))"
    return f"""SELECT '{c}' AS "column", v, sum(p) AS p, sum(q) AS q FROM (SELECT {cell} AS v, 1.0 / (SELECT count({'*' if c in TEXTS else c}) FROM a) AS p, 0.0 AS q FROM a {lo}
 UNION ALL SELECT {cell}, 0.0, 1.0 / (SELECT count({'*' if c in TEXTS else c}) FROM b) FROM b {lo}) WHERE v IS NOT NULL GROUP BY v"""


_SHARED = f"WITH {SIDES}, s AS (SELECT \"column\", v, CAST(p AS DOUBLE) AS p, CAST(q AS DOUBLE) AS q FROM ({' UNION ALL '.join(_bins(c) for c in _ALL)}))"


@query("ev_js", _SHARED + """ SELECT "column", round(sqrt(sum((CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END) / 2)), 5) AS value FROM s GROUP BY 1""")
def _(t):
    return rounded(ev.js_by_column(*halves(t)), 5)


@query("ev_inv_kl", _SHARED + """ SELECT "column", round(1 / (1 + greatest(sum(greatest(p, 1e-10) * ln(greatest(p, 1e-10) / greatest(q, 1e-10))), 0)), 6) AS value FROM s GROUP BY 1""")
def _(t):
    return rounded(ev.inv_kl_by_column(*halves(t)))


@query("ev_mmd")
def _(t):
    return rounded(ev.mmd(*halves(t)))


@query("ev_all")
def _(t):
    return rounded(ev.evaluate(*halves(t)))


@query("ev_compare")
def _(t):
    real = people(t).drop("c_custkey")
    def broken(df):
        raise ValueError("a model that cannot be fitted")

    got = ev.compare_models(real, {"copula": GaussianCopula.fit, "privbayes": PrivBayes.fit, "broken": broken})
    return rounded(got.drop("seconds"))


@query("ev_best", f"""WITH {SIDES}, m AS (SELECT 'shifted' AS model, (SELECT avg(l_extendedprice) FROM b) / (SELECT avg(l_extendedprice) FROM a) - 1 AS s UNION ALL SELECT 'even', (SELECT avg(l_quantity) FROM b) / (SELECT avg(l_quantity) FROM a) - 1)
 SELECT model, round(abs(s), 6) AS score FROM m ORDER BY abs(s) LIMIT 1""")
def _(t):
    a, b = halves(t)
    row = lambda name, c: a.agg(F.avg(c).alias("x"), F.lit(1).alias("k")).join(b.agg(F.avg(c).alias("y"), F.lit(1).alias("k")), "k").select(
        F.lit(name).alias("model"), F.lit("success").alias("status"), F.abs(F.col("y") / F.col("x") - 1).alias("ks"),
        *[F.lit(None).cast("double").alias(m) for m in ("js", "wasserstein", "mmd")])
    failed = records(t.spark, [("broken", "failed:ValueError", 0.0, 0.0, 0.0, 0.0)], "model string, status string, ks double, js double, wasserstein double, mmd double")
    return rounded(ev.best_model(row("shifted", "l_extendedprice").unionByName(row("even", "l_quantity")).unionByName(failed)))


@query("ev_badges", f"""WITH {SIDES}, f AS (SELECT ({' + '.join(f"least(1.0, (SELECT count(DISTINCT {c}) FROM b) * 1.0 / (SELECT count(DISTINCT {c}) FROM a))" for c in NUMERIC)}) / 3 AS f,
 {' + '.join(f"(SELECT CASE WHEN count(DISTINCT {c}) <= 3 THEN 1 ELSE 0 END FROM b)" for c in _ALL)} AS few)
 SELECT CASE WHEN f > 0.8 THEN 'high' WHEN f > 0.5 THEN 'medium' ELSE 'low' END AS fidelity, 'low' AS privacy_risk, CASE WHEN few = 0 THEN 'no' WHEN few <= 2 THEN 'possible' ELSE 'likely' END AS mode_collapse FROM f""")
def _(t):
    a, b = halves(t)
    return ev.badges(b, a)


@query("ev_issues", SIMILAR + """, i AS (SELECT "column", CASE WHEN statistic > 0.3 THEN 'distribution_high' WHEN statistic > 0.15 THEN 'distribution_medium' END AS issue, statistic FROM ks
 UNION ALL SELECT "column", CASE WHEN statistic > CASE dof WHEN 1 THEN 6.634897 ELSE 9.21034 END THEN 'categorical_high' END, 0 FROM chi), g AS (SELECT * FROM i WHERE issue IS NOT NULL)
 SELECT issue, CASE WHEN issue = 'distribution_medium' THEN 'medium' ELSE 'high' END AS severity, string_agg("column", ',' ORDER BY "column") AS columns FROM g GROUP BY 1
 UNION ALL SELECT 'good', 'info', '' WHERE (SELECT count(*) FROM g) = 0""")
def _(t):
    return ev.quality_issues(similarity(*halves(t))).drop("mean_statistic")


# The p-value of two degrees of freedom is exp(-x / 2); the numeric part of the score is exact in SQL.
@query("ev_scores", SIMILAR + """, c AS (SELECT avg(least(1, exp(-statistic / 2) * 10)) AS c FROM chi),
 f AS (SELECT (SELECT avg(greatest(0, 1 - statistic)) FROM ks) * 0.7 + c * 0.3 AS f FROM c), p AS (SELECT f, 0.85 + (1 - f) * 0.15 AS p FROM f), u AS (SELECT f, p, f * 0.8 + p * 0.2 AS u FROM p)
 SELECT round(f, 3) AS fidelity, round(p, 3) AS privacy, round(u, 3) AS utility, round(f * 0.9, 3) AS correlation, round(f, 3) AS distribution, CAST(0.8 AS DOUBLE) AS diversity,
 round(f * 0.35 + p * 0.20 + u * 0.25 + f * 0.09 + 0.08, 3) AS overall FROM u""")
def _(t):
    a, b = halves(t)
    return rounded(ev.similarity_scores(a, b), 3)
