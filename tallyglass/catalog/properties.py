"""Properties of results that SQL cannot recompute: trained models, random draws, iterative fits.  Each query measures the
property on the whole result; its twin takes sizes and levels from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.quantiles import one_column
from ..functions.store import materialise
from ..operators import isolation, neighbours as nb, remediation as rem, transforms as tf
from ..operators.drift import analyze, drift_classifier
from ..plans import suggest
from ..plans.recipe import Step, apply_recipe
from ..synthesis import evaluate as ev
from ..synthesis.bayesnet import PrivBayes
from ..synthesis.copula import GaussianCopula
from ..synthesis.sequence import SequenceSynth
from ..synthesis.tree import TreeSynth
from .drifts import halves
from .registry import query
from .synthetic import people
from .tables import HOLED, holed

#: A generated column may differ from the real one by this Kolmogorov-Smirnov distance at most.
CLOSE, CLOSE_PRIVATE = 0.1, 0.3

_PEOPLE = """SELECT count(*) AS n_rows, count(DISTINCT c_mktsegment) FILTER (WHERE c_acctbal >= 0) AS n_levels, count(DISTINCT c_custkey) AS n_ids, true AS levels_known, true AS in_range,
 true AS close, true AS nulls_close FROM customer"""


def _measured(real, made, limit):
    """Rows, levels, distinct ids; whether levels and ranges are those of the real table, distributions and null shares near."""
    level = real.select("c_mktsegment").filter("c_mktsegment IS NOT NULL").distinct()
    strange = made.select("c_mktsegment").filter("c_mktsegment IS NOT NULL").join(level, "c_mktsegment", "left_anti").limit(1).count()
    r, m = (t.agg(F.count(F.lit(1)).alias("n"), F.min("c_acctbal").alias("lo"), F.max("c_acctbal").alias("hi"), F.count_if(F.col("c_mktsegment").isNull()).alias("nulls"),
                  F.count_distinct("c_mktsegment").alias("levels"), F.count_distinct("c_custkey").alias("ids")).first() for t in (real, made))
    far = ev.ks_by_column(real.select("c_acctbal"), made.select("c_acctbal")).first()["value"]
    slack = 0.01 * (r["hi"] - r["lo"])
    row = (m["n"], m["levels"], m["ids"], not strange, bool(r["lo"] - slack <= m["lo"] and m["hi"] <= r["hi"] + slack), bool(far <= limit),
           abs(r["nulls"] / r["n"] - m["nulls"] / m["n"]) <= limit)
    return real.sparkSession.createDataFrame([row], "n_rows long, n_levels long, n_ids long, levels_known boolean, in_range boolean, close boolean, nulls_close boolean")


@query("syn_copula_fit", _PEOPLE)
def _(t):
    real = people(t)
    return _measured(real, GaussianCopula.fit(real, ids=["c_custkey"]).sample(real.count()), CLOSE)


@query("syn_privbayes_fit", _PEOPLE)
def _(t):
    real = people(t)
    return _measured(real, PrivBayes.fit(real, epsilon=20.0, ids=["c_custkey"]).sample(real.count()), CLOSE_PRIVATE)


@query("syn_tree_fit", _PEOPLE)
def _(t):
    real = people(t)
    return _measured(real, TreeSynth.fit(real, ids=["c_custkey"]).sample(real.count()), CLOSE)


@query("syn_sequence_fit", "SELECT 20 AS n_series, 1000 AS n_rows, count(DISTINCT event_type) AS n_levels, true AS in_range FROM events")
def _(t):
    e = t.events.select("user_id", "ts", "event_id", "event_type", "value")
    made = SequenceSynth.fit(e, "user_id", "ts", tie="event_id").sample(20, 50)
    lo, hi = e.agg(F.min("value"), F.max("value")).first()
    return made.agg(F.count_distinct("user_id").alias("n_series"), F.count(F.lit(1)).alias("n_rows"), F.count_distinct("event_type").alias("n_levels"),
                    (F.min("value").between(2 * lo - hi, hi) & F.max("value").between(lo, 2 * hi - lo)).alias("in_range"))


@query("rem_bin_kmeans_fit", f"WITH e AS {HOLED} SELECT count(value) AS n, 0 AS misplaced, true AS ordered FROM e")
def _(t):
    """Every value lies in the bin whose mean is nearest (ties either way) and bins don't overlap."""
    binned = rem.bin(holed(t), "value", "kmeans").filter("value IS NOT NULL").select("value", F.col("value_binned").alias("b"))
    bins = binned.groupBy("b").agg(F.avg("value").alias("m"), F.min("value").alias("lo"), F.max("value").alias("hi")).orderBy("m").collect()  # one row per bin
    ordered = all(a["hi"] <= b["lo"] for a, b in zip(bins, bins[1:]))
    own = F.coalesce(*[F.when(F.col("b") == F.lit(r["b"]), F.abs(F.col("value") - F.lit(r["m"]))) for r in bins])
    best = F.least(*[F.abs(F.col("value") - F.lit(r["m"])) for r in bins])
    slack = 1e-3 * (bins[-1]["hi"] - bins[0]["lo"])
    return binned.agg(F.count(F.lit(1)).alias("n"), F.count_if(own > best + F.lit(slack)).alias("misplaced"), F.lit(bool(ordered)).alias("ordered"))


@query("out_iforest_fit", "SELECT count(*) AS n, true AS share_right, true AS scores_valid, true AS extreme_flagged FROM events")
def _(t):
    got = isolation.isolation_forest(t.events.select("event_id", "user_id", "value"), ["event_id"], ["user_id", "value"])
    return got.agg(F.count(F.lit(1)).alias("n"), F.count_if("iforest_outlier").between(1, F.ceil(F.count(F.lit(1)) * 0.1)).alias("share_right"),
                   (F.min("score").between(0, 1) & F.max("score").between(0, 1)).alias("scores_valid"), F.max_by("iforest_outlier", "value").alias("extreme_flagged"))


@query("out_lof_fit", "SELECT count(*) AS n, true AS share_right, true AS centred, true AS extreme_flagged FROM events")
def _(t):
    # written: the median takes two scans, and a median aggregate would hold every score in one task
    got = materialise(nb.lof(t.events, ["user_id", "value"]).select("value", "lof", "lof_outlier"), "lof-rows")
    middle = one_column(got, F.col("lof"), [0.5])[0]
    return got.agg(F.count(F.lit(1)).alias("n"), F.count_if("lof_outlier").between(1, F.ceil(F.count(F.lit(1)) * 0.1)).alias("share_right"),
                   F.lit(middle).between(0.9, 1.2).alias("centred"), F.max_by("lof_outlier", "value").alias("extreme_flagged"))


@query("drift_classifier_none", "SELECT false AS drift, true AS near_chance WHERE (SELECT count(*) FROM lineitem) > 0")
def _(t):
    a, b = halves(t)
    both = a.unionByName(b)
    coin = F.pmod(F.xxhash64(*both.columns), F.lit(2)) == 0
    return drift_classifier(both.filter(coin), both.filter(~coin)).select((F.col("auc") > 0.6).alias("drift"), F.col("auc").between(0.4, 0.6).alias("near_chance")).limit(1)


@query("drift_classifier_shift", """SELECT 'l_extendedprice' AS strongest, true AS drift, true AS right_more_often, true AS agrees WHERE (SELECT count(*) FROM lineitem) > 0""")
def _(t):
    """A price that is tripled must be found, alone and among all methods."""
    a, b = halves(t)
    b = b.withColumn("l_extendedprice", F.col("l_extendedprice") * 3)
    got = drift_classifier(a, b, trees=20)
    every = analyze(a, b, methods=["ks", "classifier"])
    flagged = every.filter("method = 'classifier'").agg(F.bool_and("drift").alias("agrees"))
    return got.agg(F.max_by("column", "importance").alias("strongest"), F.bool_and("drift").alias("drift"), (F.max("accuracy") > 0.6).alias("right_more_often")).crossJoin(flagged)


@query("ev_compare_valid", """SELECT 'broken' AS model, false AS fitted, false AS measured UNION ALL SELECT 'copula', true, true UNION ALL SELECT 'privbayes', true, true""")
def _(t):
    """Every model has a row; those that fit have all distances, finite and at least 0, the other none."""
    def broken(df):
        raise ValueError("a model that cannot be fitted")

    got = ev.compare_models(people(t).drop("c_custkey"), {"copula": GaussianCopula.fit, "privbayes": PrivBayes.fit, "broken": broken})
    valid = [F.coalesce((F.col(m) >= 0) & ~F.isnan(m) & (F.col(m) < float("inf")), F.lit(False)) for m in ev.METRICS]
    return got.select("model", (F.col("status") == "success").alias("fitted"), F.forall(F.array(*valid), lambda v: v).alias("measured"))


@query("sug_importance_fit", "SELECT true AS finds_the_cause, true AS sums_to_one WHERE (SELECT count(*) FROM part) > 0")
def _(t):
    p = t.part.select("p_size", "p_retailprice", (F.col("p_size") > 25).cast("int").alias("large"))
    got = suggest.feature_importance(p, "large")
    return got.agg((F.max_by("feature", "importance") == "p_size").alias("finds_the_cause"), F.sum("importance").between(0.99, 1.01).alias("sums_to_one"))


@query("tf_tfidf_terms", r"""SELECT doc_id, len(list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> ''))) >= 1 AS has_terms FROM documents""")
def _(t):
    from pyspark.ml.functions import vector_to_array

    emb = tf.apply_op(t.documents.select("doc_id", "text"), "tfidf", "text")
    return emb.select("doc_id", F.exists(vector_to_array("text_emb"), lambda x: x > 0).alias("has_terms"))


@query("syn_pipeline", """SELECT count(*) AS n_rows, count(DISTINCT c_custkey) AS n_ids, 'c_acctbal,c_custkey,c_mktsegment,c_nationkey_log' AS columns,
 count(DISTINCT c_mktsegment) FILTER (WHERE c_acctbal >= 0) AS n_levels, 0 AS n_missing FROM customer""")
def _(t):
    """Recipe, fit and draw in one call: the imputed, transformed and dropped columns show in the drawn table."""
    real = people(t)
    safe, _ = apply_recipe(real, [Step("impute", "c_mktsegment", {"method": "mode"}), Step("log_transform", "c_nationkey"), Step("drop", "c_nationkey")])
    made = GaussianCopula.fit(safe, ids=["c_custkey"]).sample(real.count())
    return made.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("c_custkey").alias("n_ids"), F.lit(",".join(sorted(made.columns))).alias("columns"),
                    F.count_distinct("c_mktsegment").alias("n_levels"), F.count_if(F.col("c_mktsegment").isNull()).alias("n_missing"))
