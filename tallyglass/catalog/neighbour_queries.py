"""Neighbour and forest detectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import isolation, neighbours as nb
from .registry import query, rounded
from .tables import HOLED, holed

_POINTS = """p AS (SELECT x, y, count(*) AS w FROM (SELECT (c_nationkey - (SELECT avg(c_nationkey) FROM customer)) / (SELECT stddev_pop(c_nationkey) FROM customer) AS x,
 (c_acctbal - (SELECT avg(c_acctbal) FROM customer)) / (SELECT stddev_pop(c_acctbal) FROM customer) AS y FROM customer) GROUP BY 1, 2),
 i AS (SELECT row_number() OVER (ORDER BY x, y) AS id, * FROM p),
 d AS (SELECT a.id, b.id AS nid, CASE WHEN a.id = b.id THEN 0 ELSE round(sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)), 9) END AS d, CASE WHEN a.id = b.id THEN b.w - 1 ELSE b.w END AS w FROM i a, i b),
 c AS (SELECT *, sum(w) OVER (PARTITION BY id ORDER BY d RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM d WHERE w > 0),
 kd AS (SELECT id, min(d) AS kd FROM c WHERE cum >= 20 GROUP BY 1), n AS (SELECT c.id, nid, d, w FROM c JOIN kd USING (id) WHERE d <= kd),
 l AS (SELECT n.id, 1 / (sum(w * greatest(kd, d)) / sum(w) + 1e-10) AS lrd FROM n JOIN kd ON nid = kd.id GROUP BY 1),
 f AS (SELECT n.id, sum(w * b.lrd) / sum(w) / any_value(a.lrd) AS lof FROM n JOIN l b ON nid = b.id JOIN l a ON n.id = a.id GROUP BY n.id)"""


@query("out_lof", f"""WITH {_POINTS}, s AS (SELECT c_custkey, lof FROM customer JOIN i ON i.x = (c_nationkey - (SELECT avg(c_nationkey) FROM customer)) / (SELECT stddev_pop(c_nationkey) FROM customer)
 AND i.y = (c_acctbal - (SELECT avg(c_acctbal) FROM customer)) / (SELECT stddev_pop(c_acctbal) FROM customer) JOIN f USING (id))
 SELECT c_custkey, round(lof, 5) AS lof, lof > (SELECT quantile_cont(lof, 0.9) FROM s) AS lof_outlier FROM s""")
def _(t):
    return rounded(nb.lof(t.customer, ["c_nationkey", "c_acctbal"]).select("c_custkey", "lof", "lof_outlier"), 5)


@query("out_lof_stats")
def _(t):
    return rounded(isolation.score_stats(nb.lof(t.events, ["user_id", "value"]), "lof", "lof_outlier"), 5)


@query("out_iforest")
def _(t):
    return rounded(isolation.isolation_forest(t.events.select("event_id", "user_id", "value"), ["event_id"], ["user_id", "value"]))


@query("out_iforest_stats")
def _(t):
    return rounded(isolation.score_stats(isolation.isolation_forest(t.documents.select("doc_id", "n_chars"), ["doc_id"], ["n_chars"]), "score", "iforest_outlier"))


# Price band known for dear parts only: the others take the mean of their nearest sizes.
@query("tf_impute_knn", """WITH m AS (SELECT p_partkey, p_size, CASE WHEN p_brand = 'Brand#1' THEN NULL ELSE p_retailprice END AS price FROM part),
 k AS (SELECT p_size, count(*) AS w, avg(price) AS v FROM m WHERE price IS NOT NULL GROUP BY 1), h AS (SELECT DISTINCT p_size FROM m WHERE price IS NULL),
 s AS (SELECT stddev_pop(p_size) AS s FROM part), d AS (SELECT h.p_size, round(abs(h.p_size - k.p_size) / s, 9) AS d, w, v FROM h, k, s),
 c AS (SELECT *, sum(w) OVER (PARTITION BY p_size ORDER BY d RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM d),
 kd AS (SELECT p_size, min(d) AS kd FROM c WHERE cum >= 3 GROUP BY 1), f AS (SELECT c.p_size, sum(w * v) / sum(w) AS v FROM c JOIN kd USING (p_size) WHERE d <= kd GROUP BY 1)
 SELECT p_partkey, round(coalesce(price, v), 4) AS price FROM m LEFT JOIN f USING (p_size)""")
def _(t):
    m = t.part.select("p_partkey", "p_size", F.expr("CASE WHEN p_brand = 'Brand#1' THEN NULL ELSE p_retailprice END").alias("price"))
    return rounded(nb.impute_knn(m, "price", ["p_size"]).select("p_partkey", "price"), 4)


@query("tf_impute_knn_single", f"WITH e AS {HOLED} SELECT event_id, round(coalesce(value, (SELECT avg(value) FROM e)), 6) AS value FROM e")
def _(t):
    return rounded(nb.impute_knn(holed(t).select("event_id", "value"), "value"))
