"""Transforms and recipes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import transforms as tf
from ..plans.recipe import Step, apply_recipe, recipe_summary, steps_of
from .registry import query, rounded
from .outlier_repairs import _BOXCOX, _grid
from .tables import HOLED, holed

_E = f"WITH e AS {HOLED} "


def _simple(name, action, sql, out=None, decimals=6, table=holed, key="event_id", col="value", **params):
    @query(name, sql)
    def _(t):
        got = tf.apply_op(table(t), action, col, **params)
        return rounded(got.select(key, out or got.columns[-1]), decimals)


_simple("tf_impute_mean", "impute", _E + "SELECT event_id, round(coalesce(value, (SELECT avg(value) FROM e)), 6) AS value FROM e", "value", method="mean")
_simple("tf_impute_median", "impute", _E + "SELECT event_id, round(coalesce(value, (SELECT median(value) FROM e)), 6) AS value FROM e", "value", method="median")
_simple("tf_impute_mode", "impute", _E + "SELECT event_id, coalesce(event_type, (SELECT event_type FROM e WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, event_type LIMIT 1)) AS event_type FROM e",
        "event_type", col="event_type", method="mode")
_simple("tf_impute_const", "impute", _E + "SELECT event_id, coalesce(event_type, 'unknown') AS event_type FROM e", "event_type", col="event_type", method="value", value="unknown")
_simple("tf_ffill", "forward_fill", _E + "SELECT event_id, last_value(value IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM e", "value", order_by=["ts", "event_id"])
_simple("tf_bfill", "backward_fill", _E + "SELECT event_id, first_value(value IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS value FROM e", "value", order_by=["ts", "event_id"])
_simple("tf_ffill_by", "forward_fill", _E + "SELECT event_id, last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM e", "value",
        order_by=["ts", "event_id"], group=["user_id"])
_PART = lambda t: t.part
_simple("tf_top_categories", "top_categories", """WITH top AS (SELECT p_name FROM part GROUP BY 1 ORDER BY count(*) DESC, p_name LIMIT 10)
 SELECT p_partkey, CASE WHEN p_name IN (SELECT p_name FROM top) THEN p_name ELSE 'Other' END AS p_name FROM part""", "p_name", table=_PART, key="p_partkey", col="p_name")


_LEVELS = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


def _hot(levels):
    return "SELECT p_partkey, " + ", ".join(f"p_type = '{v}' AS \"p_type_{v}\"" for v in levels) + " FROM part"


@query("tf_onehot", _hot(_LEVELS[1:]))
def _(t):
    return tf.apply_op(t.part.select("p_partkey", "p_type"), "encode", "p_type")


@query("tf_onehot_full", _hot(_LEVELS))
def _(t):
    return tf.apply_op(t.part.select("p_partkey", "p_type"), "encode", "p_type", drop_first=False)


_simple("tf_label", "label_encode", _E + """, l AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS code FROM (SELECT DISTINCT event_type FROM e WHERE event_type IS NOT NULL))
 SELECT event_id, coalesce(code, -1) AS event_type_le FROM e LEFT JOIN l USING (event_type)""", "event_type_le", col="event_type")
_simple("tf_freq", "freq_encode", _E + """SELECT event_id, round(CASE WHEN event_type IS NOT NULL THEN count(event_type) OVER (PARTITION BY event_type) * 1.0 / count(event_type) OVER () END, 6) AS event_type_freq FROM e""",
        "event_type_freq", col="event_type")
_simple("tf_generalize", "generalize", """SELECT doc_id, CASE WHEN c < 60 THEN 'Other' ELSE source END AS source_generalized FROM (SELECT doc_id, source, count(*) OVER (PARTITION BY source) AS c FROM documents)""",
        "source_generalized", table=lambda t: t.documents, key="doc_id", col="source", min_frequency=60)


@query("tf_generalize_rare", """SELECT conv_id, turn, CASE WHEN count(*) OVER (PARTITION BY text) < 2 THEN 'Other' ELSE text END AS text_generalized FROM conversations""")
def _(t):
    return tf.apply_op(t.conversations, "generalize", "text", min_frequency=2).select("conv_id", "turn", "text_generalized")


_WIDTH = "CASE WHEN value IS NULL THEN NULL " + " ".join(f"WHEN value <= lo + (hi - lo) * {i + 1} / 4 THEN {i}" for i in range(3)) + " ELSE 3 END"
_simple("tf_bin", "bin", _E + f", c AS (SELECT min(value) AS lo, max(value) AS hi FROM e) SELECT event_id, {_WIDTH} AS value_bin FROM e, c", "value_bin")
_Q4 = ", ".join(f"quantile_cont(value, {i / 4!r}) AS e{i}" for i in range(5))
_simple("tf_quartile", "quartile_bin", _E + f", c AS (SELECT {_Q4} FROM e) SELECT event_id, CASE WHEN value IS NULL THEN NULL WHEN value <= e1 THEN 'Q1' WHEN value <= e2 THEN 'Q2' WHEN value <= e3 THEN 'Q3' ELSE 'Q4' END AS value_bin FROM e, c", "value_bin")
_simple("tf_log", "log_transform", _E + "SELECT event_id, round(ln(1 + value), 6) AS value_log FROM e")
_simple("tf_sqrt", "sqrt_transform", _E + "SELECT event_id, round(sqrt(value), 6) AS value_sqrt FROM e")
_simple("tf_standard", "standard_scaler", _E + "SELECT event_id, round((value - (SELECT avg(value) FROM e)) / (SELECT stddev_pop(value) FROM e), 6) AS value_scaled FROM e")
_simple("tf_zscore", "zscore", _E + "SELECT event_id, round((value - (SELECT avg(value) FROM e)) / (SELECT stddev(value) FROM e), 6) AS value_zscore FROM e")
_simple("tf_robust", "robust_scaler", _E + "SELECT event_id, round((value - (SELECT median(value) FROM e)) / (SELECT quantile_cont(value, 0.75) - quantile_cont(value, 0.25) FROM e), 6) AS value_robust FROM e")
_simple("tf_minmax", "minmax_scaler", _E + "SELECT event_id, round((value - (SELECT min(value) FROM e)) / (SELECT max(value) - min(value) FROM e), 6) AS value_minmax FROM e")
_simple("tf_inverse", "inverse", "SELECT p_partkey, round(1.0 / p_size, 6) AS p_size_inv FROM part", table=_PART, key="p_partkey", col="p_size")


@query("tf_poly", "SELECT p_partkey, CAST(p_size AS DOUBLE) * p_size AS p_size_squared, CAST(p_size AS DOUBLE) * p_size * p_size AS p_size_cubed FROM part")
def _(t):
    return tf.apply_op(tf.apply_op(t.part.select("p_partkey", "p_size"), "square", "p_size"), "cube", "p_size").drop("p_size")


_simple("tf_rank", "rank", _E + "SELECT event_id, CASE WHEN value IS NOT NULL THEN rank() OVER (ORDER BY value NULLS LAST) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 END AS value_rank FROM e", "value_rank")
_simple("tf_outlier_flag", "outlier_flag", _E + "SELECT event_id, coalesce(abs((value - (SELECT avg(value) FROM e)) / (SELECT stddev(value) FROM e)) > 3, false) AS value_outlier FROM e")


@query("tf_interaction", "SELECT event_id, round(ln(1 + value) * value, 6) AS value_x_log_value FROM events")
def _(t):
    got = tf.interactions(t.events.select("event_id", "user_id", "value", F.log1p("value").alias("log_value")), cols=["user_id", "value", "log_value"])
    return rounded(got.drop("user_id", "value", "log_value"))


@query("tf_text", r"""SELECT doc_id, CAST(length(text) AS INTEGER) AS text_len, CASE WHEN trim(regexp_replace(text, '\s+', ' ', 'g')) = '' THEN 0
 ELSE CAST(len(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')) AS INTEGER) END AS text_wordcount FROM documents""")
def _(t):
    return tf.apply_op(tf.apply_op(t.documents.select("doc_id", "text"), "text_length", "text"), "word_count", "text").drop("text")


@query("tf_tfidf")
def _(t):
    from pyspark.ml.functions import vector_to_array

    emb = tf.apply_op(t.documents.select("doc_id", "text"), "tfidf", "text")
    return rounded(emb.select("doc_id", F.aggregate(vector_to_array("text_emb"), F.lit(0.0), lambda a, x: a + x).alias("weight")))


_simple("tf_redact", "redact", "SELECT c_custkey, '[REDACTED]' AS c_name FROM customer", "c_name", table=lambda t: t.customer, key="c_custkey", col="c_name")
_simple("tf_hash", "hash", "SELECT doc_id, sha256(concat('salt', text)) AS text_hashed FROM documents", table=lambda t: t.documents, key="doc_id", col="text", salt="salt")
_simple("tf_hash_null", "hash", _E + "SELECT event_id, sha256(event_type) AS event_type_hashed FROM e", col="event_type")
_simple("tf_mask", "mask", """SELECT doc_id, concat(substr(text, 1, length(text) - CAST(floor(length(text) * 0.5) AS BIGINT)), repeat('*', CAST(floor(length(text) * 0.5) AS BIGINT))) AS text_masked FROM documents""",
        table=lambda t: t.documents, key="doc_id", col="text")
_YEO = "CASE WHEN g = 0 THEN ln(1 + x) ELSE (power(x + 1, g) - 1) / CASE WHEN g = 0 THEN 1 ELSE g END END"
_simple("tf_power", "power_transform", f"""WITH d AS (SELECT event_id, value AS x FROM events), {_grid('d', _YEO, 'ln(1 + x)')},
 y AS (SELECT event_id, (power(x + 1, best) - 1) / best AS y FROM d, bl) SELECT event_id, round((y - (SELECT avg(y) FROM y)) / (SELECT stddev_pop(y) FROM y), 5) AS value_power FROM y""",
        decimals=5, table=lambda t: t.events)


# ---- recipes ---------------------------------------------------------------

_STEPS = [
    {"action": "impute", "column": "value", "params": {"method": "median"}, "category": "utility"},
    {"action": "log_transform", "column": "value", "category": "utility"},
    {"action": "standard_scaler", "column": "user_id"},
    {"action": "minmax_scaler", "column": "value_log"},
    {"action": "impute", "column": "event_type", "method": "value", "value": "unknown"},
    {"action": "mask", "column": "event_type", "params": {"mask_percentage": 0.4}, "category": "privacy"},
    {"action": "hash", "column": "user_text", "category": "privacy"},
    {"action": "rename", "column": "user_id", "params": {"to": "uid"}},
    {"action": "drop", "column": "user_text"},
    {"action": "log_transform", "column": "shifted"},
    {"action": "sqrt_transform", "column": "event_type"},
    {"action": "robust_scaler", "column": "no_such"},
    {"action": "explode", "column": "value"},
]
_REASONS = {9: "negative_values", 10: "not_numeric", 11: "missing_column", 12: "unknown_action"}


def recipe_input(t):
    return holed(t).select("event_id", "user_id", "event_type", "value", F.col("user_id").cast("string").alias("user_text"), (F.col("value") - 50).alias("shifted"))


@query("recipe_apply", _E + """, m AS (SELECT event_id, user_id, coalesce(event_type, 'unknown') AS event_type, coalesce(value, (SELECT median(value) FROM e)) AS value, value - 50 AS shifted FROM e),
 l AS (SELECT *, ln(1 + value) AS value_log FROM m)
 SELECT event_id, user_id AS uid, event_type, round(value, 6) AS value, round(shifted, 6) AS shifted, round(value_log, 6) AS value_log,
 round((user_id - (SELECT avg(user_id) FROM e)) / (SELECT stddev_pop(user_id) FROM e), 6) AS user_id_scaled,
 round((value_log - (SELECT min(value_log) FROM l)) / (SELECT max(value_log) - min(value_log) FROM l), 6) AS value_log_minmax,
 concat(substr(event_type, 1, length(event_type) - CAST(floor(length(event_type) * 0.4) AS BIGINT)), repeat('*', CAST(floor(length(event_type) * 0.4) AS BIGINT))) AS event_type_masked,
 sha256(CAST(user_id AS VARCHAR)) AS user_text_hashed FROM l""")
def _(t):
    return rounded(apply_recipe(recipe_input(t), steps_of(_STEPS), on_error="skip", unprotected=True)[0])


@query("recipe_log", "SELECT * FROM (VALUES " + ", ".join(
    f"({i}, '{s['action']}', '{s['column']}', '{'skipped' if i in _REASONS else 'applied'}', {repr(_REASONS[i]) if i in _REASONS else 'NULL'})"
    for i, s in enumerate(_STEPS)) + ") v(position, action, \"column\", status, reason) WHERE (SELECT min(value) - 50 < 0 FROM events)")
def _(t):
    return apply_recipe(recipe_input(t), steps_of(_STEPS), dry_run=True, on_error="skip")[1].drop("category", "output")


@query("recipe_summary", """SELECT 13 AS n_steps, 9 AS n_applied, 4 AS n_skipped, 'event_type,user_id,user_text,value,value_log' AS columns_modified WHERE (SELECT min(value) - 50 < 0 FROM events)""")
def _(t):
    return recipe_summary(apply_recipe(recipe_input(t), steps_of(_STEPS), on_error="skip", unprotected=True)[1])


@query("recipe_features", """WITH c AS (SELECT p_type, count(*) * 1.0 / (SELECT count(*) FROM part) AS f FROM part GROUP BY 1),
 q AS (SELECT quantile_cont(p_size, 0.25) AS a, median(p_size) AS b, quantile_cont(p_size, 0.75) AS c FROM part)
 SELECT p_partkey, round(f, 6) AS p_type_freq, CAST(p_size AS DOUBLE) * p_size AS p_size_squared, CAST(length(p_name) AS INTEGER) AS p_name_len,
 CASE WHEN p_size <= a THEN 'Q1' WHEN p_size <= b THEN 'Q2' WHEN p_size <= c THEN 'Q3' ELSE 'Q4' END AS p_size_bin FROM part JOIN c USING (p_type), q""")
def _(t):
    steps = [Step("freq_encode", "p_type"), Step("square", "p_size"), Step("text_length", "p_name"), Step("quartile_bin", "p_size")]
    return rounded(apply_recipe(t.part, steps)[0].select("p_partkey", "p_type_freq", "p_size_squared", "p_name_len", "p_size_bin"))
