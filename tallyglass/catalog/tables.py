"""Sources, sinks, projections and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.store import scratch
from ..operators import relational as rel
from ..sources import metadata, reports, tables as src
from .registry import query, rounded


# Events with missing values where the value is small: the same view on both engines.
def holed(t):
    return t.events.select("event_id", "ts", "user_id", F.expr("CASE WHEN value < 5 THEN NULL ELSE event_type END").alias("event_type"),
                           F.expr("CASE WHEN value < 10 THEN NULL ELSE value END").alias("value"))


HOLED = """(SELECT event_id, ts, user_id, CASE WHEN value < 5 THEN NULL ELSE event_type END AS event_type,
 CASE WHEN value < 10 THEN NULL ELSE value END AS value FROM events)"""


@query("io_scan", """SELECT p_brand, count(*) AS n, round(sum(p_retailprice), 4) AS total, CAST(max(p_size) AS BIGINT) AS max_size
 FROM part GROUP BY 1""")
def _(t):
    path = scratch(t.spark, "scan") + "/part.csv"
    src.write_table(t.part, path, "csv")
    back = src.read_table(t.spark, path, "csv")
    return rounded(back.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.sum("p_retailprice").alias("total"),
                                               F.max("p_size").cast("long").alias("max_size")), 4)


@query("io_multi", " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, count(*) AS n_rows FROM {n}" for n in ("nation", "region", "supplier", "customer")))
def _(t):
    found = src.read_tables(t.spark, t.folder, "parquet")
    parts = [found[n].agg(F.lit(n).alias("table_name"), F.count(F.lit(1)).alias("n_rows"))
             for n in ("nation", "region", "supplier", "customer")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("io_sample", "SELECT least(100, count(*)) AS n_rows, 2 AS n_columns, least(100, count(*)) AS n_matched FROM events")
def _(t):
    s = src.read_sample(t.events, ["event_id", "ts", "no_such_column"], n=100, key=["event_id"])
    known = s.join(t.events.select("event_id"), "event_id", "left_semi")
    return s.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(s.columns))).withColumn(
        "_k", F.lit(1)).join(known.agg(F.count(F.lit(1)).alias("n_matched")).withColumn("_k", F.lit(1)), "_k").drop("_k")


@query("io_shape", """SELECT count(*) AS n_rows, 5 AS n_columns, p AS position, c AS "column" FROM customer,
 (VALUES (0,'c_custkey'),(1,'c_name'),(2,'c_nationkey'),(3,'c_acctbal'),(4,'c_mktsegment')) v(p, c) GROUP BY 3, 4""")
def _(t):
    return src.shape(t.customer).drop("dtype")


@query("io_clean", """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts,
 CASE WHEN value < 10 THEN NULL WHEN value > 200 THEN NULL ELSE round(value, 6) END AS value FROM events""")
def _(t):
    bad = t.events.select("event_id", "ts", F.expr(
        "CASE WHEN value < 10 THEN double('NaN') WHEN value > 200 THEN double('Infinity') ELSE value END").alias("value"))
    return rounded(src.iso_times(src.clean_num(bad)))


@query("io_sink", "SELECT s_nationkey, count(*) AS n, round(sum(round(s_acctbal / 7, 6)), 4) AS total FROM supplier GROUP BY 1")
def _(t):
    path = scratch(t.spark, "sink")
    src.write_table(t.supplier.withColumn("s_acctbal", F.col("s_acctbal") / 7), path, "csv", decimals=src.FLOAT_DECIMALS)
    back = src.read_table(t.spark, path, "csv", schema=t.supplier.schema)
    return rounded(back.groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"), F.sum("s_acctbal").alias("total")), 4)


@query("io_report", "SELECT 'value' AS \"column\", count(*) AS n, round(avg(value), 6) AS mean FROM events")
def _(t):
    from ..operators.profile import profile_numeric

    root = scratch(t.spark, "reports")
    reports.save_report(profile_numeric(t.events, ["value"]), root, "profile", "events")
    reports.save_report(profile_numeric(t.orders, ["o_totalprice"]), root, "profile", "orders")
    return rounded(reports.load_report(t.spark, root, "profile", "events").select("column", "n", "mean"))


@query("io_metadata", """SELECT * FROM (VALUES ('o_orderkey','bigint','id','value'), ('o_custkey','bigint','numeric','value'),
 ('o_orderstatus','string','categorical','value'), ('o_totalprice','double','numeric','value'),
 ('o_orderdate','timestamp_ntz','datetime','sequence_index'), ('o_orderpriority','string','categorical','value'))
 v("column", dtype, kind, role) WHERE (SELECT count(DISTINCT o_orderkey) = count(*) FROM orders)""")
def _(t):
    return metadata.detect_metadata(t.orders, sequence_index="o_orderdate")


_FK = [("region", "r_regionkey", "nation", "n_regionkey"), ("nation", "n_nationkey", "customer", "c_nationkey"),
       ("nation", "n_nationkey", "supplier", "s_nationkey"), ("customer", "c_custkey", "orders", "o_custkey"),
       ("orders", "o_orderkey", "lineitem", "l_orderkey"), ("part", "p_partkey", "lineitem", "l_partkey"),
       ("supplier", "s_suppkey", "lineitem", "l_suppkey")]


@query("io_relations", " UNION ALL ".join(
    f"SELECT '{p}' AS parent_table, '{pc}' AS parent_column, '{c}' AS child_table, '{cc}' AS child_column "
    f"WHERE (SELECT count(*) FROM {c} WHERE {cc} NOT IN (SELECT {pc} FROM {p})) = 0 "
    f"AND (SELECT count(*) = count(DISTINCT {pc}) FROM {p})" for p, pc, c, cc in _FK))
def _(t):
    names = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
    return metadata.detect_relationships({n: getattr(t, n) for n in names})


@query("pf_keep", "SELECT s_suppkey, s_nationkey FROM supplier")
def _(t):
    return rel.keep(t.supplier, ["s_suppkey", "s_nationkey", "absent"])


@query("pf_drop", "SELECT s_suppkey, s_nationkey FROM supplier")
def _(t):
    return rel.drop(t.supplier, ["s_name", "s_acctbal", "absent"])


@query("pf_rename", "SELECT r_regionkey AS region_id, r_name AS region FROM region")
def _(t):
    return rel.rename(t.region, {"r_regionkey": "region_id", "r_name": "region", "absent": "x"})


@query("pf_cast", "SELECT p_partkey, CAST(p_size AS VARCHAR) AS p_size, p_brand FROM part")
def _(t):
    one = rel.cast(t.part.select("p_partkey", "p_size", "p_brand"), "p_size", "string")
    return rel.cast(one, "p_brand", "int")


@query("pf_derive", """SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net,
 l_quantity FROM lineitem""")
def _(t):
    return rounded(rel.derive(t.lineitem, "net", "l_extendedprice * (1 - l_discount)").select(
        "l_orderkey", "l_linenumber", "net", "l_quantity"), 4)


@query("pf_in", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def _(t):
    return rel.filter_in(t.orders, "o_orderpriority", ["1-URGENT", "2-HIGH"]).select("o_orderkey", "o_orderpriority")


@query("pf_search", "SELECT p_partkey, p_type FROM part WHERE contains(lower(p_type), 'an')")
def _(t):
    return rel.filter_search(t.part, "p_type", "AN").select("p_partkey", "p_type")


@query("pf_topn", """WITH top AS (SELECT p_brand FROM part GROUP BY 1 ORDER BY count(*) DESC, p_brand LIMIT 5)
 SELECT p_partkey, p_brand FROM part WHERE p_brand IN (SELECT p_brand FROM top)""")
def _(t):
    return rel.top_values(t.part, "p_brand", 5).select("p_partkey", "p_brand")


@query("pf_range", "SELECT event_id, value FROM events WHERE value BETWEEN 20 AND 60")
def _(t):
    return rel.filter_range(t.events, "value", 20, 60).select("event_id", "value")


@query("pf_tonum", """SELECT o_orderkey, TRY_CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS level,
 TRY_CAST(o_orderstatus AS DOUBLE) AS status FROM orders""")
def _(t):
    return t.orders.select("o_orderkey", rel.to_numeric(F.substring("o_orderpriority", 1, 1)).alias("level"),
                           rel.to_numeric(F.col("o_orderstatus")).alias("status"))
