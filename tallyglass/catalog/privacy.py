"""Personal data, k-anonymity and functional dependencies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import anonymity as anon, dependencies as dep, pii
from .registry import query, rounded
from .tables import HOLED, holed


def _count(c, rx):
    return f"coalesce(sum(len(regexp_extract_all({c}, '{rx}'))), 0)"


def _values(table, c):
    return " UNION ALL ".join(f"""SELECT '{c}' AS "column", '{t}' AS pii_type, count({c}) AS n_values, CAST({_count(c, rx)} AS BIGINT) AS n_matches FROM {table}"""
                              for t, rx in pii.PATTERNS.items())


@query("pii_values", _values("documents", "text") + " UNION ALL " + _values("conversations", "text"))
def _(t):
    return pii.pii_by_value(t.documents, ["text"]).unionByName(pii.pii_by_value(t.conversations, ["text"]))


# customer with a contact text, so that name rules and value patterns both fire
_CONTACT = """CASE WHEN c_nationkey < 5 THEN concat('mail c', CAST(c_custkey AS VARCHAR), '@example.com now') WHEN c_nationkey < 8 THEN concat('host 10.0.0.', CAST(c_nationkey AS VARCHAR))
 WHEN c_nationkey = 9 THEN NULL ELSE 'call desk' END"""


def contacts(t):
    return t.customer.select("c_custkey", "c_name", "c_mktsegment", "c_nationkey", F.expr(_CONTACT.replace("VARCHAR", "STRING")).alias("contact"))


_SCAN = f"""c AS (SELECT c_custkey, c_name, c_mktsegment, c_nationkey, {_CONTACT} AS contact FROM customer),
 v AS ({_values('c', 'contact')} UNION ALL {_values('c', 'c_name')} UNION ALL {_values('c', 'c_mktsegment')}),
 f AS (SELECT "column", string_agg(pii_type, ',' ORDER BY list_position([{", ".join(repr(k) for k in pii.PATTERNS)}], pii_type)) AS types, sum(n_matches) AS m, max(n_values) AS n FROM v WHERE n_matches > 0 GROUP BY 1),
 names("column", types) AS (VALUES ('c_name', 'NAME')),
 s AS (SELECT coalesce(f."column", names."column") AS "column", concat_ws(',', names.types, f.types) AS pii_types,
  greatest(CASE WHEN names.types IS NULL THEN 0 ELSE 0.7 END, coalesce(least(coalesce(m * 1.0 / n, 0), 0.95), 0)) AS confidence, CAST(coalesce(m, 0) AS BIGINT) AS match_count,
  concat_ws(',', CASE WHEN names.types IS NOT NULL THEN 'column_name' END, CASE WHEN f.types IS NOT NULL THEN 'pattern_match' END) AS methods
  FROM f FULL JOIN names ON f."column" = names."column")"""


@query("pii_scan", f"WITH {_SCAN} SELECT \"column\", pii_types, round(CAST(confidence AS DOUBLE), 6) AS confidence, match_count, methods FROM s")
def _(t):
    return rounded(pii.pii_scan(contacts(t)))


@query("pii_summary", f"""WITH {_SCAN} SELECT 5 AS total_columns, count(*) AS columns_with_pii, string_agg("column", ',' ORDER BY "column") AS high_risk_columns,
 CASE WHEN count(*) > 0 THEN 'HIGH' END AS priority, CASE WHEN count(CASE WHEN pii_types LIKE '%EMAIL%' OR pii_types LIKE '%SSN%' THEN 1 END) > 0 THEN 'CRITICAL' END AS direct_identifier_priority FROM s""")
def _(t):
    return pii.pii_summary(contacts(t))


@query("pii_findings", " UNION ALL ".join(f"""SELECT doc_id, 'text' AS "column", '{p}' AS pii_type, unnest(regexp_extract_all(text, '{rx}')) AS "match" FROM documents""" for p, rx in pii.PATTERNS.items()))
def _(t):
    return pii.pii_findings(t.documents, ["text"], ["doc_id"]).select("doc_id", "column", "pii_type", "match")


@query("pii_finding_spots", """SELECT c_custkey, 'EMAIL' AS pii_type, 6 AS start, length(concat('c', CAST(c_custkey AS VARCHAR), '@example.com')) AS length,
 concat('mail c', CAST(c_custkey AS VARCHAR), '@example.com now') AS snippet FROM customer WHERE c_nationkey < 5
 UNION ALL SELECT c_custkey, 'IP_ADDRESS', 6, 8, concat('host 10.0.0.', CAST(c_nationkey AS VARCHAR)) FROM customer WHERE c_nationkey BETWEEN 5 AND 7""")
def _(t):
    return pii.pii_findings(contacts(t), ["contact"], ["c_custkey"]).select("c_custkey", "pii_type", "start", F.col("length").cast("long").alias("length"), "snippet")


@query("pii_finding_counts", " UNION ALL ".join(f"""SELECT 'text' AS "column", '{p}' AS pii_type, CAST({_count('text', rx)} AS BIGINT) AS n FROM documents HAVING {_count('text', rx)} > 0""" for p, rx in pii.PATTERNS.items()))
def _(t):
    return pii.finding_counts(pii.pii_findings(t.documents, ["text"], ["doc_id"]))


_LEVELS = [("c_nationkey", "int", "CAST(c_nationkey AS VARCHAR)"), ("c_mktsegment", "string", "c_mktsegment"), ("band", "bigint", "CAST(band AS VARCHAR)")]
_BAND = "CAST(floor(c_acctbal / 500) AS BIGINT)"


def banded(t):
    return t.customer.select("c_custkey", "c_nationkey", F.expr("CASE WHEN c_acctbal < 0 THEN NULL ELSE c_mktsegment END").alias("c_mktsegment"),
                             F.expr("cast(floor(c_acctbal / 500) AS bigint)").alias("band"))


BANDED = f"c AS (SELECT c_custkey, c_nationkey, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment, {_BAND} AS band FROM customer)"


@query("priv_qis", f"WITH {BANDED}, q AS (" + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", '{d}' AS dtype, count(DISTINCT {c}) AS unique_values, count(*) AS n, (SELECT string_agg(v, ' | ' ORDER BY v) FROM (SELECT DISTINCT {x} AS v FROM c WHERE {c} IS NOT NULL ORDER BY v LIMIT 5)) AS samples FROM c"""
    for c, d, x in _LEVELS) + """) SELECT "column", dtype, unique_values, round(unique_values / n, 4) AS uniqueness_ratio,
 CASE WHEN unique_values / n < 0.01 THEN 'Low' WHEN unique_values / n < 0.1 THEN 'Medium' ELSE 'High' END AS risk_level, samples FROM q WHERE unique_values BETWEEN 2 AND 100""")
def _(t):
    return rounded(anon.quasi_identifiers(banded(t)), 4)


_QIS = ["c_nationkey", "c_mktsegment", "band"]
_K = f"WITH {BANDED}, k AS (SELECT *, count(*) OVER (PARTITION BY c_nationkey, c_mktsegment, band) AS k FROM c)"


@query("priv_k_rows", _K + " SELECT * FROM k")
def _(t):
    return anon.k_anonymity(banded(t), _QIS)


@query("priv_vulnerable", _K + " SELECT * FROM k WHERE k < 3")
def _(t):
    return anon.vulnerable(banded(t), _QIS, 3)


_STATS = """s AS (SELECT count(*) AS n_records, min(k) AS min_k, max(k) AS max_k, round(avg(k), 2) AS mean_k, CAST(floor(median(k)) AS BIGINT) AS median_k, count(CASE WHEN k = 1 THEN 1 END) AS unique_records,
 round(count(CASE WHEN k = 1 THEN 1 END) * 100.0 / count(*), 2) AS unique_pct FROM k), t AS (SELECT *, CASE WHEN unique_pct > 10 THEN 'CRITICAL' WHEN unique_pct > 5 THEN 'HIGH' WHEN unique_pct > 1 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM s)"""


@query("priv_k_stats", _K + f", {_STATS} SELECT * FROM t")
def _(t):
    return rounded(anon.k_stats(banded(t), _QIS), 2)


@query("priv_k_risk", _K + """ SELECT t.t AS k, count(CASE WHEN k.k < t.t THEN 1 END) AS n_at_risk, round(count(CASE WHEN k.k < t.t THEN 1 END) * 100.0 / count(*), 2) AS pct_at_risk
 FROM k, (VALUES (1), (2), (3), (5), (10), (20), (50), (100)) t(t) GROUP BY t.t""")
def _(t):
    return rounded(anon.k_risk_curve(banded(t), _QIS), 2)


@query("priv_k_dist", _K + " SELECT k, count(*) AS n_records, round(count(*) * 100.0 / (SELECT count(*) FROM k), 2) AS pct FROM k GROUP BY k")
def _(t):
    return rounded(anon.k_distribution(banded(t), _QIS), 2)


@query("priv_report", _K + f""", {_STATS} SELECT 'c_nationkey,c_mktsegment,band' AS quasi_identifiers, *, concat_ws(',', CASE WHEN unique_pct > 5 THEN 'HIGH:unique_records' END,
 CASE WHEN mean_k < 10 THEN 'MEDIUM:low_mean_k' END, CASE WHEN min_k = 1 THEN 'HIGH:min_k_one' END) AS advice, greatest(5, median_k) AS target_k, unique_pct > 5 AS suppress_unique,
 CASE WHEN unique_pct > 10 THEN 'HIGH' WHEN unique_pct > 5 OR mean_k < 5 THEN 'MEDIUM' ELSE 'LOW' END AS generalization FROM t""")
def _(t):
    return rounded(anon.k_report(banded(t), _QIS), 2)


# ---- functional dependencies ----------------------------------------------

_FD = "f AS (SELECT c_nationkey, n_name, n_regionkey, c_mktsegment, CASE WHEN c_custkey = 7 THEN 'wrong' ELSE n_name END AS dirty FROM customer JOIN nation ON c_nationkey = n_nationkey)"
_FD_COLS = ["c_nationkey", "n_name", "n_regionkey", "c_mktsegment", "dirty"]


def joined(t):
    return t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_nationkey", "n_name", "n_regionkey", "c_mktsegment", F.expr("CASE WHEN c_custkey = 7 THEN 'wrong' ELSE n_name END").alias("dirty"))


_CONF = "r AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS determinant, '{b}' AS dependent, avg(CASE WHEN n = 1 THEN 1.0 ELSE 0.0 END) AS confidence, count(*) AS determinant_levels, (SELECT count(DISTINCT {b}) FROM f) AS dependent_levels, avg(n) AS mean_dependents "
    f"FROM (SELECT {a}, count(DISTINCT {b}) AS n FROM f WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1)" for a in _FD_COLS for b in _FD_COLS if a != b) + ")"
FDS = f"{_FD}, {_CONF}, fd AS (SELECT determinant, dependent, round(confidence, 4) AS confidence FROM r WHERE confidence >= 0.95)"


@query("fd_find", f"WITH {FDS} SELECT * FROM fd")
def _(t):
    return rounded(dep.find(joined(t)), 4)


@query("fd_types", f"""WITH {FDS} SELECT determinant, dependent, round(confidence, 4) AS confidence, CASE WHEN confidence < 1 THEN 'M:1 (partial)' WHEN determinant_levels = dependent_levels THEN '1:1' ELSE 'M:1' END AS type,
 determinant_levels, dependent_levels, round(mean_dependents, 2) AS mean_dependents FROM r WHERE confidence >= 0.95""")
def _(t):
    return rounded(dep.find_typed(joined(t)), 4)


@query("fd_samples", f"""WITH {_FD}, x AS (SELECT DISTINCT n_regionkey FROM f ORDER BY 1 LIMIT 3), y AS (SELECT n_regionkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS i FROM (SELECT DISTINCT n_regionkey, n_name FROM f))
 SELECT 'n_regionkey' AS determinant, 'n_name' AS dependent, CAST(n_regionkey AS VARCHAR) AS value, string_agg(n_name, ',' ORDER BY n_name) AS maps_to FROM y WHERE i <= 3 AND n_regionkey IN (SELECT * FROM x) GROUP BY n_regionkey""")
def _(t):
    return dep.samples(joined(t), "n_regionkey", "n_name")


@query("fd_graph", f"WITH {FDS} SELECT id, sum(o) AS as_determinant, sum(i) AS as_dependent FROM (SELECT determinant AS id, 1 AS o, 0 AS i FROM fd UNION ALL SELECT dependent, 0, 1 FROM fd) GROUP BY 1".replace("sum(o)", "CAST(sum(o) AS BIGINT)").replace("sum(i)", "CAST(sum(i) AS BIGINT)"))
def _(t):
    return dep.graph(dep.find(joined(t)))[0]


@query("fd_graph_totals", f"WITH {FDS} SELECT count(*) AS total_dependencies, count(CASE WHEN confidence = 1 THEN 1 END) AS strict_dependencies, (SELECT count(*) FROM (SELECT determinant FROM fd UNION SELECT dependent FROM fd)) AS columns_involved FROM fd")
def _(t):
    return dep.graph(dep.find(joined(t)))[2]


_OTHER = "o AS (SELECT c_nationkey, CASE WHEN c_acctbal < 1000 THEN 'moved' ELSE n_name END AS n_name, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey)"


@query("fd_validate", f"WITH {FDS}, {_OTHER}, c AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS determinant, '{b}' AS dependent, avg(CASE WHEN n = 1 THEN 1.0 ELSE 0.0 END) AS other FROM (SELECT {a}, count(DISTINCT {b}) AS n FROM o GROUP BY 1)"
    for a in _FD_COLS[:3] for b in _FD_COLS[:3] if a != b) + """) SELECT fd.determinant, fd.dependent, CASE WHEN other IS NULL THEN 'MISSING_COLUMNS' WHEN other >= 0.95 THEN 'PRESERVED' ELSE 'VIOLATED' END AS status,
 confidence, round(coalesce(other, 0), 4) AS other_confidence, round(CASE WHEN other IS NOT NULL THEN confidence - other END, 4) AS confidence_drop FROM fd LEFT JOIN c ON fd.determinant = c.determinant AND fd.dependent = c.dependent""")
def _(t):
    other = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_nationkey", F.expr("CASE WHEN c_acctbal < 1000 THEN 'moved' ELSE n_name END").alias("n_name"), "n_regionkey")
    return rounded(dep.validate(dep.find(joined(t)), other), 4)


@query("fd_constraints", f"WITH {FDS} SELECT * FROM fd WHERE confidence >= 0.99")
def _(t):
    return rounded(dep.constraints(dep.find(joined(t))), 4)


@query("fd_enforce", """SELECT c_custkey, c_nationkey, CASE WHEN c_nationkey IN (SELECT s_nationkey FROM supplier) THEN n_name ELSE 'scrambled' END AS n_name
 FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def _(t):
    source = t.supplier.join(F.broadcast(t.nation), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_nationkey").alias("c_nationkey"), "n_name")
    rows = t.customer.select("c_custkey", "c_nationkey", F.lit("scrambled").alias("n_name"))
    return dep.enforce(rows, source, [("c_nationkey", "n_name")])
