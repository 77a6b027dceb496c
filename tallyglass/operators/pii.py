"""Personal data: value patterns, name rules, findings and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.exprs import q, records, resolve, spread, text_columns

# fixed values: value patterns, in checking order
PATTERNS = {
    "EMAIL": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "PHONE_US": r"\b(?:\+?1[-.]?)?\(?([0-9]{3})\)?[-.]?([0-9]{3})[-.]?([0-9]{4})\b",
    "SSN": r"\b\d{3}-\d{2}-\d{4}\b",
    "CREDIT_CARD": r"\b(?:\d{4}[-\s]?){3}\d{4}\b",
    "IP_ADDRESS": r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b",
    "URL": r"https?://(?:www\.)?[-a-zA-Z0-9@:%._\+~#=]{1,256}\.[a-zA-Z0-9()]{1,6}\b(?:[-a-zA-Z0-9()@:%_\+.~#?&/=]*)",
    "DATE_OF_BIRTH": r"\b(?:0[1-9]|1[0-2])[-/](?:0[1-9]|[12][0-9]|3[01])[-/](?:19|20)\d{2}\b",
    "ZIP_CODE": r"\b\d{5}(?:-\d{4})?\b",
}

# fixed values: words that mark a column name
NAME_WORDS = {
    "NAME": ["name", "first_name", "last_name", "full_name", "firstname", "lastname", "username"],
    "EMAIL": ["email", "e_mail", "email_address", "mail"],
    "PHONE": ["phone", "telephone", "mobile", "cell", "phone_number"],
    "ADDRESS": ["address", "street", "city", "state", "zip", "postal", "location"],
    "SSN": ["ssn", "social_security", "social_security_number"],
    "DOB": ["dob", "birth_date", "date_of_birth", "birthday"],
    "ID": ["id", "customer_id", "user_id", "employee_id", "account_id"],
}

# fixed values: confidences
NAME_CONFIDENCE = 0.7
MAX_VALUE_CONFIDENCE = 0.95
SNIPPET = 10
EXAMPLES = 10


def possible(x, family: str):
    """Cheap necessary condition of a pattern, so that most texts skip the costly expression."""
    if family == "EMAIL":
        return x.contains("@")
    if family == "URL":
        return x.contains("://")
    return x.rlike("[0-9]")


def pii_by_value(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(column, pii_type, n_values, n_matches) of every text column and pattern: one scan, no shuffle
    of rows, whole texts."""
    cols = text_columns(df) if cols is None else resolve(df, cols)
    if not cols:
        return records(df.sparkSession, [], "column string, pii_type string, n_values bigint, n_matches bigint")
    table = spread(df.select(*[q(c) for c in cols]))
    found = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(p).alias("pii_type"), F.count(q(c)).alias("n_values"),
                               F.coalesce(F.sum(F.when(possible(q(c), p), F.regexp_count(q(c), F.lit(rx)))), F.lit(0)).alias("n_matches"))
                      for c in cols for p, rx in PATTERNS.items()])
    return table.agg(found.alias("r")).select(F.inline("r"))


def name_types(column: str, whole_word: bool = False) -> list[str]:
    low = column.lower()
    words = set(low.replace("-", "_").split("_"))
    return [t for t, keys in NAME_WORDS.items()
            if any((k in words or k == low) if whole_word else (k in low) for k in keys)]


def name_rules(df: DataFrame, whole_word: bool = False) -> DataFrame:
    rows = [(c, t) for c in df.columns for t in name_types(c, whole_word)]
    return records(df.sparkSession, rows, "column string, pii_type string")


def pii_scan(df: DataFrame, names: bool = True, whole_word: bool = False) -> DataFrame:
    """(column, pii_types, confidence, match_count, methods) of columns with any sign of personal data."""
    values = pii_by_value(df).filter("n_matches > 0")
    order = F.create_map(*[F.lit(x) for i, t in enumerate(dict.fromkeys([*NAME_WORDS, *PATTERNS])) for x in (t, i)])
    by_name = {c: name_types(c, whole_word) for c in df.columns} if names else {}
    named = records(df.sparkSession, [(c, t) for c, t in by_name.items() if t], "column string, name_types array<string>")
    found = values.groupBy("column").agg(
        F.transform(F.sort_array(F.collect_list(F.struct(order[F.col("pii_type")].alias("o"), "pii_type"))),
                    lambda s: s["pii_type"]).alias("value_types"),
        F.sum("n_matches").alias("match_count"), F.max("n_values").alias("n_values"), F.count(F.lit(1)).alias("n_types"))
    t = found.join(named, "column", "full_outer")
    none = F.array().cast("array<string>")
    a, b = F.coalesce("name_types", none), F.coalesce("value_types", none)
    share = F.least(F.coalesce(F.try_divide(F.col("match_count"), F.col("n_values")), F.lit(0.0)), F.lit(MAX_VALUE_CONFIDENCE))
    return t.select(
        "column", F.concat_ws(",", F.array_union(a, b)).alias("pii_types"),
        F.greatest(F.when(F.size(a) > 0, F.lit(NAME_CONFIDENCE)).otherwise(F.lit(0.0)), F.coalesce(share, F.lit(0.0))).alias("confidence"),
        F.coalesce("match_count", F.lit(0)).cast("long").alias("match_count"),
        F.concat_ws(",", F.when(F.size(a) > 0, "column_name"), F.when(F.size(b) > 0, "pattern_match")).alias("methods"))


def pii_summary(df: DataFrame, scan: DataFrame | None = None) -> DataFrame:
    """One row: columns with personal data and the priority codes they raise."""
    scan = pii_scan(df) if scan is None else scan
    types = F.split("pii_types", ",")
    direct = F.array_contains(types, "EMAIL") | F.array_contains(types, "SSN")
    return scan.agg(
        F.lit(len(df.columns)).alias("total_columns"), F.count(F.lit(1)).alias("columns_with_pii"),
        F.concat_ws(",", F.sort_array(F.collect_list("column"))).alias("high_risk_columns"),
        F.when(F.count(F.lit(1)) > 0, "HIGH").alias("priority"),
        F.when(F.count_if(direct) > 0, "CRITICAL").alias("direct_identifier_priority"))


def pii_findings(df: DataFrame, cols: list[str], key: list[str]) -> DataFrame:
    """One row per match: key, column, type, 1-based start, length and the surrounding snippet.

    One scan for all columns and patterns.  The text is split at the match with its gaps kept, so repeated
    equal matches get their own positions."""
    cells = []
    for c in resolve(df, cols):
        for t, rx in PATTERNS.items():
            found = F.struct(F.lit(c).alias("column"), F.lit(t).alias("pii_type"), q(c).alias("_text"),
                             F.regexp_extract_all(q(c), F.lit(rx), F.lit(0)).alias("_m"), F.split(q(c), rx, -1).alias("_gaps"))
            cells.append(F.when(possible(q(c), t) & (F.regexp_count(q(c), F.lit(rx)) > 0), found))
    table = spread(df.select(*[q(k) for k in dict.fromkeys([*key, *cols])]))
    rows = table.select(*[q(k) for k in key], F.explode(F.filter(F.array(*cells), lambda x: x.isNotNull())).alias("f")).select(*[q(k) for k in key], "f.*")
    spot = rows.select("*", F.posexplode("_m").alias("_i", "match"))
    # lengths of the gaps and matches before the i-th match
    before = F.aggregate(F.slice("_gaps", F.lit(1), F.col("_i") + 1), F.lit(0), lambda a, g: a + F.length(g)) + \
        F.aggregate(F.slice("_m", F.lit(1), F.col("_i")), F.lit(0), lambda a, g: a + F.length(g))
    return spot.withColumn("start", before + 1).select(
        *[q(k) for k in key], "column", "pii_type", "start", F.length("match").alias("length"), "match",
        F.substring(F.col("_text"), F.greatest(F.lit(1), F.col("start") - SNIPPET),
                    F.least(F.col("start") - 1, F.lit(SNIPPET)) + F.length("match") + SNIPPET).alias("snippet"))


def finding_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("column", "pii_type").agg(F.count(F.lit(1)).alias("n"))


def finding_examples(findings: DataFrame, key: list[str], n: int = EXAMPLES) -> DataFrame:
    """First ``n`` findings per column and type in key order (limited inside tasks before the shuffle)."""
    from pyspark.sql import Window

    w = Window.partitionBy("column", "pii_type").orderBy(*key, "start")
    return findings.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")
