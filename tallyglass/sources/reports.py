"""Report store: tidy reports as text rows, partitioned by dataset and report kind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# fixed values: the report kinds that can be stored
KINDS = ("profile", "mutual_information", "outliers", "drift", "pii", "k_anonymity",
         "dependencies", "timeseries", "remediation")


def save_report(report: DataFrame, root: str, kind: str, dataset_id: str) -> None:
    """Replaces the stored report of this dataset and kind; other partitions stay."""
    if kind not in KINDS:
        raise ValueError(f"unknown report kind: {kind}")
    rows = report.select(F.to_json(F.struct(*report.columns), {"ignoreNullFields": "false"}).alias("row"),
                         F.lit(report.schema.json()).alias("schema"))
    rows.write.mode("overwrite").parquet(f"{root.rstrip('/')}/dataset_id={dataset_id}/kind={kind}")


def load_report(spark: SparkSession, root: str, kind: str, dataset_id: str) -> DataFrame:
    """Reads one report back with its own schema (only its partition is scanned)."""
    from pyspark.sql.types import StructType
    import json

    if kind not in KINDS:
        raise ValueError(f"unknown report kind: {kind}")
    stored = spark.read.parquet(root).filter((F.col("dataset_id") == dataset_id) & (F.col("kind") == kind))
    head = stored.select("schema").first()
    if head is None:
        raise LookupError(f"no {kind} report for {dataset_id}")
    schema = StructType.fromJson(json.loads(head[0]))
    return stored.select(F.from_json("row", schema).alias("r")).select("r.*")


def list_reports(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(root).groupBy("dataset_id", "kind").agg(F.count(F.lit(1)).alias("n_rows"))
