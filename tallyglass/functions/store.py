"""Written intermediate tables, in the shared folder the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Narrow rows of a file, where the number of rows is known.
FILE_ROWS = 100_000


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder.  Only a local session without the setting falls back to a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return f"{base.rstrip('/')}/tallyglass/{name}-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    return tempfile.mkdtemp(prefix=f"tallyglass-{name}-")


def materialise(df: DataFrame, name: str, rows: int | None = None, file_rows: int = FILE_ROWS) -> DataFrame:
    """Write once, read back: several uses cost one computation, and a lost executor costs a file read.

    ``rows``: how many there are at most, if known; the last step then runs in tasks of about ``file_rows`` of them, so that a small
    table is not written as a file per shuffle partition (local file systems start a process for each)."""
    if rows is not None:
        df = df.coalesce(-(-max(rows, 1) // file_rows))
    path = scratch(df.sparkSession, name) + "/data"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
