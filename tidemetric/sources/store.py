"""The folder that driver and executors share, and idempotent writes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir. Where that is unset, a local session (tests) gets a temporary one."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from there."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_partitions(df: DataFrame, path: str, *by: str) -> None:
    """Replaces just the partitions that ``df`` holds, so a run that is repeated leaves one copy."""
    df.repartition(*by).write.partitionBy(*by).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def append_run_log(spark: SparkSession, path: str, rows: list[tuple[str, str, int, float, str]]) -> None:
    """Appends (experiment_id, metric_id, row_count, seconds, job_type) rows of a job's queries."""
    spark.createDataFrame(rows, "experiment_id string, metric_id string, row_count long, seconds double, job_type string").coalesce(1).write.mode("append").parquet(path)


def check_fresh(catalog: DataFrame, as_of: str, hours: int = 24) -> None:
    """Raises when the newest ``updated_at`` is older than ``hours`` before ``as_of``, or there is none."""
    newest = F.max("updated_at")
    fresh = catalog.agg((newest >= F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {int(hours)} HOURS")).alias("fresh")).first()["fresh"]
    if not fresh:
        raise RuntimeError(f"the catalog was not updated in the {hours} hours before {as_of}")
