"""Shared-folder access and table reads for the corpus operators."""

from __future__ import annotations

import re
import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where it is unset, a local session (tests) gets a temporary one; a cluster is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder once and go on from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: columns can then be read apart."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI or a plain absolute path."""
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def remove_folder(path: str) -> None:
    """Remove an intermediate folder that nothing reads any more."""
    store, top = open_store(path)
    store.delete_dir(top)


#: Keys that may be broadcast as heavy; each has more than this part of all rows, so there are fewer of them.
HEAVY_KEYS = 10_000


def join_by_key(rows: DataFrame, keyed: DataFrame, key: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``keyed``, which has one row a key and their number of rows in ``rows_of_key``.

    Keys with over ``total / HEAVY_KEYS`` rows are fewer than ``HEAVY_KEYS``, whatever the
    data, and are broadcast, so their rows stay where they are; all others are shuffled,
    and none of them is a large part of a task. Both sides are read more than once: give
    stored ones.
    """
    limit = max(1, total // HEAVY_KEYS)
    heavy = F.broadcast(keyed.filter(F.col("rows_of_key") > limit)).drop("rows_of_key")
    light = keyed.filter(F.col("rows_of_key") <= limit).drop("rows_of_key")
    rest = rows.join(heavy.select(key), key, "left_anti")
    return rows.join(heavy, key).unionByName(rest.join(light, key))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def is_held_out(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 5, is 0; a null id counts as the empty text."""
    text = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % 5 == 0


TEXT_ROWS = 500


def small_batches(spark: SparkSession, rows: int = TEXT_ROWS) -> None:
    """Hold Arrow batches to ``rows`` rows from now on: rows are whole texts, and a batch is held in memory twice."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))
