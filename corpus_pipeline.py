"""A training-corpus pipeline over ``documents``, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
to the shared folder and read again as the next stage's ``docs``; it goes once that stage
has written its own. All but the last return
the columns of ``documents``. A classifier is fitted on the way, which SQL cannot express,
so there is no SQL twin; tests hold the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemetric.llm import decontaminate, line_dedup, mixing, ngram_join, quality_crf
from tidemetric.llm.common import new_folder, remove_folder, table

STAGES = [
    ("quality classifier", quality_crf.stage),
    ("line dedup", line_dedup.stage),
    ("n-gram Jaccard join", ngram_join.stage),
    ("benchmark decontamination", decontaminate.stage),
    ("mixing sources", mixing.stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix: documents that pass every stage, with the words that the mix takes of them."""
    docs, folder = table(spark, sf_dir, "documents"), new_folder(spark, "pipeline")
    for at, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{at}")
        docs = spark.read.parquet(f"{folder}/{at}")
        if at:
            remove_folder(f"{folder}/{at - 1}")
    return docs
