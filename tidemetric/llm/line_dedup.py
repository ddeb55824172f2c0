"""Line dedup: repeated lines stay only in the smallest document that holds them.

Lines are exploded to (key hash, document), one row per row and key, and stored once.
Documents per hash are counted with map-side partial aggregation, so a line that a third
of all documents share costs one row per task in that shuffle. Hashes that so many share
are broadcast to the stored lines, the others meet them by hash (``join_by_key``). The
hashes to drop then meet their rows by id and a hash of the text, so rows that repeat an
id, or have none, are spread; texts are reassembled by line position. Only hashes travel;
a text is shuffled once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemetric.llm.common import cut, join_by_key, small_batches, stored, table

WHITE = " \t\n\x0b\x0c\r"
MIN_CHARS = 10
MIN_DOCS = 2
#: A null doc_id counts as one document that comes after all others.
NO_ID = 9223372036854775807


def line_hash(line: str, min_chars: int) -> bytes | None:
    """128-bit hash of the line's key, or None where the key is too short to count."""
    key = line.strip(WHITE)
    return hashlib.md5(key.encode("utf-8", "surrogatepass").lower(), usedforsecurity=False).digest() if len(key) >= min_chars else None


def _hashes(min_chars: int):
    @F.pandas_udf(T.ArrayType(T.BinaryType()))
    def hashes(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([list({h for line in (text or "").split("\n") if (h := line_hash(line, min_chars))}) for text in batch])

    return hashes


_KEPT = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])


def _reassembled(min_chars: int):
    @F.pandas_udf(_KEPT)
    def reassembled(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, drops in batches:
            rows = []
            for text, drop in zip(texts, drops, strict=True):
                lines = (text or "").split("\n")
                if drop is not None and len(drop):
                    gone = {bytes(x) for x in drop}
                    stay = [x for x in lines if line_hash(x, min_chars) not in gone]
                    rows.append(("\n".join(stay), len(lines), len(lines) - len(stay)))
                else:
                    rows.append((text or "", len(lines), 0))
            yield pd.DataFrame(rows, columns=["text", "n_lines", "n_dropped"])

    return reassembled


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with ``text`` reassembled, plus long columns ``n_lines`` and ``n_dropped``.

    A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends and with A-Z
    lower-cased. Lines whose key has ``min_chars`` code points or more and is found in
    ``min_docs`` documents or more stay only in the smallest doc_id. A null or empty text
    is one empty line. Rows that repeat a doc_id are one document. Other columns pass
    through; columns named n_lines or n_dropped are replaced.
    """
    small_batches(docs.sparkSession)
    own, body = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), F.xxhash64("text")
    lines = stored(docs.select(own.alias("doc"), body.alias("body"), F.explode(_hashes(min_chars)(F.col("text"))).alias("hash")), "lines")
    grouped = lines.groupBy("hash").agg(F.min("doc").alias("owner"), F.count("*").alias("rows_of_key"), *([F.max("doc").alias("last")] if min_docs <= 2 else [F.count_distinct("doc").alias("docs")]))
    shared = cut(grouped.filter("owner < last" if min_docs <= 2 else F.col("docs") >= min_docs).select("hash", "owner", "rows_of_key"))
    met = join_by_key(lines, shared, "hash", lines.count())
    dropped = met.filter("doc <> owner").groupBy("doc", "body").agg(F.collect_set("hash").alias("__gone")).toDF("__doc", "__body", "__gone")  # the lines of one text
    joined = docs.withColumn("__own", own).join(dropped, (F.col("__own") == F.col("__doc")) & (body == F.col("__body")), "left")
    kept = joined.withColumn("__kept", _reassembled(min_chars)(F.col("text"), F.col("__gone")))
    return kept.withColumns({"text": F.col("__kept.text"), "n_lines": F.col("__kept.n_lines"), "n_dropped": F.col("__kept.n_dropped")}).drop("__own", "__doc", "__body", "__gone", "__kept")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents with repeated lines gone and n_chars brought up to date."""
    return dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


SQL = """
with docs as (select row_number() over () as r, doc_id, coalesce(doc_id, 9223372036854775807) as doc, string_split(coalesce(text, ''), chr(10)) as ls from documents),
lines as (
  select r, doc, pos, ls[pos] as line,
    translate(trim(ls[pos], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from (select *, unnest(generate_series(1, len(ls))) as pos from docs)),
shared as (select key, min(doc) as owner from lines where length(key) >= 10 group by key having count(distinct doc) >= 2),
marked as (select l.*, s.owner is not null and s.owner <> l.doc as gone from lines l left join shared s using (key)),
kept as (
  select r, count(*) as n_lines, count(*) filter (gone) as n_dropped,
    coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '') as text
  from marked group by r)
select doc_id, n_lines, n_dropped, sha256(text) as kept_sha256 from docs join kept using (r)"""
