"""WARC archives: write, normalise from one gzip stream to a member per record, read back.

* ``write_warc`` writes whole-file gzip streams with Spark's text writer: a row is a
  record and the line separator is the record's closing ``CRLF CRLF``.
* ``normalise`` inflates each such stream once, in pieces, and rewrites every record as
  a gzip member of its own beside a sidecar index of offsets. Only one piece of one
  record is in memory at a time. An archive's name has the attempt in it and its index
  rows come from the attempt that Spark commits, so lost executors and second attempts
  leave at most an unreferenced file.
* ``read_warc`` seeks to each indexed member and reads it alone.

Archives live in the shared folder of the session, reached by URI through pyarrow.fs.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemetric.llm.common import cut, join_by_key, new_folder, open_store, stored, table

# Fixed values of the format.
VERSION = "WARC/1.1"
END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

LEAST_REVISIT = 1000
LEVEL = 4
PIECE = 1 << 18
INDEX = "archive string, offset long, length long, record_type string, record_id string"


def with_revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """``page_id, url, payload, n, digest, refers_to`` per row; refers_to is set on revisits.

    Of rows with equal payloads of at least ``least`` bytes, those with the largest page_id
    are responses. Ids and digests alone decide: digests that occur twice meet their rows
    as ``join_by_key`` does, so one that a third of all pages share stays spread. Payloads
    meet what was decided by id and digest, which no hot payload or null id makes hot.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    full = pages.select("page_id", "url", payload.alias("payload"), F.octet_length(payload).cast("long").alias("n"), F.sha1(payload.cast("binary")).alias("digest"))
    keys = stored(full.filter(F.col("n") >= least).select("page_id", "digest"), "digests")
    grouped = keys.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("rows_of_key"))
    repeated = cut(grouped.filter("rows_of_key > 1 and refers_to is not null"))
    later = join_by_key(keys, repeated, "digest", keys.count()).filter(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    decided = later.distinct().select(F.col("page_id").alias("__id"), F.col("digest").alias("__digest"), "refers_to")
    return full.join(decided, F.col("page_id").eqNullSafe(F.col("__id")) & (F.col("digest") == F.col("__digest")), "left").drop("__id", "__digest")


def record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def record_text(digest: Column) -> Column:
    """A whole record without its closing CRLF CRLF, for rows of ``with_revisits``."""
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    uri = F.regexp_replace(F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), "\r", "%0D"), "\n", "%0A")
    more = F.when(revisit, F.concat(F.lit(f"WARC-Profile: {REVISIT_PROFILE}\r\nWARC-Refers-To: "), record_id(F.col("refers_to")), F.lit("\r\n"))).otherwise("")
    return F.concat(
        F.lit(f"{VERSION}\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), record_id(F.col("page_id")),
        F.lit(f"\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "), uri,
        F.lit("\r\nWARC-Payload-Digest: sha1:"), digest, F.lit("\r\n"), more,
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"),
        F.lit(END), block,
    )


def write_warc(pages: DataFrame, folder: str) -> None:
    """One whole-file gzip stream of records per partition of ``pages`` (page_id, url, html)."""
    records = with_revisits(pages).select(record_text(F.col("digest")).alias("value"))
    records.write.option("lineSep", END).option("compression", "gzip").text(folder)


def read_header(source: io.BufferedIOBase) -> tuple[bytes, dict[str, str]] | None:
    """Raw header with its blank line, and its fields; None at the end of the stream."""
    line = source.readline()
    while line in (b"\r\n", b"\n"):  # the end of the record before
        line = source.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"not a WARC record: {line[:40]!r}")
    raw, fields = [line], {}
    while (line := source.readline()) not in (b"\r\n", b"\n", b""):
        raw.append(line)
        name, _, value = line.decode("utf-8", "replace").partition(":")
        fields[name.strip().lower()] = value.strip()
    return b"".join(raw) + b"\r\n", fields


def _pieces(source: io.BufferedIOBase, n: int) -> Iterator[bytes]:
    while n > 0:
        piece = source.read(min(n, PIECE))
        if not piece:
            raise ValueError("a record ends early")
        n -= len(piece)
        yield piece


def _normaliser(folder: str, level: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, top = open_store(folder)
        store.create_dir(top, recursive=True)
        for path in (p for batch in batches for p in batch["path"]):
            origin, at = open_store(path)
            name = f"{at.rsplit('/', 1)[-1].split('.')[0]}-{uuid.uuid4().hex}.warc.gz"
            index, offset = [], 0
            with origin.open_input_stream(at, compression=None) as raw, store.open_output_stream(f"{top}/{name}", compression=None) as out, store.open_output_stream(f"{top}/{name}.idx", compression=None) as side:
                source = io.BufferedReader(gzip.GzipFile(fileobj=raw), PIECE)
                while (head := read_header(source)) is not None:
                    header, fields = head
                    member, length = zlib.compressobj(level, zlib.DEFLATED, 31), 0
                    for piece in chain([header], _pieces(source, int(fields["content-length"])), [END.encode()]):
                        data = member.compress(piece)
                        out.write(data)
                        length += len(data)
                    data = member.flush()
                    out.write(data)
                    length += len(data)
                    row = (f"{folder}/{name}", offset, length, fields["warc-type"], fields["warc-record-id"])
                    side.write(("\t".join(map(str, row[1:])) + "\n").encode())
                    index.append(row)
                    offset += length
                    if len(index) >= 10_000:
                        yield pd.DataFrame(index, columns=["archive", "offset", "length", "record_type", "record_id"])
                        index = []
            yield pd.DataFrame(index, columns=["archive", "offset", "length", "record_type", "record_id"])

    return run


def normalise(spark: SparkSession, source: str, folder: str, level: int = LEVEL) -> DataFrame:
    """Rewrite every gzip stream under ``source`` member by member into ``folder``.

    Returns the offset index, one row a record; each archive also has it beside it as
    ``<archive>.idx``. Whole-file streams cannot be split, so a file is the unit of work.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(source).select("path")
    index = files.mapInPandas(_normaliser(folder, level), INDEX)
    return stored(index, "warc-index")


_RECORDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long"


def _page(urn: str | None) -> int | None:
    return int(urn[10:-1]) if urn and len(urn) > 11 else None


class _Member(io.RawIOBase):
    """Reads one gzip member at an offset of a file."""

    def __init__(self, file, offset: int, length: int):
        file.seek(offset)
        self.file, self.left, self.unzip = file, length, zlib.decompressobj(31)

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        while True:
            data = self.unzip.decompress(self.unzip.unconsumed_tail, len(buffer)) if self.unzip.unconsumed_tail else b""
            if not data and self.left > 0:
                raw = self.file.read(min(self.left, PIECE))
                self.left -= len(raw)
                data = self.unzip.decompress(raw, len(buffer))
            if data or (self.left <= 0 and not self.unzip.unconsumed_tail):
                buffer[: len(data)] = data
                return len(data)


def _reader(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for archive, part in batch.groupby("archive", sort=False):
            store, at = open_store(archive)
            with store.open_input_file(at) as file:
                for offset, length in zip(part["offset"], part["length"], strict=True):
                    source = io.BufferedReader(_Member(file, int(offset), int(length)), PIECE)
                    _, fields = read_header(source)
                    left, size = int(fields["content-length"]), 0
                    while (line := source.readline()) != b"\r\n":
                        left -= len(line)
                        if line.lower().startswith(b"content-length:"):
                            size = int(line.split(b":")[1])
                    left -= 2
                    digest = fields["warc-payload-digest"].removeprefix("sha1:")
                    if fields["warc-type"] == "response":
                        sha, size = hashlib.sha1(usedforsecurity=False), left
                        for piece in _pieces(source, left):
                            sha.update(piece)
                        if sha.hexdigest() != digest:
                            raise ValueError(f"{fields['warc-record-id']}: the payload does not have its digest")
                    rows.append((_page(fields["warc-record-id"]), fields["warc-target-uri"], fields["warc-type"], size, digest, _page(fields.get("warc-refers-to"))))
        out = pd.DataFrame(rows, columns=["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to"])
        yield out.astype({"page_id": "Int64", "refers_to": "Int64"})


def read_warc(index: DataFrame) -> DataFrame:
    """One row per indexed record; a response's payload is held against its digest.

    A revisit's payload size and digest are those its own header and HTTP block state.
    """
    return index.mapInPandas(_reader, _RECORDS)


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives, normalise them and read them back.

    A null html is an empty payload, a null url an empty target, and a null page_id an
    empty id that stays null; repeated rows are records each. Extra columns are ignored.
    """
    spark = pages.sparkSession
    folder = new_folder(spark, "warc")
    write_warc(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"), f"{folder}/streams")
    return read_warc(normalise(spark, f"{folder}/streams", f"{folder}/records"))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
with p as (select row_number() over () as r, page_id, coalesce(html, '') as html from pages),
d as (select r, page_id, strlen(html)::bigint as payload_bytes, sha1(html) as payload_digest from p),
g as (select payload_digest, max(page_id) as last, count(*) as n from d where payload_bytes >= 1000 group by payload_digest)
select page_id, payload_bytes, d.payload_digest,
  case when n > 1 and payload_bytes >= 1000 and page_id is distinct from last then 'revisit' else 'response' end as record_type,
  case when n > 1 and payload_bytes >= 1000 and page_id is distinct from last then last end as refers_to
from d left join g using (payload_digest)"""
