"""Suffix-array dedup by prefix-free parsing: bytes of windows that also start elsewhere go.

A window is a run of ``size`` bytes. A rolling hash of ``trigger`` bytes cuts texts into
phrases; where no trigger follows a byte within ``reach``, the byte itself is a phrase. Both
depend on the window's own bytes alone, so equal windows begin with the same phrase suffix
and go on with the same parse. A window is thus (a suffix of its phrase, the text from the
phrase's trigger on), and its place in corpus order is a pair of ranks: that of the phrase
suffix in the suffix array of the dictionary, and that of what follows in the suffix array
of the parse, cut off after ``size`` bytes.

1. Windows that start near the end of their phrase have more bytes after it: a phrase is
   cut into bands of such offsets. Where no other phrase end is followed by the bytes that
   all windows of a band hold, none of these is repeated. The keys of bytes that repeat go into a bounded bit table; it only spares work, as candidates are
   grouped exactly later.
2. Phrase ends with equal contexts (whole phrase and all that a window can reach) are one
   class. A class found twice is repeated whole, without a look at its bytes: in highly
   repetitive text that settles all but the edges of copies.
3. Classes that are found once, and those they could share windows with, send their bytes.
   Spark sorts what follows (the suffix array of the parse), numpy the reversed phrases of a
   block (that of the dictionary). At every offset, neighbours with long enough common
   prefixes are one interval in either order, and a window is repeated if its pair of
   intervals holds two.
4. Intervals that go on beyond a block, as far as its first and last row share bytes with
   their neighbours, are open: their windows, one for each pair, meet by digest.

Texts travel twice, and only to rows that need their bytes. Copies of a whole text are
settled by their number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemetric.llm.bits import bit_table, has_bit
from tidemetric.llm.common import cut, join_by_key, new_folder, remove_folder, stored, table
from tidemetric.llm.words import _BASE, _power_tables, mix

EMPTY_SHA = hashlib.sha256(b"").hexdigest()
#: Bytes of texts that are parsed at a time.
SLAB = 1 << 18
#: Contexts of a block, and bytes of contexts that a shard holds, about.
BLOCK, SHARD_BYTES = 2048, 64 << 20
ROW_GROUP = 8 << 20
#: Texts, and blocks, that Spark and a worker hold at a time.
TEXTS_A_BATCH, BLOCKS_A_BATCH = 1000, 4
_BYTE = np.random.default_rng(20240713).integers(1, (1 << 64) - 1, 256, dtype=np.uint64)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows for what runs inside; those of large rows would fill memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    most = int(before)
    spark.conf.set(name, str(rows if most <= 0 else min(rows, most)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


@dataclass(frozen=True)
class Parse:
    """Lengths in bytes: of windows, of triggers, how far a phrase reaches before its trigger, and of bands of offsets."""

    size: int = 400
    trigger: int = 32
    reach: int = 299
    band: int = 100
    rate: int = 56

    def __post_init__(self):
        if self.trigger > self.size - self.reach:
            raise ValueError("triggers must lie inside every window that they stand for")


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial over ``data``, for hashes of its runs."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power_tables(len(data) + 1)[0][: len(data)], dtype=np.uint64, out=sums[1:])
    return sums


def run_hashes(sums: np.ndarray, at: np.ndarray | slice, length: int) -> np.ndarray:
    """64-bit hashes of the runs of ``length`` bytes from ``at`` on."""
    after = slice(at.start + length, at.stop + length) if isinstance(at, slice) else at + length
    inverse = _power_tables(len(sums))[1]
    return mix((sums[after] - sums[at]) * inverse[at] + np.uint64(length * _BASE & 0xFFFFFFFFFFFFFFFF))


def phrase_ends(data: np.ndarray, begin: np.ndarray, end: np.ndarray, first: np.ndarray, stop: np.ndarray, parse: Parse) -> tuple[np.ndarray, np.ndarray]:
    """Phrase ends of texts side by side in ``data``, as rows of (text, place, low, advance, rest), and their keys.

    Text i lies from ``begin[i]`` to ``end[i]``, beyond ``data`` where that is a slab of it, and
    its phrase ends from ``first[i]`` to ``stop[i]`` are given. Windows start ``low`` to
    ``advance - 1`` bytes before the place, and ``rest`` bytes follow that such windows can
    hold. A phrase is cut into bands of offsets, as windows with a smaller offset have more
    bytes after the place in common: the key is of those that all windows of the band hold.
    Only bands with a whole window are given.
    """
    sums = prefix_sums(data)
    at = np.flatnonzero(run_hashes(sums, slice(0, max(0, len(sums) - parse.trigger)), parse.trigger) % np.uint64(parse.rate) == 0)
    text = np.searchsorted(begin, at, "right") - 1
    inside = at + parse.trigger <= end[text]
    at, text = at[inside], text[inside]
    before = np.append(-1, at[:-1])
    before = np.where(np.append(True, text[1:] != text[:-1]) if len(at) else np.zeros(0, bool), begin[text] - 1, before[: len(at)])
    own = (at >= first[text]) & (at < stop[text])
    place, advance, owner = at[own], np.minimum(at - before, parse.reach + 1)[own], text[own]
    # bytes that no trigger follows within reach: runs before each trigger, and at each text's end
    last = np.searchsorted(text, np.arange(len(begin)), "right")
    tail = np.where(last > np.searchsorted(text, np.arange(len(begin)), "left"), np.append(at, 0)[last - 1], begin - 1)
    run_text = np.concatenate([text, np.arange(len(begin))])
    low = np.maximum(np.concatenate([before, tail]) + 1, first[run_text])
    high = np.minimum(np.concatenate([at - parse.reach - 1, end]), np.minimum(end[run_text] - parse.size, stop[run_text] - 1))
    some = high >= low
    run_text, low, many = run_text[some], low[some], (high - low + 1)[some]
    lone = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())
    place, advance, owner = np.concatenate([place, lone]), np.concatenate([advance, np.ones(len(lone), np.int64)]), np.concatenate([owner, np.repeat(run_text, many)])
    rows, keys = [], []
    for band in range(0, min(parse.reach, int(advance.max(initial=0)) - 1) + 1, parse.band):
        some = np.flatnonzero(advance > band)
        after, most = place[some], np.minimum(advance[some], band + parse.band)
        rest = np.minimum(parse.size - band, end[owner[some]] - after)
        whole = most - 1 >= parse.size - rest
        after = after[whole]
        rows.append(np.stack([owner[some][whole], after, np.full(len(after), band), most[whole], rest[whole]]))
        keys.append(run_hashes(sums, after, parse.size - min(band + parse.band - 1, parse.reach)))
    return (np.concatenate(rows, axis=1), np.concatenate(keys)) if rows else (np.zeros((5, 0), np.int64), np.zeros(0, np.uint64))


def _pieces(batches: Iterator[pa.RecordBatch], parse: Parse) -> Iterator[tuple[list[bytes], bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """(tids, bytes, begins, phrase ends, keys) of texts that hold a window, many short ones at a time, long ones in slabs; a text once a task."""

    def whole(tids: list[bytes], blobs: list) -> tuple:
        end = np.cumsum([len(b) for b in blobs])
        begin = np.append(0, end[:-1])
        data = b"".join(blobs)
        return tids, data, begin, *phrase_ends(np.frombuffer(data, np.uint8), begin, end, begin, end, parse)

    seen: set[bytes] = set()
    tids, blobs, held = [], [], 0
    for batch in batches:
        for tid, text in zip(batch.column("tid").to_pylist(), batch.column("body"), strict=True):
            blob = text.as_buffer()
            if tid in seen or len(blob) < parse.size:
                continue
            seen.add(tid)
            if len(blob) > SLAB:
                for at in range(0, len(blob), SLAB):
                    low = max(0, at - parse.reach - 1)
                    data = blob[low : at + SLAB + parse.size].to_pybytes()
                    own = [np.array([x]) for x in (-low, len(blob) - low, at - low, min(at + SLAB, len(blob)) - low)]
                    yield [tid], data, own[0], *phrase_ends(np.frombuffer(data, np.uint8), *own, parse)
                continue
            tids.append(tid)
            blobs.append(blob)
            held += len(blob)
            if held >= SLAB:
                yield whole(tids, blobs)
                tids, blobs, held = [], [], 0
        if blobs:  # buffers go with their batch
            yield whole(tids, blobs)
            tids, blobs, held = [], [], 0


def once_a_task(texts: DataFrame, parse: Parse) -> DataFrame:
    """``texts`` that hold a window, each once a task: a text with many copies is no hot key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            tids, keep = batch.column("tid").to_pylist(), []
            for i, (tid, text) in enumerate(zip(tids, batch.column("body"), strict=True)):
                if tid not in seen and len(text.as_buffer()) >= parse.size:
                    seen.add(tid)
                    keep.append(i)
            if keep:
                yield batch.take(pa.array(keep))

    return texts.select("tid", "body").mapInArrow(run, "tid binary, body binary")


def _batch(columns: dict[str, tuple[list, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], list(columns))


def _keys(parse: Parse):
    """(key, n): keys of phrase ends, n is 2 where a slab has several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for *_, key in _pieces(batches, parse):
            key, n = np.unique(key, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.minimum(n, 2))], ["key", "n"])

    return run


def class_names(data: bytes, ends: np.ndarray) -> list[bytes]:
    """16 bytes for each phrase end: equal for equal bands of equal phrases that go on alike."""
    _, place, low, advance, rest = ends
    view, salts = memoryview(data), np.stack([low, advance, rest, np.zeros_like(rest)], axis=1).astype("<u4").tobytes()
    cuts = zip((place - advance + 1).tolist(), (place + rest).tolist(), range(0, len(salts), 16), strict=True)
    return [hashlib.blake2b(view[a:b], digest_size=16, salt=salts[i : i + 16]).digest() for a, b, i in cuts]


_FOUND = "key long, class binary, tid binary, place long, low int, advance int, rest int, n int"
_KINDS = dict(zip([c.split()[0] for c in _FOUND.split(", ")], [pa.int64(), pa.binary(), pa.binary(), pa.int64(), *[pa.int32()] * 4], strict=True))


def _candidates(bits, parse: Parse):
    """Phrase ends whose key may repeat. Of a class that a piece holds again and again the first stands for all, and the others' starts are sent as runs (class is null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tids, data, begin, ends, key in _pieces(batches, parse):
            keep = np.flatnonzero(has_bit(bits.value, key))
            if not len(keep):
                continue
            ends, key = ends[:, keep], key[keep]
            names = class_names(data, ends)
            first: dict[bytes, int] = {}
            others = [i for i, name in enumerate(names) if first.setdefault(name, i) != i]
            one, counts = np.fromiter(first.values(), np.int64), np.ones(len(names), np.int64)
            if others:
                counts[[first[names[i]] for i in others]] = 2
                starts: dict[int, list] = {}
                for text, p, o, a, r in ends[:, others].T.tolist():
                    starts.setdefault(text, []).append((p - a + 1 - int(begin[text]), p - max(o, parse.size - r) - int(begin[text])))
                rows = [(0, None, tids[text], last, 0, last - low + 1, parse.size, 2) for text, runs in starts.items() for low, last in merged(runs)]
                yield _batch({c: (list(v), k) for (c, k), v in zip(_KINDS.items(), zip(*rows, strict=True), strict=True)})
            text, place, low, advance, rest = ends[:, one]
            columns = [key[one].view(np.int64), list(first), pa.array(tids, pa.binary()).take(pa.array(text)), place - begin[text], *[x.astype(np.int32) for x in (low, advance, rest, counts[one])]]
            yield _batch({c: (v, k) for (c, k), v in zip(_KINDS.items(), columns, strict=True)})

    return run


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs (first, last) in order, those that touch or overlap as one."""
    out: list[tuple[int, int]] = []
    for low, high in sorted(runs):
        if out and low <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def runs_of(marks: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs (row, first, last) of what is true in a row."""
    steps = np.diff(np.pad(marks, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    (rows, first), (_, end) = np.nonzero(steps == 1), np.nonzero(steps == -1)
    return list(zip(rows.tolist(), first.tolist(), (end - 1).tolist(), strict=True))


_CONTEXT = "follows binary, phrase binary, tid binary, place long, low int, single boolean"


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What follows each wanted phrase end, and its phrase backwards from there."""
    seen: set[bytes] = set()
    for batch in batches:
        for tid, body, ends in zip(batch.column("tid").to_pylist(), batch.column("body"), batch.column("ends"), strict=True):
            if tid in seen:
                continue
            seen.add(tid)
            blob, ends = body.as_buffer(), ends.as_py()
            for at in range(0, len(ends), BLOCK):
                some = ends[at : at + BLOCK]
                yield _batch(
                    {
                        "follows": ([blob[e["place"] : e["place"] + e["rest"]].to_pybytes() for e in some], pa.binary()),
                        "phrase": ([blob[e["place"] - e["advance"] + 1 : e["place"]].to_pybytes()[::-1] for e in some], pa.binary()),
                        "tid": ([tid] * len(some), pa.binary()),
                        "place": ([e["place"] for e in some], pa.int64()),
                        "low": ([e["low"] for e in some], pa.int32()),
                        "single": ([e["single"] for e in some], pa.bool_()),
                    }
                )


def padded_bytes(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of bytes, short ones filled up, and their lengths."""
    lens = np.fromiter(map(len, strings), np.int64, len(strings))
    width = int(-(-lens.max(initial=1) // 8) * 8) or 8
    out = np.zeros((len(strings), width), np.uint8)
    out[np.arange(width) < lens[:, None]] = np.frombuffer(b"".join(strings), np.uint8)
    return out, lens


def neighbours(matrix: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """For each row of a sorted matrix the bytes at its start that the row before has too; -1 for the first."""
    out = np.full(len(matrix), -1, np.int64)
    if len(matrix) > 1:
        apart = matrix[1:] != matrix[:-1]
        common = np.where(apart.any(axis=1), apart.argmax(axis=1), matrix.shape[1])
        out[1:] = np.minimum(common, np.minimum(lens[1:], lens[:-1]))
    return out


def suffix_order(matrix: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The rows' order as strings."""
    words = matrix.view(">u8")
    return np.lexsort((lens, *(words[:, i] for i in range(words.shape[1] - 1, -1, -1))))


_MARKS = "digest binary, tid binary, place long, last long, single boolean, known boolean"


def block_marks(follows: list[bytes], phrases: list[bytes], lows: np.ndarray, size: int, before: int, after: int) -> tuple[np.ndarray, list[tuple[int, int, bool]]]:
    """Which windows of a sorted block are repeated (a row of offsets for each), and its windows at either edge as (row, offset, whether repeated here).

    ``follows`` are sorted, and ``phrases`` are backwards; a window starts ``offset`` bytes
    before its row's place, ``lows`` at least. ``before`` and ``after`` are the bytes that the
    block's first and last row share with the rows beside it in other blocks.
    """
    right, rest = padded_bytes(follows)
    left, long = padded_bytes(phrases)
    parse_lcp = neighbours(right, rest)
    order = suffix_order(left, long)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    dictionary_lcp = neighbours(left[order], long[order])
    repeated, edge = np.zeros((len(follows), int(long.max(initial=0)) + 1), bool), []
    for offset in range(int(long.max(initial=0)) + 1):
        rows = np.flatnonzero((lows <= offset) & (long >= offset) & (rest >= size - offset))
        if not len(rows):
            continue
        parse_place = np.cumsum(parse_lcp < size - offset)
        suffix_place = np.cumsum(dictionary_lcp < offset)[rank]
        _, first, which, count = np.unique(parse_place[rows] * (len(rank) + 1) + suffix_place[rows], return_index=True, return_inverse=True, return_counts=True)
        again = count[which] > 1
        repeated[rows[again], offset] = True
        open_ = (parse_place[rows] == parse_place[0]) & (before >= size - offset) | (parse_place[rows] == parse_place[-1]) & (after >= size - offset)
        for i in np.flatnonzero(open_):
            if not again[i] or first[which[i]] == i:
                edge.append((int(rows[i]), offset, bool(again[i])))
    return repeated, edge


_BLOCK = "part long, block long, follows array<binary>, phrase array<binary>, tid array<binary>, place array<long>, low array<int>, single array<boolean>, first binary, last binary"


def _blocks(block: int):
    """Blocks of a sorted shard, each a row of lists."""

    def packed(table: pa.Table, number: int) -> pa.RecordBatch:
        columns = {name: table.column(name).combine_chunks() for name in table.column_names}
        lists = [pa.ListArray.from_arrays(pa.array([0, len(table)], pa.int32()), c.chunk(0) if isinstance(c, pa.ChunkedArray) else c) for c in columns.values()]
        ends = [pa.array([table.column("follows")[i].as_py()], pa.binary()) for i in (0, -1)]
        return pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([number]), *lists, *ends], [c.split()[0] for c in _BLOCK.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, number = [], 0, 0
        for batch in batches:
            while batch.num_rows:
                some, batch = batch.slice(0, block - rows), batch.slice(block - rows)
                held.append(some)
                rows += some.num_rows
                if rows == block:
                    yield packed(pa.Table.from_batches(held), number)
                    held, rows, number = [], 0, number + 1
        if held:
            yield packed(pa.Table.from_batches(held), number)

    return run


def shared_bytes(a: bytes | None, b: bytes | None) -> int:
    """Bytes at the start that two strings share; -1 where there is no other one."""
    if a is None or b is None:
        return -1
    n = min(len(a), len(b))
    apart = np.flatnonzero(np.frombuffer(a[:n], np.uint8) != np.frombuffer(b[:n], np.uint8))
    return int(apart[0]) if len(apart) else n


def _edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What each block's first and last row share with the rows beside them."""
    for batch in batches:
        yield pd.DataFrame([(r.part, r.block, shared_bytes(r.prior, r.first), shared_bytes(r.last, r.next)) for r in batch.itertuples()], columns=["part", "block", "before", "after"])


def numbered_blocks(contexts: DataFrame, shards: int, block: int) -> DataFrame:
    """Stored blocks of the contexts in order, with what their edges share."""
    spark = contexts.sparkSession
    ordered = contexts.repartitionByRange(shards, "follows", "phrase").sortWithinPartitions("follows", "phrase")
    folder = new_folder(spark, "blocks")
    ordered.mapInArrow(_blocks(block), _BLOCK).write.option("parquet.block.size", ROW_GROUP).parquet(folder)  # rows are large, and a group is held at once
    blocks = spark.read.schema(_BLOCK).parquet(folder)
    counts = {r["part"]: r["n"] for r in blocks.groupBy("part").agg(F.count("*").alias("n")).collect()}  # a row a shard
    first, total = {}, 0
    for part in sorted(counts):
        first[part], total = total, total + counts[part]
    offsets = spark.createDataFrame(list(first.items()), "part long, offset long")
    ends = stored(blocks.select("part", "block", "first", "last").join(offsets, "part").withColumn("at", F.col("offset") + F.col("block")), "block-ends")
    beside = ends.join(ends.select((F.col("at") + 1).alias("at"), F.col("last").alias("prior")), "at", "left").join(ends.select((F.col("at") - 1).alias("at"), F.col("first").alias("next")), "at", "left")
    edges = stored(beside.mapInPandas(_edges, "part long, block long, before int, after int"), "edges")  # its size tells Spark whether to broadcast it
    return blocks.drop("first", "last").join(edges, ["part", "block"])


def _settled(size: int):
    """Runs of repeated starts (digest is null), and windows that may be repeated in other blocks; ``_MARKS``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                follows, phrases, tids = (batch.column(c)[i].values.to_pylist() for c in ("follows", "phrase", "tid"))
                places, lows, single = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("place", "low", "single"))
                repeated, edge = block_marks(follows, phrases, lows, size, batch.column("before")[i].as_py(), batch.column("after")[i].as_py())
                out = [(None, tids[r], int(places[r]) - high, int(places[r]) - low, True, True) for r, low, high in runs_of(repeated & single.astype(bool)[:, None])]
                for r, offset, known in edge:
                    window = phrases[r][:offset][::-1] + follows[r][: size - offset]
                    start = int(places[r]) - offset
                    out.append((hashlib.blake2b(window, digest_size=16).digest(), tids[r], start, start, bool(single[r]), known))
                if out:
                    kinds = [pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]
                    yield _batch({c.split()[0]: (list(v), k) for c, v, k in zip(_MARKS.split(", "), zip(*out, strict=True), kinds, strict=True)})

    return run


def _without(size: int):
    """A text's verdict: what is removed, and the digest of the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            rows = []
            for tid, body, runs in zip(batch.column("tid").to_pylist(), batch.column("body"), batch.column("runs"), strict=True):
                if tid in seen:
                    continue
                seen.add(tid)
                blob = body.as_buffer()
                spans = merged([(r["place"], r["last"] + size - 1) for r in runs.as_py()])
                state, at = hashlib.sha256(), 0
                for low, high in spans:
                    state.update(blob[at:low])
                    at = high + 1
                state.update(blob[at:])
                rows.append((tid, sum(high - low + 1 for low, high in spans), len(spans), state.hexdigest()))
            if rows:
                columns = list(zip(*rows, strict=True))
                yield _batch({"tid": (columns[0], pa.binary()), "n_removed": (columns[1], pa.int64()), "n_spans": (columns[2], pa.int64()), "kept_sha256": (columns[3], pa.string())})

    return run


def repeated_starts(texts: DataFrame, parse: Parse = Parse(), block: int = BLOCK) -> DataFrame:
    """(tid, place, last): runs of starts of windows that also start elsewhere.

    ``texts`` holds (tid, body), the bytes of a text and a digest of them; a text that is
    there several times counts once or more, so copies of whole texts are for the caller.
    """
    spark = texts.sparkSession
    keys = texts.mapInArrow(_keys(parse), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    shared = stored(keys.filter("n > 1").select("key"), "keys")
    bits = spark.sparkContext.broadcast(bit_table(shared, "key", max(1, shared.count())))
    found = stored(texts.mapInArrow(_candidates(bits, parse), _FOUND), "phrase-ends")
    ends = found.filter("class is not null")
    classes = stored(ends.groupBy("class", "key").agg(F.sum("n").alias("rows_of_key"), F.min(F.struct("tid", "place", "low", "advance", "rest")).alias("one")), "classes")
    twice = classes.filter("rows_of_key > 1").select("class", "rows_of_key")
    whole = join_by_key(ends.drop("n"), twice, "class", ends.count())
    starts = whole.select("tid", (F.col("place") - F.col("advance") + 1).alias("place"), (F.col("place") - F.greatest("low", parse.size - F.col("rest"))).alias("last"))
    locally = found.filter("class is null").select("tid", (F.col("place") - F.col("advance") + 1).alias("place"), F.col("place").alias("last"))

    groups = cut(classes.groupBy("key").agg(F.count("*").alias("n_classes"), F.min("rows_of_key").alias("least")).filter("n_classes > 1 and least = 1").select("key", F.col("n_classes").alias("rows_of_key")))
    unsure = join_by_key(classes.select("key", "one", (F.col("rows_of_key") == 1).alias("single")), groups, "key", classes.count())
    wanted = unsure.groupBy("one.tid").agg(F.collect_list(F.struct("one.place", "one.low", "one.advance", "one.rest", "single")).alias("ends"))  # phrase ends of one text
    folder = new_folder(spark, "contexts")
    once_a_task(texts, parse).join(wanted, "tid").select("tid", "body", "ends").mapInArrow(_contexts, _CONTEXT).write.parquet(folder)
    contexts = spark.read.schema(_CONTEXT).parquet(folder)
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-contexts.count() * (parse.size + parse.rate) // SHARD_BYTES))
    blocks = numbered_blocks(contexts, shards, block)
    remove_folder(folder)
    with batches_of(spark, BLOCKS_A_BATCH):
        marks = stored(blocks.mapInArrow(_settled(parse.size), _MARKS), "marks")
    open_ = marks.filter("digest is not null")
    met = cut(open_.groupBy("digest").agg(F.count("*").alias("rows_of_key")).filter("rows_of_key > 1"))
    across = join_by_key(open_.filter("single and not known"), met, "digest", open_.count())
    inside = marks.filter("digest is null")
    return starts.unionByName(locally).unionByName(inside.select("tid", "place", "last")).unionByName(across.select("tid", "place", "last"))


def dedup_substrings(docs: DataFrame, parse: Parse = Parse(), block: int = BLOCK) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of ``docs`` (doc_id, text).

    Each byte goes that a run of ``parse.size`` bytes covers which also starts anywhere else,
    in the same text or another; overlaps count, runs never cross texts and are judged on the
    input. A null or empty text has no bytes. Rows that repeat an id are texts of their own,
    and a null id passes through; other columns are ignored. Texts are read whole, in slabs.
    """
    with batches_of(docs.sparkSession, TEXTS_A_BATCH):
        return _dedup(docs, parse, block)


def _dedup(docs: DataFrame, parse: Parse, block: int) -> DataFrame:
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    texts = docs.select(body.alias("body")).select(F.substring(F.unhex(F.sha2("body", 256)), 1, 16).alias("tid"), "body")
    own = docs.select("doc_id", body.alias("body")).select("doc_id", F.octet_length("body").cast("long").alias("n_bytes"), F.sha2("body", 256).alias("own"))
    base = stored(own.withColumn("tid", F.substring(F.unhex("own"), 1, 16)), "texts")
    copies = stored(base.groupBy("tid").agg(F.count("*").alias("rows_of_key"), F.max("n_bytes").alias("n_bytes"), F.max("own").alias("own")), "copies")
    runs = repeated_starts(texts, parse, block)
    alone = copies.filter("rows_of_key = 1").select("tid")
    spans = runs.join(alone, "tid", "left_semi").groupBy("tid").agg(F.collect_list(F.struct("place", "last")).alias("runs"))  # runs of one text
    cleaned = once_a_task(texts, parse).join(spans, "tid").select("tid", "body", "runs").mapInArrow(_without(parse.size), "tid binary, n_removed long, n_spans long, kept_sha256 string")
    gone = (F.col("rows_of_key") > 1) & (F.col("n_bytes") >= parse.size)
    verdict = copies.join(cleaned, "tid", "left").select(
        "tid",
        "rows_of_key",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, EMPTY_SHA).otherwise(F.coalesce("kept_sha256", "own")).alias("kept_sha256"),
    )
    return join_by_key(base.drop("own"), stored(verdict, "verdicts"), "tid", base.count()).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))


SQL = """
with docs as (select row_number() over () as r, doc_id, hex(encode(coalesce(text, ''))) as x, strlen(coalesce(text, '')) as n from documents),
windows as (select r, pos, md5_number(substr(x, 2 * pos + 1, 800)) as w from (select r, x, unnest(range(0, n - 399)) as pos from docs where n >= 400)),
again as (select w from windows group by w having count(*) > 1),
starts as (select r, pos, pos - lag(pos) over (partition by r order by pos) as step from windows semi join again using (w)),
spans as (select r, min(pos) as low, max(pos) + 399 as high from (select r, pos, sum((coalesce(step, 401) > 400)::int) over (partition by r order by pos) as run from starts) group by r, run),
gaps as (
  select r, count(*) as n_spans, sum(high - low + 1) as n_removed,
    list(low order by low) as lows, list(high order by low) as highs from spans group by r),
kept as (
  select doc_id, n, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans,
    case when n_spans is null then x else array_to_string(list_transform(generate_series(1, n_spans + 1), lambda i:
      substr(x, case when i = 1 then 1 else 2 * highs[i - 1] + 3 end, case when i > n_spans then 2 * n else 2 * lows[i] end - case when i = 1 then 0 else 2 * highs[i - 1] + 2 end)), '') end as rest
  from docs left join gaps using (r))
select doc_id, n as n_bytes, n_removed::bigint as n_removed, n_spans, sha256(unhex(rest)) as kept_sha256 from kept"""
