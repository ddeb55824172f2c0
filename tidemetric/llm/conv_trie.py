"""Conversation prefix trie: every distinct run of first turns, with sums over its subtree.

1. Each conversation becomes one row: 16 bytes a turn (a digest of role and text) and the
   words of each turn, after its first turns are replaced by those of its group's head.
   Texts never travel.
2. Rows are range-partitioned by (turn digests, conv_id), so that every node of the trie
   is a run of neighbouring rows, and copies of one conversation spread over shards. A
   sorted shard is packed into blocks of bounded size.
3. A block is a padded matrix of turn ids: numpy's lexsort orders it, and column changes
   accumulated by OR along each row mark where nodes start at every depth. A row shares
   ``(marks not set)`` turns with the row before it, which makes all measures sums over
   rows: leaves are rows that the next row does not go on from, and a node saves the words
   of a turn for each member but the first. ``reduceat`` sums them at every depth.
4. Only nodes at the edges of a block can go on in the next one: they are keyed by a digest
   of their turns and recombined in Spark. Members that end in such a node are hashed in
   order, piece by piece, by one task a node: SHA-256 has no other order, but the task
   holds one piece at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemetric.llm.common import join_by_key, stored, table

WORD = r"[^\x20\x09-\x0D]+"
#: Conversations ``c`` of one group share the head ``c - c % GROUP``; a head gives fewer than ``HEAD_TURNS`` turns.
GROUP, HEAD_TURNS = 20, 4
#: Cells of a block's padded matrix and its rows, at most (a longer conversation is a block of its own).
CELLS, BLOCK_ROWS = 1 << 19, 1 << 16
#: Turns that a shard holds, about.
SHARD_TURNS = 1 << 22
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
_DIGEST = 16


def head_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes from its head: crc32 of its decimal id, modulo 4."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % HEAD_TURNS).cast("int")


def turn_rows(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, as structs (turn, digest in hex, words)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    words = F.regexp_count(text, F.lit(WORD)).cast("int")
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), digest.alias("digest"), words.alias("words")).alias("t"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))  # digests of one conversation


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, seq binary, words array<int>, n_turns): the head's first turns, then the conversation's own after as many."""
    own = stored(turn_rows(conversations), "turns")
    heads = own.filter(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("head"), F.slice("turns", 1, HEAD_TURNS - 1).alias("first"))
    h = head_turns(F.col("conv_id"))
    joined = own.withColumn("head", F.col("conv_id") - F.col("conv_id") % GROUP).join(heads, "head", "left")  # a head has fewer than 40 conversations
    none = F.slice("turns", 1, 0)
    turns = F.concat(F.coalesce(F.slice("first", F.lit(1), h), none), F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0))))
    seq = F.unhex(F.array_join(F.transform("t", lambda x: x["digest"]), ""))
    return joined.select("conv_id", turns.alias("t")).select("conv_id", seq.alias("seq"), F.transform("t", lambda x: x["words"]).alias("words"), F.size("t").alias("n_turns"))


_BLOCK = "block long, part long, ids binary, lens binary, seqs binary, words binary, first binary, last binary"


def _blocks(cells: int, most: int):
    """Blocks of a sorted shard, each a packed row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, number = TaskContext.get().partitionId(), 0
        held, width = [], 0

        def flush() -> pd.DataFrame:
            ids, seqs, words = zip(*held, strict=True)
            lens = np.array([len(s) // _DIGEST for s in seqs], np.int64)
            flat = np.concatenate([np.asarray(w, np.int64) for w in words])
            return pd.DataFrame({"block": [number], "part": [part], "ids": [np.array(ids, np.int64).tobytes()], "lens": [lens.tobytes()], "seqs": [b"".join(seqs)], "words": [flat.tobytes()], "first": [seqs[0]], "last": [seqs[-1]]})

        for batch in batches:
            for row in zip(batch["conv_id"], map(bytes, batch["seq"]), batch["words"], strict=True):
                wide = max(width, len(row[1]) // _DIGEST)
                if held and (wide * (len(held) + 1) > cells or len(held) == most):
                    yield flush()
                    number += 1
                    held, wide = [], len(row[1]) // _DIGEST
                held.append(row)
                width = wide
        if held:
            yield flush()

    return run


def shared_turns(a: bytes | None, b: bytes | None) -> int:
    """Turns at the start that two sequences share; -1 where there is no other one."""
    if a is None or b is None:
        return -1
    n = min(len(a), len(b)) // _DIGEST
    x, y = (np.frombuffer(s[: n * _DIGEST], "V16") for s in (a, b))
    apart = np.flatnonzero(x != y)
    return int(apart[0]) if len(apart) else n


def _edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What each block's first and last row share with their neighbours in the blocks beside it."""
    for batch in batches:
        rows = [(r.at, shared_turns(r.before, r.first), -1 if r.before is None else len(r.before) // _DIGEST, shared_turns(r.last, r.after), -1 if r.after is None else len(r.after) // _DIGEST) for r in batch.itertuples()]
        yield pd.DataFrame(rows, columns=["at", "left", "left_len", "right", "right_len"])


def numbered_blocks(sequences: DataFrame, cells: int, most: int, shard_turns: int) -> DataFrame:
    """Stored blocks of the sorted corpus, numbered through (``at``), with what their edges share (``_edges``)."""
    spark = sequences.sparkSession
    turns = sequences.agg(F.coalesce(F.sum(F.col("n_turns") + 1), F.lit(0))).first()[0]
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns // shard_turns))
    ordered = sequences.select("conv_id", "seq", "words").repartitionByRange(shards, "seq", "conv_id").sortWithinPartitions("seq", "conv_id")
    blocks = stored(ordered.mapInPandas(_blocks(cells, most), _BLOCK), "blocks")
    counts = {r["part"]: r["n"] for r in blocks.groupBy("part").agg(F.count("*").alias("n")).collect()}  # a row a shard
    first, total = {}, 0
    for part in sorted(counts):
        first[part], total = total, total + counts[part]
    offsets = spark.createDataFrame(list(first.items()), "part long, offset long")
    placed = blocks.join(offsets, "part").withColumn("at", F.col("offset") + F.col("block")).drop("part", "block", "offset")
    ends = placed.select("at", "first", "last")
    beside = ends.join(ends.select((F.col("at") + 1).alias("at"), F.col("last").alias("before")), "at", "left").join(ends.select((F.col("at") - 1).alias("at"), F.col("first").alias("after")), "at", "left")
    return placed.drop("first", "last").join(beside.mapInPandas(_edges, "at long, left int, left_len int, right int, right_len int"), "at")


def padded_ids(lens: np.ndarray, seqs: bytes, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Padded matrices of turn ids (in the order of their digests, 0 beyond the end) and of words."""
    turns = np.frombuffer(seqs, [("a", ">u8"), ("b", ">u8")])
    high, low = turns["a"].astype(np.uint64), turns["b"].astype(np.uint64)
    order = np.lexsort((low, high))
    new = np.ones(len(order), bool)
    new[1:] = (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    inside = np.arange(lens.max(initial=0)) < lens[:, None]
    ids, counts = np.zeros(inside.shape, np.int64), np.zeros(inside.shape, np.int64)
    ids[inside], counts[inside] = rank, words
    return ids, counts


_NODES = "at long, depth int, side int, key binary, parent_key binary, parent_side int, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, piece string, left_open boolean, right_open boolean"
_SIDES = ("neither", "left", "right")


def _prefix_keys(seq: bytes, depth: int) -> list[bytes]:
    """Digests of the first 0, 1, ... ``depth`` turns."""
    state, out = hashlib.md5(usedforsecurity=False), []
    for d in range(depth + 1):
        out.append(state.digest())
        state.update(seq[d * _DIGEST : (d + 1) * _DIGEST])
    return out


def block_nodes(at: int, conv_ids: np.ndarray, lens: np.ndarray, seqs: bytes, words: np.ndarray, left: int, left_len: int, right: int, right_len: int) -> pd.DataFrame:
    """Nodes, and parts of nodes that go on in other blocks, of one block; ``_NODES``.

    ``left`` and ``right`` are the turns that the first and last row share with their
    neighbours (-1: there is none), ``left_len`` and ``right_len`` the neighbours' lengths.
    """
    ids, counts = padded_ids(lens, seqs, words)
    n, width = ids.shape
    order = np.lexsort((conv_ids, *ids.T[::-1]))
    starts_at = np.cumsum(lens) - lens
    ids, counts, conv_ids, lens, starts_at = ids[order], counts[order], conv_ids[order], lens[order], starts_at[order]
    change = np.ones((n, width), bool)
    change[1:] = ids[1:] != ids[:-1]
    change[0, : max(left, 0)] = False
    starts = np.logical_or.accumulate(change, axis=1)  # a node of depth d + 1 starts, or a row ends
    shared = np.minimum((~starts).sum(axis=1), lens)  # turns shared with the row before
    after = np.append(np.minimum(shared[1:], lens[:-1]), right)
    leaf = (after < lens).astype(np.int64)
    saved = np.cumsum(np.where(starts, 0, counts)[:, ::-1], axis=1)[:, ::-1]  # words from depth d + 1 on that members repeat
    opens = starts & (ids > 0)
    same = np.append((shared[1:] == lens[1:]) & (lens[1:] == lens[:-1]), False)  # the next row is an equal sequence
    run_end = np.flatnonzero(~same)
    run_end = run_end[np.searchsorted(run_end, np.arange(n))] + 1
    to_left, to_right = left >= 0 and left == left_len, right >= 0 and right == right_len
    first_seq = seqs[starts_at[0] * _DIGEST : (starts_at[0] + lens[0]) * _DIGEST]
    last_seq = seqs[starts_at[-1] * _DIGEST : (starts_at[-1] + lens[-1]) * _DIGEST]
    keys = {1: _prefix_keys(first_seq, min(left, int(lens[0]))), 2: _prefix_keys(last_seq, min(right, int(lens[-1])))}
    texts = None
    out, above = [], None
    for d in range(width + 1):
        if d:
            mark = starts[:, d - 1].copy()
            mark[0] = True
            bound = np.flatnonzero(mark)
            real = ids[bound, d - 1] > 0
        else:
            bound, real = np.zeros(1, np.int64), np.ones(1, bool)
        if not real.any():
            break
        stop = np.append(bound[1:], n)
        smallest = np.minimum.reduceat(conv_ids, bound)
        open_left, open_right = (bound == 0) & (d <= left), (stop == n) & (d <= right) & (lens[n - 1] >= d)
        side = np.where(open_left, 1, np.where(open_right, 2, 0))
        frame = {
            "at": at, "depth": d, "side": side, "conv_id": smallest, "n_convs": stop - bound, "left_open": open_left, "right_open": open_right,
            "n_children": np.add.reduceat(opens[:, d].astype(np.int64), bound) if d < width else np.zeros(len(bound), np.int64),
            "n_leaves": np.add.reduceat(leaf, bound),
            "saved_tokens": np.add.reduceat(saved[:, max(d - 1, 0)], bound) if width else np.zeros(len(bound), np.int64),
        }
        frame = {k: v[real] if isinstance(v, np.ndarray) else v for k, v in frame.items()}
        parent = np.searchsorted(above["bound"], bound, "right") - 1 if d else None
        frame["parent_conv_id"] = np.where(above["side"][parent] == 0, above["smallest"][parent], 0)[real] if d else 0
        frame["parent_side"] = above["side"][parent][real] if d else 0
        frame["key"] = [keys[s][d] if s else None for s in side[real]]
        frame["parent_key"] = [keys[p][d - 1] if s and d else None for s, p in zip(side[real], above["side"][parent][real] if d else side[real], strict=True)]
        ends, pieces = [], []
        for b in bound[real]:
            if lens[b] != d:
                ends.append(None)
                pieces.append(None)
                continue
            texts = texts if texts is not None else list(map(str, conv_ids.tolist()))
            text = ",".join(texts[b : run_end[b]])
            split = (b == 0 and to_left and left == d) or (run_end[b] == n and to_right and right == d)
            ends.append(None if split else hashlib.sha256(text.encode()).hexdigest())
            pieces.append(text if split else None)
        frame["ends_sha256"], frame["piece"] = ends, pieces
        out.append(pd.DataFrame(frame))
        above = {"bound": bound, "side": side, "smallest": smallest}
    return pd.concat(out)[[c.split()[0] for c in _NODES.split(", ")]]


def _nodes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for r in batch.itertuples():
            ids, lens, words = (np.frombuffer(x, np.int64) for x in (r.ids, r.lens, r.words))
            yield block_nodes(r.at, ids, lens, bytes(r.seqs), words, r.left, r.left_len, r.right, r.right_len)


def _chained(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 over the pieces of each key, which come in order."""
    key, state = None, None
    for batch in batches:
        done = []
        for k, piece in zip(map(bytes, batch["key"]), batch["piece"], strict=True):
            if k != key:
                if key is not None:
                    done.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256(piece.encode())
            else:
                state.update(b"," + piece.encode())
        yield pd.DataFrame(done, columns=["key", "chained"])
    if key is not None:
        yield pd.DataFrame([(key, state.hexdigest())], columns=["key", "chained"])


_MEASURES = ("n_convs", "n_children", "n_leaves", "saved_tokens")


def prefix_trie(conversations: DataFrame, cells: int = CELLS, most: int = BLOCK_ROWS, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """The trie's nodes: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``conversations`` holds conv_id, turn, role and text; other columns are ignored. Turns
    are in order of ``turn``, null first; those that tie are in order of the digest of role
    and text, and repeated rows are turns each. A null role or text is empty. Rows without a
    conv_id belong to no conversation and are left out. A conversation without turns is a
    member of the root alone; no conversations give no nodes. Texts of any length are
    digested where they are read; a conversation's turns, 24 bytes each, are one row.
    """
    sequences = stored(rebuilt(conversations), "sequences")
    nodes = stored(numbered_blocks(sequences, cells, most, shard_turns).mapInPandas(_nodes, _NODES), "nodes")
    parts = nodes.filter("side > 0")
    sums = parts.groupBy("key", "depth").agg(F.first("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), *[F.sum(m).alias(m) for m in _MEASURES], F.max("ends_sha256").alias("ends_sha256"), F.count("*").alias("rows_of_key"))
    pieces = parts.filter("piece is not null").select("key", "at", "piece").repartition("key").sortWithinPartitions("key", "at")
    chained = pieces.mapInPandas(_chained, "key binary, chained string")
    whole = stored(sums.join(chained, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", "chained", F.lit(EMPTY_SHA))).drop("chained"), "edge-nodes")
    parents = whole.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    edge = whole.join(parents, "parent_key", "left")
    # a closed node under an open one: its block has that node's part, on the same side
    named = join_by_key(parts.select("at", "depth", "side", "key"), whole.select("key", "rows_of_key", F.col("conv_id").alias("parent_conv_id")), "key", parts.count())
    above = named.select("at", (F.col("depth") + 1).alias("depth"), F.col("side").alias("parent_side"), "parent_conv_id")
    closed = nodes.filter("side = 0")
    orphans = closed.filter("parent_side > 0").drop("parent_conv_id").join(above, ["at", "depth", "parent_side"])
    kept = closed.filter("parent_side = 0").withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.col("parent_conv_id")))
    columns = ["conv_id", "depth", "parent_conv_id", *_MEASURES, "ends_sha256"]
    out = kept.select(columns).unionByName(orphans.select(columns)).unionByName(edge.select(columns))
    return out.withColumns({"depth": F.col("depth").cast("long"), "ends_sha256": F.coalesce("ends_sha256", F.lit(EMPTY_SHA))})


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


SQL = r"""
with turns as (
  select conv_id, list({'d': md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 'w': len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))}
    order by turn nulls first, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) as t
  from conversations where conv_id is not null group by conv_id),
crc as (
  select conv_id, t, xor(list_reduce(flatten(list_transform(string_split(conv_id::varchar, ''), lambda s: [ascii(s)::bigint, -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda c, x: case when x >= 0 then xor(c, x) when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, 4294967295::bigint), 4294967295::bigint) % 4 as h
  from turns),
seqs as (
  select c.conv_id, coalesce(p.t[1:c.h], []) || c.t[c.h + 1:] as t
  from crc c left join turns p on p.conv_id = c.conv_id - c.conv_id % 20),
runs as (select conv_id, list_transform(t, lambda x: x.d) as d, list_transform(t, lambda x: x.w) as w from seqs),
members as (select conv_id, len(d) as n, unnest(generate_series(0, len(d))) as depth, d, w from runs),
nodes as (
  select d[1:depth] as node, depth, min(conv_id) as conv_id, count(*) as n_convs, any_value(case when depth = 0 then 0 else w[depth] end) as words,
    coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (n = depth), '') as ends
  from members group by 1, 2),
children as (select node[1:depth - 1] as node, count(*) as n from nodes where depth > 0 group by 1),
flat as (select n.*, coalesce(c.n, 0) as n_children from nodes n left join children c using (node)),
under as (select node[1:up] as node, sum((n_children = 0)::bigint) as n_leaves, sum((n_convs - 1) * words) as saved_tokens
  from (select *, unnest(generate_series(0, depth)) as up from flat) group by 1)
select f.conv_id, f.depth, p.conv_id as parent_conv_id, f.n_convs, f.n_children, u.n_leaves::bigint as n_leaves, u.saved_tokens::bigint as saved_tokens, sha256(f.ends) as ends_sha256
from flat f join under u on u.node = f.node left join nodes p on f.depth > 0 and p.node = f.node[1:f.depth - 1]"""
