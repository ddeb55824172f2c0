"""N-gram Jaccard join: size-aware, heavy and light sets apart, exact.

Documents with equal shingle sets are one class; everything below works on classes.

* **Light** sets (up to a boundary) enumerate all their subsets of a fixed size: two
  light sets link only if they share a subset as large as the overlap that their sizes
  ask for, so subsets are the keys of candidate buckets.
* **Heavy** sets scan inverted lists of their shingles, rarest first: as only a set's
  first ``n - ceil(t n) + 1`` shingles need lists, and a shingle at positions i and j
  leaves an overlap of ``min(n - i, m - j)`` at most, few pairs remain.
* The boundary is the size at which the cost of keys (light) and of lists (heavy) is
  least. Keys are counted; a list costs its postings and the members that each of them
  meets, as measured on the lists themselves. Small sets of common shingles have long
  lists and become light; rare shingles make lists cheap and the boundary low.

How rare a shingle is comes from all documents, at any size of the corpus: tasks send their
shingles in packed form to hash ranges, a range counts them in one group and answers with
the number of documents of each shingle that is in two or more. A shingle of more than
``MANY`` documents of a chunk is sent once with their number, and which they are stays in
the chunk's own row, so one that all documents hold adds an entry a chunk to its range, not
one a document. A shingle without an answer is in no other document and needs no list; the others are ordered by their number
of documents. Thus passages that thousands of documents share come last in every set and
hardly ever into a list, and shingles are never exploded into rows.

Large buckets are not expanded into pairs. Each bucket links its members to one pivot, its
most central member; components of these exact links follow, and buckets that lie in one
component are settled. Members are counted in cells of equal (size, position): cell pairs
that cannot link, or that lie in one component already, are settled as cells, and what is
left is verified pair by pair while it is ``DENSE`` pairs a member at most. Members of
other buckets (documents that share common shingles without being alike) are dealt again
by segments: shingles are hashed into one segment more than two linked sets can differ in,
so linked sets agree on a whole segment. What is left quadratic is a family of documents
that agree on whole segments, just below the bound, without a link.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemetric.llm.bits import bit_table, has_bit
from tidemetric.llm.common import cut, join_by_key, small_batches, stored, table
from tidemetric.llm.components import components
from tidemetric.llm.words import mix, shingle_sets, text_buffers, words_of

WORDS = 3
PERCENT = 90
#: Sizes for which keys are considered: beyond it subsets are always more than any list is worth.
MOST_LIGHT = 24
#: Pairs that may be tried one by one for each open member of a bucket, and its cells of equal size and position.
DENSE, MOST_CELLS = 100, 1000
#: Shingles and documents of a chunk that is sent at a time, and about how many shingles a range counts in one group.
FLUSH, CHUNK_DOCS, RANGE_SHINGLES = 1 << 21, 60_000, 1 << 20
#: In how many documents of a chunk a shingle is still sent with each of them.
MANY = 4
#: About how many bytes of text make a shingle, to choose the number of ranges.
SHINGLE_BYTES = 6


def least_overlap(a: int, b: int, percent: int) -> int:
    return -(-percent * (a + b) // (100 + percent))


def subset_sizes(n: int, boundary: int, percent: int) -> list[int]:
    """Sizes of the subsets that a light set of ``n`` enumerates for partners up to the boundary.

    Partners of its own size that need all ``n`` shingles are the set itself, in its class.
    """
    partners = range(-(-percent * n // 100), min(100 * n // percent, boundary) + 1)
    return sorted({o for b in partners if (o := least_overlap(n, b, percent)) <= min(n, b) and not (b == n == o)})


def key_count(n: int, boundary: int, percent: int) -> int:
    return sum(int(np.prod(np.arange(o + 1, n + 1, dtype=float)) / np.prod(np.arange(1, n - o + 1, dtype=float))) for o in subset_sizes(n, boundary, percent))


def prefix_length(n, percent: int):
    """How many of a set's first shingles need a list: two linked sets share one of these."""
    return n - -(-percent * n // 100) + 1


def choose_boundary(sizes: dict[int, int], list_costs: dict[int, float], percent: int = PERCENT) -> int:
    """The boundary of least cost, from the number of sets and the summed cost of their lists per size.

    Light sets that can link with heavy ones stay in lists as well, and cost both.
    """

    def cost(boundary: int) -> float:
        keys = sum(c * key_count(n, boundary, percent) for n, c in sizes.items() if n <= boundary)
        return keys + sum(c for n, c in list_costs.items() if 100 * n >= percent * (boundary + 1))

    return min(range(MOST_LIGHT + 1), key=lambda b: (cost(b), b))


def subset_keys(shingles: np.ndarray, boundary: int, percent: int) -> list[int]:
    """Keys of all subsets of the sizes asked for; a key does not depend on order."""
    n = len(shingles)
    values = [int(v) for v in mix(shingles.view(np.uint64) + np.uint64(11))]
    total = sum(values)
    out = set()
    for o in subset_sizes(n, boundary, percent):
        sums = [(total - sum(gone)) & 0xFFFFFFFFFFFFFFFF for gone in combinations(values, n - o)]
        out.update(mix(np.array(sums, np.uint64) + np.array(o * 0xA0761D6478BD642F & 0xFFFFFFFFFFFFFFFF, np.uint64)).view(np.int64).tolist())
    return sorted(out)


def _set_key(shingles: np.ndarray) -> bytes | None:
    return hashlib.md5(shingles.tobytes(), usedforsecurity=False).digest() if len(shingles) else None


def _class_id(key: bytes) -> int:
    return int.from_bytes(key[:8], "big", signed=True)


def _sets(batch: pa.RecordBatch, words: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    for first, data, offsets in text_buffers(batch.column("text"), 1 << 20):
        row, _, _, hashes = words_of(data, offsets)
        yield first, shingle_sets(row, hashes, words, len(offsets) - 1)


_SENT = "range long, chunk long, first long, tokens binary, docs binary, many binary, times binary, ids binary, nulls binary, keys binary, sizes binary, fresh binary, small binary"
_SENT_KINDS = [pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * 10]


def _six(tokens: np.ndarray) -> bytes:
    return np.ascontiguousarray(tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _tokens(blobs) -> np.ndarray:
    raw = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :6] = raw
    return out.view("<u8")[:, 0].astype(np.uint64)


def _chunk(chunk: int, ids: list, keys: list, fresh: list, sets: list, sizes: list, ranges: int) -> pa.RecordBatch:
    """Rows of one chunk: its header, and per range the shingles of its fresh sets with their documents' positions.

    A shingle of more than ``MANY`` documents is in ``many`` with its number of ``times``;
    the header keeps the positions of these, and ``first`` is a range's place among them.
    """
    where = np.repeat(np.flatnonzero(fresh).astype(np.uint16), [len(s) for s in sets])
    full = np.concatenate(sets).view(np.uint64) if sets else np.zeros(0, np.uint64)
    tokens = full >> np.uint64(16)
    place = ((full & np.uint64(0xFFFFFFFF)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
    order = np.lexsort((tokens, place))
    tokens, where, place = tokens[order], where[order], place[order]
    start = np.flatnonzero(np.r_[len(tokens) > 0, (tokens[1:] != tokens[:-1]) | (place[1:] != place[:-1])])
    times = np.diff(np.r_[start, len(tokens)])
    often = times > MANY
    apart = ~np.repeat(often, times)
    small = b"".join(s.tobytes() for s in sets if len(s) <= MOST_LIGHT)
    held, runs = where[~apart].tobytes(), times[often].astype(np.uint16)
    rows = [(-1 - chunk, chunk, 0, None, held, None, runs.tobytes(), np.array([i or 0 for i in ids], np.int64).tobytes(), bytes(i is None for i in ids), b"".join(k or bytes(16) for k in keys), np.array(sizes, np.int64).tobytes(), bytes(fresh), small)]
    many, many_place = tokens[start[often]], place[start[often]]
    tokens, where, place = tokens[apart], where[apart], place[apart]
    used = np.union1d(place, many_place)
    edges, many_edges = ([np.searchsorted(p, used, side) for side in ("left", "right")] for p in (place, many_place))
    for r, low, high, first, last in zip(used, *edges, *many_edges, strict=True):
        rows.append((int(r), chunk, int(first), _six(tokens[low:high]), where[low:high].tobytes(), _six(many[first:last]), runs[first:last].tobytes(), *[None] * 6))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _SENT_KINDS, strict=True)], [f.split()[0] for f in _SENT.split(", ")])


def _sent(words: int, ranges: int):
    """Chunks of the task's documents; a set is sent once a task, every document is in a header."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        seen: set[bytes] = set()
        ids, keys, fresh, sets, sizes, held = [], [], [], [], [], 0
        for batch in batches:
            names = batch.column("doc_id").to_pylist()
            for first, some in _sets(batch, words):
                for r, s in enumerate(some):
                    key = _set_key(s)
                    ids.append(names[first + r])
                    keys.append(key)
                    sizes.append(len(s))
                    fresh.append(key is not None and key not in seen)
                    if fresh[-1]:
                        seen.add(key)
                        sets.append(s)
                        held += len(s)
                    if held >= FLUSH or len(ids) >= CHUNK_DOCS:
                        yield _chunk(chunk, ids, keys, fresh, sets, sizes, ranges)
                        chunk += 1
                        ids, keys, fresh, sets, sizes, held = [], [], [], [], [], 0
        if ids:
            yield _chunk(chunk, ids, keys, fresh, sets, sizes, ranges)

    return run


_ANSWERS = "chunk long, first long, tokens binary, docs binary, counts binary, many binary, many_counts binary, times binary, ids binary, nulls binary, keys binary, sizes binary, fresh binary, small binary"


def _answered(group: pd.DataFrame) -> pd.DataFrame:
    """Of a range's shingles those in two documents or more, with their number of documents, back to each chunk."""
    names = [f.split()[0] for f in _ANSWERS.split(", ")]
    if group["range"].iloc[0] < 0:
        return group.assign(counts=None, many_counts=None)[names]
    tokens, many = _tokens(group["tokens"]), _tokens(group["many"])
    times = np.frombuffer(b"".join(group["times"]), np.uint16)
    distinct, at = np.unique(np.concatenate([tokens, many]), return_inverse=True)
    docs = np.bincount(at, np.concatenate([np.ones(len(tokens)), times]), len(distinct))
    counts = np.minimum(docs, 0xFFFF).astype(np.uint16)[at]
    counts, many_counts = counts[: len(tokens)], counts[len(tokens) :]
    rows, low, start = [], 0, 0
    for chunk, first, blob, often in zip(group["chunk"], group["first"], group["docs"], group["many"], strict=True):
        where = np.frombuffer(blob, np.uint16)
        high, end = low + len(where), start + len(often) // 6
        keep = counts[low:high] > 1
        rows.append((chunk, first, _six(tokens[low:high][keep]), where[keep].tobytes(), counts[low:high][keep].tobytes(), often, many_counts[start:end].tobytes()))
        low, start = high, end
    return pd.DataFrame(rows, columns=names[:7]).reindex(columns=names).astype(object).where(lambda d: d.notna(), None).astype({"chunk": "int64", "first": "int64"})


_READ = "bucket long, cid long, n long, at long, doc_id long, key binary, small binary"


def _read(percent: int):
    """A chunk's documents (doc_id, key, n, cid, small) and the list postings (bucket, cid, n, at) of its sets."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        head = group[group["ids"].notna()].iloc[0]
        ids, sizes, fresh = np.frombuffer(head["ids"], np.int64), np.frombuffer(head["sizes"], np.int64), np.frombuffer(head["fresh"], np.uint8) > 0
        null = np.frombuffer(head["nulls"], np.uint8) > 0
        raw = head["keys"]
        keys = [raw[16 * i : 16 * i + 16] if n else None for i, n in enumerate(sizes)]
        cids = np.array([_class_id(k) if k else 0 for k in keys], np.int64)
        small, low = [], 0
        for n, new in zip(sizes, fresh, strict=True):
            has = new and n <= MOST_LIGHT
            small.append(head["small"][low : low + 8 * n] if has else None)
            low += 8 * int(n) if has else 0
        base = pd.DataFrame({"bucket": None, "cid": cids, "n": sizes, "at": None, "doc_id": pd.array(ids, "Int64"), "key": keys, "small": small})
        base.loc[null, "doc_id"] = pd.NA
        parts = group[group["tokens"].notna()].sort_values("first", kind="stable")
        parts = parts[(parts["tokens"].str.len() > 0) | (parts["many"].str.len() > 0)]
        times = np.frombuffer(head["times"], np.uint16)
        many, many_counts = _tokens(parts["many"]), np.frombuffer(b"".join(parts["many_counts"]), np.uint16)
        tokens = np.concatenate([_tokens(parts["tokens"]), np.repeat(many, times)])
        where, counts = (np.concatenate([np.frombuffer(b"".join(parts[c]), np.uint16), more]) for c, more in (("docs", np.frombuffer(head["docs"], np.uint16)), ("counts", np.repeat(many_counts, times))))
        order = np.lexsort((tokens, counts, where))
        tokens, where = tokens[order], where[order].astype(np.int64)
        shared = np.bincount(where, minlength=len(sizes))
        rank = np.arange(len(where)) - (np.cumsum(shared) - shared)[where]
        at = (sizes - shared)[where] + rank
        keep = at < prefix_length(sizes, percent)[where]
        lists = pd.DataFrame({"bucket": mix(tokens[keep] + np.uint64(0x51)).view(np.int64), "cid": cids[where[keep]], "n": sizes[where[keep]], "at": at[keep]})
        out = pd.concat([base.astype({"bucket": "Int64", "at": "Int64"}), lists.astype("Int64")])
        return out[[f.split()[0] for f in _READ.split(", ")]]

    return run


def _light(boundary: int, percent: int):
    """(bucket, cid, n, at): subset keys of light sets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys = [subset_keys(np.frombuffer(s, np.int64), boundary, percent) for s in batch["small"]]
            many = [len(k) for k in keys]
            yield pd.DataFrame({"bucket": np.array([x for k in keys for x in k], np.int64), "cid": np.repeat(batch["cid"].to_numpy(), many), "n": np.repeat(batch["n"].to_numpy(), many), "at": np.int64(0)})

    return run


def _wanted_sets(bits, words: int):
    """(key, cid, n, shingles) of the classes that the filter lets through; once a class and task."""
    kinds = [pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for _, sets in _sets(batch, words):
                keys = [_set_key(s) for s in sets]
                ids = np.array([_class_id(k) if k else 0 for k in keys], np.int64)
                out = []
                for r in np.flatnonzero(has_bit(bits.value, mix(ids.view(np.uint64)))):
                    if keys[r] is not None and keys[r] not in seen:
                        seen.add(keys[r])
                        out.append((keys[r], int(ids[r]), len(sets[r]), sets[r].tolist()))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["key", "cid", "n", "shingles"])

    return run


def _reachable(n: Column, i: Column, m: Column, j: Column, percent: int) -> Column:
    """Whether sets of sizes n and m that first meet at positions i and j can still link."""
    return F.ceil(percent * (n + m) / (100 + percent)) <= F.least(n - i, m - j)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the class pairs (a, b) whose whole sets link."""
    one = sets.select(F.col("cid").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb"))
    both = pairs.join(one, "a").join(two, "b").withColumn("common", F.size(F.array_intersect("sa", "sb")))
    return cut(both.filter(100 * F.col("common") >= percent * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b"))


def _pair(x: Column, y: Column) -> tuple[Column, Column]:
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def size_class(n: int, percent: int) -> tuple[int, int, int]:
    """(number of the size's class, largest size in it and below it): linked sets are of one class or of neighbours."""
    number, low = 0, 1
    while (after := 100 * low // percent + 1) <= n:
        number, low = number + 1, after
    return number, after - 1, low - 1


def most_apart(n: int, percent: int) -> int:
    """In how many shingles two linked sets can differ, the smaller of size ``n`` at most."""
    return (n + 100 * n // percent) * (100 - percent) // (100 + percent)


def segment_keys(shingles: np.ndarray, percent: int) -> np.ndarray:
    """Keys of the segments of a set, towards sets of its own size class or above, and of the class below."""
    number, largest, below = size_class(len(shingles), percent)
    tokens = shingles.view(np.uint64)
    place, value = mix(tokens ^ np.uint64(0x5E61)), mix(tokens + np.uint64(0x7F))
    out = []
    for c, size in ((number, largest), (number - 1, below)):
        parts = most_apart(size, percent) + 1
        sums = np.zeros(parts, np.uint64)
        np.add.at(sums, (place % np.uint64(parts)).astype(np.int64), value)
        out.append(mix(sums + mix(np.arange(parts, dtype=np.uint64) + np.uint64((c + 1) << 32))).view(np.int64))
    return np.concatenate(out)


def _segments(percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys = [segment_keys(np.asarray(s, np.int64), percent) for s in batch["shingles"]]
            many = [len(k) for k in keys]
            yield pd.DataFrame({"bucket": np.concatenate(keys), "cid": np.repeat(batch["cid"].to_numpy(), many), "n": np.repeat(batch["n"].to_numpy(), many), "at": np.int64(0)})

    return run


def shared_buckets(postings: DataFrame) -> DataFrame:
    """Stored postings of buckets with two members or more, with ``members``."""
    full = cut(postings.groupBy("bucket").agg(F.count("*").alias("rows_of_key")).filter("rows_of_key > 1").withColumn("members", F.col("rows_of_key")))
    return stored(join_by_key(postings, full, "bucket", postings.count()), "lists")


def class_links(postings: DataFrame, sets: DataFrame, percent: int, split: bool = True) -> DataFrame:
    """Links that connect the classes in ``sets`` just as all links between them do.

    ``postings`` are stored (bucket, cid, n, at, members). With ``split``, members of
    buckets that leave more than ``DENSE`` pairs a member open are dealt again by segments.
    """
    pivots = cut(postings.groupBy("bucket").agg(F.min(F.struct("at", "n", "cid")).alias("pivot"), F.count("*").alias("rows_of_key")))
    met = join_by_key(postings, pivots, "bucket", postings.count()).filter(F.col("cid") != F.col("pivot.cid"))
    spokes = cut(met.filter(_reachable(F.col("n"), F.col("at"), F.col("pivot.n"), F.col("pivot.at"), percent)).select(*_pair(F.col("cid"), F.col("pivot.cid"))).distinct())
    links = _verified(spokes, sets, percent)
    roots = components(links)

    named = cut(postings.join(roots, F.col("cid") == F.col("node"), "left").select("bucket", "cid", "n", "at", F.coalesce("root", "cid").alias("root")))
    mixed = cut(named.groupBy("bucket").agg(F.min("root").alias("l"), F.max("root").alias("h"), F.count("*").alias("rows_of_key")).filter("l < h").select("bucket", "rows_of_key"))
    open_members = stored(join_by_key(named, mixed, "bucket", named.count()), "open")
    cells = cut(open_members.groupBy("bucket", "n", "at").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("size")))
    crowded = cells.groupBy("bucket").agg(F.count("*").alias("cells")).filter(F.col("cells") > MOST_CELLS).select("bucket")
    settled = cells.join(crowded, "bucket", "left_anti") if split else cells
    x, y = settled.alias("x"), settled.alias("y")
    ordered = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.at") <= F.col("y.at")))
    apart = ~((F.col("x.low") == F.col("x.high")) & (F.col("y.low") == F.col("y.high")) & (F.col("x.low") == F.col("y.low")))
    meets = _reachable(F.col("x.n"), F.col("x.at"), F.col("y.n"), F.col("y.at"), percent)
    met_cells = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & ordered & apart & meets).select(
        F.col("x.bucket").alias("bucket"), F.col("x.n").alias("n"), F.col("x.at").alias("at"), F.col("y.n").alias("m"), F.col("y.at").alias("to"), (F.col("x.size") * F.col("y.size")).alias("tries")
    )
    cell_pairs = cut(met_cells)
    heavy = cell_pairs.groupBy("bucket").agg(F.sum("tries").alias("tries")).join(cells.groupBy("bucket").agg(F.sum("size").alias("open")), "bucket").filter(F.col("tries") > DENSE * F.col("open")).select("bucket")
    dense = cut(crowded.unionByName(heavy)) if split else None
    few = open_members.join(dense, "bucket", "left_anti") if split else open_members
    other = few.select("bucket", F.col("cid").alias("cid2"), F.col("n").alias("m"), F.col("at").alias("to"), F.col("root").alias("root2"))
    open_pairs = cell_pairs.join(few, ["bucket", "n", "at"]).join(other, ["bucket", "m", "to"]).filter("root <> root2").select(*_pair(F.col("cid"), F.col("cid2"))).distinct()
    links = links.unionByName(_verified(open_pairs.join(spokes, ["a", "b"], "left_anti"), sets, percent))
    if not split:
        return links
    crowd = cut(open_members.join(dense, "bucket", "left_semi").select("cid").distinct())
    if not crowd.limit(1).count():
        return links
    dealt = stored(sets.join(crowd, "cid", "left_semi").select("cid", "n", "shingles").mapInPandas(_segments(percent), "bucket long, cid long, n long, at long").dropDuplicates(["bucket", "cid"]), "segments")
    return links.unionByName(class_links(shared_buckets(dealt), sets, percent, split=False))


def read_sets(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Stored rows of ``_READ``: the documents, and the list postings of their sets (bucket is not null)."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = own.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    ranges = max(1, -(-size // (SHINGLE_BYTES * RANGE_SHINGLES)))
    answers = own.mapInArrow(_sent(words, ranges), _SENT).groupBy("range").applyInPandas(_answered, _ANSWERS)
    return stored(answers.groupBy("chunk").applyInPandas(_read(percent), _READ), "sets")


def candidate_buckets(read: DataFrame, percent: int) -> DataFrame:
    """Stored (bucket, cid, n, at, members): lists of heavy sets and subset keys of light ones."""
    listed = stored(read.filter("bucket is not null").select("bucket", "cid", "n", "at").dropDuplicates(["bucket", "cid"]), "postings")
    lists = shared_buckets(listed)
    small = cut(read.filter("small is not null").select("cid", "n", "small").dropDuplicates(["cid"]))
    sizes = {r["n"]: r["sets"] for r in small.groupBy("n").agg(F.count("*").alias("sets")).collect()}  # at most MOST_LIGHT rows
    costs = dict.fromkeys(sizes, 0.0)
    for part, cost in ((listed, F.count("*")), (lists, F.sum("members") / 2)):
        for r in part.filter(F.col("n") <= MOST_LIGHT).groupBy("n").agg(cost.alias("cost")).collect():  # at most MOST_LIGHT rows
            costs[r["n"]] += float(r["cost"])
    boundary = choose_boundary(sizes, costs, percent)
    if not boundary:
        return lists
    keys = stored(small.filter(F.col("n") <= boundary).mapInPandas(_light(boundary, percent), "bucket long, cid long, n long, at long"), "keys")
    return lists.filter(100 * F.col("n") >= percent * (boundary + 1)).unionByName(shared_buckets(keys))


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text).

    Documents link when ``100 * common >= percent * union`` of their distinct ``words``-word
    shingles (A-Z lower-cased, whole texts). A text of fewer words is one shingle; a null
    text, or one without words, has none, links with nothing and is its own component.
    component_id is the smallest doc_id of the component; ids that are null are never the
    smallest, and a component of null ids alone has a null id. Repeated rows are copies.
    """
    spark = docs.sparkSession
    small_batches(spark)
    read = read_sets(docs, words, percent)
    postings = stored(candidate_buckets(read, percent), "buckets")
    classes = cut(postings.select("cid").distinct())
    marks = F.pandas_udf(lambda c: pd.Series(mix(c.to_numpy().view(np.uint64)).view(np.int64)), "long")
    bits = spark.sparkContext.broadcast(bit_table(classes.select(marks("cid").alias("mark")), "mark", max(1, classes.count())))
    found = docs.select("text").mapInArrow(_wanted_sets(bits, words), "key binary, cid long, n long, shingles array<long>")
    sets = stored(found.join(classes, "cid", "left_semi").dropDuplicates(["key"]), "suspects")
    roots = components(class_links(postings, sets, percent))

    base = read.filter("bucket is null").select("doc_id", "n", "key")
    rows = base.filter("key is not null")
    copies = rows.groupBy("key").agg(F.min("doc_id").alias("own"), F.count("*").alias("rows_of_key"))
    linked = sets.select("key", "cid").join(roots, F.col("cid") == F.col("node")).select("key", "root")
    named = cut(copies.join(linked, "key", "left"))
    inside = named.filter("root is not null")
    least = cut(inside.groupBy("root").agg(F.min("own").alias("component_id"), F.count("*").alias("rows_of_key")))
    members = join_by_key(inside.withColumnRenamed("rows_of_key", "copies"), least, "root", named.count()).withColumnRenamed("copies", "rows_of_key")
    alone = named.filter("root is null").withColumn("component_id", F.col("own"))
    columns = ["key", "component_id", "rows_of_key"]
    placed = cut(members.select(columns).unionByName(alone.select(columns)))
    empty = base.filter("key is null").withColumn("component_id", F.col("doc_id"))
    together = join_by_key(rows, placed, "key", rows.count()).unionByName(empty)
    return together.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document, the smallest doc_id, of each group of near copies.

    Near copies share five-word shingles with a similarity of 0.8 or more. Rows that repeat
    a doc_id are one document and stay together; rows with a null id stay.
    """
    near = jaccard_components(docs.select("doc_id", "text"), words=5, percent=80)
    gone = near.filter("doc_id <> component_id").select(F.col("doc_id").alias("__doc")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("__doc"), "left_anti")


SQL = """
with recursive ws as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
sh as (
  select doc_id, unnest(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) end) as s from ws),
n as (select doc_id, count(*) as n from sh group by doc_id),
common as (select a.doc_id as x, b.doc_id as y, count(*) as c from sh a join sh b on a.s = b.s and a.doc_id < b.doc_id group by all),
link as (select x, y from common join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 90 * (a.n + b.n - c)),
twice as (select x, y from link union all select y, x from link),
reach(doc_id, other) as (select x, y from twice union select r.doc_id, b.y from reach r join twice b on r.other = b.x),
low as (select doc_id, min(other) as m from reach group by doc_id)
select d.doc_id, coalesce(n.n, 0) as n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) as component_id
from documents d left join n using (doc_id) left join low using (doc_id)"""
