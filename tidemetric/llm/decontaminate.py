"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment of words.

1. Word trigrams of the test items are its seeds while they are rare: in few items, and in
   few documents or mostly there as part of the item's own text, so that an item that many
   documents hold, whole or edited, keeps them. A trigram that is common beyond that ("which
   of the") is extended by neighbouring words of its item to 5, 9 or 17 words, until it is
   rare; the longest always counts, so a whole copy is found whatever its words are. Items
   and documents are counted in full, in a pass of its own. Seeds go into a bounded bit
   table, and the lengths of their items into a table of reaches.
2. Documents are read again; around n-grams that the table lets through they send windows
   of word hashes, as wide as an alignment with that seed's items can be: a long item
   widens no other item's windows. Windows meet items by seed.
3. Pairs are aligned where enough words of the item are in the window at all; a pair
   counts from ``LEAST`` similarity on.

An alignment of that similarity without one intact seed is not found; tests measure recall
by rate of edits against the alignment of all pairs. Texts are never shuffled. Pairs grow
with the windows times ``MOST_ITEMS``, but where more items share 17 words and so do the
documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemetric.llm.bits import bit_table, has_bit
from tidemetric.llm.common import cut, join_by_key, small_batches, stored, table
from tidemetric.llm.words import fold_latin, mix, ngrams, text_buffers, words_of

N = 3
#: Lengths of seeds in words; a common one is replaced by the next.
LADDER = (N, 5, 9, 17)
#: A seed is rare in so many different items at most, and in so many documents or this share of them ...
MOST_ITEMS, RARE_DOCS, RARE_SHARE = 4, 20, 1 / 5000
#: ... or where this part of its occurrences is one of the longer seed, which is the item's own text.
OWN_PART = 0.25
LEAST = 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
#: Slots of the table of reaches, at most.
MOST_SLOTS = 1 << 22
#: Probes of that table: other bits than those of the bit table, so that it tells most of its false hits.
REACH_PROBES = (9, 28, 42)
#: Cells that a step of the alignment holds at most, and pairs.
_CELLS, _BATCH = 1 << 20, 64


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, data, offsets in text_buffers(batch.column("text"), 1 << 19):
            row, _, _, hashes = words_of(fold_latin(data), offsets)
            ends = np.cumsum(np.bincount(row, minlength=len(offsets) - 1))
            words = np.split(hashes.view(np.int64), ends[:-1])
            grams = [ngrams(np.zeros(len(w), int), w.view(np.uint64), N)[1].view(np.int64) for w in words]
            yield pa.RecordBatch.from_arrays(
                [batch.column("item_id").slice(first, len(words)), pa.array([w.tolist() for w in words], pa.list_(pa.int64())), pa.array([np.unique(g).tolist() for g in grams], pa.list_(pa.int64()))],
                ["item_id", "words", "grams"],
            )


def _ladder(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(item, body, reach, place, level, gram): at each trigram of an item the seeds that it may become, as long as the item allows."""
    for batch in batches:
        for item, body, reach, words in zip(batch["item"], batch["body"], batch["reach"], batch["words"], strict=True):
            hashes = np.asarray(words, np.int64).view(np.uint64)
            place, out = np.arange(len(hashes) - N + 1), []
            for level, n in enumerate(n for n in LADDER if n <= len(hashes)):
                grams = ngrams(np.zeros(len(hashes), int), hashes, n)[1].view(np.int64)
                out.append(pd.DataFrame({"item": item, "body": body, "reach": reach, "place": place, "level": level, "gram": grams[np.clip(place - (n - N) // 2, 0, len(hashes) - n)]}))
            yield pd.concat(out)


def _occurrences(bits):
    """(gram, n) of the n-grams of all lengths that the table lets through, counted by slab."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in text_buffers(batch.column("text"), 1 << 20):
                row, _, _, hashes = words_of(fold_latin(data), offsets)
                found = [ngrams(row, hashes, n)[1] for n in LADDER]
                gram, n = np.unique(np.concatenate([g[has_bit(bits.value, g)] for g in found]), return_counts=True)
                if len(gram):
                    yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(n)], ["gram", "n"])

    return run


def rare_seeds(docs: DataFrame, known: DataFrame, least: float) -> DataFrame:
    """(item, reach, gram): the seeds of each item, by ``LADDER``."""
    spark = docs.sparkSession
    bodies = known.select("item", F.xxhash64("words").alias("body"), reach_of(F.size("words"), least).cast("long").alias("reach"), "words")
    ladder = stored(bodies.mapInPandas(_ladder, "item long, body long, reach long, place int, level int, gram long"), "ladder")
    bits = spark.sparkContext.broadcast(bit_table(ladder, "gram", ladder.count()))
    occurrences = docs.select("text").mapInArrow(_occurrences(bits), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("seen"))
    stats = cut(ladder.groupBy("gram").agg(F.count_distinct("body").alias("items")).join(occurrences, "gram", "left").fillna(0, ["seen"]))
    steps = ladder.join(stats, "gram").groupBy("item", "reach", "place").agg(F.sort_array(F.collect_list(F.struct("level", "gram", "items", "seen"))).alias("steps"))  # a seed of each length
    limit = max(RARE_DOCS, int(RARE_SHARE * docs.count()))

    def rare(x, i):
        longer = F.get("steps", i + 1)
        return longer.isNull() | ((x["items"] <= MOST_ITEMS) & ((x["seen"] <= limit) | (longer["seen"] >= OWN_PART * x["seen"])))

    return steps.select("item", "reach", F.get(F.filter("steps", rare), F.lit(0))["gram"].alias("gram")).distinct()


def reach_of(words, least: float):
    """How far a word of an alignment can be from a seed: an item's words and the insertions that ``least`` leaves room for."""
    return words + F.floor(2 * (1 - least) * words)


def reach_table(seeds: DataFrame, count: int) -> np.ndarray:
    """Per slot the largest reach of the seeds with a probe there; the least of a seed's slots is its reach, or more."""
    slots = 1 << 16
    while slots < min(32 * count, MOST_SLOTS):
        slots *= 2
    slot = F.explode(F.array(*[F.shiftrightunsigned("gram", p).bitwiseAND(F.lit(slots - 1)) for p in REACH_PROBES])).alias("slot")
    merged = seeds.select("reach", slot).groupBy("slot").agg(F.max("reach").cast("long").alias("reach")).toArrow()  # a row a slot at most
    out = np.zeros(slots, np.int64)
    out[merged["slot"].to_numpy()] = merged["reach"].to_numpy()
    return out


def seed_reach(reaches: np.ndarray, grams: np.ndarray) -> np.ndarray:
    return np.min([reaches[(grams >> np.uint64(p)).astype(np.int64) & (len(reaches) - 1)] for p in REACH_PROBES], axis=0)


def _windows(bits, reaches, ladder: tuple[int, ...] = (N,)):
    """Runs of words around seeds of the given lengths: (wid, doc_id, body, start, words, grams)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, bodies = batch.column("doc_id"), batch.column("body").to_numpy(zero_copy_only=False)
            for first, data, offsets in text_buffers(batch.column("text"), 1 << 20):
                row, _, _, hashes = words_of(fold_latin(data), offsets)
                found = [(*ngrams(row, hashes, n), n) for n in ladder]
                at, grams, long = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]), np.repeat(ladder, [len(f[0]) for f in found])
                keep = np.flatnonzero(has_bit(bits.value, grams))
                if not len(keep):
                    continue
                reach = seed_reach(reaches.value, grams[keep])
                keep, reach = keep[reach > 0], reach[reach > 0]
                if not len(keep):
                    continue
                order = np.argsort(at[keep], kind="stable")
                keep, reach = keep[order], reach[order]
                at, grams, long = at[keep], grams[keep], long[keep]
                who, begin = row[at], np.searchsorted(row, np.arange(len(offsets)))
                low, high = np.maximum(at - reach, begin[who]), np.minimum(at + long + reach, begin[who + 1])
                cuts = np.flatnonzero(low[1:] > np.maximum.accumulate(high)[:-1]) + 1
                cuts = np.union1d(cuts, np.flatnonzero(who[1:] != who[:-1]) + 1)
                out = []
                for part in np.split(np.arange(len(at)), cuts):
                    r, left, right = int(who[part[0]]), int(low[part].min()), int(high[part].max())
                    doc, words = ids[first + r].as_py(), hashes[left:right]
                    own = np.array([doc or 0, doc is None, left - begin[r], len(words), bodies[first + r]], np.int64).view(np.uint64)
                    wid = mix(np.concatenate([own, words])).sum(keepdims=True) ^ mix(own[:1] * np.uint64(31) + own[2:3])
                    out.append((int(wid.view(np.int64)[0]), doc, int(bodies[first + r]), int(left - begin[r]), words.view(np.int64).tolist(), np.unique(grams[part].view(np.int64)).tolist()))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["wid", "doc_id", "body", "start", "words", "grams"])

    return run


def align(items: list[np.ndarray], windows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment of each item with its window: (score, end in the window).

    All pairs of the batch advance by one item word at a time. With a linear gap cost the
    row's horizontal gaps are a running maximum, so a step is a few array operations.
    """
    m, n = max(map(len, items)), max(map(len, windows))
    a, b = np.zeros((len(items), m), np.int64), np.zeros((len(items), n), np.int64)
    real_a, real_b = np.zeros(a.shape, bool), np.zeros(b.shape, bool)
    for i, (x, y) in enumerate(zip(items, windows, strict=True)):
        a[i, : len(x)], real_a[i, : len(x)] = x, True
        b[i, : len(y)], real_b[i, : len(y)] = y, True
    ramp = GAP * np.arange(n, dtype=np.int32)
    last = np.zeros((len(items), n + 1), np.int32)
    best, where = np.zeros(len(items), np.int32), np.zeros(len(items), np.int64)
    for i in range(m):
        hit = (b == a[:, i : i + 1]) & real_a[:, i : i + 1] & real_b
        row = np.maximum(last[:, :-1] + np.where(hit, MATCH, MISMATCH), last[:, 1:] + GAP)
        np.maximum(row, 0, out=row)
        row = np.maximum.accumulate(row - ramp, axis=1) + ramp
        row[~real_a[:, i]] = 0
        top = row.max(1)
        better = top > best
        best[better], where[better] = top[better], row.argmax(1)[better]
        last[:, 1:] = row
    return best, where


def _runs(lengths: np.ndarray) -> Iterator[slice]:
    """Runs of rising lengths whose padded cells stay within ``_CELLS``."""
    at = 0
    while at < len(lengths):
        stop = at + 1
        while stop < len(lengths) and stop - at < _BATCH and (stop + 1 - at) * lengths[stop] <= _CELLS:
            stop += 1
        yield slice(at, stop)
        at = stop


_PAIRS = "doc_id long, body long, item_id long, similarity double, last_word long"


def _aligned(least: float):
    """Alignments of pairs that can reach ``least``: no more words match than the window holds of the item's."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            can = [np.isin(item, words).sum() >= least * len(item) for item, words in zip(batch["item_words"], batch["words"], strict=True)]
            batch = batch[np.array(can, bool)]
            batch = batch.iloc[np.argsort(batch["words"].map(len).to_numpy(), kind="stable")]
            for some in _runs(batch["words"].map(len).to_numpy()):
                part = batch.iloc[some]
                items = [np.asarray(x) for x in part["item_words"]]
                score, where = align(items, [np.asarray(x) for x in part["words"]])
                similarity = score / (MATCH * np.array([len(x) for x in items]))
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "body": part["body"], "item_id": part["item_id"].astype("Int64"), "similarity": similarity, "last_word": part["start"].to_numpy() + where})[similarity >= least]

    return run


def alignments(docs: DataFrame, items: DataFrame, least: float = LEAST) -> DataFrame:
    """(doc_id, body, item_id, similarity, last_word) of every window that aligns with an item; body is ``xxhash64(text)``."""
    spark = docs.sparkSession
    small_batches(spark)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("body"), "text")
    read = items.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null").mapInArrow(_item_words, "item_id long, words array<long>, grams array<long>")
    known = cut(read.filter(F.size("grams") > 0).withColumn("item", F.monotonically_increasing_id()))
    total = known.agg(F.coalesce(F.sum(F.size("grams")), F.lit(0))).first()[0]
    if not total:
        return spark.createDataFrame([], _PAIRS)
    seeds = cut(rare_seeds(own, known, least))
    count = seeds.count()
    bits, reaches = spark.sparkContext.broadcast(bit_table(seeds, "gram", count)), spark.sparkContext.broadcast(reach_table(seeds, count))
    windows = stored(own.mapInArrow(_windows(bits, reaches, LADDER), "wid long, doc_id long, body long, start long, words array<long>, grams array<long>"), "windows")
    held = windows.select("wid", F.explode("grams").alias("gram"))
    keyed = cut(held.groupBy("gram").agg(F.count("*").alias("rows_of_key")).join(seeds.groupBy("gram").agg(F.collect_set("item").alias("items")), "gram"))
    total = keyed.agg(F.coalesce(F.sum("rows_of_key"), F.lit(0))).first()[0]
    met = join_by_key(held, keyed, "gram", total).select("wid", F.explode("items").alias("item")).distinct()
    pairs = met.join(known.select("item", "item_id", F.col("words").alias("item_words")), "item").join(windows.drop("grams"), "wid")
    return pairs.select("doc_id", "body", "item_id", "start", "words", "item_words").mapInPandas(_aligned(least), _PAIRS)


def find_leaks(docs: DataFrame, items: DataFrame, least: float = LEAST) -> DataFrame:
    """(doc_id, item_id, similarity, last_word): best alignment of each test item in each document.

    ``docs`` has doc_id and text, ``items`` has item_id and text. Similarity is the local
    alignment score over that of the item with itself; ``last_word`` is the position of the
    alignment's last word, the first of them where alignments tie. Null and empty texts
    match nothing, nor do items of fewer than three words. Rows that repeat an id are one
    document, or item, and so are those whose id is null. Whole texts are read, and items
    of any length.
    """
    good = alignments(docs, items, least)
    return good.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("last_word")).alias("minus"))).alias("best")).select("doc_id", "item_id", F.round("best.similarity", 6).alias("similarity"), (-F.col("best.minus")).alias("last_word"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without a passage of the benchmark.

    Each row is judged by its own text: of rows that repeat an id, or have none, those go
    whose text holds a passage.
    """
    leaks = alignments(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("__doc"), F.col("body").alias("__body")).distinct()
    return docs.join(leaks, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.xxhash64("text") == F.col("__body")), "left_anti")
