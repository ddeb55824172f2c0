"""Exact top-k inner-product search by the three-phase uniform threshold.

Vectors are cut into ``LISTS`` runs of dimensions, stored as columns apart: list j holds
every candidate's partial score for run j. Candidates are packed into slices, queries into
blocks, and every block is dealt to every slice, so one plan answers all queries however
many blocks there are:

1. each list gathers its k best partial scores per query, within slices and then over
   them; the objects found are scored exactly, and the k-th best of these is a safe
   cutoff: the true k-th score is no lower;
2. blocks travel again with their queries' cutoffs, and each list sends every entry whose
   partial score is at least cutoff / lists. Whoever reaches the cutoff in sum does so in
   one list at least, so the entries sent are sufficient;
3. the entries of a slice and a block meet both again: partial scores that no list has
   sent are computed, and the k best exact sums that reach the cutoff go on to be ranked
   over slices.

Equal vectors are one candidate and scored once; as ties go to the smaller id, k + 1 ids
of each are enough. A pair of slice and block holds ``SLICE_ROWS * BLOCK_ROWS`` scores at
most, and either side about ``BLOCK_BYTES`` of components; more rows make more pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemetric.llm.common import cut, stored, table
from tidemetric.llm.hard_negatives import _pairs as dealt

K = 20
LISTS = 2
BLOCK_BYTES = 4 << 20
BLOCK_ROWS, SLICE_ROWS = 256, 8192
_SALTS = 16
_RUN = 1 << 16  # pairs resolved at a time in phase 3
_LEAST = -(1 << 63)


def quantised(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, q): ``floor(scale * x)`` per component.

    Rows with a null vec_id, a null vector, or null or non-finite components take no part.
    """
    x = F.col("embedding")
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e.cast("double")) == float("inf")))
    return vectors.filter(F.col("vec_id").isNotNull() & x.isNotNull()).filter(~bad).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e.cast("double") * scale)).alias("q"))


def matrix(column: pd.Series, width: int) -> np.ndarray:
    """Rows of integers, short ones filled up with zeros."""
    out = np.zeros((len(column), width), np.int64)
    for i, row in enumerate(column):
        out[i, : len(row)] = row
    return out


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b.T`` exactly: in floats while every sum fits their mantissa, else in Python integers, held to 64 bits."""
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if bound < 2**24:
        return a.astype(np.float32) @ b.astype(np.float32).T
    if bound < 2**53:
        return a.astype(np.float64) @ b.astype(np.float64).T
    return np.clip(a.astype(object) @ b.astype(object).T, -(2**63), 2**63 - 1)


def vector_classes(rows: DataFrame, k: int) -> DataFrame:
    """Distinct vectors ``q`` with their k + 1 smallest ids; hot vectors are ranked within salts first."""
    salted = rows.groupBy("q", "vec_id").agg(F.pmod(F.xxhash64("vec_id"), F.lit(_SALTS)).alias("salt"))
    first = salted.withColumn("n", F.row_number().over(Window.partitionBy("q", "salt").orderBy("vec_id"))).filter(F.col("n") <= k + 1)
    both = first.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy("vec_id"))).filter(F.col("n") <= k + 1)
    return both.groupBy("q").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("cid", F.col("ids")[0])


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of ``a`` with the same rows of ``b``; in Python integers where 64 bits could overflow."""
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    return np.einsum("ij,ij->i", a, b) if bound < 2**62 else (a.astype(object) * b.astype(object)).sum(1)


def query_blocks(names: DataFrame, per_block: int) -> DataFrame:
    """``names`` with a block number; queries are counted off within partitions, so no block has more than ``per_block``."""
    parts = max(1, names.count() // (16 * per_block))
    at = F.monotonically_increasing_id()  # partition number in the upper 31 bits, row number in the lower 33
    low = F.lit((1 << 33) - 1)
    return cut(names.repartition(parts).withColumn("block", F.shiftright(at, 33) * F.lit(1 << 33) + F.floor(at.bitwiseAND(low) / per_block)))


def _packed(name: str, widths: list[int], kind: str):
    """Members of a slice or block as one matrix a list."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                own, at = {name: [row.block], f"{name}_ids": [row.ids], f"{name}_next": [row.next], f"{name}_keys": [row.keys]}, 0
                whole = matrix(pd.Series(list(row.q)), sum(widths)).astype(kind)
                for j, width in enumerate(widths):
                    own[f"{name}_v{j}"] = [whole[:, at : at + width].tobytes()]
                    at += width
                yield pd.DataFrame(own)

    return run


def packs(rows: DataFrame, name: str, most: int, widths: list[int], kind: str) -> DataFrame:
    """(id, next, key, q) as stored matrices of at most ``most`` rows and about ``BLOCK_BYTES``, each list a column."""
    per = max(1, min(most, BLOCK_BYTES // (8 * sum(widths))))
    members = F.collect_list(F.struct("id", "next", "key", "q"))  # ``per`` rows at most
    grouped = query_blocks(rows.select("id", "next", "key", "q"), per).groupBy("block").agg(members.alias("m")).select("block", F.col("m.id").alias("ids"), F.col("m.next").alias("next"), F.col("m.key").alias("keys"), F.col("m.q").alias("q"))
    shape = f"{name} long, {name}_ids array<long>, {name}_next array<long>, {name}_keys array<long>, " + ", ".join(f"{name}_v{j} binary" for j in range(len(widths)))
    return stored(grouped.mapInPandas(_packed(name, widths, kind), shape), name)


def _sides(row, j: int, width: int, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """List j of a pair's queries and of its candidates."""
    return tuple(np.frombuffer(getattr(row, f"{side}_v{j}"), kind).reshape(-1, width) for side in ("block", "slice"))


def _alone(row) -> np.ndarray:
    """Whether a candidate is nobody but the query itself."""
    ids, after, own = np.asarray(row.slice_ids), np.asarray(row.slice_next), np.asarray(row.block_ids)
    return (ids == own[:, None]) & (after == own[:, None])


def _best(j: int, width: int, kind: str, k: int):
    """Phase 1: a slice's k best of list j per query of a block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                s, keys, alone = scores(*_sides(row, j, width, kind)), np.asarray(row.slice_keys), _alone(row)
                held = np.where(alone, -np.inf, s)
                pick = np.argpartition(held, held.shape[1] - k, axis=1)[:, -k:] if held.shape[1] > k else np.broadcast_to(np.arange(held.shape[1]), held.shape)
                place = np.repeat(np.arange(len(s), dtype=np.int32), pick.shape[1])
                column = pick.ravel()
                keep = ~alone[place, column]
                place, column = place[keep], column[keep]
                yield pd.DataFrame({"block": row.block, "place": place, "list": np.int32(j), "key": keys[column], "s": s[place, column].astype(np.int64)})

    return run


def _resolved(width: int):
    """Exact scores of pairs that carry both vectors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            total = paired(matrix(batch["asked"], width), matrix(batch["q"], width))
            yield pd.DataFrame({"block": batch["block"], "place": batch["place"], "score": np.clip(total, _LEAST, -_LEAST - 1).astype(np.int64)})

    return run


def _reaching(j: int, width: int, kind: str, lists: int):
    """Phase 2: entries of list j with a partial score of at least cutoff / lists, packed a pair of slice and block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                least = _cutoffs(row)
                s = scores(*_sides(row, j, width, kind))
                at = np.flatnonzero((s >= (least // lists + (least % lists != 0))[:, None]) & ~_alone(row)).astype(np.int32)
                if len(at):
                    yield pd.DataFrame({"slice": [row.slice], "block": [row.block], "list": np.int32(j), "at": [at.tobytes()], "s": [s.ravel()[at].astype(np.int64).tobytes()]})

    return run


def _cutoffs(row) -> np.ndarray:
    """The cutoff of each query of a block; one with fewer than k candidates has none."""
    least = np.full(len(row.block_ids), _LEAST, np.int64)
    if row.places is not None:
        least[np.asarray(row.places, np.int64)] = row.cutoffs
    return least


def _settled(widths: list[int], kind: str, k: int):
    """Phase 3: a pair's k best exact scores per query that reach the cutoff; what no list has sent is computed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                least, ids, after, own = _cutoffs(row), np.asarray(row.slice_ids), np.asarray(row.slice_next), np.asarray(row.block_ids)
                sent = {e["list"]: (np.frombuffer(e["at"], np.int32), np.frombuffer(e["s"], np.int64)) for e in row.sent}
                pairs = reduce(np.union1d, [at for at, _ in sent.values()])
                place, column, score = [], [], []
                for start in range(0, len(pairs), _RUN):
                    some = pairs[start : start + _RUN]
                    q, c = some // len(ids), some % len(ids)
                    total = np.zeros(len(some), np.int64)
                    for j, width in enumerate(widths):
                        part, open_ = np.zeros(len(some), np.int64), np.ones(len(some), bool)
                        if j in sent:
                            at, s = sent[j]
                            where = np.minimum(np.searchsorted(at, some), len(at) - 1)
                            open_ = at[where] != some
                            part[~open_] = s[where[~open_]]
                        asked, rows = _sides(row, j, width, kind)
                        rest = paired(asked[q[open_]].astype(np.int64), rows[c[open_]].astype(np.int64))
                        if rest.dtype == object or max(np.abs(x.astype(float)).max(initial=0) for x in (total, part, rest)) >= 2**61:
                            total, part = total.astype(object), part.astype(object)
                        part[open_] = rest
                        total = total + part
                    keep = total >= least[q]
                    place.append(q[keep])
                    column.append(c[keep])
                    score.append(np.clip(total[keep], _LEAST, -_LEAST - 1).astype(np.int64))
                q, c, s = np.concatenate(place), np.concatenate(column), np.concatenate(score)
                first = np.where(ids[c] == own[q], after[c], ids[c])
                order = np.lexsort((first, ~s, q))
                q, c, s, first = q[order], c[order], s[order], first[order]
                keep = np.arange(len(q)) - np.searchsorted(q, q) < k
                yield pd.DataFrame({"block": row.block, "place": q[keep].astype(np.int32), "query_id": own[q[keep]], "key": np.asarray(row.slice_keys)[c[keep]], "first": first[keep], "score": s[keep]})

    return run


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = K, lists: int = LISTS) -> DataFrame:
    """The ``k`` highest scores of every query row against all rows but its own.

    ``vectors`` and ``queries`` hold (vec_id, q) with q an array of longs. Scores are inner
    products (missing components count as 0); ties go to the smaller vec_id. Rows that
    repeat a vec_id and its vector count once, and no row of a query's own id is its
    candidate; a query id with several vectors has an answer for each. No rows or no
    queries give no rows; components and scores beyond 64 bits saturate. Returns query_id,
    rank, vec_id, score.
    """
    spark = vectors.sparkSession
    classes = stored(vector_classes(vectors, k).withColumn("key", F.monotonically_increasing_id()), "vectors")
    asked = stored(queries.select("vec_id", "q").dropDuplicates(), "queries")
    most = F.max(F.greatest(*[F.abs(F.coalesce(edge("q"), F.lit(0)).cast("decimal(20,0)")) for edge in (F.array_max, F.array_min)]))
    dims, largest = classes.select("q").unionByName(asked.select("q")).agg(F.max(F.size("q")), most).first()
    if dims is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    step = max(1, -(-dims // lists))
    widths = [min(step, max(1, dims) - at) for at in range(0, max(1, dims), step)]
    kind = "int16" if largest < 1 << 15 else "int32" if largest < 1 << 31 else "int64"
    runs = list(enumerate(widths))
    second = F.coalesce(F.try_element_at("ids", F.lit(2)), F.col("cid"))
    slices = packs(classes.select(F.col("cid").alias("id"), second.alias("next"), "key", "q"), "slice", SLICE_ROWS, widths, kind)
    blocks = packs(asked.select(F.col("vec_id").alias("id"), F.col("vec_id").alias("next"), F.col("vec_id").alias("key"), "q"), "block", BLOCK_ROWS, widths, kind)
    rows_of = ["slice", "slice_ids", "slice_next", "slice_keys"]
    asks_of = ["block", "block_ids"]

    lists_best = [dealt(slices.select(*rows_of, f"slice_v{j}"), blocks.select(*asks_of, f"block_v{j}")).mapInPandas(_best(j, w, kind, k), "block long, place int, list int, key long, s long") for j, w in runs]
    nth = F.row_number().over(Window.partitionBy("block", "place", "list").orderBy(F.desc("s"), "key"))
    found = reduce(DataFrame.unionByName, lists_best).withColumn("n", nth).filter(F.col("n") <= k).select("block", "place", "key").distinct()
    places = blocks.mapInPandas(_places(widths, kind), "block long, place int, asked array<long>")
    exact = found.join(classes.select("key", "q"), "key").join(places, ["block", "place"]).select("block", "place", "asked", "q").mapInPandas(_resolved(sum(widths)), "block long, place int, score long")
    edge = exact.withColumn("n", F.row_number().over(Window.partitionBy("block", "place").orderBy(F.desc("score")))).filter(F.col("n") == k)
    cutoffs = edge.groupBy("block").agg(F.collect_list(F.struct("place", "score")).alias("c")).select("block", F.col("c.place").alias("places"), F.col("c.score").alias("cutoffs"))
    known = stored(blocks.join(cutoffs, "block", "left"), "cutoffs")

    asks_of += ["places", "cutoffs"]
    lists_sent = [dealt(slices.select(*rows_of, f"slice_v{j}"), known.select(*asks_of, f"block_v{j}")).mapInPandas(_reaching(j, w, kind, len(widths)), "slice long, block long, list int, at binary, s binary") for j, w in runs]
    gathered = reduce(DataFrame.unionByName, lists_sent).groupBy("slice", "block").agg(F.collect_list(F.struct("list", "at", "s")).alias("sent"))  # a row a list
    hits = gathered.join(known, "block").join(slices, "slice").mapInPandas(_settled(widths, kind, k), "block long, place int, query_id long, key long, first long, score long")
    per_query = Window.partitionBy("block", "place")
    top = hits.withColumn("n", F.row_number().over(per_query.orderBy(F.desc("score"), "first"))).filter(F.col("n") <= k)
    each = top.join(classes.select("key", "ids"), "key").select("block", "place", "query_id", "score", F.explode("ids").alias("vec_id")).filter("vec_id <> query_id")
    ranked = each.withColumn("rank", F.row_number().over(per_query.orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _places(widths: list[int], kind: str):
    """The queries of packed blocks, one row each, by their place."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                whole = np.hstack([np.frombuffer(getattr(row, f"block_v{j}"), kind).reshape(-1, w) for j, w in enumerate(widths)])
                yield pd.DataFrame({"block": row.block, "place": np.arange(len(whole), dtype=np.int32), "asked": list(whole.astype(np.int64))})

    return run


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quantised(table(spark, sf_dir, "embeddings"))
    return exact_top_k(rows, rows.filter("vec_id % 20 = 0"))


SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as q from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pairs as (
  select a.vec_id as query_id, b.vec_id, list_inner_product(a.q, b.q)::bigint as score
  from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0)
select query_id, row_number() over w::int as rank, vec_id, score from pairs
window w as (partition by query_id order by score desc, vec_id) qualify row_number() over w <= 20"""
