"""Hard-negative mining: exact scores by residue-number GEMM, then selection in score windows.

Vectors are packed into slices, anchors into blocks, and every block is dealt to every
slice, so one plan scores all anchors against all rows however many blocks there are. A
task multiplies the component matrices modulo several small primes in float32, where
every sum stays below 2^24, and reconstructs the signed scores by Chinese remaindering;
the primes' product exceeds twice the largest score that the data can give.

1. Each (slice, block) pair sends an anchor's best rows of its own label; Spark ranks
   them over all slices, and the first are the anchor's positives.
2. Blocks travel again with their anchors' positive scores. Each pair sends, per anchor
   and positive, the best rows of other labels whose score lies in the positive's window;
   Spark ranks these. A pair sends a bounded number of rows an anchor, whatever is tied.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemetric.llm.common import cut, stored, table

SCALE = 256
POSITIVES, NEGATIVES = 5, 5
#: A negative's score is between ``LOW`` and ``HIGH`` hundredths of the positive's.
LOW, HIGH = 80, 100
#: Rows of a slice and of a block of anchors, and about the bytes that either holds at most.
SLICE_ROWS, BLOCK_ROWS, PACK_BYTES = 8192, 256, 4 << 20
#: Dimensions that are multiplied at a time: as many products of residues fit a float32's mantissa.
RUN = 256
_MOST = 1 << 63


def primes_for(bound: int) -> list[int]:
    """The largest primes below 512, downwards, as many as tell all integers of magnitude up to ``bound`` apart."""
    out, product, n = [], 1, 511
    while product <= 2 * bound + 1:
        if all(n % k for k in range(2, int(n**0.5) + 1)):
            out.append(n)
            product *= n
        n -= 1
        if n < 2:
            raise ValueError("scores are too large")
    return out


def residues(q: np.ndarray, prime: int) -> np.ndarray:
    """``q`` modulo ``prime``, centred around 0, as float32."""
    r = np.mod(q, prime)
    return np.where(r > prime // 2, r - prime, r).astype(np.float32)


def residue_product(a: np.ndarray, b: np.ndarray, prime: int) -> np.ndarray:
    """``a @ b.T`` modulo ``prime``; every partial sum is an exact float32."""
    x, y = residues(a, prime), residues(b, prime)
    total = np.zeros((len(a), len(b)), np.int64)
    for at in range(0, a.shape[1], RUN):
        total += (x[:, at : at + RUN] @ y[:, at : at + RUN].T).astype(np.int64)
    return np.mod(total, prime)


def rns_scores(a: np.ndarray, b: np.ndarray, bound: int) -> np.ndarray:
    """Exact inner products of the rows of ``a`` and ``b``, none above ``bound`` in magnitude; beyond 64 bits they saturate."""
    value, product = np.zeros((len(a), len(b)), np.int64), 1
    for prime in primes_for(bound):
        if product * prime >= _MOST and value.dtype != object:
            value = value.astype(object)
        digit = np.mod((residue_product(a, b, prime) - np.mod(value, prime).astype(np.int64)) * pow(product, -1, prime), prime)
        value = value + digit * product if value.dtype != object else value + digit.astype(object) * product
        product *= prime
    value = np.where(value > product // 2, value - product, value)
    return value if value.dtype != object else np.clip(value, -_MOST, _MOST - 1).astype(np.int64)


def first_per_row(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's ``k`` highest allowed scores; columns are in order of id, and the first of a tie wins."""
    least = np.iinfo(np.int64).min
    held = np.where(allowed, scores, least)
    if held.shape[1] > k:
        edge = np.partition(held, held.shape[1] - k, axis=1)[:, -k]
        row, column = np.nonzero(allowed & (held >= edge[:, None]))
    else:
        row, column = np.nonzero(allowed)
    order = np.lexsort((column, ~held[row, column], row))
    row, column = row[order], column[order]
    starts = np.searchsorted(row, np.arange(len(scores)))
    keep = np.arange(len(row)) - starts[row] < k
    return row[keep], column[keep]


def in_window(scores: np.ndarray, positive: np.ndarray, low: int, high: int) -> np.ndarray:
    """Whether ``low * positive <= 100 * score <= high * positive``, exactly: limits are rounded inwards in Python integers."""
    lower = np.array([max(-_MOST, min(_MOST - 1, -(-low * int(p) // 100))) for p in positive], np.int64)
    upper = np.array([max(-_MOST, min(_MOST - 1, high * int(p) // 100)) for p in positive], np.int64)
    return (scores >= lower[:, None]) & (scores <= upper[:, None])


def _vector(blob: bytes, count: int, width: int, kind: str) -> np.ndarray:
    return np.frombuffer(blob, kind).reshape(count, width)


def _packed(name: str, rows: int, width: int, kind: str):
    """Rows (vec_id, label, q[, scores]) of a partition as packed matrices of ``rows`` rows at most, in order of vec_id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, held, count = TaskContext.get().partitionId() << 32, [], 0

        def flush() -> pd.DataFrame:
            nonlocal number
            part = pd.concat(held).sort_values(["vec_id", "label"], kind="stable")
            matrix = np.zeros((len(part), width), kind)
            for i, q in enumerate(part["q"]):
                matrix[i, : len(q)] = q
            own = {name: [number], f"{name}_ids": [part["vec_id"].to_numpy(np.int64).tobytes()], f"{name}_labels": [part["label"].to_numpy(np.int64).tobytes()], f"{name}_q": [matrix.tobytes()]}
            if "positives" in part:
                own["positives"] = [np.array([[y for p in row for y in (p["id"], p["score"])] + [0] * (2 * (POSITIVES - len(row))) for row in part["positives"]], np.int64).tobytes()]
                own["found"] = [np.array([len(row) for row in part["positives"]], np.int64).tobytes()]
            number += 1
            return pd.DataFrame(own)

        for batch in batches:
            while len(batch):
                some, batch = batch.iloc[: rows - count], batch.iloc[rows - count :]
                held.append(some)
                count += len(some)
                if count == rows:
                    yield flush()
                    held, count = [], 0
        if count:
            yield flush()

    return run


def _pairs(slices: DataFrame, blocks: DataFrame) -> DataFrame:
    """Every block of anchors beside every slice; the stated queries against all rows, in blocks.

    Small matrices are much work, so tasks are as many as slices, whatever their bytes.
    """
    numbers = [r["slice"] for r in slices.select("slice").collect()]  # a number a slice
    every = F.transform(F.split(F.lit(",".join(map(str, numbers))), ","), lambda n: n.cast("long"))
    dealt = blocks.withColumn("slice", F.explode(every))
    return slices.repartition(max(1, len(numbers)), "slice").join(dealt.repartition(max(1, len(numbers)), "slice"), "slice")


def _shape(row, width: int, kind: str):
    names, labels = np.frombuffer(row.slice_ids, np.int64), np.frombuffer(row.slice_labels, np.int64)
    anchors, wanted = np.frombuffer(row.block_ids, np.int64), np.frombuffer(row.block_labels, np.int64)
    return names, labels, anchors, wanted, _vector(row.slice_q, len(names), width, kind), _vector(row.block_q, len(anchors), width, kind)


def _positives(width: int, kind: str, bound: int, k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                names, labels, anchors, wanted, rows, asked = _shape(row, width, kind)
                scores = rns_scores(asked, rows, bound)
                at, column = first_per_row(scores, (labels == wanted[:, None]) & (names != anchors[:, None]), k)
                yield pd.DataFrame({"anchor_id": anchors[at], "anchor_label": wanted[at], "block": row.block, "place": at, "id": names[column], "score": scores[at, column]})

    return run


def _negatives(width: int, kind: str, bound: int, k: int, low: int, high: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                names, labels, anchors, wanted, rows, asked = _shape(row, width, kind)
                scores, found = rns_scores(asked, rows, bound), np.frombuffer(row.found, np.int64)
                other = (labels != wanted[:, None]) & (names != anchors[:, None])
                positives = np.frombuffer(row.positives, np.int64).reshape(len(anchors), POSITIVES, 2)
                for n in range(int(found.max(initial=0))):
                    has = np.flatnonzero(found > n)
                    score = positives[has, n, 1]
                    at, column = first_per_row(scores[has], other[has] & in_window(scores[has], score, low, high), k)
                    yield pd.DataFrame({"anchor_id": anchors[has][at], "anchor_label": wanted[has][at], "block": row.block, "place": has[at], "positive_id": positives[has, n, 0][at], "positive_score": score[at], "nth": n, "negative_id": names[column], "negative_score": scores[has][at, column]})

    return run


def _slices(rows: DataFrame, name: str, most: int, width: int, kind: str, more: str = "") -> DataFrame:
    """Packed matrices of about equal rows, stored; rows are dealt by id."""
    per = max(1, min(most, PACK_BYTES // (np.dtype(kind).itemsize * width)))
    schema = f"{name} long, {name}_ids binary, {name}_labels binary, {name}_q binary{more}"
    return stored(rows.repartition(max(1, -(-rows.count() // per)), "vec_id").mapInPandas(_packed(name, per, width, kind), schema), name)


def hard_negatives(vectors: DataFrame, anchors: DataFrame, low: int = LOW, high: int = HIGH, negatives: int = NEGATIVES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``vectors`` and ``anchors`` hold (vec_id long, label long, q array<long>). An anchor's
    positives are the ``POSITIVES`` rows of its label with the highest inner products; for
    each, up to ``negatives`` rows of other labels follow whose score is ``low`` to ``high``
    hundredths of the positive's, highest first. Ties go to the smaller vec_id. Rows that
    repeat an id, a label and a vector are one; no row of an anchor's own id is its positive
    or negative; rows that repeat an id with another label or vector are rows of their own.
    Missing components count as 0; no rows give no rows. Components and scores beyond 64
    bits saturate.
    """
    spark = vectors.sparkSession
    rows = stored(vectors.select("vec_id", F.col("label").cast("long").alias("label"), "q").dropDuplicates(), "vectors")
    asked = stored(anchors.select("vec_id", F.col("label").cast("long").alias("label"), "q").dropDuplicates(), "anchors")
    most = F.max(F.greatest(F.abs(F.coalesce(F.array_max("q"), F.lit(0)).cast("decimal(20,0)")), F.abs(F.coalesce(F.array_min("q"), F.lit(0)).cast("decimal(20,0)"))))
    dims, largest = rows.unionByName(asked).agg(F.max(F.size("q")), most).first()
    if dims is None or not asked.limit(1).count():
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    width, top = max(1, dims), int(largest)
    kind = "int16" if top < 1 << 15 else "int32" if top < 1 << 31 else "int64"
    bound = max(1, width * top * top)
    slices = _slices(rows, "slice", SLICE_ROWS, width, kind)
    blocks = _slices(asked, "block", BLOCK_ROWS, width, kind)
    sent = _pairs(slices, blocks).mapInPandas(_positives(width, kind, bound, POSITIVES), "anchor_id long, anchor_label long, block long, place int, id long, score long")
    first = F.row_number().over(Window.partitionBy("block", "place").orderBy(F.desc("score"), "id"))
    best = sent.withColumn("n", first).filter(F.col("n") <= POSITIVES)
    keyed = best.groupBy("block", "place").agg(F.sort_array(F.collect_list(F.struct("n", "id", "score"))).alias("positives"))  # POSITIVES rows at most
    places = blocks.mapInPandas(_places(width, kind), "block long, place int, vec_id long, label long, q array<long>")
    known = cut(places.join(keyed, ["block", "place"]).select("vec_id", "label", "q", "positives"))
    again = _slices(known, "block", BLOCK_ROWS, width, kind, ", positives binary, found binary")
    shape = "anchor_id long, anchor_label long, block long, place int, positive_id long, positive_score long, nth int, negative_id long, negative_score long"
    met = _pairs(slices, again).mapInPandas(_negatives(width, kind, bound, negatives, low, high), shape)
    order = F.row_number().over(Window.partitionBy("block", "place", "nth").orderBy(F.desc("negative_score"), "negative_id"))
    return met.withColumn("rank", order).filter(F.col("rank") <= negatives).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def _places(width: int, kind: str):
    """The anchors of packed blocks, one row each, by their place."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                ids = np.frombuffer(row.block_ids, np.int64)
                yield pd.DataFrame({"block": row.block, "place": np.arange(len(ids)), "vec_id": ids, "label": np.frombuffer(row.block_labels, np.int64), "q": list(_vector(row.block_q, len(ids), width, kind).astype(np.int64))})

    return run


def labelled(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, q) of the rows that take part: no null id, label, vector or component, and finite components.

    ``q`` is ``floor(scale * x)``; where vec_id is divisible by 7, label becomes (label + 1) % 10.
    """
    x = F.col("embedding")
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e.cast("double")) == float("inf")))
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull()).filter(~bad)
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), moved.cast("long").alias("label"), F.transform(x, lambda e: F.floor(e.cast("double") * scale)).alias("q"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(table(spark, sf_dir, "embeddings"))
    return hard_negatives(rows, rows.filter("vec_id % 100 = 0"))


SQL = """
with v as (
  select distinct vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as q from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pairs as (
  select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, list_inner_product(a.q, b.q)::bigint as score
  from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
pos as (select anchor_id, vec_id as positive_id, score as positive_score from pairs where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select p.anchor_id, positive_id, row_number() over w::int as rank, vec_id as negative_id, positive_score, score as negative_score
from pos p join pairs n on n.anchor_id = p.anchor_id and not n.same and 80 * positive_score <= 100 * score and 100 * score <= 100 * positive_score
window w as (partition by p.anchor_id, positive_id order by score desc, vec_id) qualify row_number() over w <= 5"""
