"""Operators 2 and 3 against brute force."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemetric.llm import bits
from tidemetric.llm import ngram_join as J
from tidemetric.llm import topk as K
from tidemetric.llm.words import shingle_sets, text_buffers, words_of

import pyarrow as pa

VECTORS = "vec_id long, embedding array<float>, label int"


def brute_top(rows, k):
    q = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            q[i] = [int(np.floor(64 * float(np.float32(x)))) for x in v]
    out = {}
    for i in q:
        if i % 20 == 0:
            scored = sorted(((-sum(a * b for a, b in zip(q[i], q[j], strict=True)), j) for j in q if j != i))[:k]
            out |= {(i, n + 1): (j, -s) for n, (s, j) in enumerate(scored)}
    return out


def test_top_k_equals_brute_force_with_ties_copies_and_bad_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 6) / 8]) for i in range(150)]
    rows += [(i, [0.5] * 6) for i in range(150, 230)]
    rows += [(400, None), (401, [0.1, None, 0.1, 0.1, 0.1, 0.1]), (402, [float("nan")] * 6), (403, [float("inf")] + [0.0] * 5), (None, [0.5] * 6), (420, [0.0] * 6)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS)
    q = K.quantised(df.union(df.filter("vec_id = 40")))
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in K.exact_top_k(q, q.filter("vec_id % 20 = 0"), 20).collect()}
    assert got == brute_top(rows, 20)


def test_few_rows_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0], 0), (1, [1.0, 1.0], 0)], VECTORS)
    q = K.quantised(df)
    assert [tuple(r) for r in K.exact_top_k(q, q.filter("vec_id = 0")).collect()] == [(0, 1, 1, 64 * 64 + 128 * 64)]
    none = q.filter("false")
    assert K.exact_top_k(none, none).count() == 0


def test_wide_unequal_and_clashing_vectors_in_several_blocks(spark, monkeypatch):
    """Blocks of 17 queries never hold more, however wide; short vectors count as filled up with zeros."""
    rng = np.random.default_rng(11)
    width = 4096
    rows = [(i, [int(x) for x in rng.integers(-30, 30, width if i % 3 else width // 2)], "x") for i in range(120)]
    vectors = spark.createDataFrame(rows, "vec_id long, q array<long>, score string")
    asked = vectors.filter("vec_id % 3 = 0")
    monkeypatch.setattr(K, "BLOCK_BYTES", 17 * 8 * width)
    sizes = [r["count"] for r in K.query_blocks(asked.selectExpr("vec_id as cid"), 17).groupBy("block").count().collect()]
    assert sum(sizes) == 40 and max(sizes) <= 17 and len(sizes) == 3
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in K.exact_top_k(vectors.select("vec_id", "q"), asked.select("vec_id", "q"), 5).collect()}
    full = np.zeros((120, width), np.int64)
    for i, q, _ in rows:
        full[i, : len(q)] = q
    scores = full @ full.T
    for i in range(0, 120, 3):
        want = sorted(((-scores[i, j], j) for j in range(120) if j != i))[:5]
        assert [got[i, n + 1] for n in range(5)] == [(j, -s) for s, j in want]


def test_jobs_do_not_grow_with_blocks(spark, monkeypatch):
    """All blocks meet all slices in one plan: 20 blocks by 6 slices run as many jobs as one pair, with the same answers."""
    rng = np.random.default_rng(3)
    rows = [(i, [int(x) for x in rng.integers(-30, 30, 8)]) for i in range(120)]
    vectors = spark.createDataFrame(rows, "vec_id long, q array<long>")
    answers, jobs = [], []
    monkeypatch.setattr(K, "SLICE_ROWS", 20)
    for n in (120, 6):
        monkeypatch.setattr(K, "BLOCK_ROWS", n)
        spark.sparkContext.setJobGroup(f"top-k blocks of {n}", "")
        answers.append({tuple(r) for r in K.exact_top_k(vectors, vectors, 5).collect()})
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"top-k blocks of {n}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert answers[0] == answers[1] and len(answers[0]) == 600
    assert jobs[0] == jobs[1]


def test_ids_that_repeat_with_other_vectors_are_no_candidates_of_their_own(spark):
    """Every row of the query's id stays out, its slots go to others, and a copy under another id stays in."""
    rows = [(0, [9, i]) for i in range(12)] + [(i, [1, i]) for i in range(1, 8)] + [(50, [9, 3])]
    vectors = spark.createDataFrame(rows, "vec_id long, q array<long>")
    got = [tuple(r)[1:] for r in K.exact_top_k(vectors, vectors.filter("vec_id = 0 and q[1] = 3"), 4).orderBy("rank").collect()]
    want = sorted((-(9 * q[0] + 3 * q[1]), i) for i, q in rows if i != 0)[:4]
    assert got == [(n + 1, i, -s) for n, (s, i) in enumerate(want)]


def test_large_components_stay_exact():
    a = np.array([[2**30, 2**30 + 1]], np.int64)
    assert K.scores(a, a)[0, 0] == 2**60 + (2**30 + 1) ** 2


def test_settled_sums_equal_plain_ones(monkeypatch):
    """Phase 3 adds what lists have sent and computes the rest, at sizes within and beyond 64 bits, in slabs of any height."""
    held = lambda v: type("Held", (), {"value": v})()
    rng = np.random.default_rng(8)
    for size in (9, 2**30, 2**40):
        query, vector = rng.integers(-size, size, (5, 4)), rng.integers(-size, size, (30, 4))
        whole = np.clip(query.astype(object) @ vector.astype(object).T, -(2**63), 2**63 - 1)
        sent = []
        for v in vector:
            part = [{"list": j, "q": np.flatnonzero(rng.random(5) < 0.5).astype(np.int32)} for j in (0, 1)]
            sent.append([e | {"s": np.array([int(np.clip(sum(int(a) * int(b) for a, b in zip(query[q, 2 * e["list"] :][:2], v[2 * e["list"] :][:2], strict=True)), -(2**62), 2**62)) for q in e["q"]], np.int64)} for e in part if len(e["q"])])
        batch = pd.DataFrame({"cid": range(30), "sent": sent, "v0": list(vector[:, :2]), "v1": list(vector[:, 2:])})
        cutoff = np.array([float(np.median(w)) for w in whole])
        for cells in (1, 1 << 20):
            monkeypatch.setattr(K, "_CELLS", cells)
            out = pd.concat(K._settled(held([query[:, :2], query[:, 2:]]), held(cutoff), [2, 2])(iter([batch])))
            got = {(q, c): s for q, c, s in out.itertuples(index=False)}
            if size < 2**40:
                assert got == {(q, c): whole[q, c] for c in range(30) for q in {int(q) for e in sent[c] for q in e["q"]} if whole[q, c] >= cutoff[q]}
            else:
                assert all(-(2**63) <= s < 2**63 for s in got.values())


def shingles(text, n):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ")
    w = [x for x in w if x]
    return {tuple(w)} - {()} if len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute_components(docs, n, percent):
    sets = [(i, shingles(t, n)) for i, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(docs)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(x)] = find(y)
    least = {}
    for x, (i, s) in enumerate(sets):
        if i is not None and s:
            least[find(x)] = min(least.get(find(x), i), i)
    return sorted(((i, len(s), i if not s else least.get(find(x))) for x, (i, s) in enumerate(sets)), key=str)


@pytest.mark.parametrize(("words", "percent", "seed"), [(3, 90, 1), (3, 90, 2), (5, 80, 3), (1, 90, 4), (2, 60, 5)])
def test_components_equal_brute_force(spark, words, percent, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    docs = []
    for size in [*range(1, 30), 40, 60, 90, 150]:
        base = [rng.choice(vocabulary) for _ in range(size)]
        for _ in range(6):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                at = rng.randrange(len(copy))
                rng.choice([lambda c, i: c.__setitem__(i, rng.choice(vocabulary)), lambda c, i: c.insert(i, "new"), lambda c, i: c.pop(i) if len(c) > 1 else None])(copy, at)
            docs.append(" ".join(x.upper() if rng.random() < 0.1 else x for x in copy))
    passage = " ".join(rng.choice(vocabulary) for _ in range(40))
    docs += [f"{' '.join(rng.choice(vocabulary) for _ in range(60))} {passage}" for _ in range(40)]
    docs += [None, "", " \t\n", "one", "One ", "é É", docs[5], docs[5]]
    rows = [(i * 3 % 1009, t) for i, t in enumerate(docs)]
    rows.append((None, docs[3]))
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component_id string")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in J.jaccard_components(df, words, percent).collect()), key=str)
    assert got == brute_components(rows, words, percent)


def test_large_near_copy_group_is_one_component(spark):
    rng = random.Random(9)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(400):
        copy = list(base)
        for _ in range(i % 6):
            copy[rng.randrange(150)] = f"e{rng.random()}"
        rows.append((i, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in J.jaccard_components(df).collect()), key=str)
    assert got == brute_components(rows, 3, 90)


def test_empty_table(spark):
    assert J.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_boundary_follows_cost():
    assert J.choose_boundary({}, {}) == 0
    sizes = dict.fromkeys(range(1, 25), 1000)
    assert J.choose_boundary(sizes, dict.fromkeys(sizes, 2_000.0)) < 12  # short lists
    assert J.choose_boundary(sizes, dict.fromkeys(sizes, 1e5)) > 12  # long ones
    assert J.choose_boundary({24: 10**6}, {24: 2e6}) < 24  # their subsets would cost more than their lists
    assert J.key_count(9, 24, 90) == 1 and J.key_count(19, 24, 90) == 20


def test_both_halves_work_at_the_setting_of_the_query(spark, monkeypatch):
    """Small sets of common shingles enumerate subsets, large ones scan lists, and both meet at the boundary."""
    rng = random.Random(4)
    phrases = [" ".join(f"p{k}{j}" for j in range(3)) for k in range(5)]
    texts = [" ".join(rng.choice(phrases) for _ in range(rng.choice([4, 4, 5]))) for _ in range(500)]
    texts += [f"{t} {rng.choice('xyz')}" for t in texts[:200]]
    for k in range(30):
        base = [f"w{k}{rng.randrange(400)}" for _ in range(80)]
        texts += [" ".join(base), " ".join([*base[:40], "changed", *base[41:]]), " ".join(base + ["more"])]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    boundaries = []
    light = J._light
    monkeypatch.setattr(J, "_light", lambda boundary, percent: boundaries.append(boundary) or light(boundary, percent))
    buckets = J.candidate_buckets(J.read_sets(df, 3, 90), 90).groupBy((F.col("n") <= 24).alias("small")).count().collect()
    members = {r["small"]: r["count"] for r in buckets}
    print("boundary", boundaries, "members of shared buckets: light, heavy", members)
    assert boundaries[0] >= 11 and J.key_count(11, boundaries[0], 90) > 11
    assert members[True] > 100 and members[False] > 100
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in J.jaccard_components(df).collect()), key=str)
    assert got == brute_components(rows, 3, 90)


@pytest.mark.parametrize("n", [4000, 8000])
def test_a_shingle_of_all_documents_is_no_large_range(spark, n):
    """Its range gets an entry a chunk, not one a document."""
    rows = [(i, "common words here " + " ".join(f"w{i}x{j}" for j in range(30))) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(4)
    sent = df.mapInArrow(J._sent(3, 64), J._SENT).filter("range >= 0")
    entries = (F.octet_length("tokens") + F.octet_length("many")) / 6
    sizes = sorted(r["n"] for r in sent.groupBy("range").agg(F.sum(entries).alias("n")).collect())
    assert len(sizes) == 64 and sizes[-1] < 2 * sizes[32]
    shared = J.read_sets(df, 3, 90).filter("bucket is not null")
    assert shared.count() == 0  # the common shingle comes last in every set


def test_counts_of_common_shingles_are_those_of_all_documents(spark, monkeypatch):
    """Lists are the same whether a shingle travels once a chunk or with each document."""
    rows = pages_of_lines(60, 7)
    lists = []
    for many in (0, 4, 10**6):
        monkeypatch.setattr(J, "MANY", many)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3, "doc_id")
        read = J.read_sets(df, 3, 90).select("bucket", "cid", "n", "at", "doc_id")
        lists.append(sorted((tuple(r) for r in read.collect()), key=str))
    assert lists[0] == lists[1] == lists[2] and any(r[0] is not None for r in lists[0])


def pages_of_lines(n, seed):
    rng = random.Random(seed)
    lines = [" ".join(f"l{k}w{j}" for j in range(10)) for k in range(40)]
    return [(i, " ".join(rng.sample(lines, 10))) for i in range(n)]


def test_pairs_of_a_template_corpus_grow_with_its_rows(spark, monkeypatch):
    monkeypatch.setattr(J, "DENSE", 0)
    tried = []
    verified = J._verified
    monkeypatch.setattr(J, "_verified", lambda pairs, *rest: tried.append(pairs.count()) or verified(pairs, *rest))
    counts = []
    for n in (800, 1600):
        tried.clear()
        rows = pages_of_lines(n, 1)
        got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
        counts.append(sum(tried))
        assert n > 1000 or got == brute_components(rows, 3, 90)
    print("pairs verified", counts)
    assert counts[1] < 3 * counts[0]  # all pairs of lists would be four times as many


@pytest.mark.parametrize("percent", [80, 90])
def test_dense_buckets_are_split_without_loss(spark, monkeypatch, percent):
    monkeypatch.setattr(J, "DENSE", 3)
    monkeypatch.setattr(bits, "MOST_BITS", 1 << 16)
    rng = random.Random(5)
    rows = pages_of_lines(120, 2)
    for i, text in list(rows):
        copy = text.split()
        for _ in range(rng.randrange(1, 5)):
            copy[rng.randrange(len(copy))] = f"new{rng.randrange(3)}"
        rows.append((1000 + i, " ".join(copy)))
        rows.append((2000 + i, " ".join(copy[: rng.randrange(80, 100)])))
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, percent).collect()), key=str)
    assert got == brute_components(rows, 3, percent)


def test_linked_sets_share_a_segment():
    rng = np.random.default_rng(3)
    for percent in (80, 90):
        for _ in range(400):
            n = int(rng.integers(1, 200))
            a = rng.integers(-(2**62), 2**62, n)
            b = np.concatenate([a[int(rng.integers(0, n // 8 + 1)) :], rng.integers(-(2**62), 2**62, int(rng.integers(0, n // 8 + 2)))])
            common = len(np.intersect1d(a, b))
            if 100 * common >= percent * (len(a) + len(b) - common):
                assert np.intersect1d(J.segment_keys(np.unique(a), percent), J.segment_keys(np.unique(b), percent)).size


def test_long_text_and_hot_copies(spark):
    long_text = " ".join(f"w{i % 70_000}x{i % 11}" for i in range(300_000))
    rows = [(i, "the same short text in very many rows") for i in range(500)] + [(900, long_text), (901, long_text + " end"), (902, None)] + [(None, "the same short text in very many rows")] * 50
    got = sorted(((r["doc_id"], r["component_id"]) for r in J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(i, 0) for i in range(500)] + [(900, 900), (901, 900), (902, 902)] + [(None, 0)] * 50, key=str)


def test_words_do_not_depend_on_slabs(monkeypatch):
    from tidemetric.llm import words as W

    texts = ["a bb  ccc\n" * 50, "", "x" * 500, " y\t" * 30, "ä ö Ü"]
    whole = []
    for slab in (1 << 19, 64, 7):
        monkeypatch.setattr(W, "SLAB", slab)
        out = []
        for _, data, offsets in text_buffers(pa.array(texts)):
            row, start, end, hashes = words_of(data, offsets)
            out.append((row.tolist(), start.tolist(), end.tolist(), hashes.tolist()))
            sets = shingle_sets(row, hashes, 3, len(offsets) - 1)
        whole.append(out)
        assert [len(s) for s in sets] == [len(shingles(t, 3)) for t in texts]
    assert whole[0] == whole[1] == whole[2]
