"""Operators 4 to 9 against brute force, held-out labels and the documents behind the pages."""

import hashlib
import html
import itertools
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemetric.llm import decontaminate as D
from tidemetric.llm import html_extract as H
from tidemetric.llm import langid as L
from tidemetric.llm import line_dedup as N
from tidemetric.llm import mixing as M
from tidemetric.llm import quality_crf as Q
from tidemetric.llm.common import is_held_out, new_folder, table

DOCS = "doc_id long, text string, lang string, source string, n_lines string, score string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, *[None] * (4 - len(r)), "x", "y") for r in rows], DOCS)


# --- 4: mixing


def mixed(spark, rows, **more):
    return M.mix_sources(frame(spark, rows), **more).collect()


def test_mix_meets_targets_and_caps(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randrange(0, 40), None, rng.choice(["a", "a", "a", "b", "B", None, "é"])) for i in range(600)]
    for ranges in (30, 100_000):
        got = mixed(spark, rows, rows_per_range=ranges)
        assert len(got) == 600
        names = sorted({r[3] for r in rows if r[3]}, key=lambda s: s.encode()) + [None]
        sizes = {s: sum(len(r[1].split()) for r in rows if r[3] == s) for s in names}
        weights = {s: i % 3 + 1 for i, s in enumerate(names)}
        total, open_to, target = sum(sizes.values()), set(names), {}
        while open_to:  # share, hold at the cap, share again
            level = (total - sum(target.values())) / sum(weights[s] for s in open_to)
            over = {s for s in open_to if 3 * sizes[s] < level * weights[s]}
            target |= {s: 3.0 * sizes[s] for s in over} if over else {s: level * weights[s] for s in open_to}
            open_to = open_to - over if over else set()
        taken = {s: sum(r["taken"] for r in got if r["source"] == s) for s in names}
        for s in names:
            assert abs(taken[s] - target[s]) <= 1
            assert all(r["target"] == pytest.approx(target[s], abs=1e-5) for r in got if r["source"] == s)
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixed(spark, rows)), key=str)


@pytest.mark.parametrize("kind", ["light", "null ids", "one id", "copies"])
def test_ranges_hold_about_equal_rows(spark, kind):
    n, symbols = F.col("id"), F.lit("!!! ")
    text = F.concat(F.lit("word "), F.when(n % 10 > 0, F.repeat(symbols, 3)).otherwise(F.lit("")), n.cast("string"))
    doc_id = {"light": n, "null ids": F.when(n % 3 > 0, n), "one id": F.when(n % 3 > 0, n).otherwise(7), "copies": F.lit(7).cast("long")}[kind]
    docs = spark.range(60_000).select(doc_id.alias("doc_id"), F.lit("same text") if kind == "copies" else text, F.when(n % 3 == 0, "hot").otherwise("cold").alias("source")).toDF("doc_id", "text", "source")
    weight = M.quality_weight(F.col("text"))
    assert kind == "copies" or docs.filter(weight == M.LEAST_WEIGHT).count() > 50_000
    sized = docs.select("doc_id", F.lit(False).alias("nul"), F.col("source").alias("src"), M.word_count(F.col("text")).alias("size"), M.exponential_key(F.col("doc_id"), weight).alias("key"), F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("row"))
    rows = M.key_ranges(sized, 1000).groupBy("range").count().collect()
    assert len(rows) > 50 and max(r["count"] for r in rows) <= 3000 and sum(r["count"] for r in rows) == 60_000
    taken = M.mix_sources(docs, rows_per_range=1000).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect()
    assert all(abs(r["taken"] - r["target"]) <= 1 for r in taken)


def test_weights_of_the_caller_decide(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"), F.when(F.col("id") < 1000, "a").otherwise("b").alias("source"))
    got = M.mix_sources(docs, quality=F.when(F.col("doc_id") % 2 == 0, 1.0).otherwise(0.01)).filter("source = 'a' and taken > 0").collect()
    assert sum(r["doc_id"] % 2 == 0 for r in got) > 0.7 * 500 and len(got) < 700


def test_mix_of_nothing(spark):
    assert mixed(spark, []) == []
    got = mixed(spark, [(1, None, None, "a"), (2, "", None, None), (None, None, None, None), (None, None, None, None)])
    assert [(r["size"], r["taken"], r["target"]) for r in got] == [(0, 0, 0.0)] * 4


def test_repeated_rows_count_each(spark):
    got = mixed(spark, [(7, "a b c", None, "s")] * 3)
    assert [r["taken"] for r in got] == [3, 3, 3]


# --- 5: quality


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    unary, pairs = rng.normal(size=7), rng.normal(size=(2, 2))
    starts, lengths = np.array([0, 4, 5]), np.array([4, 1, 2])
    good, expected = Q.forward_backward(unary, starts, lengths, pairs)
    want, counts = np.zeros(7), np.zeros((2, 2))
    for s, n in zip(starts, lengths, strict=True):
        weights, labels = [], list(itertools.product([0, 1], repeat=int(n)))
        for y in labels:
            weights.append(np.exp(sum(unary[s + t] * y[t] for t in range(n)) + sum(pairs[y[t], y[t + 1]] for t in range(n - 1))))
        for y, w in zip(labels, np.array(weights) / sum(weights), strict=True):
            want[s : s + n] += w * np.array(y)
            for t in range(n - 1):
                counts[y[t], y[t + 1]] += w
    assert good == pytest.approx(want) and expected == pytest.approx(counts)


def test_held_out_quality(spark, small):
    got = Q.op5_quality_classifier(spark, small).join(table(spark, small, "labels"), "doc_id").filter("held_out").collect()
    right = [r["predicted"] == r["quality"] for r in got]
    assert len(right) > 50 and np.mean(right) >= 0.95
    assert {r["doc_id"] for r in got} == {r["doc_id"] for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0}


def test_quality_edge_texts(spark):
    rows = [(i, f"A good line of words number {i}.\nAnother line follows it here.", None, None) for i in range(40)] + [(100 + i, "BUY!! NOW!! &&& *** $$$\nBUY!! NOW!!", None, None) for i in range(40)]
    docs = frame(spark, [*rows, (900, None), (901, ""), (None, "x"), (902, "\n\n"), (903, "word " * 50_000), (5, rows[5][1])])
    labels = spark.createDataFrame([(r[0], int(r[0] < 100)) for r in rows] + [(None, 1), (1, None)], "doc_id long, quality int")
    field = Q.train_field(docs, labels)
    got = Q.score_quality(docs, field).collect()
    assert len(got) == 86 and all(0 <= r["score"] <= 1 for r in got)
    assert all((r["score"] >= Q.THRESHOLD) == (r["doc_id"] < 100) for r in got if r["doc_id"] is not None and r["doc_id"] < 200)
    assert Q.score_quality(docs.filter("false"), field).count() == 0
    assert Q.train_field(docs, labels.filter("false")) is None
    assert {r["score"] for r in Q.score_quality(docs, None).collect()} == {1.0}


def plain_features(text):
    """The 16 own features of each line, word by word."""
    kind = lambda b: "u" if 65 <= b <= 90 else "l" if 97 <= b <= 122 else "d" if 48 <= b <= 57 else "s" if b in b".,;:?'\"()-" else " " if b < 0x21 else "h" if b >= 0x80 else "y"
    lines = text.encode().split(b"\n")
    words = [[w for w in re.split(rb"[\x20\x09-\x0D]+", line) if w] for line in lines]
    folded = [[w.lower() for w in ws] for ws in words]
    flat = [(i, w) for i, ws in enumerate(folded) for w in ws]
    seen, echo = set(), [0] * len(lines)
    for a, b, c in zip(flat, flat[1:], flat[2:], strict=False):
        echo[a[0]] += (a[1], b[1], c[1]) in seen
        seen.add((a[1], b[1], c[1]))
    out = []
    for i, line in enumerate(lines):
        n = {k: sum(kind(b) == k for b in line) for k in "ulds yh"}
        letters = n["u"] + n["l"] + n["h"]
        solid, each, ws = max(letters + n["d"] + n["s"] + n["y"], 1), max(len(words[i]), 1), words[i]
        out.append([
            np.log1p(len(line)), np.log1p(len(ws)), min(solid / each, 40) / 10, letters / solid, n["u"] / max(n["u"] + n["l"], 1), n["d"] / solid, n["s"] / solid, n["y"] / solid,
            sum(not any(kind(b) in "ulh" for b in w) for w in ws) / each, sum(kind(w[-1]) == "y" for w in ws) / each,
            sum(x == y for x, y in zip(folded[i], folded[i][1:], strict=False)) / each, (len(ws) - len(set(folded[i]))) / each,
            echo[i] / each, float(len(line) > 0 and kind(line[-1]) == "s"), float(i == 0), float(not line),
        ])
    return np.array(out), [len(x) + 1 for x in lines]


def test_scores_equal_the_plain_computation(spark, tiny, monkeypatch):
    """Features, forward-backward and document score against enumeration of all labellings."""
    docs = table(spark, tiny, "documents")
    field = Q.train_field(docs, table(spark, tiny, "labels"))
    texts = [r["text"] for r in docs.limit(30).collect() if r["text"]] + ["", "\n", "ÉCOLE école\n\nA a a. 1 2 !x! a a a\n  \ta", "No end\n"]
    texts = ["\n".join(t.split("\n")[:7]) for t in texts]
    monkeypatch.setattr(Q, "BLOCK", 7)
    got = Q.batch_scores(pa.array(texts), field)
    for text, score in zip(texts, got, strict=True):
        own, lengths = plain_features(text)
        none = np.zeros(Q.NEIGHBOUR)
        full = np.array([np.concatenate([own[i], own[i - 1][: Q.NEIGHBOUR] if i else none, own[i + 1][: Q.NEIGHBOUR] if i + 1 < len(own) else none, [1.0]]) for i in range(len(own))])
        u = np.clip(np.clip((full - field.mean) / field.scale, -5, 5) @ field.weights, -30, 30)
        p, total = np.zeros(len(u)), 0.0
        for y in itertools.product([0, 1], repeat=len(u)):
            w = np.exp(sum(u[t] * y[t] for t in range(len(u))) + sum(field.pairs[y[t], y[t + 1]] for t in range(len(u) - 1)))
            p, total = p + w * np.array(y), total + w
        assert score == pytest.approx(np.dot(p / total, lengths) / sum(lengths), abs=1e-9)


def test_sample_is_bounded_and_repeats(spark, monkeypatch):
    docs = frame(spark, [(i, f"line {i} of a text\n" * 20, None, None) for i in range(200)] + [(7, "z" * 50, None, None)] * 500)
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    sizes = []
    fit = Q.fit_field
    monkeypatch.setattr(Q, "fit_field", lambda x, *rest: sizes.append(len(x)) or fit(x, *rest))
    monkeypatch.setattr(Q, "TRAIN_ALL_LINES", 400)
    one, two = Q.train_field(docs, labels), Q.train_field(docs.orderBy(F.desc("doc_id")).repartition(7), labels)
    assert 350 < sizes[0] == sizes[1] <= 400 and np.array_equal(one.weights, two.weights)


def test_very_long_text_of_short_lines(spark):
    field = Q.ChainField(np.zeros(Q.WIDTH), np.ones(Q.WIDTH), np.full(Q.WIDTH, 0.1), np.eye(2))
    got = Q.score_quality(frame(spark, [(1, "a b.\n" * 400_000)]), field).collect()
    assert 0 <= got[0]["score"] <= 1


# --- 6: lines


def brute_lines(rows):
    def key(line):
        k = line.strip(" \t\n\x0b\x0c\r")
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in k)

    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                holders.setdefault(key(line), set()).add(N.NO_ID if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        own = N.NO_ID if i is None else i
        stay = [x for x in lines if len(holders.get(key(x), ())) < 2 or min(holders[key(x)]) == own]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=str)


def test_lines_equal_brute_force(spark):
    rng = random.Random(3)
    pool = [f"line number {i} of the pool" for i in range(30)] + ["Éclair au Chocolat", "éclair au chocolat", "short", "", "  \t", "x" * 10, "X" * 10 + "\r"]
    rows = [(i, "\n".join(rng.choice([str.upper, str.lower, lambda s: f" {s}\t"])(rng.choice(pool)) for _ in range(rng.randrange(1, 8)))) for i in range(80)]
    rows += [(200, None), (201, ""), (None, "line number 1 of the pool\nonly here, in a null id"), (3, rows[3][1]), (3, "line number 2 of the pool")]
    got = N.dedup_lines(frame(spark, rows))
    assert got.columns == ["doc_id", "text", "lang", "source", "n_lines", "score", "n_dropped"]
    assert sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in got.collect()), key=str) == brute_lines(rows)
    assert N.dedup_lines(frame(spark, [])).count() == 0


def test_lines_of_hot_ids_and_long_texts(spark):
    shared, long_text = "a line that everybody has", "\n".join(f"line {i % 50_000} of it" for i in range(200_000))
    rows = [(None, f"{shared}\nown text of row {i}") for i in range(300)] + [(5, f"{shared}\nrow {i}") for i in range(300)] + [(2, long_text), (9, f"{shared}\n{long_text}")]
    got = [(r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in N.dedup_lines(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == brute_lines(rows)


def test_line_threshold(spark):
    rows = [(i, "a line that three documents hold\nown line " + "abcdefghij"[i] * 3) for i in range(3)]
    assert {r["n_dropped"] for r in N.dedup_lines(frame(spark, rows), min_docs=4).collect()} == {0}
    assert sorted(r["n_dropped"] for r in N.dedup_lines(frame(spark, rows), min_docs=3).collect()) == [0, 1, 1]


# --- 7: decontamination


def plain_alignment(a, b):
    h, best = np.zeros((len(a) + 1, len(b) + 1), int), 0
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            h[i + 1, j + 1] = max(0, h[i, j] + (D.MATCH if x == y else D.MISMATCH), h[i, j + 1] + D.GAP, h[i + 1, j] + D.GAP)
            best = max(best, h[i + 1, j + 1])
    return best


def test_alignment_equals_the_plain_table():
    rng = np.random.default_rng(6)
    items = [rng.integers(0, 5, n) for n in (1, 3, 8, 12, 20)]
    windows = [rng.integers(0, 5, n) for n in (4, 1, 15, 9, 30)]
    assert D.align(items, windows)[0].tolist() == [plain_alignment(a, b) for a, b in zip(items, windows, strict=True)]


def test_leaks_exact_edited_and_absent(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    items = [(k, " ".join(word() for _ in range(25))) for k in range(6)] + [(90, None), (91, ""), (92, "two words")]
    around = lambda: " ".join(word() for _ in range(60))
    edited = items[1][1].split()
    for at in (5, 11, 18):
        edited[at] = "changed"
    rows = [(1, f"{around()} {items[0][1].upper()} {around()}"), (2, f"{around()} {' '.join(edited)}"), (3, around()), (4, None), (5, ""), (None, items[2][1]), (6, f"{items[3][1]}\n{items[4][1]}")]
    rows += [(100 + i, f"{around()} {items[5][1]} {around()}") for i in range(60)] + [(1, rows[0][1])]
    got = D.find_leaks(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = {(1, 0), (2, 1), (None, 2), (6, 3), (6, 4)} | {(100 + i, 5) for i in range(60)}
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want)
    assert {r["similarity"] for r in got if r["doc_id"] != 2} == {1.0}
    assert [0.75 <= r["similarity"] < 1 for r in got if r["doc_id"] == 2] == [True]
    assert D.find_leaks(frame(spark, []), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert D.find_leaks(frame(spark, rows), spark.createDataFrame([(1, None)], "item_id long, text string")).count() == 0


def edited_words(words, rate, rng):
    out = []
    for w in words:
        x = rng.random()
        if x < rate / 2:
            out.append(f"new{rng.randrange(50)}")
        elif x < 0.75 * rate:
            out += [w, f"more{rng.randrange(50)}"]
        elif x >= rate:
            out.append(w)
    return out


def test_recall_by_rate_of_edits(spark, small):
    """Against the alignment of all pairs, by rate of edits: substitutions, insertions, deletions."""
    rng = random.Random(12)
    items = [(r["item_id"], r["text"]) for r in table(spark, small, "benchmark").collect()]
    around = [r["text"].split()[:60] for r in table(spark, small, "documents").filter("length(text) > 400").limit(100).collect()]
    rates = [0.0, 0.1, 0.2, 0.3, 0.4]
    rows, rate_of = [], {}
    for rate in rates:
        for _ in range(60):
            doc = rng.choice(around)
            text = doc[:20] + edited_words(rng.choice(items)[1].split(), rate, rng) + doc[20:]
            rate_of[len(rows)] = rate
            rows.append((len(rows), " ".join(text)))
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in D.find_leaks(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    ids = {}
    code = lambda text: np.array([ids.setdefault(w.lower(), len(ids)) for w in text.split()])
    known = [(k, code(text)) for k, text in items]
    found, there = dict.fromkeys(rates, 0), dict.fromkeys(rates, 0)
    for doc_id, text in rows:
        words = code(text)
        score, _ = D.align([w for _, w in known], [words] * len(known))
        for (k, w), s in zip(known, score, strict=True):
            similarity = s / (D.MATCH * len(w))
            if similarity >= D.LEAST:
                there[rate_of[doc_id]] += 1
                found[rate_of[doc_id]] += (doc_id, k) in got
                assert (doc_id, k) not in got or got[doc_id, k] == pytest.approx(similarity, abs=1e-6)
    recall = {r: found[r] / there[r] for r in rates if there[r]}
    print("recall by rate of edits", recall, there)
    assert all(v >= 0.9 for v in recall.values()) and recall[0.0] == recall[0.1] == 1.0


def test_long_items_null_ids_and_ties(spark):
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    long_item, short, third = [[word() for _ in range(n)] for n in (20_000, 20, 27)]
    noise = lambda n: [word() for _ in range(n)]
    every_third = [("x" + w if i % 3 == 1 else w) for i, w in enumerate(third)]
    items = [(1, " ".join(long_item)), (None, " ".join(short)), (3, " ".join(third))]
    rows = [(1, " ".join(noise(3000) + short + noise(3000) + short + noise(50))), (2, " ".join(long_item[:15_000])), (None, " ".join(short)), (None, " ".join(noise(40))), (4, " ".join(every_third)), (5, " ".join(short + ["x"] + short))]
    docs, bench = frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["similarity"], r["last_word"]) for r in D.find_leaks(docs, bench).collect()}
    assert got == {(1, None): (1.0, 3019), (2, 1): (0.75, 14_999), (None, None): (1.0, 19), (5, None): (1.0, 19)}  # no three words of 4 are intact
    widths = [len(r["words"]) for r in windows_of(spark, docs.filter("doc_id = 1"), bench)]
    assert widths and max(widths) <= 20 + 4 * 40
    text = {r["text"] for r in D.stage(spark, docs, FakeBench(spark, bench)).collect()}
    assert text == {rows[3][1], rows[4][1]}


def windows_of(spark, docs, bench):
    known = bench.filter("text is not null").mapInArrow(D._item_words, "item_id long, words array<long>, grams array<long>")
    seeds = known.select(D.reach_of(F.size("words"), D.LEAST).alias("reach"), F.explode("grams").alias("gram")).persist()
    count = seeds.count()
    shared = [spark.sparkContext.broadcast(x) for x in (D.bit_table(seeds, "gram", count), D.reach_table(seeds, count))]
    own = docs.select("doc_id", F.xxhash64("text").alias("body"), "text")
    return own.mapInArrow(D._windows(*shared), "wid long, doc_id long, body long, start long, words array<long>, grams array<long>").collect()


def test_common_seeds_make_no_pairs(spark):
    """Documents and items that share only a phrase are not aligned; a few that hold an item are, also items of common words alone."""
    rng = random.Random(31)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    phrase = "which of the following is"
    for n_docs, n_items in ((1000, 50), (2000, 100)):
        items = [(k, f"{phrase} {' '.join(word() for _ in range(14))}") for k in range(n_items)] + [(9000, phrase)]
        rows = [(i, f"{' '.join(word() for _ in range(12))} {phrase} {' '.join(word() for _ in range(12))}") for i in range(n_docs)]
        edited = items[7][1].split()
        edited[9] = "changed"
        rows += [(5000, items[3][1]), (5001, " ".join(edited))]
        docs, bench = frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")
        got = {(r["doc_id"], r["item_id"]) for r in D.find_leaks(docs, bench).collect()}
        assert {g for g in got if g[1] != 9000} == {(5000, 3), (5001, 7)}
        assert {g[0] for g in got if g[1] == 9000} == {r[0] for r in rows}  # all of its words are in every document
        known = bench.mapInArrow(D._item_words, "item_id long, words array<long>, grams array<long>").filter("item_id < 9000").withColumn("item", F.col("item_id")).persist()
        seeds = D.rare_seeds(docs, known, D.LEAST)
        assert seeds.groupBy("gram").count().agg(F.max("count")).first()[0] <= D.MOST_ITEMS
        assert seeds.count() >= 10 * n_items


def test_an_item_in_most_documents_keeps_its_seeds(spark):
    rng = random.Random(32)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    item = [word() for _ in range(30)]
    rows = []
    for i in range(300):
        own = list(item)
        if i % 2:
            for at in range(i % 5, 30, 5):
                own[at] = word()
        rows.append((i, " ".join([word() for _ in range(9)] + own + [word() for _ in range(9)])))
    got = D.find_leaks(frame(spark, rows), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()
    assert len(got) == 300 and {r["similarity"] for r in got if r["doc_id"] % 2 == 0} == {1.0}


class FakeBench(str):
    """A folder that holds the given benchmark."""

    def __new__(cls, spark, bench):
        folder = new_folder(spark, "bench")
        bench.write.parquet(f"{folder}/benchmark.parquet")
        return super().__new__(cls, folder)


@pytest.mark.parametrize("whole", [0, 1])
def test_leaks_of_many_equal_edited_and_cut_copies(spark, whole):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    items = [(k, " ".join(word() for _ in range(40))) for k in range(2)]
    edited = items[0][1].split()
    for at in (6, 14, 22, 30):
        edited[at] = "changed"
    cut = items[1][1].split()[:24]
    around = lambda: " ".join(word() for _ in range(20))
    rows = [(1000 * k + i, f"{around()} {' '.join(part)} {around()}") for k, part in enumerate((edited, cut)) for i in range(200)]
    rows += [(5000 + k, items[k][1]) for k in range(2) if whole]
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in D.find_leaks(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {(1000 * k + i, k): s for k, s in ((0, 0.85), (1, 0.6)) for i in range(200)} | {(5000 + k, k): 1.0 for k in range(2) if whole}
    assert got.keys() == want.keys() and all(got[p] >= s for p, s in want.items())


# --- 8: extraction


def test_pages_give_their_documents(spark, small):
    docs = {r["doc_id"]: r["text"] for r in table(spark, small, "documents").collect()}
    for r in H.op8_html_extraction(spark, small).collect():
        lines = docs[int(re.search(r"/[a-z]+/(\d+)", r["url"])[1])].split("\n")
        title = " ".join(html.unescape(html.escape(lines[0], quote=False)[:60]).split())  # pages cut their titles after escaping
        assert r["text"].split("\n") == [x for x in [title, *(" ".join(line.split()) for line in lines)] if x]
        assert r["n_chars"] == len(r["text"])


CASES = {
    "plain": ("<p>One &amp; two</p><p>Three&nbsp;four\n five</p>", "One & two\nThree four five"),
    "parts": ('<nav><ul><li>Menu</li></ul></nav><div class="post-12"><h1>Head</h1><p>Body of the text, long enough.</p><div class="comments"><p>Nice one</p></div></div><aside>Side</aside><footer>Foot</footer>', "Head\nBody of the text, long enough."),
    "script": ('<article><p>Text<script>var t="</p><p>no</p>";</script> goes on</p><style>p{}</style></article>', "Text goes on"),
    "comment": ("<article><!-- <p>no</p> --><p>Yes</p></article><!-- open", "Yes"),
    "unclosed": ("<article><p><b>One<br><p>Two<i>three</article><div class=ad>Buy</div>", "One\nTwothree"),
    "attributes": ('<article><p title="a > b">In</p></article><div id="cookie-notice"><p>We use cookies</p></div><form><p>Sign up</p></form>', "In"),
    "broken": ("<article><p>a < b and c</p><p class='x>d</p></article>", None),
    "empty": ("", ""),
    "none": (None, ""),
    "no text": ("<html><head><title>T</title></head><body><script>x</script></body></html>", ""),
}


@pytest.mark.parametrize("name", CASES)
def test_page_cases(name):
    page, want = CASES[name]
    got = H.main_text(page)
    assert want is None or got == want


STORY = "<h1>Head</h1><p>" + "A paragraph that goes on for a while. " * 8 + "</p>"
STORY_TEXT = "Head\n" + ("A paragraph that goes on for a while. " * 8).strip()
WRAPPERS = ['div class="layout with-sidebar"', 'div id="content" class="no-sidebar"', 'div class="has-header-image"', 'form id="aspnetForm"', 'div class="page-header-wrapper"', 'main class="content-comments-off"', 'div class="site-form" role="form"']


@pytest.mark.parametrize("wrapper", WRAPPERS)
def test_a_wrapper_keeps_its_article(wrapper):
    tag = wrapper.split()[0]
    assert H.main_text(f"<body><{wrapper}>{STORY}</{tag}><footer>Foot</footer></body>") == STORY_TEXT


PARTS = {
    "share-prices": '<div class="share-prices"><p>Prices rose.</p></div>', "social-history": '<section id="social-history"><p>Its history.</p></section>', "header-image": '<div class="has-header-image"><p>Shown.</p></div>',
}
DROPPED = ['<div class="comment-list"><p>{}</p></div>', '<ul class="post-comments" id="x"><li>{}</li></ul>', '<div id="site-footer"><p>Foot</p></div>', '<div class="share-buttons">Share</div>', '<div class="cookie-notice">We use</div>', '<form><p>Sign up</p></form>', '<div class="widget-area">Side</div>', '<div role="form">Mail</div>']


@pytest.mark.parametrize("name", PARTS)
def test_a_section_named_like_a_menu_stays_in_its_article(name):
    page = f"<article>{STORY}{PARTS[name]}</article>"
    assert H.main_text(page) == STORY_TEXT + "\n" + re.sub("<[^>]*>", "", PARTS[name])


@pytest.mark.parametrize("part", DROPPED)
def test_parts_go_however_long_their_comments_are(part):
    for size in (1, 200):
        assert H.main_text(f"<body><div>{STORY}</div>{part.format('More text of readers. ' * size)}</body>") == STORY_TEXT


def test_a_host_with_most_pages_and_one_without_text(spark, monkeypatch):
    usual = '<div class="top"><p>{0} short.</p></div><div class="story-{0}"><p>{0} is the story, and it goes on for a good while here.</p></div>'
    rows = [(i, f"http://hot.org/{i}", usual.format(i), "x", i) for i in range(60)] + [(100 + i, f"http://h{i}.org/", usual.format(i), "y", 1) for i in range(30)] + [(200 + i, None, None, "z", 0) for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string, path long")
    want = {r[0]: f"{r[0] % 100} is the story, and it goes on for a good while here." if r[2] else "" for r in rows}
    for keys in (10_000, 10):
        monkeypatch.setattr("tidemetric.llm.common.HEAVY_KEYS", keys)
        got = H.extract_pages(pages).collect()
        assert {r["page_id"]: r["text"] for r in got} == want and len(got) == len(rows)


DEEP = "<div>" * 5000
ODD = {
    "open tags": ("<a" * 500_000, 1_000_000),
    "open script tags": ("<script" * 150_000, 1_050_000),
    "open scripts": ("x<script>" * 100_000, 1),
    "open quotes": ("<p x='y\">\"z" * 90_000, None),
    "quoted ends only": ("<a \"<b>\" '" * 90_000, None),
    "open comments": ("<!--" * 250_000, 0),
    "stray ends": (f"{DEEP}{'</p></table></section>' * 50_000}a", 1),
    "deep": (f"<h1>t</h1>{DEEP}<p>text</p>{'</div>' * 5000}", 6),
    "deep heading": (f"{DEEP}<h1>t</h1><p>text</p>", 6),
    "long reference": (f"a &#{'1' * 1_000_000}; b", 5),
    "padded reference": ("&#0000000065;", 1),
    "long text": ("word " * 400_000, 1_999_999),
}


@pytest.mark.parametrize("name", ODD)
def test_odd_pages_take_linear_time(name):
    page, chars = ODD[name]
    for path in (None, "body div", "body" + " div" * 4999, "body nav"):
        start = time.perf_counter()
        text = H.main_text(page, path)
        assert time.perf_counter() - start < 2.5
        assert chars is None or len(text) == chars or (path is not None and text)


def test_deep_pages_pass_the_query(spark):
    rows = [(i, "http://deep.org/", f"{DEEP}<h1>t</h1><p>text {i}</p>") for i in range(3)] + [(9, "http://deep.org/", "<div><p>other</p></div>"), (None, None, "<a" * 50_000)]
    got = {r["page_id"]: r["text"] for r in H.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"t\ntext {i}" for i in range(3)} | {9: "other", None: "<a" * 50_000}


def test_host_vote_settles_doubtful_pages(spark):
    usual = '<div class="top"><p>{0} short.</p></div><div class="story-{0}"><p>{0} is the story, and it goes on for a good while here.</p></div>'
    odd = '<div class="top"><p>An unusually long line above the story, longer than all the rest of it.</p></div><div class="story-9"><p>The story.</p></div>'
    rows = [(i, f"http://h.example.com/{i}", usual.format(i)) for i in range(5)] + [(9, "http://h.example.com/9", odd), (10, None, None), (11, "x", "<p>Alone</p>"), (None, "http://H.example.com/", usual.format(1))]
    got = {r["page_id"]: r["text"] for r in H.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[9] == "The story." and got[0] == "0 is the story, and it goes on for a good while here."
    assert got[10] == "" and got[11] == "Alone" and len(got) == 9
    assert H.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# --- 9: language


def test_held_out_languages(spark, small):
    got = L.op9_language_id(spark, small).join(table(spark, small, "documents").select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null").collect()
    assert len(got) > 100 and np.mean([r["lang_pred"] == r["lang"] for r in got]) >= 0.98


def test_language_edges(spark):
    rows = [(i, "the cat and the dog went to the house", "en", None) for i in range(20)] + [(50 + i, "der hund und die katze gehen nach hause", "de", None) for i in range(20)] + [(90, "nothing known here", None, None)]
    model = L.train_filter(frame(spark, rows))
    asked = frame(spark, [(1, "the dog"), (2, "die katze"), (3, None), (4, ""), (5, "123 !?"), (6, "ЖЖЖ"), (None, "the house"), (7, "the dog " * 200_000)])
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in L.identify(asked, model).collect()}
    assert [got[i][0] for i in (1, 2, 3, 4, 5, None, 7)] == ["en", "de", "und", "und", "und", "en", "en"]
    assert got[6] == ("de", 0.0) or got[6] == ("en", 0.0)
    assert all(0 <= s <= 1 for _, s in got.values())
    assert {r["lang_pred"] for r in L.identify(asked, L.train_filter(frame(spark, []))).collect()} == {"und"}


def test_letters_of_every_plane(spark):
    table = L.letter_table()
    assert len(table) == 0x110000 and all(table[i] == chr(i).isalpha() for i in range(0x110000))
    far = [f"{chr(0x32050 + k % 7)}{chr(0x32060 + k % 5)}{chr(0x32070)} " * 6 for k in range(40)]
    rows = [(i, t, "zz", "s") for i, t in enumerate(far)] + [(100 + i, "the plain words of another one " * 3, "en", "s") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["lang_pred"] for r in L.identify(docs.filter("lang = 'zz'"), L.train_filter(docs)).collect()}
    assert got == {"zz"}


def test_filter_returns_all_languages_of_a_gram():
    grams = {"a": np.arange(0, 50, dtype=np.int64), "b": np.arange(25, 80, dtype=np.int64)}
    grams = {k: L.mix(v.view(np.uint64)).view(np.int64) for k, v in grams.items()}
    model = L.build_filter(grams, "a")
    mask = model.languages(np.concatenate([grams["a"], grams["b"]]).view(np.uint64))[:, 0]
    assert (mask[:25] & 1).all() and (mask[25:50] == 3).all() and (mask[75:] & 2).all()
    assert (model.wrong < 1e-6).all()


def test_languages_equal_those_of_plain_sets(spark, small, monkeypatch):
    """The Bloom filter decides as the sets of n-grams that it stands for, but for close calls."""
    held = {}
    build = L.build_filter
    monkeypatch.setattr(L, "build_filter", lambda grams, *rest: held.update(grams) or build(grams, *rest))
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = L.train_filter(docs.filter(~is_held_out()))
    texts = [r["text"] for r in docs.filter(is_held_out() & F.col("text").isNotNull()).select("text").collect()]
    sets = [set(held[lang].view(np.uint64).tolist()) for lang in model.langs]
    same = seen = 0
    for text, lang in zip(texts, L.classify(texts, model)[0], strict=True):
        grams = [g for _, codes, letters in L.slabs([text]) for _, value in L.gram_hashes(codes, letters) for g in value.tolist()]
        counts = [sum(g in s for g in grams) for s in sets]
        if max(counts) > 1.1 * sorted(counts)[-2]:
            seen += 1
            same += model.langs[int(np.argmax(counts))] == lang
    assert seen > 0.9 * len(texts) and same == seen


def test_slabs_lose_no_gram(monkeypatch):
    text = "abcdefgh ijkl " * 40
    counts = []
    for slab in (1 << 18, 50):
        monkeypatch.setattr(L, "SLAB", slab)
        total = set()
        for _, codes, letters in L.slabs([text, "xyz"]):
            for _, value in L.gram_hashes(codes, letters):
                total |= set(value.tolist())
        counts.append(total)
    assert counts[0] == counts[1]


def test_sha_of_kept_text(spark, tiny):
    got = {r["doc_id"]: r["kept_sha256"] for r in N.op6_line_dedup(spark, tiny).collect()}
    docs = [(r["doc_id"], r["text"]) for r in table(spark, tiny, "documents").collect()]
    assert got == {i: hashlib.sha256(t.encode()).hexdigest() for i, _, _, t in brute_lines(docs)}
