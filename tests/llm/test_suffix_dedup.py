"""Operator 13 against a plain dictionary of windows."""

import hashlib
import random

import numpy as np
import pytest

from tidemetric.llm import suffix_dedup as S

DOCS = "doc_id long, text string, n_bytes string, tid int"


def brute(rows, size):
    seen = {}
    blobs = [(t or "").encode() for _, t in rows]
    for b in blobs:
        for i in range(len(b) - size + 1):
            seen[b[i : i + size]] = seen.get(b[i : i + size], 0) + 1
    out = []
    for (i, _), b in zip(rows, blobs, strict=True):
        gone = np.zeros(len(b) + 1, bool)
        for at in range(len(b) - size + 1):
            if seen[b[at : at + size]] > 1:
                gone[at : at + size] = True
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        out.append((i, len(b), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows, parse, block=S.BLOCK):
    got = S.dedup_substrings(spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS), parse, block).collect()
    return sorted((tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in got), key=str)


def texts(seed, n, size):
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choice("abcdé ") for _ in range(k))
    passages = [word(rng.randint(size - 3, 4 * size)) for _ in range(5)]
    hot = word(3 * size)
    rows = []
    for i in range(n):
        parts = [word(rng.randint(0, 3 * size))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            low = rng.randint(0, len(p) // 2)
            parts += [p[low : rng.randint(low, len(p))], word(rng.randint(0, size))]
        if i % 3 == 0:
            parts.append(hot + word(size // 2))
        rows.append((i, "".join(parts)))
    rows += [(1000 + i, rows[1][1]) for i in range(4)] + [rows[2], rows[2]]  # copies and repeated rows
    near = list(rows[3][1] + word(5 * size))
    for i in range(6):
        near[rng.randrange(len(near))] = "Z"
        rows.append((2000 + i, "".join(near)))
    rows += [(3000, "a" * (6 * size)), (3001, "ab" * (3 * size)), (3002, "abc" * size + "q" + "abc" * size), (3003, "x" * size), (3004, "x" * (size - 1)), (3005, None), (3006, ""), (None, passages[0] * 2), (None, None)]
    rows.append((3007, word(2 * size) + "y" * (2 * size) + word(30)))
    return rows


@pytest.mark.parametrize(("parse", "block"), [(S.Parse(40, 4, 30, 10, 8), 4096), (S.Parse(40, 4, 29, 10, 8), 16), (S.Parse(40, 4, 36, 50, 3), 7), (S.Parse(24, 3, 8, 1, 1 << 40), 4096), (S.Parse(40, 4, 35, 3, 12), 64)])
def test_equals_plain_windows(spark, parse, block):
    rows = texts(parse.rate + block, 60, parse.size)
    assert found(spark, rows, parse, block) == brute(rows, parse.size)


def test_equals_plain_windows_at_full_size_and_across_slabs(spark, monkeypatch):
    rows = texts(9, 24, 400)
    rows.append((4000, "".join(t or "" for _, t in rows[:10]) + "k" * 900))
    monkeypatch.setattr(S, "SLAB", 700)
    assert found(spark, rows, S.Parse(), 64) == brute(rows, 400)


def test_no_rows(spark):
    assert found(spark, [], S.Parse()) == []
    assert found(spark, [(1, None), (2, "short")], S.Parse()) == brute([(1, None), (2, "short")], 400)


def test_parse_of_a_window_depends_on_its_bytes_alone():
    """Equal windows start with the same offset to their phrase's end, wherever they are."""
    rng = np.random.default_rng(2)
    parse = S.Parse()
    shared = rng.integers(97, 101, 3000).astype(np.uint8)
    offsets = []
    for before in (0, 17, 5000):
        data = np.concatenate([rng.integers(97, 101, before).astype(np.uint8), shared])
        whole = np.array([0]), np.array([len(data)])
        _, place, low, advance, _ = S.phrase_ends(data, *whole, *whole, parse)[0]
        own = np.concatenate([np.arange(p - a + 1, p - o + 1) for p, o, a in zip(place, low, advance, strict=True)])
        end = np.repeat(place, advance - low)
        offsets.append(dict(zip((own - before).tolist(), (end - before).tolist(), strict=True)))
    for start in range(len(shared) - parse.size + 1):
        assert len({o[start] for o in offsets}) == 1
    with pytest.raises(ValueError, match="inside"):
        S.Parse(size=400, reach=390)


def test_blocks_come_a_few_at_a_time(spark, monkeypatch):
    """A worker is handed at most ``BLOCKS_A_BATCH`` blocks, however many a task has; the session's setting stays."""
    name, real = "spark.sql.execution.arrow.maxRecordsPerBatch", S._settled
    before = spark.conf.get(name)

    def settled(size):
        run, most = real(size), S.BLOCKS_A_BATCH

        def checked(batches):
            for batch in batches:
                if batch.num_rows > most:
                    raise ValueError(f"{batch.num_rows} blocks at a time")
                yield from run(iter([batch]))

        return checked

    monkeypatch.setattr(S, "_settled", settled)
    parse = S.Parse(12, 4, 7, 4, 3)
    rows = texts(3, 40, 12)
    assert found(spark, rows, parse, block=2) == brute(rows, 12)
    assert spark.conf.get(name) == before


def test_runs_of_a_row():
    marks = np.array([[1, 1, 0, 1], [0, 0, 0, 0], [0, 1, 1, 1]], bool)
    assert S.runs_of(marks) == [(0, 0, 1), (0, 3, 3), (2, 1, 3)]
