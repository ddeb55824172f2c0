"""Operator 12 against brute force."""

import numpy as np
import pytest

from tidemetric.llm import hard_negatives as H

VECTORS = "vec_id long, embedding array<float>, label int, score string, rank int"


def brute(rows, step=100):
    """Plain enumeration over distinct (id, label, vector) rows."""
    kept = set()
    for i, v, label in rows:
        if i is not None and v is not None and label is not None and all(x is not None and np.isfinite(x) for x in v):
            kept.add((i, (label + 1) % 10 if i % 7 == 0 else label, tuple(int(np.floor(256 * float(np.float32(x)))) for x in v)))
    out = []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))  # noqa: E731, B905
    for i, label, q in kept:
        if i % step:
            continue
        scored = sorted((-dot(q, p), j, other) for j, other, p in kept if j != i)
        for minus, j, _ in [s for s in scored if s[2] == label][:5]:
            fits = [s for s in scored if s[2] != label and -80 * minus <= -100 * s[0] <= -100 * minus][:5]
            out += [(i, j, n + 1, k, -minus, -m) for n, (m, k, _) in enumerate(fits)]
    return sorted(out)


def found(spark, rows, step=100):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS)
    labelled = H.labelled(df)
    got = H.hard_negatives(labelled, labelled.filter(f"vec_id % {step} = 0"))
    return sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in got.collect())


def test_equals_brute_force_with_ties_copies_and_bad_vectors(spark, monkeypatch):
    rng = np.random.default_rng(12)
    rows = [(i, [float(x) for x in rng.integers(-2, 4, 6) / 4], int(rng.integers(0, 3))) for i in range(260)]
    rows += [(i, [0.5] * 6, 1) for i in range(260, 420)]  # one vector for a third of all rows
    rows += rows[:50]
    rows += [(500, None, 1), (600, [0.1, None], 1), (700, [float("nan")] * 6, 1), (800, [0.5] * 6, None), (None, [0.5] * 6, 1), (900, [0.5, 0.25], 2), (0, [0.25] * 6, 2), (1000, [], 0)]
    want = brute(rows, 20)
    monkeypatch.setattr(H, "SLICE_ROWS", 37)
    monkeypatch.setattr(H, "BLOCK_ROWS", 5)
    assert found(spark, rows, 20) == want and len(want) > 200


def test_no_rows_and_a_lone_anchor(spark):
    assert found(spark, []) == []
    assert found(spark, [(100, [1.0, 2.0], 3)]) == []
    assert found(spark, [(1, [1.0, 2.0], 3), (2, [1.0, 2.0], 4)]) == []


@pytest.mark.parametrize(("top", "width"), [(3, 5), (255, 700), (2**31, 9), (2**62, 4)])
def test_residue_scores_are_exact(top, width):
    rng = np.random.default_rng(3)
    a, b = rng.integers(-top, top + 1, (7, width)), rng.integers(-top, top + 1, (11, width))
    a[0], b[0], b[1] = top, top, -top
    want = np.clip(a.astype(object) @ b.astype(object).T, -(2**63), 2**63 - 1).astype(np.int64)
    assert (H.rns_scores(a, b, width * top * top) == want).all()
    for prime in H.primes_for(width * top * top):
        assert np.abs(H.residues(a, prime)).max() ** 2 * H.RUN < 2**24


def test_window_limits_are_exact():
    scores = np.array([[79, 80, 81, 100, 101, 0, -1, 2**62]])
    assert H.in_window(scores, np.array([100]), 80, 100).tolist() == [[False, True, True, True, False, False, False, False]]
    assert H.in_window(scores, np.array([0]), 80, 100).tolist() == [[s == 0 for s in scores[0]]]
    assert not H.in_window(scores, np.array([-5]), 80, 100).any()
    assert H.in_window(scores, np.array([2**62]), 80, 100)[0, -1]


def test_ties_go_to_the_first_columns():
    scores = np.array([[5, 7, 7, 7, 1], [1, 1, 1, 1, 1]])
    row, column = H.first_per_row(scores, np.array([[True, False, True, True, True], [True] * 5]), 2)
    assert list(zip(row.tolist(), column.tolist(), strict=True)) == [(0, 2), (0, 3), (1, 0), (1, 1)]
