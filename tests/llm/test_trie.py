"""Operator 11 against a plain dictionary of prefixes."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from tidemetric.llm import conv_trie as T

ROWS = "conv_id long, turn long, role string, text string, depth int, key string"


def brute(rows):
    turns = {}
    for c, turn, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append((turn is not None, turn or 0, hashlib.md5(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest(), role or "", text or ""))
    seqs = {}
    for c, own in turns.items():
        h, head = zlib.crc32(str(c).encode()) % 4, sorted(turns.get(c - int(np.fmod(c, 20)), []))
        seqs[c] = [t[3:] for t in head[:h] + sorted(own)[h:]]
    nodes = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            nodes.setdefault(tuple(s[:d]), []).append(c)
    words = lambda t: len(t.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ")) - t.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ").count("")
    out = []
    for node, members in nodes.items():
        under = [n for n in nodes if n[: len(node)] == node]
        kids = [n for n in under if len(n) == len(node) + 1]
        leaves = [n for n in under if not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in nodes)]
        saved = sum((len(nodes[n]) - 1) * words(n[-1][1]) for n in under if n)
        ends = ",".join(str(c) for c in sorted(members) if len(seqs[c]) == len(node))
        out.append((min(members), len(node), min(nodes[node[:-1]]) if node else None, len(members), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows, **limits):
    got = T.prefix_trie(spark.createDataFrame([(*r, 7, "k") for r in rows], ROWS), **limits).collect()
    return sorted((tuple(r[c] for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")) for r in got), key=str)


def rows_of(seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(-45, 90), 1000, 10**15]:
        if c % 11 == 4 and c % 20:
            continue
        if c in (20, 40):  # heads that are absent
            continue
        n = rng.choice([1, 1, 2, 3, 5, 9])
        for t in range(n):
            rows.append((c, rng.choice([t, t, t, None, 1]), rng.choice(["user", "assistant", None]) if t > 1 else "user", rng.choice(["a b", "a  b c\n", "", None, "é x"]) if t else "hi there"))
    rows += [(c, t, "user", f"same {t}") for c in range(200, 260) for t in range(3)]  # copies of one conversation
    rows += [(300, t, "user", f"w {t % 7}") for t in range(120)] + rows[:5] + [(None, 1, "user", "x"), (301, 0, "user", "y " * 200_000)]
    return rows


@pytest.mark.parametrize("limits", [{}, {"cells": 60, "most": 4}, {"cells": 1, "most": 1}, {"cells": 40, "most": 1000, "shard_turns": 20}])
def test_equals_plain_prefixes_at_any_block_size(spark, limits):
    rows = rows_of(5)
    assert found(spark, rows, **limits) == brute(rows)


def test_no_rows_and_turnless_conversations(spark):
    assert found(spark, []) == [] and found(spark, [(None, 1, "user", "x")]) == []
    lone = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 >= 1)
    got = found(spark, [(lone, 0, "user", "x")])  # its head is absent, and its own turn is replaced
    assert got == [(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]


def test_shared_turns():
    a, b = bytes(16) + b"\x01" * 16, bytes(16) + b"\x02" * 16
    assert T.shared_turns(a, b) == 1 and T.shared_turns(a, a) == 2 and T.shared_turns(a, a[:16]) == 1 and T.shared_turns(b"", a) == 0 and T.shared_turns(None, a) == -1
