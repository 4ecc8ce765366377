"""Prefix trie against dictionaries of whole prefixes."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from moodloom.llm import prefixtrie

KIND = "conv_id bigint, turn bigint, role string, text string, key string, shard int, depth int, ends string"


def turn_id(role, text):
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    return md5(md5(role) + md5(text))


def rebuilt(rows):
    """{conv_id: [(role, text), ..]}"""
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, turn_id(role or "", text or ""), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + ts[h:]
    return out


def brute(convs):
    nodes = {}
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            nodes.setdefault(tuple(ts[:d]), []).append(c)
    kids = {k: 0 for k in nodes}
    for k in nodes:
        if k:
            kids[k[:-1]] += 1
    leaves, saved = {k: 0 for k in nodes}, {k: 0 for k in nodes}
    for k, members in nodes.items():
        words = len((k[-1][1] if k else "").split())
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += (len(members) - 1) * words
    out = []
    for k, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c in members if len(convs[c]) == len(k))))
        above = min(nodes[k[:-1]]) if k else None
        sha = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(members), len(k), above, len(members), kids[k], leaves[k], saved[k], sha))
    return sorted(out, key=repr)


def cases(seed):
    rng = random.Random(seed)
    rows = []
    for c in range(120):
        c = c * rng.choice([1, 1, 3]) - 20
        for k in range(rng.randint(0, 6)):
            # Few texts, so that prefixes are shared at all depths.
            rows.append((c, k, rng.choice(["user", "user", None]), rng.choice(["a b", "a b", "c", None])))
    rows += [(c, k, "user", f"turn {k}") for c in range(400, 440) for k in range(5)]  # equal conversations
    rows += [(500, k, "user", "again") for k in range(60)] + [(501, k, "user", "again") for k in range(45)]
    rows += [(502, None, "user", "no turn"), (502, None, "user", "no turn"), (502, 3, None, None), (503, 1, "u", "x"), (503, 1, "a", "x")]
    rows += [(None, 0, "user", "nobody"), rows[0], (600, 0, "user", "w " * 30_000)]
    return [r + ("k", 1, 2, "e") for r in rows]


@pytest.mark.parametrize("seed,shards,columns", [(1, 8, 16), (2, 23, 2), (3, 1, 3)])
def test_against_dictionaries(spark, monkeypatch, seed, shards, columns):
    monkeypatch.setattr(prefixtrie, "COLUMNS", columns)
    rows = cases(seed)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", shards)
    try:
        got = prefixtrie.trie(prefixtrie.rebuilt(spark.createDataFrame(rows, KIND).repartition(3))).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted((tuple(r) for r in got), key=repr) == brute(rebuilt(rows))


def test_matrices():
    """Order and common prefixes of rows longer than a matrix, against lists."""
    rng = np.random.default_rng(0)
    size = rng.integers(0, 50, 300)
    start = np.cumsum(size) - size
    hi = rng.integers(1, 3, size.sum()).astype(np.uint64)
    lo = np.ones_like(hi)
    for r in range(0, 300, 2):  # long common prefixes
        n = min(size[r], size[r + 1])
        hi[start[r] : start[r] + n] = hi[start[r + 1] : start[r + 1] + n]
    conv = rng.permutation(300)
    order = prefixtrie.sort_rows(hi, lo, start, size, conv)
    lists = [hi[a : a + n].tolist() for a, n in zip(start, size)]
    assert order.tolist() == sorted(range(300), key=lambda r: (lists[r], conv[r]))
    shared = prefixtrie.common_prefix(hi, lo, start[order], size[order])
    for k in range(1, 300):
        a, b = lists[order[k - 1]], lists[order[k]]
        n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert shared[k] == n


def test_empty_table_and_turnless(spark):
    frame = lambda rows: spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    assert prefixtrie.trie(prefixtrie.rebuilt(frame([]))).count() == 0
    assert prefixtrie.trie(prefixtrie.rebuilt(frame([(None, 1, "user", "a")]))).count() == 0
    c = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 > 0)
    (row,) = prefixtrie.trie(prefixtrie.rebuilt(frame([(c, 1, "user", "a b")]))).collect()
    assert tuple(row) == (c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())
