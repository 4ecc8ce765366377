"""Wu-Manber search against plain comparison of word lists."""

import hashlib
import random
import re

import pytest
from moodloom.llm import wumanber

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    strings = {}
    for item, text in items:
        w = words(text)
        n = min(len(w), wumanber.WORDS)
        for i in range(len(w) - n + 1) if n else ():
            strings.setdefault(tuple(w[i : i + n]), set()).add(item)
    sizes = {len(s) for s in strings}
    out = []
    for doc_id, text in docs:
        w, hit, met = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in strings:
                    hit |= set(range(i, i + n))
                    met |= strings[tuple(w[i : i + n])]
        ids = ",".join(sorted(str(i) for i in met if i is not None))
        out.append((doc_id, len(w), len(hit), len(met), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def cases(seed=0):
    rng = random.Random(seed)
    vocabulary = ["ab", "the", "é", "x1", "thou", "ñandú", "of", "9"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, say(rng.randint(10, 40))) for i in range(12)]
    items += [(20, "Alone"), (21, "two words"), (22, ""), (23, None), (24, " .,; "), (None, say(15)), (25, "a b c d e f g h i j")]
    items += [items[0], (26, items[1][1].upper().replace(" ", " -- ")), (100, items[2][1]), (3, say(12)), (27, "the")]
    docs = [(i, say(rng.randint(0, 60))) for i in range(40)]
    docs += [(50 + i, f"{say(7)}\n{t}!{say(5)}") for i, (_, t) in enumerate(items)]
    docs += [(90, None), (91, ""), (92, "...!"), (93, "alone"), (94, "xalone alonex"), (None, "TWO,words"), (95, "two"), (96, "words")]
    docs += [docs[3], (97, "the " * 4000), (98, "q" * 100_000 + " alone"), (99, "a\x00b c-d e f g h i j"), (101, items[4][1][:-1])]
    return docs, items


@pytest.mark.parametrize("part_bytes", [wumanber.PART_BYTES, 400])
def test_against_comparison(spark, part_bytes):
    docs, items = cases()
    rows = [(d, t, 1, "f", "r") for d, t in docs]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, found int, row string, bytes string").repartition(3)
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id bigint, text string, part int")
    got = wumanber.report(frame, bench, part_bytes=part_bytes).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(docs, items)
    if part_bytes == wumanber.PART_BYTES:
        kept = wumanber.clean(frame, bench)
        assert kept.columns == frame.columns
        want = [r for r in rows if not brute([r[:2]], items)[0][-1]]
        assert sorted(map(repr, map(tuple, kept.collect()))) == sorted(map(repr, want))


def test_runs_and_items(spark):
    bench = spark.createDataFrame([(1, "one two"), (2, "four five")], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "zero one two, three FOUR five one two")], "doc_id bigint, text string")
    found = wumanber.find(docs, bench).first()["found"]
    assert [tuple(r) for r in found["runs"]] == [(1, 2), (4, 4)] and sorted(found["items"]) == ["1", "2"]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "one two")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, "one")], "item_id bigint, text string")
    assert wumanber.report(docs.limit(0), bench).count() == 0
    (row,) = wumanber.report(docs, bench.limit(0)).collect()
    assert tuple(row)[:4] == (1, 2, 0, 0) and not row["contaminated"]


def test_most_bytes_are_skipped():
    """The window looks at a small part of a text that shares nothing with the strings."""
    import numpy as np

    strings = wumanber.Strings([wumanber.strings_of(b"alpha beta gamma delta epsilon zeta eta theta iota kappa")[0]], np.zeros(1, int), 10)
    data = np.frombuffer(b" " + b"lorem ipsum dolor " * 20_000 + bytes(8), np.uint8)
    looked = []
    code = strings._code
    strings._code = lambda eight: looked.append(len(eight)) or code(eight)
    assert len(strings.candidates(data, len(data) - 8)) == 0
    assert sum(looked) < len(data) / (strings.m - wumanber.BLOCK - 4)
