"""run() against a brute-force version of its stages on the smallest tables."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

import corpus_pipeline  # noqa: E402
from moodloom.llm import mixing, viterbi  # noqa: E402
from test_operators import span_rule  # noqa: E402


def test_stages_and_rows(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    docs = {r["doc_id"]: r for r in rows if any(c.isalpha() for c in r["text"] or "")}
    shingles = {}
    for d, r in docs.items():
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r["text"]).split()
        shingles[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    root = {d: d for d in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(docs)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if 100 * len(shingles[a] & shingles[b]) >= 75 * len(shingles[a] | shingles[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    stay = [d for d in ids if find(d) == d]
    left = {d: t for (d, _), (t, _) in span_rule((d, docs[d]["text"]) for d in stay).items() if t.strip(" ")}
    frame = spark.createDataFrame(
        [(d, t, docs[d]["source"]) for d, t in left.items()], "doc_id bigint, text string, source string"
    )
    taken = {r["doc_id"]: r["taken"] // max(r["size"], 1) for r in mixing.of_source(frame).collect()}
    pieces = viterbi.Pieces(viterbi.default_model())
    want = []
    for d, t in left.items():
        want += [(d, sum(pieces.encode(viterbi.cut_words(" " + t)), []))] * taken[d]
    got = corpus_pipeline.run(spark, sf).collect()
    assert sorted((r["doc_id"], r["ids"]) for r in got) == sorted(want)
    assert len(corpus_pipeline.STAGES) == 5


EXTRA = ", place string, pattern string, uses int, h int, node string, spans string, clean string, covered int, col int"


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls, empty and long texts, ties, repeated rows, clashing columns: each row is kept whole or goes."""
    plain = lambda i: " ".join(f"word{i}x{k}" for k in range(40)) + "."
    rows = [(i, plain(i), ["en", "de", None][i % 3], None if i % 4 == 0 else f"s{i % 2}") for i in range(12)]
    rows += [rows[5], (40, plain(6), "en", "s0"), (None, plain(41), "en", "s1"), (42, None, None, None), (43, "", "en", "s0")]
    rows += [(44, "12 34 !", "en", "s0"), (45, "longtext " + " ".join(f"l{k}" for k in range(30_000)), "en", "s1")]
    clash = ("p", "q", 1, 2, "n", "s", "c", 3, 4)
    kind = "doc_id bigint, text string, lang string, source string" + EXTRA
    docs = spark.createDataFrame([r + clash for r in rows], kind).repartition(3)
    given = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.settle(stage(spark, docs, ""))
        assert docs.columns == given.columns, name
        got = docs.collect()
        assert all(tuple(r)[4:] == clash for r in got), name
        left = [(r["doc_id"], r["text"]) for r in got]
        assert all(any(c.isalpha() for c in t) for _, t in left)
        if name in ("near_dedup", "span_dedup"):
            # One of every group of equal texts, the smallest doc_id; clean texts untouched.
            assert {d for d, _ in left} - {None} == {*range(12), 45} and len(left) - len(set(left)) <= 1
            assert all((d, t) in {r[:2] for r in rows} for d, t in left)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert sorted(r["doc_id"] for r in last if r["doc_id"] is not None) == sorted(d for d, _ in left if d is not None)
    assert all(r["n_tokens"] == len(r["ids"]) > 0 for r in last)

    none = spark.createDataFrame([], kind)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        none = corpus_pipeline.settle(stage(spark, none, ""))
        assert none.columns == given.columns and none.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, none, "").count() == 0
