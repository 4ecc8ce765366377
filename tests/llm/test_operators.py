"""Operators on small tables with nulls, ties, empties and clashing columns, against brute force."""

import hashlib
import random
import zlib

import pytest

from moodloom.llm import crosspolytope, hyperminhash, langid, mixing, records, repetition, snapshots, spans, suffixes, viterbi

KIND = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# Names that the operators use inside.
CLASH = ", node string, size int, pattern string, data string, fp int, spans string, pieces string, key int, h int"


def texts(seed=0):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    sentence = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n)).capitalize() + "."
    passage = " ".join(sentence(12) for _ in range(5))
    out = [" ".join(sentence(rng.randint(5, 14)) for _ in range(rng.randint(1, 9))) for _ in range(25)]
    out += [out[0], out[1], out[2].replace("w1", "v1", 1), passage + " " + out[3], out[4] + "\n" + passage, "a b", "A b", "", None, "12 34 !"]
    out += ["word " * 3000, "é" * 400]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    langs = ["en", "de", "fr", "es", None]
    rows = [(i, t, langs[i % 5], None if i % 7 == 0 else f"s{i % 3}", 1) for i, t in enumerate(texts())]
    rows += [rows[0], (None, "Null id text of several words here. And more of it.", "en", "s1", 1)]
    clash = ("x", 1, "p", "d", 2, "s", "q", 3, 4)
    return spark.createDataFrame([r + clash for r in rows], KIND + CLASH).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], KIND)


def test_suffix_dedup(docs, empty):
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in docs.collect()]
    count = {}
    for _, t in rows:
        for s in range(len(t) - 199):
            count[t[s : s + 200]] = count.get(t[s : s + 200], 0) + 1
    want = []
    for d, t in rows:
        gone = bytearray(len(t))
        for s in range(len(t) - 199):
            if count[t[s : s + 200]] > 1:
                gone[s : s + 200] = b"\1" * 200
        kept = bytes(b for b, g in zip(t, gone) if not g)
        n = sum(g and (not k or not gone[k - 1]) for k, g in enumerate(gone))
        want.append((d, len(t), sum(gone), n, hashlib.sha256(kept).hexdigest()))
    names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    order = lambda rows: sorted(rows, key=repr)
    assert order(tuple(r[c] for c in names) for r in suffixes.dedup(docs).collect()) == order(want)
    # Grams with more contexts than a task takes are counted instead.
    assert order(tuple(r[c] for c in names) for r in suffixes.dedup(docs, max_group=1).collect()) == order(want)
    assert suffixes.dedup(empty).count() == 0


def span_rule(rows):
    """{(doc_id, text): (remaining text, removed units)} by the rule of the operator, with plain lists."""
    rows = sorted({(d if d is not None else -(1 << 63), t or "") for d, t in rows}, key=lambda r: r[0])
    cut = {r: spans._SENTENCE.findall(r[1]) for r in rows}
    plain = {r: [x.replace("\t", " ").replace("\n", " ").replace("\f", " ").replace("\r", " ").strip(" ").lower() for x in s] for r, s in cut.items()}
    first, marked = {}, {r: set() for r in rows}
    for r in rows:
        for i in range(len(plain[r]) - spans.SPAN + 1):
            k = tuple(plain[r][i : i + spans.SPAN])
            if first.setdefault(k, (r, i)) != (r, i):
                marked[r] |= set(range(i, i + spans.SPAN))
    out = {}
    for r in rows:
        gone, run = set(), []
        for i in range(len(plain[r]) + 1):
            if i in marked[r]:
                run.append(i)
                continue
            if run and sum(len(plain[r][k]) for k in run) + len(run) - 1 >= spans.MIN_CHARS:
                gone |= set(run)
            run = []
        out[r] = ("".join(x for i, x in enumerate(cut[r]) if i not in gone), len(gone))
    return out


def test_spans(docs, empty):
    want = span_rule((r["doc_id"], r["text"]) for r in docs.collect())
    got = spans.dedup(docs).collect()
    assert len(got) == docs.count() and any(r["n_removed"] for r in got)
    for r in got:
        d = r["doc_id"] if r["doc_id"] is not None else -(1 << 63)
        assert (r["clean"], r["n_removed"]) == want[d, r["text"] or ""]
    assert spans.dedup(empty).count() == 0 and spans.cleaned(empty).columns == empty.columns


def test_span_columns_keep_their_values(spark):
    """Own columns named like inner ones or like results stay what they are."""
    passage = "One line here.\nAnother short line!\nA third; with clauses, and words.\nThe last of them."
    names = ["clean", "n_removed", "n_sentences", "covered", "runs", "places", "_id", "_th", "_row", "h", "salt", "first"]
    rows = [(1, passage, *names), (2, "Start. " + passage, *names), (3, "Other, text. Not shared.", *names), (None, None, *names)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, " + ", ".join(f"{c} string" for c in names))
    got = spans.cleaned(frame)
    assert got.columns == frame.columns
    kept = {r["doc_id"]: r for r in got.collect()}
    assert {d: r["text"] for d, r in kept.items()} == {1: passage, 2: "Start. ", 3: rows[2][1]}
    assert all(r[c] == c for r in kept.values() for c in names)
    assert {r["doc_id"]: r["n_removed"] for r in spans.dedup(frame).collect()} == {1: 0, 2: 6, 3: 0, None: 0}


def test_passages_that_whole_sentences_miss(spark, monkeypatch):
    """Short lines, one long sentence, other scripts, and a span that is hot."""
    monkeypatch.setattr(spans, "HOT_SHARE", 0.0)
    lines = "\n".join(f"{k} SHOUT!!" for k in "ABCDEFGHIJKLMNOP")
    long = ", ".join(f"a clause with the number {k} in it" for k in range(9))
    other = "。".join("これは同じ文章です" + "あいうえお"[k] for k in range(5)) * 3
    texts = [lines, "x " + lines + " y.", long, "He said " + long + " and left.", other, "前" + other + "後。"]
    texts += ["Common start of all, every one of them in the same words. Another part that all have, too. " + str(k) for k in range(1500)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want = span_rule(enumerate(texts))
    got = {r["doc_id"]: r for r in spans.dedup(frame).collect()}
    assert all((r["clean"], r["n_removed"]) == want[d, texts[d]] for d, r in got.items())
    assert all(got[d]["n_removed"] >= 7 and len(got[d]["clean"]) < 100 for d in (1, 3, 5))
    assert got[6]["n_removed"] == 0 and all(got[d]["clean"] == str(d - 6) for d in range(7, 1506))


def test_near_duplicates(docs, empty):
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    sets = []
    for _, t in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t).split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    names = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            names[find(i)] = min(names.get(find(i), d), d)
    want = sorted(((d, len(s), names.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr)
    got = hyperminhash.near_duplicates(docs).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    one = hyperminhash.one_of_each(docs)
    ids = sorted(r["doc_id"] for r in one.collect() if r["doc_id"] is not None)
    assert ids == sorted({c for d, _, c in want if c is not None and d == c}) and one.columns == docs.columns
    assert hyperminhash.near_duplicates(empty).count() == 0


def test_one_of_each_without_ids_and_with_equal_ids(spark):
    """Unrelated texts stay, whatever their ids: a component is not named by its doc_id."""
    text = lambda k: " ".join(f"{k}w{i}" for i in range(40))
    rows = [(None, text("a")), (None, text("b")), (None, text("c")), (None, text("c") + " more")]
    rows += [(7, text("d")), (7, text("e")), (7, text("e") + " more"), (8, text("e")), (None, text("d"))]
    rows += [(None, ""), (None, None), (7, "")]
    docs = spark.createDataFrame([(d, t, None, None, 1) for d, t in rows], KIND)
    left = [(r["doc_id"], r["text"] or "") for r in hyperminhash.one_of_each(docs).collect()]
    alone = [(None, text("a")), (None, text("b")), (7, text("d")), (None, ""), (7, "")]
    assert [x for x in alone if left.count(x) != 1] == [] and len(left) == 7
    assert sum(d is None and t.startswith("cw") for d, t in left) == 1
    assert sum(d == 7 and t.startswith("ew") for d, t in left) == 1


def test_blocks_find_what_stars_miss(spark, monkeypatch):
    """A chain of texts, each linked with the next alone, in blocks of two rows."""
    monkeypatch.setattr(hyperminhash, "BLOCK", 2)
    words = [f"t{i}" for i in range(400)]
    rows = [(i, " ".join(words[12 * i : 12 * i + 120]), None, None, 1) for i in range(20)]
    got = hyperminhash.near_duplicates(spark.createDataFrame(rows, KIND)).collect()
    assert {r["component_id"] for r in got} == {0}


def test_mix(spark, docs, empty):
    got = mixing.of_source(docs.select("doc_id", "text", "source", "node")).collect()
    size = lambda t: len((t or "").split())
    total = {}
    for r in docs.collect():
        total[r["source"]] = total.get(r["source"], 0) + size(r["text"])
    wanted = mixing.targets(total)
    taken = {}
    for r in got:
        assert r["size"] == size(r["text"]) and r["source_size"] == total[r["source"]]
        assert r["target"] == wanted[r["source"]] and r["taken"] <= 2 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    big = {s: max(size(r["text"]) for r in got if r["source"] == s) for s in total}
    assert all(abs(taken[s] - wanted[s]) <= big[s] for s in total)
    again = mixing.of_source(docs.select("doc_id", "text", "source", "node").repartition(5)).collect()
    key = lambda rows: sorted(((r["doc_id"], r["taken"]) for r in rows), key=repr)
    assert key(again) == key(got)
    assert mixing.repeated(docs).columns == docs.columns and mixing.repeated(empty).count() == 0


def test_mix_keeps_values_of_clashing_columns(spark, docs):
    names = ["place", "cuts", "pattern", "uses", "targets", "source_sizes", "size", "taken", "Target", "doc", "col", "sources"]
    mine = {c: f"my {c}" for c in names}
    plain = docs.select("doc_id", "text", "source")
    wide = plain.withColumns({c: mixing.F.lit(v) for c, v in mine.items()})
    uses = {r["doc_id"]: r["taken"] // max(r["size"], 1) for r in mixing.of_source(plain).collect()}
    many = mixing.repeated(wide)
    assert many.columns == wide.columns
    got = many.collect()
    assert all(r[c] == v for r in got for c, v in mine.items())
    counts = {}
    for r in plain.collect():
        counts[r["doc_id"], r["text"]] = counts.get((r["doc_id"], r["text"]), 0) + uses[r["doc_id"]]
    seen = {}
    for r in got:
        seen[r["doc_id"], r["text"]] = seen.get((r["doc_id"], r["text"]), 0) + 1
    sized = {k: n for k, n in counts.items() if n and (k[1] or "").split()}
    assert {k: n for k, n in seen.items() if (k[1] or "").split()} == sized
    row = mixing.of_source(wide).first()
    assert (row["place"], row["size_"], row["taken_"], row["Target_"]) == ("my place", "my size", "my taken", "my Target")
    lists = plain.select("*", mixing.F.array("source").alias("sources"), mixing.F.lit(3).alias("size"), mixing.F.lit("p").alias("pattern"))
    row = mixing.mix(lists).first()
    assert row["pattern_"] == "p" and row["pattern"] == row["sources"] == [row["source"]] and row["size"] == 3


def test_mix_of_overlapping_sources(spark):
    rows = [(i, f"text {i}", ["a"] if i % 3 else ["a", "b"], 10) for i in range(300)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, text string, sources array<string>, size bigint")).collect()
    words = {s: sum(10 * r["uses"].count(s) for r in got) for s in ("a", "b")}
    target = mixing.targets({"a": 3000, "b": 1000})
    assert all(abs(words[s] - target[s]) <= 20 for s in words)
    assert all(set(r["uses"]) <= set(r["sources"]) and len(r["uses"]) <= 2 for r in got)


def test_language(spark, sf, docs, empty):
    real = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r["doc_id"]: r for r in langid.identify(real).collect()}
    lang = {r["doc_id"]: r["lang"] for r in real.collect()}
    out = [d for d in got if zlib.crc32(str(d).encode()) % 5 == 0]
    assert all(got[d]["held_out"] == (d in set(out)) for d in got)
    assert sum(got[d]["lang_pred"] == lang[d] for d in out) >= 0.95 * len(out)
    some = langid.identify(docs).collect()
    none = {r["doc_id"] for r in docs.collect() if not any(c.isalpha() for c in r["text"] or "")}
    assert all((r["lang_pred"] == "und") == (r["doc_id"] in none) and 0 <= r["score"] <= 1 for r in some)
    assert langid.identify(empty).count() == 0 and langid.keep_known(empty).columns == empty.columns
    assert langid.keep_known(docs).columns == docs.columns


def test_rules(docs, empty):
    for r in repetition.rules(docs).collect():
        assert not (r["kept"] and r["base_failed"]) and (r["n_words"] or r["base_failed"])
    assert repetition.rules(empty).count() == 0


def test_pieces(docs, empty):
    rows = viterbi.encode(docs).collect()
    assert all(r["pieces"]["decoded_equal"] and len(r["pieces"]["ids"]) == r["pieces"]["n_tokens"] for r in rows)
    assert all((r["pieces"]["n_tokens"] == 0) == (not r["text"]) for r in rows)
    back = viterbi.decode(viterbi.encode(docs.drop("pieces")).selectExpr("text", "pieces.ids AS ids")).collect()
    assert all(r["decoded"] == (r["text"] or "") for r in back)
    assert viterbi.encode(empty).count() == 0


def test_records(spark, docs, empty, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(records.default_tokenizer())
    manifest = records.write(docs, str(tmp_path))
    got = records.read_back(manifest, str(tmp_path)).orderBy("start").collect()
    rows = docs.collect()
    ids = {}
    for r in rows:
        t = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        ids.setdefault(r["doc_id"], t)
    start = 0
    assert [r["doc_id"] for r in got] == sorted((r["doc_id"] for r in rows), key=lambda d: (d is not None, d))
    for r in got:
        t = ids[r["doc_id"]]
        raw = b"".join(i.to_bytes(4, "little") for i in t)
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(t), zlib.crc32(raw))
        start += len(t)
    assert records.read_back(records.write(empty, str(tmp_path)), str(tmp_path)).count() == 0


def test_vectors(spark):
    import numpy as np

    rng = np.random.default_rng(8)
    base = rng.standard_normal((30, 24))
    x = [base[i % 30] + rng.standard_normal(24) * rng.choice([0.05, 0.4, 1.0]) for i in range(150)]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(200, x[0].tolist()), (200, x[0].tolist()), (None, x[1].tolist())]
    rows += [(300, None), (301, [0.0] * 24), (302, [float("nan")] * 24), (303, [None] + [1.0] * 23), (304, []), (305, [1.0, 2.0])]
    v = [(d, np.array(e) / np.linalg.norm(e)) for d, e in rows if d not in (300, 301, 302, 303, 304)]
    n = len(v)
    links = np.array([[len(a) == len(b) and i != j and a @ b >= 0.9 for j, (_, b) in enumerate(v)] for i, (_, a) in enumerate(v)])
    reach = links | np.eye(n, dtype=bool)
    for _ in range(8):
        reach = reach @ reach
    want = []
    for i, (d, _) in enumerate(v):
        ids = [v[j][0] for j in np.flatnonzero(reach[i]) if v[j][0] is not None]
        want.append((d, int(links[i].sum()), min(ids, default=None)))
    want += [(d, 0, d) for d in (300, 301, 302, 303, 304)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = crosspolytope.near_duplicates(df).collect()
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=repr) == sorted(want, key=repr)
    assert crosspolytope.near_duplicates(df.limit(0)).count() == 0


def test_snapshots(spark, monkeypatch):
    monkeypatch.setattr(snapshots, "PART", 2)
    say = lambda c, *t: [(c, k, "user" if k % 2 == 0 else "assistant", x) for k, x in enumerate(t)]
    rows = say(1, "a", "b") + say(2, "a", "b", "c") + say(3, "a", "b", "c", "d", "e") + say(4, "a", "x")
    rows += say(5, "a", "x") + say(None, "z", None) + say(6, "b") + [(6, 0, "user", "b")] + [(7, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {}
    for r in sorted(snapshots.render(df).collect(), key=lambda r: (repr(r["conv_id"]), r["part"])):
        got[r["conv_id"]] = got.get(r["conv_id"], "") + r["text"]
    assert set(got) == {3, 4, None, 6, 7} and got[3].count("<|im_end|>") == 5 and got[6].count("<|im_start|>user") == 1
    assert got[4] == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nx<|im_end|>\n"
    assert snapshots.render(df.limit(0)).count() == 0
