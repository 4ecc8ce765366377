"""Operators' inner parts against brute force, without Spark."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from moodloom.llm import chunks, crosspolytope, hyperminhash, langid, mixing, records, repetition, suffixes, viterbi


def words(rng, n, vocabulary):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


@pytest.mark.parametrize("seed", range(30))
def test_two_stage_suffix_sort(seed):
    rng = random.Random(seed)
    length = rng.choice([8, 16, 24, 40])
    alphabet = rng.choice([b"a", b"ab", b"abc", bytes(range(254))])
    base = bytes(rng.choice(alphabet) for _ in range(300))
    contexts, starts, weights = [], [], []
    for _ in range(rng.randint(1, 12)):
        m = rng.randint(1, 30)
        a = rng.randint(0, 300 - m - length)
        c = bytearray(base[a : a + m + length - 1])
        for _ in range(rng.randint(0, 2)):
            c[rng.randrange(len(c))] = rng.choice(alphabet)
        contexts.append(bytes(c))
        starts.append(m)
        weights.append(rng.choice([1, 1, 3]))
    seen = {}
    for c, m, w in zip(contexts, starts, weights):
        for s in range(m):
            seen[c[s : s + length]] = seen.get(c[s : s + length], 0) + w
    want = [[seen[c[s : s + length]] > 1 for s in range(m)] for c, m in zip(contexts, starts)]
    got = suffixes.repeated_starts(contexts, np.array(starts), np.array(weights), length)
    assert [g.tolist() for g in got] == want


def test_stretches_hold_every_start_once():
    data = np.frombuffer(b"abcab" * 300 + b"x" * 500, np.uint8)
    offsets = np.array([0, 700, 750, len(data)])
    got = suffixes.stretches(data, offsets, 200, 32)
    starts = [(r, a + k) for r, a, m in zip(got["row"], got["at"], got["m"]) for k in range(m)]
    want = [(r, s) for r, n in enumerate(np.diff(offsets)) for s in range(n - 199)]
    assert sorted(starts) == want and len(set(starts)) == len(starts)


@pytest.mark.parametrize("seed", range(20))
def test_repetition_against_windows(seed):
    rng = random.Random(seed)
    texts = [words(rng, rng.randint(0, 60), ["a", "b", "c"][: rng.randint(1, 3)]) for _ in range(6)]
    got = repetition.measured(pa.array([t.encode() for t in texts], pa.binary()), 5).to_pylist()

    def covered(w, n):
        at = {}
        for i in range(len(w) - n + 1):
            at.setdefault(tuple(w[i : i + n]), []).append(i)
        return len({i + k for v in at.values() if len(v) > 1 for i in v for k in range(n)})

    for text, row in zip(texts, got):
        w = text.split()
        assert row["n_repeat_words"] == covered(w, 8) and row["n_covered"] == covered(w, 5)
        longest = max([n for n in range(len(w)) if n >= 5 and covered(w, n)], default=0)
        assert row["longest"] == longest
        # Maximal repeats: strings that occur twice and lose an occurrence when extended.
        subs = {}
        for n in range(5, len(w)):
            for i in range(len(w) - n + 1):
                subs.setdefault(tuple(w[i : i + n]), []).append(i)
        maximal = 0
        for s, at in subs.items():
            if len(at) > 1:
                left = {w[i - 1] if i else None for i in at}
                right = {w[i + len(s)] if i + len(s) < len(w) else (None, i) for i in at}
                maximal += len(left) > 1 and len(right) > 1
        assert row["n_repeats"] == maximal


def test_registers_and_estimate():
    rng = np.random.default_rng(1)
    off = []
    for _ in range(60):
        pool = np.unique(rng.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2))
        a, b = pool[:2500], pool[500:]
        true = 2000 / len(pool)
        n = np.array([len(a)]), np.array([len(b)])
        got, _ = hyperminhash.estimate(hyperminhash.sketch(a)[None], hyperminhash.sketch(b)[None], *n)
        off.append(got[0] - true)
    assert abs(np.mean(off)) < 0.02 and np.std(off) < 0.08


def test_common_counts():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 9000, n).astype(np.uint64)) for n in (1, 50, 6000, 6000, 300)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    got = hyperminhash.common(sets)
    assert all(got[i, j] == want[i][j] for i in range(5) for j in range(5) if i != j)


def test_hadamard_keeps_length_and_buckets_recall():
    x = np.random.default_rng(3).standard_normal((5, 64))
    assert np.allclose(np.linalg.norm(crosspolytope.hadamard(x), axis=1), np.linalg.norm(x, axis=1))
    k, tables = crosspolytope.plan(50_000, 64, 0.9)
    assert k >= 2 and (1 - crosspolytope.shared_chance(64, k, 0.9)) ** tables < 1e-4


def test_flow_prefers_fresh_words():
    got = mixing.flow({("a",): 100, ("a", "b"): 50}, {"a": 120, "b": 40})
    assert got[("a", "b")]["b"] == 40 and got[("a",)]["a"] + got[("a", "b")]["a"] == 120
    # 160 words wanted, 150 fresh ones there: ten are repeated, no more.
    assert max(got[("a",)]["a"] - 100, 0) + max(sum(got[("a", "b")].values()) - 50, 0) == 10


def test_targets_share_and_caps():
    t = mixing.targets({"a": 10, "b": 1000, None: 500})
    assert t["a"] == 20 and abs(sum(t.values()) - 1.5 * 1510) < 1e-9 and t[None] <= 1000
    assert mixing.targets({}) == {}


def test_svm_separates():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((200, 5))
    y = np.where(x[:, 0] + 0.5 * x[:, 1] > 0, 1.0, -1.0)
    w = langid.fit_svm(x, y)
    assert (np.sign(x @ w[:-1] + w[-1]) == y).mean() > 0.95


def plain_viterbi(pieces, text):
    """Best path of a whole text with marks, character by character."""
    best, back = [0.0] + [-np.inf] * len(text), [None] * (len(text) + 1)
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - pieces.longest), end):
            hit = pieces.score.get(text[start:end])
            if hit and best[start] + hit[0] > best[end]:
                best[end], back[end] = best[start] + hit[0], (start, [hit[1]])
        if text[end - 1] not in pieces.score and best[end - 1] + pieces.unknown_score > best[end]:
            best[end], back[end] = best[end - 1] + pieces.unknown_score, (end - 1, pieces.spelled(text[end - 1 : end]))
    out, end = [], len(text)
    while end:
        start, ids = back[end]
        out, end = ids + out, start
    return out


def test_viterbi_and_round_trip():
    pieces = viterbi.Pieces(viterbi.default_model())
    encoder = chunks.Encoder(pieces.encode, viterbi.ODD, viterbi.cut_words, " ")
    texts = ["The theory of therapy.", "a", " lead", "two  spaces\n\nand lines \n", "Éçeau ▁mark▁", "日本語 \U0001f600 x\x1fy", "the the"]
    for _, _, ids, counts in encoder(pa.array(texts)):
        data, sizes = pieces.decode(ids, counts)
        ends = np.cumsum(sizes)
        assert [data.tobytes()[e - s : e].decode() for e, s in zip(ends, sizes)] == texts
        for text, e, n in zip(texts, np.cumsum(counts), counts):
            if viterbi.MARK not in text:
                assert ids[e - n : e].tolist() == plain_viterbi(pieces, viterbi.MARK + text.replace(" ", viterbi.MARK))


def test_chunked_tokens_equal_library():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(records.default_tokenizer())
    rng = random.Random(5)
    parts = ["the", "The", "don't", "'s", "x1", "12.5", ",", ".", "é", "日本", " ", "  ", "\n", "\n\n", "\t", "\xa0", "a.b", "\U0001f600", "<|endoftext|>"]
    texts = ["".join(rng.choice(parts[: rng.choice([8, 11, len(parts)])]) + rng.choice(["", " ", "\n"]) for _ in range(30)) for _ in range(200)]
    texts += ["", " ", "word"]
    at = 0
    for _, _, ids, counts in records._encoder(records.default_tokenizer())(pa.array(texts)):
        for e, n in zip(np.cumsum(counts), counts):
            assert ids[e - n : e].tolist() == tokenizer.encode(texts[at], add_special_tokens=False).ids, repr(texts[at])
            at += 1
    assert at == len(texts)


def test_records_detect_damage():
    for doc_id, ids in ((7, [1, 2, 0]), (None, [0]), (-1, [70_000, 0])):
        record = records.frame(doc_id, np.array(ids))
        got_id, got = records.unframe(record)
        assert got_id == doc_id and got.tolist() == ids
        for k in (0, 9, 14, len(record) - 1):
            with pytest.raises(ValueError):
                records.unframe(record[:k] + bytes([record[k] ^ 1]) + record[k + 1 :])


def test_sentences_are_the_text():
    from moodloom.llm import spans

    for text in ("A b. C d!\n\nE", "no end", "...", "", " x. \n"):
        assert "".join(spans._SENTENCE.findall(text)) == text
    assert re.compile(spans.SENTENCE)


def test_language_features_of_a_text_in_parts(monkeypatch):
    texts = pa.array(["Straße und Weg " * 40, "", "x", "Ab c"], pa.string()).cast(pa.binary())
    whole, letters = langid.profiles(texts)
    monkeypatch.setattr(langid, "STEP", 7)
    parts, again = langid.profiles(texts)
    assert np.array_equal(whole, parts) and letters.tolist() == again.tolist() == [True, False, True, True]


def test_store_of_two_halves_gives_the_same_ids():
    """Chunks that age, come back or are new: always the ids of the encoder, and most are not encoded again."""
    import random

    import numpy as np
    from moodloom.llm import chunks

    asked = []

    def encode(words):
        asked.extend(words)
        return [[len(w), *map(ord, w)] for w in words]

    store = chunks.Encoder(encode, "x^", list, remembered=40)
    rng = random.Random(1)
    for _ in range(200):
        words = list(dict.fromkeys(rng.choice("abcdefgh") if rng.random() < 0.8 else str(rng.randint(0, 10**6)) for _ in range(12)))
        number = store.learn(words)
        got = [store.flat[store.starts[n] : store.starts[n] + store.sizes[n]].tolist() for n in number]
        assert got == [[len(w), *map(ord, w)] for w in words]
        assert len(store.known) <= 20 and len(store.older[0]) <= 20
    # A frequent chunk is encoded anew only if it was not met for a whole half.
    assert len([w for w in asked if w.isalpha()]) < 30
    assert np.issubdtype(store.flat.dtype, np.integer)


def test_a_longer_step_looks_a_chunk_up_less_often():
    """The same ids for any length of a step; one step asks for each distinct chunk once."""
    import pyarrow as pa
    from moodloom.llm import chunks

    texts = pa.array([f"one two one {i % 3}" for i in range(40)] + ["", "one"])
    seen = {}
    for size in (1, 64, 1 << 20):
        store = chunks.Encoder(lambda words: [[len(w), *map(ord, w)] for w in words], "x^", list, step_bytes=size)
        learn, looked = store.learn, []
        store.learn = lambda words: looked.extend(words) or learn(words)
        parts = [(ids.tolist(), counts.tolist()) for _, _, ids, counts in store(texts)]
        seen[size] = [i for ids, _ in parts for i in ids], [c for _, counts in parts for c in counts], len(looked)
    assert seen[1][:2] == seen[64][:2] == seen[1 << 20][:2]
    assert seen[1 << 20][2] < seen[64][2] < seen[1][2] and seen[1 << 20][2] == 7


def test_forgetting_words_after_each_task_changes_no_result(spark):
    docs = spark.createDataFrame([(i, "ab cd ab " * (i % 4)) for i in range(20)], "doc_id long, text string").repartition(5)
    kept = viterbi.encode(docs).select("doc_id", "pieces.*")
    lean = viterbi.encode(docs, remember=False).select("doc_id", "pieces.*")
    assert sorted(kept.collect()) == sorted(lean.collect())
