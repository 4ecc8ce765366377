import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from small import audio, items, tracks

from moodloom.functions.columns import delta_text, fixed, mood_label, number, playlist_ref, tag_weight, tokens
from moodloom.operators import features


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "count, weight", [(0, 1), (10, 1), (30, 2), (50, 2), (70, 4), (90, 4), (100, 5), (150, 5), (-40, 1)]
)
def test_tag_weight_rounds_half_to_even(spark, count, weight):
    assert one(spark, tag_weight(F.lit(count))) == weight


def test_tokens_keep_inner_punctuation(spark):
    text = "hip hop r&b '90s --  (lo-fi) été_ !x! A"
    assert one(spark, tokens(F.lit(text))) == ["hip", "hop", "r&b", "90s", "lo-fi", "été_", "x", "a"]
    assert one(spark, tokens(F.lit(" -- "))) == []


@pytest.mark.parametrize("x, digits", [(0.125, 2), (2.675, 2), (59.5, 0), (12.25, 1), (1234.5678, 2), (0.0, 2)])
def test_fixed_equals_python_format(spark, x, digits):
    assert one(spark, fixed(F.lit(x), digits)) == f"{x:.{digits}f}"


def test_delta_text(spark):
    d = F.struct(F.lit("tempo").alias("feature"), F.lit(-12.4).alias("delta"))
    assert one(spark, delta_text(d)) == "lower tempo by 12 BPM"


def test_number(spark):
    assert one(spark, number(F.lit("abc"))) is None
    assert one(spark, number(F.lit(float("nan")))) is None
    assert one(spark, number(F.lit("1.5"))) == 1.5


@pytest.mark.parametrize(
    "e, v, t, label",
    [
        (0.67, 0.6, 130, "high_energy_happy_fast"),
        (0.33, 0.4, 90, "low_energy_sad_slow"),
        (0.5, 0.5, 100, "medium_energy_neutral"),
        (None, None, None, "medium_energy_neutral"),
    ],
)
def test_mood_label(spark, e, v, t, label):
    cols = [F.lit(x).cast("double") for x in (e, v, t)]
    assert one(spark, mood_label(*cols)) == label


@pytest.mark.parametrize(
    "link, ref",
    [
        ("spotify:playlist:abc", "abc"),
        (" https://open.spotify.com/playlist/xyz?si=1 ", "xyz"),
        ("https://open.spotify.com/album/xyz", None),
        ("https://example.com/playlist/xyz", None),
        ("open.spotify.com/playlist/xyz", None),
    ],
)
def test_playlist_ref(spark, link, ref):
    assert one(spark, playlist_ref(F.lit(link))) == ref


def corpus(spark):
    t = tracks(
        spark,
        [
            ("a", audio(energy=0.1), [("Hip Hop", 100), ("jazz", 10)]),
            ("b", audio(energy=0.9), [("hip hop", 30)]),
            ("c", None, [(" ", 50)]),
            ("d", None, []),
            ("e", audio(energy=None), []),
        ],
    )
    return features.library(items(spark, {"p": ["a", "b", "c", "d", "e"]}), t)


def test_eligibility(spark):
    got = {r.track_id: r.eligible for r in corpus(spark).collect()}
    assert got == {"a": True, "b": True, "c": True, "d": False, "e": True}


def test_tfidf_counts_untagged_tracks(spark):
    lib = corpus(spark)
    model = features.fit(lib)
    m = model.first()
    assert m.n == 4
    idf = {v.term: v.idf for v in m.vocab}
    assert idf["hip"] == pytest.approx(math.log(5 / 3) + 1)
    assert idf["jazz"] == pytest.approx(math.log(5 / 2) + 1)
    rows = {r.track_id: r for r in features.transform(lib, model).collect()}
    raw = np.array([5 * idf["hip"], 5 * idf["hop"], 1 * idf["jazz"]])
    assert rows["a"].tag_vec == pytest.approx(list(raw / np.linalg.norm(raw)))
    assert rows["c"].tag_vec == [0.0, 0.0, 0.0]
    for r in rows.values():
        length = np.linalg.norm(r.vec)
        assert length == pytest.approx(1.0) or length == 0.0
    # A null feature is 0 after scaling; constant features are 0 everywhere.
    assert rows["e"].audio[2] == 0.0 and rows["a"].audio[0] == 0.0
    assert rows["a"].audio[2] == pytest.approx(-1.0) and rows["b"].audio[2] == pytest.approx(1.0)


def test_blank_corpus_has_no_tag_columns(spark):
    t = tracks(spark, [("a", audio(energy=0.1), [(" ", 3)]), ("b", audio(energy=0.2), [])])
    lib = features.library(items(spark, {"p": ["a", "b"]}), t)
    assert features.fit(lib).first().vocab == []
    assert {len(r.vec) for r in features.transform(lib, features.fit(lib)).collect()} == {9}


def test_vocabulary_cap(spark):
    t = tracks(spark, [("a", None, [("w%02d" % i, 100) for i in range(12)] + [("zz", 100), ("zz", 100)])])
    lib = features.library(items(spark, {"p": ["a"]}), t)
    kept = features.fit(lib, max_features=3).first().vocab
    assert [v.term for v in kept] == ["w00", "w01", "zz"]


def test_robust_scale(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=41)
    t = tracks(spark, [(f"t{i:02d}", audio(energy=float(v)), []) for i, v in enumerate(x)] + [("n", None, [])])
    lib = features.library(items(spark, {"p": [f"t{i:02d}" for i in range(41)] + ["n"]}), t)
    got = {r.track_id: r for r in features.robust_scale(lib).collect()}
    q1, q2, q3 = np.quantile(x, [0.25, 0.5, 0.75])
    assert len(got) == 41
    for i, v in enumerate(x):
        assert got[f"t{i:02d}"].energy == pytest.approx((v - q2) / (q3 - q1))
        assert got[f"t{i:02d}"].tempo == 0.0


@pytest.mark.parametrize("small,bins", [(4096, 256), (10, 4), (1, 2)])
def test_quartiles_by_bins(spark, monkeypatch, small, bins):
    """Groups of every shape, cut into bins until they are small, against NumPy."""
    monkeypatch.setattr(features, "SMALL", small)
    monkeypatch.setattr(features, "BINS", bins)
    rng = np.random.default_rng(small)
    data = {
        "normal": rng.normal(size=333),
        "skewed": np.exp(rng.normal(size=200) * 8),
        "ties": rng.integers(0, 3, 150).astype(float),
        "constant": np.full(60, 4.25),
        "one": np.array([7.0]),
        "two": np.array([1.0, 2.0]),
        "far": np.array([-1e308, 1e308, 0.0, 1.0, 2.0]),
        "mostly": np.r_[np.zeros(100), rng.normal(size=20)],
    }
    rows = [(g, float(x)) for g, xs in data.items() for x in xs]
    got = features.quartiles(spark.createDataFrame(rows, "g string, x double").repartition(4), ["g"]).collect()
    assert len(got) == len(data)
    for r in got:
        x = np.sort(data[r.g])
        for value, q in zip(r[1:], (0.25, 0.5, 0.75)):
            spot = (len(x) - 1) * q
            low = int(spot)
            want = x[low] * (1 - (spot - low)) + (x[min(low + 1, len(x) - 1)] * (spot - low) if spot > low else 0.0)
            assert value == pytest.approx(want, rel=1e-12, abs=1e-300)
