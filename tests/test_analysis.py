import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import Row
from small import audio, items, names, tracks

from moodloom.operators import analysis, compare, reports
from moodloom.operators.grouping import keep_first, rank_in_group
from moodloom.plans.pipeline import analyze


def scored(spark, values, playlist="p"):
    rows = [(playlist, f"t{i:03d}", i, float(v), len(values)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "playlist_id string, track_id string, pos int, anomaly_score double, n bigint")


@pytest.mark.parametrize("n, flags", [(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (7, 2), (20, 3), (21, 4)])
def test_number_of_flags(spark, n, flags):
    got = analysis.flag_fraction(scored(spark, np.linspace(0, 1, n)))
    assert got.filter("flagged").count() == flags


def test_flag_ties_go_to_the_first_position(spark):
    got = analysis.flag_fraction(scored(spark, [0.0] * 10))
    assert sorted(r.track_id for r in got.filter("flagged").collect()) == ["t000", "t001"]


def test_rank_of_a_group_that_spans_tasks(spark):
    rows = spark.range(20000).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 50)).alias("g"),
        (F.col("id") * 7919 % 20011).alias("v"),
    )
    got = rank_in_group(rows, ["g"], [F.desc("v")]).toPandas()
    want = got.groupby("g")["v"].rank(ascending=False, method="first").astype(int)
    assert (got["rn"] == want).all()


def test_keep_first(spark):
    rows = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 5, "z")], "k string, pos int, v string")
    assert sorted(map(tuple, keep_first(rows, ["k"], ["pos"]).collect())) == [("a", 1, "y"), ("b", 5, "z")]


def test_percentile_rank_with_ties(spark):
    got = analysis.percentile_rank(scored(spark, [0.1, 0.5, 0.5, 0.9])).collect()
    assert {r.track_id: r.percentile_rank for r in got} == pytest.approx(
        {"t000": 0.0, "t001": 1 / 3, "t002": 1 / 3, "t003": 1.0}
    )


def planted(mapping):
    def assign(lib):
        pairs = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
        return lib.filter("eligible").select("playlist_id", "track_id", pairs[F.col("track_id")].alias("cluster_id"))

    return assign


def sample(spark):
    """Two clusters with one label, one cluster without audio that holds the
    top score, one track without anything, one empty playlist."""
    rows = [(f"h{i}", audio(energy=0.8 + i / 100, valence=0.7, tempo=100.0 + i), [("pop", 50)]) for i in range(4)]
    rows += [(f"k{i}", audio(energy=0.9 + i / 100, valence=0.8, tempo=120.0 + i), [("rock", 50)]) for i in range(3)]
    rows += [("x1", None, [("odd", 100)]), ("x2", None, [("strange", 100)]), ("gone", None, [])]
    mapping = {r[0]: {"h": 0, "k": 1, "x": 2}[r[0][0]] for r in rows if r[0] != "gone"}
    return analyze(
        names(spark, ["p", "empty"]), items(spark, {"p": [r[0] for r in rows]}), tracks(spark, rows), assign=planted(mapping)
    )


@pytest.fixture(scope="module")
def done(spark):
    return sample(spark)


def test_summary_counts_and_empty_playlist(done):
    got = {r.playlist_id: r for r in done.summary.collect()}
    p, e = got["p"], got["empty"]
    assert (p.num_tracks, p.num_eligible, p.num_excluded_missing_all) == (10, 9, 1)
    assert (p.num_clusters, p.num_excluded_insufficient_audio_cluster) == (2, 2)
    # Members of the dropped cluster use up the flags: ceil(.15 * 9) = 2.
    assert p.num_anomalies <= 2 and p.anomaly_score_cutoff is not None
    assert (e.num_tracks, e.num_clusters, e.anomaly_score_cutoff) == (0, 0, None)


def test_dropped_and_excluded_rows(done):
    got = {r.track_id: r for r in done.tracks.collect()}
    assert got["x1"].cluster_id is None and got["x1"].anomaly_score is None and not got["x1"].is_anomaly
    assert got["x1"].reason == analysis.NO_AUDIO_CLUSTER and got["gone"].reason == analysis.NO_DATA
    assert len(got) == 10


def test_clusters_with_one_label_share_a_mood(done):
    mood = done.moods.collect()
    assert [(m.mood_label, m.cluster_ids, m.num_tracks) for m in mood] == [("high_energy_happy", [0, 1], 7)]
    assert [r.proportion for r in done.distribution.collect()] == [1.0]
    # Keyed by label the last cluster wins.
    assert [(r.label, r.cluster_id) for r in reports.by_label(done.clusters).collect()] == [("high_energy_happy", 1)]


def test_reason_parses_back(done):
    facts = reports.parse_reasons(done.tracks).collect()
    strict = reports.parse_reasons(done.tracks, strict=True).collect()
    assert {f.feature for f in strict} <= {"tempo", "loudness", None}
    assert len(facts) >= len(strict)
    for f in facts:
        assert f.mood == "high_energy_happy"
    for f in (f for f in facts if f.feature):
        assert f.direction in ("higher", "lower")


def test_score_range(done):
    s = done.scored.agg(F.min("anomaly_score"), F.max("anomaly_score")).first()
    assert s[0] >= 0 and s[1] == 1.0


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(0, 1), min_size=1, max_size=40))
def test_flag_formula(spark, values):
    n = len(values)
    want = max(1, math.ceil(0.15 * n)) if n >= 5 else min(1, math.ceil(0.15 * n))
    got = analysis.flag_fraction(scored(spark, values)).filter("flagged").collect()
    assert len(got) == want
    assert sorted((r.anomaly_score for r in got), reverse=True) == sorted(
        (round(v, 300) for v in values), reverse=True
    )[:want]


def distribution(spark, rows):
    return spark.createDataFrame(rows, "playlist_id string, mood_label string, size int, proportion double, rank int")


def test_compare(spark):
    dist = distribution(
        spark, [("a", "m1", 3, 0.6, 1), ("a", "m2", 2, 0.4, 2), ("b", "m1", 1, 1.0, 1), ("c", "m9", 1, 1.0, 1)]
    )
    req = spark.createDataFrame([Row(request_id=1, playlist_ids=["a", "b", "c"]), Row(request_id=2, playlist_ids=["a"])])
    got = {(r.playlist_id_a, r.playlist_id_b): r for r in compare.compare(dist, req).collect()}
    assert set(got) == {("a", "b"), ("a", "c"), ("b", "c")}
    assert got["a", "b"].mood_label == "m1" and got["a", "b"].similarity == pytest.approx(0.6)
    assert got["a", "c"].mood_label is None
    assert [r.request_id for r in compare.rejected(req).collect()] == [2]
    with pytest.raises(ValueError):
        compare.top_moods(dist, 0)


def test_top_n_limits_shared_moods(spark):
    dist = distribution(spark, [("a", "m1", 3, 0.6, 1), ("a", "m2", 2, 0.4, 2), ("b", "m2", 1, 1.0, 1)])
    req = spark.createDataFrame([Row(request_id=1, playlist_ids=["a", "b"])])
    assert [r.mood_label for r in compare.compare(dist, req, 1).collect()] == [None]
    assert [r.mood_label for r in compare.compare(dist, req, 2).collect()] == ["m2"]


def test_mean_similarity_equals_all_pairs(spark):
    rng = np.random.default_rng(3)
    x = rng.random((6, 4))
    x /= np.linalg.norm(x, axis=1)[:, None]
    prints = spark.createDataFrame(
        [(f"p{i}", f"d{j}", float(x[i, j])) for i in range(6) for j in range(4)], "playlist_id string, dim string, x double"
    )
    cos = x @ x.T
    want = {f"p{i}": (cos[i].sum() - 1) / 5 for i in range(6)}
    assert {r.playlist_id: r.mean_cosine for r in compare.mean_similarity(prints).collect()} == pytest.approx(want)


def test_no_mood_selects_nothing(done):
    assert analysis.select_by_mood(done.tracks, done.playlists, "").count() == 0
    assert analysis.select_by_mood(done.tracks, done.playlists, "high_energy_happy").count() == 7


def test_playlists_at_the_edges(spark):
    """One track, two tracks without tags, tags only, nothing at all."""
    rows = [
        ("a", audio(energy=0.2), [("jazz", 40)]),
        ("b", audio(energy=0.9, tempo=150.0), []),
        ("c", audio(energy=0.1, tempo=70.0), []),
        *[(f"t{i}", None, [(f"w{i % 2}", 60)]) for i in range(6)],
        ("n", None, []),
    ]
    lists = {"one": ["a"], "two": ["b", "c"], "tags": [f"t{i}" for i in range(6)], "none": ["n"]}
    a = analyze(names(spark, lists), items(spark, lists), tracks(spark, rows))
    got = {r.playlist_id: r for r in a.summary.collect()}
    assert (got["one"].num_clusters, got["one"].num_anomalies, got["one"].anomaly_score_cutoff) == (1, 1, 0.0)
    assert (got["two"].num_clusters, got["two"].num_anomalies) == (2, 1)
    assert (got["tags"].num_clusters, got["tags"].num_anomalies) == (0, 0)
    assert got["tags"].num_excluded_insufficient_audio_cluster == 6
    assert (got["none"].num_eligible, got["none"].num_excluded_missing_all) == (0, 1)
    assert a.top_tags.filter("playlist_id = 'two'").count() == 0
    digest = reports.digest(a.clusters, a.tracks, a.top_tags, a.summary)
    assert {r.playlist_id for r in digest.collect()} == {"one", "two"}


def test_hot_playlist_spans_tasks(spark):
    """One playlist with most of the rows: its ranked rows lie in many tasks."""
    rows = spark.range(30000).select(
        F.when(F.col("id") % 10 > 0, "hot").otherwise("cold").alias("playlist_id"),
        F.col("id").alias("track_id"),
        F.col("id").alias("pos"),
        (F.col("id") % 997 / 997).alias("anomaly_score"),
    )
    n = rows.groupBy("playlist_id").agg(F.count(F.lit(1)).alias("n"))
    got = analysis.flag_fraction(rows.join(n, "playlist_id"))
    flags = {r.playlist_id: r.f for r in got.groupBy("playlist_id").agg(F.count_if("flagged").alias("f")).collect()}
    assert flags == {"hot": 4050, "cold": 450}
    spread = rows.repartitionByRange(8, "playlist_id", "anomaly_score", "track_id")
    tasks = spread.filter("playlist_id = 'hot'").select(F.spark_partition_id().alias("t")).distinct().count()
    assert tasks >= 6


def test_refresh_replaces_whole_playlists(spark):
    from moodloom.plans.pipeline import refresh

    old = spark.createDataFrame([("p", "a", 1), ("p", "b", 1), ("q", "c", 1)], "playlist_id string, track_id string, v int")
    new = spark.createDataFrame([("p", "a", 2)], "playlist_id string, track_id string, v int")
    assert sorted(map(tuple, refresh(old, new).collect())) == [("p", "a", 2), ("q", "c", 1)]


def test_pairs_of_a_request_keep_its_order(spark):
    asked = spark.createDataFrame([(1, [7, 3, 7]), (2, [5]), (3, []), (4, None)], "request_id int, playlist_ids array<int>")
    got = sorted(tuple(r) for r in compare.pairs(asked).collect())
    assert got == [(1, 3, 7), (1, 7, 3), (1, 7, 7)]


def test_shared_moods_of_requests_in_zones(spark, monkeypatch):
    """Pairs meet the moods of their playlists without a join; unknown playlists keep a row without a mood."""
    monkeypatch.setattr(compare, "STEP", 3)
    shares = {"a": {"x": 0.5, "y": 0.5}, "b": {"x": 0.25, "z": 0.75}, "c": {"z": 1.0}, "d": {}}
    rows = [(p, m, v, i) for p, have in shares.items() for i, (m, v) in enumerate(have.items(), 1)]
    dist = spark.createDataFrame(rows, "playlist_id string, mood_label string, proportion double, rank int")
    lists = [(i, list("abcd")) for i in range(9)] + [(9, ["a"]), (10, ["a", "b", "a"]), (11, []), (None, ["a", "b"])]
    asked = spark.createDataFrame(lists, "request_id long, playlist_ids array<string>")
    want = []
    for r, ids in lists[:-1]:
        for i, p in enumerate(ids):
            for q in ids[i + 1 :]:
                both = [m for m in shares[p] if m in shares[q]]
                want += [(r, p, q, m, shares[p][m], shares[q][m], 1 - abs(shares[p][m] - shares[q][m])) for m in both] or [(r, p, q, None, None, None, None)]
    found = compare.compare(dist, asked)
    cols = ["request_id", "playlist_id_a", "playlist_id_b", "mood_label", "proportion_a", "proportion_b", "similarity"]
    assert sorted(map(repr, map(tuple, found.select(cols).collect()))) == sorted(map(repr, want))
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
