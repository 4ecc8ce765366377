import json

import pytest
from pyspark.sql import functions as F

from moodloom.checks.registry import stages
from moodloom.operators import recommend, state
from moodloom.sources import payloads, sinks


@pytest.fixture(scope="module")
def s(spark, sf):
    return stages(spark, sf)


@pytest.fixture(scope="module")
def recs(s):
    return recommend.recommend(s.tracks, s.clusters, s.source_tracks).persist()


def test_recommendations_have_the_required_columns(recs):
    assert {"track_id", "reccobeats_id", "title", "artists", "duration_ms", "popularity"} <= set(recs.columns)
    assert recs.filter("track_id IS NULL").count() == 0


def test_no_recommendation_twice_or_from_the_cluster(s, recs):
    keys = ["playlist_id", "cluster_id", "track_id"]
    assert recs.groupBy(*keys).count().filter("count > 1").count() == 0
    assert recs.join(s.tracks.select(*keys), keys, "left_semi").count() == 0


def test_five_seeds_to_one(s, recs):
    chosen = recommend.label_clusters(s.clusters)
    seeds = recommend.seeds(recommend.members(s.tracks, chosen))
    for r in recommend.counts(recs, seeds).collect():
        assert r.num_recommendations == -(-r.num_input_tracks // 5)


@pytest.mark.parametrize("size,k", [(1, 1), (2, 2), (1, 40)])
def test_greedy_matching_whatever_the_lists(spark, size, k):
    """Chunks that compete for the same few tracks, against a plain greedy loop."""
    import numpy as np
    from moodloom.operators.knn import Index

    rng = np.random.default_rng(size)
    cat = np.round(rng.normal(size=(60, 2)), 2)
    asks = np.round(rng.normal(size=(25, 2)) * 0.2, 2)
    cluster = rng.integers(0, 2, 25)
    inside = {(0, 3), (0, 4), (1, 5)}
    catalog = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(cat)], "track_id bigint, vec array<double>")
    asked = spark.createDataFrame(
        [("p", int(c), i, v.tolist()) for i, (c, v) in enumerate(zip(cluster, asks))],
        "playlist_id string, cluster_id int, chunk bigint, vec array<double>",
    )
    members = spark.createDataFrame([("p", c, t) for c, t in inside], "playlist_id string, cluster_id int, track_id bigint")
    got = recommend.serve(asked, members, Index(catalog, fine=8), size, k).collect()
    pairs = sorted(
        (round(float(np.sqrt(((asks[i] - cat[t]) ** 2).sum())), 9), i, t)
        for i in range(25) for t in range(60) if (int(cluster[i]), t) not in inside
    )
    room, taken, want = [size] * 25, set(), set()
    for _, i, t in pairs:
        if room[i] and (cluster[i], t) not in taken:
            room[i] -= 1
            taken.add((cluster[i], t))
            want.add((i, t))
    assert {(r.chunk, r.track_id) for r in got} == want and len(got) == len(want)


def test_small_catalog_runs_out(spark):
    from moodloom.operators.knn import Index

    catalog = spark.createDataFrame([(i, [float(i)]) for i in range(3)], "track_id bigint, vec array<double>")
    asked = spark.createDataFrame([("p", 0, i, [0.0]) for i in range(9)], "playlist_id string, cluster_id int, chunk bigint, vec array<double>")
    members = spark.createDataFrame([("p", 0, 1)], "playlist_id string, cluster_id int, track_id bigint")
    got = recommend.serve(asked, members, Index(catalog), k=1).collect()
    assert {(r.chunk, r.track_id) for r in got} == {(0, 0), (1, 2)}


def test_seeds_are_no_anomalies(s):
    chosen = recommend.label_clusters(s.clusters)
    seeds = recommend.seeds(recommend.members(s.tracks, chosen))
    odd = s.tracks.filter("is_anomaly").select("playlist_id", "track_id")
    assert seeds.join(odd, ["playlist_id", "track_id"], "left_semi").count() == 0


def test_full_blend_asks_every_chunk_for_the_same(s):
    chosen = recommend.label_clusters(s.clusters)
    inside = recommend.members(s.tracks, chosen)
    asked = recommend.chunks(recommend.seeds(inside))
    found = recommend.candidates(asked, inside, recommend.catalog_vectors(s.source_tracks), 3, blend=1.0)
    per = found.filter("rn = 1").groupBy("playlist_id", "cluster_id").agg(F.countDistinct("track_id").alias("n"))
    assert {r.n for r in per.collect()} == {1}


def test_empty_input_gives_empty_output(s):
    none = s.tracks.filter("false")
    assert recommend.recommend(none, s.clusters, s.source_tracks).count() == 0
    assert recommend.recommend(s.tracks, s.clusters, s.source_tracks.filter("false")).count() == 0


def test_write_batches(spark):
    rows = spark.range(250).select(F.lit("p").alias("playlist_id"), F.col("id").alias("track_id"), F.col("id").alias("pos"))
    got = recommend.write_batches(rows, ["playlist_id"], [F.asc("pos")]).orderBy("batch").collect()
    assert [len(r.uris) for r in got] == [100, 100, 50]
    assert got[2].uris[0] == "spotify:track:200"


def test_pages_hold_everything_in_order(spark):
    rows = spark.range(2500).select(F.lit("p").alias("k"), (2499 - F.col("id")).alias("v"))
    got = sinks.paged(rows, ["k"], [F.asc("v")], F.col("v"), "l").orderBy("page").collect()
    assert [len(r.l) for r in got] == [1000, 1000, 500]
    assert [v for r in got for v in r.l] == list(range(2500))


def test_export_is_json(s, tmp_path):
    path = str(tmp_path / "out")
    sinks.write_json(sinks.analysis_export(s), path)
    lines = [json.loads(x) for f in (tmp_path / "out").glob("kind=*/part-*") for x in f.read_text().splitlines()]
    heads = [x for x in lines if "summary" in x]
    assert {f.name for f in (tmp_path / "out").glob("kind=*")} >= {"kind=head", "kind=cluster", "kind=mood"}
    assert len(heads) == 10 and all(h["clusters"] for h in heads)


def test_read_nested_playlists(spark, tmp_path):
    doc = [
        {"spotify_id": "p1", "name": "One", "tracks": [{"spotify_id": "t1", "title": "A"}, {"spotify_id": "t2", "tags": [{"name": "x", "count": 3}]}]},
        {"spotify_id": "p2", "name": "Two", "total_tracks": 9},
    ]
    (tmp_path / "lists.json").write_text(json.dumps(doc))
    got = {r.spotify_id: r for r in payloads.read_playlists(spark, str(tmp_path), multi_line=True).collect()}
    assert got["p1"].total_tracks == 2 and got["p2"].total_tracks == 9 and got["p2"].tracks == []
    assert got["p1"].tracks[0].artists == [] and got["p1"].tracks[1].tags[0]["name"] == "x"


def test_feature_payload_missing_and_null(spark):
    p = spark.createDataFrame([('{"energy": null, "tempo": 120}',)], "payload string")
    f = payloads.normalise_features(F.col("payload"))
    r = p.select(*[c.alias(n) for n, c in f.items()]).first()
    assert r.energy is None and r.tempo == 120.0 and r.valence == 0.0


def test_tag_payload_shapes(spark):
    rows = [
        ('{"toptags": {"tag": [{"name": "a", "count": 7}, {"name": ""}, {"count": 1}]}}',),
        ('{"toptags": {"tag": {"name": "b"}}}',),
        ("{}",),
    ]
    got = spark.createDataFrame(rows, "p string").select(payloads.normalise_tags(F.col("p")).alias("t")).collect()
    assert [[(t["name"], t["count"]) for t in r.t] for r in got] == [[("a", 7)], [("b", 0)], []]


def test_snapshot_rules(spark):
    wanted = spark.createDataFrame([("u", p) for p in "abcdx"], "user_id string, playlist_id string")
    current = spark.createDataFrame([("u", p, "s1") for p in "abc"] + [("u", "d", "")], "user_id string, playlist_id string, snapshot_id string")
    cached = spark.createDataFrame(
        [("u", "a", "s1", True), ("u", "b", "s0", True), ("u", "c", "s1", False), ("u", "d", "", True)],
        "user_id string, playlist_id string, cached_snapshot string, resolves boolean",
    )
    got = {r.playlist_id: r.status for r in state.changed_playlists(wanted, current, cached).collect()}
    assert got == {"a": "hit", "b": "fetch", "c": "fetch", "d": "fetch"}


def test_resolve_keeps_positions(spark):
    rec = spark.createDataFrame([("u", "p", ["a", "zz", "b"])], "user_id string, playlist_id string, track_ids array<string>")
    known = spark.createDataFrame([("a", 1), ("b", 2)], "track_id string, v int")
    got = state.resolve(rec, known).orderBy("pos").collect()
    assert [(r.pos, r.track_id) for r in got] == [(0, "a"), (2, "b")]


def test_insert_only_never_updates(spark):
    old = spark.createDataFrame([("a", "old")], "track_id string, v string")
    new = spark.createDataFrame([("a", 1, "new"), ("b", 2, "y"), ("b", 1, "x")], "track_id string, pos int, v string")
    assert sorted(map(tuple, state.insert_only(old, new, ["pos"]).collect())) == [("a", "old"), ("b", "x")]


@pytest.mark.parametrize("most", [100_000, 5])
def test_clusters_are_matched_where_their_candidates_meet(spark, most):
    """The same pairs as by rounds, with one exchange for clusters of usual size."""
    import numpy as np

    rng = np.random.default_rng(3)
    rows = [(f"p{i % 4}", i % 3, int(c), int(t), float(np.round(rng.random(), 1))) for i in range(12) for c in range(4) for t in rng.choice(9, 4, replace=False)]
    found = spark.createDataFrame(rows, "playlist_id string, cluster_id int, chunk bigint, track_id bigint, distance double")
    for size in (1, 2):
        got = recommend.match_together(found, size, most)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, recommend.match(found, size).collect()))
    if most > 5:
        assert recommend.match_together(found)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_chunk_vectors_are_made_where_the_entries_lie(s):
    """The asked vectors of the analysis equal those of the plain steps, and no entry of a usual playlist moves."""
    chosen = recommend.label_clusters(s.clusters)
    inside = recommend.members(s.tracks, chosen)
    plain = recommend.asked_vectors(recommend.chunks(recommend.seeds(inside)), inside, recommend.catalog_vectors(s.source_tracks))
    rows = lambda df: {(r.playlist_id, r.cluster_id, r.chunk): [round(x, 9) for x in r.vec] for r in df.collect()}
    assert rows(s.asked) == rows(plain)
    assert recommend.chunk_vectors_in_place(s.seeded, s.entries, s.source_tracks.union(s.source_tracks), s.hot) is None


def test_equal_points_are_searched_once(spark):
    """Anomalies that name one track, and moods of many playlists, share a search."""
    from moodloom.operators.knn import Index

    catalog = spark.createDataFrame([(i, [float(i)]) for i in range(40)], "track_id bigint, vec array<double>")
    rows = spark.createDataFrame([(f"p{p}", 20 + p % 2, True) for p in range(30)], "playlist_id string, track_id bigint, is_anomaly boolean")
    lib = spark.createDataFrame([(f"p{p}", t) for p in range(30) for t in ([20, 21] if p else range(10, 31))], "playlist_id string, track_id bigint")
    index = Index(catalog)
    asked, search = [], index.search
    index.search = lambda q, n: asked.append(q.count()) or search(q, n)
    got = {}
    for r in recommend.lean_in(rows, lib, catalog, 2, index).orderBy("playlist_id", "rn").collect():
        got.setdefault(r.playlist_id, []).append(r.track_id)
    assert asked[0] == 2
    assert got == {"p0": [9, 31]} | {f"p{p}": [22, 19] if p % 2 else [19, 18] for p in range(1, 30)}
