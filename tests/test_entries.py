"""The analysis on entries that lie together by playlist: same rows as from whole vectors,
and no step moves the entries again."""

import math

import pytest
from pyspark.sql import functions as F
from small import audio, items, names, tracks

from moodloom.operators import analysis, features
from moodloom.operators.grouping import rank_dealt, rank_in_group
from moodloom.plans.pipeline import analyze


def given(lib):
    return lib.filter("eligible").select(
        "playlist_id", "track_id", (F.abs(F.xxhash64("track_id")) % 3).cast("int").alias("cluster_id")
    )


@pytest.fixture(scope="module")
def done(spark):
    words = ["hip hop", "jazz", "slow jazz", "rock", ""]
    t = [
        (f"t{i:03d}", None if i % 7 == 3 else audio(energy=(i * 37 % 101) / 101, tempo=60.0 + i % 50), [] if i % 5 == 2 else [(words[i % 5], 20 * (i % 6))])
        for i in range(120)
    ]
    # One playlist has most rows, some have one or two.
    sets = {"large": [r[0] for r in t], **{f"p{i}": [f"t{(i * 7 + j) % 120:03d}" for j in range(1 + i % 4)] for i in range(9)}}
    return analyze(names(spark, [*sets, "empty"]), items(spark, sets), tracks(spark, t), assign=given)


def test_hot_playlist_is_dealt_out(done):
    assert [r.playlist_id for r in done.hot.collect()] == ["large"]
    salts = {r._salt for r in done.entries.filter("playlist_id = 'large'").collect()}
    assert len(salts) > 1 and min(salts) > 0
    assert {r._salt for r in done.entries.filter("playlist_id <> 'large'").collect()} == {0}


def test_distances_equal_those_of_whole_vectors(done):
    whole = done.vectors.join(done.assignment, ["playlist_id", "track_id"])
    want = {(r.playlist_id, r.track_id): r.distance for r in analysis.distances(whole).collect()}
    got = {(r.playlist_id, r.track_id): r.distance for r in done.distances.collect()}
    assert got.keys() == want.keys()
    for k, d in want.items():
        assert math.isclose(got[k], d, rel_tol=1e-9, abs_tol=1e-12)
        assert d != 0 or got[k] == 0
    tags = analysis.top_tags(whole, done.model).collect()
    assert {(r.playlist_id, r.cluster_id, r.rank, r.term, round(r.weight, 9)) for r in tags} == {
        (r.playlist_id, r.cluster_id, r.rank, r.term, round(r.weight, 9)) for r in done.top_tags.collect()
    }


def test_ranks_and_rows(done):
    order = [F.desc("anomaly_score"), F.asc("pos"), F.asc("track_id")]
    cut = done.scored.select("playlist_id", "_salt", "track_id", "pos", "anomaly_score")
    pick = lambda df: {(r.playlist_id, r.track_id, r.rn) for r in df.collect()}
    assert pick(rank_dealt(cut, order)) == pick(rank_in_group(cut, ["playlist_id"], order))
    plain = analysis.track_analysis(done.library, done.flagged.drop("_salt"), done.clusters)
    columns = [c for c in plain.columns if c != "deltas"]
    assert sorted(map(repr, plain.select(columns).collect())) == sorted(map(repr, done.tracks.select(columns).collect()))


def test_entries_stay_where_they_lie(spark, done):
    """Read from their buckets, the entries go through joins and ranks without an exchange."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = done.scored._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in plan
        distances = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
        assert not any("track_id" in line for line in distances)
        cells = features.sparse(done.assigned, done.model, done.hot)._jdf.queryExecution().executedPlan().toString()
        assert cells.count("Exchange hashpartitioning") == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rows_without_a_cluster(spark):
    """A null cluster has means and words of its own, its rows stay without a score."""
    t = [(f"t{i}", audio(energy=i / 9), [("jazz" if i % 2 else "rock", 60)]) for i in range(8)]
    given_some = lambda lib: given(lib).withColumn("cluster_id", F.when(F.col("track_id") < "t5", F.lit(1)))
    done = analyze(names(spark, ["p"]), items(spark, {"p": [r[0] for r in t]}), tracks(spark, t), assign=given_some)
    assert {r.cluster_id for r in done.top_tags.collect()} == {1, None}
    assert {r.track_id: r.assigned_cluster_id for r in done.tracks.collect()} == {f"t{i}": 1 if i < 5 else None for i in range(8)}
    assert done.distances.count() == 5


def test_pieces_grow_with_the_rows_and_the_session_stays(spark, monkeypatch):
    from moodloom import session

    names_ = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes")
    before = [spark.conf.get(n) for n in names_]
    monkeypatch.setattr(session, "PART_ROWS", 10)
    lists = {f"p{i}": list(range(40)) for i in range(5)}
    songs = tracks(spark, [(t, audio(energy=t / 40), [("a b", 5)]) for t in range(40)])
    a = analyze(names(spark, lists), items(spark, lists), songs, assign=lambda lib: lib.filter("eligible").select("playlist_id", "track_id", F.lit(0).alias("cluster_id")))
    assert a.tracks.count() == 200
    for table in (a.entries, a.assigned, a.distances, a.flagged, a.dealt_tracks):
        # A bucket's number stands in the names of its files.
        assert max(int(f.rsplit("_", 1)[1].split(".")[0]) for f in table.inputFiles()) >= 8
    assert [spark.conf.get(n) for n in names_] == before


def test_pages_are_cut_where_the_entries_lie(done):
    from moodloom.sources.sinks import paged

    keys, order = ["playlist_id", "cluster_id"], [F.asc("pos"), F.asc("track_id")]

    def pages(rows):
        return paged(rows.filter("cluster_id IS NOT NULL"), keys, order, F.col("track_id"), "l", 7)

    assert sorted(map(repr, pages(done.tracks).collect())) == sorted(map(repr, pages(done.dealt_tracks).collect()))
    usual = pages(done.dealt_tracks.filter("_salt = 0"))
    assert usual.count() > 0 and "Exchange" not in usual._jdf.queryExecution().executedPlan().toString()


def given_in_place(rows):
    return rows.filter("eligible").select(
        "_salt", "playlist_id", "track_id", (F.abs(F.xxhash64("track_id")) % 3).cast("int").alias("cluster_id")
    )


def test_assignment_of_entries_moves_nothing(spark):
    """Neither the assignment nor the means of usual playlists take an exchange of entries."""
    from moodloom import session

    lists = {f"p{i}": list(range(5 * i, 5 * i + 40)) for i in range(8)} | {"long": list(range(80))}
    songs = tracks(spark, [(t, audio(energy=t / 80), [(f"a{t % 7} b", 60)]) for t in range(80)])
    args = names(spark, lists), items(spark, lists), songs
    a, plain = analyze(*args, assign=given_in_place, reads=()), analyze(*args, assign=given)
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(a.assignment.select("playlist_id", "track_id", "cluster_id")) == rows(plain.assignment)
    assert rows(a.tracks) == rows(plain.tracks) and rows(a.flagged) == rows(plain.flagged)
    assert {r.playlist_id for r in a.hot.collect()} >= {"long"}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with session._joined_in_place(spark, True):
            usual = analysis.cluster_cells(a.cells, a.hot.limit(0))
            plan = usual._jdf.queryExecution().executedPlan().toString()
            rows_plan = analysis.track_analysis(a.entries, a.flagged, a.clusters, a.hot)._jdf.queryExecution().executedPlan().toString()
        # The model is all that moves, and no join sorts the entries.
        assert plan.count("Exchange hashpartitioning") == 1
        assert "SortMergeJoin" not in plan and "ShuffledHashJoin" in plan
        assert all("track_id" not in line for line in rows_plan.splitlines() if "SortMergeJoin" in line)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_words_travel_as_text(spark):
    rows = [("a", {"r&b": 7, "été": 1, "x\x00y": 12}), ("b", None), ("c", {}), ("d", {"n": None, "m": 2})]
    df = spark.createDataFrame(rows, "track_id string, tf map<string, bigint>")
    packed = features._packed(df)
    assert not any("map" in kind for _, kind in packed.dtypes)
    back = features._unpacked(packed)
    assert dict(back.dtypes)["tf"] == "map<string,bigint>" and {r.track_id: r.tf for r in back.collect()} == dict(rows)
    ordered = spark.sql("SELECT map('b', 1L, 'c', 2L, 'a', 3L) AS tf")
    assert features._unpacked(features._packed(ordered)).selectExpr("map_keys(tf) AS k").first().k == ["b", "c", "a"]
