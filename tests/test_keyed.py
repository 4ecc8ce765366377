"""Keyed tables and the incremental run."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType
from small import audio, items, tracks

from moodloom.operators.keyed import KeyedTable
from moodloom.plans import incremental

KIND = "k bigint, user string, v string"


def table(spark, path, rows, buckets=8):
    frame = spark.createDataFrame(rows, KIND)
    t = KeyedTable(spark, str(path), ["k"], frame.schema, buckets)
    t.replace(frame)
    return t


def content(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_replace_touches_only_its_buckets(spark, tmp_path):
    rows = [(i, f"u{i % 3}", "old") for i in range(100)] + [(None, "u", "old"), (5, "u2", "second row")]
    t = table(spark, tmp_path / "t", rows)
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "t" / "rows").rglob("*.parquet")}
    folders = set(t.folders())
    new = spark.createDataFrame([(5, "u9", "new"), (None, "u", "new")], KIND)
    t.replace(new)
    assert content(t.read()) == sorted([r for r in rows if r[0] not in (5, None)] + [(5, "u9", "new"), (None, "u", "new")], key=repr)
    assert {f: f.stat().st_mtime_ns for f in before} == before
    touched = set(t._touched(new))
    assert {b for b, _ in set(t.folders()) - folders} == touched and len(touched) < 8
    assert {(b, f) for b, f in folders if b not in touched} <= set(t.folders())
    # The same change again gives the same state.
    t.replace(new)
    assert t.read().count() == 101


def test_insert_remove_and_empty(spark, tmp_path):
    t = table(spark, tmp_path / "t", [(i, "u", "old") for i in range(10)])
    folders = set(t.folders())
    more = spark.createDataFrame([(3, "u", "new"), (11, "u", "b"), (11, "u", "a"), (None, "u", "x"), (None, "u", "y")], KIND)
    t.insert_new(more, ["v"])
    assert folders <= set(t.folders())
    assert content(t.read()) == sorted([(i, "u", "old") for i in range(10)] + [(11, "u", "a"), (None, "u", "x")], key=repr)
    t.insert_new(more, ["v"])
    assert t.read().count() == 12
    t.remove(t.read().filter("k < 9 or k is null"))
    assert content(t.read()) == [(11, "u", "a"), (9, "u", "old")]
    t.remove(t.read())
    assert t.read().count() == 0 and t.folders() == [] and t.read().columns == ["k", "user", "v"]
    t.replace(spark.createDataFrame([], KIND))
    assert t.read().count() == 0
    with pytest.raises(ValueError):
        KeyedTable(spark, "x", ["k"], StructType([*t.schema.fields, StructField("bucket_no", IntegerType())]))


def test_failed_change_leaves_the_state(spark, tmp_path):
    t = table(spark, tmp_path / "t", [(1, "u", "old")])
    bad = spark.createDataFrame([(1, "u", "new")], KIND).withColumn("v", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception, match="no"):
        t.replace(bad)
    assert content(t.read()) == [(1, "u", "old")] and t.version() == 1


def test_incremental_run(spark, tmp_path):
    rows = [(f"t{i}", audio(energy=0.1 * i), [("rock", 50)]) for i in range(8)]
    lists = lambda snaps: spark.createDataFrame(
        [(p, p.upper(), "me", s) for p, s in snaps.items()], "playlist_id string, name string, owner string, snapshot_id string"
    )
    assign = lambda lib: lib.filter("eligible").select("playlist_id", "track_id", F.lit(0).alias("cluster_id"))
    step = lambda snaps, entries: incremental.run(
        str(tmp_path / "s"), lists(snaps), items(spark, entries), tracks(spark, rows), assign=assign
    )
    a, b = [f"t{i}" for i in range(6)], ["t1", "t2", "t7"]
    status, out = step({"a": "1", "b": "1", "c": ""}, {"a": a, "b": b})
    assert {r["playlist_id"]: r["status"] for r in status.collect()} == {"a": "fetch", "b": "fetch", "c": "fetch"}
    assert {r["playlist_id"]: r["num_tracks"] for r in out["summary"].collect()} == {"a": 6, "b": 3, "c": 0}
    # b changes, its entries shrink; the entries of a change without a new snapshot, so its rows stay; d is new.
    status, out = step({"a": "1", "b": "2", "d": "1"}, {"a": a[:2], "b": b[:1], "d": a})
    assert {r["playlist_id"]: r["status"] for r in status.collect()} == {"a": "hit", "b": "fetch", "d": "fetch"}
    got = {r["playlist_id"]: (r["num_tracks"], r["snapshot_id"]) for r in out["summary"].collect()}
    assert got == {"a": (6, "1"), "b": (1, "2"), "c": (0, ""), "d": (6, "1")}
    counts = {r["playlist_id"]: r["count"] for r in out["tracks"].groupBy("playlist_id").count().collect()}
    assert counts == {"a": 6, "b": 1, "d": 6}
    # Nothing new: everything is a hit, and the rows are those of before.
    status, again = step({"a": "1", "b": "2", "d": "1"}, {})
    assert {r["status"] for r in status.collect()} == {"hit"} and content(again["summary"]) == content(out["summary"])


def test_settled_rows_are_stored_without_a_second_copy(spark, tmp_path, monkeypatch):
    from moodloom.operators import keyed

    kind = "k bigint, v string"
    table = keyed.KeyedTable(spark, str(tmp_path / "t"), ["k"], spark.createDataFrame([], kind).schema, 4)
    table.replace(spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (3, "d")], kind))
    written = []
    monkeypatch.setattr(keyed, "settle", lambda df, *a: written.append(df.columns) or df)
    table.replace(spark.createDataFrame([(2, "x"), (None, "n")], kind), spark.createDataFrame([(3,)], "k bigint"), settled=True)
    assert sorted(map(repr, table.read().collect())) == ["Row(k=1, v='a')", "Row(k=2, v='x')", "Row(k=None, v='n')"]
    assert written == [["k"]]
