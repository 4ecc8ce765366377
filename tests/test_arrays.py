"""JSON array files read in splits of any size."""

import json

import pytest

from moodloom.sources import payloads

SPLIT = "spark.sql.files.maxPartitionBytes"
ODD = ['plain', 'say "hi" } ] [', "back\\", 'tail\\"', "{[", "}},{\"a\":1}", "é漢😀}", "", "line\nbreak\t}"]
DOCS = [
    {"spotify_id": f"p{i}", "name": t, "tracks": [{"spotify_id": f"t{i}{j}", "title": ODD[(i + j) % len(ODD)], "tags": []} for j in range(i % 4)]}
    for i, t in enumerate(ODD)
]


@pytest.fixture
def splits(spark):
    before = spark.conf.get(SPLIT)
    yield lambda n: spark.conf.set(SPLIT, str(n))
    spark.conf.set(SPLIT, before)


@pytest.mark.parametrize("size", [31, 1 << 20])
@pytest.mark.parametrize("shape", [dict(indent=2), dict(separators=(",", ":"), ensure_ascii=False)])
def test_any_split_gives_the_same_objects(spark, tmp_path, splits, size, shape):
    (tmp_path / "a.json").write_text(json.dumps(DOCS, **shape))
    splits(size)
    got = payloads.read_array(spark, str(tmp_path)).orderBy("nth").collect()
    assert [r.nth for r in got] == list(range(len(DOCS)))
    assert [json.loads(r.doc) for r in got] == DOCS


def test_files_are_read_in_several_splits(spark, tmp_path, splits):
    (tmp_path / "a.json").write_text(json.dumps(DOCS))
    splits(100)
    assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 5


def test_playlists_of_several_files(spark, tmp_path, splits):
    (tmp_path / "a.json").write_text(json.dumps(DOCS[:5]) + "\n")
    (tmp_path / "b.json").write_text("﻿" + json.dumps(DOCS[5:]), encoding="utf-8")
    splits(300)
    got = {r.spotify_id: r for r in payloads.read_playlists(spark, str(tmp_path), multi_line=True).collect()}
    assert {p: (r.name, [t.title for t in r.tracks]) for p, r in got.items()} == {
        d["spotify_id"]: (d["name"], [t["title"] for t in d["tracks"]]) for d in DOCS
    }


@pytest.mark.parametrize(
    "text, want",
    [
        ("", []),
        (" \n", []),
        ("[]", []),
        ("[{}]", [{}]),
        ('{"a": {"b": "}"}}', [{"a": {"b": "}"}}]),
        ('{"a": 1}\n{"a": 2}\n', [{"a": 1}, {"a": 2}]),
        ('[null, {"a": [{"b": {}}, {}]}, 7, [], {"c": "\\\\"}, "x"]', [{"a": [{"b": {}}, {}]}, {"c": "\\"}]),
        ('[{"a": 1}, {"a": "cut', [{"a": 1}]),
        ('[{"a": 1}, {"a": {"b": 2}', [{"a": 1}]),
    ],
)
def test_small_files(spark, tmp_path, splits, text, want):
    (tmp_path / "a.json").write_text(text)
    splits(20)
    got = payloads.read_array(spark, str(tmp_path)).orderBy("nth").collect()
    assert [json.loads(r.doc) for r in got] == want
