"""Analysis of what changed: stored results stay for playlists whose snapshot is known."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodloom.operators.grouping import DEALT, copies
from moodloom.operators.keyed import KeyedTable
from moodloom.operators.state import changed_playlists
from moodloom.plans.pipeline import analyze
from moodloom.session import settle

#: Result tables that are stored by default.
RESULTS = ("summary", "tracks", "clusters")


def run(
    folder: str, playlists: DataFrame, items: DataFrame, tracks: DataFrame, results=RESULTS, buckets: int = 64, **params
) -> tuple[DataFrame, dict[str, DataFrame]]:
    """One incremental run over the stored state in ``folder``.

    Playlists (playlist_id, name, owner, snapshot_id) whose stored snapshot equals the
    current one are hits: nothing of them is read or computed. The others are analysed,
    and their rows replace the stored ones, bucket by bucket. Gives the status per
    playlist (user_id, playlist_id, snapshot_id, cached_snapshot, status) and the
    stored result tables, each with the snapshot_id its rows were computed from.
    Stored playlists that nobody names any more stay.

    Snapshots are stored last, so a run that dies on the way is repeated by the next one.
    """
    spark = playlists.sparkSession
    current = playlists.select(F.col("owner").alias("user_id"), "playlist_id", "snapshot_id")
    keys = ["user_id", "playlist_id"]
    seen = KeyedTable(spark, f"{folder}/snapshots", keys, current.schema, buckets)
    cached = seen.read().select(*keys, F.col("snapshot_id").alias("cached_snapshot"), F.lit(True).alias("resolves"))
    status = settle(changed_playlists(current.select(*keys), current, cached))
    news = status.filter("status = 'fetch'").select(*keys, "snapshot_id")
    fetch = settle(news.select("playlist_id", "snapshot_id").distinct())
    of_fetch = lambda df: df.join(fetch.select("playlist_id"), "playlist_id", "left_semi")
    done = analyze(of_fetch(playlists), of_fetch(items), tracks, **params)
    out = {}
    for name in results:
        lying = name == "tracks"
        if lying:
            rows = done.dealt_tracks.join(copies(fetch, done.hot), list(DEALT)).drop("_salt")
        else:
            rows = getattr(done, name).join(fetch, "playlist_id")
        table = KeyedTable(spark, f"{folder}/{name}", ["playlist_id"], rows.schema, buckets)
        table.replace(rows, fetch, settled=lying)
        out[name] = table.read()
    seen.replace(news)
    return status, out
