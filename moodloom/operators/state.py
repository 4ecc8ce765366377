"""Incremental tables: what is known, what is new, what has to be replaced."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodloom.operators.grouping import keep_first


def changed_playlists(wanted: DataFrame, current: DataFrame, cached: DataFrame) -> DataFrame:
    """``hit`` or ``fetch`` for every wanted playlist of the user's library.

    A hit needs a stored snapshot that is not empty, equals the current one
    and whose record resolves. Wanted ids outside the library are skipped.

    wanted: (user_id, playlist_id); current: + snapshot_id;
    cached: + cached_snapshot, resolves.
    """
    keys = ["user_id", "playlist_id"]
    same = (F.col("cached_snapshot") != "") & (F.col("cached_snapshot") == F.col("snapshot_id"))
    return (
        wanted.join(current, keys)
        .join(cached, keys, "left")
        .withColumn("status", F.when(same & F.col("resolves"), "hit").otherwise("fetch"))
        .drop("resolves")
    )


def known_tracks(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    return wanted.join(stored.select("track_id"), "track_id", "left_semi")


def unknown_tracks(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    return wanted.join(stored.select("track_id"), "track_id", "left_anti")


def merge_in_order(items: DataFrame, stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Entries with their stored or fresh track; unresolved ones drop out. The
    order stays in ``pos``."""
    return items.join(stored.unionByName(fresh), "track_id")


def new_tracks(stored: DataFrame, incoming: DataFrame, order: list[str]) -> DataFrame:
    """Rows to append: first copy of each incoming track that is not stored.
    Stored rows never change, so no stored file is rewritten."""
    first = keep_first(incoming, ["track_id"], order)
    return first.join(stored.select("track_id"), "track_id", "left_anti")


def insert_only(stored: DataFrame, incoming: DataFrame, order: list[str]) -> DataFrame:
    fresh = new_tracks(stored, incoming, order)
    return stored.unionByName(fresh.select(*stored.columns))


def upsert_tracks(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Update of known tracks, insert of new ones."""
    kept = stored.join(incoming.select("track_id"), "track_id", "left_anti")
    return kept.unionByName(incoming.select(*stored.columns))


def replace_playlists(
    stored: DataFrame, incoming: DataFrame, keys: tuple[str, ...] = ("user_id", "playlist_id")
) -> DataFrame:
    """Full replacement of the rows of every incoming key."""
    keys = list(keys)
    kept = stored.join(incoming.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(incoming.select(*stored.columns))


def resolve(records: DataFrame, tracks: DataFrame) -> DataFrame:
    """Stored playlists (ordered ``track_ids``) as rows (.., pos, track).
    Unknown tracks drop out, positions stay those of the stored list."""
    rest = [c for c in records.columns if c != "track_ids"]
    entries = records.select(*rest, F.posexplode("track_ids").alias("pos", "track_id"))
    return entries.join(tracks, "track_id")


def of_users(records: DataFrame, users: DataFrame) -> DataFrame:
    """All stored playlists of the given users."""
    return records.join(users.select("user_id"), "user_id", "left_semi")


def without_users(records: DataFrame, users: DataFrame) -> DataFrame:
    """Playlists after the users are cleared; the shared tracks are not touched."""
    return records.join(users.select("user_id"), "user_id", "left_anti")
