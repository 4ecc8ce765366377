"""The data model laid over the bundled tables: supplier = playlist, part =
track, lineitem = playlist entry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodloom.operators.grouping import keep_first


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per track: names, nullable feature struct, tag array.

    Four planted sonic groups (``p_partkey % 4``); some tracks have no
    features, some no tags, some a null inside the features.
    """
    key = "p_partkey"
    return read(spark, sf_dir, "part").select(
        F.col(key).alias("track_id"),
        F.col("p_name").alias("title"),
        F.expr("array(named_struct('name', p_brand, 'spotify_id', CAST(NULL AS STRING)))").alias(
            "artists"
        ),
        F.col("p_type").alias("album_name"),
        (F.col("p_size") * 1000).cast("int").alias("duration_ms"),
        F.expr(
            """CASE WHEN p_partkey % 10 <> 3 THEN named_struct(
              'acousticness', 1e-2*((p_partkey*19)%101),
              'danceability', 1e-2*((p_partkey*71)%101),
              'energy', 25e-2*(p_partkey%4) + 24e-4*((p_partkey*37)%101),
              'instrumentalness', 1e-2*((p_partkey*11)%101),
              'liveness', 1e-2*((p_partkey*7)%101),
              'loudness', -20e0 + 4e0*(p_partkey%4) + 4e-2*((p_partkey*17)%101),
              'speechiness', CASE WHEN p_size % 13 <> 0 THEN 1e-2*((p_partkey*3)%101) END,
              'tempo', 60e0 + 35e0*((p_partkey%4+2)%4) + 3e-1*((p_partkey*29)%101),
              'valence', 25e-2*(((p_partkey%4)*3+1)%4) + 24e-4*((p_partkey*53)%101),
              'key', CAST(p_size % 12 AS INT), 'mode', CAST(p_size % 2 AS INT)) END"""
        ).alias("audio_features"),
        F.expr(
            """CASE WHEN p_partkey % 7 <> 2 THEN array(
              named_struct('name', p_name, 'count', CAST((p_partkey*13)%101 AS INT)),
              named_struct('name', lower(p_type), 'count', CAST(10*((p_partkey*7)%11) AS INT)))
              ELSE CAST(array() AS ARRAY<STRUCT<name: STRING, count: INT>>) END"""
        ).alias("tags"),
        F.when(F.col("p_size") % 5 > 0, F.concat(F.lit("rb"), F.col(key))).alias("reccobeats_id"),
        F.when(F.col("p_size") % 7 > 0, F.col("p_size").cast("int")).alias("popularity"),
    )


def raw_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Playlist entries as delivered, with repeats of a track."""
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("playlist_id"),
        F.col("l_partkey").alias("track_id"),
        (F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("pos"),
        F.col("l_shipdate").alias("added_at"),
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Playlist entries without repeats, first one kept. Order: pos, track_id."""
    return keep_first(raw_items(spark, sf_dir), ["playlist_id", "track_id"], ["pos", "added_at"])


def playlists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("playlist_id"),
        F.col("s_name").alias("name"),
        F.concat(F.lit("user"), F.col("s_nationkey")).alias("owner"),
        F.concat(F.lit("snap"), F.floor("s_acctbal").cast("bigint")).alias("snapshot_id"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as tracks whose one tag is the whole text."""
    return read(spark, sf_dir, "documents").select(
        F.col("source").alias("playlist_id"),
        F.col("doc_id").alias("track_id"),
        F.col("doc_id").alias("pos"),
        F.expr("array(named_struct('name', text, 'count', CAST(n_chars % 101 AS INT)))").alias(
            "tags"
        ),
    )


#: What ``planted`` reads besides the columns of ``features.entries``.
PLANTED = ("duration_ms",)


def planted(lib: DataFrame) -> DataFrame:
    """A known assignment: sonic group x size parity, tag-only tracks apart.

    Pairs of clusters share a mood label, and the tag-only cluster lacks
    audio means, so both special rules of the summaries are met. ``lib`` may also be
    ``features.entries`` with the columns of ``PLANTED``; its rows then stay where they lie.
    """
    return lib.filter("eligible").select(
        *[c for c in lib.columns if c == "_salt"],
        "playlist_id",
        "track_id",
        F.expr(
            """CAST(CASE WHEN has_af THEN track_id % 4 + 4 * (duration_ms DIV 1000 % 2)
               ELSE 8 END AS INT)"""
        ).alias("cluster_id"),
    )


def vector_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as one playlist of ready vectors with a given cluster."""
    return read(spark, sf_dir, "embeddings").select(
        F.lit("library").alias("playlist_id"),
        F.col("vec_id").alias("track_id"),
        F.col("vec_id").alias("pos"),
        F.col("label").alias("cluster_id"),
        F.col("embedding").cast("array<double>").alias("vec"),
    )
