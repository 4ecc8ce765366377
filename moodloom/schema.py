"""Declared schemas of the data model; nothing is inferred from the data."""

from __future__ import annotations

from pyspark.sql import types as T

# The nine audio features in matrix order.
FEATURES = (
    "acousticness",
    "danceability",
    "energy",
    "instrumentalness",
    "liveness",
    "loudness",
    "speechiness",
    "tempo",
    "valence",
)

# Features used in explanations, in the order that breaks ties.
EXPLAINED = (
    "energy",
    "valence",
    "tempo",
    "danceability",
    "acousticness",
    "speechiness",
    "loudness",
)

# Display ranges of the features (the rest run from 0 to 1).
DISPLAY_RANGE = {"loudness": (-20.0, 0.0), "tempo": (60.0, 200.0)}

ARTIST = T.StructType(
    [T.StructField("name", T.StringType()), T.StructField("spotify_id", T.StringType())]
)

AUDIO = T.StructType(
    [T.StructField(f, T.DoubleType()) for f in FEATURES]
    + [T.StructField("key", T.IntegerType()), T.StructField("mode", T.IntegerType())]
)

TAG = T.StructType(
    [T.StructField("name", T.StringType()), T.StructField("count", T.IntegerType())]
)

TRACK = T.StructType(
    [
        T.StructField("spotify_id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("album_name", T.StringType()),
        T.StructField("duration_ms", T.IntegerType()),
        T.StructField("artists", T.ArrayType(ARTIST)),
        T.StructField("audio_features", AUDIO),
        T.StructField("tags", T.ArrayType(TAG)),
        T.StructField("reccobeats_id", T.StringType()),
    ]
)

PLAYLIST_DOC = T.StructType(
    [
        T.StructField("spotify_id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("owner", T.StringType()),
        T.StructField("snapshot_id", T.StringType()),
        T.StructField("image_url", T.StringType()),
        T.StructField("total_tracks", T.IntegerType()),
        T.StructField("tracks", T.ArrayType(TRACK)),
    ]
)
