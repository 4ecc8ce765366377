"""Hand-sized frames of the data model."""

from moodloom.schema import FEATURES

TRACKS = (
    "track_id string, title string, artists array<struct<name: string, spotify_id: string>>, album_name string,"
    " duration_ms int, audio_features struct<" + ", ".join(f"{f}: double" for f in FEATURES) + ", key: int, mode: int>,"
    " tags array<struct<name: string, count: int>>, reccobeats_id string"
)


def audio(**values):
    base = dict.fromkeys(FEATURES, 0.5) | {"loudness": -8.0, "tempo": 100.0}
    base.update(values)
    return tuple(base[f] for f in FEATURES) + (1, 0)


def tracks(spark, rows):
    """rows: (track_id, audio tuple or None, [(tag, count), ..])"""
    return spark.createDataFrame(
        [(t, f"Title {t}", [("A", None)], "Album", 1000, a, tags, None) for t, a, tags in rows], TRACKS
    )


def items(spark, playlists):
    """playlists: {playlist_id: [track_id, ..]}"""
    rows = [(p, t, i) for p, ts in playlists.items() for i, t in enumerate(ts)]
    return spark.createDataFrame(rows, "playlist_id string, track_id string, pos bigint")


def names(spark, ids):
    return spark.createDataFrame([(p, p.upper()) for p in ids], "playlist_id string, name string")
