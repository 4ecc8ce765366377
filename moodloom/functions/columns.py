"""Column expressions: everything here runs inside the JVM, no Python UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from moodloom.schema import EXPLAINED

# A token runs from the first to the last word character of a stretch without
# white space, so "r&b" and "lo-fi" stay whole and outer punctuation is cut.
TOKEN = r"[\p{L}\p{N}_](?:[^\t-\r\x1c-\x20\x{85}\p{Z}]*[\p{L}\p{N}_])?"


# All labels the rules below can give.
MOODS = tuple(
    f"{e}_energy_{v}{t}"
    for e in ("low", "medium", "high")
    for v in ("sad", "neutral", "happy")
    for t in ("_slow", "", "_fast")
)


def number(c: Column) -> Column:
    """Value as double; null when it is missing, unparseable or NaN."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x), x)


def tag_weight(count: Column) -> Column:
    """How often a tag counts: a twentieth of its count, half to even, in 1..5."""
    return F.greatest(F.least(F.bround(count / F.lit(20.0)), F.lit(5.0)), F.lit(1.0)).cast("int")


def tokens(name: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(name, F.lit(""))), F.lit(TOKEN), F.lit(0))


def mood_label(energy: Column, valence: Column, tempo: Column) -> Column:
    """Readable mood of a centroid; a null feature falls into the middle."""
    # The thresholds and the words of the labels.
    e = (
        F.when(energy >= 0.67, "high_energy")
        .when(energy <= 0.33, "low_energy")
        .otherwise("medium_energy")
    )
    v = F.when(valence >= 0.6, "happy").when(valence <= 0.4, "sad").otherwise("neutral")
    t = F.when(tempo >= 130, "_fast").when(tempo <= 90, "_slow").otherwise("")
    return F.concat(e, F.lit("_"), v, t)


def severity(score: Column) -> Column:
    # The borders of the three severity classes.
    return F.when(score >= 0.9, "severe").when(score >= 0.85, "moderate").otherwise("mild")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def distance(a: Column, b: Column) -> Column:
    return norm(F.zip_with(a, b, lambda x, y: x - y))


def unit(v: Column, length: Column) -> Column:
    """``v`` over its length; a zero vector stays zero."""
    return F.transform(v, lambda x: F.when(length > 0, x / length).otherwise(F.lit(0.0)))


def link_id(href: Column, marker: str) -> Column:
    """Text behind the last slash, for links that contain ``marker``."""
    return F.when(href.contains(marker), F.regexp_extract(href, r"([^/]*)$", 1))


def playlist_ref(link: Column) -> Column:
    """Playlist id of a share link or URI; null where there is none."""
    s = F.trim(link)
    path = F.regexp_extract(s, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    # The URI prefix, the host and the path word.
    return F.when(s.startswith("spotify:playlist:"), F.element_at(F.split(s, ":"), -1)).when(
        s.contains("open.spotify.com") & (F.size(parts) >= 2) & (F.get(parts, F.lit(0)) == "playlist"),
        F.get(parts, F.lit(1)),
    )


def deltas(track: dict[str, Column], centre: dict[str, Column]) -> Column:
    """Array of (ord, feature, delta): the three features furthest off."""
    found = F.array(
        *[
            F.struct(
                F.lit(i).alias("ord"),
                F.lit(f).alias("feature"),
                # Means carry noise from the order of summation; cut it off.
                F.round(track[f] - centre[f], 9).alias("delta"),
            )
            for i, f in enumerate(EXPLAINED)
        ]
    )
    known = F.filter(found, lambda d: d["delta"].isNotNull())
    keyed = F.transform(
        known, lambda d: F.struct((-F.abs(d["delta"])).alias("k"), d["ord"], d["feature"], d["delta"])
    )
    top = F.slice(F.array_sort(keyed), 1, 3)
    return F.transform(top, lambda d: F.struct(d["ord"], d["feature"], d["delta"]))


def delta_text(d: Column) -> Column:
    """One deviation as words. ``format_number`` rounds the exact binary value
    half to even, as the sentences are specified to."""
    # The units and digits of the sentence.
    size = F.abs(d["delta"])
    way = F.when(d["delta"] > 0, "higher ").otherwise("lower ")
    amount = (
        F.when(d["feature"] == "tempo", F.concat(fixed(size, 0), F.lit(" BPM")))
        .when(d["feature"] == "loudness", F.concat(fixed(size, 1), F.lit(" dB")))
        .otherwise(fixed(size, 2))
    )
    return F.concat(way, d["feature"], F.lit(" by "), amount)


def fixed(x: Column, digits: int) -> Column:
    """``x`` with a fixed number of decimals and no thousands separator."""
    pattern = "0" if digits == 0 else "0." + "0" * digits
    return F.call_function("format_number", x, F.lit(pattern))
