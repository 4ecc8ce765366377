"""Shaping of nested payloads into rows, with declared schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moodloom.functions.columns import link_id, playlist_ref
from moodloom.schema import FEATURES, PLAYLIST_DOC
from moodloom.session import settle


def read_playlists(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Nested playlist documents from JSON files.

    One document per line is read as it is. With ``multi_line`` a file holds one JSON
    array (or one document), on any number of lines; large files are split too.
    """
    if multi_line:
        return parse_playlists(read_array(spark, path), "doc")
    return with_defaults(spark.read.schema(PLAYLIST_DOC).json(path))


def read_array(spark: SparkSession, path: str) -> DataFrame:
    """(file, nth, doc): the objects of JSON array files as texts, counted from 0.

    A file is not one task. Spark reads it in splits, cut after closing braces into
    pieces. Whether a piece starts inside a string is the parity of the quotes before
    it, and how deep it lies is a running sum of brackets outside strings; both are
    summed up per split first, so only one row a split is ordered over a whole file and
    only the pieces of one split in a task. An object ends where the depth is back at
    that of the array. Compressed files cannot be split.

    A file without an array around its objects works as well. Elements that are not
    objects, and a last object without an end, give no row; a blank file gives none.
    """
    raw = spark.read.option("lineSep", "}").text(path)
    quote, bracket = F.lit('"'), r"[^\[\]{}]"
    # A character after a backslash, a quote above all, is never a mark.
    plain = F.regexp_replace(F.concat("value", F.lit("}")), r"(?s)\\.", "")
    pieces = settle(
        raw.select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("split"),
            F.monotonically_increasing_id().alias("at"),
            "value",
            F.regexp_replace(plain, r'[^"\[\]{}]', "").alias("marks"),
        )
    )
    files = pieces.groupBy("file").agg(F.min_by("value", F.struct("split", "at")).alias("head"))
    base = files.select("file", F.col("head").rlike(r"^[\s\uFEFF]*\[").cast("int").alias("base"))

    def depth(text: Column) -> Column:
        only = F.regexp_replace(text, bracket, "")
        opened = F.length(F.regexp_replace(only, r"[\]}]", ""))
        return 2 * opened - F.length(only)

    def outside(start: int) -> Column:
        """Change of depth of a piece that starts outside (0) or inside (1) a string."""
        parts = F.split("marks", '"', -1)
        return depth(F.array_join(F.filter(parts, lambda p, i: i % 2 == start), ""))

    inner = Window.partitionBy("file", "split").orderBy("at")
    outer = Window.partitionBy("file").orderBy("split")

    def before(column: str, window) -> Column:
        earlier = F.sum(column).over(window.rowsBetween(Window.unboundedPreceding, -1))
        return F.coalesce(earlier, F.lit(0))

    def carried(rows: DataFrame, column: str, name: str) -> DataFrame:
        """Adds ``name``: the sum of ``column`` over the splits before this one."""
        per = rows.groupBy("file", "split").agg(F.sum(column).alias(column))
        return rows.join(per.select("file", "split", before(column, outer).alias(name)), ["file", "split"])

    marked = pieces.select(
        "file",
        "split",
        "at",
        (F.length("marks") - F.length(F.replace("marks", quote, F.lit("")))).alias("quotes"),
        outside(0).alias("free"),
        outside(1).alias("quoted"),
    )
    inside = (F.col("so_far") + before("quotes", inner)) % 2
    known = carried(marked, "quotes", "so_far").withColumn("inside", inside).select(
        "file",
        "split",
        "at",
        F.when(F.col("inside") == 1, F.col("quoted")).otherwise(F.col("free")).alias("change"),
        ((F.col("inside") + F.col("quotes")) % 2 == 0).alias("closes"),
    )
    level = F.col("so_far") + before("change", inner) + F.col("change")
    ends = (
        carried(known, "change", "so_far")
        .withColumn("level", level)
        .join(base, "file")
        .select("file", "split", "at", (F.col("closes") & (F.col("level") == F.col("base"))).cast("int").alias("end"))
    )
    ends = settle(carried(ends, "end", "so_far").withColumn("nth", F.col("so_far") + before("end", inner)))
    whole = (
        pieces.select("file", "split", "at", "value")
        .join(ends.select("file", "split", "at", "nth", "end"), ["file", "split", "at"])
        .groupBy("file", "nth")
        .agg(F.array_sort(F.collect_list(F.struct("split", "at", "value"))).alias("p"), F.max("end").alias("done"))
        .where("done = 1")
    )
    text = F.concat(F.array_join(F.col("p.value"), "}"), F.lit("}"))
    return whole.select("file", "nth", F.regexp_replace(text, r"^[^{]*", "").alias("doc"))


def parse_playlists(docs: DataFrame, column: str = "doc") -> DataFrame:
    """Nested playlist documents from a text column."""
    return with_defaults(docs.select(F.from_json(column, PLAYLIST_DOC).alias("d")).select("d.*"))


def with_defaults(raw: DataFrame) -> DataFrame:
    """Absent lists become empty; ``total_tracks`` falls back to their size."""
    artists, tags = (PLAYLIST_DOC["tracks"].dataType.elementType[n].dataType for n in ("artists", "tags"))

    def filled(t: Column) -> Column:
        return t.withField("artists", F.coalesce(t["artists"], F.array().cast(artists))).withField(
            "tags", F.coalesce(t["tags"], F.array().cast(tags))
        )

    tracks = F.coalesce("tracks", F.array().cast(PLAYLIST_DOC["tracks"].dataType))
    return raw.withColumn("tracks", F.transform(tracks, filled)).withColumn(
        "total_tracks", F.coalesce("total_tracks", F.size("tracks"))
    )


def flatten_playlists(playlists: DataFrame) -> DataFrame:
    """One row per track of a nested document, with its position."""
    return playlists.select(
        F.col("spotify_id").alias("playlist_id"),
        "total_tracks",
        F.posexplode("tracks").alias("pos", "t"),
    ).select("playlist_id", "total_tracks", "pos", F.col("t.spotify_id").alias("track_id"), F.col("t").alias("track"))


# Items of a playlist page as delivered; a page is an array of these.
PAGE = """array<struct<added_at: string, track: struct<id: string, name: string,
  artists: array<struct<name: string>>, album: struct<name: string>, popularity: int,
  explicit: boolean, duration_ms: int>>>"""


def flatten_items(pages: DataFrame, key: str, column: str) -> DataFrame:
    """Rows of the valid items of a page: position counts before the drop of
    null items and null ids; only the first artist is kept."""
    items = pages.select(
        key, F.posexplode(F.from_json(column, PAGE)).alias("position", "i")
    )
    t = F.col("i.track")
    return items.filter(t["id"].isNotNull()).select(
        key,
        "position",
        utc(F.col("i.added_at")).alias("added_at"),
        t["id"].alias("track_id"),
        t["name"].alias("track_name"),
        F.get(t["artists"], F.lit(0))["name"].alias("artist_name"),
        t["album"]["name"].alias("album_name"),
        t["popularity"].alias("popularity"),
        t["explicit"].alias("explicit"),
        t["duration_ms"].alias("duration_ms"),
    )


def utc(text: Column) -> Column:
    """Timestamp of a text; what cannot be parsed becomes null."""
    return text.try_cast("timestamp")


ENTRY = "item struct<id: string, name: string, linked_from: struct<id: string>>"


def resolve_ids(entries: DataFrame, column: str) -> DataFrame:
    """Adds ``track_id``: the id a track was linked from, else its own; local
    and unavailable entries (no item or no id) are dropped."""
    item = F.from_json(column, ENTRY)["item"]
    return entries.withColumn(
        "track_id", F.coalesce(item["linked_from"]["id"], item["id"])
    ).filter(F.col("track_id").isNotNull())


def id_map(links: DataFrame, marker: str = "/track/") -> DataFrame:
    """(own id, id in the link); rows lacking either are dropped."""
    return (
        links.withColumn("linked_id", F.nullif(link_id(F.col("href"), marker), F.lit("")))
        .filter(F.col("id").isNotNull() & F.col("linked_id").isNotNull())
    )


def resolve_links(links: DataFrame, playlists: DataFrame) -> DataFrame:
    """Shared playlist links with the playlist they mean; null if none."""
    named = playlists.select(F.col("playlist_id").cast("string").alias("playlist_id"), "name")
    return links.withColumn("playlist_id", playlist_ref(F.col("link"))).join(named, "playlist_id", "left")


TAG_PAYLOAD = "toptags struct<tag: string>"
RAW_TAG = "array<struct<name: string, count: string>>"


def normalise_tags(payload: Column) -> Column:
    """Tag array of a payload whose ``tag`` is a list or one object: nameless
    tags are dropped, a missing count is 0."""
    tag = F.from_json(payload, TAG_PAYLOAD)["toptags"]["tag"]
    listed = F.when(tag.startswith("["), tag).otherwise(F.concat(F.lit("["), tag, F.lit("]")))
    named = F.filter(
        F.from_json(listed, RAW_TAG), lambda t: t["name"].isNotNull() & (t["name"] != "")
    )
    clean = F.transform(
        named,
        lambda t: F.struct(
            t["name"].alias("name"),
            F.coalesce(t["count"].try_cast("int"), F.lit(0)).alias("count"),
        ),
    )
    return F.coalesce(clean, F.array().cast("array<struct<name: string, count: int>>"))


def normalise_features(payload: Column) -> dict[str, Column]:
    """The nine features of a payload: a key that is not there is 0, an
    explicit null stays null."""
    m = F.from_json(payload, "map<string, string>")
    return {
        f: F.when(F.map_contains_key(m, f), F.try_element_at(m, F.lit(f)).try_cast("double")).otherwise(
            F.when(m.isNotNull(), F.lit(0.0))
        )
        for f in FEATURES
    }


def features_by_track(payloads: DataFrame, ids: DataFrame) -> DataFrame:
    """Feature rows keyed back to the track through the id map."""
    f = normalise_features(F.col("payload"))
    return payloads.join(ids.select(F.col("id"), F.col("linked_id").alias("track_id")), "id").select(
        "track_id", *[c.alias(n) for n, c in f.items()]
    )


def fuse(tracks: DataFrame, features: DataFrame, tags: DataFrame, ids: DataFrame) -> DataFrame:
    """Tracks with features, tags and foreign id. No features: null; no tags:
    empty list."""
    empty = F.array().cast("array<struct<name: string, count: int>>")
    return (
        tracks.join(features, "track_id", "left")
        .join(tags, "track_id", "left")
        .join(ids, "track_id", "left")
        .withColumn("tags", F.coalesce("tags", empty))
    )


def merge_features(items: DataFrame, features: DataFrame) -> DataFrame:
    """Flat table: one row per entry with its features, times in UTC."""
    return items.withColumn("added_at", utc(F.col("added_at"))).join(features, "track_id", "left")


LISTING = """id string, name string, description string, snapshot_id string,
  images array<struct<url: string>>, owner struct<display_name: string>, tracks string,
  total_tracks int"""


def _listing(payloads: DataFrame, column: str) -> DataFrame:
    return payloads.select(F.from_json(column, LISTING).alias("p")).select("p.*")


def metadata(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Playlist metadata: name ``Unknown`` if absent, first image, owner."""
    p = _listing(payloads, column)
    return p.select(
        F.col("id").alias("playlist_id"),
        F.coalesce("name", F.lit("Unknown")).alias("name"),
        "description",
        F.col("owner.display_name").alias("owner"),
        "snapshot_id",
        F.get("images", F.lit(0))["url"].alias("image_url"),
        F.get_json_object("tracks", "$.total").try_cast("int").alias("total_tracks"),
    )


def listing(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Playlist listing; the track count is an object, a number or absent, and
    an explicit non-zero ``total_tracks`` wins."""
    p = _listing(payloads, column)
    nested = F.coalesce(
        F.get_json_object("tracks", "$.total").try_cast("int"), F.col("tracks").try_cast("int"), F.lit(0)
    )
    return p.select(
        F.col("id").alias("playlist_id"),
        "name",
        F.coalesce(F.nullif("total_tracks", F.lit(0)), nested).alias("total_tracks"),
        F.coalesce(F.col("owner.display_name"), F.lit("")).alias("owner"),
        "description",
        F.get("images", F.lit(0))["url"].alias("image_url"),
    )
