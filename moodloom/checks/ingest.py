"""Queries: payload shaping, sinks, incremental tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from moodloom.checks.ctes import TOKEN
from moodloom.checks.ctes import with_ctes as sql
from moodloom.checks.registry import query, r6
from moodloom.functions.columns import tokens
from moodloom.operators import state
from moodloom.operators.grouping import keep_first
from moodloom.plans import incremental
from moodloom.schema import FEATURES
from moodloom.session import state_folder
from moodloom.sources import payloads, sinks, tables

# --- payloads ----------------------------------------------------------------


def playlist_docs(s):
    """Every document as a nested playlist whose tracks are its lines."""
    track = """transform(split(text, '\\n'), (line, i) -> named_struct(
      'spotify_id', concat(doc_id, ':', i), 'title', line, 'duration_ms', length(line),
      'artists', CASE WHEN i % 2 = 0 THEN array(named_struct('name', lang)) END,
      'tags', CASE WHEN i % 3 = 0 THEN array(named_struct('name', source, 'count', i)) END))"""
    return s.read("documents").selectExpr(
        f"""to_json(named_struct('spotify_id', CAST(doc_id AS STRING), 'name', source,
        'total_tracks', CASE WHEN n_chars % 3 > 0 THEN 7 END, 'tracks', {track})) AS doc"""
    )


_LINES = """SELECT doc_id, lang, source, n_chars, string_split(text, chr(10)) AS lines,
  generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i,
  unnest(string_split(text, chr(10))) AS line FROM documents"""


@query(
    "I1_playlist_documents",
    sql("""SELECT CAST(doc_id AS VARCHAR) AS playlist_id,
      CAST(CASE WHEN n_chars % 3 > 0 THEN 7 ELSE len(lines) END AS INT) AS total_tracks, CAST(i AS INT) AS pos,
      doc_id || ':' || i AS track_id, line AS title, CAST(length(line) AS INT) AS duration_ms,
      CASE WHEN i % 2 = 0 THEN 1 ELSE 0 END AS artists, CASE WHEN i % 3 = 0 THEN 1 ELSE 0 END AS tags FROM lines_""",
        {"lines_": _LINES}),
)
def i1(s):
    flat = payloads.flatten_playlists(payloads.parse_playlists(playlist_docs(s)))
    return flat.select(
        "playlist_id",
        "total_tracks",
        "pos",
        "track_id",
        "track.title",
        "track.duration_ms",
        F.size("track.artists").alias("artists"),
        F.size("track.tags").alias("tags"),
    )


@query(
    "I2_flatten_items",
    sql("""SELECT doc_id, CAST(i AS INT) AS position, doc_id || ':' || i AS track_id, line AS track_name,
      string_split(line, ' ')[1] AS artist_name, source AS album_name, CAST(i % 100 AS INT) AS popularity,
      i % 2 = 0 AS explicit, CAST(length(line) AS INT) AS duration_ms,
      CAST(epoch(TRY_CAST('2024-01-' || lpad(CAST(1 + n_chars % 40 AS VARCHAR), 2, '0') || ' 10:00:00' AS TIMESTAMP)) AS BIGINT) AS added
      FROM lines_ WHERE line <> '' AND length(line) % 5 <> 0""", {"lines_": _LINES}),
)
def i2(s):
    page = s.read("documents").selectExpr(
        "doc_id",
        """to_json(transform(split(text, '\\n'), (line, i) -> CASE WHEN line <> '' THEN named_struct(
          'added_at', concat('2024-01-', lpad(1 + n_chars % 40, 2, '0'), 'T10:00:00Z'),
          'track', named_struct('id', CASE WHEN length(line) % 5 <> 0 THEN concat(doc_id, ':', i) END,
            'name', line, 'artists', array(named_struct('name', split(line, ' ')[0]), named_struct('name', lang)),
            'album', named_struct('name', source), 'popularity', i % 100, 'explicit', i % 2 = 0,
            'duration_ms', length(line))) END)) AS page""",
    )
    flat = payloads.flatten_items(page, "doc_id", "page")
    return flat.withColumn("added", F.unix_timestamp("added_at")).drop("added_at")


@query(
    "I3_resolve_ids",
    sql("""SELECT * FROM (SELECT l_orderkey, l_linenumber, coalesce(
        CASE WHEN l_linenumber % 2 = 0 THEN 'L' || l_suppkey END,
        CASE WHEN l_linenumber <> 1 THEN CAST(l_partkey AS VARCHAR) END) AS track_id
      FROM lineitem WHERE l_returnflag <> 'R') WHERE track_id IS NOT NULL"""),
)
def i3(s):
    entries = s.read("lineitem").selectExpr(
        "l_orderkey",
        "l_linenumber",
        """to_json(named_struct('item', CASE WHEN l_returnflag <> 'R' THEN named_struct(
          'id', CASE WHEN l_linenumber <> 1 THEN CAST(l_partkey AS STRING) END, 'name', l_linestatus,
          'linked_from', CASE WHEN l_linenumber % 2 = 0 THEN named_struct('id', concat('L', l_suppkey)) END) END))
          AS payload""",
    )
    return payloads.resolve_ids(entries, "payload").drop("payload")


@query(
    "I4_keep_first_in_playlist",
    sql("SELECT playlist_id, track_id, pos, CAST(epoch(added_at) AS BIGINT) AS added FROM items"),
)
def i4(s):
    since = "timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', added_at)"
    return s.items.select("playlist_id", "track_id", "pos", F.expr(since).alias("added"))


@query(
    "I4_keep_first_overall",
    sql("""SELECT track_id, playlist_id, pos FROM raw_items
      QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY playlist_id, pos) = 1"""),
)
def i4b(s):
    raw = tables.raw_items(s.spark, s.sf_dir).select("track_id", "playlist_id", "pos")
    return keep_first(raw, ["track_id"], ["playlist_id", "pos"])


@query(
    "I5_id_map",
    sql("""SELECT id, linked_id FROM (SELECT CASE WHEN p_size % 5 > 0 THEN 'rb' || p_partkey END AS id,
        CASE p_size % 3 WHEN 0 THEN CAST(p_partkey AS VARCHAR) END AS linked_id FROM part)
      WHERE id IS NOT NULL AND linked_id IS NOT NULL"""),
)
def i5(s):
    links = s.read("part").selectExpr(
        "CASE WHEN p_size % 5 > 0 THEN concat('rb', p_partkey) END AS id",
        """concat('https://music.example.com/', CASE p_size % 3 WHEN 0 THEN concat('track/', p_partkey)
           WHEN 1 THEN concat('artist/', p_partkey) ELSE 'track/' END) AS href""",
    )
    return payloads.id_map(links).select("id", "linked_id")


@query(
    "I5_page_links",
    sql("""SELECT page_id AS id, regexp_extract(url, '([^/]*)$', 1) AS linked_id FROM pages
      WHERE url LIKE '%/en/%' AND regexp_extract(url, '([^/]*)$', 1) <> ''"""),
)
def i5b(s):
    links = s.read("pages").select(F.col("page_id").alias("id"), F.col("url").alias("href"))
    return payloads.id_map(links, "/en/").select("id", "linked_id")


@query(
    "I6_playlist_links",
    sql("""SELECT s_suppkey AS link_id, CASE WHEN s_suppkey % 4 < 2 THEN CAST(s_suppkey AS VARCHAR)
        WHEN s_suppkey % 4 = 3 THEN '99999999' END AS playlist_id,
        CASE WHEN s_suppkey % 4 < 2 THEN s_name END AS name FROM supplier"""),
)
def i6(s):
    links = s.read("supplier").selectExpr(
        "s_suppkey AS link_id",
        """CASE s_suppkey % 4 WHEN 0 THEN concat('spotify:playlist:', s_suppkey)
          WHEN 1 THEN concat('https://open.spotify.com/playlist/', s_suppkey, '?si=x1')
          WHEN 2 THEN concat('https://open.spotify.com/album/', s_suppkey)
          ELSE '  spotify:playlist:99999999 ' END AS link""",
    )
    return payloads.resolve_links(links, s.playlists).select("link_id", "playlist_id", "name")


@query(
    "I7_tag_payloads",
    sql("""SELECT p_partkey AS track_id, 0 AS i, p_name AS name, CAST(p_partkey % 101 AS INT) AS cnt FROM part WHERE p_size % 3 = 0
      UNION ALL SELECT p_partkey, 1, p_type, 0 FROM part WHERE p_size % 3 = 0
      UNION ALL SELECT p_partkey, 0, p_brand, 17 FROM part WHERE p_size % 3 = 1"""),
)
def i7(s):
    raw = s.read("part").selectExpr(
        "p_partkey AS track_id",
        """CASE p_size % 3
          WHEN 0 THEN concat('{"toptags":{"tag":[{"name":"', p_name, '","count":', p_partkey % 101,
            '},{"count":5},{"name":"', p_type, '"}]}}')
          WHEN 1 THEN concat('{"toptags":{"tag":{"name":"', p_brand, '","count":"17"}}}')
          ELSE '{"toptags":{}}' END AS payload""",
    )
    t = raw.select("track_id", F.posexplode(payloads.normalise_tags(F.col("payload"))).alias("i", "t"))
    return t.select("track_id", "i", "t.name", F.col("t.count").alias("cnt"))


def feature_payloads(s):
    return s.read("part").selectExpr(
        "concat('rb', p_partkey) AS id",
        """concat('{"id":"rb', p_partkey, '","energy":', p_size / 64e0, ',"valence":',
          CASE WHEN p_size % 7 = 0 THEN 'null' ELSE '0.25' END,
          CASE WHEN p_size % 2 = 0 THEN concat(',"tempo":', p_size) ELSE '' END, '}') AS payload""",
    )


def foreign_ids(s):
    return s.source_tracks.filter(F.col("reccobeats_id").isNotNull()).select(
        F.col("reccobeats_id").alias("id"), F.col("track_id").alias("linked_id")
    )


@query(
    "I8_feature_payloads",
    sql("""SELECT p_partkey AS track_id, round(p_size / 64e0, 6) AS energy,
      CASE WHEN p_size % 7 <> 0 THEN 25e-2 END AS valence,
      CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS DOUBLE) ELSE 0e0 END AS tempo, 0e0 AS liveness
      FROM part WHERE p_size % 5 > 0"""),
)
def i8(s):
    f = payloads.features_by_track(feature_payloads(s), foreign_ids(s))
    return f.select("track_id", r6("energy").alias("energy"), "valence", "tempo", "liveness")


@query(
    "I9_fuse",
    sql("""SELECT t.track_id, t.title, round(CASE WHEN p.p_size % 5 > 0 THEN p.p_size / 64e0 END, 6) AS energy,
      CAST(CASE WHEN has_tags THEN 2 ELSE 0 END AS INT) AS tags, reccobeats_id
      FROM tracks t JOIN part p ON p.p_partkey = t.track_id"""),
)
def i9(s):
    bare = s.source_tracks.select("track_id", "title")
    feats = payloads.features_by_track(feature_payloads(s), foreign_ids(s))
    tags = s.source_tracks.filter(F.size("tags") > 0).select("track_id", "tags")
    ids = foreign_ids(s).select(F.col("linked_id").alias("track_id"), F.col("id").alias("reccobeats_id"))
    fused = payloads.fuse(bare, feats, tags, ids)
    return fused.select(
        "track_id", "title", r6("energy").alias("energy"), F.size("tags").alias("tags"), "reccobeats_id"
    )


@query(
    "I10_merge_features",
    sql("""SELECT l_suppkey AS playlist_id, l_partkey AS track_id, l_orderkey * 16 + l_linenumber AS pos,
      CASE WHEN l_linenumber <> 7 THEN CAST(epoch(l_shipdate) AS BIGINT) END AS added, round(energy, 6) AS energy
      FROM lineitem LEFT JOIN (SELECT track_id, energy FROM tracks WHERE has_af) t ON t.track_id = l_partkey"""),
)
def i10(s):
    items = s.read("lineitem").selectExpr(
        "l_suppkey AS playlist_id",
        "l_partkey AS track_id",
        "l_orderkey * 16 + l_linenumber AS pos",
        """CASE WHEN l_linenumber <> 7 THEN date_format(l_shipdate, "yyyy-MM-dd'T'HH:mm:ss'Z'")
           ELSE 'soon' END AS added_at""",
    )
    feats = s.source_tracks.filter(F.col("audio_features").isNotNull()).select("track_id", "audio_features.energy")
    merged = payloads.merge_features(items, feats)
    return merged.select(
        "playlist_id", "track_id", "pos", F.unix_timestamp("added_at").alias("added"), r6("energy").alias("energy")
    )


def listing_payloads(s):
    return s.read("supplier").selectExpr(
        """concat('{"id":"', s_suppkey, '"', CASE WHEN s_suppkey % 5 <> 0 THEN concat(',"name":"', s_name, '"') ELSE '' END,
          ',"images":', CASE WHEN s_suppkey % 3 = 0 THEN '[]' ELSE concat('[{"url":"u', s_suppkey, '"},{"url":"v"}]') END,
          ',"owner":{"display_name":"n', s_nationkey, '"}',
          CASE s_suppkey % 4 WHEN 0 THEN concat(',"tracks":{"total":', s_nationkey, '}')
            WHEN 1 THEN concat(',"tracks":', s_nationkey) WHEN 2 THEN ',"tracks":"many"' ELSE '' END,
          CASE s_suppkey % 6 WHEN 0 THEN ',"total_tracks":0' WHEN 1 THEN ',"total_tracks":77' ELSE '' END, '}') AS payload"""
    )


@query(
    "I11_metadata",
    sql("""SELECT CAST(s_suppkey AS VARCHAR) AS playlist_id, CASE WHEN s_suppkey % 5 <> 0 THEN s_name ELSE 'Unknown' END AS name,
      'n' || s_nationkey AS owner, CASE WHEN s_suppkey % 3 <> 0 THEN 'u' || s_suppkey END AS image_url,
      CASE WHEN s_suppkey % 4 = 0 THEN s_nationkey END AS total_tracks FROM supplier"""),
)
def i11(s):
    return payloads.metadata(listing_payloads(s)).drop("description", "snapshot_id")


@query(
    "I12_listing",
    sql("""SELECT CAST(s_suppkey AS VARCHAR) AS playlist_id, CASE WHEN s_suppkey % 5 <> 0 THEN s_name END AS name,
      CAST(CASE WHEN s_suppkey % 6 = 1 THEN 77 WHEN s_suppkey % 4 < 2 THEN s_nationkey ELSE 0 END AS INT) AS total_tracks,
      'n' || s_nationkey AS owner FROM supplier"""),
)
def i12(s):
    return payloads.listing(listing_payloads(s)).select("playlist_id", "name", "total_tracks", "owner")


# --- sinks -------------------------------------------------------------------


@query("I13_insights")
def i13(s):
    return sinks.insights(s)


@query(
    "I13_insights_anomalies",
    sql("""SELECT playlist_id, CAST(row_number() OVER (PARTITION BY playlist_id ORDER BY anomaly_score DESC, pos, track_id)
        AS INT) AS place, track_id FROM rows r JOIN (SELECT playlist_id, max(cluster_id) AS cluster_id FROM clusters
        WHERE kept GROUP BY playlist_id, label) USING (playlist_id, cluster_id) WHERE is_anomaly"""),
)
def i13b(s):
    """Read back from the written lines: place of each anomaly."""
    line = "page bigint, anomalies array<struct<track_id: bigint>>"
    doc = sinks.insights(s).filter("kind = 'anomalies'").select("playlist_id", F.from_json("json", line).alias("d"))
    at = doc.select("playlist_id", F.col("d.page").alias("page"), F.posexplode("d.anomalies").alias("i", "t"))
    return at.select(
        "playlist_id", (F.col("page") * sinks.PAGE_ROWS + F.col("i") + 1).cast("int").alias("place"), "t.track_id"
    )


_SUMMARY_LINE = """playlist_name string, summary struct<num_tracks: bigint, num_eligible: bigint, num_excluded_missing_all: bigint,
  num_excluded_insufficient_audio_cluster: bigint, num_clusters: bigint, num_anomalies: bigint, anomaly_score_cutoff: double>"""
_CENTROID = "struct<audio_means: map<string, double>, top_tags: array<string>, tag_weights_top: map<string, double>>"
# One text per cluster: its words in order, and its means and weights by name, six digits.
_TAG_LINES = """SELECT playlist_id, cluster_id, string_agg(term, '|' ORDER BY rank) AS top_tags,
  sum(weight) AS weights FROM top_tags GROUP BY 1, 2"""
_MEAN_SUM = " + ".join(f"coalesce({f}, 0)" for f in FEATURES)
_SUMMARY_SQL = """playlist_id, name AS playlist_name, num_tracks, num_eligible, num_excluded_missing_all,
  num_excluded_insufficient_audio_cluster, num_clusters, num_anomalies, round(anomaly_score_cutoff, 6) AS anomaly_score_cutoff"""


def head_lines(lines):
    """Name and summary of the playlists, read back from the written heads."""
    doc = lines.filter("kind = 'head'").select("playlist_id", F.from_json("json", _SUMMARY_LINE).alias("d"))
    return doc.select("playlist_id", "d.playlist_name", "d.summary.*").withColumn(
        "anomaly_score_cutoff", r6("anomaly_score_cutoff")
    )


def centroid_columns(c):
    """What the SQL twins compare of a centroid: feature count, sums, words."""
    total = lambda m: F.aggregate(F.map_values(m), F.lit(0e0), lambda a, x: a + F.coalesce(x, F.lit(0e0)))
    return [
        r6(total(c["audio_means"])).alias("means"),
        F.array_join(c["top_tags"], "|").alias("top_tags"),
        r6(total(c["tag_weights_top"])).alias("weights"),
    ]


@query("I13_insights_heads", sql(f"SELECT {_SUMMARY_SQL}, (SELECT count(*) FROM playlists) AS num_playlists FROM summary"))
def i13c(s):
    lines = sinks.insights(s)
    payload = lines.filter("kind = 'payload'").select(F.from_json("json", "num_playlists bigint").alias("p"))
    return head_lines(lines).withColumn("num_playlists", payload.select("p.num_playlists").scalar())


@query(
    "I13_insights_clusters",
    sql(f"""SELECT playlist_id, label, cluster_id, size, round(means, 6) AS means, coalesce(top_tags, '') AS top_tags,
      round(coalesce(weights, 0), 6) AS weights FROM (SELECT playlist_id, label, cluster_id, size, {_MEAN_SUM} AS means FROM clusters WHERE kept
        QUALIFY row_number() OVER (PARTITION BY playlist_id, label ORDER BY cluster_id DESC) = 1)
      LEFT JOIN tag_lines USING (playlist_id, cluster_id)""", {"tag_lines": _TAG_LINES}),
)
def i13d(s):
    line = f"clusters map<string, struct<cluster_id: int, size: bigint, centroid_features: {_CENTROID}>>"
    doc = sinks.insights(s).filter("kind = 'head'").select("playlist_id", F.from_json("json", line).alias("d"))
    at = doc.select("playlist_id", F.explode("d.clusters").alias("label", "c"))
    return at.select("playlist_id", "label", "c.cluster_id", "c.size", *centroid_columns(F.col("c.centroid_features")))


@query(
    "I13_insights_members",
    sql("""SELECT playlist_id, label, CAST(row_number() OVER (PARTITION BY playlist_id, label ORDER BY pos, track_id)
        AS INT) AS place, track_id FROM rows r JOIN (SELECT playlist_id, max(cluster_id) AS cluster_id FROM clusters
        WHERE kept GROUP BY playlist_id, label) USING (playlist_id, cluster_id)"""),
)
def i13e(s):
    return read_back(sinks.insights(s), "cluster", "label string", "tracks")


def read_back(lines, kind, key, items):
    """Place and track of every item on the pages of one kind; ``key`` is the page's own column."""
    line = f"{key}, page bigint, {items} array<struct<track_id: bigint>>"
    doc = lines.filter(F.col("kind") == kind).select("playlist_id", F.from_json("json", line).alias("d"))
    name = key.split()[0]
    at = doc.select("playlist_id", f"d.{name}", "d.page", F.posexplode(f"d.{items}").alias("i", "t"))
    place = (F.col("page") * sinks.PAGE_ROWS + F.col("i") + 1).cast("int").alias("place")
    return at.select("playlist_id", name, place, "t.track_id")


@query("I14_enriched_export")
def i14(s):
    return sinks.enriched_export(s.library, s.playlists)


@query(
    "I14_enriched_roundtrip",
    sql("""SELECT playlist_id, CAST(row_number() OVER (PARTITION BY playlist_id ORDER BY pos, track_id) AS INT) AS place,
      track_id, title, round(energy, 6) AS energy FROM lib"""),
)
def i14b(s):
    line = "tracks array<struct<track_id: bigint, title: string, audio_features: struct<energy: double>>>"
    doc = sinks.enriched_export(s.library, s.playlists).select("playlist_id", "page", F.from_json("json", line).alias("d"))
    at = doc.select("playlist_id", "page", F.posexplode("d.tracks").alias("i", "t"))
    return at.select(
        "playlist_id",
        (F.col("page") * sinks.PAGE_ROWS + F.col("i") + 1).cast("int").alias("place"),
        "t.track_id",
        "t.title",
        r6("t.audio_features.energy").alias("energy"),
    )


@query("I15_analysis_export")
def i15(s):
    return sinks.analysis_export(s)


@query(
    "I15_analysis_roundtrip",
    sql("""SELECT playlist_id, cluster_id, CAST(row_number() OVER (PARTITION BY playlist_id, cluster_id ORDER BY pos, track_id)
      AS INT) AS place, track_id, round(anomaly_score, 6) AS anomaly_score, is_anomaly FROM rows WHERE cluster_id IS NOT NULL"""),
)
def i15b(s):
    line = """cluster_id int, page bigint,
      tracks array<struct<track_id: bigint, anomaly_score: double, is_anomaly: boolean>>"""
    doc = sinks.analysis_export(s).filter("kind = 'cluster'").select("playlist_id", F.from_json("json", line).alias("d"))
    at = doc.select("playlist_id", "d.cluster_id", "d.page", F.posexplode("d.tracks").alias("i", "t"))
    return at.select(
        "playlist_id",
        "cluster_id",
        (F.col("page") * sinks.PAGE_ROWS + F.col("i") + 1).cast("int").alias("place"),
        "t.track_id",
        r6("t.anomaly_score").alias("anomaly_score"),
        "t.is_anomaly",
    )


@query("I15_analysis_heads", sql(f"SELECT {_SUMMARY_SQL} FROM summary"))
def i15c(s):
    return head_lines(sinks.analysis_export(s))


@query(
    "I15_analysis_clusters",
    sql(f"""SELECT playlist_id, cluster_id, label, size, round({_MEAN_SUM}, 6) AS means, coalesce(top_tags, '') AS top_tags,
      round(coalesce(weights, 0), 6) AS weights FROM clusters LEFT JOIN tag_lines USING (playlist_id, cluster_id) WHERE kept""",
        {"tag_lines": _TAG_LINES}),
)
def i15d(s):
    line = "clusters array<struct<cluster_id: int, label: string, size: bigint, centroid: string>>"
    doc = sinks.analysis_export(s).filter("kind = 'head'").select("playlist_id", F.from_json("json", line).alias("d"))
    at = doc.select("playlist_id", F.explode("d.clusters").alias("c"))
    at = at.select("playlist_id", "c.*").withColumn("centroid", F.from_json("centroid", _CENTROID))
    return at.select("playlist_id", "cluster_id", "label", "size", *centroid_columns(F.col("centroid")))


@query(
    "I15_analysis_moods",
    sql("""SELECT playlist_id, label AS mood_label, string_agg(DISTINCT CAST(cluster_id AS VARCHAR), '|' ORDER BY CAST(cluster_id AS VARCHAR))
      AS cluster_ids, CAST(sum(size) AS BIGINT) AS num_tracks FROM clusters WHERE kept GROUP BY 1, 2"""),
)
def i15e(s):
    line = "moods map<string, struct<cluster_ids: array<string>, num_tracks: bigint>>"
    doc = sinks.analysis_export(s).filter("kind = 'head'").select("playlist_id", F.from_json("json", line).alias("d"))
    at = doc.select("playlist_id", F.explode("d.moods").alias("mood_label", "m"))
    return at.select("playlist_id", "mood_label", F.array_join(F.array_sort("m.cluster_ids"), "|").alias("cluster_ids"), "m.num_tracks")


@query(
    "I15_analysis_mood_pages",
    sql("""SELECT playlist_id, label AS mood_label, CAST(row_number() OVER (PARTITION BY playlist_id, label
      ORDER BY cluster_id, pos, track_id) AS INT) AS place, track_id FROM rows WHERE cluster_id IS NOT NULL"""),
)
def i15f(s):
    return read_back(sinks.analysis_export(s), "mood", "mood_label string", "tracks")


@query(
    "I15_analysis_excluded_pages",
    sql("""SELECT playlist_id, CAST(row_number() OVER (PARTITION BY playlist_id ORDER BY pos, track_id) AS INT) AS place,
      track_id FROM rows WHERE NOT eligible"""),
)
def i15g(s):
    line = "page bigint, excluded_track_ids array<bigint>"
    doc = sinks.analysis_export(s).filter("kind = 'excluded'").select("playlist_id", F.from_json("json", line).alias("d"))
    at = doc.select("playlist_id", "d.page", F.posexplode("d.excluded_track_ids").alias("i", "track_id"))
    return at.select("playlist_id", (F.col("page") * sinks.PAGE_ROWS + F.col("i") + 1).cast("int").alias("place"), "track_id")


# --- state -------------------------------------------------------------------

# The events before this time are the state that is known, those after it the news;
# together they are the whole table.
OLDER = "ts < timestamp_ntz'2024-01-16 00:00:00'"
NEWER = "ts >= timestamp_ntz'2024-01-16 00:00:00'"

_SNAP = """SELECT user_id, event_type AS playlist_id, 's' || max(event_id) AS snapshot_id FROM events GROUP BY 1, 2"""
_CACHED = """SELECT user_id, event_type AS playlist_id,
  CASE WHEN user_id % 17 = 0 THEN '' ELSE 's' || max(event_id) END AS cached_snapshot, count(*) > 1 AS resolves
  FROM events WHERE ts < TIMESTAMP '2024-01-16 00:00:00' GROUP BY 1, 2"""
_WANTED = """SELECT DISTINCT user_id, event_type AS playlist_id FROM events
  UNION ALL SELECT DISTINCT user_id, 'missing' FROM events"""


@query(
    "C1_changed_playlists",
    sql("""SELECT w.user_id, w.playlist_id, c.snapshot_id, k.cached_snapshot,
      CASE WHEN k.cached_snapshot <> '' AND k.cached_snapshot = c.snapshot_id AND k.resolves THEN 'hit' ELSE 'fetch' END AS status
      FROM wanted w JOIN snap c USING (user_id, playlist_id) LEFT JOIN kept_ k USING (user_id, playlist_id)""",
        {"snap": _SNAP, "kept_": _CACHED, "wanted": _WANTED}),
)
def c1(s):
    ev = s.read("events").withColumnRenamed("event_type", "playlist_id")
    keys = ["user_id", "playlist_id"]
    last = F.concat(F.lit("s"), F.max("event_id"))
    current = ev.groupBy(*keys).agg(last.alias("snapshot_id"))
    cached = ev.filter(OLDER).groupBy(*keys).agg(
        F.when(F.col("user_id") % 17 == 0, "").otherwise(last).alias("cached_snapshot"),
        (F.count(F.lit(1)) > 1).alias("resolves"),
    )
    wanted = ev.select(*keys).distinct().unionByName(
        ev.select("user_id", F.lit("missing").alias("playlist_id")).distinct()
    )
    return state.changed_playlists(wanted, current, cached)


# Entries added before this day are what the first run sees, all entries what the second one sees.
CUT = "2001-11-02 00:00:00"


def incremental_runs(s):
    """Two incremental runs over one stored state: the entries before the cut, then all.

    A playlist's snapshot names its entries, so only playlists with later entries are
    analysed again; the rows of the others come from the first run.
    """
    if not hasattr(s, "_incremental"):
        folder = state_folder(s.spark)
        for cond in (f"added_at < timestamp_ntz'{CUT}'", "TRUE"):
            raw = tables.raw_items(s.spark, s.sf_dir).filter(cond)
            count = raw.groupBy("playlist_id").agg(F.concat_ws("-", F.count(F.lit(1)), F.max("pos")).alias("snapshot_id"))
            lists = s.playlists.drop("snapshot_id").join(count, "playlist_id", "left").fillna("none", "snapshot_id")
            items = keep_first(raw, ["playlist_id", "track_id"], ["pos", "added_at"])
            s._incremental = incremental.run(folder, lists, items, s.source_tracks, assign=tables.planted, reads=tables.PLANTED, rows=raw.count)
    return s._incremental


_RUNS = {
    "snaps": "SELECT playlist_id, count(*) || '-' || max(pos) AS snapshot_id FROM raw_items GROUP BY 1",
    "snaps0": f"""SELECT playlist_id, count(*) || '-' || max(pos) AS cached_snapshot FROM raw_items
      WHERE added_at < TIMESTAMP '{CUT}' GROUP BY 1""",
    "runs": """SELECT playlist_id, coalesce(snapshot_id, 'none') AS snapshot_id,
      CASE WHEN coalesce(snapshot_id, 'none') = coalesce(cached_snapshot, 'none') THEN 'hit' ELSE 'fetch' END AS status
      FROM playlists_ LEFT JOIN snaps USING (playlist_id) LEFT JOIN snaps0 USING (playlist_id)""",
    "playlists_": "SELECT s_suppkey AS playlist_id FROM supplier",
}


@query(
    "C1_incremental_summary",
    sql("""SELECT * REPLACE (round(anomaly_score_cutoff, 6) AS anomaly_score_cutoff) FROM summary JOIN runs USING (playlist_id)""", _RUNS),
)
def c1b(s):
    status, out = incremental_runs(s)
    both = out["summary"].join(status.select("playlist_id", "status"), "playlist_id")
    return both.withColumn("anomaly_score_cutoff", r6("anomaly_score_cutoff"))


@query(
    "C1_incremental_tracks",
    sql("""SELECT playlist_id, snapshot_id, track_id, cluster_id, label, round(anomaly_score, 6) AS anomaly_score, is_anomaly
      FROM rows JOIN runs USING (playlist_id)""", _RUNS),
)
def c1c(s):
    rows = incremental_runs(s)[1]["tracks"]
    return rows.select(
        "playlist_id", "snapshot_id", "track_id", "cluster_id", "label", r6("anomaly_score").alias("anomaly_score"), "is_anomaly"
    )


def stored_tracks(s):
    """Tracks known so far: those of the older entries."""
    old = s.read("lineitem").filter("l_shipdate < timestamp_ntz'1996-01-01 00:00:00'")
    return old.groupBy(F.col("l_partkey").alias("track_id")).agg(F.lit("stored").alias("origin"))


_STORED = """SELECT DISTINCT l_partkey AS track_id, 'stored' AS origin FROM lineitem
  WHERE l_shipdate < TIMESTAMP '1996-01-01 00:00:00'"""


@query(
    "C2_known_unknown",
    sql("""SELECT track_id, CASE WHEN track_id IN (SELECT track_id FROM stored) THEN 'known' ELSE 'unknown' END AS status
      FROM (SELECT DISTINCT track_id FROM raw_items)""", {"stored": _STORED}),
)
def c2(s):
    wanted, stored = s.items.select("track_id").distinct(), stored_tracks(s)
    known = state.known_tracks(wanted, stored).withColumn("status", F.lit("known"))
    return known.unionByName(state.unknown_tracks(wanted, stored).withColumn("status", F.lit("unknown")))


@query(
    "C3_merge_in_order",
    sql("""SELECT playlist_id, pos, track_id, CASE WHEN track_id IN (SELECT track_id FROM stored) THEN 'stored' ELSE 'fresh' END AS origin
      FROM items WHERE track_id IN (SELECT track_id FROM stored) OR track_id IN (SELECT track_id FROM tracks WHERE has_af)""",
        {"stored": _STORED}),
)
def c3(s):
    stored = stored_tracks(s)
    found = s.source_tracks.filter(F.col("audio_features").isNotNull()).select("track_id")
    fresh = state.unknown_tracks(found, stored).withColumn("origin", F.lit("fresh"))
    return state.merge_in_order(s.items.drop("added_at"), stored, fresh)


_INCOMING = """SELECT track_id, origin FROM (SELECT l_partkey AS track_id, l_returnflag || l_linestatus AS origin,
  row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_returnflag || l_linestatus) AS rn FROM lineitem)
  WHERE rn = 1"""


def incoming_tracks(s):
    return s.read("lineitem").select(
        F.col("l_partkey").alias("track_id"),
        "l_orderkey",
        "l_linenumber",
        F.concat("l_returnflag", "l_linestatus").alias("origin"),
    )


@query(
    "C4_insert_only",
    sql("""SELECT * FROM stored UNION ALL SELECT * FROM incoming WHERE track_id NOT IN (SELECT track_id FROM stored)""",
        {"stored": _STORED, "incoming": _INCOMING}),
)
def c4(s):
    return state.insert_only(stored_tracks(s), incoming_tracks(s), ["l_orderkey", "l_linenumber"])


@query(
    "C8_upsert_tracks",
    sql("""SELECT * FROM incoming UNION ALL SELECT * FROM stored WHERE track_id NOT IN (SELECT track_id FROM incoming)""",
        {"stored": _STORED, "incoming": _INCOMING}),
)
def c8(s):
    first = keep_first(incoming_tracks(s), ["track_id"], ["l_orderkey", "l_linenumber"])
    return state.upsert_tracks(stored_tracks(s), first)


def _records(cond):
    return f"""SELECT user_id, event_type AS playlist_id, 's' || max(event_id) AS snapshot_id, count(*) AS total
      FROM events WHERE {cond} GROUP BY 1, 2"""


_REC = {
    "old_rec": _records("ts < TIMESTAMP '2024-01-16 00:00:00'"),
    "new_rec": _records("ts >= TIMESTAMP '2024-01-16 00:00:00'"),
    "all_rec": _records("TRUE"),
}


def records(s, cond):
    return s.read("events").filter(cond).groupBy("user_id", F.col("event_type").alias("playlist_id")).agg(
        F.concat(F.lit("s"), F.max("event_id")).alias("snapshot_id"), F.count(F.lit(1)).alias("total")
    )


@query(
    "C5_replace_playlists",
    sql("""SELECT * FROM new_rec UNION ALL SELECT o.* FROM old_rec o
      WHERE NOT EXISTS (SELECT 1 FROM new_rec n WHERE n.user_id = o.user_id AND n.playlist_id = o.playlist_id)""", _REC),
)
def c5(s):
    return state.replace_playlists(records(s, OLDER), records(s, NEWER))


@query(
    "C6_resolve",
    sql("""SELECT source AS user_id, doc_id AS playlist_id, CAST(pos - 1 AS INT) AS pos, word AS track_id, uses FROM (
        SELECT source, doc_id, generate_subscripts(ws, 1) AS pos, unnest(ws) AS word
        FROM (SELECT source, doc_id, regexp_extract_all(lower(text), '{T}') AS ws FROM documents))
      JOIN (SELECT word AS w, count(*) AS uses FROM (
        SELECT unnest(regexp_extract_all(lower(text), '{T}')) AS word FROM benchmark) GROUP BY 1) ON w = word""".replace("{T}", TOKEN)),
)
def c6(s):
    stored = s.read("documents").select(
        F.col("source").alias("user_id"), F.col("doc_id").alias("playlist_id"), tokens(F.col("text")).alias("track_ids")
    )
    words = s.read("benchmark").select(F.explode(tokens(F.col("text"))).alias("track_id"))
    return state.resolve(stored, words.groupBy("track_id").agg(F.count(F.lit(1)).alias("uses")))


_GONE = {**_REC, "gone": "SELECT DISTINCT user_id FROM events WHERE event_type = 'error' AND value > 150"}


def gone_users(s):
    """Users with a costly error: the ones to be cleared."""
    return s.read("events").filter("event_type = 'error' AND value > 150").select("user_id").distinct()


@query("C7_of_users", sql("SELECT * FROM all_rec WHERE user_id IN (SELECT user_id FROM gone)", _GONE))
def c7(s):
    return state.of_users(records(s, "TRUE"), gone_users(s))


@query("C7_clear_users", sql("SELECT * FROM all_rec WHERE user_id NOT IN (SELECT user_id FROM gone)", _GONE))
def c7b(s):
    return state.without_users(records(s, "TRUE"), gone_users(s))
