"""Queries: comparison, recommendation, nearest neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from moodloom.checks.ctes import with_ctes as sql
from moodloom.checks.registry import query, r6
from moodloom.functions.columns import MOODS
from moodloom.operators import compare, recommend
from moodloom.operators.reports import presence_matrix
from moodloom.plans.pipeline import aggregate, analyze
from moodloom.schema import FEATURES

# --- comparison --------------------------------------------------------------


def requests(s):
    """Compare requests: each order asks for the suppliers on it, by id."""
    asked = s.read("lineitem").select(F.col("l_orderkey").alias("request_id"), "l_suppkey")
    return asked.groupBy("request_id").agg(F.array_sort(F.collect_set("l_suppkey")).alias("playlist_ids"))


_PAIRS = """SELECT a.request_id, a.p AS playlist_id_a, b.p AS playlist_id_b FROM asked a JOIN asked b
  ON a.request_id = b.request_id AND a.p < b.p"""
_ASKED = "SELECT DISTINCT l_orderkey AS request_id, l_suppkey AS p FROM lineitem"


@query(
    "M4_compare",
    sql("""SELECT r.request_id, r.playlist_id_a, r.playlist_id_b, a.mood_label, round(a.proportion, 6) AS proportion_a,
      round(a.pb, 6) AS proportion_b, round(greatest(0, 1 - abs(a.proportion - a.pb)), 6) AS similarity
      FROM asked_pairs r LEFT JOIN (SELECT x.playlist_id AS ia, y.playlist_id AS ib, x.mood_label, x.proportion, y.proportion AS pb
        FROM moods x JOIN moods y USING (mood_label) WHERE x.rank <= 6 AND y.rank <= 6) a
      ON a.ia = r.playlist_id_a AND a.ib = r.playlist_id_b""", {"asked": _ASKED, "asked_pairs": _PAIRS}),
)
def m4(s):
    c = compare.compare(s.distribution, requests(s))
    return c.select(
        "request_id",
        "playlist_id_a",
        "playlist_id_b",
        "mood_label",
        *[r6(x).alias(x) for x in ("proportion_a", "proportion_b", "similarity")],
    )


@query(
    "M4_rejected",
    sql("""SELECT request_id, CAST(count(*) AS INT) AS num_playlists, 'compare_playlists requires at least 2 playlists' AS error
      FROM asked GROUP BY 1 HAVING count(*) < 2""", {"asked": _ASKED}),
)
def m4b(s):
    return compare.rejected(requests(s))


_PRINT = {
    "fp_raw": "\n UNION ALL ".join(
        f"SELECT playlist_id, 'af:{f}' AS dim, coalesce((avg({f}) - ({lo}e0)) / {hi - lo}e0, 0) AS x FROM elig GROUP BY 1"
        for f in FEATURES
        for lo, hi in [{"loudness": (-20, 0), "tempo": (60, 200)}.get(f, (0, 1))]
    )
    + """ UNION ALL SELECT playlist_id, 'tag:' || term, sum(tf) / any_value(t) FROM (
        SELECT *, CAST(sum(tf) OVER (PARTITION BY playlist_id) AS DOUBLE) AS t FROM lterms) GROUP BY 1, 2""",
    "fp": "SELECT playlist_id, dim, x / sqrt(sum(x*x) OVER (PARTITION BY playlist_id)) AS x FROM fp_raw",
}


# All pairs of fingerprints; a dimension that one side lacks counts as 0.
_PRINT_PAIRS = {
    "fp_pairs": """SELECT ia, ib, c, sqrt(apart + CASE WHEN shared = na THEN 0 ELSE greatest(qa - sa, 0) END
          + CASE WHEN shared = nb THEN 0 ELSE greatest(qb - sb, 0) END) AS e
        FROM (SELECT a.playlist_id AS ia, b.playlist_id AS ib, sum(a.x * b.x) AS c, sum((a.x - b.x) * (a.x - b.x)) AS apart,
            sum(a.x * a.x) AS sa, sum(b.x * b.x) AS sb, count(*) AS shared
          FROM fp a JOIN fp b USING (dim) WHERE a.playlist_id < b.playlist_id GROUP BY 1, 2)
        JOIN (SELECT playlist_id AS ia, count(*) AS na, sum(x * x) AS qa FROM fp GROUP BY 1) USING (ia)
        JOIN (SELECT playlist_id AS ib, count(*) AS nb, sum(x * x) AS qb FROM fp GROUP BY 1) USING (ib)""",
}


@query("D1_fingerprints", sql("SELECT playlist_id, dim, round(x, 6) AS x FROM fp", _PRINT))
def d1(s):
    return _prints(s).withColumn("x", r6("x"))


def _prints(s):
    from moodloom.operators.features import library_terms

    return compare.fingerprints(s.entries.filter("eligible AND playlist_id IS NOT NULL"), library_terms(s.entries))


@query(
    "D1_similar_pairs",
    sql("""SELECT request_id, playlist_id_a, playlist_id_b, round(c, 6) AS cosine, round(e, 6) AS euclidean
      FROM asked_pairs JOIN fp_pairs ON ia = playlist_id_a AND ib = playlist_id_b""",
        {"asked": _ASKED, "asked_pairs": _PAIRS, **_PRINT, **_PRINT_PAIRS}),
)
def d1b(s):
    sim = compare.fingerprint_similarity(_prints(s), requests(s))
    return sim.select(
        "request_id", "playlist_id_a", "playlist_id_b", r6("cosine").alias("cosine"), r6("euclidean").alias("euclidean")
    )


@query(
    "D1_most_similar",
    sql("""SELECT ia AS playlist_id, ib AS other_id, round(c, 6) AS cosine, round(e, 6) AS euclidean,
        CAST(row_number() OVER (PARTITION BY ia ORDER BY round(c, 9) DESC, ib) AS INT) AS rank
      FROM (SELECT ia, ib, c, e FROM fp_pairs UNION ALL SELECT ib, ia, c, e FROM fp_pairs)
      QUALIFY row_number() OVER (PARTITION BY ia ORDER BY round(c, 9) DESC, ib) <= 5""",
        {**_PRINT, **_PRINT_PAIRS}),
)
def d1d(s):
    top = compare.most_similar(_prints(s), 5)
    return top.withColumns({"cosine": r6("cosine"), "euclidean": r6("euclidean")})


@query(
    "D1_outlier_ranking",
    sql("""SELECT a.playlist_id, round(sum(a.x * b.x) / ((SELECT count(DISTINCT playlist_id) FROM fp) - 1), 6) AS mean_cosine
      FROM fp a JOIN fp b ON a.dim = b.dim AND a.playlist_id <> b.playlist_id GROUP BY 1""", _PRINT),
)
def d1c(s):
    return compare.mean_similarity(_prints(s)).withColumn("mean_cosine", r6("mean_cosine"))


# --- the aggregated corpus ---------------------------------------------------


@query(
    "R1_aggregated_corpus",
    sql("""SELECT 'aggregated' AS playlist_id, track_id, pos, playlist_id AS from_playlist_id FROM items
      QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY items.playlist_id, pos) = 1"""),
)
def r1(s):
    return aggregate(s.items)


def aggregated(s):
    """The same analysis over the one virtual playlist, planted assignment."""
    from moodloom.sources.tables import planted

    one = s.spark.range(1).select(F.lit("aggregated").alias("playlist_id"), F.lit("Aggregated").alias("name"))
    return analyze(one, aggregate(s.items), s.source_tracks, assign=planted)


@query(
    "R1_aggregated_clusters",
    sql("""SELECT 'aggregated' AS playlist_id, cluster_id, count(*) AS size, round(avg(energy), 6) AS energy,
      round(avg(tempo), 6) AS tempo FROM (SELECT *, CAST(CASE WHEN has_af THEN track_id % 4 + 4 * (p_size % 2) ELSE 8 END AS INT)
      AS cluster_id FROM tracks WHERE eligible AND track_id IN (SELECT track_id FROM items)) GROUP BY 2"""),
)
def r1b(s):
    c = aggregated(s).clusters
    return c.select("playlist_id", "cluster_id", "size", r6("energy").alias("energy"), r6("tempo").alias("tempo"))


# --- recommendation ----------------------------------------------------------

_STATS = ", ".join(f"avg({f}) AS {f}_m, stddev_pop({f}) AS {f}_s" for f in FEATURES)
_Z = ", ".join(f"coalesce(({f} - {f}_m) / {f}_s, 0e0)" for f in FEATURES)
_REC = {
    "cat": f"""SELECT track_id, [{_Z}] AS vec FROM (SELECT * FROM tracks WHERE has_af)
        CROSS JOIN (SELECT {_STATS} FROM tracks WHERE has_af)""",
    "chosen": "SELECT playlist_id, label, max(cluster_id) AS cluster_id FROM clusters WHERE kept GROUP BY 1, 2",
    "inside": "SELECT r.* FROM rows r JOIN chosen c ON c.playlist_id = r.playlist_id AND c.cluster_id = r.cluster_id",
    "seed": """SELECT playlist_id, cluster_id, track_id, pos, (row_number() OVER (PARTITION BY playlist_id, cluster_id
        ORDER BY pos, track_id) - 1) // 5 AS chunk FROM inside WHERE NOT is_anomaly""",
    "ask": """SELECT playlist_id, cluster_id, chunk, list(v ORDER BY j) AS vec FROM (
        SELECT playlist_id, cluster_id, chunk, j, avg(v) AS v FROM (
          SELECT playlist_id, cluster_id, chunk, generate_subscripts(vec, 1) AS j, unnest(vec) AS v
          FROM seed JOIN cat USING (track_id)) GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3""",
    "calls": "SELECT playlist_id, cluster_id, count(*) AS calls FROM ask GROUP BY 1, 2",
    # A chunk cannot need more candidates than its cluster has chunks.
    "ranked": """SELECT r.* FROM (SELECT *, row_number() OVER (PARTITION BY playlist_id, cluster_id, chunk
          ORDER BY distance, track_id) AS rn
        FROM (SELECT a.playlist_id, a.cluster_id, a.chunk, c.track_id, round(list_distance(a.vec, c.vec), 9) AS distance
          FROM ask a CROSS JOIN cat c WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.playlist_id = a.playlist_id
            AND i.cluster_id = a.cluster_id AND i.track_id = c.track_id))) r
        JOIN calls USING (playlist_id, cluster_id) WHERE rn <= greatest(10, calls)""",
    "near": "SELECT * FROM ranked WHERE rn <= 10",
    # Greedy matching by distance: a round gives every pair that is the first of its chunk and of its track.
    "turn": """SELECT 0 AS round, playlist_id, cluster_id, chunk, track_id, distance, false AS won FROM ranked
      UNION ALL SELECT * FROM (
        SELECT round + 1 AS round, playlist_id, cluster_id, chunk, track_id, distance,
          row_number() OVER (PARTITION BY playlist_id, cluster_id, chunk ORDER BY distance, track_id) = 1
          AND row_number() OVER (PARTITION BY playlist_id, cluster_id, track_id ORDER BY distance, chunk) = 1 AS won
        FROM (SELECT *, bool_or(won) OVER (PARTITION BY playlist_id, cluster_id, chunk)
            OR bool_or(won) OVER (PARTITION BY playlist_id, cluster_id, track_id) AS out FROM turn) WHERE NOT out)""",
    "given": "SELECT playlist_id, cluster_id, chunk, track_id, distance FROM turn WHERE won",
}


def _parts(s):
    chosen = recommend.label_clusters(s.clusters)
    inside = s.seeded
    return chosen, inside, recommend.seeds(inside)


@query("R2_label_seeds", sql("SELECT playlist_id, label, cluster_id FROM chosen", _REC))
def r2(s):
    return recommend.label_clusters(s.clusters).select("playlist_id", "label", "cluster_id")


@query("R3_seeds", sql("SELECT playlist_id, cluster_id, track_id, pos FROM seed", _REC))
def r3(s):
    return _parts(s)[2]


@query("R4_chunks", sql("SELECT playlist_id, cluster_id, track_id, pos, CAST(chunk AS BIGINT) AS chunk FROM seed", _REC))
def r4(s):
    return recommend.chunks(_parts(s)[2])


@query(
    "R5_targets",
    sql("""SELECT q.playlist_id, q.cluster_id, CAST(q.chunk AS BIGINT) AS chunk, q.seeds, round(m.energy, 6) AS energy,
      round(m.tempo, 6) AS tempo, round(m.valence, 6) AS valence FROM (
        SELECT playlist_id, cluster_id, chunk, count(*) AS seeds FROM seed GROUP BY 1, 2, 3) q
      JOIN means m USING (playlist_id, cluster_id)""", _REC),
)
def r5(s):
    chosen, _, seed = _parts(s)
    t = recommend.targets(recommend.chunks(seed), chosen)
    return t.select(
        "playlist_id", "cluster_id", "chunk", "seeds", *[r6(f).alias(f) for f in ("energy", "tempo", "valence")]
    )


def _found(s):
    return recommend.nearest_outside(s.asked, s.seeded, s.catalog)


@query(
    "R6_nearest",
    sql("""SELECT playlist_id, cluster_id, CAST(chunk AS BIGINT) AS chunk, track_id, CAST(rn AS INT) AS rn,
      round(distance, 6) AS distance FROM near""", _REC),
)
def r6_nearest(s):
    return _found(s).withColumn("distance", r6("distance"))


@query(
    "R7_recommendations",
    sql("""SELECT g.playlist_id, g.cluster_id, c.label, CAST(g.chunk AS BIGINT) AS chunk, g.track_id, t.title, t.reccobeats_id,
      t.artist, t.duration_ms, t.popularity, round(g.distance, 6) AS distance FROM given g JOIN chosen c USING (playlist_id, cluster_id) JOIN tracks t ON t.track_id = g.track_id""", _REC),
)
def r7(s):
    cols = ["playlist_id", "cluster_id", "label", "chunk", "track_id", "title", "reccobeats_id", "duration_ms", "popularity"]
    artist = F.col("artists")[0]["name"].alias("artist")
    return s.recommendations.select(*cols, artist, r6("distance").alias("distance"))


@query(
    "R7_counts",
    sql("""SELECT playlist_id, cluster_id, num_input_tracks, coalesce(n, 0) AS num_recommendations FROM (
      SELECT playlist_id, cluster_id, count(*) AS num_input_tracks FROM seed GROUP BY 1, 2)
      LEFT JOIN (SELECT playlist_id, cluster_id, count(*) AS n FROM given GROUP BY 1, 2) USING (playlist_id, cluster_id)""", _REC),
)
def r7b(s):
    return recommend.counts(s.recommendations, _parts(s)[2])


@query(
    "R7_clean_results",
    sql("""SELECT playlist_id, cluster_id, track_id, call FROM (SELECT l_suppkey AS playlist_id, CAST(l_linenumber AS INT) AS cluster_id,
        CASE WHEN l_returnflag <> 'R' THEN l_partkey END AS track_id, l_orderkey AS call FROM lineitem) r
      WHERE track_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM inside i WHERE i.playlist_id = r.playlist_id
        AND i.cluster_id = r.cluster_id AND i.track_id = r.track_id)
      QUALIFY row_number() OVER (PARTITION BY playlist_id, cluster_id, track_id ORDER BY call) = 1""", _REC),
)
def r7c(s):
    """Entries of the orders taken as results of an outside recommender."""
    results = s.read("lineitem").select(
        F.col("l_suppkey").alias("playlist_id"),
        F.col("l_linenumber").cast("int").alias("cluster_id"),
        F.when(F.col("l_returnflag") != "R", F.col("l_partkey")).alias("track_id"),
        F.col("l_orderkey").alias("call"),
    )
    return recommend.clean_results(results, _parts(s)[1], ["call"])


@query(
    "R8_per_playlist",
    sql("""SELECT p.playlist_id, p.name, coalesce(c, 0) AS clusters, coalesce(n, 0) AS recommendations FROM playlists p
      LEFT JOIN (SELECT playlist_id, count(DISTINCT cluster_id) AS c, count(*) AS n FROM given GROUP BY 1) USING (playlist_id)""", _REC),
)
def r8(s):
    """One row per playlist of the result set, also without any cluster."""
    return recommend.per_playlist(s.recommendations, s.playlists)


@query(
    "R9_normalise",
    sql("""SELECT CASE WHEN p_size % 3 <> 0 THEN CAST(p_partkey AS VARCHAR) END AS spotify_id, 'rb' || p_partkey AS reccobeats_id,
      CASE WHEN p_size % 4 <> 0 THEN p_name ELSE '' END AS title, p_brand || ':a' || p_size AS artists,
      CAST(CASE WHEN p_size % 2 = 0 THEN p_size * 1000 ELSE 0 END AS INT) AS duration_ms, CAST(p_size AS INT) AS popularity FROM part"""),
)
def r9(s):
    raw = s.read("part").selectExpr(
        """to_json(named_struct('id', concat('rb', p_partkey),
          'href', concat('https://music.example.com/', CASE WHEN p_size % 3 = 0 THEN 'album/' ELSE 'track/' END, p_partkey),
          'trackTitle', CASE WHEN p_size % 4 <> 0 THEN p_name END,
          'artists', array(named_struct('name', p_brand, 'href', concat('https://music.example.com/artist/a', p_size))),
          'durationMs', CASE WHEN p_size % 2 = 0 THEN p_size * 1000 END, 'popularity', p_size)) AS payload"""
    )
    flat = recommend.normalise(raw)
    return flat.withColumn(
        "artists",
        F.array_join(F.transform("artists", lambda a: F.concat_ws(":", a["name"], a["spotify_id"])), ", "),
    )


@query("R10_total", sql("SELECT count(*) AS total FROM given", _REC))
def r10(s):
    return s.recommendations.agg(F.count(F.lit(1)).alias("total"))


@query(
    "R11_write_batches",
    sql("""SELECT playlist_id, CAST(batch AS BIGINT) AS batch, CAST(count(*) AS INT) AS uris, min('spotify:track:' || track_id) AS first_uri
      FROM (SELECT *, (row_number() OVER (PARTITION BY playlist_id ORDER BY pos, track_id) - 1) // 100 AS batch FROM items)
      GROUP BY 1, 2"""),
)
def r11(s):
    b = recommend.write_batches(s.items, ["playlist_id"], [F.asc("pos"), F.asc("track_id")])
    return b.select("playlist_id", "batch", F.size("uris").alias("uris"), F.array_min("uris").alias("first_uri"))


# --- described variants ------------------------------------------------------

_D = {
    "cat": _REC["cat"],
    "members_": "SELECT playlist_id, track_id FROM lib",
    "ex": """SELECT track_id, generate_subscripts(vec, 1) AS j, unnest(vec) AS v FROM cat""",
}


def _nearest(ask: str, k: int) -> str:
    """The k nearest of the catalog to each row (playlist_id, qid, vec)."""
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY playlist_id, qid ORDER BY distance, track_id) AS rn
      FROM (SELECT a.playlist_id, a.qid, c.track_id, round(list_distance(a.vec, c.vec), 9) AS distance
        FROM ({ask}) a CROSS JOIN cat c WHERE NOT EXISTS (SELECT 1 FROM members_ m
          WHERE m.playlist_id = a.playlist_id AND m.track_id = c.track_id))) WHERE rn <= {k}"""


_DOM = """SELECT playlist_id, 0 AS qid, list(v ORDER BY j) AS vec FROM (SELECT r.playlist_id, j, avg(v) AS v FROM rows r
  JOIN dominant d ON d.playlist_id = r.playlist_id AND d.cluster_id = r.assigned_cluster_id
  JOIN ex ON ex.track_id = r.track_id GROUP BY 1, 2) GROUP BY 1"""
_ODD = """SELECT r.playlist_id, r.track_id AS qid, c.vec FROM rows r JOIN cat c USING (track_id) WHERE r.is_anomaly"""
_MOOD = """SELECT playlist_id, mood_label AS qid, vec FROM (SELECT DISTINCT playlist_id, label AS mood_label FROM rows WHERE label IS NOT NULL)
  JOIN (SELECT mood_label, list(v ORDER BY j) AS vec FROM (SELECT label AS mood_label, j, avg(v) AS v FROM rows JOIN ex USING (track_id)
    WHERE label IS NOT NULL GROUP BY 1, 2) GROUP BY 1) USING (mood_label)"""


def _catalog(s):
    return recommend.catalog_vectors(s.source_tracks)


@query(
    "D2_fix_anomalies",
    sql("""SELECT r.playlist_id, r.track_id, n.track_id AS replacement, round(n.distance, 6) AS distance, CAST(n.rn AS INT) AS rn
      FROM rows r JOIN near_dom n USING (playlist_id) WHERE r.is_anomaly""", {**_D, "ask_dom": _DOM, "near_dom": _nearest("SELECT * FROM ask_dom", 3)}),
)
def d2(s):
    return recommend.fix_anomalies(s.tracks, s.clusters, s.library, _catalog(s), index=s.catalog).withColumn("distance", r6("distance"))


@query(
    "D3_lean_in",
    sql("""SELECT playlist_id, qid AS anomaly, track_id, round(distance, 6) AS distance, CAST(rn AS INT) AS rn FROM near_odd""",
        {**_D, "near_odd": _nearest(_ODD, 3)}),
)
def d3(s):
    return recommend.lean_in(s.tracks, s.library, _catalog(s), index=s.catalog).withColumn("distance", r6("distance"))


@query(
    "D4_for_mood",
    sql("""SELECT playlist_id, qid AS mood_label, track_id, round(distance, 6) AS distance, CAST(rn AS INT) AS rn FROM near_mood""",
        {**_D, "near_mood": _nearest(_MOOD, 5)}),
)
def d4(s):
    return recommend.for_mood(s.mood_tracks, s.library, _catalog(s), index=s.catalog).withColumn("distance", r6("distance"))


@query(
    "D5_ranked_selection",
    sql("""SELECT r.playlist_id, r.track_id, r.title, round(list_distance(c.vec, m.vec), 6) AS distance FROM rows r
      JOIN cat c USING (track_id) JOIN (SELECT list(v ORDER BY j) AS vec FROM (SELECT j, avg(v) AS v FROM rows JOIN ex USING (track_id)
        WHERE label = 'high_energy_happy' GROUP BY 1)) m ON true WHERE r.label = 'high_energy_happy'""", _D),
)
def d5(s):
    return recommend.ranked_selection(s.mood_tracks, _catalog(s), "high_energy_happy").withColumn("distance", r6("distance"))


@query(
    "M10_presence_matrix",
    sql("SELECT playlist_id, "
        + ", ".join(f"CAST(sum(size) FILTER (label = '{m}') AS BIGINT) AS {m}" for m in MOODS)
        + " FROM clusters WHERE kept GROUP BY 1"),
)
def m10_matrix(s):
    return presence_matrix(s.clusters)
