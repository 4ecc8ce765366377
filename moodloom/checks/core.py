"""Queries: features, clusters with a given assignment, anomalies, summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from moodloom.checks.ctes import TOKEN
from moodloom.checks.ctes import with_ctes as sql
from moodloom.checks.registry import query, r6
from moodloom.functions.columns import tag_weight, tokens
from moodloom.operators import analysis, features, reports
from moodloom.operators.grouping import rank_in_group
from moodloom.schema import FEATURES
from moodloom.sources import tables

_R = ", ".join(f"round({f}, 6) AS {f}" for f in FEATURES)


def rounded():
    return [r6(f).alias(f) for f in FEATURES]


@query("F1_audio_columns", sql(f"SELECT track_id, {_R} FROM tracks"))
def f1(s):
    return features.audio_columns(s.source_tracks).select("track_id", *rounded())


@query("F2_eligibility", sql("SELECT track_id, eligible FROM tracks"))
def f2(s):
    return s.source_tracks.select("track_id", features.eligible().alias("eligible"))


@query(
    "F3_tag_weights",
    sql("""SELECT track_id, ord, name,
      CAST(greatest(least(round_even(cnt / 20e0, 0), 5), 1) AS INT) AS weight FROM tags"""),
)
def f3(s):
    t = s.source_tracks.select("track_id", F.posexplode("tags").alias("i", "t"))
    return t.select(
        "track_id", (F.col("i") + 1).alias("ord"), "t.name", tag_weight(F.col("t.count")).alias("weight")
    )


_DOC_TOKEN = """SELECT doc_id, source, CAST(n_chars % 101 AS INT) AS cnt,
   unnest(regexp_extract_all(lower(text), '{}')) AS term FROM documents"""


@query(
    "F4_tokens",
    sql("SELECT doc_id AS track_id, term, count(*) AS occurrences FROM words GROUP BY 1, 2",
        {"words": _DOC_TOKEN.replace("{}", TOKEN)}),
)
def f4(s):
    docs = s.read("documents")
    word = docs.select(F.col("doc_id").alias("track_id"), F.explode(tokens(F.col("text"))).alias("term"))
    return word.groupBy("track_id", "term").agg(F.count(F.lit(1)).alias("occurrences"))


_DOC_VOCAB = """SELECT source AS playlist_id, term,
   CAST(sum(greatest(least(round_even(cnt / 20e0, 0), 5), 1)) AS BIGINT) AS freq,
   count(DISTINCT doc_id) AS df FROM words GROUP BY 1, 2"""


@query(
    "F5_vocabulary_documents",
    sql("""SELECT playlist_id, term, freq, df, rn FROM (SELECT *,
      row_number() OVER (PARTITION BY playlist_id ORDER BY freq DESC, term) AS rn FROM counted)
      WHERE rn <= 200""",
        {"words": _DOC_TOKEN.replace("{}", TOKEN),
         "counted": _DOC_VOCAB}),
)
def f5(s):
    docs = tables.documents(s.spark, s.sf_dir)
    terms = features.token_weights(docs).join(docs.select("track_id", "playlist_id"), "track_id")
    return features.vocabulary(terms)


@query("F5_vocabulary", sql("SELECT playlist_id, term, freq, df, rn FROM vocab"))
def f5b(s):
    return features.vocabulary(features.library_terms(s.library))


@query("F6_tfidf", sql("SELECT playlist_id, track_id, term, round(w, 6) AS weight FROM tfidf"))
def f6(s):
    pairs = s.vectors.join(s.model.select("playlist_id", "vocab"), "playlist_id").select(
        "playlist_id",
        "track_id",
        F.explode(F.zip_with("vocab", "tag_vec", lambda v, w: F.struct(v["term"].alias("term"), w.alias("w")))).alias("t"),
    )
    return pairs.filter(F.col("t.w") > 0).select(
        "playlist_id", "track_id", "t.term", r6("t.w").alias("weight")
    )


@query(
    "F7_untagged_rows",
    sql("""SELECT e.playlist_id, count(*) AS n, count(*) FILTER (t.track_id IS NULL) AS without_terms
      FROM elig e LEFT JOIN (SELECT DISTINCT playlist_id, track_id FROM tfidf) t
      ON t.playlist_id = e.playlist_id AND t.track_id = e.track_id GROUP BY 1"""),
)
def f7(s):
    blank = ~F.exists("tag_vec", lambda x: x > 0)
    return s.vectors.groupBy("playlist_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(blank).alias("without_terms")
    )


@query("F8_scaled_audio", sql("""SELECT playlist_id, track_id, feature, round(z, 6) AS z FROM audio"""))
def f8(s):
    names = F.array(*[F.lit(f) for f in FEATURES])
    z = s.vectors.select(
        "playlist_id",
        "track_id",
        F.explode(F.zip_with(names, "audio", lambda n, x: F.struct(n.alias("feature"), x.alias("z")))).alias("a"),
    )
    return z.select("playlist_id", "track_id", "a.feature", r6("a.z").alias("z"))


@query(
    "F9_unit_vectors",
    sql("SELECT playlist_id, track_id, CAST(j AS INT) AS j, round(v, 6) AS v FROM dense WHERE round(v, 6) <> 0"),
)
def f9(s):
    x = s.vectors.select("playlist_id", "track_id", F.posexplode("vec").alias("j", "x"))
    return x.select("playlist_id", "track_id", "j", r6("x").alias("v")).filter(F.col("v") != 0)


_FULL = " AND ".join(f"{f} IS NOT NULL" for f in FEATURES)
_Q = ", ".join(f"quantile_cont({f}, [0.25, 0.5, 0.75]) AS {f}_q" for f in FEATURES)
_ROB = ", ".join(
    f"round(CASE WHEN {f}_q[3] = {f}_q[1] THEN 0e0 ELSE ({f} - {f}_q[2]) / ({f}_q[3] - {f}_q[1]) END, 6) AS {f}"
    for f in FEATURES
)


@query(
    "F10_robust_scale",
    sql(f"SELECT playlist_id, track_id, {_ROB} FROM whole JOIN qs USING (playlist_id)",
        {"whole": f"SELECT * FROM lib WHERE {_FULL}",
         "qs": f"SELECT playlist_id, {_Q} FROM whole GROUP BY 1"}),
)
def f10(s):
    return features.robust_scale(s.library).select("playlist_id", "track_id", *rounded())


# --- clusters with the given assignment -----------------------------------


@query(
    "K5_audio_means",
    sql(f"SELECT playlist_id, cluster_id, size, CAST(null_means AS INT) AS null_means, {_R} FROM means"),
)
def k5(s):
    return s.clusters.select("playlist_id", "cluster_id", "size", "null_means", *rounded())


@query("K6_kept_clusters", sql("SELECT playlist_id, cluster_id, size FROM clusters WHERE kept"))
def k6(s):
    return s.kept.select("playlist_id", "cluster_id", "size")


@query(
    "K7_top_tags",
    sql("SELECT playlist_id, cluster_id, CAST(rank AS INT) AS rank, term, round(weight, 6) AS weight FROM top_tags"),
)
def k7(s):
    return s.top_tags.select("playlist_id", "cluster_id", "rank", "term", r6("weight").alias("weight"))


@query("K8_mood_labels", sql("SELECT playlist_id, cluster_id, label FROM clusters WHERE kept"))
def k8(s):
    return s.kept.select("playlist_id", "cluster_id", "label")


# --- anomalies ---------------------------------------------------------------


@query("A1_distance", sql("SELECT playlist_id, track_id, cluster_id, round(distance, 6) AS distance FROM dist"))
def a1(s):
    return s.distances.select(
        "playlist_id", "track_id", "cluster_id", r6("distance").alias("distance")
    )


_LIB = {
    "el": """SELECT vec_id AS track_id, label AS cluster_id, generate_subscripts(embedding, 1) AS j,
        CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings""",
    "ec": "SELECT cluster_id, j, avg(v) AS c FROM el GROUP BY 1, 2",
    "ed": """SELECT track_id, cluster_id, sqrt(sum((v-c)*(v-c))) AS distance
        FROM el JOIN ec USING (cluster_id, j) GROUP BY 1, 2""",
}


@query(
    "A1_distance_vectors",
    sql("SELECT track_id, cluster_id, round(distance, 6) AS distance FROM ed", _LIB),
)
def a1b(s):
    lib = tables.vector_library(s.spark, s.sf_dir)
    return analysis.distances(lib).select("track_id", "cluster_id", r6("distance").alias("distance"))


@query("A2_score", sql("SELECT playlist_id, track_id, round(anomaly_score, 6) AS anomaly_score FROM scored"))
def a2(s):
    return s.scored.select("playlist_id", "track_id", r6("anomaly_score").alias("anomaly_score"))


@query("A3_flags", sql("SELECT playlist_id, track_id, rn, flagged FROM flagged"))
def a3(s):
    return s.flagged.select("playlist_id", "track_id", "rn", "flagged")


_ROWS = """playlist_id, track_id, cluster_id, round(anomaly_score, 6) AS anomaly_score, is_anomaly, reason"""


@query("A4_dropped_cluster_rows", sql(f"SELECT {_ROWS} FROM rows WHERE eligible AND cluster_id IS NULL"))
def a4(s):
    return _row_view(s.tracks.filter(F.col("eligible") & F.col("cluster_id").isNull()))


@query("A5_excluded_rows", sql(f"SELECT {_ROWS} FROM rows WHERE NOT eligible"))
def a5(s):
    return _row_view(s.tracks.filter(~F.col("eligible")))


def _row_view(rows):
    return rows.select(
        "playlist_id",
        "track_id",
        "cluster_id",
        r6("anomaly_score").alias("anomaly_score"),
        "is_anomaly",
        "reason",
    )


@query(
    "A6_dominant_cluster",
    sql(f"SELECT playlist_id, cluster_id AS dominant_cluster_id, label AS dominant_label, {_R} FROM dominant"),
)
def a6(s):
    return analysis.dominant(s.clusters).select(
        "playlist_id",
        "dominant_cluster_id",
        "dominant_label",
        *[r6(f"dom_{f}").alias(f) for f in FEATURES],
    )


@query(
    "A7_deltas",
    sql("SELECT playlist_id, track_id, CAST(rank AS INT) AS rank, feature, round(delta, 6) AS delta FROM deltas"),
)
def a7(s):
    d = s.tracks.select("playlist_id", "track_id", F.posexplode("deltas").alias("i", "d"))
    return d.select(
        "playlist_id", "track_id", (F.col("i") + 1).alias("rank"), "d.feature", r6("d.delta").alias("delta")
    )


@query("A7_track_analysis", sql(f"SELECT {_ROWS} FROM rows"))
def a7b(s):
    return _row_view(s.tracks)


@query(
    "A8_anomaly_listing",
    sql("""SELECT r.playlist_id, p.name AS playlist_name, r.track_id, r.title, r.cluster_id,
      round(r.anomaly_score, 6) AS anomaly_score, count(*) OVER () AS num_anomalies
      FROM rows r JOIN playlists p USING (playlist_id) WHERE r.is_anomaly"""),
)
def a8(s):
    return reports.anomaly_listing(s.tracks, s.playlists).withColumn(
        "anomaly_score", r6("anomaly_score")
    ).drop("reason")


@query(
    "A9_severity",
    sql("""SELECT playlist_id, count(*) FILTER (anomaly_score >= 9e-1) AS severe,
      count(*) FILTER (anomaly_score >= 85e-2 AND anomaly_score < 9e-1) AS moderate,
      count(*) FILTER (anomaly_score < 85e-2) AS mild FROM rows WHERE is_anomaly GROUP BY 1"""),
)
def a9(s):
    return reports.severity_histogram(s.tracks)


@query(
    "A10_outliers_by_cluster",
    sql("""SELECT playlist_id, cluster_id, outliers, CAST(rn AS INT) AS rn, track_id, round(anomaly_score, 6) AS anomaly_score
      FROM (SELECT *, count(*) OVER (PARTITION BY playlist_id, cluster_id) AS outliers,
        row_number() OVER (PARTITION BY playlist_id, cluster_id ORDER BY anomaly_score DESC, pos, track_id) AS rn
        FROM rows WHERE is_anomaly) WHERE rn <= 5"""),
)
def a10(s):
    return reports.outliers_by_cluster(s.tracks).withColumn("anomaly_score", r6("anomaly_score"))


def _parsed(unit):
    return sql(f"""SELECT feature, direction, count(*) AS deviations,
      count(DISTINCT (playlist_id, track_id)) AS tracks, round(sum(amount), 2) AS total FROM (
        SELECT playlist_id, track_id, regexp_extract(m, '(higher|lower) (\\w+) by ([\\d.]+)', 1) AS direction,
          regexp_extract(m, '(higher|lower) (\\w+) by ([\\d.]+)', 2) AS feature,
          CAST(regexp_extract(m, '(higher|lower) (\\w+) by ([0-9]+(?:[.][0-9]+)?)', 3) AS DOUBLE) AS amount
        FROM (SELECT playlist_id, track_id, unnest(regexp_extract_all(reason, '{unit}')) AS m
              FROM rows WHERE is_anomaly)) GROUP BY 1, 2""")


@query("A11_parsed_reasons_strict", _parsed(r"(?:higher|lower) \w+ by [\d.]+ \w+"))
def a11(s):
    return reports.deviation_counts(reports.parse_reasons(s.tracks, strict=True))


@query("A11_parsed_reasons", _parsed(r"(?:higher|lower) \w+ by [0-9]+(?:[.][0-9]+)?(?: \w+)?"))
def a11b(s):
    return reports.deviation_counts(reports.parse_reasons(s.tracks, strict=False))


@query(
    "A11_facts",
    sql(r"""SELECT playlist_id, track_id, regexp_extract(reason, 'dominant mood ''([^'']+)''', 1) AS mood,
      TRY_CAST(regexp_extract(reason, 'distance_score=([\d.]+\d)', 1) AS DOUBLE) AS score,
      regexp_extract(m, '^(higher|lower) (\w+) by ([0-9]+(?:[.][0-9]+)?)', 1) AS direction,
      regexp_extract(m, '^(higher|lower) (\w+) by ([0-9]+(?:[.][0-9]+)?)', 2) AS feature,
      TRY_CAST(regexp_extract(m, '^(higher|lower) (\w+) by ([0-9]+(?:[.][0-9]+)?)', 3) AS DOUBLE) AS amount
      FROM (SELECT playlist_id, track_id, reason, unnest(CASE WHEN len(f) = 0 THEN [NULL] ELSE f END) AS m FROM (
        SELECT *, regexp_extract_all(reason, '(?:higher|lower) \w+ by [0-9]+(?:[.][0-9]+)?(?: \w+)?') AS f
        FROM rows WHERE is_anomaly))"""),
)
def a11c(s):
    """Every deviation of every flagged track; one row without for a sentence that names none."""
    return reports.parse_reasons(s.tracks)


@query(
    "A12_ranked_outliers",
    sql("""SELECT playlist_id, CAST(rn AS INT) AS rn, track_id, round(anomaly_score, 6) AS anomaly_score FROM (
      SELECT *, row_number() OVER (PARTITION BY playlist_id ORDER BY anomaly_score DESC, pos, track_id) AS rn
      FROM rows WHERE is_anomaly) WHERE rn <= 8"""),
)
def a12(s):
    return reports.ranked_outliers(s.tracks, 8).withColumn("anomaly_score", r6("anomaly_score"))


# --- summaries ---------------------------------------------------------------


@query("M1_summary", sql("SELECT * REPLACE (round(anomaly_score_cutoff, 6) AS anomaly_score_cutoff) FROM summary"))
def m1(s):
    return s.summary.withColumn("anomaly_score_cutoff", r6("anomaly_score_cutoff"))


@query("M1_excluded_ids", sql("SELECT playlist_id, track_id FROM rows WHERE NOT eligible"))
def m1b(s):
    return s.excluded.select("playlist_id", "track_id")


@query(
    "M2_mood_index",
    sql("SELECT playlist_id, label AS mood_label, cluster_id, track_id, title FROM rows WHERE label IS NOT NULL"),
)
def m2(s):
    return s.mood_tracks.drop("pos")


@query(
    "M2_mood_clusters",
    sql("""SELECT playlist_id, label AS mood_label, string_agg(cluster_id, ',' ORDER BY cluster_id) AS cluster_ids,
      CAST(sum(size) AS BIGINT) AS num_tracks FROM clusters WHERE kept GROUP BY 1, 2"""),
)
def m2b(s):
    return s.moods.withColumn("cluster_ids", F.concat_ws(",", F.col("cluster_ids").cast("array<string>")))


@query(
    "M3_mood_distribution",
    sql("SELECT playlist_id, mood_label, size, round(proportion, 6) AS proportion, CAST(rank AS INT) AS rank FROM moods"),
)
def m3(s):
    return s.distribution.withColumn("proportion", r6("proportion"))


@query(
    "M5_select_by_mood",
    sql("""SELECT r.track_id, r.title, r.cluster_id, round(r.anomaly_score, 6) AS anomaly_score, r.is_anomaly,
      r.playlist_id, p.name AS playlist_name FROM rows r JOIN playlists p USING (playlist_id)
      WHERE r.label = 'high_energy_happy'"""),
)
def m5(s):
    return (
        analysis.select_by_mood(s.tracks, s.playlists, "high_energy_happy")
        .withColumn("anomaly_score", r6("anomaly_score"))
        .drop("reason")
    )


@query("M6_bundle", sql("SELECT playlist_id, name, num_clusters, num_tracks, num_eligible, num_anomalies FROM summary"))
def m6(s):
    return s.summary.select("playlist_id", "name", "num_clusters", "num_tracks", "num_eligible", "num_anomalies")


@query(
    "M7_missingness",
    sql("""SELECT playlist_id, count(*) AS total, count(*) FILTER (has_af) AS with_features,
      count(*) FILTER (has_tags) AS with_tags, count(*) FILTER (NOT has_af AND NOT has_tags) AS missing_both
      FROM lib GROUP BY 1"""),
)
def m7(s):
    return reports.missingness(s.library)


@query(
    "M7_missing_examples",
    sql("""SELECT playlist_id, CAST(rn AS INT) AS rn, track_id, title FROM (SELECT *,
      row_number() OVER (PARTITION BY playlist_id ORDER BY pos, track_id) AS rn FROM lib WHERE NOT has_af)
      WHERE rn <= 10"""),
)
def m7b(s):
    return reports.missing_examples(s.library)


@query(
    "M8_overall",
    sql("""SELECT CAST(sum(num_tracks) AS BIGINT) AS tracks, CAST(sum(num_eligible) AS BIGINT) AS eligible,
      (SELECT CAST(sum(c) AS BIGINT) FROM (SELECT count(DISTINCT label) AS c FROM clusters WHERE kept GROUP BY playlist_id)) AS clusters,
      CAST(sum(num_anomalies) AS BIGINT) AS anomalies FROM summary"""),
)
def m8(s):
    return reports.overall(s.summary, s.clusters)


_AVG = ", ".join(f"round(sum(coalesce({f}, 0) * size) / sum(size), 6) AS {f}" for f in FEATURES)
_AVG_RAW = ", ".join(f"sum(coalesce({f}, 0) * size) / sum(size) AS {f}" for f in FEATURES)


# The views read clusters by their label: of clusters with one label the last counts.
_NAMED = {
    "named": """SELECT * FROM clusters WHERE kept
      QUALIFY row_number() OVER (PARTITION BY playlist_id, label ORDER BY cluster_id DESC) = 1"""
}


@query("M9_profile", sql(f"SELECT playlist_id, {_AVG} FROM named GROUP BY 1", _NAMED))
def m9(s):
    return reports.profile(reports.by_label(s.clusters)).select("playlist_id", *rounded())


@query("M9_profile_of_all_clusters", sql(f"SELECT playlist_id, {_AVG} FROM clusters WHERE kept GROUP BY 1"))
def m9b(s):
    return reports.profile(s.clusters).select("playlist_id", *rounded())


@query(
    "M10_presence",
    sql("SELECT label, playlist_id, size FROM named", _NAMED),
)
def m10(s):
    return reports.presence(reports.by_label(s.clusters))


@query(
    "M10_shared_labels",
    sql("""SELECT label, n AS playlists, n = total AS in_all, n = 1 AS in_one FROM (
      SELECT label, count(DISTINCT playlist_id) AS n,
        (SELECT count(*) FROM summary) AS total
      FROM clusters WHERE kept GROUP BY 1)"""),
)
def m10b(s):
    return reports.label_spread(s.clusters, s.summary)


@query(
    "M11_cluster_share",
    sql("""SELECT c.playlist_id, c.cluster_id, c.label, round(c.size / CAST(s.num_eligible AS DOUBLE) * 100, 6) AS percent
      FROM named c JOIN summary s USING (playlist_id)""", _NAMED),
)
def m11(s):
    return reports.cluster_share(reports.by_label(s.clusters), s.summary).withColumn("percent", r6("percent"))


@query(
    "M12_clusters_by_label",
    sql("""SELECT playlist_id, label, cluster_id, size FROM clusters WHERE kept
      QUALIFY row_number() OVER (PARTITION BY playlist_id, label ORDER BY cluster_id DESC) = 1"""),
)
def m12(s):
    return reports.by_label(s.clusters).select("playlist_id", "label", "cluster_id", "size")


def _bar(f):
    lo, hi = {"loudness": (-20, 0), "tempo": (60, 200)}.get(f, (0, 1))
    return f"round(least(greatest(({f} - ({lo}e0)) / {hi - lo}e0 * 100, 0), 100), 6) AS {f}"


@query(
    "M13_scaled_profile",
    sql(f"SELECT playlist_id, {', '.join(_bar(f) for f in FEATURES)} FROM (SELECT playlist_id, {_AVG_RAW} FROM named GROUP BY 1)", _NAMED),
)
def m13(s):
    return reports.display_scale(reports.profile(reports.by_label(s.clusters))).select("playlist_id", *rounded())


@query(
    "M14_digest",
    sql("""SELECT c.playlist_id, c.cluster_id, c.label, c.size, coalesce(a.anomalies, 0) AS anomalies, t.tags,
      round(s.anomaly_score_cutoff, 6) AS cutoff FROM clusters c JOIN summary s USING (playlist_id)
      LEFT JOIN (SELECT playlist_id, cluster_id, count(*) AS anomalies FROM rows WHERE is_anomaly GROUP BY 1, 2) a
        ON a.playlist_id = c.playlist_id AND a.cluster_id = c.cluster_id
      LEFT JOIN (SELECT playlist_id, cluster_id, string_agg(term, ', ' ORDER BY rank) AS tags FROM top_tags
        WHERE rank <= 5 GROUP BY 1, 2) t ON t.playlist_id = c.playlist_id AND t.cluster_id = c.cluster_id
      WHERE c.kept"""),
)
def m14(s):
    return reports.digest(s.clusters, s.tracks, s.top_tags, s.summary).withColumn("cutoff", r6("cutoff"))


@query(
    "M15_flat_tracks",
    sql("SELECT p.name AS playlist_name, l.track_id, l.title FROM lib l JOIN playlists p USING (playlist_id)"),
)
def m15(s):
    return reports.flat_tracks(s.library, s.playlists).select("playlist_name", "track_id", "title")


@query(
    "M16_preview",
    sql("""SELECT playlist_id, CAST(rn AS INT) AS rn, track_id, title, artist AS artists,
      round(energy, 6) AS energy, round(valence, 6) AS valence, round(tempo, 6) AS tempo,
      (SELECT string_agg(name, ', ' ORDER BY ord) FROM tags t WHERE t.track_id = q.track_id) AS tags
      FROM (SELECT *, row_number() OVER (PARTITION BY playlist_id ORDER BY pos, track_id) AS rn FROM lib) q
      WHERE rn <= 3"""),
)
def m16(s):
    return reports.preview(s.library).select(
        "playlist_id", "rn", "track_id", "title", "artists",
        *[r6(f).alias(f) for f in ("energy", "valence", "tempo")], F.nullif("tags", F.lit("")).alias("tags"),
    )


@query(
    "M17_cluster_sample",
    sql("""SELECT playlist_id, cluster_id, CAST(rn AS INT) AS rn, track_id, title FROM (SELECT *,
      row_number() OVER (PARTITION BY playlist_id, cluster_id ORDER BY pos, track_id) AS rn
      FROM rows WHERE cluster_id IS NOT NULL) WHERE rn <= 5"""),
)
def m17(s):
    return reports.cluster_sample(s.tracks).select("playlist_id", "cluster_id", "rn", "track_id", "title")


@query(
    "M17_cluster_tags",
    sql("""SELECT c.playlist_id, c.cluster_id, CAST(t.rank AS INT) AS rank, t.term, round(t.weight, 6) AS weight
      FROM clusters c JOIN top_tags t USING (playlist_id, cluster_id) WHERE c.kept AND t.rank <= 6"""),
)
def m17b(s):
    return reports.cluster_tags(s.clusters, s.top_tags, 6).withColumn("weight", r6("weight"))


@query(
    "M18_preview_clusters",
    sql("""SELECT playlist_id, CAST(rn AS INT) AS rn, cluster_id, label, size FROM (SELECT *,
      row_number() OVER (PARTITION BY playlist_id ORDER BY cluster_id) AS rn FROM clusters WHERE kept) WHERE rn <= 8"""),
)
def m18(s):
    return reports.preview_clusters(s.clusters)


@query(
    "M18_preview_rows",
    sql("""SELECT playlist_id, kind, CAST(rn AS INT) AS rn, track_id FROM (
      SELECT playlist_id, 'anomaly' AS kind, track_id,
        row_number() OVER (PARTITION BY playlist_id ORDER BY anomaly_score DESC, pos, track_id) AS rn
      FROM rows WHERE is_anomaly
      UNION ALL
      SELECT playlist_id, 'excluded', track_id, row_number() OVER (PARTITION BY playlist_id ORDER BY pos, track_id)
      FROM rows WHERE cluster_id IS NULL) WHERE rn <= 10"""),
)
def m18b(s):
    return reports.preview_rows(s.tracks)


# --- described only: ranks, z-scores, order ----------------------------------


@query(
    "D6_percentile_rank",
    sql("""SELECT playlist_id, track_id, round(percent_rank() OVER (PARTITION BY playlist_id ORDER BY anomaly_score), 6)
      AS percentile_rank FROM scored"""),
)
def d6(s):
    return analysis.percentile_rank(s.scored).select(
        "playlist_id", "track_id", r6("percentile_rank").alias("percentile_rank")
    )


@query(
    "D6_flag_strategies",
    sql("""SELECT playlist_id, count(*) FILTER (rn <= 20) AS top_n,
      count(*) FILTER (rn <= greatest(ceil(5e-2 * n), 1)) AS top_percent,
      count(*) FILTER (anomaly_score >= 8e-1) AS above FROM flagged GROUP BY 1"""),
)
def d6b(s):
    keys = ["playlist_id"]
    top_n = analysis.flag_top(s.scored, 20).groupBy(*keys).agg(F.count_if("flagged").alias("top_n"))
    share = analysis.flag_fraction(s.scored, 0.05).groupBy(*keys).agg(F.count_if("flagged").alias("top_percent"))
    above = analysis.flag_threshold(s.scored, 0.8).groupBy(*keys).agg(F.count_if("flagged").alias("above"))
    return top_n.join(share, keys).join(above, keys)


@query(
    "D7_z_reasons",
    sql("""SELECT playlist_id, track_id, CAST(rank AS INT) AS rank, feature, round(z, 6) AS z FROM (
      SELECT *, row_number() OVER (PARTITION BY playlist_id, track_id ORDER BY round(abs(z), 9) DESC, j) AS rank
      FROM audio) WHERE rank <= 3"""),
)
def d7(s):
    z = features.z_reasons(features.z_scores(s.library, s.model))
    return z.select("playlist_id", "track_id", "rank", "feature", r6("z").alias("z"))


@query(
    "D8_order_distance",
    sql("""SELECT a.playlist_id, a.track_id, a.rn, round(sqrt(sum((x.v - y.v) * (x.v - y.v))), 6) AS step
      FROM ranked a LEFT JOIN ranked b ON b.playlist_id = a.playlist_id AND b.rn = a.rn - 1
      LEFT JOIN dense x ON x.playlist_id = a.playlist_id AND x.track_id = a.track_id
      LEFT JOIN dense y ON y.playlist_id = b.playlist_id AND y.track_id = b.track_id AND y.j = x.j
      GROUP BY 1, 2, 3""",
        {"ranked": """SELECT playlist_id, track_id, row_number() OVER (PARTITION BY playlist_id ORDER BY pos, track_id) AS rn
          FROM elig"""}),
)
def d8(s):
    ranked = rank_in_group(
        s.vectors.select("playlist_id", "track_id", "pos", "vec"),
        ["playlist_id"],
        [F.asc("pos"), F.asc("track_id")],
    )
    return features.order_distance(ranked).withColumn("step", r6("step"))
