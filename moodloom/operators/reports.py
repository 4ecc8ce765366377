"""Report tables over the analysis: anomalies, profiles, previews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodloom.functions.columns import MOODS, severity
from moodloom.operators.grouping import top_in_group
from moodloom.schema import DISPLAY_RANGE, FEATURES



def _by_score():
    return [F.desc("anomaly_score"), F.asc("pos"), F.asc("track_id")]


# --- anomalies ---------------------------------------------------------------


def anomaly_listing(rows: DataFrame, playlists: DataFrame) -> DataFrame:
    """All anomalies of all playlists, highest score first, with their number."""
    hit = rows.filter("is_anomaly")
    total = hit.agg(F.count(F.lit(1)))
    named = hit.join(playlists.select("playlist_id", F.col("name").alias("playlist_name")), "playlist_id")
    return named.select(
        "playlist_id",
        "playlist_name",
        "track_id",
        "title",
        "cluster_id",
        "anomaly_score",
        "reason",
        total.scalar().alias("num_anomalies"),
    ).orderBy(F.desc("anomaly_score"), "playlist_id", "track_id")


def severity_histogram(rows: DataFrame) -> DataFrame:
    kind = severity(F.col("anomaly_score"))
    return (
        rows.filter("is_anomaly")
        .groupBy("playlist_id")
        .agg(*[F.count_if(kind == k).alias(k) for k in ("severe", "moderate", "mild")])
    )


def outliers_by_cluster(rows: DataFrame, k: int = 5) -> DataFrame:
    """Outliers of each cluster: how many, and the ``k`` highest."""
    hit = rows.filter("is_anomaly").select("playlist_id", "cluster_id", "track_id", "pos", "anomaly_score")
    keys = ["playlist_id", "cluster_id"]
    size = hit.groupBy(*keys).agg(F.count(F.lit(1)).alias("outliers"))
    return top_in_group(hit, keys, _by_score(), k).join(size, keys).drop("pos")


def ranked_outliers(rows: DataFrame, k: int = 8) -> DataFrame:
    hit = rows.filter("is_anomaly").select("playlist_id", "track_id", "pos", "anomaly_score")
    return top_in_group(hit, ["playlist_id"], _by_score(), k).drop("pos")


def parse_reasons(rows: DataFrame, strict: bool = False) -> DataFrame:
    """Facts back out of the stored sentences, one row per deviation, and one
    without a deviation for a sentence that names none.

    ``strict`` needs a unit word behind the number, as the reader of these
    sentences did, and so finds tempo and loudness only.
    """
    # The patterns of the sentence.
    with_unit = r"((?:higher|lower) \w+ by [\d.]+ \w+)"
    any_number = r"((?:higher|lower) \w+ by [0-9]+(?:[.][0-9]+)?(?: \w+)?)"
    found = F.regexp_extract_all("reason", F.lit(with_unit if strict else any_number), F.lit(1))
    facts = rows.filter("is_anomaly").select(
        "playlist_id",
        "track_id",
        F.regexp_extract("reason", "dominant mood '([^']+)'", 1).alias("mood"),
        F.regexp_extract("reason", r"distance_score=([\d.]+\d)", 1).try_cast("double").alias("score"),
        F.explode_outer(found).alias("m"),
    )
    parts = r"^(higher|lower) (\w+) by ([0-9]+(?:[.][0-9]+)?)"
    return facts.select(
        "playlist_id",
        "track_id",
        "mood",
        "score",
        F.regexp_extract("m", parts, 1).alias("direction"),
        F.regexp_extract("m", parts, 2).alias("feature"),
        F.regexp_extract("m", parts, 3).cast("double").alias("amount"),
    )


def deviation_counts(facts: DataFrame) -> DataFrame:
    """Deviations per feature and direction. A track names a feature once, so
    the number of tracks needs no distinct."""
    return facts.where("feature is not null").groupBy("feature", "direction").agg(
        F.count(F.lit(1)).alias("deviations"),
        F.count(F.lit(1)).alias("tracks"),
        F.round(F.sum("amount"), 2).alias("total"),
    )


# --- playlists and clusters --------------------------------------------------


def missingness(lib: DataFrame) -> DataFrame:
    tagged = F.size("tags") > 0
    return lib.groupBy("playlist_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("has_af").alias("with_features"),
        F.count_if(tagged).alias("with_tags"),
        F.count_if(~F.col("has_af") & ~tagged).alias("missing_both"),
    )


def missing_examples(lib: DataFrame, k: int = 10) -> DataFrame:
    bare = lib.filter(~F.col("has_af")).select("playlist_id", "track_id", "title", "pos")
    return top_in_group(bare, ["playlist_id"], [F.asc("pos"), F.asc("track_id")], k).drop("pos")


def overall(summary: DataFrame, clusters: DataFrame) -> DataFrame:
    """Totals over all playlists; clusters count as distinct labels each."""
    labels = (
        clusters.filter("kept")
        .select("playlist_id", "label")
        .distinct()
        .agg(F.count(F.lit(1)))
    )
    return summary.agg(
        F.sum("num_tracks").alias("tracks"),
        F.sum("num_eligible").alias("eligible"),
        F.sum("num_anomalies").alias("anomalies"),
    ).select("tracks", "eligible", labels.scalar().alias("clusters"), "anomalies")


def profile(clusters: DataFrame) -> DataFrame:
    """Means of the kept clusters weighted by size; a null mean counts as 0."""
    return clusters.filter("kept").groupBy("playlist_id").agg(
        *[
            (F.sum(F.coalesce(F.col(f), F.lit(0.0)) * F.col("size")) / F.sum("size")).alias(f)
            for f in FEATURES
        ]
    )


def display_scale(profiles: DataFrame) -> DataFrame:
    """Features mapped from their display range to 0..100 and clipped."""

    def bar(f):
        low, high = DISPLAY_RANGE.get(f, (0.0, 1.0))
        scaled = (F.col(f) - low) / (high - low) * 100
        return F.greatest(F.least(scaled, F.lit(100.0)), F.lit(0.0)).alias(f)

    return profiles.select("playlist_id", *[bar(f) for f in FEATURES])


def presence(clusters: DataFrame) -> DataFrame:
    """Label x playlist in long form: the size of the mood in the playlist."""
    return clusters.filter("kept").groupBy("label", "playlist_id").agg(F.sum("size").alias("size"))


def presence_matrix(clusters: DataFrame) -> DataFrame:
    """The same as a matrix: one row per playlist, one column per mood. The
    moods are a fixed set, so the width does not grow with the data."""
    return presence(clusters).groupBy("playlist_id").pivot("label", list(MOODS)).agg(F.first("size"))


def label_spread(clusters: DataFrame, playlists: DataFrame) -> DataFrame:
    """In how many playlists a label occurs; in all of ``playlists`` (one row
    each, empty ones count too), or in exactly one."""
    pairs = clusters.filter("kept").select("playlist_id", "label").distinct()
    total = playlists.agg(F.count(F.lit(1)))
    count = pairs.groupBy("label").agg(F.count(F.lit(1)).alias("playlists"))
    return count.select(
        "label",
        "playlists",
        (F.col("playlists") == total.scalar()).alias("in_all"),
        (F.col("playlists") == 1).alias("in_one"),
    )


def cluster_share(clusters: DataFrame, summary: DataFrame) -> DataFrame:
    """Share of a cluster in the eligible tracks, in percent."""
    return (
        clusters.filter("kept")
        .join(summary.select("playlist_id", "num_eligible"), "playlist_id")
        .select(
            "playlist_id",
            "cluster_id",
            "label",
            (F.col("size") / F.col("num_eligible") * 100).alias("percent"),
        )
    )


def by_label(clusters: DataFrame) -> DataFrame:
    """One cluster per label, the last one on a repeated label."""
    kept = clusters.filter("kept")
    rest = [c for c in kept.columns if c not in ("playlist_id", "label", "cluster_id")]
    last = kept.groupBy("playlist_id", "label").agg(
        F.max_by(F.struct("cluster_id", *rest), "cluster_id").alias("c")
    )
    return last.select("playlist_id", "label", "c.*")


def digest(clusters: DataFrame, rows: DataFrame, tags: DataFrame, summary: DataFrame) -> DataFrame:
    """Cluster digest: label, size, anomalies, five tags, cutoff (null when
    the playlist has none)."""
    keys = ["playlist_id", "cluster_id"]
    hit = rows.filter("is_anomaly").groupBy(*keys).agg(F.count(F.lit(1)).alias("anomalies"))
    words = (
        tags.filter(F.col("rank") <= 5)
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("t"))
        .select(*keys, F.array_join(F.col("t.term"), ", ").alias("tags"))
    )
    return (
        clusters.filter("kept")
        .select(*keys, "label", "size")
        .join(hit, keys, "left")
        .join(words, keys, "left")
        .join(summary.select("playlist_id", F.col("anomaly_score_cutoff").alias("cutoff")), "playlist_id")
        .withColumn("anomalies", F.coalesce("anomalies", F.lit(0)))
    )


def flat_tracks(lib: DataFrame, playlists: DataFrame) -> DataFrame:
    return lib.join(playlists.select("playlist_id", F.col("name").alias("playlist_name")), "playlist_id")


def preview(lib: DataFrame, k: int = 3, tags: int = 5) -> DataFrame:
    """First ``k`` tracks per playlist with artists, features and tags."""
    cut = lib.select(
        "playlist_id", "track_id", "pos", "title", "artists", "tags", "energy", "valence", "tempo"
    )
    return top_in_group(cut, ["playlist_id"], [F.asc("pos"), F.asc("track_id")], k).select(
        "playlist_id",
        "rn",
        "track_id",
        "title",
        F.array_join(F.col("artists.name"), ", ").alias("artists"),
        "energy",
        "valence",
        "tempo",
        F.array_join(F.slice(F.col("tags.name"), 1, tags), ", ").alias("tags"),
    )


def cluster_sample(rows: DataFrame, k: int = 5) -> DataFrame:
    members = rows.filter(F.col("cluster_id").isNotNull())
    order = [F.asc("pos"), F.asc("track_id")]
    return top_in_group(members, ["playlist_id", "cluster_id"], order, k)


def cluster_tags(clusters: DataFrame, tags: DataFrame, k: int = 6) -> DataFrame:
    kept = clusters.filter("kept").select("playlist_id", "cluster_id")
    return tags.filter(F.col("rank") <= k).join(kept, ["playlist_id", "cluster_id"])


def preview_clusters(clusters: DataFrame, k: int = 8) -> DataFrame:
    kept = clusters.filter("kept").select("playlist_id", "cluster_id", "label", "size")
    return top_in_group(kept, ["playlist_id"], [F.asc("cluster_id")], k)


def preview_rows(rows: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` strongest anomalies and the first ``k`` rows left out."""
    cols = ["playlist_id", "track_id", "pos", "anomaly_score"]
    odd = top_in_group(rows.filter("is_anomaly").select(*cols), ["playlist_id"], _by_score(), k)
    out = top_in_group(
        rows.filter(F.col("cluster_id").isNull()).select(*cols),
        ["playlist_id"],
        [F.asc("pos"), F.asc("track_id")],
        k,
    )
    return (
        odd.withColumn("kind", F.lit("anomaly"))
        .unionByName(out.withColumn("kind", F.lit("excluded")))
        .select("playlist_id", "kind", "rn", "track_id")
    )
