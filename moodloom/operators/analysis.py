"""Scores, clusters, moods and summaries of all playlists.

Inputs: ``lib`` (features.library) and ``assigned``, the rows of
features.transform with a ``cluster_id``, learned or given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moodloom.functions.columns import (
    delta_text,
    deltas,
    distance,
    fixed,
    mood_label,
)
from moodloom.operators.grouping import DEALT, copies, rank_dealt, rank_in_group
from moodloom.operators.vectors import mean_vectors
from moodloom.schema import EXPLAINED, FEATURES

# The two reasons of tracks outside every kept cluster.
NO_AUDIO_CLUSTER = "Excluded: assigned cluster has insufficient audio feature coverage"
NO_DATA = "Excluded: missing both audio_features and tags"


def distances(assigned: DataFrame) -> DataFrame:
    """Distance of each track to the mean vector of its cluster.

    ``assigned``: (playlist_id, track_id, pos, vec, cluster_id).
    """
    center = mean_vectors(assigned, ["playlist_id", "cluster_id"], "vec", "center")
    return assigned.join(center, ["playlist_id", "cluster_id"]).select(
        "playlist_id",
        "track_id",
        "pos",
        "cluster_id",
        distance(F.col("vec"), F.col("center")).alias("distance"),
    )


def cluster_cells(cells: DataFrame, hot: DataFrame) -> DataFrame:
    """(playlist_id, cluster_id, size, center, tags): of each cluster the mean vector and the mean of
    the tag weights as (j, weight), both from the cells of ``features.sparse``.

    A usual playlist lies together and is summed up where it lies; only the ``hot`` ones move, as a
    row per cluster, number and task.
    """
    usual = _cluster_means(cells.filter("_salt = 0"), list(DEALT))
    if hot.isEmpty():
        return usual
    return usual.unionByName(_cluster_means(cells.filter("_salt <> 0"), ["playlist_id"]))


def _cluster_means(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Where all values of a number are one, that value is the mean, however many there are."""
    # There are always cells; the plain form would test that first, with all that makes them.
    one = cells.select(*keys, "cluster_id", F.inline_outer("cells"))
    sums = one.groupBy(*keys, "cluster_id", "j").agg(
        F.sum("v").alias("v"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("w").alias("w"), F.count(F.lit(1)).alias("m")
    )
    kept = F.struct("j", "v", "lo", "hi", "w", "m")
    # Every row has the cell of the first feature.
    size = F.max(F.when(F.col("j") == 0, F.col("m")))
    packed = sums.groupBy(*keys, "cluster_id").agg(F.sort_array(F.collect_list(kept)).alias("s"), size.alias("size"))
    mean = F.transform(
        "s",
        lambda c: F.struct(
            c["j"].alias("j"),
            F.when((c["m"] == F.col("size")) & (c["lo"] == c["hi"]), c["lo"]).otherwise(c["v"] / F.col("size")).alias("c"),
        ),
    )
    made = packed.withColumn("_mean", mean)
    places, last = F.col("_mean.j"), F.element_at("_mean", -1)["j"]
    dense = F.transform(
        F.sequence(F.lit(0), last), lambda j: F.coalesce(F.get("_mean.c", (F.array_position(places, j) - 1).cast("int")), F.lit(0.0))
    )
    tags = F.transform(
        F.filter("s", lambda c: c["w"].isNotNull()),
        lambda c: F.struct((c["j"] - (len(FEATURES) - 1)).alias("j"), (c["w"] / F.col("size")).alias("weight")),
    )
    return made.select("playlist_id", "cluster_id", "size", dense.alias("center"), tags.alias("tags"))


def sparse_distances(cells: DataFrame, centers: DataFrame, hot: DataFrame) -> DataFrame:
    """``distances`` from the cells of each row, which stays where it lies; ``cells`` without their
    column is kept. The centers of a playlist are one row, bounded by its clusters.

    Where a row has no cell the center counts alone: its whole square less that at the
    cells. Both are summed in one order, so a row that equals its center has distance 0.
    """
    square = F.aggregate("center", F.lit(0.0), lambda s, c: s + c * c)
    of = centers.filter("cluster_id IS NOT NULL").groupBy("playlist_id").agg(
        F.map_from_entries(F.collect_list(F.struct("cluster_id", F.struct("center", square.alias("square"))))).alias("_centers")
    )
    rows = cells.join(copies(of, hot), list(DEALT)).withColumn("_c", F.try_element_at("_centers", F.col("cluster_id")))
    rows = rows.filter(F.col("_c").isNotNull())
    start = F.struct(F.lit(0.0).alias("apart"), F.lit(0.0).alias("at"))

    def add(s, e):
        c = F.get(F.col("_c.center"), e["j"])
        return F.struct((s["apart"] + (e["v"] - c) * (e["v"] - c)).alias("apart"), (s["at"] + c * c).alias("at"))

    rows = rows.withColumn("_s", F.aggregate("cells", start, add))
    rest = F.greatest(F.col("_c.square") - F.col("_s.at"), F.lit(0.0))
    own = [c for c in cells.columns if c != "cells"]
    return rows.select(*own, F.sqrt(F.col("_s.apart") + rest).alias("distance"))


def scores(dist: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """Distance over the largest of the playlist; 0 where that is 0. Rows of ``sparse_distances``
    (with their ``hot`` playlists) stay where they lie."""
    top = dist.groupBy("playlist_id").agg(
        F.max("distance").alias("max_distance"), F.count(F.lit(1)).alias("n")
    )
    # Rounded so that equal distances tie no matter how they were summed.
    both = dist.join(top, "playlist_id") if hot is None else dist.join(copies(top, hot), list(DEALT))
    return both.withColumn(
        "anomaly_score",
        F.when(
            F.col("max_distance") > 0, F.round(F.col("distance") / F.col("max_distance"), 12)
        ).otherwise(F.lit(0.0)),
    )


def flag_fraction(scored: DataFrame, fraction: float = 0.15) -> DataFrame:
    """Flag the top ceil(fraction x n) of each playlist, ties by position.

    The rank is exact and spread over tasks (``rank_in_group``), since the
    number of flagged rows grows with the playlist.
    """
    order = [F.desc("anomaly_score"), F.asc("pos"), F.asc("track_id")]
    ranked = _ranked(scored, order)
    want = F.ceil(F.lit(fraction).cast("double") * F.col("n"))
    want = F.when(F.col("n") >= 5, F.greatest(want, F.lit(1))).otherwise(F.least(want, F.lit(1)))
    return ranked.withColumn("flagged", F.col("rn") <= want)


def flag_top(scored: DataFrame, count: int) -> DataFrame:
    """Flag the first ``count`` of each playlist."""
    order = [F.desc("anomaly_score"), F.asc("pos"), F.asc("track_id")]
    return _ranked(scored, order).withColumn("flagged", F.col("rn") <= count)


def _ranked(scored: DataFrame, order: list) -> DataFrame:
    dealt = "_salt" in scored.columns
    return rank_dealt(scored, order) if dealt else rank_in_group(scored, ["playlist_id"], order)


def flag_threshold(scored: DataFrame, threshold: float) -> DataFrame:
    """Flag everything at or above a score; no order needed."""
    return scored.withColumn("flagged", F.col("anomaly_score") >= threshold)


def percentile_rank(scored: DataFrame) -> DataFrame:
    """Share of the other tracks of the playlist with a lower score."""
    sizes = scored.groupBy("playlist_id").agg(F.count(F.lit(1)).alias("m"))
    kept = ["playlist_id", "track_id", "anomaly_score", *_place(scored)]
    ranked = _ranked(scored.select(*kept), [F.asc("anomaly_score"), F.asc("track_id")])
    first = ranked.groupBy("playlist_id", "anomaly_score").agg(F.min("rn").alias("first"))
    return (
        ranked.join(first, ["playlist_id", "anomaly_score"])
        .join(sizes, "playlist_id")
        .select(
            "playlist_id",
            "track_id",
            "anomaly_score",
            F.when(F.col("m") > 1, (F.col("first") - 1) / (F.col("m") - 1))
            .otherwise(F.lit(0.0))
            .alias("percentile_rank"),
        )
    )


def average_ranks(scored: DataFrame) -> DataFrame:
    """Adds ``rn`` (rank by falling score) and ``low`` (mean rank among equal
    scores, smallest first) within the playlist."""
    order = [F.desc("anomaly_score"), F.asc("pos"), F.asc("track_id")]
    ranked = rank_in_group(scored, ["playlist_id"], order)
    size = scored.groupBy("playlist_id").agg(F.count(F.lit(1)).alias("_m"))
    ranked = ranked.join(size, "playlist_id")
    tie = ranked.groupBy("playlist_id", "anomaly_score").agg(
        F.avg(F.col("_m") - F.col("rn") + 1).alias("low")
    )
    return ranked.join(tie, ["playlist_id", "anomaly_score"]).drop("_m")


def audio_means(assigned: DataFrame) -> DataFrame:
    """(playlist_id, cluster_id, size, nine raw means, null_means)."""
    means = assigned.groupBy("playlist_id", "cluster_id").agg(
        F.count(F.lit(1)).alias("size"),
        F.min(F.struct("pos", "track_id")).alias("first_row"),
        *[F.avg(f).alias(f) for f in FEATURES],
    )
    nulls = sum((F.col(f).isNull().cast("int") for f in FEATURES), F.lit(0))
    return means.withColumn("null_means", nulls)


def label_clusters(means: DataFrame, max_null_means: int = 2) -> DataFrame:
    """Adds ``kept`` and the mood ``label`` (null where not kept)."""
    kept = F.col("null_means") <= max_null_means
    return means.withColumn("kept", kept).withColumn(
        "label", F.when(F.col("kept"), mood_label(F.col("energy"), F.col("valence"), F.col("tempo")))
    )


def top_tags(assigned: DataFrame, model: DataFrame, k: int = 8) -> DataFrame:
    """(playlist_id, cluster_id, rank, term, weight): mean TF-IDF, zeros
    included, only weights above zero.

    Means are combined as dense buffers of at most 200 numbers; the top ``k``
    is then taken inside the row, so no term row is shuffled.
    """
    # A playlist without any tag has vectors of length 0 and no tag rows.
    tagged = assigned.filter(F.size("tag_vec") > 0)
    mean = mean_vectors(tagged, ["playlist_id", "cluster_id"], "tag_vec", "tag_mean")
    named = mean.join(model.select("playlist_id", "vocab"), "playlist_id").withColumn(
        "tags",
        F.zip_with(
            "vocab",
            "tag_mean",
            lambda v, w: F.struct((-F.round(w, 9)).alias("k"), v["term"].alias("term"), w.alias("weight")),
        ),
    )
    top = F.slice(F.array_sort(F.filter("tags", lambda t: t["weight"] > 0)), 1, k)
    return named.select("playlist_id", "cluster_id", F.posexplode(top).alias("rank", "t")).select(
        "playlist_id",
        "cluster_id",
        (F.col("rank") + 1).alias("rank"),
        F.col("t.term").alias("term"),
        F.col("t.weight").alias("weight"),
    )


def top_words(centers: DataFrame, model: DataFrame, k: int = 8) -> DataFrame:
    """``top_tags`` from the means of ``cluster_cells``."""
    named = centers.join(model.select("playlist_id", F.col("vocab.term").alias("_terms")), "playlist_id")
    tags = F.transform(
        "tags",
        lambda t: F.struct(
            (-F.round(t["weight"], 9)).alias("k"), F.get("_terms", t["j"] - 1).alias("term"), t["weight"].alias("weight")
        ),
    )
    top = F.slice(F.array_sort(F.filter(tags, lambda t: t["weight"] > 0)), 1, k)
    return named.select("playlist_id", "cluster_id", F.posexplode(top).alias("rank", "t")).select(
        "playlist_id",
        "cluster_id",
        (F.col("rank") + 1).alias("rank"),
        F.col("t.term").alias("term"),
        F.col("t.weight").alias("weight"),
    )


def dominant(clusters: DataFrame) -> DataFrame:
    """The largest cluster of each playlist, dropped ones included; ties go to
    the cluster that starts first."""
    key = F.struct(
        (-F.col("size")).alias("k"), "first_row", "cluster_id", "label", *FEATURES
    )
    best = clusters.groupBy("playlist_id").agg(F.min(key).alias("d"))
    return best.select(
        "playlist_id",
        F.col("d.cluster_id").alias("dominant_cluster_id"),
        F.col("d.label").alias("dominant_label"),
        *[F.col("d")[f].alias(f"dom_{f}") for f in FEATURES],
    )


def track_analysis(lib: DataFrame, flagged: DataFrame, clusters: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """One row per playlist entry: cluster, score, flag, deltas and reason.

    Members of dropped clusters and entries without any data keep a row with
    null cluster and score and a fixed reason. Given the ``hot`` playlists, both inputs are dealt
    tables, and what is known of a playlist and its clusters comes to them as one row.
    """
    marks = ["cluster_id", "anomaly_score", "flagged"]
    if hot is not None:
        info = F.struct("kept", "label")
        heads = clusters.filter("cluster_id IS NOT NULL").groupBy("playlist_id").agg(
            F.map_from_entries(F.collect_list(F.struct("cluster_id", info))).alias("_info")
        )
        heads = heads.join(dominant(clusters), "playlist_id")
        own = lib.select(*DEALT, "track_id", "pos", "title", "eligible", "has_af", *EXPLAINED)
        rows = own.join(flagged.select(*DEALT, "track_id", *marks).hint("shuffle_hash"), [*DEALT, "track_id"], "left")
        rows = rows.join(copies(heads, hot), list(DEALT), "left")
        held = F.try_element_at("_info", F.col("cluster_id"))
        rows = rows.withColumn("kept", held["kept"]).withColumn("label", held["label"])
        return _described(rows.withColumn("is_anomaly", F.coalesce(F.col("kept") & F.col("flagged"), F.lit(False))))
    info = clusters.select("playlist_id", "cluster_id", "kept", "label")
    known = (
        flagged.select("playlist_id", "track_id", *marks)
        .join(info, ["playlist_id", "cluster_id"])
        .join(dominant(clusters), "playlist_id")
    )
    rows = (
        lib.select(
            "playlist_id", "track_id", "pos", "title", "eligible", "has_af", *EXPLAINED
        )
        .join(known, ["playlist_id", "track_id"], "left")
        .withColumn("is_anomaly", F.coalesce(F.col("kept") & F.col("flagged"), F.lit(False)))
    )
    return _described(rows)


def _described(rows: DataFrame) -> DataFrame:
    delta = deltas({f: F.col(f) for f in EXPLAINED}, {f: F.col(f"dom_{f}") for f in EXPLAINED})
    rows = rows.withColumn("deltas", F.when(F.col("is_anomaly") & F.col("has_af"), delta))
    head = F.when(
        F.col("dominant_label").isNotNull(),
        F.concat(F.lit("Anomalous vs dominant mood '"), F.col("dominant_label"), F.lit("'")),
    ).otherwise(F.lit("Anomalous vs dominant mood"))
    facts = F.when(
        F.size("deltas") > 0, F.array_join(F.transform("deltas", delta_text), "; ")
    ).when(
        ~F.col("has_af"), F.lit("reason: limited audio features available (mostly tag-driven)")
    )
    sentence = F.concat_ws(
        ". ", head, F.concat(F.lit("distance_score="), fixed(F.col("anomaly_score"), 2)), facts
    )
    reason = (
        F.when(~F.col("eligible"), NO_DATA)
        .when(~F.col("kept"), NO_AUDIO_CLUSTER)
        .when(F.col("is_anomaly"), sentence)
        .otherwise("")
    )
    return rows.select(
        "playlist_id",
        "track_id",
        "pos",
        "title",
        "eligible",
        F.col("cluster_id").alias("assigned_cluster_id"),
        F.when(F.col("kept"), F.col("cluster_id")).alias("cluster_id"),
        F.when(F.col("kept"), F.col("label")).alias("label"),
        F.when(F.col("kept"), F.col("anomaly_score")).alias("anomaly_score"),
        "is_anomaly",
        "deltas",
        reason.alias("reason"),
        *_place(rows),
    )


def _place(rows: DataFrame) -> list[str]:
    """The column that dealt tables have."""
    return [c for c in rows.columns if c == "_salt"]


def summary(playlists: DataFrame, rows: DataFrame, flagged: DataFrame, clusters: DataFrame) -> DataFrame:
    """Seven counters per playlist; empty playlists keep their row.

    The excluded track ids stay rows (``excluded``) instead of one array that
    would grow with the playlist.
    """
    cut = flagged.filter("flagged").groupBy("playlist_id").agg(
        F.min("anomaly_score").alias("anomaly_score_cutoff")
    )
    kept = clusters.filter("kept").groupBy("playlist_id").agg(F.count(F.lit(1)).alias("num_clusters"))
    counted = rows.groupBy("playlist_id").agg(
        F.count(F.lit(1)).alias("num_tracks"),
        F.count_if("eligible").alias("num_eligible"),
        F.count_if(~F.col("eligible")).alias("num_excluded_missing_all"),
        F.count_if(F.col("eligible") & F.col("cluster_id").isNull()).alias(
            "num_excluded_insufficient_audio_cluster"
        ),
        F.count_if("is_anomaly").alias("num_anomalies"),
    )
    joined = (
        playlists.select("playlist_id", "name")
        .join(counted, "playlist_id", "left")
        .join(kept, "playlist_id", "left")
        .join(cut, "playlist_id", "left")
    )
    zero = [
        "num_tracks",
        "num_eligible",
        "num_excluded_missing_all",
        "num_excluded_insufficient_audio_cluster",
        "num_clusters",
        "num_anomalies",
    ]
    return joined.select(
        "playlist_id",
        "name",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in zero],
        "anomaly_score_cutoff",
    )


def excluded(rows: DataFrame) -> DataFrame:
    """Entries without features and tags, one row each."""
    return rows.filter(~F.col("eligible")).select("playlist_id", "track_id", "title", "reason")


def mood_index(rows: DataFrame) -> DataFrame:
    """(playlist_id, mood_label, cluster_id, pos, track_id, title): the tracks
    of each mood, in cluster order. Clusters with one label share a mood.

    Rows, not arrays: a mood of a large playlist has no size bound.
    """
    return rows.filter(F.col("label").isNotNull()).select(
        "playlist_id", F.col("label").alias("mood_label"), "cluster_id", "pos", "track_id", "title", *_place(rows)
    )


def moods(clusters: DataFrame) -> DataFrame:
    """(playlist_id, mood_label, cluster_ids, num_tracks)."""
    return (
        clusters.filter("kept")
        .groupBy("playlist_id", F.col("label").alias("mood_label"))
        .agg(
            F.array_sort(F.collect_list("cluster_id")).alias("cluster_ids"),
            F.sum("size").alias("num_tracks"),
        )
    )


def mood_distribution(clusters: DataFrame) -> DataFrame:
    """(playlist_id, mood_label, size, proportion, rank), largest mood first.

    A playlist has no more moods than clusters, so its window is small.
    """
    sized = (
        clusters.filter("kept")
        .groupBy("playlist_id", F.col("label").alias("mood_label"))
        .agg(F.sum("size").alias("size"), F.min("cluster_id").alias("first_cluster"))
    )
    all_rows = Window.partitionBy("playlist_id")
    by_size = all_rows.orderBy(F.desc("size"), F.asc("first_cluster"))
    return sized.select(
        "playlist_id",
        "mood_label",
        "size",
        (F.col("size") / F.sum("size").over(all_rows)).alias("proportion"),
        F.row_number().over(by_size).alias("rank"),
    )


def select_by_mood(rows: DataFrame, playlists: DataFrame, mood: str | None) -> DataFrame:
    """Tracks of one mood over all playlists; no mood, no rows."""
    hit = rows.filter(F.col("label") == mood) if mood else rows.limit(0)
    return hit.join(playlists.select("playlist_id", F.col("name").alias("playlist_name")), "playlist_id").select(
        "track_id",
        "title",
        "cluster_id",
        "anomaly_score",
        "is_anomaly",
        "reason",
        "playlist_id",
        "playlist_name",
    )
