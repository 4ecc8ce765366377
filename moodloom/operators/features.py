"""Feature engineering: eligibility, weighted tags, TF-IDF, scaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moodloom.functions.columns import norm, number, tag_weight, tokens, unit
from moodloom.operators.grouping import DEALT, copies, deal, hot_join, hot_playlists, top_in_group
from moodloom.schema import FEATURES
from moodloom.session import settle, settle_keyed

QUARTILES = (0.25, 0.5, 0.75)
#: Values of a group that are sorted at once; bins of a longer one.
SMALL, BINS = 4096, 256


def audio_columns(tracks: DataFrame) -> DataFrame:
    """The nine features as columns, null for an absent struct or bad value."""
    return tracks.select(
        "track_id", *[number(F.col("audio_features")[f]).alias(f) for f in FEATURES]
    )


def token_weights(tracks: DataFrame) -> DataFrame:
    """(track_id, term, tf): tag weights summed over the words of the tags.

    The weighted document is never built; a word's count is the sum of the
    weights of the tags it occurs in. Sums combine before the shuffle.
    """
    tag = tracks.select("track_id", F.explode("tags").alias("t"))
    word = tag.select(
        "track_id",
        F.explode(tokens(F.col("t.name"))).alias("term"),
        tag_weight(F.col("t.count")).alias("reps"),
    )
    return word.groupBy("track_id", "term").agg(F.sum("reps").alias("tf"))


def library(items: DataFrame, tracks: DataFrame) -> DataFrame:
    """Playlist entries with their track, one row per (playlist, track).

    Adds ``has_af``, ``eligible`` and ``tf`` (word -> weight of the track, in order of words).
    Word counts are made once per track, before the tracks fan out over the
    playlists. Entries whose track is unknown are dropped.
    """
    tf = (
        token_weights(tracks)
        .groupBy("track_id")
        .agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("term", "tf")))).alias("tf"))
    )
    known = tracks.join(tf, "track_id", "left").select(
        "*",
        F.col("audio_features").isNotNull().alias("has_af"),
        *[number(F.col("audio_features")[f]).alias(f) for f in FEATURES],
    )
    known = known.withColumn("eligible", eligible())
    # A shuffle on the track keeps the entries, the large side, spread out; a
    # low estimate would otherwise broadcast them and leave one task.
    return items.join(known.hint("merge"), "track_id")


def eligible():
    """Features present or any tag at all (blank names count)."""
    return F.col("audio_features").isNotNull() | (F.coalesce(F.size("tags"), F.lit(0)) > 0)


def entries(lib: DataFrame, keep: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """What the analysis reads of the library, moved once so that each playlist lies together,
    and its hot playlists (``grouping.deal``). Later steps read it where it lies. ``keep`` names
    more columns of ``lib`` that stay."""
    sizes = lib.filter("playlist_id IS NOT NULL").groupBy("playlist_id").agg(F.count(F.lit(1)).alias("n"))
    hot = hot_playlists(sizes)
    slim = lib.select("playlist_id", "track_id", "pos", "title", "eligible", "has_af", *FEATURES, "tf", *keep)
    parts = int(lib.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    moved = _unpacked(deal(_packed(slim), hot).repartition(parts, *DEALT))
    return settle_keyed(moved.select(*slim.columns, "_salt"), DEALT, ["track_id"], moved=True), hot


def _packed(rows: DataFrame) -> DataFrame:
    """``tf`` as two texts, which take less than the map while rows travel. A word holds no line end."""
    words = F.array_join(F.map_keys("tf"), "\n").alias("_words")
    counts = F.array_join(F.map_values("tf"), "\n", "").alias("_counts")
    return rows.select(*[c for c in rows.columns if c != "tf"], words, counts)


def _unpacked(rows: DataFrame) -> DataFrame:
    counts = F.split("_counts", "\n").try_cast("array<bigint>")
    empty = F.expr("CAST(map() AS MAP<STRING, BIGINT>)")
    tf = F.when(F.col("_words") == "", empty).otherwise(F.map_from_arrays(F.split("_words", "\n"), counts))
    return rows.withColumn("tf", tf).drop("_words", "_counts")


def vocabulary(terms: DataFrame, max_features: int = 200, min_df: int = 1) -> DataFrame:
    """(playlist_id, term, freq, df, rn): the most frequent terms of a playlist.

    ``terms`` holds one row per (playlist, track, term) with ``tf``. Counts
    combine before the shuffle, and the window keeps ``max_features`` rows
    per map task.
    """
    counted = terms.groupBy("playlist_id", "term").agg(
        F.sum("tf").alias("freq"), F.count(F.lit(1)).alias("df")
    )
    return top_in_group(
        counted.filter(F.col("df") >= min_df),
        ["playlist_id"],
        [F.desc("freq"), F.asc("term")],
        max_features,
    )


def library_terms(lib: DataFrame) -> DataFrame:
    return lib.filter("eligible").select(
        "playlist_id", "track_id", F.explode("tf").alias("term", "tf")
    )


def fit(lib: DataFrame, max_features: int = 200, min_df: int = 1) -> DataFrame:
    """One row per playlist: n, mean/deviation/count of each feature, and the
    vocabulary as an array of at most ``max_features`` (term, idf)."""
    stats = lib.filter("eligible").groupBy("playlist_id").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(f).alias(f"{f}_mean") for f in FEATURES],
        *[F.stddev_pop(f).alias(f"{f}_sd") for f in FEATURES],
        *[F.count(f).alias(f"{f}_cnt") for f in FEATURES],
    )
    vocab = (
        vocabulary(library_terms(lib), max_features, min_df)
        .groupBy("playlist_id")
        .agg(F.array_sort(F.collect_list(F.struct("term", "df"))).alias("vocab"))
    )
    empty = F.expr("CAST(array() AS ARRAY<STRUCT<term: STRING, idf: DOUBLE>>)")
    return stats.join(vocab, "playlist_id", "left").withColumn(
        "vocab",
        F.coalesce(
            F.transform(
                "vocab",
                lambda v: F.struct(
                    v["term"].alias("term"),
                    (F.log((F.col("n") + 1) / (v["df"] + 1)) + 1).alias("idf"),
                ),
            ),
            empty,
        ),
    )


def scaled(feature: str):
    """Standardised feature; 0 for a null, a constant or a single value."""
    x, sd, cnt = F.col(feature), F.col(f"{feature}_sd"), F.col(f"{feature}_cnt")
    z = (x - F.col(f"{feature}_mean")) / sd
    return F.when((cnt < 2) | (sd == 0) | x.isNull(), F.lit(0.0)).otherwise(z)


def transform(lib: DataFrame, model: DataFrame, hot: DataFrame | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Eligible rows with ``audio`` (9), ``tag_vec`` (<= 200) and ``vec``, the
    two joined and brought to length 1.

    The model row of a playlist is bounded (nine features, 200 terms), so one
    join brings scaling and vocabulary to the tracks; the term rows are never
    shuffled a second time. The rows of a very long playlist are dealt out, those of
    ``entries`` (with their ``hot`` playlists) already are. ``keep`` names more columns of ``lib``
    that stay.
    """
    if hot is None:
        joined = hot_join(lib.filter("eligible"), model, ["playlist_id"], ["track_id"], model.select("playlist_id", "n"))
    else:
        joined = lib.filter("eligible").join(copies(model, hot), list(DEALT))
    raw = joined.withColumn("audio", F.array(*[scaled(f) for f in FEATURES])).withColumn(
        "_raw",
        F.transform(
            "vocab",
            lambda v: F.coalesce(F.try_element_at("tf", v["term"]).cast("double") * v["idf"], F.lit(0.0)),
        ),
    )
    tagged = raw.withColumn("_len", norm(F.col("_raw"))).withColumn(
        "tag_vec", unit(F.col("_raw"), F.col("_len"))
    )
    # The tag part has length 1 or 0, so the whole length needs the nine only.
    square = sum((F.get("audio", F.lit(j)) * F.get("audio", F.lit(j)) for j in range(len(FEATURES))), F.lit(0.0))
    both = tagged.withColumn(
        "_len", F.sqrt(square + F.when(F.col("_len") > 0, 1.0).otherwise(0.0))
    ).withColumn("_all", F.concat("audio", "tag_vec"))
    # Titles, artists and the like stay in the library; vectors travel often.
    return both.select(
        "playlist_id",
        "track_id",
        "pos",
        "n",
        *FEATURES,
        "audio",
        "tag_vec",
        unit(F.col("_all"), F.col("_len")).alias("vec"),
        *keep,
    )


def sparse(lib: DataFrame, model: DataFrame, hot: DataFrame) -> DataFrame:
    """``lib`` (from ``entries``, eligible rows) with ``cells``: (j, v, w) of each number that
    the ``vec`` of ``transform`` may hold, in order of j. The nine features come first, then
    the words the track has; w is the weight in ``tag_vec``, null for a feature.

    A track has few of the words of its playlist, so this is what travels or is made again.
    """
    words = model.select(
        *[c for c in model.columns if c != "vocab"],
        F.col("vocab.term").alias("_terms"),
        F.col("vocab.idf").alias("_idf"),
    )
    joined = lib.filter("eligible").join(copies(words, hot), list(DEALT))
    at = F.transform(
        F.map_entries("tf"),
        lambda e: F.struct(F.array_position("_terms", e["key"]).cast("int").alias("j"), e["value"].alias("tf")),
    )
    # The words of a track and of a playlist are in one order, so the places rise.
    known = F.filter(F.coalesce(at, F.expr("CAST(array() AS ARRAY<STRUCT<j: INT, tf: BIGINT>>)")), lambda e: (e["j"] > 0) & e["tf"].isNotNull())
    raw = F.transform(known, lambda e: F.struct(e["j"].alias("j"), (e["tf"].cast("double") * F.get("_idf", e["j"] - 1)).alias("x")))
    rows = joined.withColumn("_raw", raw).withColumn("_audio", F.array(*[scaled(f) for f in FEATURES]))
    rows = rows.withColumn("_len", norm(F.col("_raw.x")))
    square = F.aggregate("_audio", F.lit(0.0), lambda s, a: s + a * a)
    rows = rows.withColumn("_all", F.sqrt(square + F.when(F.col("_len") > 0, 1.0).otherwise(0.0)))

    def scale(x):
        return F.when(F.col("_all") > 0, x / F.col("_all")).otherwise(F.lit(0.0))

    def cell(j, v, w):
        return F.struct(j.alias("j"), v.alias("v"), w.alias("w"))

    first = F.transform("_audio", lambda a, j: cell(j, scale(a), F.lit(None).cast("double")))
    # Weights are above 0, so a row with a word has a length.
    tags = F.transform(
        "_raw",
        lambda e: cell(e["j"] + (len(FEATURES) - 1), scale(e["x"] / F.col("_len")), e["x"] / F.col("_len")),
    )
    return rows.select(*lib.columns, F.concat(first, tags).alias("cells"))


def robust_scale(rows: DataFrame, features=FEATURES) -> DataFrame:
    """(x - median) / IQR per playlist over rows without any null; a feature
    with IQR 0 becomes 0.

    Quartiles are exact with linear interpolation. They come from counts of bins, not
    from the ``percentile`` aggregate, whose buffer holds all distinct values of a
    playlist.
    """
    clean = rows.select("playlist_id", "track_id", *[number(F.col(f)).alias(f) for f in features])
    clean = settle(clean.na.drop(subset=list(features)))
    long = clean.select(
        "playlist_id",
        F.explode(
            F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("x")) for f in features])
        ).alias("v"),
    ).select("playlist_id", "v.*")
    q = quartiles(long, ["playlist_id", "feature"]).groupBy("playlist_id").agg(
        *[
            F.max(F.when(F.col("feature") == f, F.array("q1", "q2", "q3"))).alias(f"{f}_q")
            for f in features
        ]
    )

    def one(f):
        iqr = F.col(f"{f}_q")[2] - F.col(f"{f}_q")[0]
        return F.when(iqr == 0, F.lit(0.0)).otherwise((F.col(f) - F.col(f"{f}_q")[1]) / iqr)

    return clean.join(q, "playlist_id").select(
        "playlist_id", "track_id", *[one(f).alias(f) for f in features]
    )


def quartiles(long: DataFrame, group: list[str]) -> DataFrame:
    """Exact quartiles of ``x`` per group, interpolated between two ranks, without a sort
    of the rows.

    The wanted ranks of a group are six at most. A group of more than ``SMALL`` rows is
    cut into ``BINS`` bins between its ends, the counts say which bins hold those ranks,
    and only these are cut again, until every one is small or holds one value. Counts
    combine before the shuffle. What is left, at most six times ``SMALL`` values a group,
    is collected and sorted; a group that is small from the start is one such bin.
    """
    rows = long.select(*group, F.col("x").cast("double").alias("x"))
    size = rows.groupBy(*group).agg(F.count("x").alias("m"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    todo = settle(size.where("m > 0").select(*group, "m", "lo", "hi", F.lit(0).cast("bigint").alias("before"), F.col("m").alias("n")))
    large = (F.col("n") > SMALL) & (F.col("lo") / BINS < F.col("hi") / BINS)
    picks = None
    while True:
        ready = todo.where(~large)
        picks = ready if picks is None else picks.union(ready)
        cut = todo.where(large)
        if cut.isEmpty():
            break
        # Halves of the range never overflow.
        share = (F.col("x") / BINS - F.col("lo") / BINS) / (F.col("hi") / BINS - F.col("lo") / BINS)
        bins = (
            rows.join(cut, group)
            .where("x >= lo AND x <= hi")
            .withColumn("bin", F.least(F.floor(share * BINS), F.lit(BINS - 1)))
            .groupBy(*group, "m", "lo", "before", "bin")
            .agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
        )
        earlier = Window.partitionBy(*group, "lo").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        bins = bins.withColumn("before", F.col("before") + F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        held = [(r > F.col("before")) & (r <= F.col("before") + F.col("n")) for q in QUARTILES for r, _ in _ranks(q)]
        wanted = held[0]
        for h in held[1:]:
            wanted = wanted | h
        todo = settle(bins.where(wanted).select(*group, "m", F.col("low").alias("lo"), F.col("high").alias("hi"), "before", "n"))
    keys = [*group, "m", "lo", "hi", "before", "n"]
    sorted_bins = (
        rows.join(picks.where("lo < hi"), group)
        .where("x >= lo AND x <= hi")
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list("x")).alias("xs"))
    )
    # A bin of one value needs no values.
    constant = picks.where("lo >= hi").withColumn("xs", F.lit(None).cast("array<double>"))

    def point(q):
        parts = []
        for rank, weight in _ranks(q):
            value = F.coalesce(F.get("xs", (rank - F.col("before") - 1).cast("int")), F.col("lo"))
            inside = (rank > F.col("before")) & (rank <= F.col("before") + F.col("n"))
            parts.append(F.sum(F.when(inside & (weight > 0), weight * value)))
        return F.coalesce(parts[0], F.lit(0.0)) + F.coalesce(parts[1], F.lit(0.0))

    return sorted_bins.union(constant.select(sorted_bins.columns)).groupBy(*group).agg(
        *[point(q).alias(f"q{i + 1}") for i, q in enumerate(QUARTILES)]
    )


def _ranks(q: float):
    """The two ranks (from 1) between which a quantile of ``m`` rows lies, with their weights."""
    spot = (F.col("m") - 1) * F.lit(q)
    low = F.floor(spot)
    return [(low + 1, 1 - (spot - low)), (low + 2, spot - low)]


def z_scores(lib: DataFrame, model: DataFrame) -> DataFrame:
    """Features relative to their playlist, in standard deviations."""
    sizes = model.select("playlist_id", "n")
    joined = hot_join(lib.filter("eligible"), model.drop("vocab"), ["playlist_id"], ["track_id"], sizes)
    return joined.select("playlist_id", "track_id", *[scaled(f).alias(f) for f in FEATURES])


def z_reasons(z: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` features of a track that are furthest from its playlist."""
    found = F.array(
        *[
            F.struct((-F.abs(F.col(f))).alias("k"), F.lit(i).alias("ord"), F.lit(f).alias("feature"), F.col(f).alias("z"))
            for i, f in enumerate(FEATURES)
        ]
    )
    top = F.slice(F.array_sort(found), 1, k)
    return z.select("playlist_id", "track_id", F.posexplode(top).alias("rank", "f")).select(
        "playlist_id", "track_id", (F.col("rank") + 1).alias("rank"), "f.feature", "f.z"
    )


def order_distance(vectors: DataFrame, chunk_rows: int = 4096) -> DataFrame:
    """Distance of each track to its neighbours in playlist order.

    ``vectors`` carries ``rn``, the exact rank in the playlist. A neighbour is
    the row with rank +-1, so the lag runs inside chunks of ``chunk_rows``
    ranks, and each chunk also gets a copy of the row before it. No task has
    to hold a whole playlist.
    """
    own = vectors.select(
        "playlist_id", "track_id", "rn", "vec", F.floor((F.col("rn") - 1) / chunk_rows).alias("chunk")
    ).withColumn("copy", F.lit(False))
    edge = own.filter(F.col("rn") % chunk_rows == 0).select(
        "playlist_id", "track_id", "rn", "vec", (F.col("chunk") + 1).alias("chunk"), F.lit(True).alias("copy")
    )
    w = Window.partitionBy("playlist_id", "chunk").orderBy("rn")
    return (
        own.unionByName(edge)
        .withColumn("prev", F.lag("vec").over(w))
        .filter(~F.col("copy"))
        .select(
            "playlist_id",
            "track_id",
            "rn",
            F.when(
                F.col("prev").isNotNull(), norm(F.zip_with("vec", "prev", lambda a, b: a - b))
            ).alias("step"),
        )
    )
