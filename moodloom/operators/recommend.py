"""Recommendations: seeds in chunks of five, nearest catalog tracks of each."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moodloom.functions.columns import link_id
from moodloom.operators.grouping import DEALT, copies, keep_first, rank_in_group, top_in_group
from moodloom.operators.knn import Index, knn_join, outside
from moodloom.operators.reports import by_label
from moodloom.operators.vectors import mean_vectors
from moodloom.schema import FEATURES
from moodloom.session import settle

MAX_SEEDS = 5
SIZE = 1
BATCH = 100


def catalog_vectors(tracks: DataFrame) -> DataFrame:
    """(track_id, vec): audio features standardised over the whole catalog;
    a null feature sits at the mean. Tracks without features are left out."""
    rows = _featured(tracks)
    return rows.select("track_id", F.array(*_scaled(_scale(rows))).alias("vec"))


def _featured(tracks: DataFrame) -> DataFrame:
    return tracks.filter(F.col("audio_features").isNotNull()).select(
        "track_id", *[F.col("audio_features")[f].alias(f) for f in FEATURES]
    )


def _scale(rows: DataFrame):
    # Eighteen numbers come to the driver and go back as literals.
    return rows.agg(
        *[F.avg(f).alias(f"{f}_m") for f in FEATURES], *[F.stddev_pop(f).alias(f"{f}_s") for f in FEATURES]
    ).first()


def _scaled(s) -> list:
    def z(f):
        if not s[f"{f}_s"]:
            return F.lit(0.0)
        return F.coalesce((F.col(f) - s[f"{f}_m"]) / s[f"{f}_s"], F.lit(0.0))

    return [z(f) for f in FEATURES]


def label_clusters(clusters: DataFrame) -> DataFrame:
    """The clusters that feed the recommender: one per label, the last wins."""
    return by_label(clusters).select("playlist_id", "label", "cluster_id", *FEATURES)


def members(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    keys = ["playlist_id", "cluster_id"]
    return rows.filter(F.col("cluster_id").isNotNull()).join(chosen.select(*keys), keys, "left_semi")


def seeds(member_rows: DataFrame) -> DataFrame:
    """Members that are no anomalies; a cluster without any has no rows."""
    return member_rows.filter(~F.col("is_anomaly")).select("playlist_id", "cluster_id", "track_id", "pos")


def chunks(seed_rows: DataFrame, size: int = MAX_SEEDS) -> DataFrame:
    """Seeds with the number of their chunk of ``size``, in playlist order."""
    ranked = rank_in_group(seed_rows, ["playlist_id", "cluster_id"], [F.asc("pos"), F.asc("track_id")])
    return ranked.withColumn("chunk", F.floor((F.col("rn") - 1) / size)).drop("rn")


def targets(seed_chunks: DataFrame, chosen: DataFrame) -> DataFrame:
    """The cluster means that go with each chunk."""
    calls = seed_chunks.groupBy("playlist_id", "cluster_id", "chunk").agg(
        F.count(F.lit(1)).alias("seeds")
    )
    return calls.join(chosen, ["playlist_id", "cluster_id"])


def chunk_vectors(seed_chunks: DataFrame, catalog: DataFrame) -> DataFrame:
    """Mean catalog vector of the seeds of a chunk that have features."""
    return mean_vectors(
        seed_chunks.join(catalog, "track_id"), ["playlist_id", "cluster_id", "chunk"], "vec", "vec"
    )


def asked_vectors(
    seed_chunks: DataFrame, member_rows: DataFrame, catalog: DataFrame, blend: float = 0.0
) -> DataFrame:
    """(playlist_id, cluster_id, chunk, vec): what each chunk asks for.

    ``blend`` moves the chunk towards the mean of its cluster: 0 asks for the
    chunk alone, 1 for the cluster mean.
    """
    asked = chunk_vectors(seed_chunks, catalog)
    if blend:
        keys = ["playlist_id", "cluster_id"]
        mean = mean_vectors(member_rows.join(catalog, "track_id"), keys, "vec", "mean")
        asked = asked.join(mean, keys).withColumn(
            "vec", F.zip_with("vec", "mean", lambda x, m: x * (1 - blend) + m * blend)
        )
    return asked.select("playlist_id", "cluster_id", "chunk", "vec")


def members_in_place(dealt: DataFrame, chosen: DataFrame, hot: DataFrame) -> DataFrame:
    """``members`` of a table from ``grouping.deal``: a bounded row per playlist goes to its entries."""
    named = chosen.filter("cluster_id IS NOT NULL").groupBy("playlist_id").agg(F.collect_set("cluster_id").alias("_chosen"))
    held = dealt.filter("cluster_id IS NOT NULL").join(copies(named, hot), list(DEALT))
    return held.filter(F.array_contains("_chosen", F.col("cluster_id"))).drop("_chosen")


def chunk_vectors_in_place(inside: DataFrame, entries: DataFrame, tracks: DataFrame, hot: DataFrame) -> DataFrame | None:
    """``asked_vectors`` of the chunks of ``inside`` (``members_in_place``), with the features that lie with the
    ``entries``: neither moves, but for the chunks of hot playlists.

    None where the entries do not stand for the catalog: a track comes twice in it, or a mean is not a number.
    """
    rows = _featured(tracks)
    scale = _scale(rows)
    if any(x is not None and x != x for x in scale) or not tracks.groupBy("track_id").count().where("count > 1").isEmpty():
        return None
    chunk = F.floor((F.col("rn") - 1) / MAX_SEEDS).alias("chunk")
    order = [F.asc("pos"), F.asc("track_id")]
    seed = inside.filter(~F.col("is_anomaly")).select(*DEALT, "cluster_id", "track_id", "pos")
    held = entries.filter("has_af").select(*DEALT, "track_id", *[x.alias(f) for f, x in zip(FEATURES, _scaled(scale))])

    def means(ranked, keys):
        numbered = ranked.select(*keys, *[c for c in DEALT if c not in keys], "cluster_id", "track_id", chunk)
        known = held.join(numbered.hint("shuffle_hash"), [*DEALT, "track_id"])
        mean = known.groupBy(*keys, "cluster_id", "chunk").agg(*[F.avg(f).alias(f) for f in FEATURES])
        return mean.select("playlist_id", "cluster_id", "chunk", F.array(*FEATURES).alias("vec"))

    at = F.row_number().over(Window.partitionBy(*DEALT, "cluster_id").orderBy(*order)).cast("bigint")
    usual = means(seed.filter("_salt = 0").withColumn("rn", at), list(DEALT))
    if hot.isEmpty():
        return usual
    return usual.unionByName(means(rank_in_group(seed.filter("_salt <> 0"), ["playlist_id", "cluster_id"], order), ["playlist_id"]))


_BACK = {"part": "cluster_id", "qid": "chunk"}


def _asks(asked: DataFrame) -> DataFrame:
    return asked.withColumnsRenamed({c: name for name, c in _BACK.items()})


def _outside(member_rows: DataFrame) -> DataFrame:
    return member_rows.select("playlist_id", F.col("cluster_id").alias("part"), "track_id")


def candidates(
    seed_chunks: DataFrame,
    member_rows: DataFrame,
    catalog: DataFrame,
    k: int = 10,
    blend: float = 0.0,
    index: Index | None = None,
) -> DataFrame:
    """The ``k`` nearest catalog tracks of each chunk outside its cluster."""
    asked = asked_vectors(seed_chunks, member_rows, catalog, blend)
    return nearest_outside(asked, member_rows, index or catalog, k)


def nearest_outside(asked: DataFrame, member_rows: DataFrame, catalog: DataFrame | Index, k: int = 10) -> DataFrame:
    """``candidates`` of the vectors that chunks ask for."""
    return knn_join(_asks(asked), catalog, _outside(member_rows), k).withColumnsRenamed(_BACK)


def match(found: DataFrame, size: int = SIZE) -> DataFrame:
    """The greedy matching of chunks and candidates by distance: no track twice in a
    cluster, at most ``size`` tracks a chunk.

    The pair with the smallest (distance, chunk, track_id) is given first, then the next
    one whose chunk has room and whose track is free. That order needs no single place:
    a pair that is among the first of its chunk and the first of its track wins whatever
    happens elsewhere, so each round gives all such pairs at once and drops what they
    exclude. Rounds end when no pair is left.
    """
    cluster = ["playlist_id", "cluster_id"]
    cols = [*cluster, "chunk", "track_id", "distance"]
    rank = F.row_number().over(Window.partitionBy(*cluster, "chunk").orderBy("distance", "track_id"))
    live, given = found.select(*cols, F.lit(size).alias("room")), None
    while True:
        ahead = F.min(F.struct("distance", "chunk")).over(Window.partitionBy(*cluster, "track_id"))
        marked = settle(
            live.withColumn("rn", rank)
            .withColumn("ahead", ahead)
            .withColumn("won", (F.col("rn") <= F.col("room")) & (F.col("ahead") == F.struct("distance", "chunk")))
            .drop("rn", "ahead")
        )
        won = marked.where("won")
        given = won.select(cols) if given is None else given.union(won.select(cols))
        if marked.isEmpty():
            return given
        used = won.groupBy(*cluster, "chunk").agg(F.count(F.lit(1)).alias("used"))
        live = (
            marked.where("NOT won")
            .join(won.select(*cluster, "track_id"), [*cluster, "track_id"], "left_anti")
            .join(used, [*cluster, "chunk"], "left")
            .select(*cols, (F.col("room") - F.coalesce("used", F.lit(0))).alias("room"))
            .where("room > 0")
        )


#: Most candidate rows of a cluster that is matched in one place.
TOGETHER = 100_000


def match_together(found: DataFrame, size: int = SIZE, most: int | None = None) -> DataFrame:
    """``match``, each cluster in the task where its candidates meet: one shuffle and no rounds.
    Clusters of more than ``most`` rows go through the rounds."""
    cluster = ["playlist_id", "cluster_id"]
    cols = [*cluster, "chunk", "track_id", "distance"]
    most = TOGETHER if most is None else most
    sizes = found.groupBy(*cluster).agg(F.count(F.lit(1)).alias("_n"))
    large = settle(sizes.where(F.col("_n") > most).select(*cluster))
    rest = found.select(cols)
    none = large.isEmpty()
    if not none:
        rest = rest.join(large, cluster, "left_anti")

    def greedy(rows: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows, [(c, "ascending") for c in ("distance", "chunk", "track_id")]))
        room, taken, won = {}, set(), []
        for i, (chunk, track) in enumerate(zip(rows["chunk"].to_pylist(), rows["track_id"].to_pylist())):
            left = room.get(chunk, size)
            if left and track not in taken:
                room[chunk] = left - 1
                taken.add(track)
                won.append(i)
        return rows.take(pa.array(won, pa.int64()))

    given = rest.groupBy(*cluster).applyInArrow(greedy, rest.schema)
    if none:
        return given
    return given.unionByName(match(found.join(large, cluster, "left_semi"), size).select(cols))


def _lists(asked: DataFrame, inside: DataFrame, index: Index, k: int) -> DataFrame:
    """The ``k`` nearest candidates of each chunk, and the ``k`` they were asked with."""
    found = index.nearest(_asks(asked), _outside(inside), k).withColumnsRenamed(_BACK)
    return found.drop("rn").withColumn("asked_k", F.lit(k))


def serve(asked: DataFrame, inside: DataFrame, index: Index, size: int = SIZE, k: int = 10) -> DataFrame:
    """(playlist_id, cluster_id, chunk, track_id, distance): the greedy matching of every
    chunk with the whole catalog outside its cluster.

    Chunks start with their ``k`` nearest candidates. A chunk that ends up short asks
    again for more, alone, and its cluster is matched anew; a list is long enough when
    it holds the whole catalog, or as many tracks as all chunks of the cluster can take.
    """
    cluster, chunk = ["playlist_id", "cluster_id"], ["playlist_id", "cluster_id", "chunk"]
    full = asked.groupBy(*cluster).agg((F.count(F.lit(1)) * size).alias("full"))
    lists = _lists(asked, inside, index, k)
    done, open_rows = None, asked.select(chunk)
    while True:
        given = settle(match_together(lists, size))
        held = lists.groupBy(*chunk).agg(F.count(F.lit(1)).alias("listed"), F.max("asked_k").alias("asked_k"))
        got = given.groupBy(*chunk).agg(F.count(F.lit(1)).alias("got"))
        # A list that is not full has reached the end of the catalog.
        short = settle(
            open_rows.join(held, chunk, "left")
            .join(got, chunk, "left")
            .join(full, cluster)
            .where((F.coalesce("got", F.lit(0)) < size) & (F.col("listed") == F.col("asked_k")) & (F.col("listed") < F.col("full")))
            .select(*chunk)
        )
        again = short.select(*cluster).distinct()
        ready = given.join(again, cluster, "left_anti")
        done = ready if done is None else done.union(ready)
        if short.isEmpty():
            return done
        k *= 4
        more = _lists(asked.join(short, chunk, "left_semi"), inside, index, k)
        kept = lists.join(again, cluster, "left_semi").join(short, chunk, "left_anti")
        lists = settle(kept.unionByName(more))
        open_rows = settle(open_rows.join(again, cluster, "left_semi"))


def recommend(
    rows: DataFrame,
    clusters: DataFrame,
    tracks: DataFrame,
    size: int = SIZE,
    k: int = 10,
    blend: float = 0.0,
    index: Index | None = None,
    found: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """Recommendations of all clusters of all playlists. Empty in, empty out.

    ``size`` tracks for every chunk of seeds while the catalog has tracks left outside
    the cluster; ``index`` is an index of ``catalog_vectors(tracks)`` that already exists, ``found`` the settled
    ``asked_vectors`` and the members, where they are known.
    """
    chosen = label_clusters(clusters)
    if found is None:
        inside = members(rows, chosen)
        catalog = catalog_vectors(tracks)
        found = settle(asked_vectors(chunks(seeds(inside)), inside, catalog, blend)), inside
    given = serve(*found, index or Index(catalog_vectors(tracks)), size, k)
    titled = given.join(chosen.select("playlist_id", "cluster_id", "label"), ["playlist_id", "cluster_id"])
    cols = ["track_id", "reccobeats_id", "title", "artists", "duration_ms"]
    # A catalog without the column leaves the popularity open.
    popularity = F.col("popularity") if "popularity" in tracks.columns else F.lit(None).cast("int").alias("popularity")
    return titled.join(tracks.select(*cols, popularity), "track_id")


def counts(recs: DataFrame, seed_rows: DataFrame) -> DataFrame:
    """Input tracks and recommendations per cluster with at least one seed."""
    keys = ["playlist_id", "cluster_id"]
    given = seed_rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("num_input_tracks"))
    got = recs.groupBy(*keys).agg(F.count(F.lit(1)).alias("num_recommendations"))
    return given.join(got, keys, "left").withColumn(
        "num_recommendations", F.coalesce("num_recommendations", F.lit(0))
    )


def per_playlist(recs: DataFrame, playlists: DataFrame) -> DataFrame:
    """Clusters served and recommendations of every playlist; 0 where the
    playlist has nothing to recommend for."""
    by_cluster = recs.groupBy("playlist_id", "cluster_id").agg(F.count(F.lit(1)).alias("n"))
    got = by_cluster.groupBy("playlist_id").agg(
        F.count(F.lit(1)).alias("clusters"), F.sum("n").alias("recommendations")
    )
    return playlists.select("playlist_id", "name").join(got, "playlist_id", "left").fillna(
        0, ["clusters", "recommendations"]
    )


def clean_results(results: DataFrame, member_rows: DataFrame, order: list[str]) -> DataFrame:
    """Outside results: rows without an id, rows of the cluster itself and
    repeats (first kept) drop out."""
    keys = ["playlist_id", "cluster_id", "track_id"]
    named = results.filter(F.col("track_id").isNotNull())
    fresh = named.join(member_rows.select(*keys), keys, "left_anti")
    return keep_first(fresh, keys, order)


def normalise(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Rows of a recommender payload: both ids, title, artists, popularity."""
    artist = "array<struct<name: string, href: string>>"
    schema = (
        f"id string, href string, trackTitle string, artists {artist}, durationMs int, popularity int"
    )
    p = payloads.select(F.from_json(column, schema).alias("p")).select("p.*")
    return p.select(
        link_id(F.col("href"), "/track/").alias("spotify_id"),
        F.col("id").alias("reccobeats_id"),
        F.coalesce("trackTitle", F.lit("")).alias("title"),
        F.transform(
            F.coalesce("artists", F.array().cast(artist)),
            lambda a: F.struct(
                F.coalesce(a["name"], F.lit("")).alias("name"),
                link_id(a["href"], "/artist/").alias("spotify_id"),
            ),
        ).alias("artists"),
        F.coalesce("durationMs", F.lit(0)).alias("duration_ms"),
        "popularity",
    )


def write_batches(recs: DataFrame, group: list[str], order: list, size: int = BATCH) -> DataFrame:
    """(group.., batch, uris): track URIs in write batches of ``size``."""
    ranked = rank_in_group(recs, group, order).withColumn("batch", F.floor((F.col("rn") - 1) / size))
    # Fixed value: the URI prefix of a track.
    uri = F.concat(F.lit("spotify:track:"), F.col("track_id").cast("string"))
    listed = ranked.groupBy(*group, "batch").agg(
        F.array_sort(F.collect_list(F.struct("rn", uri.alias("uri")))).alias("l")
    )
    return listed.select(*group, "batch", F.col("l.uri").alias("uris"))


# --- described variants ------------------------------------------------------


def _whole(lib: DataFrame) -> DataFrame:
    return lib.select("playlist_id", F.lit(0).alias("part"), "track_id")


def fix_anomalies(rows: DataFrame, clusters: DataFrame, lib: DataFrame, catalog: DataFrame, k: int = 3, index: Index | None = None) -> DataFrame:
    """For every anomaly the tracks outside its playlist that lie nearest to
    the playlist's dominant cluster."""
    from moodloom.operators.analysis import dominant

    main = dominant(clusters).select("playlist_id", F.col("dominant_cluster_id").alias("cluster_id"))
    inside = rows.select("playlist_id", F.col("assigned_cluster_id").alias("cluster_id"), "track_id").join(
        main, ["playlist_id", "cluster_id"], "left_semi"
    )
    center = mean_vectors(inside.join(catalog, "track_id"), ["playlist_id"], "vec", "vec")
    asked = center.select("playlist_id", F.lit(0).alias("part"), F.lit(0).alias("qid"), "vec")
    best = knn_join(asked, index or catalog, _whole(lib), k).select(
        "playlist_id", F.col("track_id").alias("replacement"), "distance", "rn"
    )
    return rows.filter("is_anomaly").select("playlist_id", "track_id").join(best, "playlist_id")


def _shared(asked: DataFrame, points: DataFrame, lib: DataFrame, index: Index, k: int) -> DataFrame:
    """The ``k`` nearest tracks outside the playlist of each (playlist_id, qid) of ``asked``, whose vector is that of
    its qid in ``points`` (qid, vec), one row each: a point is searched once, however many playlists ask for it."""
    points = settle(points)
    asks = settle(asked.select("playlist_id", F.lit(0).alias("part"), "qid"))

    def search(some, n):
        wanted = points.join(some.select("qid").distinct(), "qid", "left_semi")
        queries = wanted.select(F.lit(0).alias("playlist_id"), F.lit(0).alias("part"), "qid", "vec")
        found = index.search(queries, n).drop("playlist_id", "part")
        # Exactly the first of each point go to its playlists.
        return some.join(settle(top_in_group(found, ["qid"], [F.asc("distance"), F.asc("track_id")], n)).drop("rn"), "qid")

    return outside(search, asks, _whole(lib), k, index.total)


def lean_in(rows: DataFrame, lib: DataFrame, catalog: DataFrame, k: int = 3, index: Index | None = None) -> DataFrame:
    """Tracks outside the playlist nearest to each anomaly itself."""
    odd = rows.filter("is_anomaly")
    if index is not None and index.total and index.once:
        points = index.rows.withColumnRenamed("track_id", "qid").join(odd.select(F.col("track_id").alias("qid")).distinct(), "qid")
        known = odd.select("playlist_id", F.col("track_id").alias("qid"))
        found = _shared(known, points, lib, index, k)
    else:
        asked = odd.join(catalog, "track_id").select("playlist_id", F.lit(0).alias("part"), F.col("track_id").alias("qid"), "vec")
        found = knn_join(asked, index or catalog, _whole(lib), k)
    return found.select("playlist_id", F.col("qid").alias("anomaly"), "track_id", "distance", "rn")


def mood_centers(mood_tracks: DataFrame, catalog: DataFrame) -> DataFrame:
    """(mood_label, vec): mean vector of the tracks of each mood. Entries are counted per track before they meet
    the catalog, which leaves at most a row per mood and track."""
    held = mood_tracks.groupBy("mood_label", "track_id").agg(F.count(F.lit(1)).alias("_n"))
    return mean_vectors(held.join(catalog, "track_id"), ["mood_label"], "vec", "vec", F.col("_n").cast("double"))


def for_mood(mood_tracks: DataFrame, lib: DataFrame, catalog: DataFrame, k: int = 5, index: Index | None = None) -> DataFrame:
    """Per playlist and mood it has: the tracks outside the playlist nearest
    to the centre of that mood over all playlists."""
    has = mood_tracks.select("playlist_id", F.col("mood_label").alias("qid")).distinct()
    centers = mood_centers(mood_tracks, catalog).withColumnRenamed("mood_label", "qid")
    index = index or Index(catalog)
    if index.total:
        found = _shared(has, centers, lib, index, k)
    else:
        found = index.nearest(has.join(centers, "qid").withColumn("part", F.lit(0)), _whole(lib), k)
    return found.select("playlist_id", F.col("qid").alias("mood_label"), "track_id", "distance", "rn")


def ranked_selection(mood_tracks: DataFrame, catalog: DataFrame, mood: str) -> DataFrame:
    """Tracks of a mood, nearest to the centre of the mood first."""
    from moodloom.functions.columns import distance

    mine = mood_tracks.filter(F.col("mood_label") == mood)
    center = mood_centers(mine, catalog).withColumnRenamed("vec", "center")
    return (
        mine.join(catalog, "track_id")
        .join(center, "mood_label")
        .select("playlist_id", "track_id", "title", distance(F.col("vec"), F.col("center")).alias("distance"))
        .orderBy("distance", "playlist_id", "track_id")
    )
