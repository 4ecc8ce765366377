"""KMeans of all playlists at once, choice of k, silhouette.

The rows of a playlist are spread over blocks of about ``BLOCK_ROWS`` rows.
Blocks are hashed on (playlist, block), so a playlist with a third of all rows
is spread over the whole cluster. Each round joins the few centres of a
playlist to its blocks, runs one matrix product per block, and sends back one
partial mean per block and centre, which Spark combines.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from moodloom.functions.columns import distance, dot
from moodloom.operators.grouping import DEALT, top_in_group
from moodloom.operators.vectors import mean_vectors
from moodloom.session import cut, cut_in_place, settle

BLOCK_ROWS = 1024
#: Rows of a playlist on either side of one block of distances.
PAIR_ROWS = 2048
#: Rounds of distance-weighted draws that make the start centres.
OVERSAMPLING_ROUNDS = 3


def pack(vectors: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(playlist_id, block, n, blocks, rows): blocks of bounded size, settled.

    ``n``, the size of the playlist, is taken from ``vectors`` if it is there.
    Every track goes to a block by its hash; the number of blocks follows the
    size of the playlist. The explicit partitioning survives the checkpoint,
    so later joins on (playlist_id, block) do not move the blocks again.
    """
    spark = vectors.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if "n" not in vectors.columns:
        size = vectors.groupBy("playlist_id").agg(F.count(F.lit(1)).alias("n"))
        vectors = settle(vectors.join(size, "playlist_id"))
    keyed = vectors.withColumn("blocks", F.ceil(F.col("n") / block_rows)).withColumn(
        "block", F.pmod(F.xxhash64("track_id"), F.col("blocks"))
    )
    return cut_in_place(
        keyed.repartition(parts, "playlist_id", "block")
        .groupBy("playlist_id", "block")
        .agg(
            F.first("n").alias("n"),
            F.first("blocks").alias("blocks"),
            F.collect_list(F.struct("track_id", "pos", "vec")).alias("rows"),
        )
    )


def candidates(blocks: DataFrame, k_min: int = 3, k_max: int = 8) -> DataFrame:
    """(playlist_id, n, k): the numbers of clusters to try.

    Up to three rows: k = n. Otherwise k_min..k_max below n.
    """
    size = blocks.groupBy("playlist_id").agg(
        F.first("n").alias("n"), F.first("blocks").alias("blocks")
    )
    low = F.greatest(F.lit(2), F.least(F.lit(k_min), F.col("n")))
    high = F.least(F.lit(k_max), F.col("n") - 1)
    ks = (
        F.when(F.col("n") <= 2, F.array(F.col("n")))
        .when(high < low, F.array(low.cast("bigint")))
        .otherwise(F.sequence(low.cast("bigint"), high))
    )
    return size.select("playlist_id", "n", "blocks", F.explode(ks.cast("array<int>")).alias("k"))


def seeds(
    blocks: DataFrame, cand: DataFrame, restarts: int, k_max: int = 8, seed: int = 42
) -> DataFrame:
    """Start centres: per restart the k smallest md5 keys with distinct vectors.

    Only keys and hashes are shuffled: copies of a vector merge before the
    shuffle, and the top-k window sends at most ``k_max`` rows per map task.
    The few winners then fetch their vectors from the blocks they lie in.
    """
    points = blocks.select("playlist_id", F.explode("rows").alias("r")).select(
        "playlist_id",
        F.col("r.track_id").alias("track_id"),
        # Vectors equal to nine digits count as copies.
        F.xxhash64(F.transform("r.vec", lambda x: F.floor(x * 1e9 + 0.5))).alias("_same"),
    )
    first = (
        points.withColumn("restart", F.explode(F.sequence(F.lit(0), F.lit(restarts - 1))))
        .withColumn(
            "_key", F.md5(F.concat_ws(":", F.lit(seed), "restart", F.col("track_id").cast("string")))
        )
        .groupBy("playlist_id", "restart", "_same")
        .agg(F.min(F.struct("_key", "track_id")).alias("_m"))
        .select("playlist_id", "restart", "_m.*")
    )
    ranked = top_in_group(first, ["playlist_id", "restart"], [F.col("_key")], k_max, "cid")
    picked = (
        cand.join(ranked, "playlist_id")
        .filter(F.col("cid") <= F.col("k"))
        .withColumn("block", F.pmod(F.xxhash64("track_id"), F.col("blocks")))
    )
    wanted = picked.groupBy("playlist_id", "block").agg(F.collect_set("track_id").alias("ids"))
    found = (
        blocks.join(wanted, ["playlist_id", "block"])
        .select(
            "playlist_id",
            F.explode(F.filter("rows", lambda r: F.array_contains("ids", r["track_id"]))).alias("r"),
        )
        .select("playlist_id", F.col("r.track_id").alias("track_id"), F.col("r.vec").alias("center"))
    )
    return picked.join(found, ["playlist_id", "track_id"]).select(
        "playlist_id",
        "k",
        "restart",
        (F.col("cid") - 1).cast("int").alias("cid"),
        "center",
        "blocks",
    )


def parallel_seeds(
    blocks: DataFrame,
    cand: DataFrame,
    restarts: int,
    k_max: int = 8,
    seed: int = 42,
    rounds: int = OVERSAMPLING_ROUNDS,
) -> DataFrame:
    """Start centres by distance-weighted oversampling (k-means||), in the form of ``seeds``.

    Each round draws ``2 * k_max`` further rows of every playlist and restart, without
    replacement and in proportion to the squared distance to the centres drawn before: a
    row's key is ``-ln(u) / distance`` with u from a hash of its track, and the smallest
    keys win, so blocks send only their own few smallest and no total is needed first.
    Then every drawn row gets the number of rows nearest to it, and weighted k-means++
    (best of a few draws a step) picks the centres from this small sample, one bounded
    row a playlist. Of one restart, k centres are the first k of its picks.
    """
    pid = blocks.schema["playlist_id"].dataType
    keyed = blocks.withColumn("keys", F.transform("rows", lambda r: F.xxhash64(F.lit(seed), r["track_id"])))
    size = blocks.groupBy("playlist_id").agg(F.first("blocks").alias("blocks"))
    none = F.array().cast("array<struct<restart: int, center: array<double>>>")
    state = cut(size.withColumn("cents", none))

    def by_restart(cents, x):
        """Squared distances of all rows to the centres of each restart so far."""
        if not len(cents):
            return [None] * restarts
        turn = cents.field("restart").to_numpy(zero_copy_only=False)
        d2 = _squared(x, cents.field("center").flatten().to_numpy(zero_copy_only=False).reshape(len(cents), -1))
        return [d2[:, turn == r] for r in range(restarts)]

    def draw(turn: int, wanted: int):
        def sample(batches):
            for b in batches:
                for i in range(b.num_rows):
                    part, x = _matrix(b.column("rows"), i)
                    keys = b.column("keys")[i].values.to_numpy(zero_copy_only=False).astype(np.uint64)
                    for r, d2 in enumerate(by_restart(b.column("cents")[i].values, x)):
                        u = (_scrambled(keys, turn, r) >> np.uint64(11)).astype(float) + 0.5
                        far = np.ones(len(x)) if d2 is None else d2.min(1)
                        with np.errstate(divide="ignore"):
                            key = np.where(far > 0, -np.log(u / 2.0**53) / far, np.inf)
                        best = np.argsort(key, kind="stable")[:wanted]
                        best = best[np.isfinite(key[best])]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([b.column("playlist_id")[i].as_py()] * len(best), to_arrow_type(pid)),
                                pa.array(np.full(len(best), r, np.int32)),
                                pa.array(key[best]),
                                part.field("vec").take(pa.array(best)),
                            ],
                            names=["playlist_id", "restart", "key", "center"],
                        )

        return sample

    for turn in range(rounds + 1):
        wanted = 2 * k_max if turn else 1
        drawn = _on_blocks(keyed, state, "keys").mapInArrow(
            draw(turn, wanted), f"playlist_id {pid.simpleString()}, restart int, key double, center array<double>"
        )
        # Equal vectors drawn in one round are one centre.
        new = top_in_group(drawn, ["playlist_id", "restart"], [F.asc("key"), F.asc("center")], wanted)
        new = new.groupBy("playlist_id").agg(F.array_distinct(F.collect_list(F.struct("restart", "center"))).alias("new"))
        state = cut(
            state.join(new, "playlist_id", "left").select(
                "playlist_id", "blocks", F.array_sort(F.concat("cents", F.coalesce("new", none))).alias("cents")
            )
        )

    def weigh(batches):
        for b in batches:
            for i in range(b.num_rows):
                _, x = _matrix(b.column("rows"), i)
                cents = b.column("cents")[i].values
                near = [np.bincount(d2.argmin(1), minlength=d2.shape[1]) for d2 in by_restart(cents, x)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([b.column("playlist_id")[i].as_py()] * len(cents), to_arrow_type(pid)),
                        pa.array(np.arange(len(cents), dtype=np.int32)),
                        pa.array(np.concatenate(near).astype(np.int64)),
                    ],
                    names=["playlist_id", "place", "rows"],
                )

    kind = f"playlist_id {pid.simpleString()}, place int, rows bigint"
    weights = _on_blocks(blocks, state).mapInArrow(weigh, kind).groupBy("playlist_id", "place").agg(F.sum("rows").alias("w"))
    weights = weights.groupBy("playlist_id").agg(F.array_sort(F.collect_list(F.struct("place", "w"))).alias("weights"))

    def pick(batches):
        for b in batches:
            for i in range(b.num_rows):
                cents = b.column("cents")[i].values
                turn = cents.field("restart").to_numpy(zero_copy_only=False)
                x = cents.field("center").flatten().to_numpy(zero_copy_only=False).reshape(len(cents), -1)
                w = b.column("weights")[i].values.field("w").to_numpy(zero_copy_only=False).astype(float)
                for r in range(restarts):
                    mine = np.flatnonzero(turn == r)
                    best = _plus_plus(x[mine], w[mine], k_max, np.random.default_rng([seed, r]))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([b.column("playlist_id")[i].as_py()] * len(best), to_arrow_type(pid)),
                            pa.array(np.full(len(best), r, np.int32)),
                            pa.array(np.arange(len(best), dtype=np.int32)),
                            cents.field("center").take(pa.array(mine[best])),
                        ],
                        names=["playlist_id", "restart", "cid", "center"],
                    )

    picked = state.join(weights, "playlist_id").mapInArrow(
        pick, f"playlist_id {pid.simpleString()}, restart int, cid int, center array<double>"
    )
    return cand.join(picked, "playlist_id").filter(F.col("cid") < F.col("k")).select(
        "playlist_id", "k", "restart", "cid", "center", "blocks"
    )


def _scrambled(keys: np.ndarray, *parts: int) -> np.ndarray:
    """Hashes made anew for each round and restart."""
    for p in (*parts, 1):
        keys = (keys ^ np.uint64(p + 1)) * np.uint64(0x9E3779B97F4A7C15)
        keys = keys ^ (keys >> np.uint64(29))
    return keys


def _plus_plus(x: np.ndarray, w: np.ndarray, k: int, rng: np.random.Generator) -> list[int]:
    """Places of k rows by weighted k-means++; of a few draws a step, the best."""
    tries = 2 + int(np.log(k))
    picks = [int(rng.choice(len(x), p=w / w.sum()))] if w.sum() else []
    far = _squared(x, x[picks]).min(1) if picks else np.zeros(len(x))
    while len(picks) < k and (w * far).sum() > 0:
        draws = rng.choice(len(x), tries, p=w * far / (w * far).sum())
        after = np.minimum(far[:, None], _squared(x, x[draws]))
        best = int((w @ after).argmin())
        picks.append(int(draws[best]))
        far = after[:, best]
    return picks


def gather(centers: DataFrame) -> DataFrame:
    """State of the search: one row per playlist with all its centres, at most
    restarts x (3 + ... + 8) vectors."""
    return centers.groupBy("playlist_id").agg(
        F.first("blocks").alias("blocks"),
        F.array_sort(F.collect_list(F.struct("k", "restart", "cid", "center"))).alias("cents"),
    )


def _on_blocks(blocks: DataFrame, state: DataFrame, *more: str) -> DataFrame:
    """Each block with the centres of its playlist. The centres travel to the
    blocks; the blocks stay where they are."""
    spread = state.select(
        "playlist_id",
        "cents",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"),
    )
    joined = blocks.join(spread.hint("shuffle_hash"), ["playlist_id", "block"])
    return joined.select("playlist_id", "block", "rows", "cents", *more)


def _matrix(values, row: int):
    """Rows of list ``row`` of a list<struct> column: struct array and matrix."""
    part = values[row].values
    vec = part.field("vec") if part.type.get_field_index("vec") >= 0 else part.field("center")
    flat = vec.flatten().to_numpy(zero_copy_only=False)
    return part, flat.reshape(len(part), -1)


def _squared(x, c):
    """Squared distances. Cut to nine digits, so that equal distances tie and
    the lower cluster id wins whatever the order of summation was."""
    far = (x * x).sum(1)[:, None] - 2.0 * (x @ c.T) + (c * c).sum(1)[None, :]
    return np.round(np.maximum(far, 0.0), 9)


def _sets(cents):
    """Slices of the sorted centre list that belong to one (k, restart)."""
    k = cents.field("k").to_numpy(zero_copy_only=False)
    r = cents.field("restart").to_numpy(zero_copy_only=False)
    edges = np.flatnonzero((np.diff(k) != 0) | (np.diff(r) != 0)) + 1
    bounds = [0, *edges.tolist(), len(k)]
    return [(int(k[a]), int(r[a]), a, b) for a, b in zip(bounds[:-1], bounds[1:])]


def lloyd_round(blocks: DataFrame, state: DataFrame) -> DataFrame:
    """One assignment and update for every playlist in ``state``.

    A block sends one row per centre: size, sum of squared distances, mean of
    its members. Block 0 also sends the old centre, which an empty cluster
    keeps. Spark combines the rows per task before it shuffles them.
    """
    pid_type = to_arrow_type(blocks.schema["playlist_id"].dataType)
    pid_sql = blocks.schema["playlist_id"].dataType.simpleString()

    def partial(batches):
        for batch in batches:
            pids, ks, rs, cs, cnt, far, means, olds = [], [], [], [], [], [], [], []
            rows, cents, block = batch.column("rows"), batch.column("cents"), batch.column("block")
            for i in range(batch.num_rows):
                _, x = _matrix(rows, i)
                held, c = _matrix(cents, i)
                d2 = _squared(x, c)
                for k, r, a, b in _sets(held):
                    label = d2[:, a:b].argmin(1)
                    best = d2[np.arange(len(x)), a + label]
                    one = (label[:, None] == np.arange(b - a)[None, :]).astype(float)
                    size = one.sum(0)
                    ks += [k] * (b - a)
                    rs += [r] * (b - a)
                    cs += range(b - a)
                    cnt.append(size)
                    far.append(one.T @ best)
                    means.append((one.T @ x) / np.maximum(size, 1)[:, None])
                pids += [batch.column("playlist_id")[i].as_py()] * len(c)
                olds += list(c) if block[i].as_py() == 0 else [None] * len(c)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(pids, pid_type),
                    pa.array(ks, pa.int32()),
                    pa.array(rs, pa.int32()),
                    pa.array(cs, pa.int32()),
                    pa.array(np.concatenate(cnt) if cnt else [], pa.float64()),
                    pa.array(np.concatenate(far) if far else [], pa.float64()),
                    pa.array([v for m in means for v in m], pa.list_(pa.float64())),
                    pa.array(olds, pa.list_(pa.float64())),
                ],
                names=["playlist_id", "k", "restart", "cid", "cnt", "far", "part", "old"],
            )

    parts = _on_blocks(blocks, state).mapInArrow(
        partial,
        f"playlist_id {pid_sql}, k int, restart int, cid int, cnt double, far double,"
        " part array<double>, old array<double>",
    )
    moved = mean_vectors(
        parts,
        ["playlist_id", "k", "restart", "cid"],
        "part",
        "fresh",
        # The summarizer wants some weight even for a centre without members.
        F.greatest(F.col("cnt"), F.lit(1e-300)),
        F.sum("cnt").alias("size"),
        F.sum("far").alias("far"),
        F.first("old", ignorenulls=True).alias("old"),
    ).withColumn("center", F.when(F.col("size") > 0, F.col("fresh")).otherwise(F.col("old")))
    moved = moved.withColumn("shift", distance(F.col("center"), F.col("old")))
    return moved.groupBy("playlist_id").agg(
        F.array_sort(F.collect_list(F.struct("k", "restart", "cid", "center", "far"))).alias("cents"),
        F.max("shift").alias("shift"),
    )


def lloyd(
    blocks: DataFrame, start: DataFrame, sizes: DataFrame, max_iter: int = 20, tol: float = 1e-4
) -> DataFrame:
    """Rounds until every playlist has converged or ``max_iter`` is reached.

    Converged playlists leave the loop, so late rounds touch only what still
    moves. The state (one bounded row per playlist) is settled after each
    round; only one flag per round comes to the driver.
    """
    active, done = start, None
    for turn in range(max_iter):
        stepped = cut(lloyd_round(blocks, active).join(sizes, "playlist_id"))
        last = turn + 1 == max_iter
        ready = stepped if last else stepped.filter(F.col("shift") <= tol)
        done = ready if done is None else done.unionByName(ready)
        active = stepped.filter(F.col("shift") > tol)
        if last or active.isEmpty():
            break
    return done


def best_restart(state: DataFrame) -> DataFrame:
    """The centres of the restart with the least inertia for each k."""
    flat = state.select("playlist_id", "blocks", F.explode("cents").alias("c")).select(
        "playlist_id", "blocks", "c.*"
    )
    total = flat.groupBy("playlist_id", "k", "restart").agg(
        F.round(F.sum("far"), 9).alias("total")
    )
    best = total.groupBy("playlist_id", "k").agg(F.min(F.struct("total", "restart")).alias("b"))
    keep = best.select("playlist_id", "k", F.col("b.restart").alias("restart"))
    return gather(flat.join(keep, ["playlist_id", "k", "restart"], "left_semi"))


def label(blocks: DataFrame, state: DataFrame, keep_vec: bool = False) -> DataFrame:
    """(playlist_id, track_id, pos, [vec], labels): labels is (k, cluster_id)
    for every k of the playlist, one row per track."""
    rows_type = blocks.schema["rows"].dataType.elementType
    types = {f.name: f.dataType for f in rows_type.fields}
    pid_sql = blocks.schema["playlist_id"].dataType.simpleString()
    lab = pa.struct([("k", pa.int32()), ("cluster_id", pa.int32())])

    def assign(batches):
        for batch in batches:
            rows, cents = batch.column("rows"), batch.column("cents")
            for i in range(batch.num_rows):
                part, x = _matrix(rows, i)
                held, c = _matrix(cents, i)
                d2 = _squared(x, c)
                sets = _sets(held)
                got = np.stack([d2[:, a:b].argmin(1) for _, _, a, b in sets], 1).astype(np.int32)
                ks = np.tile(np.array([s[0] for s in sets], np.int32), len(x))
                offsets = np.arange(0, len(ks) + 1, len(sets), dtype=np.int32)
                labels = pa.ListArray.from_arrays(
                    pa.array(offsets),
                    pa.StructArray.from_arrays(
                        [pa.array(ks), pa.array(got.reshape(-1))], fields=list(lab)
                    ),
                )
                out = [
                    pa.array([batch.column("playlist_id")[i].as_py()] * len(x), batch.column("playlist_id").type),
                    part.field("track_id"),
                    part.field("pos"),
                    labels,
                ]
                names = ["playlist_id", "track_id", "pos", "labels"]
                if keep_vec:
                    out.append(part.field("vec"))
                    names.append("vec")
                yield pa.RecordBatch.from_arrays(out, names=names)

    ddl = (
        f"playlist_id {pid_sql}, track_id {types['track_id'].simpleString()},"
        f" pos {types['pos'].simpleString()}, labels array<struct<k: int, cluster_id: int>>"
    ) + (", vec array<double>" if keep_vec else "")
    return _on_blocks(blocks, state).mapInArrow(assign, ddl)


def block_pairs(labelled: DataFrame, block_rows: int = PAIR_ROWS) -> DataFrame:
    """(playlist_id, block, rows, other, refs, cl): every block of a playlist with each of its blocks.

    A track goes to a block by its hash, so no row holds more than about two
    blocks of ``block_rows``. ``cl`` are the clusters (k, cluster_id, size) of the
    playlist; a k with one cluster, or one cluster per track, has no score.
    """
    size = labelled.groupBy("playlist_id").agg(F.count(F.lit(1)).alias("n"))
    keyed = labelled.join(size, "playlist_id").withColumn("blocks", F.ceil(F.col("n") / block_rows))
    blocks = settle(
        keyed.withColumn("block", F.pmod(F.xxhash64("track_id"), F.col("blocks")))
        .groupBy("playlist_id", "block")
        .agg(F.first("blocks").alias("blocks"), F.collect_list(F.struct("vec", "labels")).alias("rows"))
    )
    clusters = (
        labelled.select("playlist_id", F.explode("labels").alias("l"))
        .groupBy("playlist_id", "l.k", "l.cluster_id")
        .agg(F.count(F.lit(1)).alias("size"))
    )
    held = (
        clusters.groupBy("playlist_id", "k")
        .agg(F.sum("size").alias("n"), F.collect_list(F.struct("k", "cluster_id", "size")).alias("cl"))
        .filter((F.size("cl") >= 2) & (F.size("cl") < F.col("n")))
        .groupBy("playlist_id")
        .agg(F.array_sort(F.flatten(F.collect_list("cl"))).alias("cl"))
    )
    refs = blocks.select(
        "playlist_id",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"),
        F.col("block").alias("other"),
        F.col("rows").alias("refs"),
    )
    mine = blocks.join(held, "playlist_id").select("playlist_id", "block", "rows", "cl")
    return mine.join(refs, ["playlist_id", "block"])


def _labelled_rows(column, i):
    """Vectors of a list of rows, and the k and the cluster of each of their labels."""
    rows = column[i].values
    flat = rows.field("labels").flatten()
    ks = flat.field("k").to_numpy(zero_copy_only=False).reshape(len(rows), -1)
    cl = flat.field("cluster_id").to_numpy(zero_copy_only=False).reshape(len(rows), -1)
    return rows.field("vec").flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1), ks, cl


def _member(ks, cl, held):
    """Which of the clusters each point is in, as 0 and 1."""
    one = np.zeros((len(ks), len(held[0])))
    for j in range(ks.shape[1]):
        one += (ks[:, j][:, None] == held[0][None, :]) & (cl[:, j][:, None] == held[1][None, :])
    return one


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] - 2.0 * (x @ y.T) + (y * y).sum(1)[None, :], 0.0))


def _far(held, own, sums):
    """Mean distance of each point to each cluster, and whether its own in that k is only itself."""
    k, cluster, size = held
    far = sums / np.where(own, np.maximum(size - 1, 1), size)
    alone = np.zeros(own.shape, bool)
    for one in np.unique(k):
        alone[:, k == one] = (own & (size == 1))[:, k == one].any(1)[:, None]
    return far, alone


def _whole_scores(x, ks, cl) -> list[tuple[int, float | None]]:
    """(k, score) of a playlist whose rows are all here, as ``silhouette_exact`` has it."""
    marks = np.stack([ks.ravel(), np.nan_to_num(cl.ravel().astype(float), nan=np.inf)])
    marks, size = np.unique(marks, axis=1, return_counts=True)
    held = [marks[0], np.where(np.isinf(marks[1]), np.nan, marks[1]), size]
    fit = [(held[0] == one).sum() >= 2 and (held[0] == one).sum() < size[held[0] == one].sum() for one in held[0]]
    held = [h[np.array(fit, bool)] for h in held]
    if not len(held[0]):
        return []
    one = _member(ks, cl, held)
    d = _apart(x, x)
    np.fill_diagonal(d, 0.0)
    own = one > 0
    far, alone = _far(held, own, d @ one)
    out = []
    for k in np.unique(held[0]):
        at = held[0] == k
        a = np.where(own, far, -np.inf)[:, at].max(1)
        b = np.where(own, np.inf, far)[:, at].min(1)
        top = np.maximum(a, b)
        zero = alone[:, at][:, 0] | (top <= 0)
        # A point without a cluster of its own has no score.
        some = zero | np.isfinite(a)
        s = np.where(zero, 0.0, (b - a) / np.where(top > 0, top, 1.0))[some]
        out.append((int(k), float(s.mean()) if len(s) else None))
    return out


def silhouette_together(labelled: DataFrame, block_rows: int = PAIR_ROWS) -> tuple[DataFrame, DataFrame]:
    """Scores of the playlists of at most a block that lie in one place (rows of ``grouping.deal``),
    which do not move, and the rows of all others."""
    sizes = settle(labelled.groupBy(*DEALT).agg(F.count(F.lit(1)).alias("_n")))
    short = "_salt = 0 AND _n <= " + str(int(block_rows))
    pid = labelled.schema["playlist_id"].dataType
    schema = pa.schema([("playlist_id", to_arrow_type(pid)), ("k", pa.int32()), ("score", pa.float64())])

    def score(held: pa.Table) -> pa.Table:
        labels, vec = held["labels"].combine_chunks().flatten(), held["vec"].combine_chunks().flatten()
        n = held.num_rows
        ks, cl = (labels.field(c).to_numpy(zero_copy_only=False).reshape(n, -1) for c in ("k", "cluster_id"))
        found = _whole_scores(vec.to_numpy(zero_copy_only=False).reshape(n, -1), ks, cl)
        name = held["playlist_id"][0].as_py()
        return pa.Table.from_pylist([{"playlist_id": name, "k": k, "score": s} for k, s in found], schema)

    usual = labelled.join(sizes.filter(short).drop("_n"), list(DEALT)).select(*DEALT, "vec", "labels")
    scores = usual.groupBy(*DEALT).applyInArrow(score, f"playlist_id {pid.simpleString()}, k int, score double")
    others = sizes.filter(f"NOT ({short})")
    if others.isEmpty():
        return scores, None
    return scores, labelled.join(others.drop("_n"), list(DEALT)).drop("_salt")


def silhouette_exact(labelled: DataFrame, block_rows: int = PAIR_ROWS) -> DataFrame:
    """(playlist_id, k, score): mean Euclidean silhouette of playlists of any size.

    All distances of a playlist are made, a pair of blocks at a time; out come
    the parts of a point's mean distance to each cluster, which Spark adds up. Of a table
    from ``grouping.deal`` only playlists of more than a block move.
    """
    if "_salt" in labelled.columns:
        scores, rest = silhouette_together(labelled, block_rows)
        return scores if rest is None else scores.unionByName(silhouette_exact(rest, block_rows))
    pid = labelled.schema["playlist_id"].dataType

    def parts(key, held, own, sums):
        k, cluster, _ = held
        far, alone = _far(held, own, sums)
        n, m = own.shape
        return pa.RecordBatch.from_arrays(
            [
                pa.array([key[0]] * (n * m), to_arrow_type(pid)),
                pa.array(np.full(n * m, key[1], np.int64)),
                pa.array(np.repeat(np.arange(n, dtype=np.int32), m)),
                pa.array(np.tile(k.astype(np.int32), n)),
                pa.array(np.tile(cluster.astype(np.int32), n)),
                pa.array(own.reshape(-1)),
                pa.array(alone.reshape(-1)),
                pa.array(far.reshape(-1)),
            ],
            names=["playlist_id", "block", "place", "k", "cluster_id", "own", "alone", "far"],
        )

    def meet(batches):
        key = None
        for batch in batches:
            for i in range(batch.num_rows):
                at = (batch.column("playlist_id")[i].as_py(), batch.column("block")[i].as_py())
                if at != key:
                    if key is not None:
                        yield parts(key, held, own, sums)
                    key, cl = at, batch.column("cl")[i].values
                    held = [cl.field(f).to_numpy(zero_copy_only=False) for f in ("k", "cluster_id", "size")]
                    x, ks, ids = _labelled_rows(batch.column("rows"), i)
                    own = _member(ks, ids, held) > 0
                    sums = np.zeros(own.shape)
                y, ks, ids = _labelled_rows(batch.column("refs"), i)
                d = _apart(x, y)
                if batch.column("other")[i].as_py() == key[1]:
                    np.fill_diagonal(d, 0.0)
                sums += d @ _member(ks, ids, held)
        if key is not None:
            yield parts(key, held, own, sums)

    point = ["playlist_id", "block", "place", "k", "alone"]
    far = (
        block_pairs(labelled, block_rows)
        .mapInArrow(
            meet,
            f"playlist_id {pid.simpleString()}, block bigint, place int, k int, cluster_id int,"
            " own boolean, alone boolean, far double",
        )
        .groupBy(*point, "cluster_id", "own")
        .agg(F.sum("far").alias("far"))
    )
    both = far.groupBy(*point).agg(
        F.max(F.when(F.col("own"), F.col("far"))).alias("a"), F.min(F.when(~F.col("own"), F.col("far"))).alias("b")
    )
    top = F.greatest("a", "b")
    s = F.when(F.col("alone") | (top <= 0), F.lit(0.0)).otherwise((F.col("b") - F.col("a")) / top)
    return both.groupBy("playlist_id", "k").agg(F.avg(s).alias("score"))


def silhouette_moments(points: DataFrame) -> DataFrame:
    """(playlist_id, k, score) from cluster moments, linear in the rows.

    ``points``: (playlist_id, track_id, k, cluster_id, vec). Squared Euclidean
    distance, as in ``ClusteringEvaluator``: the mean squared distance of x to
    a cluster is |x|^2 - 2 x.mean + mean|y|^2, so no pair is ever formed.
    """
    keyed = points.withColumn("sq", dot(F.col("vec"), F.col("vec")))
    moments = mean_vectors(
        keyed,
        ["playlist_id", "k", "cluster_id"],
        "vec",
        "mean",
        None,
        F.count(F.lit(1)).alias("size"),
        F.avg("sq").alias("msq"),
    )
    held = moments.groupBy("playlist_id", "k").agg(
        F.collect_list(F.struct("cluster_id", "mean", "size", "msq")).alias("cl")
    )

    def far(c):
        return F.greatest(F.col("sq") - 2 * dot(F.col("vec"), c["mean"]) + c["msq"], F.lit(0.0))

    scored = (
        keyed.join(held.filter(F.size("cl") >= 2), ["playlist_id", "k"])
        .withColumn(
            "far",
            F.transform(
                "cl", lambda c: F.struct(c["cluster_id"].alias("cid"), c["size"].alias("size"), far(c).alias("d"))
            ),
        )
        .withColumn("own", F.filter("far", lambda c: c["cid"] == F.col("cluster_id"))[0])
        .withColumn(
            "b", F.array_min(F.transform(F.filter("far", lambda c: c["cid"] != F.col("cluster_id")), lambda c: c["d"]))
        )
        .withColumn("a", F.col("own.d") * F.col("own.size") / F.nullif(F.col("own.size") - 1, F.lit(0)))
    )
    s = F.when(F.col("own.size") == 1, F.lit(0.0)).otherwise(
        F.coalesce((F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0)), F.lit(0.0))
    )
    return scored.groupBy("playlist_id", "k").agg(F.avg(s).alias("score"))


def silhouette(labelled: DataFrame, sizes: DataFrame, metric: str = "squared") -> DataFrame:
    """Score of every (playlist, k), the same kind at every size.

    ``squared`` (default) uses squared distances by cluster moments and is linear
    in the tracks; ``euclidean`` makes all distances of a playlist, in pairs of
    blocks, so its time grows with the square of the playlist.
    """
    asked = sizes.select("playlist_id").distinct()
    if metric == "euclidean":
        # What is left out is left out of the scores: those are short, the rows are not.
        return silhouette_exact(labelled).join(asked, "playlist_id")
    rows = labelled.join(asked, "playlist_id")
    points = rows.select("playlist_id", "track_id", "vec", F.explode("labels").alias("l"))
    return silhouette_moments(points.select("playlist_id", "track_id", "vec", "l.k", "l.cluster_id"))


def choose_k(cand: DataFrame, scores: DataFrame) -> DataFrame:
    """(playlist_id, k): best silhouette, the smaller k on a tie, the smallest
    candidate where nothing could be scored."""
    ranked = cand.join(scores, ["playlist_id", "k"], "left").withColumn(
        "score", F.coalesce(F.round("score", 9), F.lit(float("-inf")))
    )
    best = ranked.groupBy("playlist_id").agg(F.max(F.struct("score", (-F.col("k")).alias("neg"))).alias("b"))
    return best.select("playlist_id", (-F.col("b.neg")).alias("k"))


def block_silhouette(blocks: DataFrame, state: DataFrame) -> DataFrame:
    """(playlist_id, k, score): ``silhouette_moments`` of the clusters around the centres
    of ``state`` (one set for each k), without moving a vector.

    Blocks send the moments of their members, get those of the whole playlist back, and
    send one sum of scores for each k.
    """
    pid = blocks.schema["playlist_id"].dataType
    moments = _moments(blocks, state, pid)

    def sums(batches):
        for b in batches:
            out = []
            for i in range(b.num_rows):
                _, x = _matrix(b.column("rows"), i)
                held = b.column("cents")[i].values
                k, size, msq = (held.field(c).to_numpy(zero_copy_only=False) for c in ("k", "size", "msq"))
                at = lambda c: held.field(c).flatten().to_numpy(zero_copy_only=False).reshape(len(held), -1)
                near = _squared(x, at("center"))
                mean = at("mean")
                far = np.maximum((x * x).sum(1)[:, None] - 2.0 * (x @ mean.T) + msq[None, :], 0.0)
                for one in np.unique(k):
                    cols = np.flatnonzero(k == one)
                    own = near[:, cols].argmin(1)
                    full = size[cols] > 0  # an empty cluster has no distance
                    if full.sum() < 2:
                        continue
                    d = np.where(full[None, :], far[:, cols], np.inf)
                    n, rows = size[cols][own], np.arange(len(x))
                    a = d[rows, own] * n / np.maximum(n - 1, 1)
                    d[rows, own] = np.inf
                    b_ = d.min(1)
                    top = np.maximum(a, b_)
                    s = np.where((n == 1) | (top <= 0), 0.0, (b_ - a) / np.where(top > 0, top, 1.0))
                    out.append((b.column("playlist_id")[i].as_py(), int(one), float(s.sum()), len(x)))
            cols = list(zip(*out)) or [[], [], [], []]
            kinds = [to_arrow_type(pid), pa.int32(), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, kinds)], names=["playlist_id", "k", "total", "rows"]
            )

    return (
        _on_blocks(blocks, moments)
        .mapInArrow(sums, f"playlist_id {pid.simpleString()}, k int, total double, rows bigint")
        .groupBy("playlist_id", "k")
        .agg((F.sum("total") / F.sum("rows")).alias("score"))
    )


def _moments(blocks: DataFrame, state: DataFrame, pid) -> DataFrame:
    """``state`` with size, mean and mean square of the members of every centre."""

    def partial(batches):
        for b in batches:
            for i in range(b.num_rows):
                _, x = _matrix(b.column("rows"), i)
                held, c = _matrix(b.column("cents"), i)
                near, sq = _squared(x, c), (x * x).sum(1)
                size, mean, msq = [], [], []
                for _, _, lo, hi in _sets(held):
                    one = (near[:, lo:hi].argmin(1)[:, None] == np.arange(hi - lo)[None, :]).astype(float)
                    size.append(one.sum(0))
                    full = np.maximum(size[-1], 1)
                    mean.append((one.T @ x) / full[:, None])
                    msq.append((one.T @ sq) / full)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([b.column("playlist_id")[i].as_py()] * len(c), to_arrow_type(pid)),
                        held.field("k").cast(pa.int32()),
                        held.field("cid").cast(pa.int32()),
                        pa.array(np.concatenate(size)),
                        pa.array([v for m in mean for v in m], pa.list_(pa.float64())),
                        pa.array(np.concatenate(msq)),
                    ],
                    names=["playlist_id", "k", "cid", "cnt", "part", "msq"],
                )

    parts = _on_blocks(blocks, state).mapInArrow(
        partial,
        f"playlist_id {pid.simpleString()}, k int, cid int, cnt double, part array<double>, msq double",
    )
    keys = ["playlist_id", "k", "cid"]
    means = mean_vectors(
        parts,
        keys,
        "part",
        "mean",
        F.greatest(F.col("cnt"), F.lit(1e-300)),
        F.sum("cnt").alias("size"),
        F.coalesce(F.sum(F.col("msq") * F.col("cnt")) / F.nullif(F.sum("cnt"), F.lit(0.0)), F.lit(0.0)).alias("msq"),
    )
    flat = state.select("playlist_id", "blocks", F.explode("cents").alias("c")).select(
        "playlist_id", "blocks", "c.k", "c.cid", "c.center"
    )
    return (
        flat.join(means, keys)
        .groupBy("playlist_id")
        .agg(
            F.first("blocks").alias("blocks"),
            F.array_sort(F.collect_list(F.struct("k", "cid", "center", "mean", "size", "msq"))).alias("cents"),
        )
    )


def cluster(
    vectors: DataFrame,
    k_min: int = 3,
    k_max: int = 8,
    restarts: int = 3,
    max_iter: int = 20,
    tol: float = 1e-4,
    metric: str = "squared",
    seed: int = 42,
    init: str = "parallel",
) -> DataFrame:
    """(playlist_id, track_id, pos, vec, cluster_id): the whole search."""
    blocks, best, cand = fit(vectors, k_min, k_max, restarts, max_iter, tol, seed, init)
    if metric == "euclidean":
        scores = silhouette(settle(label(blocks, best, keep_vec=True)), cand, metric)
    else:
        scores = block_silhouette(blocks, best)
    chosen = choose_k(cand, scores).select("playlist_id", F.col("k").alias("chosen"))
    only = best.join(chosen, "playlist_id").select(
        "playlist_id", "blocks", F.filter("cents", lambda c: c["k"] == F.col("chosen")).alias("cents")
    )
    picked = label(blocks, only, keep_vec=True)
    return picked.select("playlist_id", "track_id", "pos", "vec", F.col("labels")[0]["cluster_id"].alias("cluster_id"))


def fit(vectors, k_min=3, k_max=8, restarts=3, max_iter=20, tol=1e-4, seed=42, init="parallel"):
    """(blocks, best, candidates): the best centres of every playlist for every k.

    ``init`` is ``parallel`` (k-means||) or ``hash`` (the tracks with the smallest keys,
    a start that other engines can repeat).
    """
    if init not in ("parallel", "hash"):
        raise ValueError(f"init {init!r}")
    blocks = pack(vectors)
    cand = candidates(blocks, k_min, k_max)
    first = {"parallel": parallel_seeds, "hash": seeds}[init]
    start = cut(gather(first(blocks, cand, restarts, max(k_max, 2), seed)))
    state = lloyd(blocks, start, start.select("playlist_id", "blocks"), max_iter, tol)
    return blocks, cut(best_restart(state)), cand


def search(vectors, k_min=3, k_max=8, restarts=3, max_iter=20, tol=1e-4, seed=42, init="parallel"):
    """(labelled, candidates): every track with its cluster for every k."""
    blocks, best, cand = fit(vectors, k_min, k_max, restarts, max_iter, tol, seed, init)
    return settle(label(blocks, best, keep_vec=True)), cand
