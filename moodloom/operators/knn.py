"""Exact nearest-neighbour join over a two-level pivot index (after Lu, Shen, Chen,
Ooi: "Efficient Processing of k Nearest Neighbor Joins using MapReduce", 2012).

The catalog is cut into coarse cells around pivots and each of those into fine cells of
about ``FINE`` tracks around pivots of its own, so the number of cells grows with the
catalog while one level never has more than ``COARSE`` pivots in one place. A cell knows
the distances of its nearest and its farthest track to its pivot.

A search has two passes. The first looks into one block at home, of the fine cell nearest to
the query that holds enough tracks, and takes the distance of the k-th track found there. Any k
tracks bound the distance of the k-th nearest, so nothing is merged and the query goes on from
there with its bound. The second pass visits only
cells that can hold a nearer one: by the triangle inequality a track of a cell lies at
least ``d - far`` and ``near - d`` away, d being the distance to the pivot. Whole coarse
cells drop out first, then fine cells. A cell also knows the least and the greatest value of
each dimension, and a track is no nearer than the box between them. Of tracks as far away as the
k-th found at home only those with a smaller id are wanted, and of equal vectors of a block only the
first k are looked at. Queries are packed per cell after they are routed,
so what travels is in proportion to the visited cells. A task reduces a pack of queries
and a block of tracks to the tracks within the bound; candidate pairs never become rows.

Members are left out afterwards: a query first asks for one track more than it needs, and only
those that end up short because of members ask again, for four times as many.
"""

from __future__ import annotations

import math
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moodloom.operators.grouping import rank_in_group, top_in_group
from moodloom.session import settle

#: Tracks of a fine cell, most cells of a level in one place.
FINE, COARSE = 256, 1024
#: Most tracks of a block (a cell of equal vectors has many), most queries of a pack, and of one step of routing.
BLOCK, ASKS, PIECE = 1024, 512, 4096
#: Tasks among which the queries of one home cell are dealt out.
DEAL = 4
#: Up to so many fine cells, their pivots go along and a query finds its home among all of them.
FLAT = 8192
#: How many tracks more than it has to a query with members asks for at first, and how it goes on.
SPARE, MORE = 1, 4
#: What rounding may add to a distance.
EDGE = 1e-6


def _floats(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _ints(scalar) -> np.ndarray:
    return scalar.values.to_numpy(zero_copy_only=False)


def _dist(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Distances of rows, one dimension at a time: equal vectors give equal numbers
    whatever block they lie in; the rest of the noise is rounded off."""
    total = np.zeros(np.broadcast_shapes(q.shape, c.shape)[:-1])
    for j in range(q.shape[-1]):
        total += (q[..., j] - c[..., j]) ** 2
    return np.round(np.sqrt(total), 9)


def _rough(q: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, float]:
    """Squared distances of all pairs by one matrix product, and their largest error."""
    qq, cc = (q * q).sum(1), (c * c).sum(1)
    error = 1e-12 * (1.0 + float(qq.max(initial=0.0)) + float(cc.max(initial=0.0)))
    return qq[:, None] - 2.0 * (q @ c.T) + cc[None, :], error


def _apart(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Distance of each row to each box, 0 inside."""
    total = np.zeros((len(q), len(low)))
    for j in range(q.shape[1]):
        x = q[:, j, None]
        total += np.maximum(np.maximum(low[None, :, j] - x, x - high[None, :, j]), 0.0) ** 2
    return np.sqrt(total)


def _up_to(ids: pa.Array, last: pa.Array) -> np.ndarray:
    """How many of the sorted ``ids`` (nulls first) are no greater than each of ``last``."""
    none = ids.null_count
    known = ids.slice(none).to_numpy(zero_copy_only=False)
    ends, open_ = np.full(len(last), none), np.flatnonzero(last.is_valid().to_numpy(zero_copy_only=False))
    if len(open_):
        ends[open_] += np.searchsorted(known, last.take(pa.array(open_)).to_numpy(zero_copy_only=False), side="right")
    return ends


def _boxes(rows: DataFrame, key: str) -> DataFrame:
    """(key, low, high): the box around the vectors of each cell. A row per cell and dimension
    combines before the shuffle."""
    ends = rows.select(key, F.posexplode("vec").alias("j", "x")).groupBy(key, "j").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    packed = ends.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("j", "low", "high"))).alias("b"))
    return packed.select(key, F.col("b.low").alias("low"), F.col("b.high").alias("high"))


def _to_pivots(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest pivot of each row and the distance to it."""
    near = _rough(x, pivots)[0].argmin(1)
    return near, _dist(x, pivots[near])


def _found(asks, rows, same):
    """(who, col, d) of each query of a pack: its first ``take`` tracks of a block within its
    bound, in order. At the bound itself only tracks up to the id ``last`` count, or all if ``ties``."""
    take = asks.field("take").to_numpy(zero_copy_only=False)
    bound = asks.field("bound").to_numpy(zero_copy_only=False)
    # Of equal vectors no more than the first ``take`` can be wanted.
    kept = np.flatnonzero(same < take.max(initial=1))
    q, c = _floats(asks.field("vec")), _floats(rows.field("vec"))[kept]
    d, error = _rough(q, c)
    limit = (bound + EDGE) ** 2 + error
    inside = d <= limit[:, None]
    # No more than the first ``m`` can be wanted.
    m = int(min(take.max(initial=1), len(c)))
    full = np.flatnonzero(inside.sum(1) > m)
    if len(full):
        most = np.partition(d[full], m - 1, axis=1)[:, m - 1] + 2 * error + EDGE
        inside[full] &= d[full] <= most[:, None]
    who, col = np.nonzero(inside)
    d, col = _dist(q[who], c[col]), kept[col]
    ends = _up_to(rows.field("track_id"), asks.field("last"))
    free = asks.field("ties").to_numpy(zero_copy_only=False)
    inside = (d < bound[who]) | ((d == bound[who]) & (free[who] | (col < ends[who])))
    who, col, d = who[inside], col[inside], d[inside]
    order = np.lexsort((col, d, who))
    who, col, d = who[order], col[order], d[order]
    rank = np.arange(len(who)) - np.searchsorted(who, who)
    return (x[rank < take[who]] for x in (who, col, d))


class Index:
    """Cells of a catalog (track_id, vec), settled once for many searches."""

    def __init__(self, catalog: DataFrame, fine: int = FINE):
        self.fine = fine
        self.rows = settle(catalog.select("track_id", "vec"))
        self.track_type = catalog.schema["track_id"].dataType.simpleString()
        self.total = self.rows.count()

    @cached_property
    def once(self) -> bool:
        """Whether no track comes twice."""
        return self.rows.groupBy("track_id").count().where("count > 1").isEmpty()

    @property
    def parts(self) -> int:
        return int(self.rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    @cached_property
    def pivots(self) -> np.ndarray:
        """Coarse pivots: the tracks with the smallest keys."""
        n = min(max(math.isqrt(-(-self.total // self.fine)), 1), COARSE)
        key = F.md5(F.col("track_id").cast("string"))
        return np.array([r[0] for r in self.rows.orderBy(key, "track_id").limit(n).select("vec").collect()], float)

    @cached_property
    def _coarse(self) -> DataFrame:
        """(coarse, to_coarse, track_id, vec)"""
        pivots = self.pivots

        def place(batches):
            for b in batches:
                near, far = _to_pivots(_floats(b.column("vec")), pivots)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(near.astype(np.int64)), pa.array(far), b.column("track_id"), b.column("vec")],
                    ["coarse", "to_coarse", "track_id", "vec"],
                )

        kind = f"coarse bigint, to_coarse double, track_id {self.track_type}, vec array<double>"
        return settle(self.rows.mapInArrow(place, kind))

    @cached_property
    def coarse_radii(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest and farthest track and size of each coarse cell (one bounded row each)."""
        near, far = np.full(len(self.pivots), np.inf), np.full(len(self.pivots), -np.inf)
        n = np.zeros(len(self.pivots), np.int64)
        for r in self._coarse.groupBy("coarse").agg(F.min("to_coarse"), F.max("to_coarse"), F.count(F.lit(1))).collect():
            near[r[0]], far[r[0]], n[r[0]] = r[1], r[2], r[3]
        return near, far, n

    @cached_property
    def coarse_boxes(self) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest value of each dimension of each coarse cell (one bounded row each)."""
        low = np.full(self.pivots.shape, np.inf)
        high = -low
        for r in _boxes(self._coarse, "coarse").collect():
            low[r[0]], high[r[0]] = r[1], r[2]
        return low, high

    @cached_property
    def _fine_pivots(self) -> DataFrame:
        """(coarse, pivots): one row of bounded size for each coarse cell."""
        size = self._coarse.groupBy("coarse").agg(F.count(F.lit(1)).alias("n"))
        keyed = self._coarse.select("coarse", "track_id", "vec", F.md5(F.col("track_id").cast("string")).alias("key"))
        first = top_in_group(keyed, ["coarse"], [F.asc("key"), F.asc("track_id")], COARSE)
        some = first.join(size, "coarse").where(F.col("rn") <= F.ceil(F.col("n") / self.fine))
        return settle(some.groupBy("coarse").agg(F.array_sort(F.collect_list(F.struct("rn", "vec"))).alias("pivots")))

    @cached_property
    def placed(self) -> DataFrame:
        """(cell, radius, track_id, vec): every track in its fine cell."""
        size = self._coarse.groupBy("coarse").agg(F.count(F.lit(1)).alias("n"))
        packs = (
            self._coarse.join(size, "coarse")
            .withColumn("salt", F.pmod(F.xxhash64("track_id"), F.ceil(F.col("n") / (4 * BLOCK))))
            .groupBy("coarse", "salt")
            .agg(F.collect_list(F.struct("track_id", "vec")).alias("rows"))
            .join(self._fine_pivots, "coarse")
        )

        def place(batches):
            for b in batches:
                for i, coarse in enumerate(b.column("coarse").to_pylist()):
                    rows, pivots = b.column("rows")[i].values, _floats(b.column("pivots")[i].values.field("vec"))
                    near, far = _to_pivots(_floats(rows.field("vec")), pivots)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(coarse * COARSE + near), pa.array(far), rows.field("track_id"), rows.field("vec")],
                        ["cell", "radius", "track_id", "vec"],
                    )

        return settle(packs.mapInArrow(place, f"cell bigint, radius double, track_id {self.track_type}, vec array<double>"))

    @cached_property
    def sizes(self) -> DataFrame:
        """(cell, n, near, far)"""
        return settle(
            self.placed.groupBy("cell").agg(
                F.count(F.lit(1)).alias("n"), F.min("radius").alias("near"), F.max("radius").alias("far")
            )
        )

    @cached_property
    def fines(self) -> DataFrame:
        """(coarse, cells): the fine cells of each coarse one with pivot, size and radii."""
        pivots = self._fine_pivots.select("coarse", F.posexplode("pivots").alias("fine", "p")).select(
            (F.col("coarse") * COARSE + F.col("fine")).alias("cell"), "coarse", F.col("p.vec").alias("vec")
        )
        cells = pivots.join(self.sizes, "cell").join(_boxes(self.placed, "cell"), "cell")
        kept = F.struct("cell", "vec", "n", "near", "far", "low", "high")
        return settle(cells.groupBy("coarse").agg(F.collect_list(kept).alias("cells")))

    @cached_property
    def flat(self) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Number, size and pivot of every fine cell (``FLAT`` rows at most), or None if they are more."""
        if self.sizes.count() > FLAT:
            return None
        cells = [c for r in self.fines.select(F.transform("cells", lambda c: F.struct(c["cell"], c["n"], c["vec"]))).collect() for c in r[0]]
        cells.sort(key=lambda c: c[0])
        return np.array([c[0] for c in cells], np.int64), np.array([c[1] for c in cells], np.int64), np.array([c[2] for c in cells], float)

    @cached_property
    def blocks(self) -> DataFrame:
        """(cell, block, rows, same): tracks in id order, and how many equal vectors come before each.
        A cell of many tracks is cut in order of the ids."""
        keyed = self.placed.join(self.sizes.select("cell", "n"), "cell").select("cell", "n", "track_id", "vec")
        small = keyed.where(F.col("n") <= BLOCK).withColumn("block", F.lit(0).cast("bigint"))
        if not self.sizes.where(F.col("n") > BLOCK).isEmpty():
            ranked = rank_in_group(keyed.where(F.col("n") > BLOCK), ["cell"], [F.asc("track_id")])
            small = small.unionByName(ranked.withColumn("block", F.floor((F.col("rn") - 1) / BLOCK)).drop("rn"))
        packed = small.groupBy("cell", "block").agg(F.array_sort(F.collect_list(F.struct("track_id", "vec"))).alias("rows"))

        def count(batches):
            for b in batches:
                rows = b.column("rows")
                x = _floats(rows.flatten().field("vec"))
                sizes = np.diff(rows.offsets.to_numpy())
                cuts, same = np.r_[0, np.cumsum(sizes)], np.zeros(len(x), np.int32)
                for a, z in zip(cuts[:-1], cuts[1:]):
                    _, kind = np.unique(x[a:z], axis=0, return_inverse=True)
                    kind = kind.ravel()
                    order = kind.argsort(kind="stable")
                    same[a + order] = np.arange(z - a) - np.searchsorted(kind[order], kind[order])
                yield pa.RecordBatch.from_arrays(
                    [b.column("cell"), b.column("block"), rows, pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(same))],
                    ["cell", "block", "rows", "same"],
                )

        kind = f"cell bigint, block bigint, rows {packed.schema['rows'].dataType.simpleString()}, same array<int>"
        return settle(packed.mapInArrow(count, kind))

    def _route(self, asks: DataFrame, home: bool) -> DataFrame:
        """(cell, nth, asks): packs of queries with the fine cells they look into.

        ``asks`` is one struct column ``ask``; with ``home`` only the nearest cell that
        alone holds enough tracks, else all that its bound does not exclude.
        """
        pivots, (near, far, held), (low, high) = self.pivots, self.coarse_radii, self.coarse_boxes
        ask = asks.schema["ask"].dataType.simpleString()

        def chosen(x, d, near, far, low, high, bound):
            with np.errstate(invalid="ignore"):  # a cell without a track has no box
                ball, box = np.maximum(d - far, near - d), _apart(x, low, high)
            return (ball <= bound[:, None] + EDGE) & (box <= bound[:, None] + EDGE)

        def pack(asks, take, key, name):
            """One row of asks for each True column of ``take``, in pieces of ASKS."""
            keys, lists = [], []
            for c in np.flatnonzero(take.any(0)):
                rows = np.flatnonzero(take[:, c])
                for a in range(0, len(rows), ASKS):
                    keys.append(key[c])
                    lists.append(rows[a : a + ASKS])
            cuts = np.r_[0, np.cumsum([len(x) for x in lists])].astype(np.int32)
            held = asks.take(pa.array(np.concatenate(lists) if lists else np.empty(0, np.int64)))
            return pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(np.arange(len(keys))), pa.ListArray.from_arrays(cuts, held)], [name, "nth", "asks"]
            )

        def reach(d, bound, want):
            """``bound``, or where there is none the end of the coarse cells that together hold enough tracks."""
            open_ = np.flatnonzero(np.isinf(bound))
            if len(open_):
                ends = np.where(held > 0, d[open_] + far, np.inf)
                order = ends.argsort(1)
                enough = held[order].cumsum(1) >= want[open_][:, None]
                at = np.take_along_axis(ends, np.take_along_axis(order, enough.argmax(1)[:, None], 1), 1)[:, 0]
                bound = bound.copy()
                bound[open_] = np.where(enough.any(1), at + EDGE, np.inf)
            return bound

        def coarse(batches):
            for b in batches:
                for at in range(0, b.num_rows, PIECE):
                    asks = b.column("ask").slice(at, PIECE)
                    x = _floats(asks.field("vec"))
                    d = np.sqrt(np.maximum(_rough(x, pivots)[0], 0.0))
                    if home:
                        want = asks.field("take").to_numpy(zero_copy_only=False)
                        d = np.where(held[None, :] >= want[:, None], d, np.inf)
                        d[np.isinf(d).all(1)] = np.where(held > 0, -held, np.inf)
                        take = np.arange(len(pivots))[None, :] == d.argmin(1)[:, None]
                    else:
                        bound = reach(d, asks.field("bound").to_numpy(zero_copy_only=False), asks.field("take").to_numpy(zero_copy_only=False))
                        take = chosen(x, d, near, far, low, high, bound)
                    yield pack(asks, take, np.arange(len(pivots)), "coarse")

        def nearest_cell(d, n, asks):
            """The nearest cell that alone holds enough tracks, or the largest one."""
            want = asks.field("take").to_numpy(zero_copy_only=False)
            d = np.where(np.minimum(n, BLOCK)[None, :] >= want[:, None], d, np.inf)
            d[np.isinf(d).all(1)] = -n
            return np.arange(len(n))[None, :] == d.argmin(1)[:, None]

        def at_once(batches):
            cell, n, vec = flat
            for b in batches:
                for at in range(0, b.num_rows, PIECE):
                    asks = b.column("ask").slice(at, PIECE)
                    yield pack(asks, nearest_cell(_rough(_floats(asks.field("vec")), vec)[0], n, asks), cell, "cell")

        def fine(batches):
            for b in batches:
                for i in range(b.num_rows):
                    asks, cells = b.column("asks")[i].values, b.column("cells")[i].values
                    x = _floats(asks.field("vec"))
                    d = np.sqrt(np.maximum(_rough(x, _floats(cells.field("vec")))[0], 0.0))
                    n, least, most = (cells.field(c).to_numpy(zero_copy_only=False) for c in ("n", "near", "far"))
                    if home:
                        take = nearest_cell(d, n, asks)
                    else:
                        box = [_floats(cells.field(c)) for c in ("low", "high")]
                        take = chosen(x, d, least, most, *box, asks.field("bound").to_numpy(zero_copy_only=False))
                    yield pack(asks, take, cells.field("cell").to_numpy(zero_copy_only=False), "cell")

        kind = f"coarse bigint, nth bigint, asks array<{ask}>"
        flat = self.flat if home else None
        if flat is not None:
            return asks.mapInArrow(at_once, kind.replace("coarse", "cell"))
        packs = asks.mapInArrow(coarse, kind)
        met = packs.select("coarse", "asks").join(self.fines, "coarse")
        return met.mapInArrow(fine, kind.replace("coarse", "cell"))

    def _gathered(self, packs: DataFrame) -> DataFrame:
        """(cell, asks): the packs of a cell brought together, so that a block meets many queries at once, and so
        do the cells that those visit later. A cell with very many queries is dealt out to ``DEAL`` tasks."""
        kind = packs.schema["asks"].dataType

        def merge(batches):
            for b in batches:
                cell, lists = b.column("cell").to_numpy(zero_copy_only=False), b.column("asks")
                sizes = np.diff(lists.offsets.to_numpy())
                which = np.repeat(cell, sizes)
                new = np.r_[True, which[1:] != which[:-1]] if len(which) else np.empty(0, bool)
                first = np.maximum.accumulate(np.where(new, np.arange(len(which)), 0))
                starts = np.flatnonzero((np.arange(len(which)) - first) % ASKS == 0)
                cuts = np.r_[starts, len(which)].astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(which[starts], pa.int64()), pa.ListArray.from_arrays(pa.array(cuts), lists.flatten())], ["cell", "asks"]
                )

        moved = packs.select("cell", "asks", F.pmod(F.spark_partition_id(), F.lit(DEAL)).alias("_s"))
        near = moved.repartition(self.parts, "cell", "_s").sortWithinPartitions("cell").select("cell", "asks")
        return near.mapInArrow(merge, f"cell bigint, asks {kind.simpleString()}")

    def _bounded(self, packs: DataFrame) -> DataFrame:
        """(ask): the queries of ``packs`` with the distance and the id of the last of their first
        ``take`` tracks in one block of the cell; those that find fewer have no bound."""
        ask = packs.schema["asks"].dataType.elementType
        fields = [f.name for f in ask.fields]

        def bound(batches):
            for b in batches:
                for i in range(b.num_rows):
                    asks, rows = b.column("asks")[i].values, b.column("rows")[i].values
                    who, col, d = _found(asks, rows, _ints(b.column("same")[i]))
                    ends = np.searchsorted(who, np.arange(len(asks)), "right")
                    take = asks.field("take").to_numpy(zero_copy_only=False)
                    known = np.diff(np.r_[0, ends]) == take
                    at = np.where(known, ends - 1, 0)
                    ids = rows.field("track_id").take(pa.array(col[at] if len(col) else at, pa.int64(), mask=~known))
                    new = {
                        "bound": pa.array(np.where(known, d[at] if len(d) else np.inf, np.inf)),
                        "last": ids,
                        "ties": pa.array(~known),
                    }
                    yield pa.RecordBatch.from_arrays(
                        [pa.StructArray.from_arrays([new.get(f, asks.field(f)) for f in fields], fields)], ["ask"]
                    )

        met = packs.join(self.blocks.where("block = 0"), "cell").select("asks", "rows", "same")
        return met.mapInArrow(bound, f"ask {ask.simpleString()}")

    def _meet(self, packs: DataFrame) -> DataFrame:
        """(playlist_id, part, qid, track_id, distance): for each query of a pack the
        first ``take`` tracks of each block within its bound. At the bound itself only tracks up
        to the id ``last`` count, or all if ``ties``."""
        names = ("playlist_id", "part", "qid")

        def nearest(batches):
            for b in batches:
                for i in range(b.num_rows):
                    asks, rows = b.column("asks")[i].values, b.column("rows")[i].values
                    who, col, d = _found(asks, rows, _ints(b.column("same")[i]))
                    yield pa.RecordBatch.from_arrays(
                        [*[asks.field(c).take(pa.array(who)) for c in names], rows.field("track_id").take(pa.array(col)), pa.array(d)],
                        [*names, "track_id", "distance"],
                    )

        own = packs.schema["asks"].dataType.elementType
        kind = ", ".join(f"{c} {own[c].dataType.simpleString()}" for c in names)
        met = packs.join(self.blocks, "cell").select("asks", "rows", "same")
        return met.mapInArrow(nearest, f"{kind}, track_id {self.track_type}, distance double")

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """(playlist_id, part, qid, track_id, distance): at least the ``k`` nearest tracks of every
        query (playlist_id, part, qid, vec), ties by id, and some further ones."""
        ask = F.struct(
            "playlist_id",
            "part",
            "qid",
            F.col("vec").cast("array<double>").alias("vec"),
            F.lit(float("inf")).alias("bound"),
            F.lit(k).cast("bigint").alias("take"),
            F.lit(None).cast(self.track_type).alias("last"),
            F.lit(True).alias("ties"),
        )
        first = self._route(queries.select(ask.alias("ask")), True)
        self.routed = self._route(self._bounded(self._gathered(first)), False)
        return self._meet(self.routed)

    def nearest(self, queries: DataFrame, members: DataFrame, k: int = 10) -> DataFrame:
        """The ``k`` nearest tracks of every query that are not members.

        queries: (playlist_id, part, qid, vec); members: (playlist_id, part, track_id),
        left out for the queries of the same (playlist_id, part). Returns (playlist_id,
        part, qid, track_id, distance, rn); ties by id.
        """
        keys = ["playlist_id", "part"]
        if self.total == 0:
            return queries.select(*keys, "qid").limit(0).join(
                self.rows.select("track_id", F.lit(0.0).alias("distance"), F.lit(0).alias("rn")), F.lit(False)
            )
        queries = settle(queries.select(*keys, "qid", F.col("vec").cast("array<double>").alias("vec")))
        return outside(lambda asks, n: self.search(asks, n), queries, members.select(*keys, "track_id"), k, self.total)

    def within(self, queries: DataFrame) -> DataFrame:
        """All tracks no further than ``bound`` from each query.

        queries: (playlist_id, part, qid, vec, bound). Returns (playlist_id, part, qid,
        track_id, distance). Only cells that reach into the bound are visited.
        """
        ask = F.struct(
            "playlist_id",
            "part",
            "qid",
            F.col("vec").cast("array<double>").alias("vec"),
            F.col("bound").cast("double").alias("bound"),
            F.lit((1 << 31) - 1).cast("bigint").alias("take"),
            F.lit(None).cast(self.track_type).alias("last"),
            F.lit(True).alias("ties"),
        )
        if self.total == 0:
            return queries.select("playlist_id", "part", "qid").limit(0).join(
                self.rows.select("track_id", F.lit(0.0).alias("distance")), F.lit(False)
            )
        self.routed = self._route(settle(queries.select(ask.alias("ask"))).repartition(self.parts), False)
        return self._meet(self.routed)

    def visited_share(self) -> float:
        """Share of (query, track) pairs that the second pass of the last search looks at."""
        asked = self.routed.select("cell", F.size("asks").alias("asks")).join(self.sizes, "cell")
        seen = asked.agg(F.sum(F.col("asks") * F.col("n"))).first()[0] or 0
        queries = self.routed.select(F.explode("asks").alias("a")).select("a.playlist_id", "a.part", "a.qid").distinct().count()
        return seen / max(1, queries * self.total)


def knn_join(queries: DataFrame, catalog: DataFrame | Index, members: DataFrame, k: int = 10) -> DataFrame:
    """``Index.nearest`` over a catalog that is searched once, or over an index."""
    index = catalog if isinstance(catalog, Index) else Index(catalog)
    return index.nearest(queries, members, k)


def outside(search, asks: DataFrame, members: DataFrame, k: int, total: int) -> DataFrame:
    """(playlist_id, part, qid, track_id, distance, rn): the ``k`` nearest of each ask that are no ``members``
    (playlist_id, part, track_id) of its (playlist_id, part).

    ``search(asks, n)`` gives at least the ``n`` nearest tracks of each ask, of a catalog of ``total``. A few
    more than ``k`` do for nearly all; those whose members take too many of them ask again, alone.
    """
    keys, one = ["playlist_id", "part"], ["playlist_id", "part", "qid"]
    rank = [F.asc("distance"), F.asc("track_id")]
    n, done = min(k + SPARE, total), None
    mine, spread, place = _spread(asks, members.withColumn("_in", F.lit(True)).distinct(), keys)
    while True:
        # Queries and members of a playlist lie together.
        marked = spread(search(asks, n)).join(mine, [*place, "track_id"], "left")
        by = Window.partitionBy(*place, "qid").orderBy(*rank)
        placed = marked.withColumn("_at", F.row_number().over(by))
        if n < total:  # of later ones some may be missing
            placed = placed.where(F.col("_at") <= n)
        own = F.col("_in").isNull()
        placed = placed.withColumn("rn", F.count_if(own).over(by.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
        kept = placed.where((own & (F.col("rn") <= k)) | (F.col("_at") == n))
        got = settle(kept.select(*one, "track_id", "distance", "rn", own.alias("_own"), "_at"), together=True)
        result = got.where(F.col("_own") & (F.col("rn") <= k)).drop("_own", "_at")
        short = got.where((F.col("_at") == n) & (F.col("rn") < k)).select(*one)
        if n >= total or short.isEmpty():
            return result if done is None else done.unionByName(result)
        short = settle(short.distinct())
        result = _those(result, short, "left_anti")
        done = result if done is None else done.unionByName(result)
        asks = settle(_those(asks, short, "left_semi"))
        n = min(n * MORE, total)


def _spread(asks: DataFrame, members: DataFrame, keys: list[str]):
    """Puts what is found and ``members`` in one place by ``keys``, and deals out by query the few keys that have
    more than a task's share of ``asks``; their members are copied as often."""
    parts = int(asks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = asks.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    share = max(ASKS, -(-asks.count() // parts))
    hot = settle(sizes.where(F.col("n") > share).select(*keys, F.ceil(2 * F.col("n") / share).alias("_salts")))
    none = hot.isEmpty()

    if none:
        return members, lambda found: found.repartition(parts, *keys), keys

    def spread(found):
        salt = F.pmod(F.xxhash64("qid"), F.coalesce("_salts", F.lit(1)))
        dealt = found.join(F.broadcast(hot), keys, "left").withColumn("_salt", salt.cast("bigint")).drop("_salts")
        return dealt.repartition(parts, *keys, "_salt")

    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("_salts", F.lit(1)) - 1))
    dealt = members.join(F.broadcast(hot), keys, "left").withColumn("_salt", every).drop("_salts")
    return dealt, spread, [*keys, "_salt"]


def _those(rows: DataFrame, short: DataFrame, how: str) -> DataFrame:
    """``rows`` with the (playlist_id, part, qid) of ``short``, or without; nulls are equal here."""
    names = ["playlist_id", "part", "qid"]
    other = short.select(*[F.col(c).alias(f"_{c}") for c in names])
    same = F.lit(True)
    for c in names:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return rows.join(other, same, how)
