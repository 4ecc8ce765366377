"""Near duplicates of embeddings by cross-polytope hashing.

Vectors are normalised in double precision and padded to a power of two. A table
hashes a vector ``k`` times: three rounds of random signs and a fast Hadamard
transform rotate it, and the hash is the axis, with its sign, of the largest
coordinate. Besides the bucket of the best axes a vector also enters the next
buckets, those where one axis is the runner-up that loses least (multiprobe).
Buckets that share a vector are compared in blocks of bounded size by cosine; a
pair is counted only in the first table and smallest bucket that its vectors
share, so nothing needs a global distinct. ``k`` follows the number of vectors and
the number of tables follows the measured chance that a pair at the threshold
shares a bucket, for a chance of at most ``MISS`` to lose it.

Equal vectors are one node with a weight, so a large group of copies costs
nothing. Links within a block leave it as counts per node and as a spanning
forest, never as all pairs.

Defined cases: null vectors, zero vectors and those with null or non-finite
components link with nothing; vectors of another length than the most frequent
one are compared among their own length only; repeated rows and rows that share a
vec_id are vectors of their own, and a row without vec_id never names a
component that has another id; other columns do not matter.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodloom.llm.common import components, drop, forest, joined, settle

COSINE = 0.9
MISS = 1e-5
PROBES = 3
#: Rows of a bucket that one comparison holds on either side.
BLOCK = 512
SEED = 11


def hadamard(x: np.ndarray) -> np.ndarray:
    """Orthonormal Walsh-Hadamard transform of the rows; their length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), 2)
        h *= 2
    return x.reshape(n, d) / math.sqrt(d)


def width(d: int) -> int:
    return 1 << max(1, (d - 1).bit_length())


def axes(x: np.ndarray, signs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best and second axis of each rotated row (axis, with + width for the negative end), and the loss."""
    for s in signs:
        x = hadamard(x * s)
    d = x.shape[1]
    size = np.abs(x)
    two = np.argpartition(size, d - 2, axis=1)[:, d - 2 :]
    rows = np.arange(len(x))[:, None]
    order = np.argsort(size[rows, two], axis=1, kind="stable")
    second, best = two[rows, order].T
    r = rows[:, 0]
    end = lambda a: a + d * (x[r, a] < 0)
    return end(best), end(second), size[r, best] - size[r, second]


def table_signs(table: int, k: int, d: int) -> np.ndarray:
    """Random signs of the k rotations of a table."""
    return np.random.default_rng([SEED, table]).choice([-1.0, 1.0], (k, 3, d))


def buckets(x: np.ndarray, table: int, k: int, probes: int = PROBES) -> np.ndarray:
    """Bucket numbers of the padded unit rows in a table, best first."""
    found = [axes(x, s) for s in table_signs(table, k, x.shape[1])]
    base = 2 * x.shape[1]
    loss = np.array([f[2] for f in found]).T
    key = np.zeros(len(x), np.int64)
    for f in found:
        key = key * base + f[0]
    out = [key]
    cheapest = np.argsort(loss, axis=1, kind="stable")[:, : probes - 1]
    for c in cheapest.T:
        other = np.zeros(len(x), np.int64)
        for i, f in enumerate(found):
            other = other * base + np.where(c == i, f[1], f[0])
        out.append(other)
    return np.array(out).T


def shared_chance(d: int, k: int, cosine: float, trials: int = 4000) -> float:
    """Measured chance that a pair at ``cosine`` shares a bucket of one table."""
    rng = np.random.default_rng(SEED)
    x = rng.standard_normal((trials, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((trials, d))
    y -= (x * y).sum(1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    y = cosine * x + math.sqrt(1 - cosine**2) * y
    pad = ((0, 0), (0, width(d) - d))
    a, b = (buckets(np.pad(v, pad), 0, k) for v in (x, y))
    return float((a[:, :, None] == b[:, None, :]).any((1, 2)).mean())


def plan(n: int, d: int, cosine: float, miss: float = MISS) -> tuple[int, int]:
    """Hashes per table, so that random vectors seldom meet, and tables, so that few pairs are lost."""
    k = max(1, min(8, math.ceil(math.log(max(n, 2)) / math.log(2 * width(d)))))
    k = min(k, 63 // (width(d).bit_length()))
    chance = shared_chance(d, k, cosine)
    return k, max(4, math.ceil(math.log(miss) / math.log(1 - min(max(chance, 1e-3), 0.999))))


def unit(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.float64)


def _rows(vectors: DataFrame) -> DataFrame:
    """vec_id, node (hash of the components, null if unusable), d, unit vector as bytes."""

    @F.arrow_udf("struct<node:binary,d:int,unit:binary>")
    def normalised(col: pa.Array) -> pa.Array:
        out = []
        for v in col.to_pylist():
            x = None
            if v and None not in v:
                raw = np.array(v, np.float64)
                norm = np.linalg.norm(raw / max(np.abs(raw).max(), 1e-300)) if np.isfinite(raw).all() else 0.0
                if norm > 0 and np.abs(raw).max() > 0:
                    x = raw / np.abs(raw).max() / norm
            out.append(
                None if x is None else {"node": xxhash.xxh3_128_digest((raw + 0.0).tobytes()), "d": len(x), "unit": x.tobytes()}
            )
        return pa.array(out, pa.struct([("node", pa.binary()), ("d", pa.int32()), ("unit", pa.binary())]))

    return vectors.select(
        "vec_id", normalised(F.col("embedding").cast("array<double>")).alias("v")
    ).select("vec_id", "v.*")


def _compared(nodes: DataFrame, d: int, k: int, tables: int, cosine: float) -> DataFrame:
    """Per block of a bucket: the counts and spanning edges of the links first seen there."""

    @F.arrow_udf("array<array<bigint>>")
    def places(units: pa.Array) -> pa.Array:
        x = np.frombuffer(joined(units)[0].tobytes(), np.float64).reshape(-1, d)
        x = np.pad(x, ((0, 0), (0, width(d) - d)))
        keys = np.stack([buckets(x, t, k) for t in range(tables)], 1)
        return pa.array(keys.tolist(), pa.list_(pa.list_(pa.int64())))

    placed = settle(nodes.select("node", "weight", "unit", places("unit").alias("keys")))
    at = placed.select("node", F.posexplode("keys").alias("t", "own")).select(
        "node", "t", F.explode(F.array_distinct("own")).alias("key")
    )
    shared = at.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    members = at.join(shared, ["t", "key"]).withColumn("mine", F.pmod(F.xxhash64("node"), parts).cast("int"))
    dealt = members.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1))).select(
        "node", "t", "key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine"
    )
    blocks = (
        dealt.join(placed, "node")
        .groupBy("t", "key", "i", "j")
        .agg(F.collect_list(F.struct("mine", "node", "weight", "unit", "keys")).alias("rows"))
    )

    @F.arrow_udf("array<struct<node:binary,links:bigint,root:binary>>")
    def compare(t: pa.Array, key: pa.Array, i: pa.Array, j: pa.Array, groups: pa.Array) -> pa.Array:
        out = []
        for table, bucket, a, b, rows in zip(t.to_pylist(), key.to_pylist(), i.to_pylist(), j.to_pylist(), groups):
            rows = rows.as_py()
            x = np.array([unit(r["unit"]) for r in rows])
            keys = np.array([r["keys"] for r in rows])
            mine = np.array([r["mine"] for r in rows])
            weight = np.array([r["weight"] for r in rows])
            left, right = np.flatnonzero(mine == a), np.flatnonzero(mine == b)
            u, v = np.nonzero(x[left] @ x[right].T >= cosine)
            u, v = left[u], right[v]
            if a == b:
                u, v = u[u < v], v[u < v]
            if table and len(u):
                # Counted in an earlier table?
                met = np.zeros(len(u), bool)
                for p in range(keys.shape[2]):
                    for q in range(keys.shape[2]):
                        met |= (keys[u, :table, p] == keys[v, :table, q]).any(1)
                u, v = u[~met], v[~met]
            if len(u):
                both = (keys[u, table][:, :, None] == keys[v, table][:, None, :]).any(2)
                first = np.where(both, keys[u, table], np.iinfo(np.int64).max).min(1) == bucket
                u, v = u[first], v[first]
            links = np.bincount(u, weight[v], len(rows)) + np.bincount(v, weight[u], len(rows))
            root = forest(len(rows), u, v)
            out.append(
                [
                    {"node": rows[r]["node"], "links": int(links[r]), "root": rows[root[r]]["node"]}
                    for r in np.flatnonzero(links > 0).tolist()
                ]
            )
        return pa.array(
            out, pa.list_(pa.struct([("node", pa.binary()), ("links", pa.int64()), ("root", pa.binary())]))
        )

    return blocks.select(F.explode(compare("t", "key", "i", "j", "rows")).alias("f")).select("f.*")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, miss: float = MISS) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector."""
    rows = settle(_rows(vectors))
    nodes = settle(
        rows.where("node is not null")
        .groupBy("node")
        .agg(F.count("*").alias("weight"), F.min("vec_id").alias("vec_id"), F.first("d").alias("d"), F.first("unit").alias("unit"))
    )
    found = None
    # One pass per vector length; a table of embeddings has one.
    for r in nodes.groupBy("d").count().orderBy("d").collect():
        k, tables = plan(r["count"], r["d"], cosine, miss)
        one = settle(_compared(nodes.where(F.col("d") == r["d"]), r["d"], k, tables, cosine))
        found = one if found is None else found.union(one)
    if found is None:
        return rows.select(
            "vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")
        )
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    comps = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    named = (
        nodes.join(comps, "node", "left")
        .join(links, "node", "left")
        .withColumns({"comp": F.coalesce("comp", "node"), "links": F.coalesce("links", F.lit(0)) + F.col("weight") - 1})
    )
    names = named.groupBy("comp").agg(F.min("vec_id").alias("component_id"))
    labels = settle(named.join(names, "comp").select("node", "links", "component_id"))
    out = rows.select("vec_id", "node").join(labels, "node", "left")
    drop(nodes)
    return out.select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"),
        F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
