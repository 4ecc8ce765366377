"""Near duplicates of texts by HyperMinHash sketches on word shingles.

Each distinct shingle hash picks one of 128 registers by its top bits; a register
keeps the smallest remaining hash as its leading-zero count and ten mantissa
bits, 16 bits in all. Bands of four registers are the blocking keys; a band
without any shingle gives no key, so short texts do not meet by emptiness. A pair
that meets goes on if its Jaccard estimate from the registers, less the expected
chance collisions of compressed registers, is within five standard errors of the
threshold, and counts as a link only after the full shingle sets agree.

Texts with equal shingle sets are one node, whatever their number. The nodes of a
bucket meet in blocks of bounded size, each pair in the first band that its nodes
share; a block gives the nodes that may have a link, never the pairs. Their best
partners are verified first. Components of these links show which blocks still
hold several components; only there the full sets of a block are compared, all
pairs at once by matrix products, and a spanning forest of the links comes back.
So a large group of copies costs a few comparisons per copy, rows grow with the
documents, and no link between components is lost.

With 32 bands of four registers a pair at similarity 0.75 misses every band with
a chance of about 5e-6, less above.

Defined cases: null and empty texts have no shingles and link with nothing; texts
with fewer words than a shingle are one shingle of all their words; repeated rows
and rows that share a doc_id are linked by their texts like all others; a row
without doc_id takes part, but never names a component that has another id;
other columns do not matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodloom.llm.common import (
    bound_batches,
    components,
    drop,
    forest,
    give_back,
    joined,
    mix,
    release,
    settle,
    steps,
    utf8,
    words_of,
)

SHINGLE = 5
PERCENT = 75
REGISTERS = 128
BAND = 4
MANTISSA = 10
#: Bytes of text that one step shingles.
STEP = 1 << 20
#: Rows of a bucket that one comparison task holds on either side.
BLOCK = 1024
KIND = "struct<n_shingles:bigint,node:binary,sketch:binary,bands:array<bigint>>"


def word_hashes(flat: pa.Array) -> np.ndarray:
    """64-bit hash of every word, lower-cased A-Z, computed once per distinct word."""
    if not len(flat):
        return np.empty(0, np.uint64)
    codes = flat.dictionary_encode()
    words = pc.ascii_lower(codes.dictionary).cast(pa.large_binary()).to_pylist()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    return hashes[codes.indices.to_numpy()]


def shingle_sets(texts: pa.Array, size: int = SHINGLE):
    """Sorted distinct shingle hashes of each whole text, one array per text."""
    for a, b in steps(np.diff(joined(texts)[1]), STEP):
        flat, counts = words_of(texts[a:b])
        h = word_hashes(flat)
        ends = np.cumsum(counts)
        run = np.zeros(max(0, len(h) - size + 1), np.uint64)
        for k in range(size):
            run = run * np.uint64(0x9E3779B97F4A7C15) + mix(h[k : k + len(run)] + np.uint64(k + 1))
        run = mix(run)
        for start, end in zip((ends - counts).tolist(), ends.tolist()):
            if end - start >= size:
                yield np.unique(run[start : end - size + 1])
            elif end > start:
                yield np.array([xxhash.xxh3_64_intdigest(h[start:end].tobytes())], np.uint64)
            else:
                yield np.empty(0, np.uint64)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Registers of a sorted set: 0 if empty, else 1 + leading zeros and mantissa of the least hash."""
    out = np.zeros(REGISTERS, np.uint16)
    if not len(shingles):
        return out
    bits = REGISTERS.bit_length() - 1
    where = (shingles >> np.uint64(64 - bits)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, where[1:] != where[:-1]])
    # 52 of the remaining bits are exact in a double.
    rest = (shingles[first] << np.uint64(bits)) >> np.uint64(12)
    part, exponent = np.frexp(np.maximum(rest, np.uint64(1)).astype(np.float64))
    mantissa = ((part * 2 - 1) * (1 << MANTISSA)).astype(np.int64)
    out[where[first]] = ((52 - exponent).astype(np.int64) << MANTISSA | mantissa) + 1
    return out


def bands(registers: np.ndarray) -> list[int | None]:
    """A blocking key for each band, none for a band without a shingle."""
    groups = registers.reshape(-1, BAND)
    out = []
    for k, some in enumerate(groups.any(1).tolist()):
        h = xxhash.xxh3_64_intdigest(groups[k].tobytes(), k)
        out.append((h - (1 << 64) if h >> 63 else h) if some else None)
    return out


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected Jaccard estimate of register rows, and the registers it rests on."""
    used = ((a > 0) | (b > 0)).sum(-1)
    same = ((a == b) & (a > 0)).sum(-1)
    n, m = np.maximum(n_a, n_b).astype(float), np.minimum(n_a, n_b).astype(float)
    # Expected equal registers of unrelated sets, with the published constant.
    ratio = 4 * n / np.maximum(m, 1) / ((1 + n) / np.maximum(m, 1)) ** 2
    chance = 0.16991948715973909 * REGISTERS / (1 << MANTISSA) * np.minimum(ratio, 1.0)
    return np.maximum(same - chance, 0) / np.maximum(used, 1), used


def enough(got: np.ndarray, used: np.ndarray, percent: int) -> np.ndarray:
    """Estimates that five standard errors could lift to the threshold."""
    t = percent / 100
    return got >= t - 5 * np.sqrt(t * (1 - t) / np.maximum(used, 1))


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def sketches(docs: DataFrame, extra: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, n_shingles, node (hash of the whole set, null if empty), sketch, bands."""

    @F.arrow_udf(KIND)
    def sketched(texts: pa.Array) -> pa.Array:
        n, node, regs, keys = [], [], [], []
        for s in shingle_sets(texts):
            r = sketch(s)
            n.append(len(s))
            node.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            regs.append(r.tobytes())
            keys.append(bands(r))
        give_back()
        return pa.StructArray.from_arrays(
            [
                pa.array(n, pa.int64()),
                pa.array(node, pa.binary()),
                pa.array(regs, pa.binary()),
                pa.array(keys, pa.list_(pa.int64())),
            ],
            ["n_shingles", "node", "sketch", "bands"],
        )

    extra = extra or {}
    kept = docs.withColumns(extra).select("doc_id", *extra, sketched(utf8()).alias("s"))
    return kept.select("doc_id", *extra, "s.*")


def _registers(rows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(rows), np.uint16).reshape(-1, REGISTERS)


def meetings(regs: np.ndarray, sizes: np.ndarray, left: np.ndarray, right: np.ndarray, band: int, percent: int):
    """(u, v, estimate) of the promising pairs that meet in ``band`` first, u from left and v from right."""
    groups = regs.reshape(len(regs), -1, BAND)
    some = groups.any(2)
    for u in left.tolist():
        v = right[right > u] if len(left) == len(right) and (left == right).all() else right
        few, many = np.minimum(sizes[u], sizes[v]), np.maximum(sizes[u], sizes[v])
        v = v[100 * few >= percent * many]
        if band:
            before = (groups[u, :band] == groups[v, :band]).all(2) & some[u, :band]
            v = v[~before.any(1)]
        if len(v):
            got, used = estimate(regs[u][None, :], regs[v], sizes[u], sizes[v])
            ok = enough(got, used, percent)
            if ok.any():
                yield u, v[ok], got[ok]


def _dealt(members: DataFrame, parts: Column) -> DataFrame:
    """Rows of a bucket in every pair of its parts that they belong to: i <= j, and their own part."""
    mine = F.pmod(F.xxhash64("node"), parts).cast("int")
    return (
        members.withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
        .withColumns({"i": F.least("mine", "other"), "j": F.greatest("mine", "other")})
        .drop("other")
    )


def _promising(members: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(key, i, j, mine, node, to) of the nodes that may have a link in a block of a bucket.

    ``to`` are the partners to verify first: the one with the best estimate, and
    the smallest node of the block where the estimate is near the threshold.
    """
    rows = members.join(nodes.select("node", "sketch", "n_shingles"), "node")
    blocks = (
        _dealt(rows, F.ceil(F.col("n") / BLOCK).cast("int"))
        .groupBy("key", "band", "i", "j")
        .agg(F.collect_list(F.struct("mine", "node", "sketch", "n_shingles")).alias("rows"))
    )

    @F.arrow_udf("array<struct<mine:int,node:binary,to:array<binary>>>")
    def meet(bands: pa.Array, i: pa.Array, j: pa.Array, groups: pa.Array) -> pa.Array:
        out = []
        for band, a, b, rows in zip(bands.to_pylist(), i.to_pylist(), j.to_pylist(), groups):
            rows = sorted(rows.as_py(), key=lambda r: r["node"])
            regs = _registers([r["sketch"] for r in rows])
            sizes = np.array([r["n_shingles"] for r in rows])
            mine = np.array([r["mine"] for r in rows])
            best, partner, to = np.full(len(rows), -1.0), np.full(len(rows), -1), {}
            for u, vs, got in meetings(regs, sizes, np.flatnonzero(mine == a), np.flatnonzero(mine == b), band, percent):
                k = int(got.argmax())
                if got[k] > best[u]:
                    best[u], partner[u] = got[k], vs[k]
                better = got > best[vs]
                best[vs[better]], partner[vs[better]] = got[better], u
                if u == 0:
                    for v, g in zip(vs.tolist(), got.tolist()):
                        if 100 * g >= percent - 8:
                            to[v] = 0
            found = []
            for k in np.flatnonzero(partner >= 0).tolist():
                ends = {int(partner[k])} | ({to[k]} if k in to else set())
                found.append({"mine": int(mine[k]), "node": rows[k]["node"], "to": [rows[e]["node"] for e in sorted(ends)]})
            out.append(found)
        kind = pa.struct([("mine", pa.int32()), ("node", pa.binary()), ("to", pa.list_(pa.binary()))])
        return pa.array(out, pa.list_(kind))

    return blocks.select("key", "i", "j", F.explode(meet("band", "i", "j", "rows")).alias("f")).select(
        "key", "i", "j", "f.*"
    )


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose full shingle sets are similar enough."""

    @F.arrow_udf("boolean")
    def similar(a: pa.Array, b: pa.Array) -> pa.Array:
        load = lambda x: np.frombuffer(x.as_py(), np.uint64)
        return pa.array([linked(load(x), load(y), percent) for x, y in zip(a, b)], pa.bool_())

    side = lambda k: sets.select(F.col("node").alias(k), F.col("set").alias(f"s{k}"))
    return pairs.join(side("u"), "u").join(side("v"), "v").where(similar("su", "sv")).select("u", "v")


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, set) of the wanted nodes (doc_id, _th, node), shingled again from one text each."""

    @F.arrow_udf("binary")
    def shingled(texts: pa.Array, nodes: pa.Array) -> pa.Array:
        # Other texts may share doc_id and hash: only one with the wanted set counts.
        return pa.array(
            [
                s.tobytes() if xxhash.xxh3_128_digest(s.tobytes()) == n else None
                for s, n in zip(shingle_sets(texts), nodes.to_pylist())
            ],
            pa.binary(),
        )

    ids = wanted.select(F.col("doc_id").alias("_id"), F.col("_th").alias("_t"), "node")
    texts = docs.select("doc_id", "text", _text_hash().alias("_th")).join(
        ids, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_th") == F.col("_t"))
    )
    return texts.select("node", shingled(utf8(), F.col("node")).alias("set")).where("set is not null")


def common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets with each other, exact, by products of 0-1 matrices."""
    sizes = [len(s) for s in sets]
    values, place = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    # Shingles of one set only add nothing to a pair.
    often = np.bincount(place, minlength=len(values)) > 1
    column = np.cumsum(often) - 1
    row, place = row[often[place]], column[place[often[place]]]
    out = np.zeros((len(sets), len(sets)), np.float32)
    by = np.argsort(place, kind="stable")
    row, place = row[by], place[by]
    for low in range(0, int(often.sum()), 4096):
        a, b = np.searchsorted(place, [low, low + 4096])
        part = np.zeros((len(sets), 4096), np.float32)
        part[row[a:b], place[a:b] - low] = 1
        out += part @ part.T
    return out


def _across(promising: DataFrame, comps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """A spanning forest (u, v) of the links across components, block by block, on full sets."""
    placed = promising.select("key", "i", "j", "mine", "node").join(comps, "node", "left")
    placed = placed.withColumn("comp", F.coalesce("comp", "node"))
    open_blocks = (
        placed.groupBy("key", "i", "j").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
    )
    blocks = (
        placed.join(open_blocks.select("key", "i", "j"), ["key", "i", "j"])
        .join(sets, "node")
        .groupBy("key", "i", "j")
        .agg(F.collect_list(F.struct("mine", "node", "comp", "set")).alias("rows"))
    )

    @F.arrow_udf("array<struct<u:binary,v:binary>>")
    def verify(groups: pa.Array) -> pa.Array:
        out = []
        for rows in groups:
            rows = rows.as_py()
            data = [np.frombuffer(r["set"], np.uint64) for r in rows]
            size = np.array([len(d) for d in data])
            _, comp = np.unique([r["comp"] for r in rows], return_inverse=True)
            both = common(data)
            hit = 100 * both >= percent * (size[:, None] + size[None, :] - both)
            u, v = np.nonzero(np.triu(hit & (comp[:, None] != comp[None, :]), 1))
            root = forest(len(rows), u, v)
            out.append([{"u": rows[r]["node"], "v": rows[k]["node"]} for k, r in enumerate(root.tolist()) if r != k])
        return pa.array(out, pa.list_(pa.struct([("u", pa.binary()), ("v", pa.binary())])))

    return blocks.select(F.explode(verify("rows")).alias("p")).select("p.u", "p.v")


def _grouped(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, n_shingles, component_id of every document, its text hash _th and its component.

    ``comp`` is the smallest node of the component, null without shingles. It names
    a component where component_id, a doc_id, may be null or shared by several.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    all_rows = settle(sketches(docs, {"_th": _text_hash()}))
    nodes = all_rows.where("node is not null").groupBy("node").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_th")).alias("row"),
        F.first("sketch").alias("sketch"),
        F.first("n_shingles").alias("n_shingles"),
        F.first("bands").alias("bands"),
    )
    nodes = settle(nodes.select("node", "row.doc_id", "row._th", "sketch", "n_shingles", "bands"))
    release(spark)
    rows = nodes.select("node", F.posexplode("bands").alias("band", "key")).where("key is not null")
    shared = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = settle(rows.join(shared, "key"))
    release(spark)
    promising = settle(_promising(members, nodes, percent))
    drop(members)
    release(spark)
    wanted = nodes.join(promising.select("node").distinct(), "node", "left_semi")
    sets = settle(_sets(docs, wanted.select("doc_id", "_th", "node")).dropDuplicates(["node"]))
    release(spark)

    first = promising.select("node", F.explode("to").alias("to"))
    first = first.select(F.least("node", "to").alias("u"), F.greatest("node", "to").alias("v")).distinct()
    links = settle(_verified(first, sets, percent))
    release(spark)
    comps = settle(components(links))
    more = settle(_across(promising, comps, sets, percent))
    release(spark)
    drop(sets, promising)
    if not more.isEmpty():
        comps = settle(components(links.union(more)))
    release(spark)

    named = nodes.select("node", "doc_id").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    names = named.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    labels = settle(named.join(names, "comp").select("node", "comp", "component_id"))
    out = all_rows.select("doc_id", "n_shingles", "node", "_th").join(labels, "node", "left")
    return out.withColumn(
        "component_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    )


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    return _grouped(docs, percent).select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One document of each component: the row with its smallest doc_id.

    Documents without shingles stay. Rows equal in doc_id and text are one
    document and stay once; of a component without any id one text stays, and
    components that share a doc_id keep one text each.
    """
    names = {"_id": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63))), "_th": _text_hash()}
    found = _grouped(docs, percent)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_th")).alias("row")
    linked_rows = found.where("comp is not null").groupBy("comp").agg(first).select("row.doc_id", "row._th")
    alone = found.where("comp is null").select("doc_id", "_th")
    keep = settle(linked_rows.union(alone).select(names["_id"].alias("_id"), "_th").distinct())
    columns = docs.columns
    return docs.withColumns(names).join(keep, ["_id", "_th"], "left_semi").dropDuplicates(["_id", "_th"]).select(columns)
