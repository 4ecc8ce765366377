"""Suffix-array dedup of bytes: every byte of a 200-byte string that starts twice goes.

Two ideas make the suffix array work on a cluster.

*Dealing.* Every 200-byte string has an anchor, the leftmost of its 32-byte grams
with the smallest hash. Equal strings have equal anchors, so only strings with one
anchor gram need to meet. Consecutive starts of a text with one anchor form a
stretch; its context is the stretch and 199 bytes beyond it. Contexts whose gram
occurs once in the corpus are done; equal contexts are sent once, with a weight.

*Two-stage sorting.* A task concatenates the contexts of some hundred grams, each
closed by a mark below all bytes. A suffix is of type S if it is smaller than the
one a byte later, else of type L. Only S suffixes are sorted directly, eight bytes
at a time and only while they tie. The bucket scan then goes through the first
bytes in order: L suffixes of a bucket follow from the ranks of what comes after
their first run of equal bytes, which lies in smaller buckets, and the S suffixes
come behind them. Common prefixes of adjacent suffixes show classes of equal
200-byte strings; a class of weight two or more is repeated.

A gram with more than ``MAX_GROUP`` distinct contexts would not fit one task; its
strings are counted by 128-bit hashes in a distributed aggregation instead, which
is exact in the same sense. Nothing is dropped.

Defined cases: null and empty texts have no bytes; texts below 200 bytes lose
nothing; repeated rows are texts like all others, so both lose what they share;
rows without doc_id and other columns do not matter.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodloom.llm.common import drop, joined, mix, release, settle, steps, utf8

LENGTH = 200
GRAM = 32
#: Distinct contexts of one gram that a task sorts; more are counted by hash.
MAX_GROUP = 2000
#: Context bytes that one sort holds, about.
SORT_BYTES = 2 << 20
STEP = 1 << 20

_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


class Hashes:
    """Hashes of any substrings of a byte array, from prefix sums modulo 2^64."""

    def __init__(self, data: np.ndarray, base: int = _BASES[0]):
        up, self.down = _powers(base, 1 << max(21, len(data).bit_length()))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, size) -> np.ndarray:
        return mix((self.sums[start + size] - self.sums[start]) * self.down[start])

    def all(self, size: int) -> np.ndarray:
        n = max(0, len(self.sums) - size)
        return mix((self.sums[size : size + n] - self.sums[:n]) * self.down[:n])


def stretches(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> dict:
    """Stretches of starts with one anchor: text row, first start in it, number of starts, gram and context."""
    none = {k: np.empty(0, np.int64) for k in ("row", "at", "m", "fp", "ctx")}
    n = len(data) - length + 1
    if n <= 0:
        return none
    hashes = Hashes(data)
    grams = hashes.all(gram)
    # Hash above, place below: the minimum is the leftmost smallest.
    low = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    windows = length - gram + 1
    span = 1
    while 2 * span <= windows:
        low = np.minimum(low[: len(low) - span], low[span:])
        span *= 2
    if span < windows:
        low = np.minimum(low[: len(low) - (windows - span)], low[windows - span :])
    anchor = (low[:n] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(len(sizes)), sizes)[:n]
    inside = np.arange(n) + length <= offsets[row + 1]
    first = np.flatnonzero(inside & np.r_[True, (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]) | ~inside[:-1]])
    if not len(first):
        return none
    last = np.r_[first[1:], n] - 1
    last = np.minimum(last, offsets[row[first] + 1] - length)
    m = last - first + 1
    ctx = hashes.of(first, m + length - 1) + mix((anchor[first] - first).astype(np.uint64) * np.uint64(512) + m.astype(np.uint64))
    return {
        "row": row[first],
        "at": first - offsets[row[first]],
        "m": m,
        "fp": grams[anchor[first]].view(np.int64),
        "ctx": ctx.view(np.int64),
    }


def direct(words: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """``places`` in the order of their first ``depth`` bytes, eight bytes a round, ties only."""
    order = places[np.argsort(words[places], kind="stable")]
    tied = np.arange(len(order))
    group = np.zeros(len(order), np.int64)
    for at in range(0, depth, 8):
        if at:
            sub = words[order[tied] + at]
            by = np.lexsort((sub, group))
            order[tied] = order[tied][by]
        value = words[order[tied] + at]
        new = np.r_[True, (value[1:] != value[:-1]) | (group[1:] != group[:-1])]
        group = np.cumsum(new)
        alone = new & np.r_[new[1:], True]
        tied, group = tied[~alone], group[~alone]
        if not len(tied):
            break
    return order


def sorted_suffixes(text: np.ndarray, wanted: np.ndarray, depth: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """The wanted places of ``text`` in suffix order (to ``depth``), and packed eight-byte words.

    ``text`` has symbols 0 to 256 as uint16; 0 closes each piece and ends the text.
    """
    n = len(text)
    pad = np.r_[text, np.zeros(depth + 8, np.uint16)]
    # Symbols are bytes plus one; UTF-8 has no byte 255, so they fit eight bits.
    words = np.zeros(n + depth, np.uint64)
    for k in range(8):
        words = (words << np.uint64(8)) | pad[k : k + n + depth].astype(np.uint64)
    # Ends of runs of equal symbols; the last symbol ends the last run.
    change = np.flatnonzero(text[1:] != text[:-1]) + 1
    ends = np.r_[change, n]
    run_end = np.repeat(ends, np.diff(np.r_[0, ends]))
    following = pad[run_end].astype(np.int32)
    following[run_end == n] = 1 << 10
    small = following > text  # S: smaller than its successor
    next_small = np.minimum.accumulate(np.where(small, np.arange(n), n - 1)[::-1])[::-1]
    # L suffixes need the ranks of what follows, up to the next S.
    need = np.zeros(n + 1, np.int64)
    np.add.at(need, wanted, 1)
    np.add.at(need, next_small[wanted] + 1, -1)
    need = np.flatnonzero(np.cumsum(need[:n]) > 0)

    rank = np.full(n + 1, -1, np.int64)
    s_order = direct(words, need[small[need]], depth)
    l_places = need[~small[need]]
    l_places = l_places[np.argsort(text[l_places], kind="stable")]
    symbols = np.arange(258)
    s_at = np.searchsorted(text[s_order], symbols)
    l_at = np.searchsorted(text[l_places], symbols)
    out, given = [], 0
    for c in range(257):
        some = l_places[l_at[c] : l_at[c + 1]]
        if len(some):
            end = run_end[some]
            some = some[np.lexsort((rank[end], end - some))]
            rank[some] = given + np.arange(len(some))
            given += len(some)
            out.append(some)
        some = s_order[s_at[c] : s_at[c + 1]]
        if len(some):
            rank[some] = given + np.arange(len(some))
            given += len(some)
            out.append(some)
    order = np.concatenate(out) if out else np.empty(0, np.int64)
    keep = np.zeros(n, bool)
    keep[wanted] = True
    return order[keep[order]], words


def common_prefixes(order: np.ndarray, words: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Common prefix of each suffix with the one before it, in bytes up to ``depth``."""
    lcp = np.zeros(len(order), np.int64)
    pair = np.arange(1, len(order))
    for at in range(0, depth, 8):
        differ = words[order[pair] + at] ^ words[order[pair - 1] + at]
        part = np.full(len(pair), 8)
        some = differ != 0
        # Leading equal bytes of eight.
        part[some] = (63 - np.log2(differ[some].astype(np.float64)).astype(np.int64).clip(0, 63)) // 8
        lcp[pair] += part
        pair = pair[~some]
        if not len(pair):
            break
    return np.minimum(lcp, depth)


def repeated_starts(contexts: list[bytes], starts: np.ndarray, weights: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """Per context, which of its ``starts`` first places begin a string of weight two or more in all."""
    sizes = np.array([len(c) + 1 for c in contexts])
    text = np.frombuffer(b"\0".join([c.translate(_UP) for c in contexts]) + b"\0", np.uint8).astype(np.uint16)
    begin = np.cumsum(sizes) - sizes
    total = int(starts.sum())
    ends = np.cumsum(starts)
    wanted = np.arange(total) + np.repeat(begin - (ends - starts), starts)
    order, words = sorted_suffixes(text, wanted, length)
    lcp = common_prefixes(order, words, length)
    cls = np.cumsum(lcp < length) - 1
    owner = np.zeros(len(text), np.int64)
    owner[wanted] = np.repeat(np.arange(len(contexts)), starts)
    weight = np.bincount(cls, weights[owner[order]])
    hit = np.zeros(len(text), bool)
    hit[order] = weight[cls] >= 2
    return [hit[b : b + m] for b, m in zip(begin.tolist(), starts.tolist())]


_UP = bytes([*range(1, 256), 255])


def runs(mask: np.ndarray) -> list[dict]:
    """(first, last) of the runs of true."""
    edge = np.flatnonzero(np.diff(np.r_[0, mask.astype(np.int8), 0]))
    return [{"lo": int(a), "hi": int(b) - 1} for a, b in zip(edge[::2], edge[1::2])]


def _keyed(docs: DataFrame) -> DataFrame:
    """_id and _th name a text; data holds its bytes."""
    return docs.select(
        "doc_id",
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63))).alias("_id"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("_th"),
        utf8().alias("data"),
    )


def _stretches(docs: DataFrame, length: int) -> DataFrame:
    names = ("_id", "_th", "fp", "ctx")
    schema = pa.schema([(c, pa.int64()) for c in names] + [("at", pa.int32()), ("m", pa.int32())])

    def find(batches):
        for batch in batches:
            data, offsets = joined(batch.column("data"))
            ids, hashes = batch.column("_id").to_numpy(), batch.column("_th").to_numpy()
            for a, b in steps(np.diff(offsets), STEP):
                got = stretches(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], length, min(GRAM, length))
                row = a + got["row"]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[row]),
                        pa.array(hashes[row]),
                        pa.array(got["fp"]),
                        pa.array(got["ctx"]),
                        pa.array(got["at"].astype(np.int32)),
                        pa.array(got["m"].astype(np.int32)),
                    ],
                    schema=schema,
                )

    kind = ", ".join(f"{c} bigint" for c in names) + ", at int, m int"
    return _keyed(docs).select("_id", "_th", "data").mapInArrow(find, kind)


def _contexts(docs: DataFrame, found: DataFrame, length: int) -> DataFrame:
    """(fp, ctx, n, m, context) of every distinct context, cut out of one of its texts."""
    one = found.groupBy("fp", "ctx").agg(F.count("*").alias("n"), F.min(F.struct("_id", "_th", "at", "m")).alias("w"))
    wanted = one.groupBy("w._id", "w._th").agg(
        F.collect_list(F.struct("fp", "ctx", "n", F.col("w.at").alias("at"), F.col("w.m").alias("m"))).alias("cuts")
    )

    @F.arrow_udf("array<binary>")
    def cut(texts: pa.Array, cuts: pa.Array) -> pa.Array:
        out = []
        for t, c in zip(texts.to_pylist(), cuts.to_pylist()):
            out.append([t[x["at"] : x["at"] + x["m"] + length - 1] for x in c])
        return pa.array(out, pa.list_(pa.binary()))

    rows = _keyed(docs).join(wanted, ["_id", "_th"]).select("cuts", cut("data", "cuts").alias("context"))
    return rows.select(F.explode(F.arrays_zip("cuts", "context")).alias("z")).select(
        "z.cuts.fp", "z.cuts.ctx", "z.cuts.n", "z.cuts.m", "z.context"
    )


def _sorted(contexts: DataFrame, length: int) -> DataFrame:
    """(fp, ctx, spans) by suffix sorting; contexts of a gram share a bucket."""
    size = contexts.agg(F.sum(F.length("context"))).first()[0] or 0
    buckets = max(1, math.ceil(size / SORT_BYTES))
    kind = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
    schema = pa.schema([("fp", pa.int64()), ("ctx", pa.int64()), ("spans", kind)])

    def repeated(table: pa.Table) -> pa.Table:
        # A row of documents that occurs twice brings its contexts twice.
        rows = list({(r["fp"], r["ctx"]): r for r in table.to_pylist()}.values())
        hits = repeated_starts(
            [r["context"] for r in rows], np.array([r["m"] for r in rows]), np.array([r["n"] for r in rows]), length
        )
        out = [{"fp": r["fp"], "ctx": r["ctx"], "spans": runs(h)} for r, h in zip(rows, hits) if h.any()]
        return pa.Table.from_pylist(out, schema)

    return (
        contexts.withColumn("bucket", F.pmod("fp", F.lit(buckets)))
        .groupBy("bucket")
        .applyInArrow(repeated, "fp bigint, ctx bigint, spans array<struct<lo:int,hi:int>>")
    )


def _counted(contexts: DataFrame, length: int) -> DataFrame:
    """(fp, ctx, spans) of contexts of crowded grams, by counting hashes of their strings."""

    @F.arrow_udf("array<struct<g1:bigint,g2:bigint,s:int>>")
    def strings(col: pa.Array, starts: pa.Array) -> pa.Array:
        out = []
        for c, m in zip(col.to_pylist(), starts.to_pylist()):
            data = np.frombuffer(c, np.uint8)
            g = [Hashes(data, b).all(length).view(np.int64).tolist() for b in _BASES]
            out.append([{"g1": x, "g2": y, "s": s} for s, (x, y) in enumerate(zip(*g))][:m])
        return pa.array(out, pa.list_(pa.struct([("g1", pa.int64()), ("g2", pa.int64()), ("s", pa.int32())])))

    rows = (
        contexts.dropDuplicates(["fp", "ctx"])
        .select("fp", "ctx", "n", F.explode(strings("context", "m")).alias("g"))
        .select("fp", "ctx", "n", "g.*")
    )
    often = rows.groupBy("g1", "g2").agg(F.sum("n").alias("k")).where("k > 1").select("g1", "g2")
    hit = rows.join(often, ["g1", "g2"]).groupBy("fp", "ctx").agg(F.collect_set("s").alias("s"))
    one = F.transform("s", lambda x: F.struct(x.alias("lo"), x.alias("hi")))
    return hit.select("fp", "ctx", one.alias("spans"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, max_group: int = MAX_GROUP) -> DataFrame:
    """(_id, _th, spans): byte ranges [lo, hi) of a text that repeated strings cover, unmerged."""
    spark = docs.sparkSession
    found = settle(_stretches(docs, length))
    often = found.groupBy("fp").agg(F.count("*").alias("k")).where("k > 1").select("fp")
    again = settle(found.join(often, "fp"))
    release(spark)
    drop(found)
    contexts = settle(_contexts(docs, again, length))
    release(spark)
    crowded = contexts.groupBy("fp").agg(F.count("*").alias("k")).where(F.col("k") > max_group).select("fp")
    crowded = settle(crowded)
    if crowded.isEmpty():
        hits = _sorted(contexts, length)
    else:
        hits = _sorted(contexts.join(crowded, "fp", "left_anti"), length).union(
            _counted(contexts.join(crowded, "fp", "left_semi"), length)
        )
    hits = settle(hits)
    spans = (
        again.join(hits, ["fp", "ctx"])
        .select("_id", "_th", "at", F.explode("spans").alias("s"))
        .groupBy("_id", "_th")
        .agg(
            F.collect_list(
                F.struct((F.col("at") + F.col("s.lo")).alias("lo"), (F.col("at") + F.col("s.hi") + length).alias("hi"))
            ).alias("spans")
        )
    )
    out = settle(spans)
    release(spark)
    drop(again, contexts, hits, crowded)
    return out


def dedup(docs: DataFrame, length: int = LENGTH, max_group: int = MAX_GROUP) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept, the remaining bytes."""

    @F.arrow_udf("struct<n_bytes:bigint,n_removed:bigint,n_spans:bigint,kept_sha256:string,kept:binary>")
    def remove(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for t, cuts in zip(texts.to_pylist(), spans.to_pylist()):
            n, gone, pieces, at = 0, 0, [], 0
            for lo, hi in sorted((c["lo"], c["hi"]) for c in cuts or ()):
                if lo > at or not n:
                    pieces.append(t[at:lo])
                    n += 1
                    gone += hi - lo
                    at = hi
                elif hi > at:
                    gone += hi - at
                    at = hi
            kept = b"".join([*pieces, t[at:]]) if n else t
            out.append(
                {
                    "n_bytes": len(t),
                    "n_removed": gone,
                    "n_spans": n,
                    "kept_sha256": hashlib.sha256(kept).hexdigest(),
                    "kept": kept,
                }
            )
        kind = pa.struct(
            [(c, pa.int64()) for c in ("n_bytes", "n_removed", "n_spans")]
            + [("kept_sha256", pa.string()), ("kept", pa.binary())]
        )
        return pa.array(out, kind)

    spans = repeated_spans(docs, length, max_group)
    return (
        _keyed(docs)
        .join(spans, ["_id", "_th"], "left")
        .select("doc_id", remove("data", "spans").alias("r"))
        .select("doc_id", "r.*")
    )
