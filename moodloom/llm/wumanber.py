"""Benchmark decontamination by Wu-Manber multi-pattern search.

Texts become runs of lower-case words between single spaces (bytes, so UTF-8 letters
are word bytes). A test string is ten consecutive words of an item with the spaces
around them; an item with fewer words is one string. Strings with the same number of
words form a class, and ``m`` is the length of its shortest string. A window of ``m``
bytes moves over the text: the last ``BLOCK`` bytes of the window are looked up in the
shift table, which says how far no string can begin, so most bytes are never looked at.
Where the shift is zero, the hash of the window picks the bucket of test strings that
begin like it, and a comparison of all bytes confirms an occurrence. Many windows of a
batch of texts move at the same time, each in its own stretch of the bytes, as NumPy
arrays.

Test strings are dealt to parts of about ``PART_BYTES``; one part at a time goes to the
executors, so a benchmark of any size needs bounded memory there. With more than one part
the documents are read once per part and the finds of a document are united.

Defined cases: null and empty texts have no words; an item without words has no strings;
equal strings of several items count for each; rows that share an item_id are one item;
items without id are one item, counted but not named in a list of ids; documents may
repeat (each row gets its result), other columns do not matter. A very long text is
handled as a batch of its own, in about eight times its bytes. With an empty benchmark
nothing is found; an empty table of documents gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodloom.llm.chunks import gather
from moodloom.llm.common import bound_batches, joined, mix, settle, steps

WORDS = 10
BLOCK = 8
#: Bytes of test strings that are searched for at once.
PART_BYTES = 16 << 20
#: Bytes of text that one window passes.
STRETCH = 2048
#: Bytes compared at once.
COMPARED = 4 << 20

_PLAIN = np.full(256, 32, np.uint8)
_PLAIN[48:58] = np.arange(48, 58)
_PLAIN[65:91] = np.arange(97, 123)
_PLAIN[97:123] = np.arange(97, 123)
_PLAIN[128:] = np.arange(128, 256)

KIND = "struct<n_words: bigint, runs: array<struct<start: bigint, n: bigint>>, items: array<string>>"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("n", pa.int64())]))


def plain_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all words between single spaces, places of the words in them, words per text."""
    spaced = pc.binary_join_element_wise(texts.cast(pa.large_binary()), pa.scalar(b"", pa.large_binary()), pa.scalar(b" ", pa.large_binary()))
    data, offsets = joined(spaced)
    data = _PLAIN[data]
    gap = data == 32
    gap_before = np.r_[True, gap[:-1]]
    begin = np.flatnonzero(~gap & gap_before)
    counts = np.diff(np.searchsorted(begin, offsets))
    out = np.r_[np.uint8(32), data[~(gap & gap_before)]]
    return out, np.flatnonzero((out[1:] != 32) & (out[:-1] == 32)) + 1, counts


def strings_of(text: bytes, words: int = WORDS) -> list[bytes]:
    """The test strings of one item."""
    data, at, counts = plain_words(pa.array([text], pa.large_binary()))
    if not len(at):
        return []
    data = data.tobytes()
    n = min(words, len(at))
    ends = np.r_[at[1:], len(data)]
    return sorted({data[at[i] - 1 : ends[i + n - 1]] for i in range(len(at) - n + 1)})


class Strings:
    """Shift table and buckets of test strings with the same number of words."""

    def __init__(self, strings: list[bytes], numbers: np.ndarray, words: int):
        self.words = words
        sizes = np.fromiter(map(len, strings), np.int64, len(strings))
        self.m = int(sizes.min())
        self.block = min(BLOCK, self.m)
        flat = np.frombuffer(b"".join(strings) + bytes(8), np.uint8)
        starts = np.cumsum(sizes) - sizes
        spots = self.m - self.block + 1
        self.bits = int(np.clip(np.ceil(np.log2(16 * len(strings) * spots)), 12, 22))
        self.shift = np.full(1 << self.bits, spots, np.int32)
        for at in range(spots):  # at the end of the window, the shift is zero
            code = self._code(_eight(flat, starts + at, self.block))
            np.minimum.at(self.shift, code, spots - 1 - at)
        key = self._key(flat, starts)
        order = np.argsort(key, kind="stable")
        self.key, self.flat = key[order], flat
        self.starts, self.sizes, self.numbers = starts[order], sizes[order], numbers[order]

    def _code(self, eight: np.ndarray) -> np.ndarray:
        return (mix(eight) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _key(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Hash of the m bytes from each start."""
        key = np.zeros(len(starts), np.uint64)
        for at in range(0, self.m, 8):
            key = mix(key * np.uint64(31) + _eight(data, starts + at, min(8, self.m - at)))
        return key

    def candidates(self, data: np.ndarray, size: int) -> np.ndarray:
        """Starts of windows whose shift is zero. ``data`` has 8 bytes more than ``size``."""
        end = np.arange(0, size, STRETCH)
        at, end = np.maximum(end, self.m - 1), np.minimum(end + STRETCH, size)
        found = []
        while True:
            on = at < end
            at, end = at[on], end[on]
            if not len(at):
                break
            step = self.shift[self._code(_eight(data, at - self.block + 1, self.block))]
            found.append(at[step == 0])
            at = at + np.maximum(step, 1)
        return np.sort(np.concatenate(found)) - self.m + 1 if found else np.empty(0, np.int64)

    def occurrences(self, data: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(starts, numbers of strings) of all occurrences in the first ``size`` bytes."""
        at = self.candidates(data, size)
        key = self._key(data, at)
        low, high = np.searchsorted(self.key, key, "left"), np.searchsorted(self.key, key, "right")
        at, low, n = at[high > low], low[high > low], (high - low)[high > low]
        out = []
        for a, b in steps(n * self.sizes.max(), COMPARED):
            pair = gather(np.arange(len(self.key)), low[a:b], n[a:b])
            start = np.repeat(at[a:b], n[a:b])
            inside = start + self.sizes[pair] <= size
            pair, start = pair[inside], start[inside]
            sizes = self.sizes[pair]
            if not len(pair):
                continue
            same = gather(data, start, sizes) == gather(self.flat, self.starts[pair], sizes)
            equal = np.logical_and.reduceat(same, np.cumsum(sizes) - sizes)
            out.append((start[equal], self.numbers[pair[equal]]))
        if not out:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*out))


def _eight(data: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """The n <= 8 bytes from each start as one number; 8 bytes from there must exist."""
    view = np.ndarray((len(data) - 7,), "<u8", buffer=data, strides=(1,))
    eight = view[starts]
    return eight if n == 8 else eight & np.uint64((1 << 8 * n) - 1)


class Matcher:
    """All test strings of a part: (string, words, item) rows."""

    def __init__(self, strings: list[bytes], words: list[int], items: list[str | None]):
        distinct = {s: k for k, s in enumerate(dict.fromkeys(strings))}
        number = np.fromiter((distinct[s] for s in strings), np.int64, len(strings))
        size = np.zeros(len(distinct), np.int64)
        size[number] = words
        names = {i: k for k, i in enumerate(dict.fromkeys(items))}
        self.names = np.array(list(names), object)
        order = np.argsort(number, kind="stable")
        self.item = np.fromiter((names[i] for i in items), np.int64, len(items))[order]
        self.first = np.searchsorted(number[order], np.arange(len(distinct) + 1))
        all_strings = list(distinct)
        self.classes = []
        for w in np.unique(size):
            mine = np.flatnonzero(size == w)
            self.classes.append(Strings([all_strings[k] for k in mine], mine, int(w)))

    def step(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Words per text; text and (start, n) of each run of hit words; (text, item) pairs."""
        data, at, counts = plain_words(texts)
        size = len(data)
        data = np.r_[data, np.zeros(8, np.uint8)]
        first = np.cumsum(counts) - counts
        row = np.repeat(np.arange(len(counts)), counts)
        change = np.zeros(len(at) + 1, np.int32)
        pairs = []
        for strings in self.classes:
            start, number = strings.occurrences(data, size)
            word = np.searchsorted(at, start + 1)
            whole = row[word] == row[word + strings.words - 1] if len(word) else np.empty(0, bool)
            word, number = word[whole], number[whole]
            np.add.at(change, word, 1)
            np.add.at(change, word + strings.words, -1)
            met = np.unique(np.stack([row[word], number], 1), axis=0)
            n = self.first[met[:, 1] + 1] - self.first[met[:, 1]]
            pairs.append(np.stack([np.repeat(met[:, 0], n), gather(self.item, self.first[met[:, 1]], n)], 1))
        hit = np.cumsum(change[:-1]) > 0
        edge = np.zeros(len(at) + 1, bool)  # runs end where a text ends
        edge[first[counts > 0]] = True
        fresh = hit & (~np.r_[False, hit[:-1]] | edge[:-1])
        starts = np.flatnonzero(fresh)
        run = np.cumsum(fresh) - 1
        lengths = np.bincount(run[hit], minlength=len(starts)).astype(np.int64)
        pairs = np.unique(np.concatenate(pairs), axis=0) if pairs else np.empty((0, 2), np.int64)
        return counts, row[starts], np.stack([starts - first[row[starts]], lengths], 1), pairs[:, 0], pairs[:, 1]

    def __call__(self, texts: pa.Array) -> pa.Array:
        out = []
        texts = texts.cast(pa.large_binary())
        for a, b in steps(pc.binary_length(texts).to_numpy()):
            counts, run_row, runs, item_row, item = self.step(texts[a:b])
            cuts = lambda rows: pa.array(np.searchsorted(rows, np.arange(b - a + 1)).astype(np.int32))
            spans = pa.StructArray.from_arrays([pa.array(runs[:, 0]), pa.array(runs[:, 1])], fields=list(_RUNS.value_type))
            lists = pa.ListArray.from_arrays(cuts(run_row), spans)
            names = pa.ListArray.from_arrays(cuts(item_row), pa.array(self.names[item], pa.string()))
            out.append(pa.StructArray.from_arrays([pa.array(counts.astype(np.int64)), lists, names], ["n_words", "runs", "items"]))
        kind = pa.struct([("n_words", pa.int64()), ("runs", _RUNS), ("items", pa.list_(pa.string()))])
        return pa.concat_arrays(out).cast(kind) if out else pa.array([], kind)


@lru_cache(maxsize=2)
def _matcher(part) -> Matcher:
    table = part.value
    return Matcher(*table)


def patterns(benchmark: DataFrame, words: int = WORDS) -> DataFrame:
    """Distinct (string, words, item): the test strings of all items."""

    @F.arrow_udf("array<struct<string: binary, words: int>>")
    def cut(texts: pa.Array) -> pa.Array:
        rows = []
        for text in texts.to_pylist():
            rows.append([{"string": s, "words": s.count(b" ") - 1} for s in strings_of(text or b"", words)])
        return pa.array(rows, pa.list_(pa.struct([("string", pa.binary()), ("words", pa.int32())])))

    return (
        benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("binary").alias("text"))
        .select("item", F.explode(cut("text")).alias("s"))
        .select("s.string", "s.words", "item")
        .distinct()
    )


def _search(part: list) -> Callable:
    """A column function: what of ``part`` is in a text."""

    @F.arrow_udf(KIND)
    def found(texts: pa.Array) -> pa.Array:
        return _matcher(part)(texts)

    return found


def _merged() -> Callable:
    """Runs of several parts as the runs of their union."""

    @F.arrow_udf("array<struct<start: bigint, n: bigint>>")
    def union(runs: pa.Array) -> pa.Array:
        out = []
        for lists in runs.to_pylist():
            spans = sorted((r["start"], r["start"] + r["n"]) for r in lists)
            one = []
            for a, b in spans:
                if one and a <= one[-1][1]:
                    one[-1][1] = max(one[-1][1], b)
                else:
                    one.append([a, b])
            out.append([{"start": a, "n": b - a} for a, b in one])
        return pa.array(out, _RUNS)

    return union


def find(docs: DataFrame, benchmark: DataFrame, words: int = WORDS, part_bytes: int = PART_BYTES) -> DataFrame:
    """(row, found): each document as the struct of its own columns, and what was found in it.

    found has n_words, runs (start, n: maximal runs of hit words, counted from 0) and
    items (ids as strings of the items with an occurring test string).
    """
    spark = docs.sparkSession
    bound_batches(spark)
    strings = settle(patterns(benchmark, words))
    size = strings.agg(F.sum(F.length("string") + F.coalesce(F.length("item"), F.lit(0)) + 16)).first()[0] or 0
    parts = max(1, -(-size // part_bytes))
    strings = strings.withColumn("part", F.pmod(F.xxhash64("string", "item"), F.lit(parts)))
    searches = []
    for k in range(parts):  # each part is bounded, and so is what the driver holds of it
        rows = strings.where(F.col("part") == k).drop("part").toArrow()
        value = tuple(rows.column(c).to_pylist() for c in ("string", "words", "item"))
        searches.append(_search(spark.sparkContext.broadcast(value)))
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = docs.select(F.struct("*").alias("row"), text.alias("bytes"))
    if parts == 1:
        return rows.select("row", searches[0]("bytes").alias("found"))
    rows = rows.withColumns({"k1": F.xxhash64("bytes"), "k2": F.md5("bytes")})
    finds = None
    for search in searches:
        mine = rows.select("k1", "k2", search("bytes").alias("f")).where(F.size("f.items") > 0).distinct()
        finds = mine if finds is None else finds.union(mine)
    joint = finds.groupBy("k1", "k2").agg(
        F.flatten(F.collect_list("f.runs")).alias("runs"), F.array_distinct(F.flatten(F.collect_list("f.items"))).alias("items")
    )
    joint = joint.select(F.col("k1").alias("j1"), F.col("k2").alias("j2"), _merged()("runs").alias("runs"), "items")
    n = _search(spark.sparkContext.broadcast(((), (), ())))("bytes")["n_words"]
    return (
        rows.select("row", "k1", "k2", n.alias("n_words"))
        .join(joint, (F.col("k1") == F.col("j1")) & (F.col("k2") == F.col("j2")), "left")
        .select(
            "row",
            F.struct(
                "n_words",
                F.coalesce("runs", F.array().cast("array<struct<start: bigint, n: bigint>>")).alias("runs"),
                F.coalesce("items", F.array().cast("array<string>")).alias("items"),
            ).alias("found"),
        )
    )


def n_hit(found: str = "found") -> Column:
    return F.aggregate(F.col(f"{found}.runs"), F.lit(0).cast("bigint"), lambda a, r: a + r["n"])


def report(docs: DataFrame, benchmark: DataFrame, words: int = WORDS, part_bytes: int = PART_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    done = find(docs, benchmark, words, part_bytes)
    ids = F.array_join(F.array_sort("found.items"), ",")
    return done.select(
        "row.doc_id",
        F.col("found.n_words").alias("n_words"),
        n_hit().alias("n_hit"),
        F.size("found.items").cast("bigint").alias("n_items"),
        F.sha2(ids.cast("binary"), 256).alias("items_sha256"),
        (F.size("found.items") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, words: int = WORDS) -> DataFrame:
    """The documents without any test string, in their own columns."""
    return find(docs, benchmark, words).where(F.size("found.items") == 0).select("row.*")
