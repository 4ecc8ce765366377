"""Helpers that several operators share: Arrow text access, scratch tables, components."""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodloom.session import settle

#: Bytes of text that one NumPy step handles; a longer single text is a step of its own.
STEP_BYTES = 4 << 20


#: Bytes of an Arrow batch between Spark and a Python worker.
BATCH_BYTES = 2 << 20


def bound_batches(spark) -> None:
    """Arrow batches of at most ``BATCH_BYTES`` in this session; a lower setting stays.

    Spark's own bound is 64 MB, and a task holds a batch several times over (JVM
    buffer, Python copy, result). Whole texts are wide rows, so the bound in bytes
    decides, not the one in rows. A single longer text is a batch of its own.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if size <= 0 or size > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def give_back() -> None:
    """Return freed memory of this Python worker to the system.

    Workers outlive their tasks: what one step leaves in the allocators' free
    lists would add to the memory of the steps after it.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def utf8(column: str = "text") -> Column:
    """The whole text as UTF-8 bytes; null is empty."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def read(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def joined(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary or string array without nulls, and its n + 1 offsets from zero."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = arr.cast(pa.large_binary())
    offsets = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    if arr.buffers()[2] is None or offsets[-1] == offsets[0]:
        return np.empty(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    data = np.frombuffer(arr.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def steps(sizes: np.ndarray, limit: int = STEP_BYTES):
    """Consecutive row ranges of about ``limit`` in sum, at least one row each."""
    start, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if total and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer of 64-bit hashes: every input bit reaches every output bit."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text in a row, and the words per text."""
    split = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
    flat = split.flatten()
    rows = np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
    some = pc.greater(pc.binary_length(flat), 0)
    flat = flat.filter(some)
    rows = rows[some.to_numpy(zero_copy_only=False)]
    return flat, np.bincount(rows, minlength=len(texts))


def release(spark) -> None:
    """Let Spark remove the shuffle files of finished steps now instead of at some later GC."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop(*tables: DataFrame) -> None:
    """Delete tables made by ``settle`` that nothing reads any more."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        files = df.inputFiles()
        if files:
            folder = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            if folder.getParent().getName() == "tables":
                folder.getFileSystem(conf).delete(folder, True)


def forest(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest place that each of n places reaches by the links (u, v)."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, u, root[v])
        np.minimum.at(low, v, root[u])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, comp) of every node in ``edges``: comp is the smallest node reachable.

    Alternating large-star and small-star steps: each hangs the neighbours of a
    node on its smallest one, so the rounds grow with the logarithm of the
    longest path. No node's neighbours meet in one task: minima are combined
    before the shuffle and the joins may be split. Edges are settled per round.
    """

    def star(e: DataFrame, both: bool) -> DataFrame:
        """Each node's neighbours (with ``both`` only the larger ones move) on its smallest."""
        sides = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both else e
        low = sides.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        moved = sides.join(low, "u")
        if both:
            out = moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
                low.select("u", F.col("m").alias("v"))
            )
        return out.where("u > v").distinct()

    state = settle(
        edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u > v").distinct()
    )
    seen = None
    while True:
        # A forest of stars: every node hangs on a root and no root hangs on anything.
        state, old = settle(star(star(state, True), False)), state
        drop(old)
        mark = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    return state.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(
        state.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    )
