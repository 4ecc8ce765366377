"""Prefix trie of conversations from sorted turn-id matrices.

A turn's id is the 128-bit hash of its role and text. Conversations, as lists of turn
ids, are dealt by range of (ids, conv_id), so conversations with a common prefix lie side
by side and even a third of all conversations being equal splits over many shards. In a
shard the lists stand as padded matrices of ``COLUMNS`` turns at a time (a long
conversation pads nothing but its own rows), sorted by NumPy's lexsort. Neighbouring rows
are compared column by column; the changes, OR-accumulated from left to right, say at
which depth a row leaves the row before it, and so where the nodes of every depth start.
``reduceat`` over those starts gives the members, leaves and saved words of all nodes of a
depth at once: a row adds to a node the words of its turns from there to where it leaves
the row before, which counts each node's text once less than its members.

Only nodes on the paths of a shard's first and last row can go on in other shards. Those
come as partial sums with a hash of their prefix as key and are added up over the shards;
where a shard's first row and the last one before it share a prefix, the shared nodes,
which both shards took for new, are taken back. The ids of the conversations that end in
such a node are hashed shard by shard as a stream, so no task holds them all.

Defined cases: turns are ordered by turn (null first), equal ones by id; repeated rows are
turns of their own; a null role or text is empty; rows without conv_id belong to no
conversation and are left out; the remainder of a negative conv_id is negative or zero; a
conversation that loses all its turns is a member of the root alone; other columns do not
matter; an empty table has no root. The ids of a conversation's turns and its word counts
are one row (20 bytes a turn), its texts are not, so very long texts cost nothing here.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moodloom.llm.common import bound_batches, joined, settle

#: Conversations c of one group of ``GROUP`` ids take their first crc32(c) % HEADS turns from the group's first one.
GROUP, HEADS = 20, 4
#: Turns of a matrix, and turns (or conversations) of a shard.
COLUMNS = 16
SHARD = 1 << 19
EMPTY = hashlib.sha256(b"").hexdigest()
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of an Arrow batch of nodes.
ROWS = 8192

KIND = (
    "shard int, key binary, parent_key binary, first boolean, last boolean, ends_here boolean, before bigint,"
    " upto bigint, depth bigint, conv_id bigint, parent_conv_id bigint, n_convs bigint, n_children bigint,"
    " n_leaves bigint, saved_tokens bigint, ends string"
)
SUMS = ("n_convs", "n_children", "n_leaves", "saved_tokens")


def sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's ordered (id, words)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.struct(
            "turn",
            F.unhex(F.md5(F.concat(F.md5(role.cast("binary")), F.md5(text.cast("binary"))))).alias("id"),
            F.regexp_count(text, F.lit(WORD)).alias("words"),
        ).alias("t"),
    )
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, turns) of conversations that take their first turns from their group's first one."""
    own = settle(sequences(turns))
    base = F.col("conv_id") - F.col("conv_id") % GROUP
    heads = own.where(F.col("conv_id") == base).select(
        F.col("conv_id").alias("base"), F.slice("turns", 1, HEADS - 1).alias("head")
    )
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    rest = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    taken = F.slice(F.coalesce("head", F.array().cast(own.schema["turns"].dataType)), F.lit(1), h)
    return own.withColumn("base", base).join(heads, "base", "left").select("conv_id", F.concat(taken, rest).alias("turns"))


def sort_rows(hi: np.ndarray, lo: np.ndarray, start: np.ndarray, size: np.ndarray, conv: np.ndarray) -> np.ndarray:
    """Order of the rows by turn ids (a prefix before its extensions), then conv_id."""
    order = np.lexsort((conv,))
    tie = np.zeros(len(order), np.int64)  # rows with equal ids so far, in their place
    open_rows = np.arange(len(order))
    depth = 0
    while len(open_rows):
        mine = order[open_rows]
        keys = [conv[mine]]
        for c in reversed(range(COLUMNS)):
            there = size[mine] > depth + c
            spot = np.where(there, start[mine] + depth + c, 0)
            keys += [np.where(there, lo[spot], 0), np.where(there, hi[spot], 0)] if len(hi) else []
        by = np.lexsort((*keys, tie[open_rows]))
        order[open_rows] = mine = mine[by]
        change = np.r_[True, np.diff(tie[open_rows]) != 0]
        for k in keys[1:]:
            k = k[by]
            change[1:] |= k[1:] != k[:-1]
        group = np.cumsum(change) - 1
        depth += COLUMNS
        longer = np.bincount(group, size[mine] > depth) > 0
        more = longer[group] & (np.bincount(group) > 1)[group]
        tie[open_rows] = group
        open_rows = open_rows[more]
    return order


def common_prefix(hi: np.ndarray, lo: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Turns that each row shares with the row before it; -1 for the first row."""
    shared = np.r_[-1, np.zeros(len(size) - 1, np.int64)]
    rows = np.arange(1, len(size))
    depth = 0
    while len(rows) and len(hi):
        columns = depth + np.arange(COLUMNS)
        at = [np.where(size[r][:, None] > columns, start[r][:, None] + columns, -1) for r in (rows, rows - 1)]
        change = ((at[0] >= 0) != (at[1] >= 0)) | (hi[at[0]] != hi[at[1]]) | (lo[at[0]] != lo[at[1]])
        change &= (at[0] >= 0) | (at[1] >= 0)  # padding equals padding
        starts = np.logical_or.accumulate(change, axis=1)
        shared[rows] += COLUMNS - starts.sum(1)
        depth += COLUMNS
        rows = rows[~starts[:, -1] & (size[rows] > depth)]
    shared[1:] = np.minimum(shared[1:], size[1:])
    return shared


def _path(hi: np.ndarray, lo: np.ndarray) -> list[bytes]:
    """Keys of all prefixes of one row, from the root on."""
    ids = np.stack([hi, lo], 1).astype(">u8").tobytes()
    state = hashlib.md5(usedforsecurity=False)
    keys = [state.digest()]
    for k in range(len(hi)):
        state.update(ids[16 * k : 16 * k + 16])
        keys.append(state.digest())
    return keys


class Shard:
    """Nodes of the conversations of one shard."""

    def __init__(self, conv: np.ndarray, size: np.ndarray, ids: np.ndarray, words: np.ndarray):
        pairs = ids.view(">u8").astype(np.uint64).reshape(-1, 2)
        self.hi, self.lo = np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1])
        start = np.cumsum(size) - size
        order = sort_rows(self.hi, self.lo, start, size, conv)
        self.conv, self.size, self.start = conv[order], size[order], start[order]
        self.shared = common_prefix(self.hi, self.lo, self.start, self.size)
        self.upto = np.r_[0, np.cumsum(words)]
        # A row is a leaf if no row after it equals or extends it.
        self.leaf = np.r_[self.shared[1:] < self.size[:-1], True].astype(np.int64)
        self.paths = []
        for r in (0, -1):
            a, n = self.start[r], self.size[r]
            self.paths.append(_path(self.hi[a : a + n], self.lo[a : a + n]))

    def edges(self, depth: int) -> tuple[bytes | None, bytes | None]:
        return tuple(p[depth] if depth < len(p) else None for p in self.paths)

    def depths(self):
        """(depth, numbers, ends) from the root on; numbers by column for all nodes of the depth."""
        rows = np.arange(len(self.conv))
        node = np.zeros(len(rows), np.int64)
        low = None
        held = None
        for depth in range(int(self.size.max()) + 1):
            rows = rows[self.size[rows] >= depth]
            fresh = self.shared[rows] < depth
            begin = np.flatnonzero(fresh)
            parent = node[rows[begin]]
            if held is not None:
                held[1]["n_children"] = np.bincount(parent, minlength=len(held[1]["conv_id"]))
                yield held
            node[rows] = np.cumsum(fresh) - 1
            a, shared = self.start[rows], np.maximum(self.shared[rows], 0)
            saved = self.upto[a + shared] - self.upto[a + max(depth - 1, 0)]
            saved[shared < depth] = 0
            ends = rows[self.size[rows] == depth]
            held = (
                depth,
                {
                    "parent": parent,
                    "parent_conv_id": None if low is None else low[parent],
                    "conv_id": (low := np.minimum.reduceat(self.conv[rows], begin)),
                    "n_convs": np.diff(np.r_[begin, len(rows)]),
                    "n_leaves": np.add.reduceat(self.leaf[rows], begin),
                    "saved_tokens": np.add.reduceat(saved, begin),
                },
                self.ends(ends, node[ends]),
            )
        held[1]["n_children"] = np.zeros(len(held[1]["conv_id"]), np.int64)
        yield held

    def ends(self, rows: np.ndarray, nodes: np.ndarray) -> dict[int, str]:
        """The conversations that end in each node, if any, in ascending order."""
        cuts = np.flatnonzero(np.r_[True, nodes[1:] != nodes[:-1], True]) if len(rows) else []
        ids = self.conv[rows].tolist()
        return {int(nodes[a]): ",".join(map(str, ids[a:b])) for a, b in zip(cuts[:-1], cuts[1:])}

    def nodes(self, shard: int):
        """Columns of ``KIND`` of all nodes, a part of a depth at a time."""
        for depth, x, ends in self.depths():
            n = len(x["conv_id"])
            sha = [EMPTY] * n
            key: list[bytes | None] = [None] * n
            parent_key: list[bytes | None] = [None] * n
            for k, joint in ends.items():
                sha[k] = hashlib.sha256(joint.encode()).hexdigest()
            flags = {c: np.zeros(n, bool) for c in ("first", "last", "ends_here")}
            before, upto = np.zeros(n, np.int64), np.zeros(n, np.int64)
            for r, place, name in ((0, 0, "first"), (-1, n - 1, "last")):
                own = self.edges(depth)[r]
                if own is None:
                    continue
                key[place], sha[place] = own, ends.get(place, "")
                flags[name][place] = True
                if r == 0:
                    a = self.start[0]
                    before[0] = self.upto[a + max(depth - 1, 0)] - self.upto[a]
                    upto[0] = self.upto[a + depth] - self.upto[a]
                else:
                    flags["ends_here"][place] = depth == self.size[-1]
            if depth:
                above = self.edges(depth - 1)
                for own, place in zip(above, (0, self.above - 1)):
                    for k in np.flatnonzero(x["parent"] == place) if own else ():
                        parent_key[k] = own
            self.above = n
            columns = [
                pa.array(np.full(n, shard, np.int32)),
                pa.array(key, pa.binary()),
                pa.array(parent_key, pa.binary()),
                *[pa.array(flags[c]) for c in ("first", "last", "ends_here")],
                pa.array(before),
                pa.array(upto),
                pa.array(np.full(n, depth)),
                pa.array(x["conv_id"]),
                pa.nulls(n, pa.int64()) if x["parent_conv_id"] is None else pa.array(x["parent_conv_id"]),
                *[pa.array(x[c].astype(np.int64)) for c in SUMS],
                pa.array(sha, pa.string()),
            ]
            for a in range(0, n, ROWS):
                yield pa.RecordBatch.from_arrays([c[a : a + ROWS] for c in columns], [c.split()[0] for c in KIND.split(",")])


def _shards(batches):
    """Nodes of a task's conversations."""
    conv, size, ids, words = [], [], [], []
    for b in batches:
        conv.append(b.column("conv_id").to_numpy())
        size.append(b.column("ids").value_lengths().to_numpy())
        ids.append(joined(b.column("ids").flatten())[0])
        words.append(b.column("words").flatten().to_numpy())
    if sum(map(len, conv)):
        shard = Shard(*[np.concatenate(x) for x in (conv, size, ids, words)])
        yield from shard.nodes(TaskContext.get().partitionId())


def _streamed(batches):
    """SHA-256 of the ends of each key; rows come by key and shard."""
    key, state, out = None, None, []
    for b in batches:
        for k, ends in zip(b.column("key").to_pylist(), b.column("ends").to_pylist()):
            if k != key:
                if key is not None:
                    out.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256(ends.encode())
            else:
                state.update(b"," + ends.encode())
        if len(out) >= ROWS:
            yield _pairs(out)
            out = []
    if key is not None:
        yield _pairs([*out, (key, state.hexdigest())])


def _pairs(rows: list[tuple[bytes, str]]) -> pa.RecordBatch:
    keys, hashes = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(hashes)], ["key", "ends_sha256"])


def trie(sequences: DataFrame) -> DataFrame:
    """Nodes of all prefixes of (conv_id, turns): conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = sequences.sparkSession
    bound_batches(spark)
    rows = settle(sequences.select("conv_id", F.col("turns.id").alias("ids"), F.col("turns.words").alias("words")))
    total = rows.agg(F.sum(F.size("ids") + 1)).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARD))
    found = settle(rows.repartitionByRange(shards, "ids", "conv_id").mapInArrow(_shards, KIND))

    edge = found.where("key IS NOT NULL")
    # One row a shard: which shard with rows comes before.
    order = edge.where("depth = 0").select("shard", F.lag("shard").over(Window.orderBy("shard")).alias("prev"))
    last = edge.where("last").select(F.col("shard").alias("prev"), "key", F.col("ends_here").alias("whole"))
    both = settle(
        edge.where("first")
        .select("shard", "key", "parent_key", "depth", "before", "upto")
        .join(order, "shard")
        .join(last, ["prev", "key"])
    )
    top = both.groupBy("shard").agg(F.max("depth").alias("deepest"), F.max("upto").alias("all"), F.max("whole").alias("covered"))
    again = both.join(top, "shard").select(
        "key",
        "parent_key",
        "depth",
        F.lit(None).cast("bigint").alias("conv_id"),
        F.lit(0).cast("bigint").alias("n_convs"),
        (-(F.col("depth") < F.col("deepest")).cast("bigint")).alias("n_children"),
        (-F.col("covered").cast("bigint")).alias("n_leaves"),
        (F.col("all") - F.col("before")).alias("saved_tokens"),
    )
    sums = settle(
        edge.select(again.columns)
        .union(again)
        .groupBy("key", "parent_key", "depth")
        .agg(F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in SUMS])
    )
    named = sums.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    pieces = edge.where("ends <> ''").select("key", "shard", "ends").repartition("key").sortWithinPartitions("key", "shard")
    hashed = pieces.select("key", "ends").mapInArrow(_streamed, "key binary, ends_sha256 string")
    out = ["conv_id", "depth", "parent_conv_id", *SUMS, "ends_sha256"]
    edges = (
        sums.join(named, "parent_key", "left")
        .join(hashed, "key", "left")
        .withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY)))
    )
    inner = found.where("key IS NULL").withColumnRenamed("ends", "ends_sha256")
    # A shard's own copy of its path spreads the many children of one node, such as the root.
    own = edge.select("shard", F.col("key").alias("parent_key")).join(named, "parent_key")
    below = inner.where("parent_key IS NOT NULL").drop("parent_conv_id").join(own, ["shard", "parent_key"])
    return edges.select(out).union(below.select(out)).union(inner.where("parent_key IS NULL").select(out))
