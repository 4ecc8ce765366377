"""Keyed helpers that hold up when one group has a third of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moodloom.session import settle

#: Pieces of a hot key for each task's share of rows.
PIECES = 4


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the smallest in ``order``.

    A ``min`` over structs combines before the shuffle, so a key with very
    many copies reaches the reducer as one row per map task. A window would
    send all copies to one task.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    first = df.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("_f"))
    return first.select(*keys, *[F.col("_f")[c].alias(c) for c in [*order, *rest]]).select(
        *df.columns
    )


def hot_join(
    large: DataFrame, one: DataFrame, keys: Sequence[str], spread: Sequence[str], sizes: DataFrame | None = None
) -> DataFrame:
    """Inner join of ``large`` with ``one``, which has at most one row per key, so that a
    key with very many rows does not end in one task.

    A key is hot if it has more than a task's share of ``large``. Its rows are dealt out
    by a hash of the columns ``spread``, ``PIECES`` to a share so that pieces which meet in a
    task stay small, and its one row is copied as often. The hot keys are fewer than there
    are partitions, which bounds what is broadcast; the copies are fewer than 2 x ``PIECES``
    x partitions. ``sizes`` (keys, n) saves the count where it is known. Rows with a null key
    join nothing.
    """
    if sizes is None:
        sizes = large.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    parts = int(large.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = max(1, -(-(sizes.agg(F.sum("n")).first()[0] or 0) // parts))
    hot = F.broadcast(sizes.where(F.col("n") > share).select(*keys, F.ceil(PIECES * F.col("n") / share).alias("_salts")))
    salts = F.coalesce("_salts", F.lit(1))
    dealt = large.join(hot, list(keys), "left").withColumn("_salt", F.pmod(F.xxhash64(*spread), salts))
    copies = one.join(hot, list(keys), "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), salts - 1)))
    return dealt.drop("_salts").join(copies.drop("_salts"), [*keys, "_salt"]).drop("_salt")


#: Where the rows of a dealt table lie (``deal``).
DEALT = ("playlist_id", "_salt")


def hot_playlists(sizes: DataFrame) -> DataFrame:
    """(playlist_id, _salts): playlists with more than a task's share of all rows.

    ``sizes``: (playlist_id, n). They are fewer than there are partitions.
    """
    parts = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = settle(sizes)
    share = max(1, -(-(sizes.agg(F.sum("n")).first()[0] or 0) // parts))
    return settle(sizes.where(F.col("n") > share).select("playlist_id", F.ceil(PIECES * F.col("n") / share).alias("_salts")))


def deal(df: DataFrame, hot: DataFrame) -> DataFrame:
    """Adds ``_salt``: 0 for the rows of a usual playlist, which lie together, 1 and more for
    those of a hot one, dealt out by their track, below 0 for those of none."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.xxhash64("track_id")
    salt = (
        F.when(F.col("playlist_id").isNull(), -1 - F.pmod(place, F.lit(parts)))
        .when(F.col("_salts").isNotNull(), 1 + F.pmod(place, F.col("_salts")))
        .otherwise(0)
    )
    return df.join(F.broadcast(hot), "playlist_id", "left").withColumn("_salt", salt.cast("bigint")).drop("_salts")


def copies(one: DataFrame, hot: DataFrame) -> DataFrame:
    """The one row of each playlist, for every ``_salt`` under which ``deal`` put its rows.

    A join takes them as a hash table per task, so the many rows on its other side are not sorted.
    """
    salts = F.when(F.col("_salts").isNotNull(), F.sequence(F.lit(1).cast("bigint"), F.col("_salts")))
    dealt = one.join(F.broadcast(hot), "playlist_id", "left")
    return dealt.withColumn("_salt", F.explode(F.coalesce(salts, F.array(F.lit(0).cast("bigint"))))).drop("_salts").hint("shuffle_hash")


def rank_dealt(df: DataFrame, order: Sequence[Column], name: str = "rn") -> DataFrame:
    """``rank_in_group`` by playlist of a table from ``deal``: a usual playlist is less than a
    task's share and is ranked where it lies, only hot ones are range-partitioned."""
    usual = df.filter("_salt = 0").withColumn(name, F.row_number().over(Window.partitionBy(*DEALT).orderBy(*order)).cast("bigint"))
    hot = df.filter("_salt <> 0")
    return usual if hot.isEmpty() else usual.unionByName(rank_in_group(hot, ["playlist_id"], order, name))


def rank_in_group(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str = "rn"
) -> DataFrame:
    """Exact row number (from 1) inside each group, for ranks without a bound.

    ``row_number`` over a window puts a whole group into one task. Here the
    rows are range-partitioned and sorted on (group, order), so a big group
    spans many tasks; a row's rank is its offset in the task plus the number
    of rows of its group in earlier tasks. The offsets come from one
    (group, task) count, which has no more than groups + tasks rows.
    ``order`` must be total within a group.
    """
    keys = [F.col(c) for c in group]
    ordered = settle(
        df.repartitionByRange(*keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_task", F.shiftright("_at", 33))
    )
    starts = ordered.groupBy(*group, "_task").agg(
        F.min("_at").alias("_start"), F.count(F.lit(1)).alias("_rows")
    )
    before = Window.partitionBy(*group).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    joined = ordered.join(starts.drop("_rows"), [*group, "_task"])
    return joined.withColumn(name, F.col("_at") - F.col("_start") + F.col("_before") + 1).drop(
        "_at", "_task", "_start", "_before"
    )


def top_in_group(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, name: str = "rn"
) -> DataFrame:
    """The first ``k`` rows of each group for a small constant ``k``.

    Spark limits each group to ``k`` rows per map task before the shuffle
    (window group limit), so a big group costs no more than k x tasks rows.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)
