"""Chat formatting: cumulative snapshots collapse to the maximal conversations.

A service that logs the whole conversation after every turn leaves each prefix as
a conversation of its own. Every turn gets the rolling hash of the turns up to it
(the exclusive-or of hashes of place, role and text, 128 bits, so it can be summed
in blocks); a conversation is named by the hash of its last turn. It is dropped if
that hash is a proper prefix hash of another one (anti-join), and of equal
conversations the smallest conv_id stays. What is left is rendered in the
``<|im_start|>role`` notation, in parts of ``PART`` turns so that no text is
unbounded.

Defined cases: turns are ordered by turn (null first), role and text; repeated rows
of a conversation count once; null roles and texts are empty; a conversation
without id is one conversation; other columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moodloom.llm.common import drop, settle

PART = 512
START, END = "<|im_start|>", "<|im_end|>\n"


def rolling(turns: DataFrame) -> DataFrame:
    """conv_id, place, part, role, text, h1, h2 (hashes of the turns up to this one)."""
    rows = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    ).distinct()
    # Turns are numbered and hashed block by block, then blocks are added up, so a
    # conversation of any length is spread over tasks.
    rows = rows.withColumn("block", F.floor(F.col("turn") / PART))
    inside = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    rows = rows.withColumn("nth", F.row_number().over(inside))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("conv_id", "block").agg(F.count("*").alias("n"))
    sizes = sizes.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    same = lambda a, b: a["conv_id"].eqNullSafe(b["conv_id"]) & a["block"].eqNullSafe(b["block"])
    a, b = rows.alias("a"), sizes.alias("b")
    placed = a.join(b, same(rows, sizes)).select("a.*", (F.col("nth") + F.col("before")).alias("place"))
    placed = settle(
        placed.withColumns(
            {
                "h1": F.xxhash64("place", "role", "text"),
                "h2": F.xxhash64("text", "role", "place", F.lit("other")),
            }
        )
    )
    sums = placed.groupBy("conv_id", "block").agg(F.bit_xor("h1").alias("x1"), F.bit_xor("h2").alias("x2"))
    sums = sums.select(
        "conv_id", "block", *[F.coalesce(F.bit_xor(x).over(earlier), F.lit(0)).alias(x) for x in ("x1", "x2")]
    )
    upto = Window.partitionBy("conv_id", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    run = placed.withColumns({"r1": F.bit_xor("h1").over(upto), "r2": F.bit_xor("h2").over(upto)})
    return run.alias("a").join(sums.alias("b"), same(run, sums)).select(
        "a.conv_id",
        "place",
        F.floor((F.col("place") - 1) / PART).alias("part"),
        "role",
        "text",
        F.col("r1").bitwiseXOR(F.col("x1")).alias("h1"),
        F.col("r2").bitwiseXOR(F.col("x2")).alias("h2"),
    )


def maximal(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rolling rows, and (conv_id, n_turns) of the conversations that stay."""
    rows = settle(rolling(turns))
    sizes = rows.groupBy("conv_id").agg(F.max("place").alias("n_turns"))
    tagged = rows.select("conv_id", "place", "h1", "h2").join(
        sizes.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c"))
    )
    key = ["place", "h1", "h2"]
    whole = tagged.where("place = n_turns").groupBy(*key).agg(F.min("conv_id").alias("conv_id"))
    inner = tagged.where("place < n_turns").select(*key).distinct()
    return rows, whole.join(inner, key, "left_anti").select("conv_id", F.col("place").alias("n_turns"))


def render(turns: DataFrame) -> DataFrame:
    """conv_id, part, n_turns (of the conversation), text of the maximal conversations."""
    rows, stay = maximal(turns)
    stay = settle(stay)
    turn = F.concat(F.lit(START), F.col("role"), F.lit("\n"), F.col("text"), F.lit(END))
    return (
        rows.join(stay.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c")))
        .groupBy("conv_id", F.col("part").cast("bigint").alias("part"), F.col("n_turns").cast("bigint").alias("n_turns"))
        .agg(F.sort_array(F.collect_list(F.struct("place", turn.alias("t")))).alias("turns"))
        .select("conv_id", "part", "n_turns", F.array_join(F.col("turns.t"), "").alias("text"))
    )
