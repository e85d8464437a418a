"""Collapse of cumulative conversation snapshots, then rendering; DataFrame functions only.

A logger that stores a conversation after every turn leaves many conversations that are prefixes of
longer ones. Each turn's place, role and text are hashed; the running exclusive-or of two such
64-bit hashes names every turn-prefix. A conversation whose whole hash is a proper prefix of another
is dropped by an anti-join, as are all but the smallest conv_id of equal conversations. Sorted
turns are cut into blocks of bounded size, so a conversation with a third of all turns is shared out
among tasks: hashes run within a block and are carried over block totals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Rows of a block.
BLOCK = 1024


def _places(conversations: DataFrame) -> DataFrame:
    """conv, block, pos (from 1 over the whole conversation), role, body.

    Turns are sorted over all tasks and numbered in that order, so blocks are of BLOCK rows whatever their turn numbers.
    """
    turns = conversations.select(
        F.col("conv_id").alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("body"),
    )
    dealt = turns.repartitionByRange("conv", "turn", "role", F.substring("body", 1, 64)).sortWithinPartitions("conv", "turn", "role", "body")
    rows = cut(dealt.select("conv", "role", "body", F.monotonically_increasing_id().alias("seq")), "chat-turns").withColumn("block", F.floor(F.col("seq") / BLOCK))
    sizes = rows.groupBy("conv", "block").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    ahead = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(F.col("conv").alias("c"), F.col("block").alias("b"), "first", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    return rows.join(before, rows.conv.eqNullSafe(before.c) & (rows.block == before.b)).select("conv", "block", (F.col("seq") - F.col("first") + 1 + F.col("before")).alias("pos"), "role", "body")


def prefixes(placed: DataFrame) -> DataFrame:
    """conv, pos, h1, h2, turns from _places: the hashes of each conversation's first pos turns, and its number of turns."""
    marks = placed.select(
        "conv", "block", "pos", F.xxhash64("pos", "role", "body").alias("m1"), F.xxhash64(F.lit("second"), "body", "pos", "role").alias("m2")
    )
    run = Window.partitionBy("conv", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = marks.select("conv", "block", "pos", F.expr("bit_xor(m1)").over(run).alias("x1"), F.expr("bit_xor(m2)").over(run).alias("x2"))
    totals = marks.groupBy("conv", "block").agg(F.expr("bit_xor(m1)").alias("t1"), F.expr("bit_xor(m2)").alias("t2"), F.count("*").alias("n"))
    ahead = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        F.col("conv").alias("c"),
        F.col("block").alias("b"),
        F.coalesce(F.expr("bit_xor(t1)").over(ahead), F.lit(0)).alias("c1"),
        F.coalesce(F.expr("bit_xor(t2)").over(ahead), F.lit(0)).alias("c2"),
        F.sum("n").over(Window.partitionBy("conv")).alias("turns"),
    )
    return rows.join(carried, rows.conv.eqNullSafe(carried.c) & (rows.block == carried.b)).select(
        "conv", "pos", F.col("x1").bitwiseXOR(F.col("c1")).alias("h1"), F.col("x2").bitwiseXOR(F.col("c2")).alias("h2"), "turns"
    )


def maximal(placed: DataFrame) -> DataFrame:
    """conv, turns, from _places, of the conversations that are no proper prefix of another; of equal ones the smallest conv_id, null last."""
    heads = prefixes(placed)
    least = F.min(F.struct(F.col("conv").isNull().alias("none"), F.col("conv").alias("conv")))
    whole = heads.where("pos = turns").groupBy("pos", "h1", "h2").agg(least.alias("least"))
    proper = heads.where("pos < turns").select("pos", "h1", "h2").distinct()
    return whole.join(proper, ["pos", "h1", "h2"], "left_anti").select(F.col("least.conv").alias("conv"), F.col("pos").alias("turns"))


def render(conversations: DataFrame, part_turns: int = BLOCK) -> DataFrame:
    """conv_id, part, turns, first_turn, chat: the maximal conversations as chat text.

    conversations(conv_id, turn, role, text, ...): turns go by turn, null first, then role and text;
    repeated rows are turns of their own. Null roles and texts count as empty; rows without a
    conv_id form one conversation. A conversation is rendered in parts of part_turns turns, from 0,
    so that no task needs a whole one; nearly all have one part. turns is the length of the whole
    conversation, first_turn the place of the part's first turn, from 1. No rows give no rows.
    """
    placed = _places(conversations)
    longest = maximal(placed).select(F.col("conv").alias("c"), "turns")
    kept = placed.join(longest, placed.conv.eqNullSafe(longest.c))
    said = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("body"), F.lit("<|end|>\n"))
    part = F.floor((F.col("pos") - 1) / part_turns).cast("long")
    return (
        kept.groupBy(F.col("conv").alias("conv_id"), part.alias("part"))
        .agg(F.max("turns").cast("long").alias("turns"), F.array_sort(F.collect_list(F.struct("pos", said.alias("said")))).alias("said"))
        .select("conv_id", "part", "turns", F.col("said")[0]["pos"].cast("long").alias("first_turn"), F.concat_ws("", F.col("said.said")).alias("chat"))
    )
