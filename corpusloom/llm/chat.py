"""Chat formatting with collapse of cumulative snapshots.

Logs often hold a conversation again after every turn. Each turn gets the hash of all turns
up to it (a rolling prefix hash); a conversation whose last hash is some longer
conversation's hash at the same turn is a prefix of it. Equal conversations are first
reduced to the smallest id, then an anti-join on (turn, hash) retains the maximal ones,
which are rendered.

The prefix hash is the exclusive-or of turn hashes that contain the turn's position (two of
64 bits), so it is a running aggregate. Positions and running values are computed in blocks
of BLOCK turns with offsets per block, so a conversation that holds a third of all turns is
not one task. Rendered turns are rows with their place in the conversation's text; nothing
is joined into one row that grows with a conversation.

Only DataFrame functions are used.

Defined cases: turns are ordered by turn, then role and text; exactly repeated rows count
once; a null turn number comes first; a null role renders as "user", a null text as "";
rows with a null conversation id belong to no conversation and are left out; extra columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.llm.common import stored

BLOCK = 1024
START, END = "<|im_start|>", "<|im_end|>"


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END + "\n"))


def turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, pos (from 1), role, text, h1, h2: every turn with the hash of the turns up to it."""
    rows = stored(
        conversations.where(F.col(conv_col).isNotNull())
        .select(
            F.col(conv_col).alias("conv_id"), F.coalesce(F.col(turn_col), F.lit(-1)).cast("long").alias("turn"),
            F.coalesce(F.col(role_col), F.lit("user")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        )
        .distinct().withColumn("blk", F.floor(F.col("turn") / BLOCK))
    )
    before = Window.partitionBy("conv_id").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("conv_id", "blk").agg(F.count("*").alias("n")).withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0)))
    inside = Window.partitionBy("conv_id", "blk").orderBy("turn", "role", "text")
    placed = (
        rows.withColumn("r", F.row_number().over(inside)).join(sizes.drop("n"), ["conv_id", "blk"])
        .withColumn("pos", F.col("r") + F.col("ahead")).drop("r", "ahead")
        .withColumn("t1", F.xxhash64("pos", "role", "text")).withColumn("t2", F.xxhash64(F.lit("turn"), "text", "role", "pos"))
    )
    placed = stored(placed)
    offsets = placed.groupBy("conv_id", "blk").agg(F.bit_xor("t1").alias("x1"), F.bit_xor("t2").alias("x2")).select(
        "conv_id", "blk", *[F.coalesce(F.bit_xor(f"x{i}").over(before), F.lit(0)).alias(f"o{i}") for i in (1, 2)]
    )
    upto = Window.partitionBy("conv_id", "blk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return (
        placed.withColumn("l1", F.bit_xor("t1").over(upto)).withColumn("l2", F.bit_xor("t2").over(upto))
        .join(offsets, ["conv_id", "blk"])
        .select("conv_id", "pos", "role", "text", F.col("l1").bitwiseXOR(F.col("o1")).alias("h1"), F.col("l2").bitwiseXOR(F.col("o2")).alias("h2"))
    )


def maximal(rolled: DataFrame) -> DataFrame:
    """conv_id, n_turns of the conversations that are no prefix of another."""
    length = rolled.groupBy("conv_id").agg(F.max(F.struct("pos", "h1", "h2")).alias("last")).select("conv_id", F.col("last.pos").alias("n_turns"), "last.h1", "last.h2")
    length = stored(length)
    # equal conversations are one from here on, so both sides of the anti-join are unique
    ends = length.groupBy("n_turns", "h1", "h2").agg(F.min("conv_id").alias("conv_id"))
    inner = (
        rolled.join(length.select("conv_id", "n_turns"), "conv_id").where("pos < n_turns")
        .select(F.col("pos").alias("n_turns"), "h1", "h2").distinct()
    )
    return ends.join(inner, ["n_turns", "h1", "h2"], "left_anti").select("conv_id", "n_turns")


def format_chats(conversations: DataFrame, **names) -> DataFrame:
    """conv_id, pos, n_turns, role, rendered, is_target (assistant turns): the turns of the
    maximal conversations; the rendered turns in order are the conversation's text."""
    rolled = stored(turns(conversations, **names))
    kept = stored(maximal(rolled))
    return rolled.join(kept, "conv_id").select(
        "conv_id", "pos", "n_turns", "role", rendered(F.col("role"), F.col("text")).alias("rendered"), (F.col("role") == "assistant").alias("is_target")
    )
