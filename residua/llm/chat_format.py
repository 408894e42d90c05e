"""Chat formatting with cumulative-snapshot collapse, in DataFrame functions alone.

A log often holds a conversation again each time it grows. The turns of a conversation, in order, give a rolling hash for each
prefix: h(k) = SHA-256 of h(k - 1), the turn's role and its text, lengths included. A conversation whose whole hash is the
hash of a proper prefix of a longer one is a snapshot of it; an anti-join on (turns, hash) leaves the maximal ones. Of equal
conversations the smallest conv_id stays. Only then are chats rendered.

Prefix hashes are made distinct before the join, with partial aggregation, so a first turn that a third of all conversations
share is one row there. A conversation itself is one output row and is gathered as such.

Defined cases: a null role or text counts as empty, a null turn comes first. Turns are ordered by (turn, role, text) and a row
that is repeated whole counts once. Rows with a null conv_id belong to no conversation and are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle


def gather(turns: DataFrame) -> DataFrame:
    """conv_id and its turns in order."""
    turn = F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return turns.where(F.col("conv_id").isNotNull()).groupBy("conv_id").agg(F.array_sort(F.collect_set(turn)).alias("turns"))


def prefix_hashes(turns: Column) -> Column:
    """h(1), h(2), ... of an array of turns."""

    def step(done: Column, turn: Column) -> Column:
        last = F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(""))
        parts = (last, F.length(turn["role"]).cast("string"), F.lit(":"), turn["role"], F.length(turn["text"]).cast("string"), F.lit(":"), turn["text"])
        return F.concat(done, F.array(F.sha2(F.concat(*parts), 256)))

    return F.aggregate(turns, F.array().cast("array<string>"), step)


def maximal(conversations: DataFrame) -> DataFrame:
    """conv_id, n_copies and turns of the conversations that no longer one begins with."""
    whole, _ = settle(gather(conversations).withColumn("hashes", prefix_hashes(F.col("turns"))).withColumn("n", F.size("turns")), "chat-turns")
    ends = whole.groupBy("n", F.element_at("hashes", -1).alias("hash")).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    begins = whole.select(F.posexplode(F.slice("hashes", F.lit(1), F.col("n") - 1)).alias("k", "hash")).select((F.col("k") + 1).alias("n"), "hash").distinct()
    kept = ends.join(begins, ["n", "hash"], "left_anti").select("conv_id", "n_copies")
    return whole.join(kept, "conv_id").select("conv_id", "n_copies", "turns")


def render(turns: Column, before: str = "<|im_start|>", between: str = "\n", after: str = "<|im_end|>\n") -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(before), t["role"], F.lit(between), t["text"], F.lit(after))), "")


def chats(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies and the rendered chat of every maximal conversation."""
    return maximal(conversations).select("conv_id", F.size("turns").alias("n_turns"), "n_copies", render(F.col("turns")).alias("chat"))
