"""Collapse of cumulative conversation snapshots, and rendering of what is left.

A chat log often holds a conversation many times: once after each exchange, every snapshot a prefix of
the next. The hash of each turn prefix rolls along the turns (exclusive-or of position-bound hashes, 128
bits). A conversation goes if its whole hash is the hash of a proper prefix of another one (anti-join);
of conversations with equal turns the smallest id stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def _turns(conversations: DataFrame) -> DataFrame:
    """Distinct turns with their position, the conversation's length and the hashes of the prefix that ends there."""
    rows = conversations.where("conv_id is not null").select(
        "conv_id", F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    ).distinct()
    conv = Window.partitionBy("conv_id")
    order = conv.orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = rows.select("*", F.row_number().over(order).alias("pos"), F.count("*").over(conv).cast("int").alias("n_turns"))
    return numbered.select(
        "conv_id", "pos", "n_turns", "role", "text",
        F.bit_xor(F.xxhash64("pos", "role", "text")).over(so_far).alias("h1"),
        F.bit_xor(F.xxhash64("text", "pos", F.lit("second"), "role")).over(so_far).alias("h2"),
    )


def collapse_snapshots(conversations: DataFrame) -> DataFrame:
    """``conv_id, n_turns, n_copies`` of the maximal conversations.

    Turns count in order of ``turn`` (nulls first; equal turns by role, then text); a row that repeats in
    full counts once; null role or text counts as empty; rows without ``conv_id`` belong to no
    conversation. ``n_copies``: conversations with the same turns, of which the smallest ``conv_id`` stays.
    An empty table gives an empty result; other columns are ignored.
    """
    return _maximal(_turns(conversations))


def _maximal(turns: DataFrame) -> DataFrame:
    key = ["h1", "h2", "pos"]
    whole = turns.where("pos = n_turns").groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    inner = turns.where("pos < n_turns").select(*key).distinct()
    return whole.join(inner, key, "left_anti").select("conv_id", F.col("pos").alias("n_turns"), "n_copies")


def render(conversations: DataFrame, open_turn: str = "<|", close_role: str = "|>\n", end_turn: str = "\n") -> DataFrame:
    """``conv_id, n_turns, n_copies, rendered``: the maximal conversations as one text each, role before every turn."""
    turns = _turns(conversations)
    turn = F.struct("pos", F.concat(F.lit(open_turn), "role", F.lit(close_role), "text", F.lit(end_turn)).alias("part"))
    texts = turns.select("conv_id", turn.alias("t")).join(_maximal(turns), "conv_id")
    return texts.groupBy("conv_id").agg(
        F.first("n_turns").alias("n_turns"), F.first("n_copies").alias("n_copies"),
        F.array_join(F.transform(F.sort_array(F.collect_list("t")), lambda t: t["part"]), "").alias("rendered"),
    )
