"""Ranks, running totals and first occurrences that hold up when one key owns most of the rows.

A plain window sends a whole key to one task. Here rows are first put into *blocks* that follow the
order; windows run inside ``(key, block)``, and one small row per block carries the totals of the
blocks before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage


def with_range_blocks(df: DataFrame, order: list[str], blocks: int | None = None, name: str = "block") -> DataFrame:
    """Adds a block id for any order, composite ones included: the range partition a row falls in.

    The table is checkpointed with its block ids, so later steps (and recomputed tasks) all see the
    same boundaries. Ties are split only if ``order`` is unique, so end it with a row id. Without a
    number of blocks, adaptive execution merges small neighbouring ranges.
    """
    ranged = df.repartitionByRange(blocks, *order) if blocks else df.repartitionByRange(*order)
    return cut_lineage(ranged.withColumn(name, F.spark_partition_id().cast("bigint")))


def block_offsets(df: DataFrame, keys: list[str], block: str, **totals: Column) -> DataFrame:
    """One row per key and block: for each aggregate, its sum over earlier blocks and over all blocks.

    The first aggregation combines on the map side; the window after it sees one row per block.
    """
    per_block = df.groupBy(*keys, block).agg(*[expr.alias(name) for name, expr in totals.items()])
    whole = Window.partitionBy(*keys)
    before = whole.orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    out = per_block
    for name in totals:
        out = out.withColumn(f"{name}_before", F.coalesce(F.sum(name).over(before), F.lit(0)))
        out = out.withColumn(f"{name}_total", F.sum(name).over(whole))
    return out.drop(*totals)


def rank_in_blocks(
    df: DataFrame, keys: list[str], block: str, order: list, rank: str = "rank", total: str | None = None
) -> DataFrame:
    """Exact ``row_number`` per key (and optionally the key's row count). Keys must not be null."""
    local = df.withColumn("_local", F.row_number().over(Window.partitionBy(*keys, block).orderBy(*order)))
    offsets = block_offsets(df, keys, block, n=F.count("*"))
    joined = local.join(offsets, [*keys, block])
    out = joined.withColumn(rank, F.col("_local") + F.col("n_before"))
    if total:
        out = out.withColumn(total, F.col("n_total"))
    return out.drop("_local", "n_before", "n_total")


def increment_rank(plan: DataFrame, naive: str = "naive", ord_: str = "ord", blocks: int | None = None) -> DataFrame:
    """Rank of each input among those that ask for the same output name.

    Blocks are ranges of the data, so ids may be sparse, and a name asked for by very many rows has many blocks.
    """
    blocked = with_range_blocks(plan, [naive, ord_], blocks, "_block")
    return rank_in_blocks(blocked, [naive], "_block", [ord_], rank="increment_rank").drop("_block")


def progress(outcomes: DataFrame, job: str = "job_id", order: tuple[str, ...] = ("finished_at", "ord")) -> DataFrame:
    """``done`` of ``total`` for every completion of a batch, in completion order."""
    blocked = with_range_blocks(outcomes, list(order), name="_block")
    return rank_in_blocks(blocked, [job], "_block", list(order), rank="done", total="total").drop("_block")


def sort_by_path(df: DataFrame, path: str = "path", tie: str | None = None) -> DataFrame:
    """Lexicographic order. A tie-breaker lets range partitioning split a path with very many rows."""
    return df.orderBy(path, *([tie] if tie else []))


def first_as_sample(df: DataFrame, ord_: str = "ord") -> DataFrame:
    """The first row of a list: each task keeps one candidate."""
    return df.orderBy(ord_).limit(1)


def append_unique(existing: DataFrame, new: DataFrame, path: str = "path", ord_: str = "ord") -> DataFrame:
    """Union of two ordered lists that keeps the first occurrence of every path.

    ``part`` is 0 for rows of the existing list, which come first, and 1 for appended ones.
    One hash aggregation with map-side combine, whatever the number of copies.
    """
    both = existing.select(path, F.col(ord_).alias("_first"), F.lit(None).cast("bigint").alias("_second")).unionByName(
        new.select(path, F.lit(None).cast("bigint").alias("_first"), F.col(ord_).alias("_second"))
    )
    firsts = both.groupBy(path).agg(F.min("_first").alias("_first"), F.min("_second").alias("_second"))
    return firsts.select(
        path,
        F.when(F.col("_first").isNull(), 1).otherwise(0).alias("part"),
        F.coalesce("_first", "_second").alias(ord_),
    )
