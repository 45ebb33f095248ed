"""Histograms and batch reports. Everything here combines on the map side before it shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numeric import as_col, int_div
from ..functions.text import files_label

CHANNELS = ("R", "G", "B")
BINS = 256


def histogram(px: DataFrame, image_id: str = "image_id") -> DataFrame:
    """Pixels per image, channel and value; alpha plays no part."""
    cells = F.array(*[F.struct(F.lit(n).alias("channel"), F.col(n.lower()).alias("bin")) for n in CHANNELS])
    return px.select(image_id, F.inline(cells)).groupBy(image_id, "channel", "bin").agg(F.count("*").alias("cnt"))


def histogram_dense(px: DataFrame, image_id: str = "image_id") -> DataFrame:
    """All 768 bins of every image, absent values counting 0. At most 256 entries are collected per group."""
    found = (
        histogram(px, image_id)
        .groupBy(image_id)
        .pivot("channel", list(CHANNELS))
        .agg(F.map_from_entries(F.collect_list(F.struct("bin", "cnt"))))
    )
    per_channel = F.array(*[F.struct(F.lit(n).alias("channel"), F.col(n).alias("_counts")) for n in CHANNELS])
    rows = found.select(image_id, F.inline(per_channel)).withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(BINS - 1))))
    cnt = F.coalesce(F.try_element_at("_counts", F.col("bin")), F.lit(0))
    return rows.select(image_id, "channel", "bin", cnt.cast("bigint").alias("cnt"))


def histogram_rebin(hist: DataFrame, cols: int, image_id: str = "image_id") -> DataFrame:
    """Histogram drawn ``cols`` wide: summed per column, with the height relative to the channel's tallest."""
    binned = hist.groupBy(image_id, "channel", int_div(F.col("bin") * cols, BINS).alias("col")).agg(F.sum("cnt").alias("cnt"))
    tallest = F.greatest(F.max("cnt").over(Window.partitionBy(image_id, "channel")), F.lit(1))
    return binned.withColumn("height", F.col("cnt").cast("double") / tallest)


def batch_summary(outcomes: DataFrame, *keys: str) -> DataFrame:
    """Counts by status; input bytes over every row, output bytes over written rows only."""
    written = F.col("status") == "written"
    return outcomes.groupBy(*keys).agg(
        F.count_if(written).alias("ok"),
        F.count_if(F.col("status") == "skipped").alias("skip"),
        F.count_if(F.col("status") == "failed").alias("fail"),
        F.coalesce(F.sum("bytes_in"), F.lit(0)).alias("bytes_in"),
        F.coalesce(F.sum(F.when(written, F.col("bytes_out"))), F.lit(0)).alias("bytes_out"),
    )


def batch_averages(summary: DataFrame) -> DataFrame:
    """Bytes per written file, null unless files were written and both sums are positive.

    The input sum covers skipped and failed files as well, as in the report it belongs to.
    """
    fair = (F.col("ok") > 0) & (F.col("bytes_in") > 0) & (F.col("bytes_out") > 0)
    ok = F.greatest(F.col("ok"), F.lit(1))
    return summary.withColumns(
        {f"avg_{side}": F.when(fair, int_div(F.col(f"bytes_{side}"), ok)) for side in ("in", "out")}
    )


def first_error(outcomes: DataFrame, *keys: str) -> DataFrame:
    """The error of the failed row that comes first in list order. Only failed rows are shuffled."""
    failed = outcomes.filter(F.col("status") == "failed")
    return failed.groupBy(*keys).agg(F.min("ord").alias("ord"), F.min_by("error", "ord").alias("first_error"))


def exit_code(outcomes: DataFrame, *keys: str) -> DataFrame:
    """2 if any row failed, else 0."""
    code = F.max(F.when(F.col("status") == "failed", 2).otherwise(0))
    return outcomes.groupBy(*keys).agg(F.coalesce(code, F.lit(0)).alias("exit_code"))


def selection_summary(files: DataFrame, *keys: str) -> DataFrame:
    return files.groupBy(*keys).agg(
        F.count("*").alias("n_files"), F.coalesce(F.sum("length"), F.lit(0)).alias("total_bytes")
    )


def selection_label(files: DataFrame, name, *keys: str) -> DataFrame:
    """``name +k outros`` for each list, the name being that of its first file."""
    named = files.select(*keys, "ord", as_col(name).alias("_name"))
    firsts = named.groupBy(*keys).agg(F.min_by("_name", "ord").alias("_name"), F.count("*").alias("_n"))
    return firsts.select(*keys, files_label("_name", "_n").alias("label"))


def groups_in_order(df: DataFrame, group: str | Column, ord_: str = "ord") -> DataFrame:
    """Distinct groups, ordered by where each is first seen; rows without a group are ignored."""
    g = df.select(as_col(group).alias("group"), F.col(ord_).alias("_ord")).filter(F.col("group").isNotNull())
    return g.groupBy("group").agg(F.min("_ord").alias("first_ord")).orderBy("first_ord")
