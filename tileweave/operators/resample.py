"""Resampling. Source pixels announce themselves to the target pixels they contribute to.

That turns resampling around: no weight table and no join, only a generated range of targets
per source pixel and an aggregation. Nearest neighbour needs no shuffle at all.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numeric import as_col, ceil_div

# Kernel radius; (B, C) of the cubic family.
RADIUS = {"bilinear": 1.0, "catmullrom": 2.0, "mitchell": 2.0, "lanczos3": 3.0}
CUBIC = {"catmullrom": (0.0, 0.5), "mitchell": (1.0 / 3.0, 1.0 / 3.0)}
SAMPLES = ("r", "g", "b", "a")


def _nearest_targets(at: Column, source: Column, target: Column) -> Column:
    """All i with floor((i + ½)·source/target) = at, by integer arithmetic; null if there are none."""
    low = ceil_div(2 * target * at - source, 2 * source)
    high = ceil_div(2 * target * (at + 1) - source, 2 * source) - 1
    return F.when(low <= high, F.sequence(low, high))


def resample_nearest(px: DataFrame, width, height, image_id: str = "image_id") -> DataFrame:
    """Nearest neighbour: every source pixel is copied to the targets that pick it. Narrow."""
    sw, sh = F.col("width").cast("bigint"), F.col("height").cast("bigint")
    tw, th = as_col(width).cast("bigint"), as_col(height).cast("bigint")
    spread = px.withColumns({"_tw": tw.cast("int"), "_th": th.cast("int")}).withColumn(
        "_y", F.explode(_nearest_targets(F.col("y").cast("bigint"), sh, F.col("_th").cast("bigint")))
    )
    spread = spread.withColumn(
        "_x", F.explode(_nearest_targets(F.col("x").cast("bigint"), sw, F.col("_tw").cast("bigint")))
    )
    return spread.select(
        image_id, F.col("_x").cast("int").alias("x"), F.col("_y").cast("int").alias("y"), *SAMPLES,
        F.col("_tw").alias("width"), F.col("_th").alias("height"),
    )


def kernel(name: str, distance) -> Column:
    """Unnormalised weight at a non-negative distance in kernel units."""
    d = as_col(distance)
    if name == "bilinear":
        return F.when(d < 1.0, 1.0 - d).otherwise(0.0)
    if name == "lanczos3":
        t = d * math.pi
        lobe = F.sin(t) * F.sin(t / 3.0) * 3.0 / (t * t)
        return F.when(d == 0.0, 1.0).when(d < 3.0, lobe).otherwise(0.0)
    b, c = CUBIC[name]
    near = (((12 - 9 * b - 6 * c) * d + (-18 + 12 * b + 6 * c)) * d * d + (6 - 2 * b)) / 6.0
    far = ((((-b - 6 * c) * d + (6 * b + 30 * c)) * d + (-12 * b - 48 * c)) * d + (8 * b + 24 * c)) / 6.0
    return F.when(d < 1.0, near).when(d < 2.0, far).otherwise(0.0)


def _pass(px: DataFrame, keys: list[str], axis: str, source: str, target: str, name: str) -> DataFrame:
    """One axis: weighted mean over the sources in reach. An axis that keeps its size is left alone."""
    at, n, m = F.col(axis), F.col(source).cast("double"), F.col(target).cast("double")
    step = n / m
    reach = F.lit(RADIUS[name]) * F.greatest(step, F.lit(1.0))
    same = F.col(source) == F.col(target)
    low = F.greatest(F.floor((at + 0.5 - reach) / step - 0.5), F.lit(0).cast("bigint"))
    high = F.least(F.ceil((at + 0.5 + reach) / step - 0.5), F.col(target).cast("bigint") - 1)
    targets = F.sequence(F.when(same, at.cast("bigint")).otherwise(low), F.when(same, at.cast("bigint")).otherwise(high))
    distance = (at + 0.5 - (F.col("_t") + 0.5) * step) / F.greatest(step, F.lit(1.0))
    # The distance is a column of its own: the kernel refers to it many times.
    spread = (
        px.withColumn("_t", F.explode(targets))
        .withColumn("_d", F.abs(distance))
        .withColumn("_w", F.when(same, 1.0).otherwise(kernel(name, "_d")))
    )
    kept = [k for k in keys if k != axis]
    extents = [c for c in ("width", "height", "_tw", "_th") if c in px.columns]
    sums = spread.groupBy(*kept, F.col("_t").alias(axis)).agg(
        *[F.sum(F.col("_w") * F.col(c)).alias(c) for c in SAMPLES],
        F.sum("_w").alias("_w"),
        *[F.min(c).alias(c) for c in extents],
    )
    return sums.withColumns({c: F.col(c) / F.col("_w") for c in SAMPLES}).drop("_w")


def resample(
    px: DataFrame, width, height, filter_: str = "lanczos3", image_id: str = "image_id",
    premultiply: bool = False, rows_first: bool = False, tasks: int | None = None,
) -> DataFrame:
    """Separable convolution to ``width`` × ``height`` (numbers, or columns constant per image).

    Weights come from the kernel widened by the shrink factor and are normalised over the taps
    inside the image. ``premultiply`` weights colours by alpha. ``rows_first`` does the vertical
    pass first, which is cheaper when the height shrinks more. An axis that keeps its size is not
    filtered, so images that already have the target size come out unchanged.

    Two shuffles, each of one row per intermediate pixel: the first pass combines on the map side,
    and its result is partitioned so that the second pass aggregates in place, with a single huge
    image still spread over all its columns (or rows). With a number of ``tasks``, lines are dealt over so many
    before the first pass, so that what a task holds depends on that number alone.
    """
    if filter_ == "nearest":
        return resample_nearest(px, width, height, image_id)
    work = px.select(
        image_id, "x", "y", *SAMPLES, "width", "height",
        as_col(width).cast("int").alias("_tw"), as_col(height).cast("int").alias("_th"),
    )
    same = (F.col("width") == F.col("_tw")) & (F.col("height") == F.col("_th"))
    if premultiply:
        work = work.withColumns(
            {c: F.when(same, F.col(c)).otherwise(F.col(c) * F.col("a") / F.lit(255.0)) for c in ("r", "g", "b")}
        )
    keys = [image_id, "y", "x"]
    passes = [("x", "width", "_tw"), ("y", "height", "_th")]
    if rows_first:
        passes.reverse()
    (axis1, from1, to1), (axis2, from2, to2) = passes
    dealt = [tasks] if tasks else []
    first = _pass(work.repartition(tasks, image_id, axis2) if tasks else work, keys, axis1, from1, to1, filter_)
    second = _pass(first.repartition(*dealt, image_id, axis1), keys, axis2, from2, to2, filter_)
    if premultiply:
        unweighted = F.when(F.round("a", 6) > 0, F.lit(255.0) / F.col("a")).otherwise(0.0)
        second = second.withColumns({c: F.col(c) * F.when(same, 1.0).otherwise(unweighted) for c in ("r", "g", "b")})
    # Sums of doubles depend on their order in the last bits; six decimals settle ties.
    return second.select(
        image_id, F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"),
        *[
            F.least(F.greatest(F.floor(F.round(c, 6) + 0.5), F.lit(0)), F.lit(255)).cast("int").alias(c)
            for c in SAMPLES
        ],
        F.col("_tw").alias("width"), F.col("_th").alias("height"),
    )
