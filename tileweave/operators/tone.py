"""Tone operators: expressions over the r, g, b, a columns of a pixel table.

All arithmetic is in double precision. Parameters are numbers or columns; a number that leaves an
axis neutral removes that axis from the plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numeric import as_col, clamp, round_half_up

RGB = ("r", "g", "b")
# Rec. 601 luma weights; ImageNet channel means and deviations.
LUMA = (0.299, 0.587, 0.114)
CHANNEL_MEAN = (0.485, 0.456, 0.406)
CHANNEL_STD = (0.229, 0.224, 0.225)
# How far from neutral an axis must be to be applied, and to count as an identity.
CONTRAST_EPSILON = SATURATION_EPSILON = 0.01
GAMMA_EPSILON = 0.001


def _unless_neutral(px: DataFrame, parameter, neutral: float, epsilon: float, changed: dict[str, Column]) -> DataFrame:
    if not isinstance(parameter, (str, Column)):
        return px.withColumns(changed) if abs(parameter - neutral) > epsilon else px
    active = F.abs(as_col(parameter) - F.lit(neutral)) > epsilon
    return px.withColumns({c: F.when(active, v).otherwise(F.col(c)) for c, v in changed.items()})


def brightness(px: DataFrame, amount) -> DataFrame:
    """Adds ``amount`` to every colour sample, within 0–255."""
    return _unless_neutral(px, amount, 0, 0, {c: clamp(F.col(c) + as_col(amount), 0, 255).cast("int") for c in RGB})


def contrast(px: DataFrame, amount) -> DataFrame:
    """Scales the distance from mid-gray by ((100 + amount)/100)², then truncates."""
    base = (F.lit(100.0) + as_col(amount).cast("double")) / 100.0
    factor = base * base

    def stretched(c: str) -> Column:
        return clamp(((F.col(c) / F.lit(255.0) - 0.5) * factor + 0.5) * 255.0, 0.0, 255.0).cast("int")

    return _unless_neutral(px, amount, 0.0, CONTRAST_EPSILON, {c: stretched(c) for c in RGB})


def saturation(px: DataFrame, amount) -> DataFrame:
    """Moves every sample away from (or towards) the pixel's luma."""
    factor = F.lit(1.0) + as_col(amount).cast("double") / 100.0
    r, g, b = (F.col(c) for c in RGB)
    luma = F.lit(LUMA[0]) * r + F.lit(LUMA[1]) * g + F.lit(LUMA[2]) * b

    def blended(c: str) -> Column:
        return round_half_up(clamp(luma + (F.col(c) - luma) * factor, 0.0, 255.0)).cast("int")

    return _unless_neutral(px, amount, 0.0, SATURATION_EPSILON, {c: blended(c) for c in RGB})


def gamma_lut(value: float) -> list[int]:
    """The 256 results of ``round((i/255)^value · 255)``."""
    levels = [min((i / 255.0) ** value, 1.0) * 255.0 if i else 0.0 for i in range(256)]
    return [int(v) + (v - int(v) >= 0.5) for v in levels]


def gamma(px: DataFrame, value) -> DataFrame:
    """Power curve on every colour sample; a constant becomes a lookup in a 256-entry literal."""
    if isinstance(value, (str, Column)):
        g = as_col(value).cast("double")
        curve = {c: round_half_up(clamp(F.pow(F.col(c) / F.lit(255.0), g), 0.0, 1.0) * 255.0).cast("int") for c in RGB}
    else:
        lut = F.array(*[F.lit(v) for v in gamma_lut(value)])
        curve = {c: F.element_at(lut, F.col(c) + 1) for c in RGB}
    return _unless_neutral(px, value, 1.0, GAMMA_EPSILON, curve)


def lut_join(px: DataFrame, lut: DataFrame, channel: str = "r") -> DataFrame:
    """Replaces one channel through a table ``v, mapped`` of at most 256 rows (8-bit samples).

    A table with a repeated, missing or out-of-range ``v`` is refused when the plan runs.
    """
    entries = lut.groupBy(F.col("v").alias("_v")).agg(F.max("mapped").alias("_mapped"), F.count("*").alias("_n"))
    sound = F.coalesce(F.col("_v").between(0, 255), F.lit(False)) & (F.col("_n") == 1)
    refused = F.raise_error(F.concat(F.lit("bad lookup entry: "), F.coalesce(F.col("_v").cast("string"), F.lit("null"))))
    bounded = entries.select(F.when(sound, F.col("_v")).otherwise(refused.cast("int")).alias("_v"), "_mapped")
    joined = px.join(F.broadcast(bounded), F.col(channel) == F.col("_v"), "left")
    return joined.withColumn(channel, F.coalesce("_mapped", F.col(channel))).drop("_v", "_mapped")


def is_identity(brightness_=0, contrast_=0.0, saturation_=0.0, gamma_=1.0) -> Column:
    return (
        (as_col(brightness_) == 0)
        & (F.abs(as_col(contrast_)) < CONTRAST_EPSILON)
        & (F.abs(as_col(saturation_)) < SATURATION_EPSILON)
        & (F.abs(as_col(gamma_) - 1.0) < GAMMA_EPSILON)
    )


def adjust_tag(brightness_, contrast_, saturation_, gamma_) -> Column:
    """Name tag of an adjustment, neutral axes left out: ``b10_c-20``, ``g1.80``; ``adj`` if all are."""
    b, c, s, g = as_col(brightness_), *(as_col(v).cast("double") for v in (contrast_, saturation_, gamma_))
    parts = [
        F.when(b != 0, F.concat(F.lit("b"), b.cast("string"))),
        F.when(F.abs(c) > CONTRAST_EPSILON, F.concat(F.lit("c"), F.round(c).cast("int").cast("string"))),
        F.when(F.abs(s) > SATURATION_EPSILON, F.concat(F.lit("s"), F.round(s).cast("int").cast("string"))),
        F.when(
            F.abs(g - 1.0) > GAMMA_EPSILON,
            F.concat(F.lit("g"), F.call_function("format_number", g, F.lit("0.00"))),
        ),
    ]
    return F.coalesce(F.nullif(F.concat_ws("_", *parts), F.lit("")), F.lit("adj"))


def adjust(px: DataFrame, brightness_=0, contrast_=0.0, saturation_=0.0, gamma_=1.0) -> DataFrame:
    """Brightness, contrast, saturation, gamma, in that order; one narrow stage."""
    return gamma(saturation(contrast(brightness(px, brightness_), contrast_), saturation_), gamma_)


def normalize_chw(px: DataFrame, image_id: str = "image_id") -> DataFrame:
    """Model input as rows ``image_id, c, y, x, v`` with v = (sample/255 - mean) / deviation."""
    cells = [
        F.struct(F.lit(i).alias("c"), ((F.col(ch) / F.lit(255.0) - CHANNEL_MEAN[i]) / CHANNEL_STD[i]).alias("v"))
        for i, ch in enumerate(RGB)
    ]
    return px.select(image_id, "y", "x", F.inline(F.array(*cells)))


def mask_to_alpha(value) -> Column:
    """Clamps to [0, 1] and truncates to 0–255."""
    return (clamp(as_col(value).cast("double"), 0.0, 1.0) * 255.0).cast("int")


def apply_mask(px: DataFrame, mask: DataFrame, image_id: str = "image_id", value: str = "m") -> DataFrame:
    """Alpha from the mask's value at the same pixel; the original alpha is discarded."""
    m = mask.select(image_id, "x", "y", mask_to_alpha(value).alias("a"))
    # Size estimates do not see the pixels that an image explodes to, so neither side may be broadcast on their word.
    return px.drop("a").join(m.hint("merge"), [image_id, "x", "y"])
