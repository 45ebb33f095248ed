"""Parameter checks. Each returns an error code, null when the parameters are fine."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .geometry import UPSCALE_FACTORS
from .numeric import as_col

# Input caps and parameter ranges.
MAX_INPUT_BYTES = 1024 * 1024 * 1024
MAX_PIXELS = 256 * 1024 * 1024
U32_MAX = 4294967295


def admit(length, width, height) -> Column:
    """``too_many_bytes`` or ``too_many_pixels``, in that order; exactly at a cap still passes.

    A file of unknown size may be any bomb: without a length it is an ``unreadable_file``, without sides an ``unreadable_header``.
    """
    pixels = as_col(width).cast("bigint") * as_col(height).cast("bigint")
    return (
        F.when(as_col(length) > MAX_INPUT_BYTES, "too_many_bytes").when(as_col(length).isNull(), "unreadable_file")
        .when(pixels > MAX_PIXELS, "too_many_pixels").when(pixels.isNull(), "unreadable_header")
    )


def _outside(value: Column, low: float, high: float) -> Column:
    # NaN sorts above every number in Spark, so `between` alone rejects NaN and both infinities.
    return ~value.between(F.lit(low), F.lit(high))


def validate_adjust(brightness, contrast, saturation, gamma) -> Column:
    c, s, g = (as_col(v).cast("double") for v in (contrast, saturation, gamma))
    return (
        F.when(~as_col(brightness).between(-100, 100), "brightness_out_of_range")
        .when(_outside(c, -100.0, 100.0), "contrast_out_of_range")
        .when(_outside(s, -100.0, 100.0), "saturation_out_of_range")
        .when(_outside(g, 0.1, 10.0), "gamma_out_of_range")
    )


def validate_crop(x, y, width, height, image_width, image_height) -> Column:
    x, y, w, h = (as_col(v).cast("bigint") for v in (x, y, width, height))
    return (
        F.when((w == 0) | (h == 0), "zero_size")
        .when(x + w > U32_MAX, "overflow_x")
        .when(y + h > U32_MAX, "overflow_y")
        .when((x + w > as_col(image_width)) | (y + h > as_col(image_height)), "outside_image")
    )


def _zero_source(width, height) -> Column:
    return (as_col(width) == 0) | (as_col(height) == 0)


def validate_resize_percent(width, height, percent) -> Column:
    p = as_col(percent).cast("double")
    return F.when(_zero_source(width, height), "zero_source").when(
        F.isnan(p) | (p <= 0.0) | (p > 1000.0), "percent_out_of_range"
    )


def validate_resize_box(width, height, box_width, box_height) -> Column:
    """For exact sizes and fit boxes alike."""
    return F.when(_zero_source(width, height), "zero_source").when(
        (as_col(box_width) == 0) | (as_col(box_height) == 0), "zero_target"
    )


def validate_resize_max_edge(width, height) -> Column:
    return F.when(_zero_source(width, height), "zero_source")


def validate_quality(quality) -> Column:
    """Null quality means the encoder default and is fine."""
    return F.when(~as_col(quality).between(1, 100), "quality_out_of_range")


def validate_upscale(factor) -> Column:
    return F.when(~as_col(factor).isin(*UPSCALE_FACTORS), "factor_out_of_range")
