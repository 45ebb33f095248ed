"""Encoder settings as plan columns. Nothing is encoded here."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .numeric import as_col

# Encoder defaults and the settings of the web preset.
JPEG_QUALITY = 75
AVIF_QUALITY = 80
AVIF_SPEED = 8
AVIF_SPEED_OPTIMIZED = 4
WEB_PRESET = {"quality": 85, "progressive": True, "optimize": True, "strip_metadata": True, "avif_speed": 8}


def web_preset() -> Column:
    return F.struct(*[F.lit(v).alias(k) for k, v in WEB_PRESET.items()])


def encode_settings(target, quality, optimize, avif_speed=AVIF_SPEED) -> Column:
    """Settings that reach the encoder: only JPEG, AVIF and optimised PNG have any."""
    t, q = as_col(target), as_col(quality).cast("int")
    opt = F.coalesce(as_col(optimize), F.lit(False))
    speed = as_col(avif_speed).cast("int")
    return F.struct(
        F.when(t == "jpeg", F.coalesce(q, F.lit(JPEG_QUALITY)))
        .when(t == "avif", F.coalesce(q, F.lit(AVIF_QUALITY)))
        .alias("quality"),
        F.when(t == "avif", F.when(opt, F.least(speed, F.lit(AVIF_SPEED_OPTIMIZED))).otherwise(speed)).alias("speed"),
        F.when((t == "png") & opt, "best").alias("compression"),
        F.when((t == "png") & opt, "adaptive").alias("filter"),
    )


def target_layout(target, quality, optimize) -> Column:
    """Sample layout the encoder receives; ``source`` means unchanged."""
    t = as_col(target)
    return (
        F.when(t == "openexr", "rgba_f32")
        .when(t == "hdr", "rgb_f32")
        .when((t == "jpeg") & as_col(quality).isNotNull(), "rgb8")
        .when((t == "avif") | ((t == "png") & F.coalesce(as_col(optimize), F.lit(False))), "rgba8")
        .otherwise("source")
    )


def to_layout(value, layout) -> Column:
    """An 8-bit sample in the given layout: float layouts divide by 255."""
    v = as_col(value).cast("double")
    return F.when(as_col(layout).endswith("f32"), v / 255.0).otherwise(v)


def alpha_loss(has_alpha, target) -> Column:
    return as_col(has_alpha) & (as_col(target) == "jpeg")


def has_alpha(n_channels) -> Column:
    return as_col(n_channels).isin(2, 4)


def color_mode(n_channels) -> Column:
    n = as_col(n_channels)
    return F.when(n == 1, "gray").when(n == 2, "gray+alpha").when(n == 3, "RGB").when(n == 4, "RGBA")


def bits_per_channel(mode) -> Column:
    """Text for an OpenCV type code (the ``mode`` field of an image row), whose low 3 bits are the depth."""
    depth = as_col(mode).bitwiseAND(F.lit(7))
    return F.when(depth == 0, "8").when(depth == 2, "16").when(depth == 5, "32 (float)")
