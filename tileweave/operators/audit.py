"""Per-file checks of an image manifest: admission, properties and outcome decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.encoding import bits_per_channel, color_mode
from ..functions.geometry import aspect_ratio, megapixels
from ..functions.numeric import as_col
from ..functions.validation import admit


def with_admission(manifest: DataFrame) -> DataFrame:
    """``admit_error`` is null for admitted rows. Decide this before anything reads pixels."""
    return manifest.withColumn("admit_error", admit("length", "width", "height"))


def admitted(manifest: DataFrame) -> DataFrame:
    return manifest.filter(admit("length", "width", "height").isNull())


def image_properties(manifest: DataFrame) -> DataFrame:
    """Megapixels, aspect ratio and colour mode; bits per channel where the rows carry a ``mode``."""
    out = manifest.withColumns(
        {
            "megapixels": megapixels("width", "height"),
            "aspect": aspect_ratio("width", "height"),
            "color_mode": color_mode("n_channels"),
        }
    )
    return out.withColumn("bits", bits_per_channel("mode")) if "mode" in manifest.columns else out


def target_or_source(target, source) -> Column:
    return F.coalesce(as_col(target), as_col(source))


# The order in which each operation makes its checks, which decides a row's status.
CHECK_ORDER = {
    "convert": ("skip", "decode"),
    "resize": ("decode", "skip", "params"),
    "rotate": ("decode", "skip"),
    "flip": ("decode", "skip"),
    "crop": ("decode", "params", "skip"),
    "adjust": ("params", "decode", "skip"),
}


def decide_outcome(operation: str, decode_error, params_error, output_exists, policy="skip") -> Column:
    """``struct<status,error_kind,error>`` of one row under one operation.

    ``decode_error`` and ``params_error`` are error texts or null; ``policy`` is a column or one of
    skip, replace, increment.
    """
    policy_col = F.lit(policy) if isinstance(policy, str) and policy in ("skip", "replace", "increment") else as_col(policy)
    d, p = as_col(decode_error), as_col(params_error)
    none = F.lit(None).cast("string")

    def verdict(status: str, kind: Column, error: Column) -> Column:
        return F.struct(F.lit(status).alias("status"), kind.alias("error_kind"), error.alias("error"))

    checks = {
        "skip": ((policy_col == "skip") & as_col(output_exists), verdict("skipped", none, none)),
        "decode": (d.isNotNull(), verdict("failed", F.lit("decode"), d)),
        "params": (p.isNotNull(), verdict("failed", F.lit("invalid_input"), p)),
    }
    order = CHECK_ORDER[operation]
    result = F.when(*checks[order[0]])
    for name in order[1:]:
        result = result.when(*checks[name])
    return result.otherwise(verdict("written", none, none))
