"""Facts derived from tag rows ``(path, ifd, tag, value, seq)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numeric import as_col

# Tags that reveal a location, and tags that identify a camera.
GPS = ("GPSLatitude", "GPSLongitude")
CAMERA = ("Make", "Model", "Software")


def tag_flags(tags: DataFrame, path: str = "path") -> DataFrame:
    """Per file: location and camera flags, orientation and tag count.

    Flags and orientation come from the primary directory; of several orientation entries the last
    one counts. One hash aggregation with map-side combine.
    """
    primary = F.col("ifd") == "primary"
    orientation = F.when(primary & (F.col("tag") == "Orientation"), F.col("value").try_cast("int"))
    rows = tags.withColumn("_o", orientation)
    return rows.groupBy(path).agg(
        F.bool_or(primary & F.col("tag").isin(*GPS)).alias("has_gps"),
        F.bool_or(primary & F.col("tag").isin(*CAMERA)).alias("has_camera"),
        F.max_by("_o", F.when(F.col("_o").isNotNull(), F.col("seq"))).alias("orientation"),
        F.count("tag").alias("n_tags"),
    )


def with_tag_flags(files: DataFrame, tags: DataFrame, path: str = "path") -> DataFrame:
    """Flags next to every file; files without tags, or whose tags could not be read, count as clean."""
    joined = files.join(tag_flags(tags, path), path, "left")
    return joined.withColumns(
        {
            "has_gps": F.coalesce("has_gps", F.lit(False)),
            "has_camera": F.coalesce("has_camera", F.lit(False)),
            "n_tags": F.coalesce("n_tags", F.lit(0)),
        }
    )


def privacy_label(has_gps="has_gps", has_camera="has_camera") -> Column:
    """A location outranks a camera; null when there is nothing to warn about."""
    return F.when(as_col(has_gps), "gps").when(as_col(has_camera), "camera")
