"""File scans over Spark's ``binaryFile`` and ``image`` sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.paths import extension, file_name

# Extensions accepted when a folder is listed.
FOLDER_EXTENSIONS = ["jpg", "jpeg", "png", "webp", "avif", "gif", "tif", "tiff", "bmp", "heic", "heif", "jxl"]


def scan_files(spark: SparkSession, path: str | list[str], recursive: bool = True) -> DataFrame:
    """``path, modificationTime, length, content`` per file.

    Select without ``content`` and no file is opened; filters on ``path``, ``length``
    and ``modificationTime`` reach the listing.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return reader.load(path)


def list_folder(spark: SparkSession, path: str) -> DataFrame:
    """One level of image files by extension, in path order; an unreadable folder gives no rows."""
    schema = "path string, modificationTime timestamp, length bigint"
    try:
        files = scan_files(spark, path, recursive=False).select("path", "modificationTime", "length")
    except Exception as error:  # a missing folder is the only failure at planning time
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)
    return files.filter(F.lower(extension("path")).isin(*FOLDER_EXTENSIONS)).orderBy("path")


def scan_decoded(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Decoded rasters of the types the JVM reads, by content rather than by name.

    ``origin, height, width, nChannels, mode, data`` plus ``status`` and ``error_kind``: a file
    that does not decode stays in the result as ``failed``.
    """
    images = spark.read.format("image").option("recursiveFileLookup", "true").load(path).select("image.*")
    bad = F.col("width") < 0
    return images.withColumn("status", F.when(bad, "failed").otherwise("decoded")).withColumn(
        "error_kind", F.when(bad, "decode")
    )


def with_file_name(df: DataFrame, path: str = "path") -> DataFrame:
    return df.withColumn("name", file_name(path))
