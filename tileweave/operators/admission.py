"""Admission of model artifacts by license, size and hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.binary import sha256_hex
from ..functions.numeric import as_col
from ..sources.formats import literal_table

# Accepted SPDX identifiers (exact case) and the tolerated excess in bytes.
ALLOWED_LICENSES = ["MIT", "Apache-2.0", "BSD-3-Clause", "BSD-2-Clause", "MPL-2.0", "CC0-1.0"]
MAX_OVER_BYTES = 16 * 1024 * 1024


def license_ok(license_="license") -> Column:
    return F.coalesce(as_col(license_).isin(*ALLOWED_LICENSES), F.lit(False))


def size_ok(actual="actual_bytes", expected="expected_bytes") -> Column:
    return F.coalesce(as_col(actual) <= as_col(expected) + F.lit(MAX_OVER_BYTES), F.lit(False))


def hash_ok(actual="actual_sha256", expected="expected_sha256") -> Column:
    """Hex digests compared without regard to case; a missing digest is never valid."""
    return F.coalesce(F.lower(as_col(actual)) == F.lower(as_col(expected)), F.lit(False))


def split_by_license(artifacts: DataFrame, license_: str = "license") -> tuple[DataFrame, DataFrame]:
    """``(allowed, refused)`` as semi and anti join with the six-row allow-list."""
    allowed = F.broadcast(literal_table(artifacts.sparkSession, license_, [(n,) for n in ALLOWED_LICENSES]))
    return artifacts.join(allowed, license_, "left_semi"), artifacts.join(allowed, license_, "left_anti")


def with_file_hashes(artifacts: DataFrame, files: DataFrame, path: str = "path") -> DataFrame:
    """``actual_sha256`` and ``actual_bytes`` of each artifact's file, null where the file is missing.

    Content is hashed where it is read; only the digest is shuffled.
    """
    digests = files.select(path, sha256_hex("content").alias("actual_sha256"), F.col("length").alias("actual_bytes"))
    return artifacts.join(digests, path, "left")


def admission_report(artifacts: DataFrame) -> DataFrame:
    """``admitted`` or the first gate that refuses: license, then size, then hash."""
    verdict = (
        F.when(~license_ok(), "license").when(~size_ok(), "size").when(~hash_ok(), "hash").otherwise("admitted")
    )
    return artifacts.withColumn("verdict", verdict)
