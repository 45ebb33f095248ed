"""Digests of files of any size: read in chunks inside tasks, so no file has to fit in a row or in memory."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .ranges import open_location

#: Bytes that are read at a time; bytes of a part of a file that one task reads for ``tree_digests``.
CHUNK, PART = 1 << 20, 64 << 20


def _fold(path: str, start: int = 0, length: int | None = None) -> tuple[str, int]:
    """SHA-256 of a range of a file, and its size."""
    store, name = open_location(path)
    digest, size = hashlib.sha256(), 0
    with store.open_input_file(name) as file:
        end = file.size() if length is None else min(file.size(), start + length)
        while start + size < end:
            chunk = file.read_at(min(CHUNK, end - start - size), start + size)
            if not chunk:
                raise OSError("file ends early")
            digest.update(chunk)
            size += len(chunk)
    return digest.hexdigest(), size


def with_sha256(files: DataFrame, path: str = "path") -> DataFrame:
    """Adds ``sha256``, ``n_hashed`` and ``hash_error`` to a table of paths: the whole file's digest, as published ones are.

    A digest goes through a file in order, so one task reads a file; memory is bounded by ``CHUNK``. Spread the paths first.
    """

    @F.pandas_udf("sha256 string, n_hashed bigint, hash_error string")
    def fold(paths: pd.Series) -> pd.DataFrame:
        rows = []
        for p in paths:
            try:
                rows.append((*_fold(p), None) if p is not None else (None, None, None))
            except OSError as error:
                rows.append((None, None, f"io: {error}"))
        return pd.DataFrame(rows, columns=["sha256", "n_hashed", "hash_error"], dtype=object).astype({"n_hashed": "Int64"})

    return files.withColumn("_d", fold(path)).select(*files.columns, "_d.*")


def tree_digests(files: DataFrame, path: str = "path", length: str = "length", part: int = PART) -> DataFrame:
    """``path, tree_sha256, n_parts``: the SHA-256 over the digests of a file's parts in order.

    Parts of one file are read by different tasks and meet as 32 bytes each. For collections whose digests are one's own:
    a published SHA-256 of a whole file can't be put together from parts. A file with a part that can't be read has null.
    """

    @F.pandas_udf("string")
    def fold(paths: pd.Series, starts: pd.Series, sizes: pd.Series) -> pd.Series:
        out = []
        for p, start, size in zip(paths, starts, sizes):
            try:
                found, n = _fold(p, start, size)
                out.append(found if n == size else None)
            except OSError:
                out.append(None)
        return pd.Series(out, dtype=object)

    parts = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.floor((F.col(length) - 1) / part), F.lit(0)))
    rows = files.select(path, F.col(length).alias("_length"), F.explode(parts).alias("_part"))
    rows = rows.repartition(path, "_part").withColumns({"_start": F.col("_part") * part}).withColumn("_size", F.least(F.col("_length") - F.col("_start"), F.lit(part)))
    hashed = rows.withColumn("_h", fold(path, "_start", "_size"))
    # 40 bytes a part: a terabyte in parts of 64 MB is 600 KB.
    joined = hashed.groupBy(path).agg(F.sort_array(F.collect_list(F.struct("_part", "_h"))).alias("_p"))
    broken = F.exists("_p", lambda p: p["_h"].isNull())
    every = F.unhex(F.array_join(F.transform("_p", lambda p: p["_h"]), ""))
    return joined.select(path, F.when(~broken, F.sha2(every, 256)).alias("tree_sha256"), F.size("_p").alias("n_parts"))
