"""Output sinks: a keyed Parquet table and plain files."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.utils import AnalysisException

from ..session import cut_lineage

FILE_OUTCOME = "ord bigint, output string, status string, error_kind string, error string, bytes_out bigint"


def _table(spark, path: str) -> DataFrame | None:
    """The Parquet table at ``path``, or None where there is no such path yet; any other failure is raised."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def write_outputs(df: DataFrame, path: str, policy: str = "skip", partition_by: str = "target", order_by: str | None = None) -> None:
    """Writes rows keyed by ``output`` to a Parquet table partitioned by ``partition_by``.

    ``skip`` leaves outputs that the table already has; ``replace`` rewrites the partitions that get rows
    and those that lose some (a key may move); ``increment`` expects names that were made unique beforehand
    and appends. Rows of one batch that share a key: the first stays under ``skip``, the last under
    ``replace``, by ``order_by`` (default: ``ord`` if there is one). The committer publishes a job's files all
    at once or not at all.
    """
    spark = df.sparkSession
    if policy not in ("skip", "replace", "increment"):
        raise ValueError(f"unknown policy: {policy}")
    existing = _table(spark, path)
    if policy != "increment":
        order = order_by or ("ord" if "ord" in df.columns else None)
        whole = F.struct(*[F.col(c) for c in df.columns])
        key = F.col(order) if order else F.xxhash64(*df.columns)
        chosen = (F.min_by if policy == "skip" else F.max_by)(whole, key)
        df = df.groupBy("output").agg(chosen.alias("_row")).select("_row.*")
    if existing is None or policy == "increment":
        df.write.partitionBy(partition_by).mode("append").parquet(path)
    elif policy == "skip":
        todo = df.join(existing.select("output"), "output", "left_anti")
        todo.write.partitionBy(partition_by).mode("append").parquet(path)
    else:
        df = cut_lineage(df)
        left = existing.join(df.select("output"), "output", "left_semi").select(partition_by)
        touched = cut_lineage(df.select(partition_by).union(left).distinct())
        kept = existing.join(touched, partition_by, "left_semi").join(df.select("output"), "output", "left_anti")
        # Materialised first: the partitions being overwritten are also being read.
        merged = cut_lineage(df.unionByName(kept, allowMissingColumns=True))
        emptied = touched.join(merged.select(partition_by).distinct(), partition_by, "left_anti")
        merged.write.partitionBy(partition_by).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
        _drop_partitions(spark, path, partition_by, [r[0] for r in emptied.collect()])


def _drop_partitions(spark, path: str, column: str, values: list) -> None:
    """Removes partitions whose every row moved elsewhere (dynamic overwrite leaves those alone)."""
    if not values:
        return
    jvm = spark._jvm
    for value in values:
        name = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString(column, None if value is None else str(value))
        folder = jvm.org.apache.hadoop.fs.Path(path, name)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def export_files(df: DataFrame, content: str = "content") -> DataFrame:
    """Writes each row's bytes to its ``output`` location; one outcome row per file.

    Parent folders are created. Bytes go to a temporary sibling that is renamed at the end, so a
    failed or repeated task never leaves half a file. Whether to write at all was decided before,
    by the naming operators. The action on the result does the writing.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            rows = []
            for ord_, output, data in zip(batch["ord"], batch["output"], batch["content"]):
                try:
                    target = output if "://" in output else output.removeprefix("file:")
                    store, place = fs.FileSystem.from_uri(target if "://" in target else os.path.abspath(target))
                    folder = place.rpartition("/")[0]
                    if folder:
                        store.create_dir(folder, recursive=True)
                    part = f"{place}.{uuid.uuid4().hex}.part"
                    try:
                        with store.open_output_stream(part) as out:
                            out.write(data)
                        store.move(part, place)
                    except Exception:
                        if store.get_file_info(part).type != fs.FileType.NotFound:
                            store.delete_file(part)
                        raise
                    rows.append((ord_, output, "written", None, None, len(data)))
                except Exception as error:
                    rows.append((ord_, output, "failed", "io", str(error), None))
            out = pd.DataFrame(rows, columns=["ord", "output", "status", "error_kind", "error", "bytes_out"])
            yield out.astype({"bytes_out": "Int64"})

    return df.select("ord", "output", F.col(content).alias("content")).mapInPandas(write, FILE_OUTCOME)
