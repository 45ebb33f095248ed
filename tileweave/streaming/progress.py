"""Running batch totals over a stream of outcome rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.stats import batch_summary
from ..session import cut_lineage, shared_dir

#: Micro-batches after which their folders are folded into one.
COMPACT = 100


def stream_summary(outcomes: DataFrame, watermark: str | None = "1 day") -> DataFrame:
    """ok, skip, fail, bytes and done per job; a repeated ``(job_id, ord)`` counts once.

    ``watermark``: how late a row or its repetition may come (by ``finished_at``); ids are remembered that
    long, later rows no longer count. None remembers every id, which is right for a finite backlog in any order.
    """
    if watermark:
        unique = outcomes.withWatermark("finished_at", watermark).dropDuplicatesWithinWatermark(["job_id", "ord"])
    else:
        unique = outcomes.dropDuplicates(["job_id", "ord"])
    summary = batch_summary(unique, "job_id")
    return summary.withColumn("done", F.col("ok") + F.col("skip") + F.col("fail"))


def write_summary(summary: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Writes each micro-batch's changed totals under ``path/batch=N``; a repeated batch overwrites itself.

    Every ``COMPACT`` batches the current totals are written as one batch and the older folders go.
    """

    def publish(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/batch={batch}")
        if batch and batch % COMPACT == 0:
            spark = changed.sparkSession
            values = [c for c in changed.columns if c != "job_id"]
            cut_lineage(latest_summary(spark, path)).select("job_id", *values).write.mode("overwrite").parquet(f"{path}/batch={batch}")
            root = spark._jvm.org.apache.hadoop.fs.Path(path)
            store = root.getFileSystem(spark._jsc.hadoopConfiguration())
            for entry in store.listStatus(root):
                name = entry.getPath().getName()
                if name.startswith("batch=") and int(name[6:]) < batch:
                    store.delete(entry.getPath(), True)

    writer = summary.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    return writer.foreachBatch(publish).trigger(**trigger).start()


def latest_summary(spark: SparkSession, path: str) -> DataFrame:
    """Current totals: for every job, the row of its last batch."""
    rows = spark.read.parquet(path)
    values = [c for c in rows.columns if c not in ("job_id", "batch")]
    return rows.groupBy("job_id").agg(*[F.max_by(c, "batch").alias(c) for c in values])


def drain_summary(outcomes: DataFrame, watermark: str | None = None) -> DataFrame:
    """Runs a stream over everything available now and returns the final totals."""
    spark = outcomes.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    query = write_summary(stream_summary(outcomes, watermark), f"{base}/out", f"{base}/state", availableNow=True)
    query.awaitTermination()
    return latest_summary(spark, f"{base}/out")
