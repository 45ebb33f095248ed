"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", app: str = "tileweave", **conf: str) -> SparkSession:
    """A session for one machine. On a cluster, pass the cluster's own session instead."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Makes this package importable in Python workers that do not have it installed (once per context)."""
    context = spark.sparkContext
    if getattr(context, "_tileweave_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="spark-")) / "tileweave.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._tileweave_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``, or a scratch one on a single machine.

    On a cluster the setting must be there: a folder of the driver's own would be invisible to executors.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if configured:
        if current is None:
            context.setCheckpointDir(configured)
        return configured
    if current is None:
        master = context.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
        current = context.getCheckpointDir()
    return current


@contextmanager
def small_batches(spark: SparkSession, rows: int = 256, size: int = 32 << 20):
    """Bounds what a Python worker is handed at once, by rows and by bytes, in jobs that run inside; a smaller setting stays.

    For functions that make much of a row (a decoded file, a nested list as Python objects): with the usual 10,000 rows a
    batch, a worker's memory would grow with its partition up to there.
    """
    limits = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {key: spark.conf.get(key, None) for key in limits}
    for key, limit in limits.items():
        now = before[key] if before[key] and before[key].isdigit() and int(before[key]) > 0 else limit
        spark.conf.set(key, str(min(limit, int(now))))
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value is not None else spark.conf.unset(key)


def cut_lineage(df):
    """Reliable checkpoint: the result is written to the shared folder and survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def spread(df, tasks: int | None = None):
    """Deals rows out evenly before expensive per-row work.

    An explicit number keeps adaptive execution from merging the partitions again: to it, a million
    narrow rows look small, whatever the files or pixels behind them weigh.
    """
    return df.repartition(tasks or 4 * df.sparkSession.sparkContext.defaultParallelism)
