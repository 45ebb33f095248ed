"""User functions over whole files: the two places where Python sees an image.

Both run inside tasks over Arrow batches. One batch of binaries has to fit in a Python worker:
``spark.sql.execution.arrow.maxBytesPerBatch`` bounds it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

OUTCOME = (
    "ord bigint, input string, output string, status string, error_kind string, error string, "
    "bytes_in bigint, bytes_out bigint"
)
_COLUMNS = [c.split()[0] for c in OUTCOME.split(", ")]


def read_file(path: str) -> bytes:
    """A file's bytes from any store Arrow knows, for use inside tasks."""
    from pyarrow import fs

    store, place = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    with store.open_input_stream(place) as stream:
        return stream.read()


def map_images(files: DataFrame, fn: Callable[[str, bytes, str], int | None]) -> DataFrame:
    """Runs ``fn(path, content, output)`` per file and reports one outcome row each.

    ``files`` has ``ord, path, output`` and maybe ``content``; without it the task reads the file
    itself, so that only names are ever shuffled. ``fn`` returns the bytes it wrote, or None for a
    skipped file. An exception fails that row only. Do the naming, skipping and admission joins
    first: the optimizer cannot move a filter below this operator.
    """
    inline = "content" in files.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            contents = batch["content"] if inline else [None] * len(batch)
            for ord_, path, output, content in zip(batch["ord"], batch["path"], batch["output"], contents):
                size = len(content) if content is not None else None
                try:
                    if not inline:
                        content = read_file(path)
                        size = len(content)
                    written = fn(path, content, output)
                    status = "skipped" if written is None else "written"
                    rows.append((ord_, path, output, status, None, None, size, written))
                except Exception as error:
                    rows.append((ord_, path, output, "failed", type(error).__name__, f"{path}: {error}", size, None))
            frame = pd.DataFrame(rows, columns=_COLUMNS)
            yield frame.astype({"bytes_in": "Int64", "bytes_out": "Int64"})

    columns = ["ord", "path", "output", *(["content"] if inline else [])]
    return files.select(*columns).mapInPandas(run, OUTCOME)


#: The session of the last job that this Python worker served, by the job's token: workers outlive tasks.
_held: dict[str, object] = {}


def held_session(token: str, open_session: Callable[[], object]) -> object:
    """The worker's session of a job; another job's is let go first, so a worker holds one model at a time."""
    if token not in _held:
        _held.clear()
        _held[token] = open_session()
    return _held[token]


def score_images(
    df: DataFrame,
    open_session: Callable[[], object],
    score: Callable[[object, pd.DataFrame], pd.DataFrame],
    schema: str,
    token: str | None = None,
) -> DataFrame:
    """Runs a model over batches of rows, opening it once per Python worker.

    ``open_session`` is called before the first batch that a worker sees; Spark reuses workers (``spark.python.worker.reuse``), so
    there are as many sessions as an executor has slots, whatever the number of tasks. Model files that were
    distributed with ``SparkContext.addFile`` are opened by ``SparkFiles.get`` there. ``score(session, batch)`` returns
    a frame with ``schema``. Jobs with the same ``token`` share sessions (default: a new one, so each result has its own).
    Errors surface: a batch that cannot be scored fails its task.
    """
    job = token or uuid.uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield score(held_session(job, open_session), batch)

    return df.mapInPandas(run, schema)
