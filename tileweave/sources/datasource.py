"""Python data sources over image files that list without content and read only header ranges.

``spark.read.format("image_headers").load(folder)`` gives sizes, ``"image_tags"`` the EXIF tags. Options: ``recursive``
(default true) and ``minPartitions``. Register them with ``register(spark)``; ``scan_headers`` and ``scan_tags`` do.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .exif import TAG_SCHEMA, _rows
from .headers import dims_of, format_of
from .ranges import FileRanges, open_location

#: What a file costs a task: opening it, and what is likely to be read of it. A partition holds files for so much.
OPEN_COST, MOST_READ, PARTITION_COST = 64 << 10, 512 << 10, 128 << 20


class Files(InputPartition):
    """``(path, length, modification time)`` of the files of one task."""

    def __init__(self, value: list[tuple]):
        super().__init__(value)


def list_files(location: str, recursive: bool) -> list[tuple]:
    """Files below a location in order of their names, as a file index lists them; hidden ones and parts are left out."""
    from pyarrow import fs

    store, place = open_location(location)
    prefix = location[: len(location) - len(place)] if location.endswith(place) else ""
    top = store.get_file_info(place)
    if top.type == fs.FileType.NotFound:
        raise FileNotFoundError(location)
    found = [top] if top.type == fs.FileType.File else store.get_file_info(fs.FileSelector(place, recursive=recursive))
    files = [i for i in found if i.type == fs.FileType.File and not i.base_name.startswith((".", "_"))]
    return sorted((prefix + i.path, i.size, i.mtime) for i in files)


def pack(files: list[tuple], least: int) -> list[Files]:
    """Consecutive files by what reading their headers may cost, in at least so many partitions."""
    costs = [OPEN_COST + min(size, MOST_READ) for _, size, _ in files]
    most = max(1, min(PARTITION_COST, -(-sum(costs) // max(least, 1))))
    parts, now, cost = [], [], 0
    for file, c in zip(files, costs):
        if now and cost + c > most:
            parts.append(Files(now))
            now, cost = [], 0
        now.append(file)
        cost += c
    return [*parts, Files(now)] if now else parts


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.location = options.get("path")
        if not self.location:
            raise ValueError("load() needs a path")
        self.recursive = str(options.get("recursive", "true")).lower() == "true"
        self.least = int(options.get("minPartitions", 8))

    def partitions(self):
        # A source without partitions is read once with None, which would be an error here.
        return pack(list_files(self.location, self.recursive), self.least) or [Files([])]


class HeaderReader(_Reader):
    def read(self, partition: Files) -> Iterator[tuple]:
        for path, length, modified in partition.value:
            try:
                with FileRanges(path) as d:
                    kind = format_of(d.some(0, 64), path)
                    width, height = dims_of(d, kind) or (None, None)
                    yield path, length, modified, kind, width, height, d.n_read, None
            except OSError as error:
                yield path, length, modified, None, None, None, 0, f"io: {error}"


class TagReader(_Reader):
    def read(self, partition: Files) -> Iterator[tuple]:
        for path, _, _ in partition.value:
            try:
                with FileRanges(path) as d:
                    yield from [(*row, d.n_read) for row in _rows(path, d)]
            except Exception as error:
                yield path, None, None, None, 0, f"exif: {error}", None, 0


class ImageHeaders(DataSource):
    @classmethod
    def name(cls) -> str:
        return "image_headers"

    def schema(self) -> str:
        return "path string, length bigint, modificationTime timestamp, source_format string, width bigint, height bigint, n_read bigint, read_error string"

    def reader(self, schema) -> HeaderReader:
        return HeaderReader(self.options)


class ImageTags(DataSource):
    @classmethod
    def name(cls) -> str:
        return "image_tags"

    def schema(self) -> str:
        return TAG_SCHEMA + ", n_read bigint"

    def reader(self, schema) -> TagReader:
        return TagReader(self.options)


def register(spark: SparkSession) -> None:
    for source in (ImageHeaders, ImageTags):
        spark.dataSource.register(source)


def _scan(spark: SparkSession, name: str, path: str, recursive: bool) -> DataFrame:
    register(spark)
    tasks = 4 * spark.sparkContext.defaultParallelism
    return spark.read.format(name).option("recursive", str(recursive).lower()).option("minPartitions", str(tasks)).load(path)


def scan_headers(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """Format and sides of every file below ``path``, with the number of bytes read of each; an unreadable file has ``read_error``."""
    return _scan(spark, "image_headers", path, recursive)


def scan_tags(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """``exif.exif_tags`` of every file below ``path``."""
    return _scan(spark, "image_tags", path, recursive)
