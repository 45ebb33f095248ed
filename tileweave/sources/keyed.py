"""A keyed table of outputs that is changed by small delta files: log-structured, one row per key.

Rows are dealt over buckets by the hash of their key. A change writes a segment with its own rows, and tombstones for
deleted keys; nothing that is there is rewritten. A manifest names the segments that make up a version, and a new
version exists once its manifest has its name: a job that dies before leaves the old one as it was. Reading lays the
deltas over the bases of the buckets that have some; compaction folds them into new bases, bucket by bucket.

    data/<segment>/bucket__=<k>/*.parquet      rows of one change or compaction
    versions/<number>.json                     bases by bucket, and deltas in order with their buckets
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..session import cut_lineage

#: Deltas of a bucket after which a change compacts it.
COMPACT_AFTER = 8
_BUCKET, _DELETED, _AGE = "bucket__", "deleted__", "age__"
_BUCKET_FIELD = T.StructField(_BUCKET, T.IntegerType())


class ConcurrentChange(RuntimeError):
    """Another writer has published the version that this change was to become."""


class KeyedTable:
    """Opens the table at ``path``, or prepares a new one of ``buckets`` buckets, which is written by the first change."""

    def __init__(self, spark: SparkSession, path: str, key: str = "output", buckets: int = 64, compact_after: int = COMPACT_AFTER):
        self.spark, self.path, self.compact_after = spark, path, compact_after
        jvm = spark._jvm
        self._jpath = lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join([path, *parts]))
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._jpath().getFileSystem(self._conf)
        found = self._manifest()
        self.key, self.buckets = (found["key"], found["buckets"]) if found else (key, buckets)

    # --- versions ------------------------------------------------------------------------------

    def versions(self) -> list[int]:
        folder = self._jpath("versions")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _manifest(self, version: int | None = None) -> dict | None:
        known = self.versions()
        if not known:
            return None
        stream = self._fs.open(self._jpath("versions", f"{known[-1] if version is None else version}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> None:
        """Gives the manifest its name. The rename fails if the name is taken, so of two writers one wins."""
        jvm, rename = self.spark._jvm, self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        part = self._jpath("versions", f".{uuid.uuid4().hex}.part")
        out = self._fs.create(part, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        try:
            context.rename(part, self._jpath("versions", f"{manifest['version']}.json"), self.spark._sc._gateway.new_array(rename, 0))
        except Exception as error:
            self._fs.delete(part, False)
            if "FileAlreadyExists" in str(error) or "already exists" in str(error):
                raise ConcurrentChange(f"version {manifest['version']} of {self.path} was published by someone else") from error
            raise

    def _next(self, manifest: dict | None, schema: T.StructType) -> dict:
        if manifest is None:
            return {"version": 1, "key": self.key, "buckets": self.buckets, "bases": {}, "deltas": [], "schema": schema.jsonValue()}
        old = T.StructType.fromJson(manifest["schema"])
        for field in schema:
            if field.name in old.names and old[field.name].dataType != field.dataType:
                raise ValueError(f"column {field.name} is {old[field.name].dataType.simpleString()}, not {field.dataType.simpleString()}")
        merged = T.StructType([*old, *[T.StructField(f.name, f.dataType, True) for f in schema if f.name not in old.names]])
        return {**manifest, "version": manifest["version"] + 1, "schema": merged.jsonValue(), "bases": dict(manifest["bases"]), "deltas": list(manifest["deltas"])}

    # --- segments --------------------------------------------------------------------------------

    def _dealt(self, df: DataFrame) -> DataFrame:
        return df.withColumn(_BUCKET, F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))

    def _write(self, dealt: DataFrame) -> tuple[str, list[int]]:
        """A segment of rows with their buckets, one file each, and the buckets that got some."""
        name = uuid.uuid4().hex
        dealt.repartition(_BUCKET).write.partitionBy(_BUCKET).parquet(f"{self.path}/data/{name}")
        folders = [s.getPath().getName() for s in self._fs.listStatus(self._jpath("data", name))]
        return name, sorted(int(f.split("=")[1]) for f in folders if f.startswith(f"{_BUCKET}="))

    def _read(self, segment: str, buckets: list[int], schema: T.StructType) -> DataFrame:
        rows = self.spark.read.schema(T.StructType([*schema, _BUCKET_FIELD])).parquet(f"{self.path}/data/{segment}")
        return rows if len(buckets) == self.buckets else rows.filter(F.col(_BUCKET).isin(*buckets))

    def _empty(self, schema: T.StructType) -> DataFrame:
        return self.spark.createDataFrame([], T.StructType([*schema, _BUCKET_FIELD]))

    def _bases(self, manifest: dict, buckets: set[int], schema: T.StructType) -> DataFrame:
        """Base rows of some buckets; each segment is read once, only in those of its buckets that are still current."""
        by_segment: dict[str, list[int]] = {}
        for bucket, segment in manifest["bases"].items():
            if int(bucket) in buckets:
                by_segment.setdefault(segment, []).append(int(bucket))
        out = None
        for segment, mine in by_segment.items():
            rows = self._read(segment, sorted(mine), schema)
            out = rows if out is None else out.unionByName(rows)
        return self._empty(schema) if out is None else out

    def _newest(self, manifest: dict, buckets: set[int], schema: T.StructType) -> DataFrame:
        """The last change of every key in the deltas of some buckets."""
        out = None
        for age, delta in enumerate(manifest["deltas"]):
            mine = sorted(buckets.intersection(delta["buckets"]))
            if mine:
                rows = self._read(delta["segment"], mine, T.StructType([*schema, T.StructField(_DELETED, T.BooleanType())])).withColumn(_AGE, F.lit(age))
                out = rows if out is None else out.unionByName(rows)
        if out is None:
            return self._empty(schema).withColumn(_DELETED, F.lit(False))
        return out.groupBy(self.key).agg(F.max_by(F.struct(*out.columns), _AGE).alias("_row")).select("_row.*").drop(_AGE)

    def _touched(self, manifest: dict) -> set[int]:
        return {b for delta in manifest["deltas"] for b in delta["buckets"]}

    def _rows(self, manifest: dict, buckets: set[int]) -> DataFrame:
        """Current rows of some buckets, with their bucket."""
        schema = T.StructType.fromJson(manifest["schema"])
        touched = buckets & self._touched(manifest)
        if not touched:
            return self._bases(manifest, buckets, schema)
        newest = self._newest(manifest, touched, schema)
        under = self._bases(manifest, touched, schema).join(newest.select(self.key), self.key, "left_anti").select(*schema.names, _BUCKET)
        changed = under.unionByName(newest.filter(~F.col(_DELETED)).drop(_DELETED))
        return self._bases(manifest, buckets - touched, schema).unionByName(changed)

    # --- what users call ---------------------------------------------------------------------------

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version. Buckets without deltas are plain scans; the others join with their own deltas only."""
        manifest = self._manifest(version)
        if manifest is None:
            raise FileNotFoundError(f"no table at {self.path}")
        return self._rows(manifest, set(range(self.buckets))).drop(_BUCKET)

    def upsert(self, df: DataFrame, order_by: str | None = None) -> int:
        """Inserts rows and replaces those with the same key; of several rows of a key the last by ``order_by`` stays."""
        return self._change(df, order_by, F.max_by, None)

    def insert_new(self, df: DataFrame, order_by: str | None = None) -> int:
        """Inserts rows whose key is not there; of several rows of a key the first by ``order_by`` counts."""
        return self._change(df, order_by, F.min_by, "left_anti")

    def delete(self, keys: DataFrame) -> int:
        """Tombstones for keys; those that are not there do no harm."""
        return self._change(keys.select(self.key).distinct(), None, None, "left_semi")

    def _change(self, df: DataFrame, order_by: str | None, pick, present: str | None) -> int:
        """One delta. ``present`` keeps the rows whose key is, or is not, in the table already."""
        manifest = self._manifest()
        if manifest is None and pick is None:
            raise FileNotFoundError(f"no table at {self.path}")
        schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema])
        new = self._next(manifest, T.StructType([]) if pick is None else schema)
        rows = df.filter(F.col(self.key).isNotNull())
        if pick is not None:
            order = F.col(order_by) if order_by else F.xxhash64(*df.columns)
            rows = rows.groupBy(self.key).agg(pick(F.struct(*df.columns), order).alias("_row")).select("_row.*")
        rows = cut_lineage(self._dealt(rows))
        if manifest is not None and present:
            # Only the buckets of the changed keys are looked at, and of those only the keys.
            mine = {r[0] for r in rows.select(_BUCKET).distinct().collect()}
            rows = rows.join(self._rows(manifest, mine).select(self.key), self.key, present).select(*rows.columns)
        for field in T.StructType.fromJson(new["schema"]):
            if field.name not in rows.columns:
                rows = rows.withColumn(field.name, F.lit(None).cast(field.dataType))
        segment, buckets = self._write(rows.withColumn(_DELETED, F.lit(pick is None)))
        if buckets:
            new["deltas"].append({"segment": segment, "buckets": buckets})
        self._publish(new)
        counts: dict[int, int] = {}
        for delta in new["deltas"]:
            for b in delta["buckets"]:
                counts[b] = counts.get(b, 0) + 1
        crowded = {b for b, n in counts.items() if n > self.compact_after}
        return self.compact(crowded) if crowded else new["version"]

    def compact(self, buckets: set[int] | None = None) -> int:
        """Folds the deltas of some buckets (default: all that have some) into new bases; other buckets are not read."""
        manifest = self._manifest()
        if manifest is None:
            raise FileNotFoundError(f"no table at {self.path}")
        chosen = self._touched(manifest) if buckets is None else buckets & self._touched(manifest)
        if not chosen:
            return manifest["version"]
        new = self._next(manifest, T.StructType([]))
        segment, filled = self._write(self._rows(manifest, chosen))
        for b in chosen:
            new["bases"].pop(str(b), None)
        new["bases"].update({str(b): segment for b in filled})
        left = [{**d, "buckets": [b for b in d["buckets"] if b not in chosen]} for d in manifest["deltas"]]
        new["deltas"] = [d for d in left if d["buckets"]]
        self._publish(new)
        return new["version"]

    def vacuum(self, keep: int = 1) -> list[str]:
        """Deletes all but the last ``keep`` versions and the segments that none of those uses; returns the segments.

        Do not run it next to a writer: a segment that is being written is not in a manifest yet.
        """
        known = self.versions()
        kept, used = known[-keep:], set()
        for version in kept:
            manifest = self._manifest(version)
            used |= set(manifest["bases"].values()) | {d["segment"] for d in manifest["deltas"]}
        for version in known[:-keep]:
            self._fs.delete(self._jpath("versions", f"{version}.json"), False)
        folder = self._jpath("data")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        gone = [n for n in names if n not in used]
        for name in gone:
            self._fs.delete(self._jpath("data", name), True)
        return gone
