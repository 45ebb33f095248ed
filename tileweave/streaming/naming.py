"""Names and outcomes across micro-batches, with keyed state: no output is given twice, no late row goes uncounted.

Both operators need Spark's RocksDB state store (``rocksdb_state``). State lives with its key, so a restart from the checkpoint
goes on where the last committed micro-batch ended.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.numeric import as_col
from ..operators.naming import LAST_SLOT
from ..operators.stats import batch_summary
from ..session import shared_dir

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Lanes that a job's outcomes are dealt over; each has its own newest row.
LANES = 16


@contextmanager
def rocksdb_state(spark: SparkSession):
    """The state store that the operators of this module need, for queries that are started inside."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


def family(path) -> Column:
    """What all numbered siblings of a name share: ``dir/a_3_1.png`` and ``dir/a_3.png`` belong to ``dir/a.png``."""
    return F.regexp_replace(as_col(path), r"^([\s\S]*?)(?:_[1-9][0-9]{0,3})+((?:\.[^./]*)?)$", "$1$2")


def slot_of(name: str) -> tuple[str, int]:
    """The name and the slot that a name is a numbered sibling of: ``a_3.png`` is slot 3 of ``a.png``; slot 0 of itself without a number."""
    stem, dot, ext = split_ext(name)
    base, _, digits = stem.rpartition("_")
    if digits.isascii() and digits.isdigit() and digits[0] != "0" and len(base) < len(stem) - len(digits):
        return f"{base}{dot}{ext}", int(digits)
    return name, 0


def split_ext(name: str) -> tuple[str, str, str]:
    stem, dot, ext = name.rpartition(".")
    return (stem, dot, ext) if dot and "/" not in ext else (name, "", "")


class Slots:
    """The slots of each name of a family: all below ``next`` are taken, and those in ``others``, by a listing or by a longer name.

    A name that is given is a slot below its own name's ``next``, or a slot among its shorter name's ``others``, so nothing is kept by row.
    """

    def __init__(self, packed: str | None):
        self.next, self.others = {}, {}
        for name, (after, *taken) in json.loads(packed or "{}").items():
            self.next[name], self.others[name] = after, set(taken)

    def pack(self) -> str:
        names = self.next.keys() | self.others.keys()
        entries = {n: (self.next.get(n, 0), sorted(self.others.get(n, ()))) for n in names}
        return json.dumps({n: [after, *(k for k in taken if k >= after)] for n, (after, taken) in entries.items()})

    def take(self, name: str) -> bool:
        """Takes exactly this name, if it is free."""
        base, slot = slot_of(name)
        others = self.others.setdefault(base, set())
        if slot < self.next.get(base, 0) or slot in others:
            return False
        others.add(slot)
        return True

    def give(self, naive: str, last_slot: int) -> str | None:
        """The first free name among ``naive`` and its numbered siblings."""
        slot, others, output = self.next.get(naive, 0), self.others.get(naive, ()), None
        while output is None and slot <= last_slot:
            if slot == 0:
                output = naive if self.take(naive) else None
            elif slot not in others:
                stem, dot, ext = split_ext(naive)
                output = f"{stem}_{slot}{dot}{ext}"
            slot += 1
        self.next[naive] = slot
        return output


class NameAllocator(StatefulProcessor):
    """Gives each row the first free name among its own and its numbered siblings; keyed by ``family``.

    A call of the state store from Python costs about half a millisecond, so a family's state is one value: it is read and
    written once in a micro-batch, however many rows the family has.
    """

    def __init__(self, last_slot: int):
        self.last_slot = last_slot

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.slots = handle.getValueState("slots", "packed string")

    def _slots(self) -> Slots:
        return Slots((self.slots.get() or (None,))[0])

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        slots = self._slots()
        for output in initialState["output"]:
            slots.take(output)
        self.slots.update((slots.pack(),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pieces = list(rows)
        if not pieces:
            return
        batch, slots = pd.concat(pieces).sort_values("ord"), self._slots()
        given = [slots.give(naive, self.last_slot) for naive in batch["naive"]]
        self.slots.update((slots.pack(),))
        yield pd.DataFrame({"ord": batch["ord"].to_numpy(), "naive": batch["naive"].to_numpy(), "output": pd.Series(given, dtype=object)})

    def close(self) -> None:
        pass


def allocate_names(stream: DataFrame, existing: DataFrame | None = None, last_slot: int = LAST_SLOT, remember_ms: int | None = None) -> DataFrame:
    """``ord, naive, output`` of a stream of ``ord, naive``, as ``naming.resolve_increment_all`` gives them to rows in order of arrival.

    Rows of a micro-batch come in order of ``ord``. A repeated ``ord`` gets nothing a second time, as long as it is remembered
    (at least ``remember_ms`` of processing time; None: always): Spark's own deduplication drops it before it reaches Python. ``existing`` is a
    batch table of outputs that are taken from the start; it counts when the query starts anew. Rows without a name are left out; a
    name whose siblings are all taken gets null.
    A family of names is one key, so its rows of a micro-batch meet in one task: limit the source's rows per trigger.
    """
    rows = stream.filter("ord IS NOT NULL AND naive IS NOT NULL").select(F.col("ord").cast("bigint").alias("ord"), "naive", family("naive").alias("family"))
    if remember_ms is None:
        rows = rows.dropDuplicates(["family", "ord"])
    else:
        # A row is remembered from its time plus the delay on until the watermark, late by the delay, gets there.
        half = f"{(remember_ms + 1) // 2} milliseconds"
        rows = rows.withColumn("at__", F.current_timestamp()).withWatermark("at__", half).dropDuplicatesWithinWatermark(["family", "ord"])
    keyed = rows.select("ord", "naive", "family").groupBy("family")
    held = existing.filter("output IS NOT NULL").select("output", family("output").alias("family")).distinct().groupBy("family") if existing is not None else None
    return keyed.transformWithStateInPandas(NameAllocator(last_slot), "ord bigint, naive string, output string", "append", "None", held)


class OutcomeFilter(StatefulProcessor):
    """Passes each outcome once and flags those that come too late to know; keyed by job and lane."""

    def __init__(self, delay_ms: int, remember_ms: int | None):
        self.delay_ms, self.remember_ms = delay_ms, remember_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "ord bigint", "at bigint", self.remember_ms)
        self.newest = handle.getValueState("newest", "at bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self.newest.get()[0] if self.newest.exists() else None
        newest = before
        for batch in rows:
            keep, late = [], []
            for k, (ord_, at) in enumerate(zip(batch["ord"].tolist(), batch["at__"].tolist())):
                old = before is not None and at < before - self.delay_ms
                if not old:
                    if self.seen.containsKey((ord_,)):
                        continue
                    self.seen.updateValue((ord_,), (at,))
                    newest = at if newest is None else max(newest, at)
                keep.append(k)
                late.append(old)
            if keep:
                yield batch.iloc[keep].drop(columns=["at__", "lane__"]).assign(late=late)
        if newest is not None and newest != before:
            self.newest.update((newest,))

    def close(self) -> None:
        pass


def unique_outcomes(outcomes: DataFrame, delay_ms: int, remember_ms: int | None = None) -> DataFrame:
    """The rows of a stream of outcomes, each ``(job_id, ord)`` once, with a flag ``late``.

    A row is late if it is more than ``delay_ms`` older (by ``finished_at``) than the newest row of its lane in earlier micro-batches:
    it may be a repetition of one that is forgotten, so it is passed on, flagged, instead of counted or dropped. Rows without
    ``finished_at`` count as of the beginning of time.
    """
    at = F.coalesce(F.unix_millis("finished_at"), F.lit(0))
    keyed = outcomes.withColumns({"at__": at, "lane__": F.pmod(F.xxhash64("ord"), F.lit(LANES)).cast("int")})
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in outcomes.schema) + ", late boolean"
    return keyed.groupBy("job_id", "lane__").transformWithStateInPandas(OutcomeFilter(delay_ms, remember_ms), schema, "append", "ProcessingTime" if remember_ms else "None")


def append_batches(rows: DataFrame, path: str, checkpoint: str, **trigger):
    """Writes each micro-batch's rows under ``path/batch=N``; a repeated micro-batch overwrites itself."""
    def publish(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    with rocksdb_state(rows.sparkSession):
        return rows.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(publish).trigger(**trigger).start()


def summary_with_late(rows: DataFrame) -> DataFrame:
    """``batch_summary`` per job of the rows in time, and ``late``, the number of those that were not."""
    late = rows.groupBy("job_id").agg(F.count_if("late").alias("late"))
    return late.join(batch_summary(rows.filter("NOT late"), "job_id"), "job_id", "left")


def drain_names(stream: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Allocates names for everything available now and returns what was given."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/names-{uuid.uuid4().hex}"
    append_batches(allocate_names(stream, existing), f"{base}/out", f"{base}/state", availableNow=True).awaitTermination()
    return spark.read.schema("ord bigint, naive string, output string").parquet(f"{base}/out")
