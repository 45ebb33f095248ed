import random

import pandas as pd
from pyspark.sql import functions as F

from tests.test_naming import in_list_order
from tileweave.operators.naming import resolve_increment_all
from tileweave.streaming import naming as sn

PLAN = "ord bigint, naive string"
STEMS = ["a", "a_1", "a_2", "a_1_1", "b_1", "b", "c.x", "a_2_1"]


def feed(spark, folder, rows, schema=PLAN):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def source(spark, folder, schema=PLAN):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_family(spark):
    value = lambda column: spark.range(1).select(column).first()[0]
    for path, want in (("/d/a_3_1.png", "/d/a.png"), ("/d_1/a", "/d_1/a"), ("/d/a_0.png", "/d/a_0.png"), ("a_12345.b", "a_12345.b"), ("x_1.t_2.g", "x_1.t.g"), ("_7.png", ".png"), ("a_2.d/x.png", "a_2.d/x.png")):
        assert value(sn.family(F.lit(path))) == want


def test_a_backlog_in_pieces_equals_the_batch(spark, tmp_path):
    rng = random.Random(3)
    plan = [(k, f"/{rng.randint(0, 6)}/{rng.choice(STEMS)}.png") for k in range(120)]
    listing = [f"/{rng.randint(0, 6)}/{rng.choice(STEMS)}.png" for _ in range(15)]
    existing = spark.createDataFrame([(o,) for o in set(listing)], "output string")
    source_dir, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def run():
        sn.append_batches(sn.allocate_names(source(spark, source_dir), existing), out, state, availableNow=True).awaitTermination()
        return [(r.ord, r.output) for r in spark.read.parquet(out).collect()]

    feed(spark, source_dir, plan[:50])
    feed(spark, source_dir, plan[50:80] + plan[40:50])
    first = run()
    assert len(first) == 80
    # Another process goes on from the checkpoint; rows that were seen before come again.
    feed(spark, source_dir, plan[80:] + plan[:20])
    every = run()
    assert len(every) == len(dict(every)) == 120 and set(first) <= set(every)
    assert dict(every) == in_list_order(plan, listing)
    batch = resolve_increment_all(spark.createDataFrame(plan, PLAN), existing)
    assert dict(every) == {r.ord: r.output for r in batch.collect()}


def test_names_run_out(spark, tmp_path):
    folder = str(tmp_path / "in")
    feed(spark, folder, [(k, "a.png") for k in range(6)] + [(9, None)])
    rows = sn.allocate_names(source(spark, folder), last_slot=3)
    sn.append_batches(rows, str(tmp_path / "out"), str(tmp_path / "state"), availableNow=True).awaitTermination()
    got = {r.ord: r.output for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {0: "a.png", 1: "a_1.png", 2: "a_2.png", 3: "a_3.png", 4: None, 5: None}


class Counted:
    """A state handle of one key whose states count their calls."""

    def __init__(self):
        self.value, self.calls = None, 0

    def getValueState(self, *_):
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value


def test_calls_of_the_store_do_not_grow_with_rows():
    rng = random.Random(5)
    plan = [(k, f"/d/{rng.choice(STEMS[:5])}.png") for k in range(2000)]
    allocator, state, got = sn.NameAllocator(9999), Counted(), []
    allocator.init(state)
    allocator.handleInitialState(("/d/a.png",), pd.DataFrame({"output": ["/d/a_3.png", "/d/a_1_2.png"]}), None)
    for batch in (plan[:900], plan[900:]):
        for out in allocator.handleInputRows(("/d/a.png",), iter([pd.DataFrame(batch, columns=["ord", "naive"])]), None):
            got += zip(out["ord"], out["output"])
    assert dict(got) == in_list_order(plan, ["/d/a_3.png", "/d/a_1_2.png"])
    assert state.calls <= 6
    assert len(state.value[0]) < 1000


def test_rows_are_remembered_for_a_time(spark, tmp_path):
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def run():
        sn.append_batches(sn.allocate_names(source(spark, folder), remember_ms=3_600_000), out, state, availableNow=True).awaitTermination()
        return {(r.ord, r.output) for r in spark.read.parquet(out).collect()}

    feed(spark, folder, [(1, "a.png"), (2, "a.png"), (1, "a.png")])
    assert run() == {(1, "a.png"), (2, "a_1.png")}
    feed(spark, folder, [(2, "a.png"), (3, "a.png")])
    assert run() == {(1, "a.png"), (2, "a_1.png"), (3, "a_2.png")}


def test_names_without_an_ending_meet_their_siblings(spark, tmp_path):
    folder, plan = str(tmp_path / "in"), [(1, "/x.y/a"), (2, "/x.y/a"), (3, "/x.y/a_1"), (4, "/x.y/a_1"), (5, "/x.y/a_1_1")]
    feed(spark, folder, plan)
    listing = spark.createDataFrame([("/x.y/a_2",)], "output string")
    sn.append_batches(sn.allocate_names(source(spark, folder), listing), str(tmp_path / "out"), str(tmp_path / "state"), availableNow=True).awaitTermination()
    got = {r.ord: r.output for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: "/x.y/a", 2: "/x.y/a_1", 3: "/x.y/a_1_1", 4: "/x.y/a_1_2", 5: "/x.y/a_1_1_1"}


def test_late_rows_are_counted(spark, tmp_path):
    schema = "job_id bigint, ord bigint, finished_at timestamp, status string, bytes_in bigint, bytes_out bigint, error string"
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def rows(*items):
        df = spark.createDataFrame([(j, o, t, "written", 10, 5, None) for j, o, t in items], "job_id bigint, ord bigint, t bigint, status string, bytes_in bigint, bytes_out bigint, error string")
        df.select("job_id", "ord", F.timestamp_seconds("t").alias("finished_at"), "status", "bytes_in", "bytes_out", "error").coalesce(1).write.mode("append").parquet(folder)

    def run():
        stream = sn.unique_outcomes(source(spark, folder, schema), delay_ms=60_000)
        sn.append_batches(stream, out, state, availableNow=True).awaitTermination()
        got = sn.summary_with_late(spark.read.parquet(out)).collect()
        return {r.job_id: (r.ok, r.late) for r in got}

    rows((1, 1, 1000), (1, 1, 1000), (1, 2, 10), (2, 1, 1000))
    assert run() == {1: (2, 0), 2: (1, 0)}
    # The same lane has moved on: a row of long ago is late, a repetition in time is nothing.
    rows((1, 1, 990), (1, 1, 100), (2, 1, 1000))
    assert run() == {1: (2, 1), 2: (1, 0)}
    assert run() == {1: (2, 1), 2: (1, 0)}
