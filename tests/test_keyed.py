import os
import random

import pytest
from pyspark.sql import functions as F

from tileweave.sources.keyed import ConcurrentChange, KeyedTable

ROWS = "output string, size bigint, ord int"


def files(path):
    return {os.path.join(root, n): os.path.getmtime(os.path.join(root, n)) for root, _, names in os.walk(path) for n in names if n.endswith(".parquet")}


def content(table, version=None):
    return {r.output: r["size"] for r in table.read(version).collect()}


def test_changes_against_a_dictionary(spark, tmp_path):
    rng, want, path = random.Random(1), {}, str(tmp_path / "t")
    table = KeyedTable(spark, path, buckets=8, compact_after=3)
    for step in range(9):
        rows = [(f"k{rng.randint(0, 60)}", step * 100 + i, i) for i in range(rng.randint(1, 25))]
        df = spark.createDataFrame(rows, ROWS)
        kind = step % 3 if step else 0
        if kind == 0:
            table.upsert(df, order_by="ord")
            want.update({k: v for k, v, _ in rows})
        elif kind == 1:
            table.insert_new(df, order_by="ord")
            for k, v, _ in rows:
                want.setdefault(k, v)
        else:
            table.delete(df)
            for k, _, _ in rows:
                want.pop(k, None)
        assert content(table) == want and content(KeyedTable(spark, path)) == want
    table.compact()
    assert content(table) == want and table._manifest()["deltas"] == []
    before = table.versions()[-1]
    table.upsert(spark.createDataFrame([("new", 1, 1)], ROWS))
    assert content(table, before) == want and content(table) == {**want, "new": 1}
    assert table.vacuum() and content(table) == {**want, "new": 1} and len(table.versions()) == 1


def test_one_row_touches_one_bucket(spark, tmp_path):
    path = str(tmp_path / "t")
    table = KeyedTable(spark, path, buckets=16)
    table.upsert(spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("output"), F.col("id").alias("size"), F.lit(1).alias("ord")))
    table.compact()
    old = files(path)
    table.upsert(spark.createDataFrame([("k77", -1, 1)], ROWS))
    new = {f: t for f, t in files(path).items() if f not in old}
    assert len(new) == 1 and all(files(path)[f] == t for f, t in old.items())
    assert table.read().filter("output = 'k77'").first()["size"] == -1 and table.read().count() == 20_000
    table.compact()
    rewritten = [f for f in files(path) if f not in old and f not in new]
    assert len(rewritten) == 1 and 20_000 / 32 < spark.read.parquet(rewritten[0]).count() < 20_000 / 8
    assert "Join" not in table.read()._jdf.queryExecution().executedPlan().toString()
    table.delete(spark.createDataFrame([("k78",), ("none",)], "output string"))
    assert table.read().count() == 19_999 and "Join" in table.read()._jdf.queryExecution().executedPlan().toString()


def test_a_dead_job_leaves_the_old_version(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), buckets=4)
    table.upsert(spark.createDataFrame([("a", 1, 1), ("b", 2, 1)], ROWS))
    dies = spark.createDataFrame([("a", 5, 1)], ROWS).withColumn("size", F.when(F.col("size") > 4, F.raise_error(F.lit("killed")).cast("bigint")))
    with pytest.raises(Exception, match="killed"):
        table.upsert(dies)
    assert content(table) == {"a": 1, "b": 2} and table.versions() == [1]
    # Written, but never published.
    table._write(table._dealt(spark.createDataFrame([("a", 9, 1)], ROWS)))
    assert content(table) == {"a": 1, "b": 2}
    assert len(table.vacuum()) >= 1 and content(table) == {"a": 1, "b": 2}


def test_of_two_writers_one_wins(spark, tmp_path):
    path = str(tmp_path / "t")
    one, two = KeyedTable(spark, path, buckets=4), KeyedTable(spark, path, buckets=4)
    one.upsert(spark.createDataFrame([("a", 1, 1)], ROWS))
    stale = two._manifest()
    one.upsert(spark.createDataFrame([("a", 2, 1)], ROWS))
    two._manifest = lambda version=None: stale
    with pytest.raises(ConcurrentChange):
        two.upsert(spark.createDataFrame([("a", 3, 1)], ROWS))
    assert content(one) == {"a": 2} and not [n for n in os.listdir(f"{path}/versions") if "part" in n and not n.endswith(".crc")]


def test_odd_changes(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), buckets=4)
    for wrong in (table.read, table.compact, lambda: table.delete(spark.createDataFrame([("a",)], "output string"))):
        with pytest.raises(FileNotFoundError):
            wrong()
    table.upsert(spark.createDataFrame([], ROWS))
    assert content(table) == {}
    table.upsert(spark.createDataFrame([("a", 1, 1), (None, 7, 1)], ROWS))
    table.upsert(spark.createDataFrame([("b", "note", True)], "output string, note string, deleted boolean"))
    rows = {r.output: (r["size"], r.note, r.deleted) for r in table.read().collect()}
    assert rows == {"a": (1, None, None), "b": (None, "note", True)}
    with pytest.raises(ValueError, match="size"):
        table.upsert(spark.createDataFrame([("a", "text")], "output string, size string"))
    table.delete(table.read())
    assert content(table) == {} and table.compact() == table.versions()[-1] and content(table) == {}
