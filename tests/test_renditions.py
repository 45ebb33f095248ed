from pyspark.sql import functions as F

from tests.conftest import png
from tileweave.plans import renditions as rn
from tileweave.sources.presets import PRESETS

OUT = "output string"


def test_one_read_feeds_all_renditions(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.png").write_bytes(png(4, 2, lambda x, y: (1, 2, 3)))
    (tmp_path / "c.png").write_bytes(b"garbage")
    log = str(tmp_path / "log")
    files = spark.createDataFrame([(i, str(tmp_path / n), 9) for i, n in enumerate(("a.png", "b.png", "c.png", "gone.png"))], "ord bigint, path string, length bigint")

    def open_image(path, content):
        with open(log, "a") as out:
            out.write(path + "\n")
        return len(content)

    def render(size, edge):
        if edge["preset_id"] == "rotate-180":
            raise OSError("disk")
        return size

    rows = rn.run_renditions(files, spark.createDataFrame([], OUT), open_image, render)
    got = {(r.ord, r.preset_id): r for r in rows.collect()}
    assert rows.count() == len(got) == 4 * len(PRESETS)
    with open(log) as lines:
        assert len(lines.readlines()) == 2
    assert {r.error for k, r in got.items() if k[0] == 2} == {"unreadable_header"} and {(r.error_kind, r.error) for k, r in got.items() if k[0] == 3} == {("io", "unreadable_file")}
    mine = {p: (r.status, r.error_kind) for (o, p), r in got.items() if o == 0}
    # The file itself is there, so converting it to its own format is skipped; the optimiser may replace it.
    assert mine["convert-png"] == ("skipped", None) and mine["web-optimize-png"] == ("written", None) and mine["rotate-180"] == ("failed", "OSError")
    assert mine["web-facebook"] == ("written", None) and mine["web-discord"] == ("skipped", None)


def test_policies_meet_in_order(spark):
    png_ = bytearray(png(4, 2, lambda x, y: (1, 2, 3)))
    files = spark.createDataFrame([(i, f"/in/{n}", png_) for i, n in enumerate(("x.png", "x.gif", "x.bmp"))], "ord bigint, path string, content binary").withColumn("length", F.length("content").cast("bigint"))
    listing = spark.createDataFrame([("/in/x_auto.png",), ("/in/x_auto_2.png",)], OUT)
    plan = rn.name_renditions(files, listing, only=["rotate-auto-exif", "web-optimize-png", "convert-jpg"])
    got = {(r.ord, r.preset_id): (r.output, r.status, r.error_kind) for r in plan.collect()}
    assert [got[i, "rotate-auto-exif"][0] for i in range(3)] == ["/in/x_auto_1.png", "/in/x_auto_3.png", "/in/x_auto_4.png"]
    assert [got[i, "web-optimize-png"][1:] for i in range(3)] == [("skipped", "superseded"), ("skipped", "superseded"), (None, None)]
    assert [got[i, "convert-jpg"][1] for i in range(3)] == [None, "skipped", "skipped"]
    assert rn.name_renditions(files.limit(0), listing).count() == 0


def test_a_worker_holds_few_rows_at_a_time(spark, tmp_path):
    png_ = bytearray(png(4, 2, lambda x, y: (1, 2, 3)))
    files = spark.range(1500).selectExpr("id AS ord", "concat('/in/', id, '.png') AS path").withColumns({"content": F.lit(png_), "length": F.lit(len(png_)).cast("bigint")})
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")}

    def held(image, edge):
        import sys

        # The batch of the caller's caller: rows that this worker holds as Python objects.
        return len(sys._getframe(1).f_locals["batch"])

    rows = rn.run_renditions(files, spark.createDataFrame([], OUT), lambda path, content: content, held, only=["rotate-180", "web-discord"], tasks=2).cache()
    assert rows.filter("status = 'written'").count() == 3000
    assert rows.agg(F.max("bytes_out")).first()[0] <= 256
    assert before == {k: spark.conf.get(k, None) for k in before}
