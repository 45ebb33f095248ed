import os
import struct

import pytest
from pyspark.sql import functions as F

from tests.conftest import png
from tileweave.operators import admission as adm, images as im, metadata as md, pixels as pz
from tileweave.plans.conversion import plan_conversion, report, run_conversion
from tileweave.sources import exif, files as fl, sinks
from tileweave.streaming import progress


@pytest.fixture()
def folder(tmp_path):
    gradient = png(8, 8, lambda x, y: (32 * x % 256, 32 * y % 256, 128))
    (tmp_path / "a.png").write_bytes(gradient)
    (tmp_path / "b.PNG.part").write_bytes(gradient)
    (tmp_path / "c.png").write_bytes(b"garbage")
    (tmp_path / "d.JPG").write_bytes(png(4, 2, lambda x, y: (9, 8, 7, 6), 4))
    (tmp_path / "notes.txt").write_text("hello")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "e.png").write_bytes(gradient)
    return tmp_path


def names(df, column="path"):
    return [os.path.basename(r[0]) for r in df.select(column).collect()]


def test_scan_prunes_content(spark, folder):
    scan = fl.scan_files(spark, str(folder)).select("path", "length").filter("length < 10")
    assert sorted(names(scan)) == ["c.png", "notes.txt"]
    plan = scan._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(length), LessThan(length,10)]" in plan
    assert "content" not in plan.split("ReadSchema:")[1].splitlines()[0]


def test_list_folder(spark, folder):
    assert names(fl.list_folder(spark, str(folder))) == ["a.png", "c.png", "d.JPG"]
    assert fl.list_folder(spark, str(folder / "missing")).count() == 0


def test_decode_by_content(spark, folder):
    rows = {os.path.basename(r.origin): r for r in fl.scan_decoded(spark, str(folder)).collect()}
    assert (rows["b.PNG.part"].width, rows["b.PNG.part"].status) == (8, "decoded")
    assert (rows["c.png"].status, rows["c.png"].error_kind) == ("failed", "decode")
    assert rows["d.JPG"].nChannels == 4
    first = fl.scan_decoded(spark, str(folder / "a.png")).withColumn("image_id", F.lit(1))
    pixel = pz.to_pixels(first).filter("x = 3 AND y = 5").first()
    assert (pixel.r, pixel.g, pixel.b, pixel.a) == (96, 160, 128, 255)


def tiff(order, entries, extra=b"", ifd1=None):
    e = {"II": "<", "MM": ">"}[order]
    body = order.encode() + struct.pack(e + "HI", 42, 8) + struct.pack(e + "H", len(entries))
    data_at = 8 + 2 + 12 * len(entries) + 4
    for tag, kind, count, value in entries:
        raw = value if isinstance(value, bytes) else struct.pack(e + value[0], *value[1:])
        body += struct.pack(e + "HHI", tag, kind, count) + raw.ljust(4, b"\0")
    return body + struct.pack(e + "I", 0) + extra, data_at


@pytest.mark.parametrize("order", ["II", "MM"])
def test_exif_walk(order):
    entries = [(0x0112, 3, 1, ("H", 6)), (0x010F, 2, 3, b"ACM"), (0xC000, 4, 2, ("I", 0))]
    block, at = tiff(order, entries)
    e = "<" if order == "II" else ">"
    block = block[: 10 + 12 * 2 + 8] + struct.pack(e + "I", at) + block[10 + 12 * 3 :] + struct.pack(e + "II", 5, 7)
    got = exif.tags_of(block)
    assert got == [("primary", "Orientation", "6"), ("primary", "Make", "ACM"), ("primary", "0xC000", "5, 7")]
    jpeg = b"\xff\xd8\xff\xe0\0\4ab\xff\xe1" + struct.pack(">H", len(block) + 8) + b"Exif\0\0" + block + b"\xff\xd9"
    assert exif.tags_of(jpeg) == got


def test_exif_rows_and_flags(spark, folder):
    block, _ = tiff("II", [(0x0112, 3, 1, ("H", 8)), (0x0110, 2, 2, b"M1")])
    (folder / "f.tif").write_bytes(block)
    (folder / "g.tif").write_bytes(b"II*\0\x08\0\0\0\xff\xff")
    tags = exif.exif_tags(fl.scan_files(spark, str(folder)))
    rows = tags.collect()
    assert sorted((os.path.basename(r.path), r.tag, r.value) for r in rows if r.error is None) == [
        ("f.tif", "Model", "M1"), ("f.tif", "Orientation", "8")
    ]
    assert [os.path.basename(r.path) for r in rows if r.error] == ["g.tif"]
    flagged = md.with_tag_flags(fl.scan_files(spark, str(folder)).select("path"), tags)
    by_name = {os.path.basename(r.path): (r.has_gps, r.has_camera, r.orientation) for r in flagged.collect()}
    assert by_name["f.tif"] == (False, True, 8)
    assert by_name["g.tif"] == by_name["a.png"] == (False, False, None)


def test_map_images_isolates_failures(spark, folder):
    files = fl.scan_files(spark, str(folder), recursive=False).withColumns({"ord": F.monotonically_increasing_id(), "output": F.lit("o")})

    def work(path, content, output):
        if path.endswith("c.png"):
            raise ValueError("corrupt")
        return None if path.endswith("txt") else len(content)

    for given in (files, files.drop("content")):  # inline, and read inside the task
        rows = {os.path.basename(r.input): r for r in im.map_images(given, work).collect()}
        assert rows["c.png"].status == "failed" and rows["c.png"].error.endswith("corrupt")
        assert rows["notes.txt"].status == "skipped" and rows["notes.txt"].bytes_in == 5
        assert rows["a.png"].status == "written" and rows["a.png"].bytes_out == rows["a.png"].bytes_in


def test_sessions_open_once_per_task(spark):
    df = spark.range(0, 100, 1, 2)

    def open_session():
        import uuid

        return uuid.uuid4().hex

    def score(session, batch):
        return batch.assign(session=session)[["id", "session"]]

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        out = im.score_images(df, open_session, score, "id bigint, session string").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(out) == 100 and len({r.session for r in out}) == 2


def test_export_creates_folders_and_reports_failures(spark, tmp_path):
    (tmp_path / "blocked").write_text("a file, not a folder")
    rows = [(1, str(tmp_path / "x" / "y" / "1.bin"), bytearray(b"one")), (2, str(tmp_path / "blocked" / "2.bin"), bytearray(b"two"))]
    out = {r.ord: r for r in sinks.export_files(spark.createDataFrame(rows, "ord bigint, output string, content binary")).collect()}
    assert out[1].status == "written" and (tmp_path / "x" / "y" / "1.bin").read_bytes() == b"one"
    assert out[2].status == "failed" and out[2].error_kind == "io"
    assert os.listdir(tmp_path / "x" / "y") == ["1.bin"]


def test_write_policies(spark, tmp_path):
    path = str(tmp_path / "table")

    def rows(names, origin):
        return spark.createDataFrame([(n, "png" if n < "m" else "jpeg", origin) for n in names], "output string, target string, origin string")

    sinks.write_outputs(rows("az", "1"), path)
    sinks.write_outputs(rows("abz", "2"), path, "skip")
    assert {r.output: r.origin for r in spark.read.parquet(path).collect()} == {"a": "1", "b": "2", "z": "1"}
    sinks.write_outputs(rows("a", "3"), path, "replace")
    assert {r.output: r.origin for r in spark.read.parquet(path).collect()} == {"a": "3", "b": "2", "z": "1"}
    with pytest.raises(ValueError):
        sinks.write_outputs(rows("a", "3"), path, "other")


def test_conversion_of_a_folder(spark, folder):
    files = fl.scan_files(spark, str(folder), recursive=False)
    files = files.withColumn("ord", F.xxhash64("path")).cache()
    existing = spark.createDataFrame([(f"file:{folder}/c.webp",)], "output string")
    done = run_conversion(files, existing, "webp", lambda path, content, output: 7, tasks=2)
    got = {os.path.basename(r.input): (r.status, r.error, os.path.basename(r.output)) for r in done.collect()}
    assert got["a.png"] == ("written", None, "a.webp")
    assert got["b.PNG.part"][0] == "written" and got["b.PNG.part"][2] == "b.PNG.webp"
    assert got["c.png"][0] == "skipped"  # an existing output wins over a corrupt input
    assert got["notes.txt"] == ("failed", "unsupported_format", "notes.webp")
    total = report(done).first()
    assert (total.ok, total.skip, total.fail, total.exit_code) == (3, 1, 1, 2)


def test_conversion_under_increment(spark):
    header = bytearray.fromhex("89504E470D0A1A0A0000000D494844520000000200000002")
    files = spark.createDataFrame([(i, f"/p/x.{e}", 24, header) for i, e in enumerate(("png", "gif", "bmp"))], "ord bigint, path string, length bigint, content binary")
    existing = spark.createDataFrame([("/p/x.jpg",)], "output string")
    got = {r.ord: r.output for r in plan_conversion(files, existing, "jpeg", "increment").collect()}
    assert got == {0: "/p/x_1.jpg", 1: "/p/x_2.jpg", 2: "/p/x_3.jpg"}
    bomb = files.withColumn("length", F.when(F.col("ord") == 1, F.lit(1 << 31)).otherwise(F.col("length")).cast("bigint"))
    got = {r.ord: (r.output, r.status, r.error) for r in plan_conversion(bomb, existing, "jpeg", "increment").collect()}
    assert got == {0: ("/p/x_1.jpg", None, None), 1: ("/p/x.jpg", "failed", "too_many_bytes"), 2: ("/p/x_2.jpg", None, None)}
    got = {r.ord: (r.status, r.error_kind) for r in plan_conversion(bomb, existing, "jpeg", "replace").collect()}
    assert got == {0: ("skipped", "superseded"), 1: ("failed", "invalid_input"), 2: (None, None)}
    got = {r.ord: r.status for r in plan_conversion(bomb, existing, "jpeg", "skip").collect()}
    assert set(got.values()) == {"skipped"}
    free = existing.filter("output IS NULL")
    got = {r.ord: r.status for r in plan_conversion(bomb, free, "jpeg", "skip").collect()}
    assert got == {0: None, 1: "failed", 2: "skipped"}


def test_missing_artifacts_are_not_valid(spark, folder):
    rows = [(1, f"file:{folder}/a.png", "00"), (2, f"file:{folder}/nowhere", "00")]
    wanted = spark.createDataFrame(rows, "artifact_id int, path string, expected_sha256 string")
    joined = adm.with_file_hashes(wanted, fl.scan_files(spark, str(folder)))
    got = {r.artifact_id: (r.actual_sha256 is None, r.ok) for r in joined.withColumn("ok", adm.hash_ok()).collect()}
    assert got == {1: (False, False), 2: (True, False)}


def test_stream_counts_repeated_rows_once(spark, tmp_path):
    schema = "ord bigint, job_id bigint, finished_at timestamp, status string, bytes_in bigint, bytes_out bigint, error string"
    when = "2024-01-01 00:00:00"
    rows = [(1, 1, when, "written", 10, 4, None), (2, 1, when, "failed", 5, None, "e"), (1, 2, when, "skipped", 7, None, None)]
    first = spark.createDataFrame(rows, schema.replace("timestamp", "string")).withColumn("finished_at", F.to_timestamp("finished_at"))
    source = str(tmp_path / "events")
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def drain():
        stream = spark.readStream.schema(first.schema).parquet(source)
        progress.write_summary(progress.stream_summary(stream, "1 hour"), out, state, availableNow=True).awaitTermination()
        return {r.job_id: (r.ok, r.skip, r.fail, r.bytes_in, r.bytes_out, r.done) for r in progress.latest_summary(spark, out).collect()}

    first.write.parquet(source)
    assert drain() == {1: (1, 0, 1, 15, 4, 2), 2: (0, 1, 0, 7, 0, 1)}
    more = first.filter("job_id = 1 AND ord = 1").unionByName(first.filter("ord = 2").withColumn("ord", F.lit(3).cast("bigint")))
    more.write.mode("append").parquet(source)
    assert drain() == {1: (1, 0, 2, 20, 4, 3), 2: (0, 1, 0, 7, 0, 1)}
