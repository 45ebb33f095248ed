"""Inputs off the happy path: odd rasters, holes, bombs, moved keys, repeated side effects."""

import struct
import subprocess
import sys
import uuid

import pytest
from pyspark.sql import functions as F

from tileweave.operators import naming, pixels as pz, tone
from tileweave.plans.conversion import plan_conversion, run_conversion
from tileweave.sources import exif, headers, sinks
from tileweave.session import shared_dir

from .conftest import grid, png

RED, BLUE = (255, 0, 0, 255), (0, 0, 255, 255)
RASTER = "image_id bigint, width int, height int, nChannels int, mode int, data binary"


def test_gray_with_alpha_and_other_depths(spark):
    two = spark.createDataFrame([(1, 1, 1, 2, 8, bytearray([100, 200])), (2, 1, 1, 1, 0, bytearray([7]))], RASTER)
    assert grid(pz.to_pixels(two)) == {1: [[(100, 100, 100, 200)]], 2: [[(7, 7, 7, 255)]]}
    deep = spark.createDataFrame([(1, 1, 1, 1, 2, bytearray([1, 2]))], RASTER)
    with pytest.raises(Exception, match="only 8-bit"):
        pz.to_pixels(deep).collect()


def test_a_hole_is_reported_and_bands_have_no_limit(px, monkeypatch):
    table = px({1: [[RED, BLUE], [BLUE, RED]], 2: [[RED]]})
    out = {r.image_id: r for r in pz.from_pixels(table.filter("not (image_id = 1 and x = 0 and y = 1)")).collect()}
    assert (out[1].status, out[1].data, out[2].status, len(out[2].data)) == ("incomplete", None, "decoded", 4)
    monkeypatch.setattr(pz, "MAX_PIXELS", 3)
    large = {r.image_id: r.status for r in pz.from_pixels(table).collect()}
    assert large == {1: "too_large", 2: "decoded"}
    bands = pz.from_pixels_bands(table, band_lines=1).filter("image_id = 1").orderBy("band").collect()
    assert [(b.first_line, b.width, b.height, b.pixels, len(b.data)) for b in bands] == [(0, 2, 1, 2, 8), (1, 2, 1, 2, 8)]


def test_a_canvas_does_not_hang_on_the_corner_pixel(px):
    table = px({1: [[RED, BLUE], [BLUE, RED]]}).filter("x > 0 or y > 0")
    cells = pz.overlay_on_canvas(table, 4, 4, 1, 1).collect()
    assert len(cells) == 16 and sum(c.a for c in cells) == 3 * 255
    assert [(c.x, c.y) for c in cells if c.a] and (1, 1) not in [(c.x, c.y) for c in cells if c.a]


def test_a_bad_lookup_table_is_refused(spark, px):
    for rows in ([(1, 2), (1, 3)], [(300, 1)], [(None, 1)]):
        with pytest.raises(Exception, match="bad lookup entry"):
            tone.lut_join(px({1: [[RED]]}), spark.createDataFrame(rows, "v int, mapped int")).collect()


def test_masks_are_never_broadcast(px):
    table = px({1: [[RED]]})
    plan = tone.apply_mask(table, table.selectExpr("image_id", "x", "y", "0.5d as m"))._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def _box(kind, body):
    return struct.pack(">I", len(body) + 8) + kind + body


def big_headers(w, h):
    """A few bytes of each format that declare w x h."""
    exr = b"\x76\x2f\x31\x01\x02\0\0\0dataWindow\0box2i\0" + struct.pack("<iiiii", 16, 0, 0, w - 1, h - 1)
    vp8x = b"RIFF\0\0\0\0WEBPVP8X\x0a\0\0\0\0\0\0\0" + (w - 1).to_bytes(3, "little") + (h - 1).to_bytes(3, "little")
    return {
        "jpeg": b"\xff\xd8\xff\xe0\0\x04\0\0\xff\xc0\0\x0b\x08" + struct.pack(">HH", h, w) + b"\x01\x01\x11\0",
        "webp": vp8x,
        "tiff": b"II*\0\x08\0\0\0\x02\0" + struct.pack("<HHII", 256, 4, 1, w) + struct.pack("<HHII", 257, 4, 1, h),
        "avif": _box(b"ftyp", b"avif\0\0\0\0") + _box(b"ispe", b"\0\0\0\0" + struct.pack(">II", w, h)),
        "pnm": b"P6\n# note\n%d %d\n255\n" % (w, h),
        "hdr": b"#?RADIANCE\nFORMAT=32-bit_rle_rgbe\n\n-Y %d +X %d\n" % (h, w),
        "openexr": exr,
    }


def test_header_sizes():
    for name, head in big_headers(60_000, 50_000).items():
        assert headers.dims_of(head, name) == (60_000, 50_000), name
        assert headers.dims_of(head[:9], name) is None
    assert headers.dims_of(b"RIFF\0\0\0\0WEBPVP8L\0\0\0\0\x2f" + ((99) | (49 << 14)).to_bytes(4, "little"), "webp") == (100, 50)
    assert headers.dims_of(b"RIFF\0\0\0\0WEBPVP8 \0\0\0\0\0\0\0\x9d\x01\x2a" + struct.pack("<HH", 80, 60), "webp") == (80, 60)
    assert headers.dims_of(b"\0\0\x01\0\x02\0" + bytes([16, 16]) + bytes(14) + bytes([0, 0]) + bytes(14), "ico") == (256, 256)
    assert headers.dims_of(b"", "jpeg") is None and headers.dims_of(b"x" * 50, None) is None


def test_pixel_bombs_and_unreadable_headers_are_not_admitted(spark):
    ext = {"jpeg": "jpg", "webp": "webp", "tiff": "tif", "avif": "avif", "pnm": "ppm", "hdr": "hdr", "openexr": "exr"}
    rows = [(i, f"/in/{n}.{ext[n]}", bytearray(h)) for i, (n, h) in enumerate(big_headers(65_535, 65_535).items())]
    rows += [(50, "/in/short.jpg", bytearray(b"\xff\xd8\xff\xe0")), (51, "/in/fine.png", bytearray(png(2, 2, lambda x, y: (0, 0, 0))))]
    files = spark.createDataFrame(rows, "ord bigint, path string, content binary").withColumn("length", F.length("content").cast("bigint"))
    none = spark.createDataFrame([], "output string")
    got = {r.ord: r.error for r in plan_conversion(files, none, "jpeg", output_dir="/out").collect()}
    assert all(got[i] == "too_many_pixels" for i in range(len(rows) - 2)) and got[50] == "unreadable_header" and got[51] is None


def test_headers_behind_the_first_bytes(spark):
    pixels = b"\x5a" * 2_000_000
    entries = {o: struct.pack(o + "H", 2) + struct.pack(o + "HHII", 256, 4, 1, 70) + struct.pack(o + "HHII", 257, 4, 1, 50) for o in "<>"}
    app = b"\xff\xe2\xff\xff" + bytes(65_533)
    ispe = _box(b"meta", b"\0\0\0\0" + _box(b"iprp", _box(b"ipco", _box(b"ispe", b"\0\0\0\0" + struct.pack(">II", 70, 50)))))
    fake = _box(b"ispe", b"\0\0\0\0" + struct.pack(">II", 9000, 9000))
    contents = {
        "little.tif": b"II*\0" + struct.pack("<I", 8 + len(pixels)) + pixels + entries["<"],
        "big.tif": b"MM\0*" + struct.pack(">I", 8 + len(pixels)) + pixels + entries[">"],
        "segments.jpg": b"\xff\xd8" + app * 20 + b"\xff\xc0\0\x0b\x08" + struct.pack(">HH", 50, 70) + b"\x01\x01\x11\0",
        "late.avif": _box(b"ftyp", b"avif\0\0\0\0") + _box(b"mdat", fake + pixels) + ispe,
        "broken.tif": b"II*\0" + struct.pack("<I", 2**32 - 5) + pixels,
        "cut.tif": b"II*\0" + struct.pack("<I", 8 + len(pixels)) + pixels + entries["<"][:8],
        "broken.jpg": b"\xff\xd8" + app * 20,
    }
    files = spark.createDataFrame([(i, f"/in/{n}", bytearray(c)) for i, (n, c) in enumerate(contents.items())], "ord bigint, path string, content binary")
    files = files.withColumn("length", F.length("content").cast("bigint"))
    rows = plan_conversion(files, spark.createDataFrame([], "output string"), "png", output_dir="/out").collect()
    got = {r.path[4:]: (r.width, r.height, r.error) for r in rows}
    assert got == {n: (None, None, "unreadable_header") if n[:3] in ("bro", "cut") else (70, 50, None) for n in contents}


def test_exif_in_webp_and_heif():
    block = b"II*\0\x08\0\0\0\x01\0" + struct.pack("<HHI", 0x0110, 2, 3) + b"ab\0\0" + b"\0\0\0\0"
    webp = b"RIFF\0\0\0\0WEBPVP8X\x01\0\0\0\0\0EXIF" + struct.pack("<I", len(block)) + block
    heif = _box(b"ftyp", b"heic\0\0\0\0") + _box(b"mdat", b"\0\0\0\x06Exif\0\0" + block)
    want = [("primary", "Model", "ab")]
    assert exif.tags_of(block) == exif.tags_of(webp) == exif.tags_of(heif) == want


def test_replaced_keys_may_move_and_repeat(spark):
    path = f"{shared_dir(spark)}/moved-{uuid.uuid4().hex}"
    rows = lambda *r: spark.createDataFrame(list(r), "output string, target string, ord int, origin string")
    read = lambda: sorted((r.output, r.target, r.origin) for r in spark.read.parquet(path).collect())
    sinks.write_outputs(rows(("a", "png", 1, "one"), ("b", "png", 2, "one"), ("b", "png", 3, "late"), ("c", "gif", 4, "one")), path)
    assert read() == [("a", "png", "one"), ("b", "png", "one"), ("c", "gif", "one")]
    sinks.write_outputs(rows(("a", "jpeg", 1, "first"), ("a", "jpeg", 2, "last"), ("c", "jpeg", 3, "moved")), path, "replace")
    assert read() == [("a", "jpeg", "last"), ("b", "png", "one"), ("c", "jpeg", "moved")]
    sinks.write_outputs(rows(("a", "png", 1, "no")), path, "skip")
    assert len(read()) == 3


def test_a_second_action_does_not_encode_again(spark, tmp_path):
    rows = [(i, f"/in/{i}.png", bytearray(png(2, 2, lambda x, y: (0, 0, 0)))) for i in range(3)]
    files = spark.createDataFrame(rows, "ord bigint, path string, content binary").withColumn("length", F.length("content").cast("bigint"))
    log = str(tmp_path / "log")

    def encode(path, content, output):
        with open(log, "a") as out:
            out.write(path + "\n")
        return 1

    out = run_conversion(files, spark.createDataFrame([], "output string"), "jpeg", encode, output_dir="/out", read_by_path=False)
    assert out.count() == 3 and out.filter("status = 'written'").count() == 3
    with open(log) as lines:
        assert len(lines.readlines()) == 3


def test_split_existing_over_a_hot_name(spark):
    plan = spark.range(100).select(F.col("id").alias("ord"), F.when(F.col("id") < 60, "hot").otherwise(F.col("id").cast("string")).alias("output"))
    skipped, todo = naming.split_existing(plan, spark.createDataFrame([("hot",), ("hot",), ("99",), ("none",)], "output string"))
    assert skipped.count() == 61 and todo.count() == 39 and skipped.columns == plan.columns


def test_workers_import_the_package_from_anywhere(tmp_path):
    code = (
        f"import sys; sys.path.insert(0, {sys.path[0]!r}); sys.path.insert(0, {__file__.rsplit('/tests/', 1)[0]!r})\n"
        "from tileweave.session import local_session\nfrom tileweave.sources import exif\n"
        "s = local_session(1)\ndf = s.createDataFrame([('a', bytearray(b'x'))], 'path string, content binary')\nprint('rows', exif.exif_tags(df).count())"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=180, env={k: v for k, v in __import__("os").environ.items() if k != "PYTHONPATH"})
    assert "rows 0" in done.stdout, done.stderr[-800:]


def test_ranks_and_frames_with_sparse_ids_and_a_hot_key(spark):
    from tileweave.operators import frames, ordering

    rows = spark.range(3000).select(F.abs(F.xxhash64("id")).alias("ord"), F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("naive"))
    got = {r.ord: r.increment_rank for r in ordering.increment_rank(rows).filter("naive = 'hot'").collect()}
    assert [got[o] for o in sorted(got)] == list(range(1, 2001))
    shots = rows.select(F.when(F.col("naive") == "hot", 1).otherwise(2).alias("anim_id"), F.col("ord").alias("seq"), F.lit(4).alias("width"), F.lit(3).alias("height"), F.lit(20).alias("delay_ms"))
    plan = frames.frame_plan(shots).filter("anim_id = 1").orderBy("seq").collect()
    assert [p.frame_no for p in plan] == list(range(1, 2001)) and [p.start_ms for p in plan] == [20 * k for k in range(2000)]


def test_stream_folders_are_compacted(spark, tmp_path, monkeypatch):
    from tileweave.streaming import progress

    monkeypatch.setattr(progress, "COMPACT", 2)
    schema = "job_id bigint, ord bigint, finished_at timestamp, status string, bytes_in bigint, bytes_out bigint, error string"
    for k in range(5):
        row = spark.createDataFrame([(k % 2, k, None, "written", 10, 5, None)], schema).withColumn("finished_at", F.timestamp_seconds(F.lit(1000 + k)))
        row.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = progress.write_summary(progress.stream_summary(stream), str(tmp_path / "out"), str(tmp_path / "state"), availableNow=True)
    query.awaitTermination()
    assert sum(r.done for r in progress.latest_summary(spark, str(tmp_path / "out")).collect()) == 5
    assert len([p for p in (tmp_path / "out").iterdir() if p.name.startswith("batch=")]) <= 3


def test_a_failed_writer_hands_its_output_on(spark):
    rows = [(1, "/in/x.png"), (2, "/in/x.gif"), (3, "/in/x.bmp"), (4, "/in/y.png"), (5, "/in/y.gif")]
    files = spark.createDataFrame([(o, p, bytearray(png(2, 2, lambda x, y: (0, 0, 0)))) for o, p in rows], "ord bigint, path string, content binary")
    files = files.withColumn("length", F.length("content").cast("bigint"))

    def encode(path, content, output):
        if path in ("/in/x.png", "/in/x.gif", "/in/y.png", "/in/y.gif"):
            raise OSError("disk")
        return 7

    out = run_conversion(files, spark.createDataFrame([], "output string"), "jpeg", encode, output_dir="/out", read_by_path=False)
    assert {r.ord: r.status for r in out.collect()} == {1: "failed", 2: "failed", 3: "written", 4: "failed", 5: "failed"}
