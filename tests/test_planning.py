import pytest
from pyspark.sql import functions as F

from tileweave.functions import binary, encoding as enc, geometry as geo, text as tx, validation as val
from tileweave.functions import paths as pth
from tileweave.operators import admission as adm, audit, frames as fr, stats, tone
from tileweave.sources import formats as fm, presets as ps
from tests.conftest import png


@pytest.fixture(scope="module")
def value(spark):
    one = spark.range(1)

    def get(column):
        v = one.select(column.alias("v")).first()[0]
        return tuple(v) if hasattr(v, "asDict") else v

    return get


def test_sizes(value):
    assert value(geo.dims_max_edge(400, 200, 100)) == (100, 50)
    assert value(geo.dims_max_edge(40, 25, 100)) == (40, 25)
    assert value(geo.dims_max_edge(200, 400, 100)) == (50, 100)
    assert value(geo.dims_max_edge(10000, 1, 100)) == (100, 1)
    assert value(geo.dims_max_edge(3, 2, 0)) == (1, 1)
    assert value(geo.dims_fit(400, 100, 200, 200)) == (200, 50)
    assert value(geo.dims_fit(10, 5, 100, 100)) == (100, 50)
    assert value(geo.dims_percent(40, 25, 100.0)) == (40, 25)
    assert value(geo.dims_percent(5, 3, 50.0)) == (3, 2)  # halves go up
    assert value(geo.dims_percent(1, 1, 0.1)) == (1, 1)
    assert value(geo.dims_upscale(40, 25, 3)) == (120, 75)
    assert value(geo.dims_preview(2000, 1000)) == (800, 400, 0.4)
    assert value(geo.dims_preview(300, 200)) == (300, 200, 1.0)
    assert value(geo.dims_thumb(1920, 1080)) == (80, 45)
    assert value(geo.dims_exact(7, 9)) == (7, 9)


def test_rectangles(value):
    assert value(geo.default_crop(100, 60)) == (25, 15, 50, 30)
    assert value(geo.default_crop(1, 1)) == (0, 0, 1, 1)
    assert value(geo.scale_rect(500, 250, 1000, 500, 0.4)) == (200, 100, 400, 200)
    assert value(geo.scale_rect(0, 0, 1, 1, 0.1)) == (0, 0, 1, 1)
    assert value(geo.contain_fit(800, 600, 400, 400)) == (1.5, 100.0, 0.0)
    assert value(geo.contain_fit(0, 600, 400, 400)) == (1.0, 0.0, 0.0)
    assert value(geo.letterbox(120, 80, 60, 40)) == (60, 40, 0, 0)
    assert value(geo.letterbox(30, 20, 60, 40)) == (30, 20, 15, 10)
    assert value(geo.aspect_ratio(1920, 1080)) == "16:9"
    assert value(geo.aspect_ratio(0, 10)) is None
    assert value(geo.megapixels(100, 100)) is None
    assert value(geo.megapixels(4000, 3000)) == 12.0
    assert value(geo.aspect_ratio(F.lit(2971215073), F.lit(1836311903))) == "2971215073:1836311903"  # worst case for Euclid


def test_a_scaled_rectangle_can_overhang(value):
    x, y, w, h = value(geo.scale_rect(1, 0, 2, 2, 0.5))
    assert (x, y, w, h) == (1, 0, 1, 1)
    assert value(val.validate_crop(1, 0, 1, 1, 1, 1)) == "outside_image"


def test_caps_are_inclusive(value):
    assert value(val.admit(F.lit(1 << 30), 10, 10)) is None
    assert value(val.admit(F.lit((1 << 30) + 1), 99999, 99999)) == "too_many_bytes"
    assert value(val.admit(F.lit(1), 16384, 16384)) is None
    assert value(val.admit(F.lit(1), 16384, 16385)) == "too_many_pixels"


def test_validation(value):
    nan, inf = float("nan"), float("inf")
    assert value(val.validate_adjust(F.lit(-100), F.lit(100.0), F.lit(-100.0), F.lit(0.1))) is None
    assert value(val.validate_adjust(F.lit(101), F.lit(nan), F.lit(0.0), F.lit(1.0))) == "brightness_out_of_range"
    assert value(val.validate_adjust(F.lit(0), F.lit(nan), F.lit(0.0), F.lit(1.0))) == "contrast_out_of_range"
    assert value(val.validate_adjust(F.lit(0), F.lit(0.0), F.lit(-inf), F.lit(1.0))) == "saturation_out_of_range"
    assert value(val.validate_adjust(F.lit(0), F.lit(0.0), F.lit(0.0), F.lit(10.01))) == "gamma_out_of_range"
    assert value(val.validate_resize_percent(10, 10, F.lit(1000.0))) is None
    for bad in (0.0, -1.0, 1000.5, nan, inf):
        assert value(val.validate_resize_percent(10, 10, F.lit(bad))) == "percent_out_of_range"
    assert value(val.validate_resize_box(0, 5, 1, 1)) == "zero_source"
    assert value(val.validate_crop(F.lit(4294967295), F.lit(0), F.lit(1), F.lit(1), F.lit(5), F.lit(5))) == "overflow_x"
    assert value(val.validate_quality(F.lit(0))) == "quality_out_of_range"
    assert value(val.validate_quality(F.lit(None).cast("int"))) is None
    assert value(val.validate_upscale(F.lit(5))) == "factor_out_of_range"


def test_check_order_decides(value):
    bad, wrong, yes = F.lit("bad"), F.lit("wrong"), F.lit(True)

    def outcome(op, decode=None, params=None, policy="skip"):
        none = F.lit(None).cast("string")
        return value(audit.decide_outcome(op, none if decode is None else decode, none if params is None else params, yes, policy))[:2]

    assert outcome("convert", bad) == ("skipped", None)
    assert outcome("resize", bad) == ("failed", "decode")
    assert outcome("resize", None, wrong) == ("skipped", None)
    assert outcome("crop", None, wrong) == ("failed", "invalid_input")
    assert outcome("adjust", bad, wrong) == ("failed", "invalid_input")
    assert outcome("rotate", None, None, "replace") == ("written", None)


def test_encoder_settings(value):
    none = F.lit(None).cast("int")
    assert value(enc.encode_settings(F.lit("jpeg"), none, F.lit(False)))[0] == 75
    assert value(enc.encode_settings(F.lit("avif"), none, F.lit(False)))[:2] == (80, 8)
    assert value(enc.encode_settings(F.lit("avif"), none, F.lit(True), F.lit(10)))[1] == 4
    assert value(enc.encode_settings(F.lit("avif"), none, F.lit(True), F.lit(2)))[1] == 2
    assert value(enc.encode_settings(F.lit("png"), none, F.lit(True))) == (None, None, "best", "adaptive")
    assert value(enc.encode_settings(F.lit("webp"), F.lit(50), F.lit(True))) == (None, None, None, None)
    assert value(enc.target_layout(F.lit("jpeg"), none, F.lit(False))) == "source"
    assert value(enc.web_preset()) == (85, True, True, True, 8)
    assert value(enc.bits_per_channel(F.lit(24))) == "8"
    assert value(enc.bits_per_channel(F.lit(18))) == "16"


def test_text(value):
    assert value(tx.format_size(F.lit(12))) == "12 B"
    assert value(tx.format_size(F.lit(456 * 1024))) == "456 KB"
    assert value(tx.format_size(F.lit(int(1.25 * 1024**2)))) == "1.2 MB"  # ties to even
    assert value(tx.format_size(F.lit(int(1.75 * 1024**3)))) == "1.8 GB"
    assert value(tx.format_bytes(F.lit(1536))) == "1.5 KB (1536 bytes)"
    assert value(tx.format_bytes(F.lit(5 * 1024**4))) == f"5120.0 GB ({5 * 1024**4} bytes)"
    assert value(tx.format_duration(F.lit(0.44))) == "0.4 s"
    assert value(tx.format_duration(F.lit(12.0))) == "12 s"
    assert value(tx.format_duration(F.lit(83.0))) == "1 min 23 s"
    assert value(tx.format_duration(F.lit(119.7))) == "1 min 60 s"
    assert value(tx.format_duration(F.lit(7500.0))) == "2h 5min"
    assert value(tx.size_delta(F.lit(0), F.lit(5))) == ""
    assert value(tx.size_delta(F.lit(1000), F.lit(1004))) == "≈ mesmo tamanho"
    assert value(tx.size_delta(F.lit(100), F.lit(17))) == "−83%"
    assert value(tx.size_delta(F.lit(100), F.lit(104))) == "+4%"
    assert value(tx.files_label(F.lit("a.png"), F.lit(3))) == "a.png +2 outros"
    assert value(tx.files_label(F.lit("a.png"), F.lit(0))) == "—"


def test_geometry_text(value):
    assert value(tx.parse_geometry(F.lit("1920x1080"))) == (1920, 1080)
    assert value(tx.parse_geometry(F.lit("5X+7"))) == (5, 7)
    assert value(tx.parse_geometry(F.lit("0x4294967295"))) == (0, 4294967295)
    for bad in ("1920", "x5", "5x", "1x2x3", "-1x5", "1x4294967296", " 1x2", "1x99999999999999999999999999999999999999999"):
        assert value(tx.parse_geometry(F.lit(bad))) is None, bad
    assert value(tx.parse_crop(F.lit("100x50+10+20"))) == (10, 20, 100, 50)
    assert value(tx.parse_crop(F.lit("100x50+10++20"))) == (10, 20, 100, 50)
    for bad in ("100x50", "100x50+1", "+1x2+3+4", "1x2+-3+4"):
        assert value(tx.parse_crop(F.lit(bad))) is None, bad


def test_formats_round_trip(spark):
    listed = fm.formats(spark)
    assert listed.count() == 13
    parsed = fm.parse_format(listed.withColumnRenamed("format", "want"), F.upper("extension"))
    assert parsed.filter("want <> format OR format IS NULL").count() == 0
    odd = spark.createDataFrame([(" Tiff ",), ("xyz",), ("openexr",), ("jpe",)], "s string")
    assert [r.format for r in fm.parse_format(odd, "s").select("s", "format").collect()] == ["tiff", None, "openexr", "jpeg"]


def test_sniffing(spark):
    rows = [
        ("/a/real.png-chunking-3510624803-2-0", png(8, 4, lambda x, y: (1, 2, 3)), "png", (8, 4)),
        ("/a/not-an-image.png", b"garbage", "png", None), ("/a/x.tga", b"\0\0", "tga", None), ("/a/x", b"DDS \0", None, None),
        ("/a/y.jpg", b"DDS \0", None, None), ("/a/z", b"RIFF\0\0\0\0WEBPVP8 ", "webp", None), ("/a/q.dat", b"", None, None),
    ]
    df = spark.createDataFrame([(p, bytearray(c)) for p, c, _, _ in rows], "path string, content binary")
    got = {r.path: (r.format, tuple(r.d) if r.d else None) for r in fm.sniff_format(df).withColumn("d", binary.read_dims("content")).collect()}
    assert got == {p: (f, d) for p, _, f, d in rows}


def test_presets(spark):
    table = ps.presets(spark)
    assert table.count() == 28 and table.select("preset_id").distinct().count() == 28
    order = [r.group for r in stats.groups_in_order(table, "preset_group", "preset_ord").collect()]
    assert order == ["convert", "resize", "rotate", "flip", "adjust", "web"]


def test_preset_suffixes_are_those_of_the_naming_functions(spark):
    zero = F.lit(0)
    tag = tone.adjust_tag(F.coalesce("brightness", zero), F.coalesce("contrast", zero), F.coalesce("saturation", zero), F.lit(1.0))
    want = (
        F.when(F.col("percent").isNotNull(), pth.percent_suffix("percent"))
        .when(F.col("fit").isNotNull(), pth.fit_suffix("fit", "fit"))
        .when(F.col("op") == "rotate", pth.rotate_suffix("degrees"))
        .when(F.col("op") == "flip", pth.flip_suffix("axis"))
        .when(F.col("op") == "adjust", F.concat(F.lit("_"), tag))
        .otherwise("")
    )
    table = ps.presets(spark)
    assert table.filter(want != F.col("suffix")).count() == 0
    exploded = spark.range(1).select(F.inline(ps.preset_array())).select(*table.columns)
    assert sorted(map(repr, exploded.collect())) == sorted(map(repr, table.collect()))


def test_admission(value):
    assert value(adm.license_ok(F.lit("MIT"))) and not value(adm.license_ok(F.lit("mit")))
    assert not value(adm.license_ok(F.lit(None).cast("string")))
    cap = 16 * 1024 * 1024
    assert value(adm.size_ok(F.lit(cap + 5), F.lit(5))) and not value(adm.size_ok(F.lit(cap + 6), F.lit(5)))
    digest = "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    assert value(binary.sha256_hex(F.lit(b"abc"))) == digest
    assert value(adm.hash_ok(F.lit(digest), F.lit(digest.upper())))
    assert not value(adm.hash_ok(F.lit(None).cast("string"), F.lit(digest)))


def test_frames(spark):
    frames = spark.createDataFrame(
        [(1, 10, 60, 40, 5), (1, 20, 120, 80, 50), (1, 30, 30, 20, 100), (2, 1, 16, 16, 20)],
        "anim_id int, seq bigint, width int, height int, delay_ms int",
    )
    for blocks in (1, 3, None):
        rows = fr.frame_plan(frames, blocks=blocks).orderBy("anim_id", "seq").collect()
        got = [(r.frame_no, r.delay_ms, r.start_ms, r.canvas_width, r.canvas_height, r.scaled_width, r.scaled_height, r.dx, r.dy) for r in rows]
        assert got == [
            (1, 10, 0, 60, 40, 60, 40, 0, 0), (2, 50, 10, 60, 40, 60, 40, 0, 0), (3, 100, 60, 60, 40, 30, 20, 15, 10),
            (1, 20, 0, 16, 16, 16, 16, 0, 0),
        ]


def test_loops(value):
    assert value(fr.loop_plan(F.lit(0), F.lit(-5))) == ("infinite", None, 1)
    assert value(fr.loop_plan(F.lit(1), F.lit(10))) == ("once", 0, 10)
    assert value(fr.loop_plan(F.lit(7), F.lit(99))) == ("finite", 7, 30)


def test_batch_reports(spark):
    schema = "ord bigint, status string, bytes_in bigint, bytes_out bigint, error string"
    rows = [(3, "failed", 10, None, "c"), (1, "written", 100, 40, None), (2, "failed", None, None, "b"), (4, "skipped", 30, None, None)]
    df = spark.createDataFrame(rows, schema)
    s = stats.batch_averages(stats.batch_summary(df)).first()
    assert (s.ok, s.skip, s.fail, s.bytes_in, s.bytes_out, s.avg_in, s.avg_out) == (1, 1, 2, 140, 40, 140, 40)
    assert stats.first_error(df).first().first_error == "b"
    assert stats.exit_code(df).first().exit_code == 2
    empty = df.filter("false")
    s = stats.batch_averages(stats.batch_summary(empty)).first()
    assert (s.ok, s.bytes_in, s.avg_in) == (0, 0, None)
    assert stats.exit_code(empty).first().exit_code == 0
