import os
import struct

import pytest
from pyspark.sql import functions as F

from tests.conftest import png
from tests.test_robustness import _box, big_headers
from tileweave.operators import metadata as md
from tileweave.plans import operations as ops
from tileweave.sources import datasource, exif, files as fl, headers, ranges

PIXELS = b"\x5a" * 2_000_000


def directory(*sides):
    return struct.pack("<H", 2) + struct.pack("<HHII", 256, 4, 1, sides[0]) + struct.pack("<HHII", 257, 4, 1, sides[1]) + bytes(4)


def block(*entries, order=">"):
    """A TIFF block of short entries."""
    head = (b"MM\0*" if order == ">" else b"II*\0") + struct.pack(order + "IH", 8, len(entries))
    return head + b"".join(struct.pack(order + "HHIHH", tag, 3, 1, value, 0) for tag, value in entries) + bytes(4)


def heif(item, extents=None, method=0, kind=b"Exif", wide=2, version=1, name=b"heic", cut=0):
    """A file with one item; ``extents`` are pieces of it in the order in which they are stored."""
    number = lambda v: v.to_bytes(wide, "big")
    infe = _box(b"infe", bytes([2 if wide == 2 else 3, 0, 0, 0]) + number(7) + b"\0\0" + kind + b"\0")
    iinf = _box(b"iinf", bytes(4) + b"\0\1" + infe)
    pieces = extents or [(0, len(item))]
    idat = _box(b"idat", item) if method == 1 else b""
    stored = b"".join(item[a:b] for a, b in pieces)

    def iloc(start):
        at, places = start, {}
        for a, b in pieces:
            places[a], at = (at, b - a), at + b - a
        rows = b"".join(struct.pack(">II", *places[a]) for a, _ in sorted(pieces))
        entry = number(7) + (struct.pack(">H", method) if version else b"") + b"\0\0" + struct.pack(">H", len(pieces)) + rows
        return _box(b"iloc", bytes([version, 0, 0, 0]) + b"\x44\0" + (1).to_bytes(4 if version == 2 else 2, "big") + entry)

    ftyp = _box(b"ftyp", name + bytes(4))
    size = len(_box(b"meta", bytes(4) + iinf + iloc(0) + idat))
    tree = _box(b"meta", bytes(4) + iinf + iloc(0 if method == 1 else len(ftyp) + size + 8) + idat)
    return ftyp + tree + _box(b"mdat", b"" if method == 1 else stored)[: None if not cut else -cut]


@pytest.fixture()
def folder(tmp_path):
    contents = {
        "late.tif": b"II*\0" + struct.pack("<I", 8 + len(PIXELS)) + PIXELS + directory(70, 50),
        "long.jpg": b"\xff\xd8" + (b"\xff\xe2\xff\xff" + bytes(65_533)) * 20 + b"\xff\xc0\0\x0b\x08" + struct.pack(">HH", 50, 70) + b"\x01\x01\x11\0",
        "late.avif": _box(b"ftyp", b"avif\0\0\0\0") + _box(b"mdat", PIXELS) + _box(b"meta", bytes(4) + _box(b"iprp", _box(b"ipco", _box(b"ispe", bytes(4) + struct.pack(">II", 70, 50))))),
        "cut.tif": b"II*\0" + struct.pack("<I", 8 + len(PIXELS)) + PIXELS + directory(70, 50)[:20],
        "small.png": png(7, 5, lambda x, y: (1, 2, 3)), "none.png": b"garbage", "empty.png": b"", "read.me": b"text",
        ".hidden.png": png(1, 1, lambda x, y: (0, 0, 0)), "_part.png": b"x",
    }
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "deep.gif").write_bytes(b"GIF89a\x09\0\x04\0")
    return tmp_path


def test_headers_of_files_in_a_few_kilobytes(spark, folder):
    rows = {os.path.basename(r.path): r for r in datasource.scan_headers(spark, str(folder)).collect()}
    assert set(rows) == {"late.tif", "long.jpg", "late.avif", "cut.tif", "small.png", "none.png", "empty.png", "read.me", "deep.gif"}
    sides = {n: (r.source_format, r.width, r.height) for n, r in rows.items()}
    assert sides["late.tif"] == ("tiff", 70, 50) and sides["long.jpg"] == ("jpeg", 70, 50) and sides["late.avif"] == ("avif", 70, 50)
    assert sides["cut.tif"] == ("tiff", None, None) and sides["small.png"] == ("png", 7, 5) and sides["deep.gif"] == ("gif", 9, 4)
    assert sides["none.png"] == ("png", None, None) and sides["empty.png"] == ("png", None, None) and sides["read.me"] == (None, None, None)
    assert rows["late.tif"].length > 2_000_000 and rows["late.tif"].n_read <= 4096 and rows["late.avif"].n_read <= 6144
    assert rows["long.jpg"].n_read <= 2048 + 21 * 2048 and all(r.read_error is None for r in rows.values())
    flat = datasource.scan_headers(spark, f"file:{folder}", recursive=False)
    assert "deep.gif" not in {os.path.basename(r.path) for r in flat.collect()} and all(r.path.startswith("file:/") for r in flat.collect())
    with pytest.raises(Exception, match="missing"):
        datasource.scan_headers(spark, str(folder / "missing")).collect()
    (folder / "bare").mkdir()
    assert datasource.scan_headers(spark, str(folder / "bare")).count() == 0


def test_partitions_hold_files_by_what_their_headers_cost():
    files = [(f"f{i}", 10**9 if i % 2 else 10, None) for i in range(1000)]
    parts = datasource.pack(files, 8)
    assert [f for p in parts for f in p.value] == files and 8 <= len(parts) <= 9
    costs = [sum(datasource.OPEN_COST + min(n, datasource.MOST_READ) for _, n, _ in p.value) for p in parts]
    assert max(costs) <= 1.05 * sum(costs) / 8
    assert len(datasource.pack(files * 50, 1)) > 50 and datasource.pack([], 4) == []


def test_paths_in_a_table(spark, folder):
    paths = spark.createDataFrame([(str(folder / n),) for n in ("late.tif", "gone.png")] + [(None,)], "path string").withColumn("width", F.lit("kept"))
    rows = headers.with_headers(paths.withColumnRenamed("width", "label")).collect()
    by = {os.path.basename(r.path or "null"): r for r in rows}
    assert (by["late.tif"].width, by["late.tif"].label) == (70, "kept")
    assert by["gone.png"].width is None and by["gone.png"].read_error.startswith("io: ") and by["null"].source_format is None


def test_every_format_by_the_same_readers(spark):
    from tileweave.sources.formats import sniff_format

    heads = big_headers(6_000, 5_000) | {
        "png": b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">II", 6000, 5000), "gif": b"GIF87a" + struct.pack("<HH", 6000, 5000),
        "bmp": b"BM" + bytes(12) + b"\x28\0\0\0" + struct.pack("<ii", 6000, -5000), "qoi": b"qoif" + struct.pack(">II", 6000, 5000) + b"\3\0",
        "tga": bytes(12) + struct.pack("<HH", 6000, 5000) + b"\x18\0",
    }
    ext = {"tga": "tga"}
    files = spark.createDataFrame([(f"/in/x.{ext.get(n, 'bin')}", n, bytearray(h)) for n, h in heads.items()], "path string, name string, content binary")
    for r in headers.with_dims(sniff_format(files, name="source_format")).collect():
        assert (r.source_format, r.width, r.height) == (r.name, 6000, 5000)
        assert headers.dims_of(bytes(r.content), r.name) == (6000, 5000) and headers.format_of(bytes(r.content)[:64], r.path) == r.name
        assert headers.dims_of(bytes(r.content)[:9], r.name) is None
    assert headers.dims_of(b"P6\n#" + b"x" * 9000 + b"\n12 34\n255\n", "pnm") == (12, 34)
    assert headers.dims_of(b"P7\nWIDTH 3\nHEIGHT 4\nENDHDR\n", "pnm") == (3, 4) and headers.dims_of(b"P7\nENDHDR\n" + bytes(5000), "pnm") is None
    assert headers.format_of(b"DDS \0", "/a/y.jpg") is None and headers.format_of(b"", "/a/b.JPE") == "jpeg"


def test_the_primary_items_size_counts():
    ispe = [_box(b"ispe", bytes(4) + struct.pack(">II", *s)) for s in ((9000, 9000), (70, 50))]
    ipma = _box(b"ipma", bytes(4) + struct.pack(">IHBB", 1, 3, 1, 0x82))
    tree = lambda links: _box(b"ftyp", b"avif\0\0\0\0") + _box(b"meta", bytes(4) + _box(b"pitm", bytes(4) + b"\0\3") + _box(b"iprp", _box(b"ipco", b"".join(ispe)) + links))
    assert headers.dims_of(tree(ipma), "avif") == (70, 50) and headers.dims_of(tree(b""), "avif") == (9000, 9000)
    wide = _box(b"ipma", b"\1\0\0\1" + struct.pack(">IIBH", 1, 3, 1, 0x8002))
    assert headers.dims_of(tree(wide), "avif") == (70, 50) and headers.dims_of(tree(ipma)[:-1], "avif") is None


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("lead", [b"\0\0\0\0", b"\0\0\0\0Exif\0\0", b"\0\0\0\6Exif\0\0"])
def test_tags_of_item_trees(order, lead):
    item = lead + block((0x0112, 6), (0xA402, 1), order=order)
    want = [("primary", "Orientation", "6"), ("primary", "0xA402", "1")]
    n = len(item)
    for content in (
        heif(item), heif(item, method=1), heif(item, [(9, n), (0, 9)]), heif(item, [(0, 3), (20, n), (3, 20)]), heif(item, wide=4, version=2), heif(item, name=b"avif"), heif(item, version=0),
    ):
        assert exif.tags_of(content) == want
    assert exif.tags_of(heif(item, kind=b"mime")) == []
    with pytest.raises(Exception):
        exif.tags_of(heif(item, cut=20))


def test_a_location_in_a_heif_without_marker_is_seen(spark):
    gps = b"MM\0*\0\0\0\x08\0\1" + struct.pack(">HHII", 0x8825, 4, 1, 26) + bytes(4) + struct.pack(">H", 1) + struct.pack(">HHII", 2, 5, 3, 44) + bytes(4)
    gps += struct.pack(">6I", 48, 1, 30, 1, 0, 1)
    files = spark.createDataFrame([("a", bytearray(heif(bytes(4) + gps)))], "path string, content binary")
    tags = exif.exif_tags(files)
    assert [(r.tag, r.display) for r in tags.collect()] == [("GPSLatitude", "48 deg 30 min 0 sec")]
    assert md.with_tag_flags(files.select("path"), tags).first().has_gps


def test_tags_by_ranges(spark, tmp_path):
    body = block((0x0112, 8), (0x0128, 2))
    (tmp_path / "a.jpg").write_bytes(b"\xff\xd8\xff\xe1" + struct.pack(">H", len(body) + 8) + b"Exif\0\0" + body + b"\xff\xda" + PIXELS)
    (tmp_path / "b.heic").write_bytes(heif(bytes(4) + body) + PIXELS)
    (tmp_path / "c.png").write_bytes(png(2, 2, lambda x, y: (0, 0, 0)))
    (tmp_path / "d.tif").write_bytes(b"II*\0\x08\0\0\0\xff\xff")
    rows = datasource.scan_tags(spark, str(tmp_path)).collect()
    assert sorted((os.path.basename(r.path), r.tag, r.display) for r in rows if r.error is None) == [
        (n, t, s) for n in ("a.jpg", "b.heic") for t, s in (("Orientation", "row 0 at left and column 0 at bottom"), ("ResolutionUnit", "inch"))
    ]
    assert all(r.n_read <= 4096 for r in rows) and [os.path.basename(r.path) for r in rows if r.error] == ["d.tif"]
    listed = fl.scan_files(spark, str(tmp_path)).select("path")
    assert exif.exif_tags(listed, content=None).filter("tag = 'Orientation'").count() == 2


def test_displayed_values():
    tags = [("primary", t, x) for t, x in (
        ("ExposureTime", "1/60"), ("FNumber", "28/10"), ("FocalLength", "50/1"), ("ExposureBiasValue", "-1/3"), ("XResolution", "72/1"), ("ResolutionUnit", "3"), ("GPSLatitude", "1/1, 2/1, 30/4"),
        ("GPSLatitudeRef", "S"), ("GPSAltitude", "5/0"), ("Make", "A/B"), ("MeteringMode", "77"), ("GPSTimeStamp", "7/1, 5/1, 59/2"), ("GPSSpeed", "3/2"), ("GPSSpeedRef", "K"), ("LensModel", ""),
    )]
    assert exif.displayed(tags) == [
        "1/60 s", "f/2.8", "50 mm", "-0.333333 EV", "72 pixels per cm", "cm", "1 deg 2 min 7.5 sec S", "S", "5/0 m", "A/B", "77", "07:05:29.5 UTC", "1.5 km/h", "K", ""
    ]


def test_ranges_read_what_is_asked(tmp_path):
    data = bytes(range(256)) * 4000
    (tmp_path / "x").write_bytes(data)
    with ranges.FileRanges(str(tmp_path / "x")) as d:
        assert d.n_read == 2048 and d.get(5, 10) == data[5:15] and d.n_read == 2048
        assert d.get(500_000, 1500) == data[500_000:501_500] and d.n_read <= 2048 + 3072
        assert d.some(len(data) - 3, 10) == data[-3:] and d.some(-1, 5) == d.some(10**9, 5) == b"" and d.get(0, 900_000) == data[:900_000]
        with pytest.raises(EOFError):
            d.get(len(data) - 3, 4)
        parts = ranges.Slices(d, [(100, 5), (50, 5), (7, 0), (0, 2)])
        assert parts.length == 12 and parts.get(0, 12) == data[100:105] + data[50:55] + data[:2] and parts.get(4, 3) == data[104:105] + data[50:52]
        assert d.find(rb"\xff\0\x01", 300) == 511 and d.find(rb"\xff\x05") == -1


def test_a_plan_without_content(spark, folder):
    listed = fl.scan_files(spark, str(folder)).filter("path LIKE '%late%' OR path LIKE '%cut%'").select("path", "length").withColumn("ord", F.monotonically_increasing_id())
    none = spark.createDataFrame([], "output string")
    made = ops.plan(ops.resize(percent=50.0), listed, none)
    rows = {os.path.basename(r.path): r for r in made.collect()}
    assert (rows["late.tif"].out_width, rows["late.tif"].out_height, rows["late.tif"].status) == (35, 25, None)
    assert rows["late.tif"].output.endswith("/late_50pct.tiff") and rows["cut.tif"].error == "unreadable_header"
    schema = headers.with_headers(listed)._jdf.queryExecution().executedPlan().toString().split("ReadSchema:")[1].splitlines()[0]
    assert "path" in schema and "content" not in schema
    written = ops.run(ops.rotate(180), listed, none, lambda path, content, output: len(content)).collect()
    assert {os.path.basename(r.output): r.bytes_out for r in written if r.status == "written"} == {"late_rot180.tiff": 2_000_038, "late_rot180.avif": os.path.getsize(folder / "late.avif")}
    gone = spark.createDataFrame([(1, str(folder / "gone.png"), 5)], "ord bigint, path string, length bigint")
    assert [(r.status, r.error_kind, r.error) for r in ops.plan(ops.flip("horizontal"), gone, none).collect()] == [("failed", "io", "unreadable_file")]


def test_operations_refuse_what_they_cannot_do():
    for wrong in (lambda: ops.rotate(45), lambda: ops.flip("diagonal"), lambda: ops.resize(), lambda: ops.resize(percent=10, fit=(1, 2))):
        with pytest.raises(ValueError):
            wrong()


def test_upright_files_are_rewritten_and_broken_tags_are_none(spark):
    turned = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">II", 30, 20) + bytes(9) + struct.pack(">I", 26) + b"eXIf" + block((0x0112, 6)) + bytes(4)
    rows = [(1, "/in/a.png", bytearray(turned)), (2, "/in/b.png", bytearray(png(3, 2, lambda x, y: (0, 0, 0)))), (3, "/in/c.png", bytearray(turned[:60]))]
    files = spark.createDataFrame(rows, "ord bigint, path string, content binary").withColumn("length", F.length("content").cast("bigint"))
    none = spark.createDataFrame([], "output string")
    got = {r.ord: (r.output, r.out_width, r.out_height) for r in ops.plan(ops.rotate(), files, none, "replace").collect()}
    assert got == {1: ("/in/a_auto.png", 20, 30), 2: ("/in/b_auto.png", 3, 2), 3: ("/in/c_auto.png", 30, 20)}
    same = ops.plan(ops.convert("png"), files, none, "replace")
    assert {r.error for r in same.collect()} == {"output_is_input"}
    assert {r.error for r in ops.plan(ops.convert("png"), files, none, "replace", in_place=True).collect()} == {None}
