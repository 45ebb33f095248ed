"""Queries on file headers: sizes of all formats, from columns and from ranges of real files, and tags in item trees."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tileweave.operators.admission import hash_ok
from tileweave.plans import operations as ops
from tileweave.session import shared_dir, spread
from tileweave.sources import datasource, digests, exif, files as fl, headers, sinks
from tileweave.sources.formats import sniff_format

from . import views as v
from .registry import query
from .views import with_views

_PAD = 66_000


def _be(value, n):
    return F.lpad(F.hex(value.cast("bigint")), 2 * n, "0")


def _le(value, n):
    h = _be(value, n)
    return F.concat(*[F.substring(h, 2 * n - 2 * i - 1, 2) for i in range(n)])


def _text(*parts):
    return F.hex(F.encode(F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]), "UTF-8"))


# What the files below say of themselves, by key % 15.
_HEADS = """heads AS (
  SELECT s_suppkey AS k, s_suppkey % 15 AS f, 1 + s_suppkey * 37 % 3000 AS w, 1 + s_suppkey * 53 % 2000 AS h,
    ['png', 'gif', 'bmp', 'qoi', 'jpeg', 'webp', 'tiff', 'avif', 'ico', 'pnm', 'hdr', 'openexr', 'tga', 'tiff', 'png'][s_suppkey % 15 + 1] AS format
  FROM supplier)"""
_SIDES = """format, CASE WHEN f > 12 THEN -1 WHEN f = 8 THEN k % 255 + 1 ELSE w END AS width, CASE WHEN f > 12 THEN -1 WHEN f = 8 THEN k % 99 + 1 ELSE h END AS height"""


def _heads(spark, d):
    """One file per supplier, in 13 formats with 66 KB of pixels; then TIFFs whose directory is cut, and no images at all."""
    k = F.col("s_suppkey").cast("bigint")
    w, h, pad = 1 + k * 37 % 3000, 1 + k * 53 % 2000, F.repeat(F.lit("5A"), _PAD)

    def entry(tag, value):
        return F.concat(F.lit(tag + "0400" "01000000"), _le(value, 4))

    def sized(a, b):
        return F.concat(F.lit("00000014" "69737065" "00000000"), _be(a, 4), _be(b, 4))

    directory = F.concat(F.lit("0200"), entry("0001", w), entry("0101", h))
    tiff = F.concat(F.lit("49492A00"), _le(F.lit(_PAD + 8), 4), pad)
    # The primary item owns the second size; the first belongs to something larger.
    tree = F.concat(
        F.lit("00000066" "6D657461" "00000000" "0000000E" "7069746D" "00000000" "0001" "0000004C" "69707270" "00000030" "6970636F"),
        sized(F.lit(9000), F.lit(9000)), sized(w, h), F.lit("00000014" "69706D61" "00000000" "00000001" "0001" "01" "82"),
    )
    forms = [
        F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), _be(w, 4), _be(h, 4), pad),
        F.concat(F.lit("474946383961"), _le(w, 2), _le(h, 2), pad),
        F.concat(F.lit("424D" + "00" * 12 + "28000000"), _le(w, 4), _le(F.pmod(-h, F.lit(4294967296)), 4), pad),
        F.concat(F.lit("716F6966"), _be(w, 4), _be(h, 4), F.lit("0300"), pad),
        F.concat(F.lit("FFD8FFE2FFFF"), F.repeat(F.lit("00"), 65_533), F.lit("FFC0000B08"), _be(h, 2), _be(w, 2), F.lit("01011100")),
        F.concat(F.lit("52494646" "00000000" "57454250" "56503858" "0A000000" "00000000"), _le(w - 1, 3), _le(h - 1, 3), pad),
        F.concat(tiff, directory, F.lit("00000000")),
        F.concat(F.lit("00000010" "66747970" "61766966" "00000000" "000101D8" "6D646174"), F.repeat(F.lit("5A"), 66_000), tree),
        F.concat(F.lit("00000100" "0200" "0101" + "00" * 14), _be(k % 255 + 1, 1), _be(k % 99 + 1, 1), F.lit("00" * 14), pad),
        F.concat(_text("P6\n# ", F.repeat(F.lit("note "), 1000), "\n", w, " ", h, "\n255\n"), pad),
        F.concat(_text("#?RADIANCE\nFORMAT=32-bit_rle_rgbe\n\n-Y ", h, " +X ", w, "\n"), pad),
        F.concat(
            F.lit("762F310102000000"), _text("compression"), F.lit("00"), _text("compression"), F.lit("00" "01000000" "03"), _text("dataWindow"), F.lit("00"), _text("box2i"),
            F.lit("00" "10000000" "FBFFFFFF" "00000000"), _le(F.pmod(w - 6, F.lit(4294967296)), 4), _le(h - 1, 4), pad,
        ),
        F.concat(F.lit("000002" "0000000000" "00000000"), _le(w, 2), _le(h, 2), F.lit("1800"), pad),
        F.concat(tiff, F.substring(directory, 1, 40)),
    ]
    kind = k % 15
    content = F.unhex(v._pick(kind, forms, F.lit("00112233")))
    ending = F.when(kind == 12, ".tga").when(kind == 14, ".png").otherwise(".img")
    rows = v.table(spark, d, "supplier").select(k.alias("ord"), F.concat(F.lit("f"), k.cast("string"), ending).alias("name"), content.alias("content"))
    return rows.withColumn("path", F.concat(F.lit("/in/"), "name"))


def _or(name):
    return F.coalesce(F.col(name), F.lit(-1)).cast("bigint").alias(name)


@query("header_sizes", with_views(f"SELECT k AS ord, {_SIDES} FROM heads", _HEADS))
def header_sizes(spark, d):
    """From a column of contents."""
    sized = headers.with_dims(sniff_format(_heads(spark, d), name="source_format"))
    return sized.select("ord", F.col("source_format").alias("format"), _or("width"), _or("height"))


def _write(spark, rows):
    folder = f"{shared_dir(spark)}/heads-{uuid.uuid4().hex}"
    outcomes = sinks.export_files(rows.withColumn("output", F.concat(F.lit(f"{folder}/"), "name")))
    outcomes.groupBy("status").count().collect()
    return folder


@query("ranged_headers", with_views(f"SELECT concat('f', k, CASE f WHEN 12 THEN '.tga' WHEN 14 THEN '.png' ELSE '.img' END) AS name, {_SIDES}, f < 14 AS long, true AS few_read FROM heads", _HEADS))
def ranged_headers(spark, d):
    """From files, by a source that reads ranges: at most 8 KB of each, wherever the header ends."""
    rows = datasource.scan_headers(spark, _write(spark, _heads(spark, d)))
    return fl.with_file_name(rows).select(
        "name", F.col("source_format").alias("format"), _or("width"), _or("height"), (F.col("length") > 60_000).alias("long"), (F.col("n_read") <= 8192).alias("few_read")
    )


@query(
    "ranged_plan",
    with_views(
        """SELECT k AS ord, CASE WHEN f < 13 THEN '-' ELSE 'unreadable_header' END AS error, concat('_', 1 + k % 700, '.jpg') AS ending,
        CASE WHEN f > 12 THEN -1 ELSE greatest(1, CASE WHEN width >= height THEN e ELSE width * e // height END) END AS out_width,
        CASE WHEN f > 12 THEN -1 ELSE greatest(1, CASE WHEN width >= height THEN height * e // width ELSE e END) END AS out_height
        FROM (SELECT *, least(1 + k % 700, greatest(width, height)) AS e FROM (SELECT k, f, """ + _SIDES + """ FROM heads))""",
        _HEADS,
    ),
)
def ranged_plan(spark, d):
    """A batch planned from a listing: names and sizes of every file, no content in the plan."""
    rows = _heads(spark, d)
    folder = _write(spark, rows)
    # The listing gives lengths; keys come back by name.
    listed = fl.with_file_name(fl.scan_files(spark, folder).select("path", "length")).join(rows.select("ord", "name"), "name").drop("name")
    none = v.table(spark, d, "documents").filter("doc_id < 0").selectExpr("text AS output")
    plan = ops.plan(ops.resize(max_edge=1 + F.col("ord") % 700, target="jpeg"), listed, none, output_dir="/out")
    side = lambda c: F.when(F.col("error").isNull(), F.col(c)).otherwise(-1).cast("bigint").alias(c)
    return plan.select("ord", F.coalesce("error", F.lit("-")).alias("error"), F.regexp_extract("output", r"(_[^_]*)$", 1).alias("ending"), side("out_width"), side("out_height"))


_TURNS = """['row 0 at top and column 0 at left', 'row 0 at top and column 0 at right', 'row 0 at bottom and column 0 at right', 'row 0 at bottom and column 0 at left',
  'row 0 at left and column 0 at top', 'row 0 at right and column 0 at top', 'row 0 at right and column 0 at bottom', 'row 0 at left and column 0 at bottom']"""


@query(
    "exif_items",
    f"""WITH c AS (SELECT c_custkey AS k, concat('c', c_custkey) AS path FROM customer WHERE c_custkey % 4 < 3)
    SELECT path, 'Model' AS tag, concat('M', k % 7) AS value, concat('M', k % 7) AS display, CAST(0 AS BIGINT) AS seq FROM c
    UNION ALL SELECT path, 'Orientation', CAST(k % 9 AS VARCHAR), coalesce({_TURNS}[nullif(k % 9, 0)], '0'), 1 FROM c
    UNION ALL SELECT path, 'GPSAltitudeRef', CAST(k % 2 AS VARCHAR), CASE k % 2 WHEN 0 THEN 'above sea level' ELSE 'below sea level' END, 2 FROM c
    UNION ALL SELECT path, 'GPSAltitude', concat(k % 500, '/2'), concat(k % 500 // 2, CASE WHEN k % 500 % 2 = 1 THEN '.5' ELSE '' END, ' m ', CASE k % 2 WHEN 0 THEN 'above' ELSE 'below' END, ' sea level'), 3 FROM c""",
)
def exif_items(spark, d):
    """HEIF item trees: header offsets of 0 and 6, a marker or none; in one extent, in two out of order, or inside the tree."""
    k = F.col("c_custkey").cast("bigint")

    def size(h):
        return (F.length(h) / 2).cast("bigint")

    block = F.concat(
        F.lit("49492A0008000000" "0300" "1001" "0200" "03000000" "4D"), F.hex(48 + k % 7), F.lit("0000" "1201" "0300" "01000000"), _le(k % 9, 4), F.lit("2588" "0400" "01000000" "32000000" "00000000"),
        F.lit("0200" "0500" "0100" "01000000"), _le(k % 2, 4), F.lit("0600" "0500" "01000000" "50000000" "00000000"), _le(k % 500, 4), F.lit("02000000"),
    )
    lead = v._pick(k % 4, [F.lit("00000000"), F.lit("00000006457869660000")], F.lit("00000000457869660000"))
    item = F.concat(lead, block)
    place = (k / 4).cast("bigint") % 3
    info = F.concat(F.lit("00000023" "69696E66" "00000000" "0001" "00000015" "696E6665" "02000000" "0001" "0000"), F.when(k % 4 < 3, "45786966").otherwise("6D696D65"), F.lit("00"))
    inner = F.when(place == 2, F.concat(_be(size(item) + 8, 4), F.lit("69646174"), item)).otherwise(F.lit(""))
    width = F.when(place == 1, 40).otherwise(32)
    # The extents start behind the boxes before them.
    data = 16 + 12 + 35 + width + size(inner) + 8
    extents = (
        F.when(place == 0, F.concat(F.lit("0001"), _be(data, 4), _be(size(item), 4)))
        .when(place == 1, F.concat(F.lit("0002"), _be(data + size(item) - 10, 4), _be(F.lit(10), 4), _be(data, 4), _be(size(item) - 10, 4)))
        .otherwise(F.concat(F.lit("0001" "00000000"), _be(size(item), 4)))
    )
    location = F.concat(_be(width, 4), F.lit("696C6F63" "01000000" "4400" "0001" "0001"), F.when(place == 2, "0001").otherwise("0000"), F.lit("0000"), extents)
    meta = F.concat(_be(12 + 35 + width + size(inner), 4), F.lit("6D657461" "00000000"), info, location, inner)
    body = F.when(place == 0, item).when(place == 1, F.concat(F.substring(item, F.lit(21), F.length(item)), F.substring(item, 1, 20))).otherwise(F.lit("5A5A"))
    content = F.unhex(F.concat(F.lit("00000010" "66747970" "68656963" "00000000"), meta, _be(size(body) + 8, 4), F.lit("6D646174"), body))
    files = v.table(spark, d, "customer").select(F.concat(F.lit("c"), k.cast("string")).alias("path"), content.alias("content"))
    return exif.exif_tags(files).select("path", "tag", "value", "display", "seq")


@query(
    "hash_files",
    """WITH f AS (SELECT s_suppkey AS k, repeat(concat(s_name, '-', s_suppkey, ';'), 1 + s_suppkey % 50 * 40) AS t FROM supplier)
    SELECT concat('h', k, '.bin') AS name, sha256(t) AS sha256, octet_length(encode(t)) AS n_hashed, k % 4 > 0 AS ok, sha256(unhex(sha256(t))) AS tree_sha256, 1 AS n_parts FROM f""",
)
def hash_files(spark, d):
    """Files digested in chunks by the tasks that read them, against claims of which every fourth is wrong."""
    k = F.col("s_suppkey")
    text = F.expr("repeat(concat(s_name, '-', s_suppkey, ';'), cast(1 + s_suppkey % 50 * 40 as int))")
    rows = v.table(spark, d, "supplier").select(
        k.cast("bigint").alias("ord"), F.concat(F.lit("h"), k.cast("string"), F.lit(".bin")).alias("name"), text.cast("binary").alias("content"),
        F.when(k % 4 > 0, F.upper(F.sha2(text, 256))).otherwise("00").alias("claimed"),
    )
    listed = fl.scan_files(spark, _write(spark, rows.drop("claimed"))).select("path", "length")
    hashed = digests.with_sha256(spread(listed)).join(digests.tree_digests(listed), "path")
    named = fl.with_file_name(hashed).join(rows.select("name", "claimed"), "name")
    return named.select("name", "sha256", "n_hashed", hash_ok("sha256", "claimed").alias("ok"), "tree_sha256", "n_parts")
