"""Queries on real files, which Spark writes from the given tables into the shared folder first.

256 embeddings at a time become one 64-pixel-wide bitmap, one vector per line, so the number of
files stays proportional to the data and small.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tileweave.operators import pixels as pz, stats
from tileweave.plans import operations as ops, renditions as rn
from tileweave.plans.conversion import run_conversion
from tileweave.session import shared_dir
from tileweave.sources import exif, files as fl, sinks
from tileweave.sources.keyed import KeyedTable

from . import views as v
from .registry import query
from .views import MANIFEST, with_views

_SHEETS = """sheets AS (SELECT vec_id // 256 AS sheet, count(*) AS n FROM embeddings GROUP BY 1)"""


def _le(value, n):
    h = F.lpad(F.hex(value.cast("bigint")), 2 * n, "0")
    return F.concat(*[F.substring(h, 2 * n - 2 * i - 1, 2) for i in range(n)])


def _sheets(spark, d):
    """``ord, output, content``: one bitmap per 256 embeddings, bottom line first as the format wants."""
    def sample(value):
        q = F.least(F.greatest(F.floor((value.cast("double") + 0.5) * 255), F.lit(0)), F.lit(255))
        return F.lpad(F.hex(q), 2, "0")

    def bgr(p):
        return F.concat(*[F.col("_hex")[(p + shift) % 64] for shift in (42, 21, 0)])

    line = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(63)), bgr), ""))
    lines = v.table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 256).cast("bigint").alias("ord"), "vec_id", F.transform("embedding", sample).alias("_hex")).select("ord", "vec_id", line.alias("_line"))
    sheets = lines.groupBy("ord").agg(F.count("*").alias("n"), F.expr("listagg(_line) WITHIN GROUP (ORDER BY vec_id DESC)").alias("_data"))
    size = F.col("n") * 192
    header = F.concat(
        F.lit("424D"), _le(size + 54, 4), F.lit("00000000"), F.lit("36000000"), F.lit("28000000"), F.lit("40000000"), _le(F.col("n"), 4),
        F.lit("0100"), F.lit("1800"), F.lit("00000000"), _le(size, 4), F.lit("00" * 16),
    )
    return sheets.select("ord", F.concat(F.lit("sheet"), F.col("ord").cast("string"), F.lit(".bmp")).alias("name"), F.concat(F.unhex(header), "_data").alias("content"))


def _write_sheets(spark, d):
    folder = f"{shared_dir(spark)}/sheets-{uuid.uuid4().hex}"
    rows = _sheets(spark, d).withColumn("output", F.concat(F.lit(f"{folder}/"), F.col("name")))
    # One more file that is no image, to be listed and refused by the decoder.
    notes = v.table(spark, d, "embeddings").groupBy().agg(F.count("*").alias("n")).select(
        F.lit(-1).cast("bigint").alias("ord"), F.lit("notes.png").alias("name"), F.lit(b"garbage").alias("content"),
        F.lit(f"{folder}/notes.png").alias("output"),
    )
    text = notes.withColumns({"ord": F.lit(-2).cast("bigint"), "output": F.lit(f"{folder}/readme.txt"), "name": F.lit("readme.txt")})
    outcomes = sinks.export_files(rows.unionByName(notes).unionByName(text))
    return folder, outcomes


@query(
    "export_files",
    with_views(
        """SELECT sheet AS ord, concat('sheet', sheet, '.bmp') AS name, 'written' AS status, 54 + 192 * n AS bytes_out FROM sheets
        UNION ALL SELECT -1, 'notes.png', 'written', 7 UNION ALL SELECT -2, 'readme.txt', 'written', 7""",
        _SHEETS,
    ),
)
def export_files(spark, d):
    _, outcomes = _write_sheets(spark, d)
    return fl.with_file_name(outcomes, "output").select("ord", "name", "status", "bytes_out")


@query(
    "scan_files",
    with_views(
        """SELECT concat('sheet', sheet, '.bmp') AS name, 54 + 192 * n AS length FROM sheets
        UNION ALL SELECT 'notes.png', 7 UNION ALL SELECT 'readme.txt', 7""",
        _SHEETS,
    ),
)
def scan_files(spark, d):
    """The action on the outcomes is what writes; the scan afterwards opens no file."""
    folder, outcomes = _write_sheets(spark, d)
    outcomes.groupBy("status").count().collect()
    return fl.with_file_name(fl.scan_files(spark, folder).select("path", "length")).select("name", "length")


@query(
    "list_folder",
    with_views(
        """SELECT row_number() OVER (ORDER BY name) AS place, name FROM (
          SELECT concat('sheet', sheet, '.bmp') AS name FROM sheets UNION ALL SELECT 'notes.png')""",
        _SHEETS,
    ),
)
def list_folder(spark, d):
    from tileweave.operators.ordering import rank_in_blocks, with_range_blocks

    folder, outcomes = _write_sheets(spark, d)
    outcomes.groupBy("status").count().collect()
    listed = with_range_blocks(fl.list_folder(spark, folder).select("path"), ["path"])
    return fl.with_file_name(rank_in_blocks(listed, [], "block", ["path"], rank="place")).select("place", "name")


@query(
    "scan_decoded",
    with_views(
        """SELECT concat('sheet', sheet, '.bmp') AS name, 64 AS width, CAST(n AS INTEGER) AS height, 3 AS channels, 'decoded' AS status FROM sheets
        UNION ALL SELECT 'notes.png', -1, -1, -1, 'failed' UNION ALL SELECT 'readme.txt', -1, -1, -1, 'failed'""",
        _SHEETS,
    ),
)
def scan_decoded(spark, d):
    folder, outcomes = _write_sheets(spark, d)
    outcomes.groupBy("status").count().collect()
    images = fl.with_file_name(fl.scan_decoded(spark, folder), "origin")
    return images.select("name", "width", "height", F.col("nChannels").alias("channels"), "status")


@query(
    "keyed_outputs",
    with_views(
        """SELECT ord AS output, CASE WHEN ord % 12 = 0 THEN 'replaced' WHEN ord % 2 = 0 THEN 'first' ELSE 'second' END AS origin, CASE WHEN ord % 3 = 0 THEN 'jpeg' ELSE 'png' END AS target
        FROM manifest WHERE ord % 15 <> 4""",
        MANIFEST,
    ),
)
def keyed_outputs(spark, d):
    """Even rows, then all that are new, then some replaced and some deleted: deltas of a keyed table, half of its buckets compacted."""
    rows = v.manifest(spark, d).select(F.col("ord").alias("output"), F.when(F.col("ord") % 3 == 0, "jpeg").otherwise("png").alias("target"))
    table = KeyedTable(spark, f"{shared_dir(spark)}/keyed-{uuid.uuid4().hex}", buckets=16)
    table.upsert(rows.filter("output % 2 = 0").withColumn("origin", F.lit("first")))
    table.insert_new(rows.withColumn("origin", F.lit("second")))
    table.compact(set(range(8)))
    table.upsert(rows.filter("output % 12 = 0").withColumn("origin", F.lit("replaced")))
    table.delete(rows.filter("output % 15 = 4"))
    return table.read().select("output", "origin", "target")


_LEVELS = """levels AS (
  SELECT vec_id // 256 AS sheet, p, CAST(least(greatest(floor((CAST(embedding[p + 1] AS DOUBLE) + 0.5e0) * 255), 0), 255) AS INTEGER) AS q
  FROM embeddings, (SELECT unnest(range(0, 64)) AS p))"""


@query(
    "decoded_histogram",
    with_views(
        """SELECT concat('sheet', sheet, '.bmp') AS name, channel, q AS bin, count(*) AS cnt
        FROM levels, (SELECT unnest(['R', 'G', 'B']) AS channel) GROUP BY ALL""",
        _LEVELS,
    ),
)
def decoded_histogram(spark, d):
    """Files to decoded rasters to pixels to histogram. The three channels are rotations of one line."""
    folder, outcomes = _write_sheets(spark, d)
    outcomes.groupBy("status").count().collect()
    rasters = fl.with_file_name(fl.scan_decoded(spark, folder), "origin").filter("status = 'decoded'")
    return stats.histogram(pz.to_pixels(rasters, "name"), "name")


@query(
    "write_outputs",
    with_views(
        """SELECT ord AS output, CASE WHEN ord % 3 = 0 THEN 'jpeg' ELSE 'png' END AS target,
        CASE WHEN ord % 12 = 0 THEN 'replaced' WHEN ord % 2 = 0 THEN 'first' ELSE 'second' END AS origin FROM manifest""",
        MANIFEST,
    ),
)
def write_outputs(spark, d):
    """Even rows are written first; all rows follow under skip; some are then replaced."""
    path = f"{shared_dir(spark)}/outputs-{uuid.uuid4().hex}"
    rows = v.manifest(spark, d).select(F.col("ord").alias("output"), F.when(F.col("ord") % 3 == 0, "jpeg").otherwise("png").alias("target"))
    sinks.write_outputs(rows.filter("output % 2 = 0").withColumn("origin", F.lit("first")), path)
    sinks.write_outputs(rows.withColumn("origin", F.lit("second")), path, "skip")
    sinks.write_outputs(rows.filter("output % 12 = 0").withColumn("origin", F.lit("replaced")), path, "replace")
    return spark.read.parquet(path).select("output", "target", "origin")


@query(
    "exif_tags",
    """SELECT path, ifd, tag, value, CAST(seq AS BIGINT) AS seq FROM (
      SELECT concat('c', c_custkey) AS path, 'primary' AS ifd, 'Make' AS tag, concat('Maker', c_custkey % 7) AS value, 0 AS seq, c_custkey FROM customer
      UNION ALL SELECT concat('c', c_custkey), 'primary', 'Orientation', CAST(c_custkey % 9 AS VARCHAR), 1, c_custkey FROM customer
      UNION ALL SELECT concat('c', c_custkey), 'primary', 'GPSLatitude', concat(c_custkey % 90, '/1, ', c_custkey % 60, '/1, 0/1'), 2, c_custkey FROM customer WHERE c_custkey % 2 = 0)
    WHERE c_custkey % 5 > 1""",
)
def exif_tags(spark, d):
    """Files with EXIF blocks made from customers: TIFF, JPEG and PNG containers, plus ones without EXIF."""
    k = F.col("c_custkey")
    make = F.hex(F.concat(F.lit("Maker"), (k % 7).cast("string")).cast("binary"))

    def entry(tag, kind, count, value):
        return F.concat(F.lit(tag), F.lit(kind), _le(F.lit(count), 4), value)

    has_gps = k % 2 == 0
    # Offsets in the block: first directory at 8; text at 62; GPS directory at 72; its rationals at 90.
    entries = F.concat(
        entry("0F01", "0200", 7, _le(F.lit(62), 4)),
        entry("1201", "0300", 1, F.concat(_le(k % 9, 2), F.lit("0000"))),
        F.when(has_gps, entry("2588", "0400", 1, _le(F.lit(72), 4))).otherwise(F.lit("")),
    )
    head = F.concat(F.lit("49492A0008000000"), F.when(has_gps, "0300").otherwise("0200"), entries, F.lit("00000000"))
    body = F.rpad(F.concat(F.rpad(head, 124, "0"), make), 144, "0")
    rational = F.concat(_le(k % 90, 4), _le(F.lit(1), 4), _le(k % 60, 4), _le(F.lit(1), 4), _le(F.lit(0), 4), _le(F.lit(1), 4))
    gps = F.concat(F.lit("0100"), entry("0200", "0500", 3, _le(F.lit(90), 4)), F.lit("00000000"), rational)
    block = F.concat(body, gps)
    size = F.length(block) / 2
    jpeg = F.concat(F.lit("FFD8FFE1"), F.lpad(F.hex((size + 8).cast("bigint")), 4, "0"), F.lit("457869660000"), block, F.lit("FFD9"))
    png = F.concat(F.lit("89504E470D0A1A0A"), F.lpad(F.hex(size.cast("bigint")), 8, "0"), F.lit("65584966"), block, F.lit("00000000"))
    content = F.unhex(v._pick(k % 5, [F.lit("89504E470D0A1A0A0000000049484452"), F.lit("00FF"), block, jpeg], png))
    files = v.table(spark, d, "customer").select(F.concat(F.lit("c"), k.cast("string")).alias("path"), content.alias("content"))
    return exif.exif_tags(files).select("path", "ifd", "tag", "value", "seq")


@query(
    "run_conversion",
    """WITH named AS (SELECT doc_id, concat('/in/', doc_id % 300, CASE WHEN doc_id % 3 = 0 THEN '.gif' ELSE '.png' END) AS path, concat('/in/', doc_id % 300, '.jpg') AS output,
        doc_id % 4 <> 1 AS sound, (doc_id % 300) % 10 = 0 AS listed, octet_length(encode(text)) AS chars FROM documents),
      ranked AS (SELECT *, row_number() OVER (PARTITION BY output, sound ORDER BY doc_id) AS r FROM named)
    SELECT doc_id AS ord, path AS input, CASE WHEN listed THEN 'skipped' WHEN NOT sound THEN 'failed' WHEN r > 1 THEN 'skipped' ELSE 'written' END AS status,
      CASE WHEN listed OR sound THEN '-' ELSE 'too_many_pixels' END AS error, chars + 24 AS bytes_in,
      CASE WHEN NOT listed AND sound AND r = 1 THEN (chars + 24) // 3 ELSE -1 END AS bytes_out FROM ranked""",
)
def conversion(spark, d):
    """A whole batch: sniff, header sizes, caps, names, skips, then a user encoder over what is left."""
    files, existing = _batch(spark, d, "jpg")
    return _outcome(run_conversion(files, existing, "jpeg", lambda path, content, output: len(content) // 3, read_by_path=False))


def _batch(spark, d, listed_ext):
    k = F.col("doc_id")
    side = F.when(k % 4 == 1, "00010000").otherwise("00000040")
    header = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), side, side)
    ext = F.when(k % 3 == 0, ".gif").otherwise(".png")
    files = v.table(spark, d, "documents").select(
        k.alias("ord"), F.concat(F.lit("/in/"), (k % 300).cast("string"), ext).alias("path"),
        F.concat(F.unhex(header), F.col("text").cast("binary")).alias("content"),
    ).withColumn("length", F.length("content").cast("bigint"))
    existing = v.table(spark, d, "documents").filter("(doc_id % 300) % 10 = 0").select(
        F.concat(F.lit("/in/"), (k % 300).cast("string"), F.lit(f".{listed_ext}")).alias("output")
    )
    return files, existing


def _outcome(out):
    return out.select(
        "ord", "input", "status", F.coalesce("error", F.lit("-")).alias("error"), "bytes_in",
        F.coalesce("bytes_out", F.lit(-1)).alias("bytes_out"),
    )


# The same batch under other operations: checks in their own order, the source's format kept, each with its own suffix.
_OPERATION = """WITH named AS (SELECT doc_id, concat('/in/', doc_id % 300, CASE WHEN doc_id % 3 = 0 THEN '.gif' ELSE '.png' END) AS path, concat('/in/', doc_id % 300, {suffix}, '.png') AS output,
    CASE WHEN doc_id % 4 = 1 THEN 'too_many_pixels' END AS d_error, {params} AS p_error, (doc_id % 300) % 10 = 0 AS listed, octet_length(encode(text)) + 24 AS bytes_in FROM documents),
  ranked AS (SELECT *, d_error IS NULL AND p_error IS NULL AS sound, row_number() OVER (PARTITION BY output, d_error IS NULL AND p_error IS NULL ORDER BY doc_id) AS r FROM named)
SELECT doc_id AS ord, path AS input, output, CASE WHEN NOT sound THEN 'failed' WHEN listed OR r > 1 THEN 'skipped' ELSE 'written' END AS status,
  coalesce({first}, {second}, '-') AS error, bytes_in, CASE WHEN sound AND NOT listed AND r = 1 THEN bytes_in // 3 ELSE -1 END AS bytes_out FROM ranked"""
_CROP = "CASE WHEN doc_id % 80 = 0 THEN 'zero_size' WHEN doc_id % 4 <> 1 AND doc_id % 80 > 64 THEN 'outside_image' END"
_BRIGHT = "CASE WHEN doc_id % 220 - 110 NOT BETWEEN -100 AND 100 THEN 'brightness_out_of_range' END"
_BRIGHT_TAG = "CASE WHEN doc_id % 220 = 110 THEN '_adj' ELSE concat('_b', doc_id % 220 - 110) END"


def _operated(spark, d, operation, suffix):
    """``suffix`` is spelled out for the listing, in terms of ``doc_id``; the operation makes its own."""
    files, _ = _batch(spark, d, "png")
    existing = v.table(spark, d, "documents").filter("(doc_id % 300) % 10 = 0").selectExpr(f"concat('/in/', doc_id % 300, {suffix}, '.png') AS output")
    out = ops.run(operation, files, existing, lambda path, content, output: len(content) // 3)
    return out.select("output", *_outcome(out).columns[:3], F.coalesce("error", F.lit("-")).alias("error"), "bytes_in", F.coalesce("bytes_out", F.lit(-1)).alias("bytes_out"))


@query("run_rotate", _OPERATION.format(suffix="'_rot90'", params="CAST(NULL AS VARCHAR)", first="d_error", second="p_error"))
def run_rotate(spark, d):
    return _operated(spark, d, ops.rotate(90), "'_rot90'")


@query("run_flip", _OPERATION.format(suffix="'_flipV'", params="CAST(NULL AS VARCHAR)", first="d_error", second="p_error"))
def run_flip(spark, d):
    return _operated(spark, d, ops.flip("vertical"), "'_flipV'")


@query("run_crop", _OPERATION.format(suffix="concat('_crop-', doc_id % 80, 'x10+0+0')", params=_CROP, first="d_error", second="p_error"))
def run_crop(spark, d):
    return _operated(spark, d, ops.crop(0, 0, (F.col("ord") % 80).cast("bigint"), 10), "concat('_crop-', doc_id % 80, 'x10+0+0')")


@query("run_adjust", _OPERATION.format(suffix=_BRIGHT_TAG, params=_BRIGHT, first="p_error", second="d_error"))
def run_adjust(spark, d):
    return _operated(spark, d, ops.adjust((F.col("ord") % 220 - 110).cast("int")), _BRIGHT_TAG)


_PERCENT = "CASE WHEN doc_id % 9 = 0 THEN '_0pct' ELSE '_50pct' END"


@query("run_resize", _OPERATION.format(suffix=_PERCENT, params="CASE WHEN doc_id % 9 = 0 THEN 'percent_out_of_range' END", first="d_error", second="p_error").replace(
    "WHEN NOT sound THEN 'failed' WHEN listed OR r > 1 THEN 'skipped'", "WHEN d_error IS NOT NULL THEN 'failed' WHEN listed THEN 'skipped' WHEN NOT sound THEN 'failed' WHEN r > 1 THEN 'skipped'"
).replace("coalesce(d_error, p_error, '-')", "CASE WHEN d_error IS NOT NULL THEN d_error WHEN listed THEN '-' ELSE coalesce(p_error, '-') END"))
def run_resize(spark, d):
    return _operated(spark, d, ops.resize(percent=F.when(F.col("ord") % 9 == 0, 0.0).otherwise(50.0)), _PERCENT)


_TAGGED = """tagged AS (SELECT doc_id, 1 + doc_id % 500 AS w, 1 + doc_id % 300 AS h, doc_id % 10 AS o FROM documents)"""


def _tagged(spark, d):
    """PNG headers with an orientation tag behind the size: 0 to 8, or a file without tags."""
    k = F.col("doc_id")

    def be(value):
        return F.lpad(F.hex(value.cast("bigint")), 8, "0")

    head = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), be(1 + k % 500), be(1 + k % 300), F.lit("080200000000000000"))
    block = F.concat(F.lit("4D4D002A00000008" "0001" "0112" "0003" "00000001"), F.lpad(F.hex(k % 10), 4, "0"), F.lit("0000" "00000000"))
    chunk = F.concat(F.lit("0000001A" "65584966"), block, F.lit("00000000"))
    content = F.unhex(F.concat(head, F.when(k % 10 < 9, chunk).otherwise(F.lit("")), F.lit("0000000049454E44AE426082")))
    rows = v.table(spark, d, "documents").select(k.alias("ord"), F.concat(F.lit("/in/"), k.cast("string"), F.lit(".png")).alias("path"), content.alias("content"))
    return rows.withColumn("length", F.length("content").cast("bigint"))


@query(
    "plan_rotate_auto",
    with_views(
        """SELECT doc_id AS ord, concat('/in/', doc_id, '_auto.png') AS output, CASE WHEN o BETWEEN 5 AND 8 THEN h ELSE w END AS out_width,
        CASE WHEN o BETWEEN 5 AND 8 THEN w ELSE h END AS out_height, CASE WHEN doc_id % 7 = 0 THEN 'skipped' ELSE '-' END AS status FROM tagged""",
        _TAGGED,
    ),
)
def plan_rotate_auto(spark, d):
    """Each file turned by its own tag; upright ones are rewritten, too."""
    existing = v.table(spark, d, "documents").filter("doc_id % 7 = 0").selectExpr("concat('/in/', doc_id, '_auto.png') AS output")
    rows = ops.plan(ops.rotate(), _tagged(spark, d), existing)
    return rows.select("ord", "output", "out_width", "out_height", F.coalesce("status", F.lit("-")).alias("status"))


@query(
    "plan_resize_fit",
    with_views(
        """SELECT doc_id AS ord, concat('/out/', doc_id, '_fit-', bw, 'x', bh, '.jpg') AS output,
        CASE WHEN bw * bh = 0 THEN 'zero_target' ELSE '-' END AS error,
        CASE WHEN bw * bh = 0 THEN -1 ELSE greatest(1, CAST(round(w * s) AS BIGINT)) END AS out_width,
        CASE WHEN bw * bh = 0 THEN -1 ELSE greatest(1, CAST(round(h * s) AS BIGINT)) END AS out_height
        FROM (SELECT *, CASE WHEN bw * bh > 0 THEN least(CAST(bw AS DOUBLE) / w, CAST(bh AS DOUBLE) / h) END AS s FROM (SELECT *, doc_id % 40 AS bw, doc_id % 30 AS bh FROM tagged))""",
        _TAGGED,
    ),
)
def plan_resize_fit(spark, d):
    """Boxes that differ by row, some of them empty, into another format and folder."""
    box = (F.col("ord") % 40).cast("bigint"), (F.col("ord") % 30).cast("bigint")
    none = v.table(spark, d, "documents").filter("doc_id < 0").selectExpr("text AS output")
    rows = ops.plan(ops.resize(fit=box, target="jpeg"), _tagged(spark, d), none, output_dir="/out")
    side = lambda c: F.when(F.col("error").isNull(), F.col(c)).otherwise(-1).alias(c)
    return rows.select("ord", "output", F.coalesce("error", F.lit("-")).alias("error"), side("out_width"), side("out_height"))


@query(
    "plan_in_place",
    """SELECT doc_id AS ord, p AS policy, CASE WHEN doc_id % 3 = 0 THEN concat('/in/', doc_id, '.png') WHEN p = 'increment' THEN concat('/in/', doc_id, '_1.png') ELSE concat('/in/', doc_id, '.png') END AS output,
      CASE WHEN doc_id % 3 = 0 OR p = 'increment' THEN '-' WHEN p = 'skip' THEN 'skipped' ELSE 'failed' END AS status,
      CASE WHEN doc_id % 3 > 0 AND p = 'replace' THEN 'output_is_input' ELSE '-' END AS error
    FROM documents, (SELECT unnest(['skip', 'replace', 'increment']) AS p)""",
)
def plan_in_place(spark, d):
    """Conversion into a file's own format: its name is taken by itself, and replacing it is refused."""
    k = F.col("doc_id")
    header = F.unhex(F.lit("89504E470D0A1A0A0000000D494844520000000400000004"))
    files = v.table(spark, d, "documents").select(
        k.alias("ord"), F.concat(F.lit("/in/"), k.cast("string"), F.when(k % 3 == 0, ".gif").otherwise(".png")).alias("path"), header.alias("content"), F.lit(24).cast("bigint").alias("length"),
    )
    none = v.table(spark, d, "documents").filter("doc_id < 0").selectExpr("text AS output")
    parts = [ops.plan(ops.convert("png"), files, none, policy).select("ord", F.lit(policy).alias("policy"), "output", F.coalesce("status", F.lit("-")).alias("status"), F.coalesce("error", F.lit("-")).alias("error")) for policy in ("skip", "replace", "increment")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# What the presets make of a 64 by 64 PNG: name ending, policy and side. Of those that skip, only the last web preset shares a name with an earlier one.
_EDGES = """edges AS (SELECT * FROM (VALUES ('convert-png', '.png', 'skip', 64), ('convert-jpg', '.jpg', 'skip', 64), ('convert-webp', '.webp', 'skip', 64), ('convert-avif', '.avif', 'skip', 64),
  ('convert-tiff', '.tiff', 'skip', 64), ('resize-25pct', '_25pct.png', 'skip', 16), ('resize-50pct', '_50pct.png', 'skip', 32), ('resize-200pct', '_200pct.png', 'skip', 128),
  ('resize-hd-1920', '_fit-1920x1920.png', 'skip', 1920), ('resize-4k-3840', '_fit-3840x3840.png', 'skip', 3840), ('rotate-90', '_rot90.png', 'skip', 64), ('rotate-180', '_rot180.png', 'skip', 64),
  ('rotate-270', '_rot270.png', 'skip', 64), ('rotate-auto-exif', '_auto.png', 'increment', 64), ('flip-horizontal', '_flipH.png', 'skip', 64), ('flip-vertical', '_flipV.png', 'skip', 64),
  ('adjust-brightness-plus', '_b10.png', 'skip', 64), ('adjust-brightness-minus', '_b-10.png', 'skip', 64), ('adjust-contrast-plus', '_c20.png', 'skip', 64), ('adjust-bw', '_s-100.png', 'skip', 64),
  ('adjust-vivid', '_s40.png', 'skip', 64), ('web-whatsapp', '_fit-1280x1280.jpg', 'skip', 1280), ('web-instagram', '_fit-1080x1080.jpg', 'skip', 1080), ('web-facebook', '_fit-2048x2048.jpg', 'skip', 2048),
  ('web-twitter', '_fit-1200x1200.jpg', 'skip', 1200), ('web-telegram', '_fit-2560x2560.jpg', 'skip', 2560), ('web-discord', '_fit-2048x2048.jpg', 'skip', 2048), ('web-optimize-png', '.png', 'replace', 64)
  ) AS t(preset_id, ending, policy, side))"""


@query(
    "run_renditions",
    with_views(
        """SELECT ord, preset_id, CASE WHEN sound AND policy = 'increment' AND r > 1 THEN concat('/in/', m, '_auto_', r - 1, '.png') ELSE naive END AS output,
          CASE WHEN NOT sound THEN 'failed' WHEN policy = 'increment' OR policy = 'replace' AND back = 1 OR policy = 'skip' AND NOT held AND r = 1 THEN 'written' ELSE 'skipped' END AS status,
          CASE WHEN NOT sound THEN 'too_many_pixels' ELSE '-' END AS error, bytes_in,
          CASE WHEN sound AND (policy = 'increment' OR policy = 'replace' AND back = 1 OR policy = 'skip' AND NOT held AND r = 1) THEN bytes_in * 10000 + side ELSE -1 END AS bytes_out
        FROM (SELECT *, row_number() OVER (PARTITION BY naive, policy, sound ORDER BY ord, n) AS r, row_number() OVER (PARTITION BY naive, policy, sound ORDER BY ord DESC, n DESC) AS back
          FROM (SELECT doc_id AS ord, doc_id % 300 AS m, doc_id % 4 <> 1 AS sound, octet_length(encode(text)) + 24 AS bytes_in, preset_id, policy, side, concat('/in/', doc_id % 300, ending) AS naive,
              CASE preset_id WHEN 'web-discord' THEN 1 ELSE 0 END AS n, ending = '.png' AND doc_id % 3 > 0 OR ending = '_rot90.png' AND doc_id % 300 % 10 = 0 AS held FROM documents, edges))""",
        _EDGES,
    ),
)
def run_renditions(spark, d):
    """All presets of all files in one job: each file opened once, names under three policies."""
    files, _ = _batch(spark, d, "png")
    existing = v.table(spark, d, "documents").filter("(doc_id % 300) % 10 = 0").selectExpr("concat('/in/', doc_id % 300, '_rot90.png') AS output")
    out = rn.run_renditions(files, existing, lambda path, content: len(content), lambda size, edge: size * 10000 + edge["out_width"])
    return out.select("ord", "preset_id", "output", "status", F.coalesce("error", F.lit("-")).alias("error"), "bytes_in", F.coalesce("bytes_out", F.lit(-1)).alias("bytes_out"))


@query(
    "run_conversion_replace",
    """WITH named AS (SELECT doc_id, concat('/in/', doc_id % 300, CASE WHEN doc_id % 3 = 0 THEN '.gif' ELSE '.png' END) AS path, doc_id % 4 <> 1 AS sound,
        octet_length(encode(text)) + 24 AS bytes_in FROM documents),
      ranked AS (SELECT *, sound AND doc_id = max(doc_id) OVER (PARTITION BY doc_id % 300, sound) AS stays FROM named)
    SELECT doc_id AS ord, path AS input, CASE WHEN NOT sound THEN 'failed' WHEN stays THEN 'written' ELSE 'skipped' END AS status,
      CASE WHEN sound THEN '-' ELSE 'too_many_pixels' END AS error, bytes_in, CASE WHEN stays THEN bytes_in // 3 ELSE -1 END AS bytes_out FROM ranked""",
)
def conversion_replace(spark, d):
    files, existing = _batch(spark, d, "jpg")
    return _outcome(run_conversion(files, existing, "jpeg", lambda path, content, output: len(content) // 3, "replace", read_by_path=False))
