"""Queries on the image manifest: formats, admission, validation, sizes, encoder settings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tileweave.functions import binary, encoding as enc, geometry as geo, validation as val
from tileweave.operators import audit
from tileweave.plans.renditions import plan_renditions
from tileweave.session import spread
from tileweave.sources import formats as fm, presets as ps

from . import views as v
from .registry import query
from .views import MANIFEST, PARAMS, with_views

# --- formats -------------------------------------------------------------------------------------

_ALIAS_SQL = """aliases AS (SELECT * FROM (VALUES ('png','png'),('jpg','jpeg'),('jpeg','jpeg'),('jpe','jpeg'),('webp','webp'),
  ('avif','avif'),('tif','tiff'),('tiff','tiff'),('bmp','bmp'),('dib','bmp'),('gif','gif'),('ico','ico'),('pnm','pnm'),
  ('ppm','pnm'),('pgm','pnm'),('pbm','pnm'),('pam','pnm'),('tga','tga'),('targa','tga'),('qoi','qoi'),('hdr','hdr'),
  ('rgbe','hdr'),('exr','openexr'),('openexr','openexr')) AS t(alias, format))"""
_FORMAT_SQL = """formats AS (SELECT * FROM (VALUES ('png','png','image/png',0),('jpeg','jpg','image/jpeg',1),
  ('webp','webp','image/webp',2),('avif','avif','image/avif',3),('tiff','tiff','image/tiff',4),('bmp','bmp','image/bmp',5),
  ('gif','gif','image/gif',6),('ico','ico','image/vnd.microsoft.icon',7),('pnm','ppm','image/x-portable-anymap',8),
  ('tga','tga','image/x-tga',9),('qoi','qoi','image/qoi',10),('hdr','hdr','image/vnd.radiance',11),
  ('openexr','exr','image/x-exr',12)) AS t(format, extension, mime, ord))"""


@query(
    "format_census",
    with_views(
        """SELECT f.format, f.extension, f.mime, CAST(f.ord AS INTEGER) AS ord, count(m.ord) AS files
        FROM formats f LEFT JOIN manifest m ON m.sniffed = f.format GROUP BY ALL""",
        MANIFEST, _FORMAT_SQL,
    ),
)
def format_census(spark, d):
    """The format dimension with the number of files of each format."""
    counts = v.manifest(spark, d).groupBy(F.col("sniffed").alias("format")).agg(F.count("*").alias("files"))
    joined = fm.formats(spark).join(counts, "format", "left")
    return joined.withColumn("files", F.coalesce("files", F.lit(0)))


@query(
    "parse_format",
    with_views(
        """SELECT ord, path, coalesce(format, '-') AS format FROM manifest LEFT JOIN aliases
        ON alias = lower(trim(regexp_extract(path, '\\.([^.]*)$', 1)))""",
        MANIFEST, _ALIAS_SQL,
    ),
)
def parse_format(spark, d):
    m = v.manifest(spark, d).withColumn("ext", F.concat(F.lit(" "), F.regexp_extract("path", r"\.([^.]*)$", 1)))
    return fm.parse_format(m, "ext").select("ord", "path", F.coalesce("format", F.lit("-")).alias("format"))


@query(
    "format_mismatch",
    with_views(
        """SELECT ord, path, sniffed, format AS ext_format FROM manifest JOIN aliases
        ON alias = lower(regexp_extract(path, '\\.([^.]*)$', 1)) WHERE sniffed <> format""",
        MANIFEST, _ALIAS_SQL,
    ),
)
def format_mismatch(spark, d):
    return fm.format_mismatch(v.manifest(spark, d)).select("ord", "path", "sniffed", "ext_format")


_MAGIC_CASES = [
    ("89504E470D0A1A0A", "png"), ("FFD8FFE0", "jpeg"), ("474946383961", "gif"), ("49492A00", "tiff"), ("424D", "bmp"),
    ("0000001C6674797061766966", "avif"), ("5249464600000000574542505650", "webp"), ("762F3101", "openexr"),
    ("716F6966", "qoi"), ("44445320", None), ("5035", "pnm"),
]


@query(
    "sniff_format",
    f"""SELECT doc_id, coalesce(CASE doc_id % 12
      {' '.join(f"WHEN {i} THEN {'NULL' if n is None else repr(n)}" for i, (_, n) in enumerate(_MAGIC_CASES))}
      ELSE CASE doc_id % 5 WHEN 0 THEN 'png' WHEN 1 THEN 'tga' WHEN 2 THEN 'jpeg' END END, '-') AS format
    FROM documents""",
)
def sniff_format(spark, d):
    """Document bytes behind magic bytes; the names end in png, tga, JPG, an unknown extension, or none."""
    k = F.col("doc_id")
    magic = v._pick(k % 12, [m for m, _ in _MAGIC_CASES], "7E7E")
    name = F.concat(F.lit("d"), k.cast("string"), v._pick(k % 5, [".png", ".tga", ".JPG", ".xyz"], ""))
    files = v.table(spark, d, "documents").select(
        "doc_id", name.alias("path"), F.concat(F.unhex(magic), F.col("text").cast("binary")).alias("content")
    )
    return fm.sniff_format(files).select("doc_id", F.coalesce("format", F.lit("-")).alias("format"))


@query(
    "read_dims",
    with_views(
        """SELECT ord, CASE WHEN ord % 6 < 4 THEN width ELSE -1 END::BIGINT AS width,
        CASE WHEN ord % 6 < 4 THEN height ELSE -1 END::BIGINT AS height FROM manifest""",
        MANIFEST,
    ),
)
def read_dims(spark, d):
    """Headers written from the manifest's sizes: PNG, GIF, BMP (bottom-up or top-down), QOI; other or cut ones."""
    k = F.col("ord")

    def be(c):
        return F.lpad(F.hex(F.col(c).cast("bigint")), 8, "0")

    def le(h, n):
        return F.concat(*[F.substring(h, 2 * n - 2 * i - 1, 2) for i in range(n)])

    height = F.when(k % 4 == 0, -F.col("height")).otherwise(F.col("height")).cast("bigint")
    bmp_h = F.lpad(F.hex(F.pmod(height, F.lit(4294967296))), 8, "0")
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), be("width"), be("height"))
    gif = F.concat(F.lit("474946383961"), le(F.substring(be("width"), 5, 4), 2), le(F.substring(be("height"), 5, 4), 2))
    bmp = F.concat(F.lit("424D"), F.lit("00" * 12), F.lit("28000000"), le(be("width"), 4), le(bmp_h, 4))
    qoi = F.concat(F.lit("716F6966"), be("width"), be("height"), F.lit("0300"))
    cut = F.lit("89504E470D0A1A0A0000000D")
    content = F.unhex(v._pick(k % 6, [png, gif, bmp, qoi, cut], F.lit("00112233")))
    files = v.manifest(spark, d).select("ord", content.alias("content"))
    dims = files.select("ord", binary.read_dims("content").alias("_d"))
    return dims.select(
        "ord", F.coalesce("_d.width", F.lit(-1)).alias("width"), F.coalesce("_d.height", F.lit(-1)).alias("height")
    )


# --- admission, properties, validation -------------------------------------------------------------

@query(
    "admit",
    with_views(
        """SELECT ord, CASE WHEN length > 1073741824 THEN 'too_many_bytes'
        WHEN CAST(width AS BIGINT) * height > 268435456 THEN 'too_many_pixels' ELSE 'ok' END AS verdict FROM manifest""",
        MANIFEST,
    ),
)
def admit(spark, d):
    return audit.with_admission(v.manifest(spark, d)).select("ord", F.coalesce("admit_error", F.lit("ok")).alias("verdict"))


@query(
    "admitted_set",
    with_views(
        "SELECT ord, path FROM manifest WHERE length <= 1073741824 AND CAST(width AS BIGINT) * height <= 268435456", MANIFEST
    ),
)
def admitted_set(spark, d):
    return audit.admitted(v.manifest(spark, d)).select("ord", "path")


@query(
    "admit_unknown",
    with_views(
        """SELECT ord, CASE WHEN ord % 5 <> 0 AND length > 1073741824 THEN 'too_many_bytes' WHEN ord % 5 = 0 THEN 'unreadable_file'
        WHEN ord % 7 = 0 OR ord % 3 = 0 THEN 'unreadable_header' WHEN CAST(width AS BIGINT) * height > 268435456 THEN 'too_many_pixels' ELSE 'ok' END AS verdict FROM manifest""",
        MANIFEST,
    ),
)
def admit_unknown(spark, d):
    """Files whose length or sides are not known are never admitted."""
    k = F.col("ord")
    rows = v.manifest(spark, d).withColumns({"length": F.when(k % 5 != 0, F.col("length")), "width": F.when(k % 7 != 0, F.col("width")), "height": F.when(k % 3 != 0, F.col("height"))})
    return audit.with_admission(rows).select("ord", F.coalesce("admit_error", F.lit("ok")).alias("verdict"))


@query(
    "image_properties",
    with_views(
        """SELECT ord, coalesce(CASE WHEN mp >= 0.1e0 THEN mp END, -1) AS megapixels,
        concat(width // gcd(width, height), ':', height // gcd(width, height)) AS aspect,
        CASE n_channels WHEN 3 THEN 'RGB' WHEN 4 THEN 'RGBA' END AS color_mode, '8' AS bits
        FROM (SELECT *, CAST(width AS DOUBLE) * height / 1e6 AS mp FROM manifest)""",
        MANIFEST,
    ),
)
def image_properties(spark, d):
    m = v.manifest(spark, d).withColumn("mode", F.when(F.col("n_channels") == 4, 24).otherwise(16))
    return audit.image_properties(m).select(
        "ord", F.coalesce("megapixels", F.lit(-1.0)).alias("megapixels"), "aspect", "color_mode", "bits"
    )


@query(
    "alpha_loss",
    with_views("SELECT ord, n_channels = 4 AND coalesce(sniffed, '') = 'jpeg' AS alpha_loss FROM manifest", MANIFEST),
)
def alpha_loss(spark, d):
    loss = enc.alpha_loss(enc.has_alpha("n_channels"), F.coalesce("sniffed", F.lit("")))
    return v.manifest(spark, d).select("ord", loss.alias("alpha_loss"))


@query(
    "validate_adjust",
    with_views(
        """SELECT id, CASE WHEN brightness NOT BETWEEN -100 AND 100 THEN 'brightness_out_of_range'
        WHEN isnan(c) OR c < -100 OR c > 100 THEN 'contrast_out_of_range'
        WHEN saturation NOT BETWEEN -100 AND 100 THEN 'saturation_out_of_range'
        WHEN gamma < 0.1e0 OR gamma > 10 THEN 'gamma_out_of_range' ELSE 'ok' END AS verdict
        FROM (SELECT *, CASE WHEN id % 23 = 0 THEN 'nan'::DOUBLE WHEN id % 29 = 0 THEN 'inf'::DOUBLE ELSE contrast END AS c FROM params)""",
        PARAMS,
    ),
)
def validate_adjust(spark, d):
    k = F.col("id")
    c = F.when(k % 23 == 0, float("nan")).when(k % 29 == 0, float("inf")).otherwise(F.col("contrast"))
    verdict = val.validate_adjust("brightness", c, "saturation", "gamma")
    return v.params(spark, d).select("id", F.coalesce(verdict, F.lit("ok")).alias("verdict"))


@query(
    "validate_crop",
    with_views(
        """SELECT id, CASE WHEN cw = 0 OR ch = 0 THEN 'zero_size' WHEN x + cw > 4294967295 THEN 'overflow_x'
        WHEN cy + ch > 4294967295 THEN 'overflow_y' WHEN x + cw > img_w OR cy + ch > img_h THEN 'outside_image' ELSE 'ok' END AS verdict
        FROM (SELECT *, CASE WHEN id % 31 = 0 THEN 4294967290 ELSE cx END AS x FROM params)""",
        PARAMS,
    ),
)
def validate_crop(spark, d):
    x = F.when(F.col("id") % 31 == 0, F.lit(4294967290)).otherwise(F.col("cx"))
    verdict = val.validate_crop(x, "cy", "cw", "ch", "img_w", "img_h")
    return v.params(spark, d).select("id", F.coalesce(verdict, F.lit("ok")).alias("verdict"))


@query(
    "validate_resize",
    with_views(
        """SELECT id, CASE WHEN cx = 0 OR cy = 0 THEN 'zero_source' WHEN contrast <= 0 THEN 'percent_out_of_range' ELSE 'ok' END AS percent,
        CASE WHEN cx = 0 OR cy = 0 THEN 'zero_source' WHEN cw = 0 OR ch = 0 THEN 'zero_target' ELSE 'ok' END AS box,
        CASE WHEN cx = 0 OR cy = 0 THEN 'zero_source' ELSE 'ok' END AS max_edge FROM params""",
        PARAMS,
    ),
)
def validate_resize(spark, d):
    ok = F.lit("ok")
    return v.params(spark, d).select(
        "id",
        F.coalesce(val.validate_resize_percent("cx", "cy", "contrast"), ok).alias("percent"),
        F.coalesce(val.validate_resize_box("cx", "cy", "cw", "ch"), ok).alias("box"),
        F.coalesce(val.validate_resize_max_edge("cx", "cy"), ok).alias("max_edge"),
    )


@query(
    "validate_quality",
    with_views(
        """SELECT id, CASE WHEN brightness BETWEEN 1 AND 100 THEN 'ok' ELSE 'quality_out_of_range' END AS quality,
        CASE WHEN loop_count IN (2, 3, 4) THEN 'ok' ELSE 'factor_out_of_range' END AS upscale FROM params""",
        PARAMS,
    ),
)
def validate_quality(spark, d):
    return v.params(spark, d).select(
        "id",
        F.coalesce(val.validate_quality("brightness"), F.lit("ok")).alias("quality"),
        F.coalesce(val.validate_upscale("loop_count"), F.lit("ok")).alias("upscale"),
    )


_TARGET = "CASE ord % 7 WHEN 0 THEN 'jpeg' WHEN 1 THEN 'png' WHEN 2 THEN 'avif' WHEN 3 THEN 'openexr' WHEN 4 THEN 'hdr' WHEN 5 THEN 'webp' END"


def _with_target(m):
    k = F.col("ord")
    target = v._pick(k % 7, ["jpeg", "png", "avif", "openexr", "hdr", "webp"])
    return m.withColumns(
        {
            "target": target,
            "quality": F.when(k % 3 > 0, (k % 100 + 1).cast("int")),
            "optimize": k % 2 == 0,
            "speed": (k % 10 + 1).cast("int"),
        }
    )


@query("target_or_source", with_views(f"SELECT ord, coalesce({_TARGET}, sniffed, '-') AS target FROM manifest", MANIFEST))
def target_or_source(spark, d):
    t = audit.target_or_source("target", "sniffed")
    return _with_target(v.manifest(spark, d)).select("ord", F.coalesce(t, F.lit("-")).alias("target"))


_ENC = f"""enc AS (SELECT ord, {_TARGET} AS target, CASE WHEN ord % 3 > 0 THEN CAST(ord % 100 + 1 AS INTEGER) END AS quality,
  ord % 2 = 0 AS optimize, CAST(ord % 10 + 1 AS INTEGER) AS speed FROM manifest)"""


@query(
    "encode_settings",
    with_views(
        """SELECT ord, CAST(CASE target WHEN 'jpeg' THEN coalesce(quality, 75) WHEN 'avif' THEN coalesce(quality, 80) ELSE -1 END AS INTEGER) AS quality,
        CAST(CASE WHEN target <> 'avif' OR target IS NULL THEN -1 WHEN optimize AND speed > 4 THEN 4 ELSE speed END AS INTEGER) AS speed,
        CASE WHEN target = 'png' AND optimize THEN 'best/adaptive' ELSE '-' END AS compression FROM enc""",
        MANIFEST, _ENC,
    ),
)
def encode_settings(spark, d):
    s = _with_target(v.manifest(spark, d)).select("ord", enc.encode_settings("target", "quality", "optimize", "speed").alias("s"))
    return s.select(
        "ord", F.coalesce("s.quality", F.lit(-1)).alias("quality"), F.coalesce("s.speed", F.lit(-1)).alias("speed"),
        F.coalesce(F.concat("s.compression", F.lit("/"), "s.filter"), F.lit("-")).alias("compression"),
    )


@query(
    "target_layout",
    with_views(
        """SELECT ord, CASE WHEN target = 'openexr' THEN 'rgba_f32' WHEN target = 'hdr' THEN 'rgb_f32'
        WHEN target = 'jpeg' AND quality IS NOT NULL THEN 'rgb8' WHEN target = 'avif' OR (target = 'png' AND optimize) THEN 'rgba8'
        ELSE 'source' END AS layout,
        CASE WHEN target IN ('openexr', 'hdr') THEN (ord % 256) / 255.0e0 ELSE ord % 256 END::DOUBLE AS sample FROM enc""",
        MANIFEST, _ENC,
    ),
)
def target_layout(spark, d):
    rows = _with_target(v.manifest(spark, d)).withColumn("layout", enc.target_layout("target", "quality", "optimize"))
    return rows.select("ord", "layout", enc.to_layout(F.col("ord") % 256, "layout").alias("sample"))


@query(
    "web_preset",
    with_views(
        """SELECT ord, CAST(CASE target WHEN 'jpeg' THEN 85 WHEN 'avif' THEN 85 ELSE -1 END AS INTEGER) AS quality,
        CAST(CASE target WHEN 'avif' THEN 4 ELSE -1 END AS INTEGER) AS speed, true AS strip_metadata, true AS progressive FROM enc""",
        MANIFEST, _ENC,
    ),
)
def web_preset(spark, d):
    rows = _with_target(v.manifest(spark, d)).withColumn("p", enc.web_preset())
    s = enc.encode_settings("target", F.col("p.quality"), F.col("p.optimize"), F.col("p.avif_speed"))
    return rows.withColumn("s", s).select(
        "ord", F.coalesce("s.quality", F.lit(-1)).alias("quality"), F.coalesce("s.speed", F.lit(-1)).alias("speed"),
        F.col("p.strip_metadata").alias("strip_metadata"), F.col("p.progressive").alias("progressive"),
    )


_DECIDE = {
    "convert": ["s", "d"], "resize": ["d", "s", "p"], "rotate": ["d", "s"],
    "flip": ["d", "s"], "crop": ["d", "p", "s"], "adjust": ["p", "d", "s"],
}
_DECIDE_SQL = {
    "s": "WHEN policy = 'skip' AND present THEN 'skipped:-'",
    "d": "WHEN bad THEN 'failed:decode'",
    "p": "WHEN wrong THEN 'failed:invalid_input'",
}


@query(
    "decide_outcome",
    with_views(
        " UNION ALL ".join(
            f"SELECT ord, '{op}' AS operation, CASE {' '.join(_DECIDE_SQL[c] for c in order)} ELSE 'written:-' END AS outcome FROM cases"
            for op, order in _DECIDE.items()
        ),
        MANIFEST,
        """cases AS (SELECT ord, ord % 5 = 0 AS bad, ord % 3 = 0 AS wrong, ord % 2 = 0 AS present,
           CASE ord % 7 WHEN 0 THEN 'replace' WHEN 1 THEN 'increment' ELSE 'skip' END AS policy FROM manifest)""",
    ),
)
def decide_outcome(spark, d):
    k = F.col("ord")
    rows = v.manifest(spark, d).select(
        "ord", F.when(k % 5 == 0, "bad bytes").alias("bad"), F.when(k % 3 == 0, "bad parameters").alias("wrong"),
        (k % 2 == 0).alias("present"), v._pick(k % 7, ["replace", "increment"], "skip").alias("policy"),
    )

    def outcome(op):
        o = audit.decide_outcome(op, "bad", "wrong", "present", F.col("policy"))
        return F.struct(
            F.lit(op).alias("operation"),
            F.concat(o["status"], F.lit(":"), F.coalesce(o["error_kind"], F.lit("-"))).alias("outcome"),
        )

    return rows.select("ord", F.inline(F.array(*[outcome(op) for op in audit.CHECK_ORDER])))


# --- sizes -----------------------------------------------------------------------------------------

def _dims(name, columns, sql, fn, types="BIGINT"):
    """Registers a size query; ``sql`` gives one expression per output column over the manifest."""
    body = ", ".join(f"CAST({e} AS {types if isinstance(types, str) else types[i]}) AS {c}" for i, (c, e) in enumerate(zip(columns, sql)))

    def run(spark, d):
        return v.manifest(spark, d).select("ord", fn().alias("_d")).select("ord", *[F.col(f"_d.{c}").alias(c) for c in columns])

    query(name, with_views(f"SELECT ord, {body} FROM (SELECT ord, CAST(width AS BIGINT) AS w, CAST(height AS BIGINT) AS h FROM manifest)", MANIFEST))(run)


def _edge(e):
    return (
        f"CASE WHEN w <= {e} AND h <= {e} THEN w WHEN w >= h THEN {e} ELSE greatest(w * {e} // h, 1) END",
        f"CASE WHEN w <= {e} AND h <= {e} THEN h WHEN w >= h THEN greatest(h * {e} // w, 1) ELSE {e} END",
    )


def _pct(p):
    return tuple(f"greatest(round({s} * (CAST({p} AS FLOAT)::DOUBLE / 100)), 1)" for s in "wh")


def _fit(bw, bh):
    return tuple(f"greatest(round({s}::DOUBLE * least({bw}.0e0 / w, {bh}.0e0 / h)), 1)" for s in "wh")


_WH = ("width", "height")
_dims("dims_max_edge", _WH, _edge(1080), lambda: geo.dims_max_edge("width", "height", 1080))
_dims("dims_max_edge_tiny", _WH, _edge(1), lambda: geo.dims_max_edge("width", "height", 0))
_dims("dims_percent", _WH, _pct(50), lambda: geo.dims_percent("width", "height", 50.0))
_dims("dims_percent_fraction", _WH, _pct(33.3), lambda: geo.dims_percent("width", "height", 33.3))
_dims("dims_exact", _WH, ("640", "480"), lambda: geo.dims_exact(640, 480))
_dims("dims_fit", _WH, _fit(1920, 1200), lambda: geo.dims_fit("width", "height", 1920, 1200))
_dims("dims_upscale", _WH, _pct(300), lambda: geo.dims_upscale("width", "height", 3))
_dims("dims_thumb", _WH, _fit(80, 80), lambda: geo.dims_thumb("width", "height"))
_dims(
    "dims_preview", ("width", "height", "scale"), (*_edge(800), f"({_edge(800)[0]})::DOUBLE / w"),
    lambda: geo.dims_preview("width", "height"), ("BIGINT", "BIGINT", "DOUBLE"),
)
_dims(
    "default_crop", ("x", "y", "width", "height"),
    ("(w - greatest(w // 2, 1)) // 2", "(h - greatest(h // 2, 1)) // 2", "greatest(w // 2, 1)", "greatest(h // 2, 1)"),
    lambda: geo.default_crop("width", "height"),
)
_RATIO = "(800.0e0 / greatest(w, h))"
_dims(
    "scale_rect", ("x", "y", "width", "height"),
    (f"round((w // 2) * {_RATIO})", f"round((h // 3) * {_RATIO})", f"greatest(round((w - w // 2) * {_RATIO}), 1)",
     f"greatest(round((h - h // 3) * {_RATIO}), 1)"),
    lambda: geo.scale_rect(
        F.floor(F.col("width") / 2), F.floor(F.col("height") / 3), F.col("width") - F.floor(F.col("width") / 2),
        F.col("height") - F.floor(F.col("height") / 3), F.lit(800.0) / F.greatest("width", "height"),
    ),
)
_dims(
    "contain_fit", ("scale", "dx", "dy"),
    tuple(
        f"CASE WHEN ord % 9 = 0 THEN {z} ELSE {e} END"
        for z, e in (
            ("1", "least(1280.0e0 / w, 720.0e0 / h)"),
            ("0", "(1280.0e0 - w * least(1280.0e0 / w, 720.0e0 / h)) / 2"),
            ("0", "(720.0e0 - h * least(1280.0e0 / w, 720.0e0 / h)) / 2"),
        )
    ),
    lambda: geo.contain_fit(F.when(F.col("ord") % 9 == 0, 0).otherwise(1280), 720, "width", "height"), "DOUBLE",
)
_LARGER = "(w > 4000 OR h > 3000)"
_LW, _LH = (f"(CASE WHEN {_LARGER} THEN {f}::BIGINT ELSE {s} END)" for f, s in zip(_fit(4000, 3000), "wh"))
_dims(
    "letterbox", ("width", "height", "dx", "dy"), (_LW, _LH, f"(4000 - {_LW}) // 2", f"(3000 - {_LH}) // 2"),
    lambda: geo.letterbox("width", "height", 4000, 3000),
)


# --- renditions --------------------------------------------------------------------------------------

_PRESET_SQL = """presets AS (SELECT * FROM (VALUES
  ('convert-png','convert','convert',NULL,NULL,'png',NULL,false,''), ('convert-jpg','convert','convert',NULL,NULL,'jpeg',NULL,false,''),
  ('convert-webp','convert','convert',NULL,NULL,'webp',NULL,false,''), ('convert-avif','convert','convert',NULL,NULL,'avif',NULL,false,''),
  ('convert-tiff','convert','convert',NULL,NULL,'tiff',NULL,false,''), ('resize-25pct','resize','resize',25,NULL,NULL,NULL,false,'_25pct'),
  ('resize-50pct','resize','resize',50,NULL,NULL,NULL,false,'_50pct'), ('resize-200pct','resize','resize',200,NULL,NULL,NULL,false,'_200pct'),
  ('resize-hd-1920','resize','resize',NULL,1920,NULL,NULL,false,'_fit-1920x1920'), ('resize-4k-3840','resize','resize',NULL,3840,NULL,NULL,false,'_fit-3840x3840'),
  ('rotate-90','rotate','r90',NULL,NULL,NULL,NULL,false,'_rot90'), ('rotate-180','rotate','r180',NULL,NULL,NULL,NULL,false,'_rot180'),
  ('rotate-270','rotate','r270',NULL,NULL,NULL,NULL,false,'_rot270'), ('rotate-auto-exif','rotate','auto',NULL,NULL,NULL,NULL,false,'_auto'),
  ('flip-horizontal','flip','flip',NULL,NULL,NULL,NULL,false,'_flipH'), ('flip-vertical','flip','flip',NULL,NULL,NULL,NULL,false,'_flipV'),
  ('adjust-brightness-plus','adjust','adjust',NULL,NULL,NULL,NULL,false,'_b10'), ('adjust-brightness-minus','adjust','adjust',NULL,NULL,NULL,NULL,false,'_b-10'),
  ('adjust-contrast-plus','adjust','adjust',NULL,NULL,NULL,NULL,false,'_c20'), ('adjust-bw','adjust','adjust',NULL,NULL,NULL,NULL,false,'_s-100'),
  ('adjust-vivid','adjust','adjust',NULL,NULL,NULL,NULL,false,'_s40'), ('web-whatsapp','web','resize',NULL,1280,'jpeg',85,false,'_fit-1280x1280'),
  ('web-instagram','web','resize',NULL,1080,'jpeg',90,false,'_fit-1080x1080'), ('web-facebook','web','resize',NULL,2048,'jpeg',85,false,'_fit-2048x2048'),
  ('web-twitter','web','resize',NULL,1200,'jpeg',85,false,'_fit-1200x1200'), ('web-telegram','web','resize',NULL,2560,'jpeg',85,false,'_fit-2560x2560'),
  ('web-discord','web','resize',NULL,2048,'jpeg',80,false,'_fit-2048x2048'), ('web-optimize-png','web','convert',NULL,NULL,'png',NULL,true,'')
  ) AS t(preset_id, preset_group, op, percent, fit, target, quality, optimize, suffix))"""
_RENDITIONS = """renditions AS (
  SELECT m.ord, preset_id, preset_group,
    CASE WHEN percent IS NOT NULL THEN greatest(round(w * (percent / 100.0e0)), 1) WHEN fit IS NOT NULL
      THEN greatest(round(w::DOUBLE * least(fit::DOUBLE / w, fit::DOUBLE / h)), 1) WHEN op IN ('r90', 'r270') OR (op = 'auto' AND m.ord % 9 BETWEEN 5 AND 8) THEN h ELSE w END::BIGINT AS out_width,
    CASE WHEN percent IS NOT NULL THEN greatest(round(h * (percent / 100.0e0)), 1) WHEN fit IS NOT NULL
      THEN greatest(round(h::DOUBLE * least(fit::DOUBLE / w, fit::DOUBLE / h)), 1) WHEN op IN ('r90', 'r270') OR (op = 'auto' AND m.ord % 9 BETWEEN 5 AND 8) THEN w ELSE h END::BIGINT AS out_height,
    CASE WHEN m.sniffed IS NOT NULL THEN coalesce(p.target, m.sniffed) END AS target,
    CASE CASE WHEN m.sniffed IS NOT NULL THEN coalesce(p.target, m.sniffed) END WHEN 'jpeg' THEN coalesce(quality, 75) WHEN 'avif' THEN coalesce(quality, 80) ELSE -1 END::INTEGER AS quality,
    CASE WHEN m.sniffed IS NOT NULL THEN concat(regexp_replace(path, '\\.[^.]*$', ''), suffix, '.', f.extension) END AS output,
    CASE WHEN m.sniffed IS NULL THEN 'failed' END AS status
  FROM (SELECT *, width::BIGINT AS w, height::BIGINT AS h FROM manifest) m CROSS JOIN presets p
  LEFT JOIN formats f ON f.format = coalesce(p.target, m.sniffed))"""


def _renditions(spark, d):
    m = spread(v.manifest(spark, d))
    images = m.withColumn("format", F.col("sniffed")).withColumn("orientation", (F.col("ord") % 9).cast("int"))
    return plan_renditions(images).withColumn("quality", F.coalesce("encoder.quality", F.lit(-1)))


_RENDITION_COLUMNS = "ord, preset_id, preset_group, out_width, out_height, target, quality, output, status"


@query("plan_renditions", with_views(f"SELECT {_RENDITION_COLUMNS} FROM renditions", MANIFEST, _FORMAT_SQL, _PRESET_SQL, _RENDITIONS))
def renditions(spark, d):
    return _renditions(spark, d).select(*_RENDITION_COLUMNS.split(", "))


@query(
    "preset_usage",
    with_views(
        """SELECT preset_id, preset_group, CAST(sum(out_width * out_height) AS BIGINT) AS pixels, count(DISTINCT target) AS targets
        FROM renditions GROUP BY ALL""",
        MANIFEST, _FORMAT_SQL, _PRESET_SQL, _RENDITIONS,
    ),
)
def preset_usage(spark, d):
    """The preset table joined with what its presets would produce over the whole manifest."""
    used = _renditions(spark, d).groupBy("preset_id").agg(
        F.sum(F.col("out_width") * F.col("out_height")).alias("pixels"), F.count_distinct("target").alias("targets")
    )
    return ps.presets(spark).select("preset_id", "preset_group").join(used, "preset_id")
