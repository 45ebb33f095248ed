"""Queries on pixel tables: rasters, geometry, tone, resampling, histograms."""

from __future__ import annotations

from pyspark.sql import functions as F

from tileweave.functions.geometry import letterbox
from tileweave.operators import frames as fr, pixels as pz, resample as rs, stats, tone
from tileweave.plans import masking

from . import views as v
from .registry import query
from .views import EDITS, MASK, PARAMS, PX, TAGS, with_views

FULL = "image_id, x, y, r, g, b, a, width, height"
CLAMP = "least(greatest({0}, 0), 255)"


def _full(df):
    return df.select(*[c.strip() for c in FULL.split(",")])


# --- rasters and pixels --------------------------------------------------------------------------

@query("pixel_table", with_views(f"SELECT {FULL} FROM px", PX))
def pixel_table(spark, d):
    """Raster rows built from pixels, then exploded to pixels again."""
    rasters = pz.from_pixels(v.px(spark, d))
    return _full(pz.to_pixels(rasters))


_RASTER = """SELECT image_id, CAST(max(x) + 1 AS INTEGER) AS width, CAST(max(y) + 1 AS INTEGER) AS height,
  {n} AS "nChannels", string_agg({fmt}, '' ORDER BY y, x) AS data_hex FROM px GROUP BY image_id"""


@query("rasters_with_alpha", with_views(_RASTER.format(n=4, fmt="printf('%02X%02X%02X%02X', b, g, r, a)"), PX))
def rasters_with_alpha(spark, d):
    return pz.from_pixels(v.px(spark, d)).select("image_id", "width", "height", "nChannels", F.hex("data").alias("data_hex"))


@query("rasters_without_alpha", with_views(_RASTER.format(n=3, fmt="printf('%02X%02X%02X', b, g, r)"), PX))
def rasters_without_alpha(spark, d):
    out = pz.from_pixels(v.px(spark, d), alpha=False)
    return out.select("image_id", "width", "height", "nChannels", F.hex("data").alias("data_hex"))


# --- geometry ------------------------------------------------------------------------------------

def _geometry(name, x, y, swap, fn):
    w, h = ("height", "width") if swap else ("width", "height")
    sql = f"SELECT image_id, CAST({x} AS INTEGER) AS x, CAST({y} AS INTEGER) AS y, r, g, b, a, {w} AS width, {h} AS height FROM px"
    query(name, with_views(sql, PX))(lambda spark, d: _full(fn(v.px(spark, d))))


_geometry("rotate_90", "height - 1 - y", "x", True, pz.rotate90)
_geometry("rotate_180", "width - 1 - x", "height - 1 - y", False, pz.rotate180)
_geometry("rotate_270", "y", "width - 1 - x", True, pz.rotate270)
_geometry("flip_horizontal", "width - 1 - x", "y", False, pz.flip_h)
_geometry("flip_vertical", "x", "height - 1 - y", False, pz.flip_v)

_ORIENT = """SELECT image_id,
  CAST(CASE o WHEN 2 THEN width - 1 - x WHEN 3 THEN width - 1 - x WHEN 5 THEN y WHEN 6 THEN height - 1 - y
       WHEN 7 THEN height - 1 - y WHEN 8 THEN y ELSE x END AS INTEGER) AS x,
  CAST(CASE o WHEN 3 THEN height - 1 - y WHEN 4 THEN height - 1 - y WHEN 5 THEN x WHEN 6 THEN x
       WHEN 7 THEN width - 1 - x WHEN 8 THEN width - 1 - x ELSE y END AS INTEGER) AS y,
  r, g, b, a, CASE WHEN o IN (5, 6, 7, 8) THEN height ELSE width END AS width,
  CASE WHEN o IN (5, 6, 7, 8) THEN width ELSE height END AS height
FROM ({source})"""


@query("exif_orient", with_views(_ORIENT.format(source="SELECT *, image_id % 10 AS o FROM px"), PX))
def exif_orient(spark, d):
    return _full(pz.exif_orient(v.px(spark, d), F.col("image_id") % 10))


_ORIENTATIONS = """orientations AS (
  SELECT CAST(substr(path, 4) AS BIGINT) AS image_id, arg_max(CAST(value AS INTEGER), seq) AS o
  FROM tags WHERE ifd = 'primary' AND tag = 'Orientation' GROUP BY path)"""


@query(
    "auto_orient",
    with_views(_ORIENT.format(source="SELECT px.*, o FROM px LEFT JOIN orientations USING (image_id)"), PX, TAGS, _ORIENTATIONS),
)
def auto_orient(spark, d):
    from tileweave.operators.metadata import tag_flags

    flags = tag_flags(v.tags(spark, d)).select(F.substring("path", 4, 20).cast("bigint").alias("image_id"), "orientation")
    return _full(pz.auto_orient(v.px(spark, d), flags))


@query(
    "crop",
    with_views(
        """SELECT image_id, CAST(x - cx AS INTEGER) AS x, CAST(y - cy AS INTEGER) AS y, r, g, b, a,
        CAST(3 AS INTEGER) AS width, CAST(2 AS INTEGER) AS height
        FROM (SELECT *, image_id % 2 AS cx, image_id % 3 AS cy FROM px)
        WHERE x BETWEEN cx AND cx + 2 AND y BETWEEN cy AND cy + 1""",
        PX,
    ),
)
def crop(spark, d):
    return _full(pz.crop(v.px(spark, d), F.col("image_id") % 2, F.col("image_id") % 3, 3, 2))


# Independent of the running-parity method: compose one edit after the other.
_EDIT_CODES = """ordered AS (
  SELECT image_id, list(op ORDER BY conv_id, seq) AS ops FROM edits GROUP BY image_id),
folded AS (
  SELECT image_id, list_reduce(list_prepend('1', list_transform(ops, lambda o: o)), lambda s, o:
    CASE o
      WHEN 'cw' THEN CASE s WHEN '1' THEN '6' WHEN '2' THEN '7' WHEN '3' THEN '8' WHEN '4' THEN '5' WHEN '5' THEN '2'
                            WHEN '6' THEN '3' WHEN '7' THEN '4' ELSE '1' END
      WHEN 'ccw' THEN CASE s WHEN '1' THEN '8' WHEN '2' THEN '5' WHEN '3' THEN '6' WHEN '4' THEN '7' WHEN '5' THEN '4'
                             WHEN '6' THEN '1' WHEN '7' THEN '2' ELSE '3' END
      WHEN 'r180' THEN CASE s WHEN '1' THEN '3' WHEN '2' THEN '4' WHEN '3' THEN '1' WHEN '4' THEN '2' WHEN '5' THEN '7'
                              WHEN '6' THEN '8' WHEN '7' THEN '5' ELSE '6' END
      WHEN 'fliph' THEN CASE s WHEN '1' THEN '2' WHEN '2' THEN '1' WHEN '3' THEN '4' WHEN '4' THEN '3' WHEN '5' THEN '6'
                               WHEN '6' THEN '5' WHEN '7' THEN '8' ELSE '7' END
      ELSE CASE s WHEN '1' THEN '4' WHEN '2' THEN '3' WHEN '3' THEN '2' WHEN '4' THEN '1' WHEN '5' THEN '8'
                  WHEN '6' THEN '7' WHEN '7' THEN '6' ELSE '5' END
    END) AS code FROM ordered)"""


@query("edit_orientation", with_views("SELECT image_id, CAST(code AS INTEGER) AS orientation FROM folded", EDITS, _EDIT_CODES))
def edit_orientation(spark, d):
    return fr.edit_orientation(v.edits(spark, d), order=("conv_id", "seq"))


@query(
    "apply_edits",
    with_views(
        _ORIENT.format(source="SELECT px.*, CAST(code AS INTEGER) AS o FROM px LEFT JOIN folded USING (image_id)"),
        PX, EDITS, _EDIT_CODES,
    ),
)
def apply_edits(spark, d):
    return _full(fr.apply_edits(v.px(spark, d), v.edits(spark, d), order=("conv_id", "seq")))


@query(
    "overlay_on_canvas",
    with_views(
        """SELECT c.image_id, CAST(c.x AS INTEGER) AS x, CAST(c.y AS INTEGER) AS y, coalesce(r, 0) AS r, coalesce(g, 0) AS g,
        coalesce(b, 0) AS b, coalesce(a, 0) AS a, CAST(12 AS INTEGER) AS width, CAST(10 AS INTEGER) AS height
        FROM (SELECT image_id, width, height, x, y FROM (SELECT DISTINCT image_id, width, height FROM px),
                (SELECT unnest(range(0, 12)) AS x), (SELECT unnest(range(0, 10)) AS y)) c
        LEFT JOIN px ON px.image_id = c.image_id AND px.x = c.x - (image_offset_x) AND px.y = c.y - (image_offset_y)"""
        .replace("image_offset_x", "12 // 2 - c.width // 2").replace("image_offset_y", "10 // 2 - c.height // 2"),
        PX,
    ),
)
def overlay_on_canvas(spark, d):
    """Offsets may be negative here: 16×4 and 4×16 rasters overhang the 12×10 canvas."""
    px = v.px(spark, d)
    dx, dy = F.lit(6) - F.floor(F.col("width") / 2), F.lit(5) - F.floor(F.col("height") / 2)
    return _full(pz.overlay_on_canvas(px, 12, 10, dx, dy))


@query(
    "letterbox_frames",
    with_views(
        """SELECT c.image_id, CAST(c.x AS INTEGER) AS x, CAST(c.y AS INTEGER) AS y, coalesce(r, 0) AS r, coalesce(g, 0) AS g,
        coalesce(b, 0) AS b, coalesce(a, 0) AS a, CAST(20 AS INTEGER) AS width, CAST(18 AS INTEGER) AS height
        FROM (SELECT image_id, width, height, x, y FROM (SELECT DISTINCT image_id, width, height FROM px),
                (SELECT unnest(range(0, 20)) AS x), (SELECT unnest(range(0, 18)) AS y)) c
        LEFT JOIN px ON px.image_id = c.image_id AND px.x = c.x - (20 - c.width) // 2 AND px.y = c.y - (18 - c.height) // 2""",
        PX,
    ),
)
def letterbox_frames(spark, d):
    px = v.px(spark, d)
    box = letterbox("width", "height", 20, 18)
    return _full(pz.overlay_on_canvas(px, 20, 18, box["dx"], box["dy"]))


# --- resampling ----------------------------------------------------------------------------------

_NEAREST = """SELECT t.image_id, CAST(t.x AS INTEGER) AS x, CAST(t.y AS INTEGER) AS y, r, g, b, a,
  CAST({w} AS INTEGER) AS width, CAST({h} AS INTEGER) AS height
FROM (SELECT image_id, width, height, x, y FROM (SELECT DISTINCT image_id, width, height FROM px),
        (SELECT unnest(range(0, {w})) AS x), (SELECT unnest(range(0, {h})) AS y)) t
JOIN px ON px.image_id = t.image_id
  AND px.x = CAST(floor((t.x + 0.5e0) * t.width / {w}) AS INTEGER)
  AND px.y = CAST(floor((t.y + 0.5e0) * t.height / {h}) AS INTEGER)"""

for _name, _w, _h in (("resample_nearest_down", 5, 3), ("resample_nearest_up", 21, 19)):
    query(_name, with_views(_NEAREST.format(w=_w, h=_h), PX))(
        lambda spark, d, w=_w, h=_h: _full(rs.resample(v.px(spark, d), w, h, "nearest"))
    )

_KERNEL_SQL = {
    "bilinear": (1, "greatest(1 - abs(d), 0)"),
    "catmullrom": (
        2,
        "CASE WHEN abs(d) < 1 THEN (9 * abs(d)**3 - 15 * abs(d)**2 + 6) / 6.0e0 "
        "WHEN abs(d) < 2 THEN (-3 * abs(d)**3 + 15 * abs(d)**2 - 24 * abs(d) + 12) / 6.0e0 ELSE 0 END",
    ),
    "mitchell": (
        2,
        "CASE WHEN abs(d) < 1 THEN (7 * abs(d)**3 - 12 * abs(d)**2 + 16.0e0/3) / 6.0e0 "
        "WHEN abs(d) < 2 THEN (-7.0e0/3 * abs(d)**3 + 12 * abs(d)**2 - 20 * abs(d) + 32.0e0/3) / 6.0e0 ELSE 0 END",
    ),
    "lanczos3": (
        3,
        "CASE WHEN d = 0 THEN 1.0e0 WHEN abs(d) < 3 THEN (sin(pi() * d) / (pi() * d)) * (sin(pi() * d / 3) / (pi() * d / 3)) "
        "ELSE 0 END",
    ),
}
# Pull form: a normalised weight table per axis, then two joins.
_CONVOLVE = """
  {axis}_grid AS (
    SELECT n, s, t, ((s + 0.5e0) - (t + 0.5e0) * n / {m}) / greatest(n / {m}.0e0, 1) AS d
    FROM (SELECT DISTINCT {side} AS n FROM px), (SELECT unnest(range(0, 16)) AS s), (SELECT unnest(range(0, {m})) AS t)
    WHERE s < n),
  {axis}_raw AS (SELECT n, s, t, CASE WHEN n = {m} THEN CASE WHEN s = t THEN 1.0e0 ELSE 0 END ELSE {kernel} END AS w FROM {axis}_grid),
  {axis}_weights AS (SELECT n, s, t, w / sum(w) OVER (PARTITION BY n, t) AS w FROM {axis}_raw)"""


def _convolution(name: str, w: int, h: int, premultiply: bool = False) -> str:
    _, kernel = _KERNEL_SQL[name]
    colour = "{c} * a / 255.0e0" if premultiply else "{c}"
    back = "CASE WHEN round(a, 6) > 0 THEN {c} * 255 / a ELSE 0 END" if premultiply else "{c}"
    h_sums = ", ".join(f"sum(w * ({(colour if c != 'a' else '{c}').format(c=c)})) AS {c}" for c in "rgba")
    v_sums = ", ".join(f"sum(w * {c}) AS {c}" for c in "rgba")
    final = ", ".join(
        f"CAST(least(greatest(floor(round({(back if c != 'a' else '{c}').format(c=c)}, 6) + 0.5e0), 0), 255) AS INTEGER) AS {c}"
        for c in "rgba"
    )
    return with_views(
        f"""SELECT image_id, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, {final},
        CAST({w} AS INTEGER) AS width, CAST({h} AS INTEGER) AS height FROM vertical""",
        PX,
        _CONVOLVE.format(axis="h", side="width", m=w, kernel=kernel),
        _CONVOLVE.format(axis="v", side="height", m=h, kernel=kernel),
        f"""horizontal AS (SELECT image_id, t AS x, y, height, {h_sums} FROM px JOIN h_weights ON n = width AND s = x
            GROUP BY image_id, t, y, height)""",
        f"""vertical AS (SELECT image_id, x, t AS y, {v_sums} FROM horizontal JOIN v_weights ON n = height AND s = y
            GROUP BY image_id, x, t)""",
    )


for _kernel in _KERNEL_SQL:
    query(f"resample_{_kernel}", _convolution(_kernel, 5, 6))(
        lambda spark, d, k=_kernel: _full(rs.resample(v.px(spark, d), 5, 6, k))
    )
query("resample_lanczos3_up", _convolution("lanczos3", 16, 11))(
    lambda spark, d: _full(rs.resample(v.px(spark, d), 16, 11, rows_first=True))
)
query("resample_premultiplied", _convolution("lanczos3", 7, 5, premultiply=True))(
    lambda spark, d: _full(rs.resample(v.px(spark, d), 7, 5, premultiply=True))
)


# Sizes differ by frame, so weights are kept by source and target size.
_AXIS = """
  {axis}_grid AS (
    SELECT n, m, s, t, ((s + 0.5e0) - (t + 0.5e0) * n / m) / greatest(n / CAST(m AS DOUBLE), 1) AS d
    FROM (SELECT DISTINCT {side} AS n, {target} AS m FROM fit), (SELECT unnest(range(0, 16)) AS s), (SELECT unnest(range(0, 16)) AS t) WHERE s < n AND t < m),
  {axis}_raw AS (SELECT n, m, s, t, CASE WHEN n = m THEN CASE WHEN s = t THEN 1.0e0 ELSE 0 END ELSE {kernel} END AS w FROM {axis}_grid),
  {axis}_weights AS (SELECT n, m, s, t, w / sum(w) OVER (PARTITION BY n, m, t) AS w FROM {axis}_raw)"""
_SUMS = ", ".join(f"sum(w * {c}) AS {c}" for c in "rgba")
_SHOWN = ", ".join(f"CASE WHEN v.a > 0 THEN v.{c} ELSE 0 END AS {c}" for c in "rgba")


@query(
    "normalise_frames",
    with_views(
        f"""SELECT f.image_id, CAST(cx AS INTEGER) AS x, CAST(cy AS INTEGER) AS y, {_SHOWN}, CAST(cw AS INTEGER) AS width, CAST(ch AS INTEGER) AS height
        FROM fit f, (SELECT unnest(range(0, 16)) AS cx), (SELECT unnest(range(0, 16)) AS cy)
        LEFT JOIN shown v ON v.image_id = f.image_id AND v.x = cx - (cw - sw) // 2 AND v.y = cy - (ch - sh) // 2 WHERE cx < cw AND cy < ch""",
        PX,
        """canvas AS (SELECT image_id, width, height, first_value(width) OVER w AS cw, first_value(height) OVER w AS ch
          FROM (SELECT DISTINCT image_id, width, height FROM px) WINDOW w AS (PARTITION BY image_id // 4 ORDER BY image_id))""",
        """fit AS (SELECT *, CASE WHEN width > cw OR height > ch THEN greatest(CAST(round(width * z) AS INTEGER), 1) ELSE width END AS sw,
            CASE WHEN width > cw OR height > ch THEN greatest(CAST(round(height * z) AS INTEGER), 1) ELSE height END AS sh
          FROM (SELECT *, least(cw / CAST(width AS DOUBLE), ch / CAST(height AS DOUBLE)) AS z FROM canvas))""",
        _AXIS.format(axis="h", side="width", target="sw", kernel=_KERNEL_SQL["lanczos3"][1]),
        _AXIS.format(axis="v", side="height", target="sh", kernel=_KERNEL_SQL["lanczos3"][1]),
        f"""horizontal AS (SELECT px.image_id, t AS x, y, px.height, sh, {_SUMS} FROM px JOIN fit USING (image_id) JOIN h_weights ON n = px.width AND m = sw AND s = x
          GROUP BY px.image_id, t, y, px.height, sh)""",
        f"""vertical AS (SELECT image_id, x, t AS y, {_SUMS} FROM horizontal JOIN v_weights ON n = height AND m = sh AND s = y GROUP BY image_id, x, t)""",
        "shown AS (SELECT image_id, x, y, " + ", ".join(f"CAST(least(greatest(floor(round({c}, 6) + 0.5e0), 0), 255) AS INTEGER) AS {c}" for c in "rgba") + " FROM vertical)",
    ).replace("FROM fit f, (SELECT unnest(range(0, 16)) AS cx), (SELECT unnest(range(0, 16)) AS cy)", "FROM (SELECT * FROM fit, (SELECT unnest(range(0, 16)) AS cx), (SELECT unnest(range(0, 16)) AS cy)) f")
    .replace("CASE WHEN v.a > 0 THEN v.", "CASE WHEN coalesce(v.a, 0) > 0 THEN v."),
)
def normalise_frames(spark, d):
    """Four images in a row are an animation; the first one's shape is the canvas, and larger ones shrink, each to its own size."""
    px = v.px(spark, d)
    images = v.table(spark, d, "embeddings").select(F.col("vec_id").cast("bigint").alias("image_id"))
    width = v.shape_width(F.col("image_id"))
    frames = images.select(F.floor(F.col("image_id") / 4).alias("anim_id"), F.col("image_id").alias("seq"), "image_id", width.alias("width"), F.floor(F.lit(64) / width).cast("int").alias("height"))
    return _full(fr.normalise_frames(px, frames))


def _conv(name: str, source: str, axis: str, side: str, other: str, keep: str, target: str) -> str:
    """A pass of a convolution as SQL: ``name`` from ``source`` along x or y, by the weights of the same axis."""
    at, rest = ("x", "y") if axis == "h" else ("y", "x")
    sums = ", ".join(f"sum(w * {c}) AS {c}" for c in keep)
    return f"""{name} AS (SELECT image_id, {rest}, t AS {at}, {other}, {sums} FROM {source} JOIN {name}_weights ON n = {side} AND m = {target} AND s = {at} GROUP BY image_id, {rest}, t, {other})"""


def _weights(name: str, side: str, target: str) -> str:
    return _AXIS.format(axis=name, side=side, target=target, kernel=_KERNEL_SQL["lanczos3"][1]).replace("FROM fit", "FROM sides")


_BYTE = "CAST(least(greatest(floor(round({c}, 6) + 0.5e0), 0), 255) AS INTEGER)"


@query(
    "mask_images",
    with_views(
        f"SELECT px.image_id, px.x, px.y, px.r, px.g, px.b, {_BYTE.format(c='z.r')} AS a, px.width, px.height FROM px JOIN wide_y z USING (image_id, x, y)",
        PX,
        "sides AS (SELECT DISTINCT width, height, 8 AS side FROM px)",
        _weights("down_x", "width", "side"), _weights("down_y", "height", "side"), _weights("wide_x", "side", "width"), _weights("wide_y", "side", "height"),
        _conv("down_x", "px", "h", "width", "width, height", "r", "8"), _conv("down_y", "down_x", "v", "height", "width, height", "r", "8"),
        f"masks AS (SELECT image_id, x, y, width, height, CASE WHEN {_BYTE.format(c='r')} > 120 THEN 255 ELSE 0 END AS r FROM down_y)",
        _conv("wide_x", "masks", "h", "8", "width, height", "r", "width"), _conv("wide_y", "wide_x", "v", "8", "width, height", "r", "height"),
    ),
)
def mask_images(spark, d):
    """A model in closed form: a pixel of the 8 by 8 input is foreground where its red sample is above 120."""
    edge = (120.5 / 255 - tone.CHANNEL_MEAN[0]) / tone.CHANNEL_STD[0]
    return _full(masking.mask_images(v.px(spark, d), lambda: edge, lambda session, tensor: (tensor[0, 0] > session).astype("float32"), side=8))


# --- tone ----------------------------------------------------------------------------------------

def _rgb(template: str) -> str:
    return ", ".join(f"CAST({template.replace('@', c)} AS INTEGER) AS {c}" for c in "rgb")


def _tone(name, source, template, fn, *extra):
    sql = f"SELECT image_id, x, y, {_rgb(template)}, a, width, height FROM ({source})"
    query(name, with_views(sql, PX, *extra))(lambda spark, d: _full(fn(v.px(spark, d))))


_CONTRAST = "trunc(least(greatest(((@ / 255.0e0 - 0.5e0) * (((100.0e0 + {c}) / 100) * ((100.0e0 + {c}) / 100)) + 0.5e0) * 255, 0), 255))"
_LUMA = "(0.299e0 * r + 0.587e0 * g + 0.114e0 * b)"
_SATURATION = "round(least(greatest({luma} + (@ - {luma}) * (1.0e0 + {s} / 100.0e0), 0), 255))"
_GAMMA = "round(least(greatest(pow(@ / 255.0e0, {g}), 0), 1) * 255)"

_tone("brightness", "SELECT * FROM px", CLAMP.format("@ + 37"), lambda px: tone.brightness(px, 37))
_tone("contrast", "SELECT * FROM px", _CONTRAST.format(c="20"), lambda px: tone.contrast(px, 20.0))
_tone("saturation", "SELECT * FROM px", _SATURATION.format(luma=_LUMA, s="40"), lambda px: tone.saturation(px, 40.0))
_tone("gamma", "SELECT * FROM px", _GAMMA.format(g="1.8e0"), lambda px: tone.gamma(px, 1.8))
_tone(
    "tone_per_image",
    f"""SELECT image_id, x, y, a, width, height, {_rgb("CASE WHEN s <> 0 THEN " + _SATURATION.format(luma=_LUMA, s="s") + " ELSE @ END")}
        FROM (SELECT *, image_id % 7 - 3 AS n, image_id % 5 * 20 - 40 AS s FROM (
          SELECT image_id, x, y, a, width, height, {_rgb(CLAMP.format("@ + (image_id % 7 - 3)"))} FROM px))""",
    "CASE WHEN image_id % 4 <> 2 THEN round(least(greatest(pow(@ / 255.0e0, 0.5e0 + (image_id % 4) * 0.25e0), 0), 1) * 255) ELSE @ END",
    lambda px: tone.adjust(
        px, F.col("image_id") % 7 - 3, 0.0, (F.col("image_id") % 5 * 20 - 40).cast("double"),
        F.lit(0.5) + (F.col("image_id") % 4) * F.lit(0.25),
    ),
)
_ADJUSTED = f"""
  SELECT image_id, x, y, a, width, height, {_rgb(_GAMMA.format(g="1.2e0"))} FROM (
    SELECT image_id, x, y, a, width, height, {_rgb(_SATURATION.format(luma=_LUMA, s="-30"))} FROM (
      SELECT image_id, x, y, a, width, height, {_rgb(_CONTRAST.format(c="15"))} FROM (
        SELECT image_id, x, y, a, width, height, {_rgb(CLAMP.format("@ + 10"))} FROM px)))"""
_tone("adjust", _ADJUSTED, "@", lambda px: tone.adjust(px, 10, 15.0, -30.0, 1.2))

_HIST = """SELECT image_id, channel, bin, count(*) AS cnt FROM (
  SELECT image_id, 'R' AS channel, r AS bin FROM {t} UNION ALL SELECT image_id, 'G', g FROM {t}
  UNION ALL SELECT image_id, 'B', b FROM {t}) GROUP BY image_id, channel, bin"""


@query("adjusted_histogram", with_views(_HIST.format(t="adjusted"), PX, f"adjusted AS ({_ADJUSTED})"))
def adjusted_histogram(spark, d):
    """The flagship: tone adjustment and histogram, one shuffle of partial counts."""
    return stats.histogram(tone.adjust(v.px(spark, d), 10, 15.0, -30.0, 1.2))


@query(
    "adjust_identity",
    with_views(
        """SELECT id, brightness = 0 AND abs(contrast) < 0.01e0 AND abs(saturation) < 0.01e0 AND abs(gamma - 1) < 0.001e0
        AS is_identity FROM params UNION ALL SELECT -1 - id, abs(gamma - 1) < 0.001e0 FROM params""",
        PARAMS,
    ),
)
def adjust_identity(spark, d):
    p = v.params(spark, d)
    return p.select("id", tone.is_identity("brightness", "contrast", "saturation", "gamma").alias("is_identity")).unionByName(
        p.select((-1 - F.col("id")).alias("id"), tone.is_identity(gamma_="gamma").alias("is_identity"))
    )


_CHW = " UNION ALL ".join(
    f"SELECT image_id, CAST({i} AS INTEGER) AS c, y, x, ({c} / 255.0e0 - {m}e0) / {s}e0 AS v FROM px"
    for i, (c, m, s) in enumerate(zip("rgb", (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)))
)


@query("normalize_chw", with_views(_CHW, PX))
def normalize_chw(spark, d):
    return tone.normalize_chw(v.px(spark, d))


@query("mask_to_alpha", with_views("SELECT image_id, x, y, CAST(trunc(least(greatest(m, 0), 1) * 255) AS INTEGER) AS alpha FROM mask", MASK))
def mask_to_alpha(spark, d):
    return v.mask(spark, d).select("image_id", "x", "y", tone.mask_to_alpha("m").alias("alpha"))


@query(
    "apply_mask",
    with_views(
        """SELECT image_id, x, y, r, g, b, CAST(trunc(least(greatest(m, 0), 1) * 255) AS INTEGER) AS a, width, height
        FROM px JOIN mask USING (image_id, x, y)""",
        PX, MASK,
    ),
)
def apply_mask(spark, d):
    return _full(tone.apply_mask(v.px(spark, d), v.mask(spark, d)))


@query(
    "lut_join",
    with_views(
        """SELECT image_id, x, y, coalesce(CAST(mapped AS INTEGER), r) AS r, g, b, a, width, height FROM px
        LEFT JOIN (SELECT p_partkey % 256 AS v, max(p_size) AS mapped FROM part GROUP BY 1) ON v = r""",
        PX,
    ),
)
def lut_join(spark, d):
    """A lookup table kept as data: replaces red through a table of the largest size per key, derived from ``part``."""
    lut = v.table(spark, d, "part").groupBy((F.col("p_partkey") % 256).cast("int").alias("v")).agg(F.max("p_size").cast("int").alias("mapped"))
    return _full(tone.lut_join(v.px(spark, d), lut))


# --- histograms ----------------------------------------------------------------------------------

@query("histogram", with_views(_HIST.format(t="px"), PX))
def histogram(spark, d):
    return stats.histogram(v.px(spark, d))


@query(
    "histogram_dense",
    with_views(
        """SELECT i.image_id, c.channel, CAST(n.bin AS INTEGER) AS bin, coalesce(h.cnt, 0) AS cnt
        FROM (SELECT DISTINCT image_id FROM px) i, (SELECT unnest(['R', 'G', 'B']) AS channel) c,
             (SELECT unnest(range(0, 256)) AS bin) n
        LEFT JOIN h ON h.image_id = i.image_id AND h.channel = c.channel AND h.bin = n.bin""",
        PX, f"h AS ({_HIST.format(t='px')})",
    ),
)
def histogram_dense(spark, d):
    return stats.histogram_dense(v.px(spark, d))


@query(
    "histogram_rebin",
    with_views(
        """SELECT image_id, channel, col, cnt, cnt / CAST(greatest(max(cnt) OVER (PARTITION BY image_id, channel), 1) AS DOUBLE) AS height
        FROM (SELECT image_id, channel, CAST(bin * 50 // 256 AS BIGINT) AS col, CAST(sum(cnt) AS BIGINT) AS cnt FROM h
              GROUP BY image_id, channel, bin * 50 // 256)""",
        PX, f"h AS ({_HIST.format(t='px')})",
    ),
)
def histogram_rebin(spark, d):
    return stats.histogram_rebin(stats.histogram(v.px(spark, d)), 50)
