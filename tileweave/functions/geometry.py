"""Target sizes and placements: integer and double arithmetic on the source sides.

Every function returns a struct column; sides are bigint, so products of two
32-bit sides cannot overflow.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .numeric import as_col, gcd, int_div, round_half_up

# Preview edge, thumbnail box, upscale factors.
PREVIEW_EDGE = 800
THUMB_BOX = 80
UPSCALE_FACTORS = (2, 3, 4)


def _side(value) -> Column:
    return as_col(value).cast("bigint")


def _at_least_one(value: Column) -> Column:
    return F.greatest(value, F.lit(1).cast("bigint"))


def size(width, height) -> Column:
    return F.struct(_side(width).alias("width"), _side(height).alias("height"))


def dims_max_edge(width, height, edge) -> Column:
    """Longest side at most ``edge``; the other side is floored, never below 1. Never enlarges."""
    w, h, e = _side(width), _side(height), _at_least_one(_side(edge))
    fits = (w <= e) & (h <= e)
    wide = w >= h
    out_w = F.when(fits, w).when(wide, e).otherwise(_at_least_one(int_div(w * e, h)))
    out_h = F.when(fits, h).when(wide, _at_least_one(int_div(h * e, w))).otherwise(e)
    return F.struct(out_w.alias("width"), out_h.alias("height"))


def dims_percent(width, height, percent) -> Column:
    """Both sides times ``percent``/100, rounded half up. The percentage is a single-precision value."""
    f = as_col(percent).cast("float").cast("double") / F.lit(100.0)
    sides = [_at_least_one(round_half_up(_side(v).cast("double") * f)) for v in (width, height)]
    return F.struct(sides[0].alias("width"), sides[1].alias("height"))


def dims_exact(width, height) -> Column:
    """The requested size as given; aspect is ignored."""
    return size(width, height)


def dims_fit(width, height, box_width, box_height) -> Column:
    """Largest size inside the box with the same aspect; may enlarge."""
    w, h = _side(width).cast("double"), _side(height).cast("double")
    scale = F.least(
        as_col(box_width).cast("double") / F.nullif(w, F.lit(0.0)),
        as_col(box_height).cast("double") / F.nullif(h, F.lit(0.0)),
    )
    return F.struct(
        _at_least_one(round_half_up(w * scale)).alias("width"),
        _at_least_one(round_half_up(h * scale)).alias("height"),
    )


def dims_upscale(width, height, factor) -> Column:
    return dims_percent(width, height, as_col(factor) * 100)


def dims_preview(width, height) -> Column:
    """Working size for previews, with the scale from source to preview pixels."""
    d = dims_max_edge(width, height, PREVIEW_EDGE)
    scale = d["width"].cast("double") / _at_least_one(_side(width)).cast("double")
    return F.struct(d["width"].alias("width"), d["height"].alias("height"), scale.alias("scale"))


def dims_thumb(width, height) -> Column:
    return dims_fit(width, height, THUMB_BOX, THUMB_BOX)


def scale_rect(x, y, width, height, ratio) -> Column:
    """Rounds every field on its own, so the result may overhang by a pixel; validate it afterwards."""
    r = as_col(ratio).cast("double")
    sx, sy, sw, sh = (round_half_up(_side(v).cast("double") * r) for v in (x, y, width, height))
    return F.struct(sx.alias("x"), sy.alias("y"), _at_least_one(sw).alias("width"), _at_least_one(sh).alias("height"))


def default_crop(width, height) -> Column:
    """Centred rectangle of half the size."""
    w, h = _side(width), _side(height)
    cw, ch = _at_least_one(int_div(w, 2)), _at_least_one(int_div(h, 2))
    return F.struct(
        int_div(w - cw, 2).alias("x"), int_div(h - ch, 2).alias("y"), cw.alias("width"), ch.alias("height")
    )


def contain_fit(view_width, view_height, image_width, image_height) -> Column:
    """Scale and offsets that centre an image in a view; (1, 0, 0) unless all four are positive."""
    vw, vh, iw, ih = (as_col(v).cast("double") for v in (view_width, view_height, image_width, image_height))
    ok = (vw > 0) & (vh > 0) & (iw > 0) & (ih > 0)
    s = F.least(vw / F.nullif(iw, F.lit(0.0)), vh / F.nullif(ih, F.lit(0.0)))
    return F.struct(
        F.when(ok, s).otherwise(1.0).alias("scale"),
        F.when(ok, (vw - iw * s) / 2.0).otherwise(0.0).alias("dx"),
        F.when(ok, (vh - ih * s) / 2.0).otherwise(0.0).alias("dy"),
    )


def letterbox(width, height, canvas_width, canvas_height) -> Column:
    """Size and offset of a frame on a canvas: shrunk to fit when larger in either side, then centred."""
    w, h, cw, ch = (_side(v) for v in (width, height, canvas_width, canvas_height))
    larger = (w > cw) | (h > ch)
    fit = dims_fit(w, h, cw, ch)
    sw, sh = F.when(larger, fit["width"]).otherwise(w), F.when(larger, fit["height"]).otherwise(h)
    return F.struct(
        sw.alias("width"), sh.alias("height"), int_div(cw - sw, 2).alias("dx"), int_div(ch - sh, 2).alias("dy")
    )


def aspect_ratio(width, height) -> Column:
    """``16:9`` for 1920×1080; null when a side is 0."""
    w, h = _side(width), _side(height)

    def ratio(d: Column) -> Column:
        reduced = (F.call_function("div", side, d).cast("string") for side in (w, h))
        return F.concat_ws(":", *reduced)

    return F.when((w > 0) & (h > 0), gcd(w, h, ratio))


def megapixels(width, height) -> Column:
    """Millions of pixels, null below 0.1."""
    mp = _side(width).cast("double") * _side(height).cast("double") / 1e6
    return F.when(mp >= 0.1, mp)
