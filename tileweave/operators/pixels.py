"""Rasters as pixel rows, and geometry on them.

A pixel table has one row per pixel: ``image_id, x, y, r, g, b, a`` and, where an operator needs
the extent, ``width, height``. Rasters are rows of ``width, height, nChannels, data`` with samples
in B, G, R(, A) order, as Spark's ``image`` source delivers them. Geometry operators are
projections: no shuffle, whatever the image sizes. The pixel table suits thumbnails, tiles and
collection-wide statistics; full-size originals are better served by ``map_images``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.numeric import as_col
from ..functions.validation import MAX_PIXELS
from ..session import cut_lineage

#: Pixels that a task aggregates; in memory they take about a hundred bytes each.
PIXELS_PER_TASK = 500_000


def to_pixels(images: DataFrame, image_id: str = "image_id", spread_lines: bool = False) -> DataFrame:
    """Raster rows to pixel rows; alpha is 255 without an alpha channel, gray (with or without alpha) fills r, g and b.

    Samples are bytes: where the rasters have a ``mode`` (OpenCV type), one of another depth is refused.

    Exploded in two steps, scanlines first, so no array is longer than a side of the image.
    ``spread_lines`` shuffles the scanlines (as many bytes as the rasters have), so that a few very
    large images keep all tasks busy; many images do not need it.
    """
    channels = F.col("nChannels")
    if "mode" in images.columns:
        refused = F.raise_error(F.concat(F.lit("only 8-bit rasters have pixels here, mode "), F.col("mode").cast("string"))).cast("binary")
        images = images.withColumn("data", F.when(F.coalesce(F.col("mode") % 8, F.lit(0)) == 0, F.col("data")).otherwise(refused))
    stride = F.col("width") * channels
    lines = (
        images.filter((F.col("width") > 0) & (F.col("height") > 0))
        .select(image_id, "width", "height", "nChannels", "data", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y"))
        .select(
            image_id, "width", "height", "nChannels", "y",
            F.substring(F.col("data"), F.col("y") * stride + 1, stride).alias("_line"),
        )
    )
    if spread_lines:
        lines = lines.repartition(image_id, "y")
    # One packed integer per pixel instead of one conversion per sample.
    packed = (
        lines.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("width") - 1)))
        .withColumn(
            "_p",
            F.conv(F.hex(F.substring(F.col("_line"), F.col("x") * channels + 1, channels)), 16, 10).cast("bigint"),
        )
    )

    def byte(shift: int) -> Column:
        return F.shiftright("_p", shift).bitwiseAND(F.lit(255)).cast("int")

    def sample(gray: Column, rgb: Column, rgba: Column) -> Column:
        return F.when(channels <= 2, gray).when(channels == 3, rgb).otherwise(rgba)

    opaque = F.lit(255)
    first = F.when(channels == 2, byte(8)).otherwise(byte(0))
    return packed.select(
        image_id, "width", "height", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"),
        sample(first, byte(0), byte(8)).alias("r"),
        sample(first, byte(8), byte(16)).alias("g"),
        sample(first, byte(16), byte(24)).alias("b"),
        sample(F.when(channels == 2, byte(0)).otherwise(opaque), opaque, byte(0)).alias("a"),
    )


def from_pixels_bands(px: DataFrame, image_id: str = "image_id", alpha: bool = True, band_lines: int = 256) -> DataFrame:
    """Pixel rows to bands of scanlines: ``image_id, band, first_line, width, height, pixels, data``.

    ``width`` and ``height`` are the band's extent by its largest coordinates; ``pixels`` counts its rows, so a
    hole shows as ``pixels < width * height``. There is no limit on an image's size.
    """
    packed = F.lit(0).cast("bigint")
    for channel in "bgra" if alpha else "bgr":
        packed = packed * 256 + F.col(channel)
    digits = 8 if alpha else 6
    lines = (
        px.select(image_id, "x", "y", F.unhex(F.lpad(F.hex(packed), digits, "0")).alias("_p"))
        .groupBy(image_id, "y")
        .agg(F.count("*").alias("_n"), F.max("x").alias("_x"), F.expr("listagg(_p) WITHIN GROUP (ORDER BY x)").alias("_line"))
    )
    bands = lines.groupBy(image_id, F.floor(F.col("y") / band_lines).alias("band")).agg(
        F.min("y").alias("first_line"), (F.max("_x") + 1).cast("int").alias("width"), F.max("y").alias("_last"),
        F.sum("_n").alias("pixels"), F.expr("listagg(_line) WITHIN GROUP (ORDER BY y)").alias("data"),
    )
    return bands.select(image_id, "band", "first_line", "width", (F.col("_last") - F.col("first_line") + 1).cast("int").alias("height"), "pixels", "data")


def from_pixels(px: DataFrame, image_id: str = "image_id", alpha: bool = True) -> DataFrame:
    """Pixel rows to one raster row per image, with a ``status``.

    ``decoded``: the raster is complete. ``incomplete``: a pixel is missing or given twice. ``too_large``: one row
    cannot hold it (over the pixel cap). The last two have no ``data``; ``from_pixels_bands`` has no limit.
    """
    bands = from_pixels_bands(px, image_id, alpha)
    sizes = bands.groupBy(image_id).agg(
        F.max("width").alias("width"), F.max(F.col("first_line") + F.col("height")).cast("int").alias("height"), F.sum("pixels").alias("_pixels")
    )
    area = F.col("width").cast("bigint") * F.col("height")
    status = F.when(area != F.col("_pixels"), "incomplete").when(area > MAX_PIXELS, "too_large").otherwise("decoded")
    sizes = sizes.select(image_id, "width", "height", status.alias("status"))
    fit = bands.join(sizes.filter("status = 'decoded'").select(image_id), image_id, "left_semi")
    data = fit.groupBy(image_id).agg(F.expr("listagg(data) WITHIN GROUP (ORDER BY band)").alias("data"))
    return sizes.join(data, image_id, "left").select(
        image_id, "width", "height", F.lit(4 if alpha else 3).alias("nChannels"), F.lit(24 if alpha else 16).alias("mode"), "data", "status"
    )


def _moved(px: DataFrame, x: Column, y: Column, swap: bool | Column = False) -> DataFrame:
    """Replaces the coordinates and, where the axes swap, the extent (if the table carries it)."""
    changes = {"x": x.cast("int"), "y": y.cast("int")}
    if "width" in px.columns and "height" in px.columns and swap is not False:
        w, h = F.col("width"), F.col("height")
        flag = F.lit(True) if swap is True else swap
        changes |= {"width": F.when(flag, h).otherwise(w), "height": F.when(flag, w).otherwise(h)}
    return px.withColumns(changes)


def rotate90(px: DataFrame, width="width", height="height") -> DataFrame:
    """Clockwise."""
    return _moved(px, as_col(height) - 1 - F.col("y"), F.col("x"), swap=True)


def rotate180(px: DataFrame, width="width", height="height") -> DataFrame:
    return _moved(px, as_col(width) - 1 - F.col("x"), as_col(height) - 1 - F.col("y"))


def rotate270(px: DataFrame, width="width", height="height") -> DataFrame:
    return _moved(px, F.col("y"), as_col(width) - 1 - F.col("x"), swap=True)


def flip_h(px: DataFrame, width="width", height="height") -> DataFrame:
    return _moved(px, as_col(width) - 1 - F.col("x"), F.col("y"))


def flip_v(px: DataFrame, width="width", height="height") -> DataFrame:
    return _moved(px, F.col("x"), as_col(height) - 1 - F.col("y"))


def exif_orient(px: DataFrame, orientation="orientation", width="width", height="height") -> DataFrame:
    """Puts an image upright by its orientation value 1–8; anything else, null included, is identity.

    Values 2, 3, 7, 8 mirror the columns and 3, 4, 6, 7 the rows; 5–8 then swap the axes.
    """
    o = F.coalesce(as_col(orientation).cast("int"), F.lit(1))
    u = F.when(o.isin(2, 3, 7, 8), as_col(width) - 1 - F.col("x")).otherwise(F.col("x"))
    v = F.when(o.isin(3, 4, 6, 7), as_col(height) - 1 - F.col("y")).otherwise(F.col("y"))
    swap = o.between(5, 8)
    return _moved(px, F.when(swap, v).otherwise(u), F.when(swap, u).otherwise(v), swap=swap)


def auto_orient(px: DataFrame, orientations: DataFrame, image_id: str = "image_id") -> DataFrame:
    """Orients every image by its row in ``orientations(image_id, orientation)``; no row means upright.

    Only rows that change something take part in the join. Neither side is hinted: the optimizer
    broadcasts the orientation side if its measured size allows and shuffles otherwise.
    """
    turned = orientations.select(
        F.col(image_id), F.col("orientation").cast("int").alias("_orientation")
    ).filter(F.col("_orientation").between(2, 8))
    return exif_orient(px.join(turned, image_id, "left"), "_orientation").drop("_orientation")


def crop(px: DataFrame, x, y, width, height) -> DataFrame:
    """Keeps a rectangle and moves it to the origin; the rectangle may be columns of the table."""
    cx, cy, cw, ch = (as_col(v) for v in (x, y, width, height))
    inside = (F.col("x") >= cx) & (F.col("x") < cx + cw) & (F.col("y") >= cy) & (F.col("y") < cy + ch)
    kept = px.filter(inside)
    changes = {"x": (F.col("x") - cx).cast("int"), "y": (F.col("y") - cy).cast("int")}
    if "width" in px.columns and "height" in px.columns:
        changes |= {"width": cw.cast("int"), "height": ch.cast("int")}
    return kept.withColumns(changes)


def tasks_for(spark: SparkSession, pixels: int | None) -> int:
    """Tasks for so many rows of pixels. Adaptive execution would merge by bytes, and pixels compress so well that millions would meet in a task."""
    return max(spark.sparkContext.defaultParallelism, -(-(pixels or 0) // PIXELS_PER_TASK))


def overlay_on_canvas(
    px: DataFrame, canvas_width, canvas_height, dx, dy, image_id: str = "image_id", images: DataFrame | None = None, tasks: int | None = None,
) -> DataFrame:
    """Every image on its own transparent canvas, shifted by (dx, dy); overhanging pixels are cut.

    The parameters may be columns that are constant per image. The canvas is the shifted pixels over an empty
    frame, one aggregation by cell deciding for the pixel, so holes in an image are empty cells. The frame comes from one row per image, its
    lines before its cells, so that no task makes a whole canvas out of one row. Lines are dealt over as many tasks as the number of
    cells asks for. ``images`` (``image_id, _cw, _ch``) and ``tasks`` save finding the canvases in the pixels, if they are known.
    """
    cw, ch, ox, oy = (as_col(v).cast("bigint") for v in (canvas_width, canvas_height, dx, dy))
    placed = px.select(
        image_id, "r", "g", "b", "a", cw.alias("_cw"), ch.alias("_ch"), (F.col("x") + ox).alias("x"), (F.col("y") + oy).alias("y"),
    )
    if images is None or tasks is None:
        images = cut_lineage(placed.groupBy(image_id).agg(F.max("_cw").alias("_cw"), F.max("_ch").alias("_ch")))
        tasks = tasks_for(px.sparkSession, images.agg(F.sum(F.col("_cw") * F.col("_ch"))).first()[0])
    zero = F.lit(0).cast("bigint")
    lines = images.withColumn("y", F.explode(F.sequence(zero, F.col("_ch") - 1))).repartition(tasks, image_id, "y")
    frame = lines.withColumn("x", F.explode(F.sequence(zero, F.col("_cw") - 1)))
    on_canvas = (F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("x") < F.col("_cw")) & (F.col("y") < F.col("_ch"))
    shown = placed.filter(on_canvas & (F.col("a") > 0))
    # Dealt out before the aggregation: nothing is to be combined ahead of it, as a frame's cells all differ.
    both = shown.unionByName(frame.withColumns({c: F.lit(0) for c in "rgba"})).repartition(tasks, image_id, "y")
    # A cell's two rows, pixel and frame, meet at one integer: samples are bytes, and a shown pixel has alpha above 0.
    packed = F.col("a").cast("bigint") * 16777216 + F.col("r") * 65536 + F.col("g") * 256 + F.col("b")
    cells = both.groupBy(image_id, "x", "y", "_cw", "_ch").agg(F.max(packed).alias("_v"))
    sample = {c: F.shiftright("_v", bits).bitwiseAND(255) for c, bits in (("a", 24), ("r", 16), ("g", 8), ("b", 0))}
    return cells.withColumns(sample).select(
        image_id, F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), *[F.col(c).cast("int").alias(c) for c in "rgba"],
        F.col("_cw").cast("int").alias("width"), F.col("_ch").cast("int").alias("height"),
    )
