"""Animations and edit lists: ordered per-image work without sending an image's rows to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.geometry import letterbox
from ..functions.numeric import as_col
from ..session import cut_lineage
from .ordering import with_range_blocks
from .pixels import overlay_on_canvas, tasks_for
from .resample import resample

# Shortest frame delay, quantiser speed range.
MIN_DELAY_MS = 10
SPEED_RANGE = (1, 30)


def frame_plan(frames: DataFrame, anim_id: str = "anim_id", seq: str = "seq", blocks: int | None = None) -> DataFrame:
    """Frame number, canvas, start time and letterbox of every frame.

    The first frame's size is the canvas of the whole animation; delays are at least 10 ms; a frame
    starts when all earlier delays have passed. Blocks are ranges of the data, however its numbers are spaced.
    """
    delay = F.greatest(F.col("delay_ms"), F.lit(MIN_DELAY_MS)).cast("bigint")
    blocked = with_range_blocks(frames.withColumn("delay_ms", delay), [anim_id, seq], blocks, "_block")
    inside = Window.partitionBy(anim_id, "_block").orderBy(seq)
    running = inside.rowsBetween(Window.unboundedPreceding, -1)
    local = blocked.withColumns(
        {"_no": F.row_number().over(inside), "_start": F.coalesce(F.sum("delay_ms").over(running), F.lit(0))}
    )
    # Sides travel as bigint, so both aggregates stay on the hash path.
    heads = blocked.groupBy(anim_id, "_block").agg(
        F.count("*").alias("_n"),
        F.sum("delay_ms").alias("_ms"),
        F.min_by(F.col("width").cast("bigint"), F.col(seq)).alias("_cw"),
        F.min_by(F.col("height").cast("bigint"), F.col(seq)).alias("_ch"),
    )
    in_order = Window.partitionBy(anim_id).orderBy("_block")
    earlier = in_order.rowsBetween(Window.unboundedPreceding, -1)
    per_block = heads.select(
        anim_id,
        "_block",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n_before"),
        F.coalesce(F.sum("_ms").over(earlier), F.lit(0)).alias("_ms_before"),
        F.first("_cw").over(in_order).alias("canvas_width"),
        F.first("_ch").over(in_order).alias("canvas_height"),
    )
    joined = local.join(per_block, [anim_id, "_block"])
    box = letterbox("width", "height", "canvas_width", "canvas_height")
    return joined.select(
        *[c for c in frames.columns if c != "delay_ms"],
        "delay_ms",
        (F.col("_no") + F.col("_n_before")).alias("frame_no"),
        (F.col("_start") + F.col("_ms_before")).alias("start_ms"),
        "canvas_width", "canvas_height",
        box["width"].alias("scaled_width"), box["height"].alias("scaled_height"),
        box["dx"].alias("dx"), box["dy"].alias("dy"),
    )


def normalise_frames(
    px: DataFrame, frames: DataFrame, anim_id: str = "anim_id", seq: str = "seq", image_id: str = "image_id", filter_: str = "lanczos3",
) -> DataFrame:
    """Every frame on the canvas of its animation's first frame: shrunk to fit where it is larger in a side, centred, transparent around.

    ``px`` are the pixels of the frames; ``frames`` has a row per frame: ``anim_id, seq, image_id, width, height`` and maybe ``delay_ms``.
    Only frames that are larger are resampled, each to its own size; pixels of frames without a row are left out.
    """
    rows = frames if "delay_ms" in frames.columns else frames.withColumn("delay_ms", F.lit(MIN_DELAY_MS))
    plan = cut_lineage(frame_plan(rows.select(anim_id, seq, image_id, "width", "height", "delay_ms"), anim_id, seq).select(
        image_id, (F.col("width").cast("bigint") * F.col("height")).alias("_pixels"), F.col("scaled_width").cast("int").alias("_sw"), F.col("scaled_height").cast("int").alias("_sh"),
        F.col("canvas_width").alias("_cw"), F.col("canvas_height").alias("_ch"), F.col("dx").alias("_dx"), F.col("dy").alias("_dy"),
    ))
    sizes = plan.agg(F.sum("_pixels"), F.sum(F.col("_cw").cast("bigint") * F.col("_ch"))).first()
    tasks = tasks_for(px.sparkSession, max(sizes[0] or 0, sizes[1] or 0))
    plan = plan.drop("_pixels")
    columns = [image_id, "x", "y", "r", "g", "b", "a", "width", "height"]
    sized = px.select(*columns).join(plan.select(image_id, "_sw", "_sh"), image_id)
    larger = (F.col("width") != F.col("_sw")) | (F.col("height") != F.col("_sh"))
    shrunk = resample(sized.filter(larger), F.col("_sw"), F.col("_sh"), filter_, image_id, tasks=tasks)
    placed = sized.filter(~larger).select(*columns).unionByName(shrunk.select(*columns)).join(plan.drop("_sw", "_sh"), image_id)
    images = plan.groupBy(image_id).agg(*[F.max(F.col(c).cast("bigint")).alias(c) for c in ("_cw", "_ch")]).join(px.select(image_id).distinct(), image_id, "left_semi")
    return overlay_on_canvas(placed, "_cw", "_ch", "_dx", "_dy", image_id, images, tasks)


def loop_plan(loop_count, speed) -> Column:
    """Loop mode, encoder repeat count and clamped speed: 0 loops for ever, 1 plays once."""
    n = as_col(loop_count)
    return F.struct(
        F.when(n == 0, "infinite").when(n == 1, "once").otherwise("finite").alias("loop_mode"),
        F.when(n == 0, F.lit(None).cast("int")).when(n == 1, 0).otherwise(n.cast("int")).alias("repeat"),
        F.least(F.greatest(as_col(speed).cast("int"), F.lit(SPEED_RANGE[0])), F.lit(SPEED_RANGE[1])).alias("speed"),
    )


def edit_orientation(
    edits: DataFrame, image_id: str = "image_id", order: tuple[str, ...] = ("seq",), op: str = "op",
    block: str | None = None,
) -> DataFrame:
    """One orientation value 1–8 per image, equivalent to its whole ordered edit list.

    ``op`` is cw, ccw, r180, fliph or flipv. Any list of these is a mirror (or none) followed by
    quarter turns, and a later mirror reverses the sense of earlier turns. So the turns add up with
    a sign given by the parity of the mirrors so far — a running count, done in blocks — and no
    edit list is ever collected. ``block`` names an order-preserving block column if the table has
    one; otherwise range blocks are made.
    """
    if block is None:
        edits, block = with_range_blocks(edits, list(order), name="_block"), "_block"
    o = F.col(op)
    mirror = F.when(o.isin("fliph", "flipv"), 1).otherwise(0).cast("bigint")
    turns = F.when(o == "cw", 1).when(o.isin("r180", "flipv"), 2).when(o == "ccw", 3).otherwise(0).cast("bigint")
    so_far = Window.partitionBy(image_id, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    signed = edits.select(image_id, block, *order, mirror.alias("_m"), turns.alias("_t")).withColumn(
        "_signed", F.when(F.sum("_m").over(so_far) % 2 == 0, F.col("_t")).otherwise(-F.col("_t"))
    )
    per_block = signed.groupBy(image_id, block).agg(F.sum("_signed").alias("_k"), F.sum("_m").alias("_m"))
    earlier = Window.partitionBy(image_id).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    flipped = F.coalesce(F.sum("_m").over(earlier), F.lit(0)) % 2 == 1
    per_image = (
        per_block.withColumn("_k", F.when(flipped, -F.col("_k")).otherwise(F.col("_k")))
        .groupBy(image_id)
        .agg(F.sum("_k").alias("_k"), (F.sum("_m") % 2).alias("_f"))
    )
    quarter = F.pmod(F.when(F.col("_f") == 1, -F.col("_k")).otherwise(F.col("_k")), F.lit(4))
    # Orientation values for 0–3 clockwise turns, unmirrored and after a horizontal mirror.
    plain, mirrored = F.array(*map(F.lit, (1, 6, 3, 8))), F.array(*map(F.lit, (2, 7, 4, 5)))
    at = (quarter + 1).cast("int")
    code = F.when(F.col("_f") == 1, F.element_at(mirrored, at)).otherwise(F.element_at(plain, at))
    return per_image.select(image_id, code.alias("orientation"))


def apply_edits(
    px: DataFrame, edits: DataFrame, image_id: str = "image_id", order: tuple[str, ...] = ("seq",),
    op: str = "op", block: str | None = None,
) -> DataFrame:
    """Applies each image's edit list in one projection; images without edits stay as they are."""
    from .pixels import auto_orient

    return auto_orient(px, edit_orientation(edits, image_id, order, op, block), image_id)
