"""A batch of one operation over many files, from listing to report, around a user encoder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.paths import output_path
from ..functions.validation import admit
from ..operators.audit import decide_outcome
from ..operators.images import map_images
from ..operators.naming import resolve_increment_all, resolve_replace, resolve_skip
from ..operators.stats import batch_averages, batch_summary
from ..session import cut_lineage, spread
from ..sources.formats import extension_of, sniff_format
from ..sources.headers import with_dims, with_headers


#: Operations that keep the source's format unless told otherwise.
KEEP_FORMAT = ("resize", "rotate", "flip", "crop", "adjust")


def plan_conversion(
    files: DataFrame, existing: DataFrame, target: str, policy: str = "skip",
    output_dir: str | None = None, suffix: str | None = None,
) -> DataFrame:
    """``plan_operation`` for ``convert``."""
    return plan_operation("convert", files, existing, target, policy, output_dir, F.lit(suffix) if suffix else None)


def plan_operation(
    operation: str, files: DataFrame, existing: DataFrame, target: str | None = None, policy: str = "skip",
    output_dir: str | None = None, suffix: Column | None = None, params_error: Column | None = None,
    sides: Column | None = None, in_place: bool = False,
) -> DataFrame:
    """Names, admission and status of every file before any pixel is read.

    A file whose size cannot be read from its header is not admitted (``unreadable_header``): its pixels may be any number.

    ``files`` has ``ord, path, length`` and maybe ``content``: without it, tasks read header ranges of the files.
    ``existing`` has ``output``. The result carries
    ``status`` = skipped or failed for rows that are settled, and null for rows still to be encoded.
    Under ``replace`` only the last input of an output is encoded; the others are skipped with
    ``error_kind`` superseded. Content is not in the result.

    ``operation`` sets the order of the checks (``audit.CHECK_ORDER``). ``suffix`` and ``params_error`` are
    columns that may use ``width`` and ``height``, as the naming and validation functions give them. Without
    a ``target`` the operations in ``KEEP_FORMAT`` keep the source's format. ``sides``, a struct of ``width`` and ``height``,
    is returned as ``out_width`` and ``out_height``.

    An output that is its own input exists, whether or not the listing has it; ``replace`` refuses it
    (``output_is_input``) unless it may work ``in_place``.
    """
    if target is None and operation not in KEEP_FORMAT:
        raise ValueError(f"{operation} needs a target")
    directory = F.lit(output_dir) if output_dir else None
    if "content" in files.columns:
        sized = with_dims(sniff_format(files, name="source_format")).drop("content").withColumn("read_error", F.lit(None).cast("string"))
    else:
        sized = with_headers(spread(files))
    sized = sized.withColumn("target", F.lit(target) if target else F.col("source_format"))
    sized = sized.withColumn("params_error", params_error if params_error is not None else F.lit(None).cast("string"))
    named = sized.withColumn("output", output_path("path", suffix, extension_of("target"), directory))
    named = named.withColumn(
        "decode_error",
        F.when(F.col("output").isNull() & F.col("target").isNotNull(), "no_stem")
        .when(F.col("read_error").isNotNull(), "unreadable_file")
        .when(F.col("source_format").isNull(), "unsupported_format")
        .when(F.lit(policy == "replace" and not in_place) & (F.col("output") == F.col("path")), "output_is_input")
        .otherwise(admit("length", "width", "height")),
    )
    out = sides if sides is not None else F.lit(None).cast("struct<width:bigint,height:bigint>")
    named = named.withColumns({"out_width": out["width"], "out_height": out["height"]})
    # Everything below works on these narrow facts, several times over; the files are read once.
    named = cut_lineage(named)
    existing = existing.select("output").unionByName(named.filter("output = path").select("output"))
    # An input that cannot be decoded writes nothing, so it takes no name and stands in nobody's way.
    sound = named.filter("decode_error IS NULL AND params_error IS NULL").select("ord", "output")
    named = named.withColumn("_exists", F.lit(False))
    if policy == "increment":
        placed = resolve_increment_all(sound.withColumnRenamed("output", "naive"), existing)
        named = named.join(placed.select("ord", F.col("output").alias("_placed")), "ord", "left")
        named = named.withColumn("output", F.when(F.col("decode_error").isNull() & F.col("params_error").isNull(), F.col("_placed")).otherwise(F.col("output")))
        named = named.withColumn("decode_error", F.when(F.col("output").isNull(), F.coalesce("decode_error", F.lit("too_many_siblings"))).otherwise(F.col("decode_error")))
    elif policy == "skip":
        # A broken input is skipped only because of a file that is really there, not a sibling in the batch.
        late = resolve_skip(sound, existing).filter(F.col("status") == "skipped").select("ord")
        broken = named.filter("decode_error IS NOT NULL OR params_error IS NOT NULL").join(existing.select("output"), "output", "left_semi")
        skipped = late.unionByName(broken.select("ord")).withColumn("_skip", F.lit(True))
        named = named.join(skipped, "ord", "left").withColumn("_exists", F.col("_skip").isNotNull())
    else:
        lost = resolve_replace(sound).filter("superseded").select("ord", F.lit(True).alias("_lost"))
        named = named.join(lost, "ord", "left")
    verdict = decide_outcome(operation, "decode_error", "params_error", "_exists", policy)
    superseded = F.col("_lost").isNotNull() if policy == "replace" else F.lit(False)
    kind = (
        F.when(superseded, "superseded")
        .when(F.col("_v.error") == "unsupported_format", "unsupported_format")
        .when(F.col("_v.error") == "unreadable_file", "io")
        .when(F.col("_v.error").isNotNull(), "invalid_input")
    )
    return (
        named.withColumn("_v", verdict)
        .select(
            "ord", "path", "length", "source_format", "width", "height", "target", "output",
            F.when(superseded, "skipped").when(F.col("_v.status") != "written", F.col("_v.status")).alias("status"),
            kind.alias("error_kind"), F.col("_v.error").alias("error"), *(["out_width", "out_height"] if sides is not None else []),
        )
    )


def run_conversion(
    files: DataFrame, existing: DataFrame, target: str, encode: Callable[[str, bytes, str], int | None],
    policy: str = "skip", output_dir: str | None = None, read_by_path: bool = True, tasks: int | None = None,
) -> DataFrame:
    """``run_operation`` for ``convert``."""
    return run_operation("convert", files, existing, encode, target, policy, output_dir, read_by_path=read_by_path, tasks=tasks)


def run_operation(
    operation: str, files: DataFrame, existing: DataFrame, encode: Callable[[str, bytes, str], int | None],
    target: str | None = None, policy: str = "skip", output_dir: str | None = None, suffix: Column | None = None,
    params_error: Column | None = None, read_by_path: bool = True, tasks: int | None = None, in_place: bool = False,
) -> DataFrame:
    """Outcome rows of the whole batch: settled rows from the plan, the rest through ``encode``.

    The plan works on header facts and names and is checkpointed before anything is written: what a
    retried task recomputes must not see the batch's own outputs as existing ones. Files still to be encoded are read by their tasks, so
    file content never crosses a shuffle; pass ``read_by_path=False`` when ``content`` is small and
    ``path`` is not a real location. Outcomes are written once, so that reading them again does not encode again.

    Under ``skip``, an output whose writer fails goes to the next input that asks for it, until one writes it or
    none is left.
    """
    plan = cut_lineage(plan_operation(operation, files, existing, target, policy, output_dir, suffix, params_error, in_place=in_place))

    def encoded(rows: DataFrame) -> DataFrame:
        todo = rows.select("ord", "path", "output")
        if not read_by_path:
            todo = todo.join(files.select("ord", "content"), "ord")
        return cut_lineage(map_images(spread(todo, tasks), encode))

    settled = plan.filter("status IS NOT NULL")
    if policy == "skip":
        # Rows that were skipped for a sibling's sake, not for a file that was there. Fixed before anything is
        # written: a failed writer may leave part of its file in a listing that is read live.
        waiting = cut_lineage(settled.filter("status = 'skipped' AND error IS NULL AND output IS NOT NULL AND output <> path").join(existing.select("output"), "output", "left_anti"))
    done = encoded(plan.filter("status IS NULL"))
    if policy == "skip":
        failed = done.filter("status = 'failed'").select("output")
        while True:
            turn = waiting.join(failed, "output", "left_semi").groupBy("output").agg(F.min("ord").alias("ord")).select("ord")
            turn = cut_lineage(turn)
            if turn.isEmpty():
                break
            again = encoded(plan.join(turn, "ord", "left_semi"))
            done, settled, waiting = done.unionByName(again), settled.join(turn, "ord", "left_anti"), waiting.join(turn, "ord", "left_anti")
            failed = again.filter("status = 'failed'").select("output")
    settled = settled.select(
        "ord", F.col("path").alias("input"), "output", "status", "error_kind", "error",
        F.col("length").alias("bytes_in"), F.lit(None).cast("bigint").alias("bytes_out"),
    )
    return done.unionByName(settled)


def report(outcomes: DataFrame, *keys: str) -> DataFrame:
    """Counts, byte totals, averages and exit code in one row per key."""
    summary = batch_averages(batch_summary(outcomes, *keys))
    return summary.withColumn("exit_code", F.when(F.col("fail") > 0, 2).otherwise(0))
