"""Every image times every preset: as a plan, which is one narrow projection, and as a batch that reads every file once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.encoding import encode_settings
from ..functions.geometry import dims_fit, dims_percent
from ..functions.paths import join_path, parent, stem
from ..functions.validation import admit
from ..operators.images import read_file
from ..operators.naming import resolve_increment_all, resolve_replace, resolve_skip
from ..session import cut_lineage, small_batches, spread
from ..sources.formats import extension_of, sniff_format
from ..sources.headers import with_dims, with_headers
from ..sources.presets import PRESETS, preset_array

RENDITION_OUTCOME = "ord bigint, preset_id string, output string, status string, error_kind string, error string, bytes_in bigint, bytes_out bigint"


def plan_renditions(images: DataFrame, output_dir: str | None = None) -> DataFrame:
    """One row per image and preset: size, target, encoder settings, output name and policy.

    ``images`` has ``ord, path, width, height, format``; a column ``orientation``, if present, is
    followed by the automatic rotation. Presets are a literal array exploded next to each row, so
    there is no join and the plan keeps the partitioning of its input. An image of unknown format gets its
    rows with ``status`` failed, without target and output; other rows have none yet.
    """
    orientation = F.col("orientation") if "orientation" in images.columns else F.lit(1)
    directory = F.lit(output_dir) if output_dir else parent("path")
    # Path parts once per image; per rendition only a concatenation is left.
    rows = images.select(
        "ord", "path", "width", "height", "format", F.coalesce(orientation, F.lit(1)).alias("_orientation"),
        join_path(F.coalesce(directory, F.lit(".")), stem("path")).alias("_base"),
    ).select("*", F.inline(preset_array()))
    op = F.col("op")
    pct, fit = dims_percent("width", "height", "percent"), dims_fit("width", "height", "fit", "fit")
    swap = (op == "rotate") & (
        F.col("degrees").isin(90, 270) | (F.col("degrees").isNull() & F.col("_orientation").between(5, 8))
    )

    def side(name: str, other: str):
        scaled = F.when(F.col("percent").isNotNull(), pct[name]).when(F.col("fit").isNotNull(), fit[name])
        return F.when(swap, F.col(other)).otherwise(F.coalesce(scaled, F.col(name))).cast("bigint").alias(f"out_{name}")

    return rows.withColumn("target", F.when(F.col("format").isNotNull(), F.coalesce("target", "format"))).select(
        "ord", "path", "preset_id", "preset_group", "preset_ord", side("width", "height"), side("height", "width"),
        "target", F.when(F.col("target").isNotNull(), encode_settings("target", "quality", "optimize")).alias("encoder"),
        F.concat("_base", "suffix", F.lit("."), extension_of("target")).alias("output"), "policy",
        F.when(F.col("target").isNull(), "failed").alias("status"),
    )


def name_renditions(files: DataFrame, existing: DataFrame, output_dir: str | None = None, only: list[str] | None = None) -> DataFrame:
    """``plan_renditions`` of files with names that are settled: ``edge``, and ``status`` and ``error`` of what is not to be written.

    ``files`` has ``ord, path, length``, maybe ``content`` and ``orientation``; ``existing`` has ``output``. Edges are taken in order of
    file and preset, under their preset's policy: ``skip`` and ``increment`` see the listing, the files themselves and each
    other (increment after skip); of ``replace`` edges with one output the last is written, over its own input, too.
    ``only`` limits the presets.
    """
    if "content" in files.columns:
        sized = with_dims(sniff_format(files, name="source_format")).drop("content").withColumn("read_error", F.lit(None).cast("string"))
    else:
        sized = with_headers(spread(files))
    error = F.when(F.col("read_error").isNotNull(), "unreadable_file").when(F.col("source_format").isNull(), "unsupported_format").otherwise(admit("length", "width", "height"))
    sized = cut_lineage(sized.withColumn("error", error).withColumnRenamed("source_format", "format"))
    plan = plan_renditions(sized, output_dir).drop("status")
    if only is not None:
        plan = plan.filter(F.col("preset_id").isin(*only))
    edges = plan.join(sized.select("ord", "length", "error"), "ord").withColumn("edge", F.col("ord") * len(PRESETS) + F.col("preset_ord"))
    edges = edges.withColumn("error", F.coalesce("error", F.when(F.col("output").isNull(), "no_stem")))
    edges = cut_lineage(edges.withColumn("kind", F.when(F.col("error") == "unreadable_file", "io").when(F.col("error") == "unsupported_format", F.col("error")).when(F.col("error").isNotNull(), "invalid_input")))
    sound = edges.filter("error IS NULL").select("edge", "output", "policy")
    taken = existing.select("output").unionByName(sized.select(F.col("path").alias("output"))).distinct()

    def of(policy: str) -> DataFrame:
        return sound.filter(F.col("policy") == policy).select(F.col("edge").alias("ord"), "output")

    first = cut_lineage(resolve_skip(of("skip"), taken))
    later = taken.unionByName(first.filter("status = 'written'").select("output"))
    placed = resolve_increment_all(of("increment").withColumnRenamed("output", "naive"), later)
    lost = resolve_replace(of("replace")).filter("superseded")
    verdicts = (
        first.filter("status = 'skipped'").select("ord", F.lit("skipped").alias("status"), F.lit(None).cast("string").alias("why"), F.lit(None).cast("string").alias("placed"))
        .unionByName(lost.select("ord", F.lit("skipped").alias("status"), F.lit("superseded").alias("why"), F.lit(None).cast("string").alias("placed")))
        .unionByName(placed.select("ord", F.when(F.col("output").isNull(), "failed").alias("status"), F.when(F.col("output").isNull(), "too_many_siblings").alias("why"), F.col("output").alias("placed")))
    )
    named = edges.join(verdicts.withColumnRenamed("ord", "edge"), "edge", "left")
    return named.select(
        "edge", "ord", "path", "length", "preset_id", "preset_ord", "target", "encoder", "out_width", "out_height", F.coalesce("placed", "output").alias("output"),
        F.when(F.col("error").isNotNull(), "failed").otherwise(F.col("status")).alias("status"),
        F.when(F.col("why") == "superseded", "superseded").when(F.col("why").isNotNull(), "invalid_input").otherwise(F.col("kind")).alias("error_kind"),
        F.coalesce("error", F.when(F.col("why") != "superseded", F.col("why"))).alias("error"),
    )


def run_renditions(
    files: DataFrame, existing: DataFrame, open_image: Callable[[str, bytes], object], render: Callable[[object, dict], int],
    output_dir: str | None = None, only: list[str] | None = None, tasks: int | None = None,
) -> DataFrame:
    """One outcome row per file and preset; every file is read and opened once, however many renditions it feeds.

    ``open_image(path, content)`` decodes, ``render(image, edge)`` writes one rendition and returns its bytes; ``edge`` has
    ``preset_id, output, target, out_width, out_height`` and the encoder's settings. An exception of ``render`` fails that rendition, one of
    ``open_image`` all of the file's. The plan is fixed before anything is written, outcomes are written once. A file has at most as many
    edges as there are presets, so its edges travel in one row; a worker holds few rows at a time, since their edges become Python objects.
    """
    with small_batches(files.sparkSession):
        plan = cut_lineage(name_renditions(files, existing, output_dir, only))
    inline = "content" in files.columns
    edge = F.struct("preset_ord", "preset_id", "output", "target", "out_width", "out_height", F.to_json("encoder").alias("encoder"))
    todo = plan.filter("status IS NULL").groupBy("ord", "path").agg(F.sort_array(F.collect_list(edge)).alias("edges"))
    if inline:
        todo = todo.join(files.select("ord", "content"), "ord")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            contents, rows = batch["content"] if inline else [None] * len(batch), []
            for ord_, path, edges, content in zip(batch["ord"], batch["path"], batch["edges"], contents):
                image, size, failure = None, None, None
                try:
                    content = read_file(path) if content is None else bytes(content)
                    size, image = len(content), open_image(path, content)
                except Exception as error:
                    failure = error
                for e in edges:
                    e, written, error = dict(e), None, failure
                    if error is None:
                        try:
                            written = render(image, e)
                        except Exception as wrong:
                            error = wrong
                    row = (ord_, e["preset_id"], e["output"])
                    rows.append((*row, "written", None, None, size, written) if error is None else (*row, "failed", type(error).__name__, f"{path}: {error}", size, None))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in RENDITION_OUTCOME.split(", ")])
            yield out.astype({"bytes_in": "Int64", "bytes_out": "Int64"})

    with small_batches(files.sparkSession):
        done = cut_lineage(spread(todo, tasks).mapInPandas(run, RENDITION_OUTCOME))
    settled = plan.filter("status IS NOT NULL").select("ord", "preset_id", "output", "status", "error_kind", "error", F.col("length").alias("bytes_in"), F.lit(None).cast("bigint").alias("bytes_out"))
    return done.unionByName(settled)
