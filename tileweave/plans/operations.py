"""Operations that know their names, checks and sizes: one value describes what a batch does to its files.

Numbers are Python values or columns of the table of files, so rows may differ. Every operation but ``convert``
adds its own suffix to the name, so that its output is never its input.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import geometry, paths, validation
from ..functions.numeric import as_col
from ..operators.metadata import tag_flags
from ..operators.tone import adjust_tag
from ..sources.exif import exif_tags
from .conversion import plan_operation, run_operation


def _param(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


@dataclass(frozen=True)
class Operation:
    """``kind`` orders the checks; ``suffix`` and ``params_error`` go into the plan; ``sides`` gives the output's size."""

    kind: str
    suffix: Column | None = None
    params_error: Column | None = None
    sides: Column | None = None
    target: str | None = None
    follows_orientation: bool = False


def _pair(width, height) -> Column:
    return F.struct(as_col(width).cast("bigint").alias("width"), as_col(height).cast("bigint").alias("height"))


def _turned(swap) -> Column:
    return F.when(swap, _pair("height", "width")).otherwise(_pair("width", "height"))


def convert(target: str) -> Operation:
    return Operation("convert", target=target, sides=_pair("width", "height"))


def resize(max_edge=None, percent=None, exact=None, fit=None, target: str | None = None) -> Operation:
    """One of a longest edge, a percentage, an exact size and a box to fit in (pairs)."""
    given = [p is not None for p in (max_edge, percent, exact, fit)]
    if sum(given) != 1:
        raise ValueError("resize takes exactly one of max_edge, percent, exact and fit")
    if max_edge is not None:
        edge = _param(max_edge)
        return Operation("resize", paths.max_edge_suffix(edge), validation.validate_resize_max_edge("width", "height"), geometry.dims_max_edge("width", "height", edge), target)
    if percent is not None:
        p = _param(percent)
        return Operation("resize", paths.percent_suffix(p), validation.validate_resize_percent("width", "height", p), geometry.dims_percent("width", "height", p), target)
    w, h = map(_param, exact if exact is not None else fit)
    error = validation.validate_resize_box("width", "height", w, h)
    if exact is not None:
        return Operation("resize", paths.exact_suffix(w, h), error, _pair(w, h), target)
    return Operation("resize", paths.fit_suffix(w, h), error, geometry.dims_fit("width", "height", w, h), target)


def rotate(degrees: int | None = None, target: str | None = None) -> Operation:
    """By 90, 180 or 270 degrees; without degrees by the file's own orientation tag, upright files included."""
    if degrees not in (None, 90, 180, 270):
        raise ValueError(f"cannot rotate by {degrees} degrees")
    if degrees is None:
        return Operation("rotate", paths.rotate_suffix(F.lit(None)), None, _turned(F.coalesce(F.col("orientation").between(5, 8), F.lit(False))), target, True)
    return Operation("rotate", paths.rotate_suffix(F.lit(degrees)), None, _turned(F.lit(degrees != 180)), target)


def flip(axis: str, target: str | None = None) -> Operation:
    if axis not in ("horizontal", "vertical"):
        raise ValueError(f"unknown axis: {axis}")
    return Operation("flip", paths.flip_suffix(F.lit(axis)), None, _pair("width", "height"), target)


def crop(x, y, width, height, target: str | None = None) -> Operation:
    x, y, w, h = map(_param, (x, y, width, height))
    return Operation("crop", paths.crop_suffix(x, y, w, h), validation.validate_crop(x, y, w, h, "width", "height"), _pair(w, h), target)


def adjust(brightness=0, contrast=0.0, saturation=0.0, gamma=1.0, target: str | None = None) -> Operation:
    p = tuple(map(_param, (brightness, contrast, saturation, gamma)))
    return Operation("adjust", F.concat(F.lit("_"), adjust_tag(*p)), validation.validate_adjust(*p), _pair("width", "height"), target)


def with_orientation(files: DataFrame) -> DataFrame:
    """Adds ``orientation`` from each file's tags, null where there is none: a broken block is none, too.

    Tags come from ``content`` if there is such a column, else from ranges of the file.
    """
    tags = exif_tags(files, content="content" if "content" in files.columns else None)
    return files.join(tag_flags(tags).select("path", "orientation"), "path", "left")


def plan(operation: Operation, files: DataFrame, existing: DataFrame, policy: str = "skip", output_dir: str | None = None, in_place: bool = False) -> DataFrame:
    """``conversion.plan_operation`` with ``out_width`` and ``out_height`` of the rows that are to be written.

    ``files`` has ``ord, path, length``, maybe ``content`` (without it, header ranges are read from the files), and the
    columns that parameters use.
    """
    if operation.follows_orientation:
        files = with_orientation(files)
    return plan_operation(
        operation.kind, files, existing, operation.target, policy, output_dir, operation.suffix, operation.params_error,
        sides=operation.sides, in_place=in_place,
    )


def run(
    operation: Operation, files: DataFrame, existing: DataFrame, encode: Callable[[str, bytes, str], int | None],
    policy: str = "skip", output_dir: str | None = None, in_place: bool = False, tasks: int | None = None,
) -> DataFrame:
    """``conversion.run_operation`` of an operation; files are read by their tasks unless they carry ``content``."""
    if operation.follows_orientation:
        files = with_orientation(files)
    return run_operation(
        operation.kind, files, existing, encode, operation.target, policy, output_dir, operation.suffix, operation.params_error,
        read_by_path="content" not in files.columns, tasks=tasks, in_place=in_place,
    )
