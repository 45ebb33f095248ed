"""Path text functions: last component, stem, extension, parent, and output names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .numeric import as_col

# Fixed patterns. Trailing slashes and "/." do not count as a component; "." and ".." are no names; an
# extension starts at the last dot, unless that dot is the first character of the name. All are
# anchored or possessive, so matching stays linear, and every function below matches once.
NAME = r"^(?:[\s\S]*/)?(?!\.{1,2}(?:/|$))([^/]+)(?:/+\.)*/*$"
DOT_EXTENSION = r"(?<=[\s\S])\.([^.]*)$"
PARENT = r"^(/(?=/*[^/]++(?:/+\.)*/*$)|[\s\S]*?)(?:/+(?:\./+)*)?[^/]++(?:/+\.)*/*$"


def file_name(path) -> Column:
    """Last component; null for ``/``, ``.``, ``..`` and the empty path."""
    return F.nullif(F.regexp_extract(as_col(path), NAME, 1), F.lit(""))


def stem(path) -> Column:
    """File name without its extension."""
    return F.nullif(F.regexp_replace(F.regexp_extract(as_col(path), NAME, 1), DOT_EXTENSION, ""), F.lit(""))


def extension(path) -> Column:
    """Text after the last dot (may be empty); null when there is no extension."""
    name = F.regexp_extract(as_col(path), NAME, 1)
    return F.when(name.rlike(DOT_EXTENSION), F.regexp_extract(name, DOT_EXTENSION, 1))


def parent(path) -> Column:
    """Everything before the last component: ``""`` for a bare name, null when there is none."""
    p = as_col(path)
    return F.when(p.rlike("[^/]"), F.regexp_extract(p, PARENT, 1))


def join_path(directory, *parts) -> Column:
    """One slash between a directory and a name; none after an empty directory."""
    return F.concat(F.regexp_replace(as_col(directory), r"([^/])$", "$1/"), *[as_col(p) for p in parts])


def output_path(path, suffix, extension_, output_dir=None) -> Column:
    """``dir/stem + suffix + "." + extension``; null when the input has no stem.

    The directory is ``output_dir`` if given, else the input's parent, else ``.``.
    """
    directory = F.coalesce(*([as_col(output_dir)] if output_dir is not None else []), parent(path), F.lit("."))
    suffix = F.coalesce(as_col(suffix), F.lit("")) if suffix is not None else F.lit("")
    return join_path(directory, stem(path), suffix, F.lit("."), as_col(extension_))


def percent_suffix(percent) -> Column:
    """``_50pct``: shortest decimal text, without a trailing ``.0``."""
    text = as_col(percent).cast("float").cast("string").try_cast("decimal(30,15)").cast("string")
    return F.concat(F.lit("_"), F.regexp_replace(text, r"\.?0+$", ""), F.lit("pct"))


def max_edge_suffix(edge) -> Column:
    return F.concat(F.lit("_"), as_col(edge).cast("string"))


def exact_suffix(width, height) -> Column:
    return F.concat(F.lit("_"), as_col(width).cast("string"), F.lit("x"), as_col(height).cast("string"))


def fit_suffix(width, height) -> Column:
    return F.concat(F.lit("_fit-"), as_col(width).cast("string"), F.lit("x"), as_col(height).cast("string"))


def rotate_suffix(degrees) -> Column:
    """``_rot90`` and so on; null degrees mean rotation by the recorded orientation."""
    d = as_col(degrees)
    return F.when(d.isNull(), F.lit("_auto")).otherwise(F.concat(F.lit("_rot"), d.cast("string")))


def flip_suffix(axis) -> Column:
    """Axis is ``horizontal`` or ``vertical``."""
    return F.when(as_col(axis) == "horizontal", F.lit("_flipH")).otherwise(F.lit("_flipV"))


def crop_suffix(x, y, width, height) -> Column:
    parts = [F.lit("_crop-"), as_col(width), F.lit("x"), as_col(height), F.lit("+"), as_col(x), F.lit("+"), as_col(y)]
    return F.concat(*[p.cast("string") for p in parts])


def mask_output_path(path) -> Column:
    """Masked results are always PNG: ``stem_nobg.png`` next to the input."""
    return output_path(path, F.lit("_nobg"), F.lit("png"))
