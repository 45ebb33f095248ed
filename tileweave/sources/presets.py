"""Rendition presets as data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .formats import literal_table, sql_literal

COLUMNS = (
    "preset_id, preset_group, op, percent, fit, target, quality, progressive, optimize, "
    "degrees, axis, brightness, contrast, saturation, policy, suffix, preset_ord"
)
_FIELDS = [c.strip() for c in COLUMNS.split(",")][:-1]


def _preset(preset_id: str, group: str, op: str, **params) -> tuple:
    row = {"policy": "skip", "progressive": False, "optimize": False, "suffix": "", **params}
    return (preset_id, group, op, *[row.get(f) for f in _FIELDS[3:]])


# Preset names and parameters, in menu order. A null percent, fit box, target or
# quality means that the preset leaves it alone; rotation without degrees follows the orientation tag.
# The suffix is what the naming functions give for the same parameters.
PRESETS = [
    _preset("convert-png", "convert", "convert", target="png"),
    _preset("convert-jpg", "convert", "convert", target="jpeg"),
    _preset("convert-webp", "convert", "convert", target="webp"),
    _preset("convert-avif", "convert", "convert", target="avif"),
    _preset("convert-tiff", "convert", "convert", target="tiff"),
    _preset("resize-25pct", "resize", "resize", percent=25, suffix="_25pct"),
    _preset("resize-50pct", "resize", "resize", percent=50, suffix="_50pct"),
    _preset("resize-200pct", "resize", "resize", percent=200, suffix="_200pct"),
    _preset("resize-hd-1920", "resize", "resize", fit=1920, suffix="_fit-1920x1920"),
    _preset("resize-4k-3840", "resize", "resize", fit=3840, suffix="_fit-3840x3840"),
    _preset("rotate-90", "rotate", "rotate", degrees=90, suffix="_rot90"),
    _preset("rotate-180", "rotate", "rotate", degrees=180, suffix="_rot180"),
    _preset("rotate-270", "rotate", "rotate", degrees=270, suffix="_rot270"),
    _preset("rotate-auto-exif", "rotate", "rotate", policy="increment", suffix="_auto"),
    _preset("flip-horizontal", "flip", "flip", axis="horizontal", suffix="_flipH"),
    _preset("flip-vertical", "flip", "flip", axis="vertical", suffix="_flipV"),
    _preset("adjust-brightness-plus", "adjust", "adjust", brightness=10, suffix="_b10"),
    _preset("adjust-brightness-minus", "adjust", "adjust", brightness=-10, suffix="_b-10"),
    _preset("adjust-contrast-plus", "adjust", "adjust", contrast=20, suffix="_c20"),
    _preset("adjust-bw", "adjust", "adjust", saturation=-100, suffix="_s-100"),
    _preset("adjust-vivid", "adjust", "adjust", saturation=40, suffix="_s40"),
    _preset("web-whatsapp", "web", "resize", fit=1280, target="jpeg", quality=85, progressive=True, suffix="_fit-1280x1280"),
    _preset("web-instagram", "web", "resize", fit=1080, target="jpeg", quality=90, progressive=True, suffix="_fit-1080x1080"),
    _preset("web-facebook", "web", "resize", fit=2048, target="jpeg", quality=85, progressive=True, suffix="_fit-2048x2048"),
    _preset("web-twitter", "web", "resize", fit=1200, target="jpeg", quality=85, progressive=True, suffix="_fit-1200x1200"),
    _preset("web-telegram", "web", "resize", fit=2560, target="jpeg", quality=85, progressive=True, suffix="_fit-2560x2560"),
    _preset("web-discord", "web", "resize", fit=2048, target="jpeg", quality=80, progressive=True, suffix="_fit-2048x2048"),
    _preset("web-optimize-png", "web", "convert", target="png", optimize=True, policy="replace"),
]


def presets(spark: SparkSession) -> DataFrame:
    return literal_table(spark, COLUMNS, [(*row, i) for i, row in enumerate(PRESETS)])


def preset_array() -> Column:
    """All presets as one literal array of structs, to be exploded next to each image."""
    types = {name: "int" for name in ("percent", "fit", "quality", "degrees", "brightness", "contrast", "saturation")}
    types |= {"progressive": "boolean", "optimize": "boolean"}

    def struct(ord_: int, row: tuple) -> str:
        fields = [f"'{n}', CAST({sql_literal(v)} AS {types.get(n, 'string')})" for n, v in zip(_FIELDS, row)]
        return f"named_struct({', '.join(fields)}, 'preset_ord', {ord_})"

    return F.expr(f"array({', '.join(struct(i, row) for i, row in enumerate(PRESETS))})")
