"""The format dimension: 13 formats, their extensions, MIME types and accepted spellings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.binary import sniff_content
from ..functions.numeric import as_col
from ..functions.paths import extension

# Format, file extension, MIME type, in listing order.
FORMATS = [
    ("png", "png", "image/png"),
    ("jpeg", "jpg", "image/jpeg"),
    ("webp", "webp", "image/webp"),
    ("avif", "avif", "image/avif"),
    ("tiff", "tiff", "image/tiff"),
    ("bmp", "bmp", "image/bmp"),
    ("gif", "gif", "image/gif"),
    ("ico", "ico", "image/vnd.microsoft.icon"),
    ("pnm", "ppm", "image/x-portable-anymap"),
    ("tga", "tga", "image/x-tga"),
    ("qoi", "qoi", "image/qoi"),
    ("hdr", "hdr", "image/vnd.radiance"),
    ("openexr", "exr", "image/x-exr"),
]

# Accepted spellings, lower case.
ALIASES = {
    "png": ["png"],
    "jpeg": ["jpg", "jpeg", "jpe"],
    "webp": ["webp"],
    "avif": ["avif"],
    "tiff": ["tif", "tiff"],
    "bmp": ["bmp", "dib"],
    "gif": ["gif"],
    "ico": ["ico"],
    "pnm": ["pnm", "ppm", "pgm", "pbm", "pam"],
    "tga": ["tga", "targa"],
    "qoi": ["qoi"],
    "hdr": ["hdr", "rgbe"],
    "openexr": ["exr", "openexr"],
}


def sql_literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    return f"'{value}'" if isinstance(value, str) else str(value)


def literal_table(spark: SparkSession, columns: str, rows: list[tuple]) -> DataFrame:
    """A small constant table that the optimizer sees as a LocalRelation of known size."""
    body = ", ".join("(" + ", ".join(map(sql_literal, row)) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({columns})")


def formats(spark: SparkSession) -> DataFrame:
    return literal_table(spark, "format, extension, mime, ord", [(*row, i) for i, row in enumerate(FORMATS)])


def format_aliases(spark: SparkSession) -> DataFrame:
    return literal_table(spark, "alias, format", [(a, name) for name, names in ALIASES.items() for a in names])


def spelling(text) -> Column:
    """The normal form in which spellings are compared."""
    return F.lower(F.trim(as_col(text)))


def parse_format(df: DataFrame, text, name: str = "format") -> DataFrame:
    """Adds the format a spelling stands for; null means unsupported. 23 literal rows are broadcast."""
    aliases = format_aliases(df.sparkSession).select(F.col("alias").alias("_alias"), F.col("format").alias(name))
    return df.join(F.broadcast(aliases), spelling(text) == F.col("_alias"), "left").drop("_alias")


def extension_of(format_) -> Column:
    """Canonical extension of a format column, as an expression over the 13 literals."""
    f = as_col(format_)
    (first, ext, _), *rest = FORMATS
    out = F.when(f == first, ext)
    for name, ext, _ in rest:
        out = out.when(f == name, ext)
    return out


def sniff_format(df: DataFrame, content="content", path="path", name: str = "format") -> DataFrame:
    """Format by content, falling back to the extension only when no magic bytes match."""
    by_name = parse_format(df.withColumn("_ext", extension(path)), "_ext", "_by_name")
    sniffed = sniff_content(content)
    return by_name.withColumn(
        name, F.when(sniffed != "unsupported", sniffed).when(sniffed.isNull(), F.col("_by_name"))
    ).drop("_ext", "_by_name")


def format_mismatch(df: DataFrame, sniffed="sniffed", path="path") -> DataFrame:
    """Rows whose content and extension name different formats, spellings of one format being equal."""
    named = parse_format(df.withColumn("_ext", extension(path)), "_ext", "ext_format").drop("_ext")
    return named.filter(as_col(sniffed) != F.col("ext_format"))
