"""Header bytes: content sniffing, header-only dimensions, hashing."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .numeric import as_col

# Magic bytes as (format, offset, hex), longest and most specific first.
MAGIC = [
    ("png", 0, "89504E470D0A1A0A"),
    ("jpeg", 0, "FFD8FF"),
    ("gif", 0, "474946383761"),
    ("gif", 0, "474946383961"),
    ("tiff", 0, "4D4D002A"),
    ("tiff", 0, "49492A00"),
    ("avif", 4, "6674797061766966"),
    ("hdr", 0, "233F52414449414E4345"),
    ("openexr", 0, "762F3101"),
    ("qoi", 0, "716F6966"),
    ("ico", 0, "00000100"),
    ("bmp", 0, "424D"),
    ("pnm", 0, "5031"),
    ("pnm", 0, "5032"),
    ("pnm", 0, "5033"),
    ("pnm", 0, "5034"),
    ("pnm", 0, "5035"),
    ("pnm", 0, "5036"),
    ("pnm", 0, "5037"),
]
# RIFF container, form type at offset 8; recognised but unsupported containers.
RIFF, WEBP_FORM = "52494646", "57454250"
UNSUPPORTED_MAGIC = ["44445320", "66617262666C6420"]


def _has(content: Column, offset: int, hex_bytes: str) -> Column:
    raw = bytes.fromhex(hex_bytes)
    return F.substring(content, offset + 1, len(raw)) == F.lit(raw)


def sniff_content(content) -> Column:
    """Format by magic bytes alone; ``unsupported`` for known foreign containers, null if nothing matches."""
    c = as_col(content)
    found = F.when(_has(c, 0, RIFF) & _has(c, 8, WEBP_FORM), "webp")
    for name, offset, magic in MAGIC:
        found = found.when(_has(c, offset, magic), name)
    for magic in UNSUPPORTED_MAGIC:
        found = found.when(_has(c, 0, magic), "unsupported")
    return found


def uint_be(content, position: int, length: int) -> Column:
    """Big-endian unsigned integer at a 1-based byte position, as bigint."""
    return F.conv(F.hex(F.substring(as_col(content), position, length)), 16, 10).try_cast("bigint")


def uint_le(content, position: int, length: int) -> Column:
    c = as_col(content)
    parts = [F.hex(F.substring(c, p, 1)) for p in range(position + length - 1, position - 1, -1)]
    return F.conv(F.concat(*parts), 16, 10).try_cast("bigint")


def _int32(value: Column) -> Column:
    return F.when(value >= 2**31, value - 2**32).otherwise(value)


def read_dims(content) -> Column:
    """Sides from the header of PNG, GIF, BMP and QOI content; null for other or truncated content."""
    c = as_col(content)
    n = F.length(c)

    def dims(width: Column, height: Column) -> Column:
        return F.struct(width.alias("width"), height.alias("height"))

    magic = {name: [_has(c, offset, m) for kind, offset, m in MAGIC if kind == name] for name in ("png", "gif", "bmp", "qoi")}
    core_bmp = magic["bmp"][0] & (n >= 26) & (uint_le(c, 15, 4) == 12)
    return (
        F.when(magic["png"][0] & (n >= 24), dims(uint_be(c, 17, 4), uint_be(c, 21, 4)))
        .when((magic["gif"][0] | magic["gif"][1]) & (n >= 10), dims(uint_le(c, 7, 2), uint_le(c, 9, 2)))
        .when(core_bmp, dims(uint_le(c, 19, 2), uint_le(c, 21, 2)))
        .when(magic["bmp"][0] & (n >= 26), dims(F.abs(_int32(uint_le(c, 19, 4))), F.abs(_int32(uint_le(c, 23, 4)))))
        .when(magic["qoi"][0] & (n >= 14), dims(uint_be(c, 5, 4), uint_be(c, 9, 4)))
    )


def sha256_hex(content) -> Column:
    return F.sha2(as_col(content), 256)
