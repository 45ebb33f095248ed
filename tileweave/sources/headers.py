"""Image sizes from file headers, for the formats whose headers need a walk through markers, boxes or tags."""

from __future__ import annotations

import re
import struct

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.binary import MAGIC, RIFF, UNSUPPORTED_MAGIC, WEBP_FORM, read_dims, uint_be, uint_le
from ..functions.paths import DOT_EXTENSION, NAME
from .formats import ALIASES
from .ranges import Content, FileRanges, as_content, boxes, meta_box

#: Bytes of a file that are looked at first. Only a header that goes on behind them gets more of its file.
HEAD_BYTES = 512 * 1024
#: Most entries of a TIFF directory, by the width of its count.
_TIFF_ENTRIES = 0xFFFF


def _png(d: Content):
    return struct.unpack(">II", d.get(16, 8))


def _gif(d: Content):
    return struct.unpack("<HH", d.get(6, 4))


def _bmp(d: Content):
    if d.number(14, 4, "little") == 12:
        return struct.unpack("<HH", d.get(18, 4))
    return tuple(map(abs, struct.unpack("<ii", d.get(18, 8))))


def _qoi(d: Content):
    d.get(0, 14)
    return struct.unpack(">II", d.get(4, 8))


def _jpeg(d: Content):
    at = 2
    while True:
        lead, marker = d.get(at, 2)
        if lead != 0xFF:
            return None
        if marker == 0xFF:
            at += 1
        elif marker == 0x01 or 0xD0 <= marker <= 0xD8:
            at += 2
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", d.get(at + 5, 4))
            return width, height
        elif marker in (0xD9, 0xDA):
            return None
        else:
            at += 2 + d.number(at + 2, 2)


def _webp(d: Content):
    kind = d.get(12, 4)
    if kind == b"VP8 " and d.get(23, 3) == b"\x9d\x01\x2a":
        return tuple(v & 0x3FFF for v in struct.unpack("<HH", d.get(26, 4)))
    if kind == b"VP8L" and d.get(20, 1) == b"\x2f":
        bits = d.number(21, 4, "little")
        return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
    if kind == b"VP8X":
        return d.number(24, 3, "little") + 1, d.number(27, 3, "little") + 1
    return None


def _tiff(d: Content):
    order, word = ("<", "little") if d.get(0, 2) == b"II" else (">", "big")
    at, found = d.number(4, 4, word), {}
    entries = d.get(at + 2, 12 * d.number(at, 2, word))
    for slot in range(0, len(entries), 12):
        tag, kind = struct.unpack_from(order + "HH", entries, slot)
        if tag in (256, 257) and kind in (3, 4):
            found[tag] = struct.unpack_from(order + ("H" if kind == 3 else "I"), entries, slot + 8)[0]
    return (found[256], found[257]) if len(found) == 2 else None


def _properties(d: Content, at: int, end: int):
    """Sizes by property number, the primary item, and the properties of each item."""
    sizes, primary, owned = {}, None, {}
    for kind, body, stop in boxes(d, at, end):
        if kind == b"pitm":
            primary = d.number(body + 4, 2 if d.number(body, 1) == 0 else 4)
        if kind != b"iprp":
            continue
        for inner, begin, close in boxes(d, body, stop):
            if inner == b"ipco":
                for k, (name, where, _) in enumerate(boxes(d, begin, close), 1):
                    if name == b"ispe":
                        sizes[k] = struct.unpack(">II", d.get(where + 4, 8))
            elif inner == b"ipma":
                version, flags, spot = d.number(begin, 1), d.number(begin + 1, 3), begin + 8
                wide = 2 if flags & 1 else 1
                for _ in range(d.number(begin + 4, 4)):
                    item = d.number(spot, 2 if version < 1 else 4)
                    spot += 2 if version < 1 else 4
                    count = d.number(spot, 1)
                    links = d.get(spot + 1, count * wide)
                    mask = 0x7FFF if wide == 2 else 0x7F
                    owned.setdefault(item, []).extend(int.from_bytes(links[i : i + wide], "big") & mask for i in range(0, len(links), wide))
                    spot += 1 + count * wide
    return sizes, primary, owned


def _avif(d: Content):
    """The size of the primary item; the largest size there is where none is said to be its own."""
    meta = meta_box(d)
    if meta is None:
        head = d.some(0, HEAD_BYTES)
        found = [struct.unpack_from(">II", head, m.end() + 4) for m in re.finditer(b"ispe", head) if m.end() + 12 <= len(head)]
        return max(found, key=lambda s: s[0] * s[1], default=None)
    sizes, primary, owned = _properties(d, *meta)
    mine = [sizes[k] for k in owned.get(primary, []) if k in sizes]
    return mine[-1] if mine else max(sizes.values(), key=lambda s: s[0] * s[1], default=None)


def _ico(d: Content):
    entries = d.some(6, 16 * d.number(4, 2, "little"))
    found = [(entries[i] or 256, entries[i + 1] or 256) for i in range(0, len(entries) - 1, 16)]
    return max(found, key=lambda s: s[0] * s[1], default=None)


def _pnm(d: Content):
    gap = rb"(?:\s|#[^\n]*\n)+"
    for head, whole in d.windows():
        # A number at the end of a part of the file may go on behind it.
        after = rb"\b" if whole else rb"(?=\s)"
        if head[:2] == b"P7":
            m = re.search(rb"\bWIDTH\s+(\d+)" + after, head), re.search(rb"\bHEIGHT\s+(\d+)" + after, head)
            if all(m):
                return tuple(int(x[1]) for x in m)
            if re.search(rb"\bENDHDR\s", head):
                return None
        else:
            m = re.match(rb"P[1-6]" + gap + rb"(\d+)" + gap + rb"(\d+)" + after, head)
            if m:
                return int(m[1]), int(m[2])
    return None


def _hdr(d: Content):
    for head, _ in d.windows():
        m = re.search(rb"\n([+-][XY]) (\d+) ([+-][XY]) (\d+)\n", head)
        if m:
            first, second = int(m[2]), int(m[4])
            return None if m[1][1:] == m[3][1:] else (second, first) if m[1][1:] == b"Y" else (first, second)
    return None


def _exr(d: Content):
    at = 8
    while True:
        named = re.match(rb"([^\0]+)\0([^\0]+)\0", d.some(at, 520))
        if not named:
            return None
        at += named.end()
        size = d.number(at, 4, "little")
        if named[1] == b"dataWindow" and named[2] == b"box2i":
            x0, y0, x1, y1 = struct.unpack("<iiii", d.get(at + 4, 16))
            return x1 - x0 + 1, y1 - y0 + 1
        at += 4 + size


def _tga(d: Content):
    return struct.unpack("<HH", d.get(12, 4))


_READERS = {"jpeg": _jpeg, "webp": _webp, "tiff": _tiff, "avif": _avif, "ico": _ico, "pnm": _pnm, "hdr": _hdr, "openexr": _exr, "tga": _tga}
#: Formats whose sizes column expressions read where the content is a column.
_FIXED = {"png": _png, "gif": _gif, "bmp": _bmp, "qoi": _qoi}


def dims_of(head, format_: str | None) -> tuple[int, int] | None:
    """Width and height by the reader of the format; None for other formats and for broken or short headers."""
    reader = _READERS.get(format_) or _FIXED.get(format_)
    try:
        found = reader(as_content(head)) if reader else None
    except (struct.error, IndexError, EOFError):
        return None
    return found if found and min(found) > 0 else None


def format_of(head: bytes, path: str) -> str | None:
    """``formats.sniff_format`` for one file: by magic bytes, else by extension; None for foreign containers."""
    has = lambda at, magic: head[at : at + len(magic) // 2] == bytes.fromhex(magic)
    if has(0, RIFF) and has(8, WEBP_FORM):
        return "webp"
    for name, at, magic in MAGIC:
        if has(at, magic):
            return name
    if any(has(0, magic) for magic in UNSUPPORTED_MAGIC):
        return None
    named = re.match(NAME, path)
    ext = re.search(DOT_EXTENSION, named[1]) if named else None
    return next((name for name, spellings in ALIASES.items() if ext and ext[1].strip(" ").lower() in spellings), None)


HEADER_SCHEMA = "source_format string, width bigint, height bigint, n_read bigint, error string"


def header_of(path: str) -> tuple:
    """Format, sides and bytes read of a file, with an error where it cannot be read at all."""
    try:
        with FileRanges(path) as d:
            kind = format_of(d.some(0, 64), path)
            sides = dims_of(d, kind) or (None, None)
            return kind, *sides, d.n_read, None
    except OSError as error:
        return None, None, None, 0, f"io: {error}"


def with_headers(files: DataFrame, path: str = "path") -> DataFrame:
    """Adds ``source_format, width, height, n_read`` and ``read_error`` to a table of paths; no content is scanned.

    Tasks read the first ``FIRST_READ`` bytes of a file and then the ranges that its header points to, wherever
    those are. Sides are null where the header is broken; a null path gives nulls.
    """

    @F.pandas_udf(HEADER_SCHEMA.replace(" ", ":").replace(",:", ","))
    def read(paths: pd.Series) -> pd.DataFrame:
        rows = [header_of(p) if p is not None else (None,) * 5 for p in paths]
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in HEADER_SCHEMA.split(", ")], dtype=object)
        return out.astype({c: "Int64" for c in ("width", "height", "n_read")})

    found = files.withColumn("_header", read(path))
    return found.select(*files.columns, *[F.col(f"_header.{c}").alias(c) for c in ("source_format", "width", "height", "n_read")], F.col("_header.error").alias("read_error"))


def _tiff_head(content):
    """Header and first directory of a TIFF as a file of their own; the directory may lie anywhere in the content."""
    little = F.substring(content, 1, 2) == F.lit(b"II")
    start = F.when(little, uint_le(content, 5, 4)).otherwise(uint_be(content, 5, 4)) + 1
    inside = start <= F.length(content)
    start = F.when(inside, start).cast("int")
    size = 2 + 12 * _TIFF_ENTRIES
    count = F.substring(content, start, F.lit(2))
    entries = F.when(little, uint_le(count, 1, 2)).otherwise(uint_be(count, 1, 2))
    directory = F.substring(content, start, F.least(2 + 12 * entries, F.lit(size)).cast("int"))
    offset = F.when(little, F.lit(b"\x08\0\0\0")).otherwise(F.lit(b"\0\0\0\x08"))
    return F.concat(F.substring(content, 1, 4), offset, directory)


def with_dims(files: DataFrame, format_: str = "source_format", content: str = "content") -> DataFrame:
    """Adds ``width`` and ``height``: by column expressions for fixed headers, by a reader for the others, null if unreadable.

    Of a TIFF the header and the first directory go to Python, of other such files the first ``HEAD_BYTES``. A
    longer file whose size is not among them goes there whole.
    """

    @F.pandas_udf("struct<width:bigint,height:bigint>")
    def read(heads: pd.Series, formats: pd.Series) -> pd.DataFrame:
        rows = [dims_of(bytes(h), f) if h is not None else None for h, f in zip(heads, formats)]
        return pd.DataFrame({"width": pd.array([r and r[0] for r in rows], "Int64"), "height": pd.array([r and r[1] for r in rows], "Int64")})

    c, kind = F.col(content), F.col(format_)
    head = F.when(kind == "tiff", _tiff_head(c)).when(kind.isin(*_READERS), F.substring(c, 1, HEAD_BYTES))
    more = F.when(kind.isin(*(set(_READERS) - {"tiff"})) & F.col("_walked.width").isNull() & (F.length(c) > HEAD_BYTES), c)
    sized = files.withColumn("_fixed", read_dims(content)).withColumn("_walked", read(head, kind)).withColumn("_whole", read(more, kind))
    return sized.withColumns({side: F.coalesce(f"_fixed.{side}", f"_walked.{side}", f"_whole.{side}") for side in ("width", "height")}).drop("_fixed", "_walked", "_whole")
