"""Human-readable text and the two geometry parsers.

Decimal places round to the nearest value with ties to even on the exact binary
value, which is what ``format_number`` with a pattern does.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .numeric import as_col, round_half_up

# Binary size units; wording of unchanged sizes and of longer lists.
KB, MB, GB = 1024, 1024**2, 1024**3
SAME_SIZE = "≈ mesmo tamanho"
OTHERS = "outros"


def fixed(value, places: int) -> Column:
    """``value`` with exactly ``places`` decimals and no thousands separator."""
    pattern = "0" if places == 0 else "0." + "0" * places
    return F.call_function("format_number", as_col(value).cast("double"), F.lit(pattern))


def format_size(size) -> Column:
    """``12 B`` / ``456 KB`` / ``1.2 MB`` / ``3.4 GB``."""
    n = as_col(size).cast("bigint")
    return (
        F.when(n >= GB, F.concat(fixed(n / F.lit(float(GB)), 1), F.lit(" GB")))
        .when(n >= MB, F.concat(fixed(n / F.lit(float(MB)), 1), F.lit(" MB")))
        .when(n >= KB, F.concat(fixed(n / F.lit(float(KB)), 0), F.lit(" KB")))
        .otherwise(F.concat(n.cast("string"), F.lit(" B")))
    )


def format_bytes(size) -> Column:
    """``512 B`` or ``1.5 KB (1536 bytes)``; GB is the largest unit."""
    n = as_col(size).cast("bigint")
    exact = F.concat(F.lit(" ("), n.cast("string"), F.lit(" bytes)"))
    return (
        F.when(n >= GB, F.concat(fixed(n / F.lit(float(GB)), 1), F.lit(" GB"), exact))
        .when(n >= MB, F.concat(fixed(n / F.lit(float(MB)), 1), F.lit(" MB"), exact))
        .when(n >= KB, F.concat(fixed(n / F.lit(float(KB)), 1), F.lit(" KB"), exact))
        .otherwise(F.concat(n.cast("string"), F.lit(" B")))
    )


def format_duration(seconds) -> Column:
    """``0.4 s`` / ``12 s`` / ``1 min 23 s`` / ``2h 5min``; the remainder is rounded, not carried."""
    s = as_col(seconds).cast("double")
    minutes, hours = F.floor(s / 60.0), F.floor(s / 3600.0)
    return (
        F.when(s < 10.0, F.concat(fixed(s, 1), F.lit(" s")))
        .when(s < 60.0, F.concat(fixed(s, 0), F.lit(" s")))
        .when(
            s < 3600.0,
            F.concat(minutes.cast("string"), F.lit(" min "), round_half_up(s - minutes * 60.0).cast("string"), F.lit(" s")),
        )
        .otherwise(
            F.concat(hours.cast("string"), F.lit("h "), round_half_up((s - hours * 3600.0) / 60.0).cast("string"), F.lit("min"))
        )
    )


def size_delta(bytes_in, bytes_out, same: str = SAME_SIZE) -> Column:
    """Relative change in size: empty without both sides, ``same`` under half a percent."""
    a, b = as_col(bytes_in).cast("double"), as_col(bytes_out).cast("double")
    pct = (b / F.nullif(a, F.lit(0.0)) - 1.0) * 100.0
    return (
        F.when((a == 0) | (b == 0), F.lit(""))
        .when(F.abs(pct) < 0.5, F.lit(same))
        .when(pct < 0, F.concat(F.lit("−"), fixed(F.abs(pct), 0), F.lit("%")))
        .otherwise(F.concat(F.lit("+"), fixed(pct, 0), F.lit("%")))
    )


def files_label(first_name, count, others: str = OTHERS) -> Column:
    """``—`` for an empty list, the name for one file, ``name +k outros`` for more."""
    n = as_col(count)
    return (
        F.when(F.coalesce(n, F.lit(0)) == 0, F.lit("—"))
        .when(n == 1, as_col(first_name))
        .otherwise(F.concat(as_col(first_name), F.lit(" +"), (n - 1).cast("string"), F.lit(f" {others}")))
    )


def mtime_text(timestamp) -> Column:
    """Minute precision, in the session time zone."""
    return F.date_format(as_col(timestamp), "yyyy-MM-dd HH:mm")


# An unsigned number may carry one leading plus sign; 32 bits at most.
_NUMBER = r"(\+?\d+)"
_U32_MAX = 4294967295


def _u32(text: Column) -> Column:
    value = F.regexp_replace(text, r"^\+?0*(?=\d)", "").try_cast("decimal(38,0)")
    return F.when(value <= F.lit(_U32_MAX), value.cast("bigint"))


def parse_geometry(text) -> Column:
    """``WxH`` (or ``WXH``) to ``struct<width,height>``; null when malformed or over 32 bits."""
    pattern = rf"^{_NUMBER}[xX]{_NUMBER}$"
    s = as_col(text)
    w, h = (_u32(F.regexp_extract(s, pattern, i)) for i in (1, 2))
    return F.when(w.isNotNull() & h.isNotNull(), F.struct(w.alias("width"), h.alias("height")))


def parse_crop(text) -> Column:
    """``WxH+X+Y`` to ``struct<x,y,width,height>``; null when malformed or over 32 bits.

    The first two plus signs separate the parts, so only the last number may carry its own sign.
    """
    pattern = rf"^(\d+)[xX](\d+)\+(\d+)\+{_NUMBER}$"
    s = as_col(text)
    w, h, x, y = (_u32(F.regexp_extract(s, pattern, i)) for i in (1, 2, 3, 4))
    ok = w.isNotNull() & h.isNotNull() & x.isNotNull() & y.isNotNull()
    return F.when(ok, F.struct(x.alias("x"), y.alias("y"), w.alias("width"), h.alias("height")))
