"""Small exact arithmetic helpers."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, functions as F


def as_col(value) -> Column:
    """Column names and columns pass through; numbers become literals."""
    if isinstance(value, Column):
        return value
    if isinstance(value, str):
        return F.col(value)
    return F.lit(value)


def clamp(value, low, high) -> Column:
    return F.least(F.greatest(as_col(value), F.lit(low)), F.lit(high))


def round_half_up(value) -> Column:
    """Exact half-up rounding of a non-negative double, as bigint.

    ``round`` on doubles goes through BigDecimal; this stays primitive, and unlike
    ``floor(v + 0.5)`` it cannot be fooled by the addition itself rounding up.
    """
    v = as_col(value).cast("double")
    whole = F.floor(v)
    return whole + F.when(v - whole >= 0.5, F.lit(1)).otherwise(F.lit(0))


def int_div(a, b) -> Column:
    """Integral division (floor for non-negative operands); null when ``b`` is 0."""
    return F.call_function("div", as_col(a).cast("bigint"), F.nullif(as_col(b).cast("bigint"), F.lit(0)))


def ceil_div(a, b) -> Column:
    """ceil(a / b) for any integer ``a`` and positive ``b``, in exact integer arithmetic."""
    a, b = as_col(a).cast("bigint"), as_col(b).cast("bigint")
    q = F.call_function("div", a, b)
    return q + F.when((a > 0) & (a % b != 0), 1).otherwise(0)


def gcd(a, b, finish: Callable[[Column], Column] = lambda d: d) -> Column:
    """Greatest common divisor, optionally passed on to ``finish``, which sees it computed once.

    Euclid as a fold. Two sides below φ^n need at most n steps, so the fold is as long as the
    smaller side asks for and a few microseconds suffice.
    """
    a, b = as_col(a).cast("bigint"), as_col(b).cast("bigint")
    golden = (1 + math.sqrt(5)) / 2
    smaller = F.greatest(F.least(a, b), F.lit(1)).cast("double")
    steps = F.sequence(F.lit(1), F.ceil(F.log(smaller) / F.lit(math.log(golden))).cast("int") + 2)

    def step(acc, _):
        return F.when(acc["b"] == 0, acc).otherwise(F.struct(acc["b"].alias("a"), (acc["a"] % acc["b"]).alias("b")))

    return F.aggregate(steps, F.struct(a.alias("a"), b.alias("b")), step, lambda acc: finish(acc["a"]))
