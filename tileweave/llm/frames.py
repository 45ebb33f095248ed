"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: White space of the contracts: space, tab and the control characters 0x0A to 0x0D.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Column names like the wanted ones that ``df`` does not have (names compare without case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def words_of(text):
    """Array of the words of a column; empty for null and for text without words."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def lower_ascii(text):
    """A-Z to a-z, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lowest(rows: DataFrame, key, n: int) -> DataFrame:
    """About the ``n`` rows with the smallest ``key`` (ties at the edge all stay). Only keys are compared across tasks."""
    (name,) = fresh(rows, "sample_key")
    keyed = rows.withColumn(name, key)
    edge = keyed.select(name).orderBy(name).limit(n).agg(F.max(name)).first()[0]
    return keyed.where(F.lit(False) if edge is None else F.col(name) <= edge).drop(name)
