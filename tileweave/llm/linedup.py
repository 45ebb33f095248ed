"""Removal of repeated passages: overlapping windows of consecutive lines, hashed and compared over the whole corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .frames import fresh

SPAN = 3


def later_windows(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """``doc_id, text_hash, later``: line numbers at which windows start that occur earlier in the corpus."""
    lines = docs.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("text_hash"), F.split("text", "\n").alias("lines"))
    starts = lines.where(F.size("lines") >= span).select("*", F.explode(F.sequence(F.lit(0), F.size("lines") - span)).alias("pos"))
    parts = [F.get("lines", F.col("pos") + k) for k in range(span)]
    found = starts.where(F.trim(F.concat(*parts)) != "").select(
        "doc_id", "text_hash", "pos", F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit(span), *reversed(parts)).alias("h2")
    )
    at = F.struct("doc_id", "text_hash", "pos")
    firsts = found.groupBy("h1", "h2").agg(F.min(at).alias("first"), F.max(at).alias("last")).where("first <> last").drop("last")
    later = found.join(firsts, ["h1", "h2"]).where(at != F.col("first"))
    return later.groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("later"))


def _marked(docs: DataFrame, span: int):
    """The documents with two more columns: their lines, and the numbers of the lines that stay (null: all)."""
    key, sign, later, lines, kept = fresh(docs, "doc_key", "text_sign", "later", "lines", "kept_lines")
    removals = later_windows(docs.select("doc_id", "text"), span).toDF(key, sign, later)
    same = (F.col("doc_id") == F.col(key)) & (F.xxhash64("text") == F.col(sign)) & F.col("text").isNotNull()
    covered = F.flatten(F.transform(F.col(later), lambda s: F.sequence(s, s + (span - 1))))
    marked = docs.join(removals.hint("shuffle_hash"), same, "left").withColumn(lines, F.split("text", "\n"))
    marked = marked.withColumn(kept, F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), covered))
    rest = F.array_join(F.transform(F.col(kept), lambda i: F.get(F.col(lines), i)), "\n")
    return marked.withColumn("text", F.when(F.col(kept).isNotNull(), rest).otherwise(F.col("text"))), lines, kept


def line_dedup(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """The documents without the lines that later occurrences of a repeated window cover; all columns as they were.

    An occurrence is earlier with the smaller ``doc_id``, then the smaller line number. Documents stay even
    when all their lines go (text ``""``). Null texts, texts of fewer than ``span`` lines and rows without
    ``doc_id`` stay as they are; windows of blank lines never count. A row repeated in full is one document:
    its copies lose the same lines. Different texts under one ``doc_id`` are different documents.
    """
    return _marked(docs, span)[0].select(*docs.columns)


def line_dedup_report(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """``doc_id, text, n_lines, n_removed`` of every document after the removal (a null text has no lines)."""
    marked, lines, kept = _marked(docs.select("doc_id", "text"), span)
    n = F.when(F.col(lines).isNull(), 0).otherwise(F.size(lines))
    return marked.select("doc_id", "text", n.alias("n_lines"), (n - F.coalesce(F.when(F.col(kept).isNotNull(), F.size(kept)), n)).alias("n_removed"))
