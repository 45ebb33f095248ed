"""Language of texts: multinomial naive Bayes over hashed character n-grams.

Letters are lower-cased, everything else is a blank; the 1-, 2- and 3-grams of a text's words, the blanks before
and after a word included, fall into buckets. Training sums bucket counts of every labelled row inside Spark; the
resulting matrix of log probabilities (buckets x languages, at most ``CELLS``) is broadcast, and each task
scores batches as sparse rows: the distinct buckets of each text with their counts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .tokens import chunks, mix
from .toxicity import held_out

#: Buckets of n-grams; bound of the broadcast matrix in cells of four bytes (16 MB). More than CELLS / BUCKETS
#: languages share fewer buckets, halved until the matrix fits; more than CELLS / LEAST_BUCKETS are refused.
BUCKETS, CELLS, LEAST_BUCKETS = 1 << 15, 1 << 22, 1 << 8
ORDERS = (1, 2, 3)
#: Added to every count.
ALPHA = 0.1
UNKNOWN = "und"

_tables: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """The lower-case form of every code point that is a letter; zero for all others."""
    if not _tables:
        low = np.zeros(0x110000, np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                small = c.lower()
                low[i] = ord(small) if len(small) == 1 else i
        _tables.append(low)
    return _tables[0]


def features(texts, buckets: int = BUCKETS):
    """Per chunk of an Arrow string column: first row, number of rows, and row, bucket and count of its n-grams.

    Rows without a letter have no entry. Entries come by row.
    """
    for first, chunk in chunks(texts):
        point = np.frombuffer(chunk.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        begins = np.concatenate([[0], np.cumsum((chunk.data & 0xC0) != 0x80)])[chunk.at]
        owner = np.repeat(np.arange(chunk.n), np.diff(begins))
        # One blank before each text and one at the end keep the n-grams of neighbours apart.
        sign = np.zeros(len(point) + chunk.n + 1, np.uint32)
        sign[np.arange(len(point)) + owner + 1] = _letters()[point]
        text = np.concatenate([np.repeat(np.arange(chunk.n), np.diff(begins) + 1), [max(chunk.n - 1, 0)]])
        keys = []
        for n in ORDERS:
            size = len(sign) - n + 1
            if size <= 0:
                continue
            parts = [sign[k : size + k] for k in range(n)]
            # A blank only at the ends of an n-gram, and never nothing but blanks.
            at = np.flatnonzero(parts[n // 2] > 0 if n != 2 else (parts[0] > 0) | (parts[1] > 0))
            h = np.full(len(at), np.uint64(n))
            with np.errstate(over="ignore"):
                for p in parts:
                    h = h * np.uint64(0x100000001B3) + p[at]
            of = text[at + n // 2] if n != 2 else text[at + (parts[0][at] == 0)]
            keys.append(of * buckets + (mix(h) & np.uint64(buckets - 1)).astype(np.int64))
        key = np.sort(np.concatenate(keys)) if keys else np.empty(0, np.int64)
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
        yield first, chunk.n, key[edge] // buckets, key[edge] % buckets, np.diff(np.append(edge, len(key)))


@dataclass
class Model:
    """``logs``: log probability of each bucket by language (languages x buckets); ``prior``: that of the language."""

    languages: list[str]
    logs: np.ndarray
    prior: np.ndarray

    def column(self, texts) -> tuple[list[str], np.ndarray]:
        """The likeliest language of each text and its posterior; ``und`` and 0 where there is no letter or no model."""
        names, scores = [], []
        for _, n, row, bucket, count in features(texts, self.logs.shape[1]):
            out, score = np.full(n, -1), np.zeros(n)
            if len(row) and self.languages:
                start = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                logs = np.stack([np.add.reduceat(line[bucket].astype(np.float64) * count, start) + p for line, p in zip(self.logs, self.prior)])
                best = logs.argmax(axis=0)
                out[row[start]] = best
                score[row[start]] = 1 / np.exp(logs - logs[best, np.arange(len(best))]).sum(axis=0)
            names += [self.languages[k] if k >= 0 else UNKNOWN for k in out]
            scores.append(score)
        return names, np.concatenate(scores) if scores else np.empty(0)


def _buckets_for(languages: int, cells: int) -> int:
    buckets = BUCKETS
    while buckets * languages > cells:
        buckets //= 2
    if buckets < LEAST_BUCKETS:
        raise ValueError(f"{languages} languages do not fit a matrix of {cells} cells")
    return buckets


def bucket_counts(rows: DataFrame) -> DataFrame:
    """``lang, bucket, n`` over all rows of ``lang, text``; each task sends sums."""

    def run(batches):
        sums: dict[str, np.ndarray] = {}

        def flush():
            for lang, total in sums.items():
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(total[at])], names=["lang", "bucket", "n"])
            sums.clear()

        for b in batches:
            codes = b.column(0).dictionary_encode()
            names, code = codes.dictionary.to_pylist(), codes.indices.to_numpy(zero_copy_only=False)
            for first, n, row, bucket, count in features(b.column(1)):
                mine = code[first : first + n][row]
                for k in np.unique(mine):
                    of = mine == k
                    total = np.bincount(bucket[of], weights=count[of], minlength=BUCKETS).astype(np.int64)
                    sums[names[k]] = sums[names[k]] + total if names[k] in sums else total
                if len(sums) > 200:
                    yield from flush()
        yield from flush()

    return rows.select("lang", "text").mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, cells: int = CELLS) -> Model:
    """Counts over all rows with a text and a ``lang`` outside the held-out quarter; an empty model if there are none."""
    rows = docs.where("text is not null and lang is not null").where(~held_out(F.col("doc_id"))).select(F.col("lang").cast("string").alias("lang"), "text")
    priors = rows.groupBy("lang").count()
    found = priors.limit(cells // LEAST_BUCKETS + 1).collect()
    buckets = _buckets_for(max(len(found), 1), cells)
    languages = sorted(r["lang"] for r in found)
    counts = bucket_counts(rows).groupBy("lang", F.col("bucket").bitwiseAND(buckets - 1).alias("bucket")).agg(F.sum("n").alias("n")).toArrow()
    total, where = np.full((len(languages), buckets), ALPHA), {lang: k for k, lang in enumerate(languages)}
    coded = counts.column("lang").combine_chunks().dictionary_encode() if counts.num_rows else None
    if coded is not None:
        line = np.array([where[x] for x in coded.dictionary.to_pylist()])[coded.indices.to_numpy(zero_copy_only=False)]
        total[line, counts.column("bucket").to_numpy()] += counts.column("n").to_numpy()
    logs = np.log(total / total.sum(axis=1, keepdims=True)).astype(np.float32)
    size = {r["lang"]: r["count"] for r in found}
    prior = np.log(np.array([size[x] for x in languages], np.float64) / max(sum(size.values()), 1))
    return Model(languages, logs, prior)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row.

    Null texts and texts without a letter are ``und`` with score 0, as is everything under a model without
    languages. Every text is read whole. Equal posteriors go to the language first in order; repeated rows get
    equal results; other columns of ``docs`` are ignored.
    """
    kind = next(f.dataType for f in docs.schema if f.name == "doc_id")
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            names, scores = shared.value.column(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, schema)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def fit_and_predict(docs: DataFrame) -> DataFrame:
    """Trains on the rows outside the held-out quarter and predicts every row (see ``predict``)."""
    return predict(docs, fit(docs))
