"""Toxicity scores from subword-bag embeddings under a linear softmax.

A word is the bag of its byte n-grams (hashed to buckets) and of itself; a bag's embedding is the average of
its members', a window's the average of its words', and a two-class linear softmax reads the window.
Embeddings and softmax are trained jointly by gradient steps in numpy. A few toxic words would vanish in
the average of a long text, so a text is scored by its most toxic window; training starts from averages of
whole texts and goes on through each text's most toxic window. Misspellings share most n-grams with the
words they distort.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .frames import lowest
from .tokens import Texts, chunks, lower, mix

#: Bounds of the training sample: rows of each class, and characters of a row (longer rows are scored, not trained on).
TRAIN_POSITIVE, TRAIN_NEGATIVE, TRAIN_CHARS = 1000, 2000, 12_000
THRESHOLD = 0.3


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 16
    dim: int = 8
    grams: tuple[int, ...] = (3, 4, 5)
    window: int = 2
    mean_steps: int = 25
    window_steps: int = 75
    rate: float = 0.6
    decay: float = 1e-3
    seed: int = 7


class Words:
    """The words of texts, lower-cased and without ASCII punctuation at their ends, and their bags.

    ``start``, ``end`` and ``text`` of each word refer to ``data``, in which every text stands between blanks.
    """

    def __init__(self, texts: Texts):
        n, shift = texts.n, np.arange(texts.n) + 1
        data = np.full(len(texts.data) + n + 8, 0x20, np.uint8)
        owner = np.repeat(np.arange(n), np.diff(texts.at))
        data[np.arange(len(texts.data)) + owner + 1] = np.where(texts.white, 0x20, lower(texts.data))
        self.data = data
        start, end, self.text = texts.words()
        start, end = start + shift[self.text], end + shift[self.text]
        letter = np.flatnonzero((data >= 0x80) | ((data >= 0x30) & (data <= 0x39)) | ((data >= 0x61) & (data <= 0x7A)))
        first, last = np.searchsorted(letter, start), np.searchsorted(letter, end) - 1
        keep = first <= last
        self.start, self.end, self.text = letter[first[keep]], letter[last[keep]] + 1, self.text[keep]
        self.plain = Texts(data, np.array([0, len(data)]))

    def grams(self, n: int, buckets: int):
        """The bucket of the n-gram at each byte; and for each word the first and past-the-last of its n-grams.

        A word's n-grams take in the byte before and after it, a blank or punctuation mark as its boundary.
        """
        h = np.zeros(max(len(self.data) - n + 1, 0), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(n):
                h = h * np.uint64(0x100000001B3) + self._framed()[k : len(self.data) - n + 1 + k]
            bucket = (mix(h + np.uint64(n)) % np.uint64(buckets)).astype(np.int64)
        low = np.minimum(self.start - 1, len(bucket))
        return bucket, low, np.maximum(self.end + 2 - n, low)

    def _framed(self) -> np.ndarray:
        edge = np.ones(len(self.data), bool)
        edge[self.start - 1] = False
        edge[self.end] = False
        return np.where(edge, self.data, 0x20).astype(np.uint64)

    def whole(self, buckets: int) -> np.ndarray:
        return (self.plain.hashes(self.start, self.end) % np.uint64(buckets)).astype(np.int64)


def _best(values: np.ndarray, text: np.ndarray, n_texts: int, size: int):
    """Largest window mean of each text and the first word of that window (-1 without words).

    ``values`` per word; a text shorter than the window is one window, padded with nothing.
    """
    count = np.bincount(text, minlength=n_texts)
    first = np.concatenate([[0], np.cumsum(count)])
    sums = np.concatenate([[0.0], np.cumsum(values)])
    n_windows = np.where(count > 0, np.maximum(count - size + 1, 1), 0)
    owner = np.repeat(np.arange(n_texts), n_windows)
    start = np.arange(len(owner)) - np.repeat(np.concatenate([[0], np.cumsum(n_windows)[:-1]]), n_windows) + first[owner]
    means = (sums[np.minimum(start + size, first[owner + 1])] - sums[start]) / size
    top, at = np.zeros(n_texts), np.full(n_texts, -1)
    full = np.flatnonzero(n_windows)
    if len(full):
        top[full] = np.maximum.reduceat(means, np.concatenate([[0], np.cumsum(n_windows[full])[:-1]]))
        hit = np.flatnonzero(means >= top[owner])
        at[owner[hit][::-1]] = start[hit][::-1]
    return top, at


class Model:
    """``table`` (buckets x dim) and the softmax's ``weight`` (2 x dim) and ``bias`` (2)."""

    def __init__(self, settings: Settings):
        rng = np.random.default_rng(settings.seed)
        self.settings = settings
        self.table = np.zeros((settings.buckets, settings.dim))
        self.weight = rng.normal(0, 1 / np.sqrt(settings.dim), (2, settings.dim))
        self.bias = np.zeros(2)

    def scorer(self) -> "Scorer":
        """What scoring needs: the softmax is linear, so each bucket boils down to one number."""
        return Scorer(self.settings, (self.table @ (self.weight[1] - self.weight[0])).astype(np.float32), float(self.bias[1] - self.bias[0]))


@dataclass
class Scorer:
    settings: Settings
    value: np.ndarray
    bias: float

    def words(self, words: Words) -> np.ndarray:
        """Log-odds that each word adds to its window: the mean over its bag."""
        total = self.value[words.whole(self.settings.buckets)].astype(np.float64)
        size = np.ones(len(total))
        for n in self.settings.grams:
            bucket, low, high = words.grams(n, self.settings.buckets)
            sums = np.concatenate([[0.0], np.cumsum(self.value[bucket], dtype=np.float64)])
            total += sums[high] - sums[low]
            size += high - low
        return total / size

    def column(self, texts) -> np.ndarray:
        """Probability of the toxic class for each text of an Arrow column; the bias alone without words."""
        out = []
        for _, chunk in chunks(texts):
            words = Words(chunk)
            top, at = _best(self.words(words), words.text, chunk.n, self.settings.window)
            out.append(1 / (1 + np.exp(-np.clip(self.bias + np.where(at >= 0, top, 0.0), -30, 30))))
        return np.concatenate(out) if out else np.empty(0)


def train(texts: list[str], toxic: list[int], settings: Settings | None = None) -> Model:
    """Joint training with Adagrad over the whole sample at each step; both classes weigh alike."""
    settings = settings or Settings()
    model, y = Model(settings), np.array(toxic, np.float64)
    if not 0 < y.sum() < len(y):
        model.bias[:] = (1.0, -1.0)
        return model
    plain = next(Words(chunk) for _, chunk in chunks(pa.array(texts, pa.large_string()), limit=1 << 40))
    text, n_texts = plain.text, len(y)
    _, example, token = np.unique(plain.plain.hashes(plain.start, plain.end), return_index=True, return_inverse=True)
    spelled = b" ".join(plain.data[plain.start[i] : plain.end[i]].tobytes() for i in example)
    vocabulary = Words(Texts(np.frombuffer(spelled, np.uint8), np.array([0, len(spelled)])))
    del plain
    n_words, owner, member = len(example), [np.arange(len(example))], [vocabulary.whole(settings.buckets)]
    for n in settings.grams:
        bucket, low, high = vocabulary.grams(n, settings.buckets)
        owner.append(np.repeat(np.arange(n_words), high - low))
        member.append(bucket[np.arange(len(owner[-1])) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + np.repeat(low, high - low)])
    owner, member = np.concatenate(owner), np.concatenate(member)
    size = np.bincount(owner, minlength=n_words)
    count = np.maximum(np.bincount(text, minlength=n_texts), 1)
    weigh = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    table_sum, weight_sum, bias_sum = np.full(settings.buckets, 1e-8), np.full(settings.dim, 1e-4), 1e-4
    for step in range(settings.mean_steps + settings.window_steps):
        direction = model.weight[1] - model.weight[0]
        value = np.bincount(owner, weights=(model.table @ direction)[member], minlength=n_words) / size
        if step < settings.mean_steps:
            z = np.bincount(text, weights=value[token], minlength=n_texts) / count
        else:
            z, at = _best(value[token], text, n_texts, settings.window)
        miss = weigh * (1 / (1 + np.exp(-np.clip(z + model.bias[1] - model.bias[0], -30, 30))) - y)
        if step < settings.mean_steps:
            pull = np.bincount(token, weights=(miss / count)[text], minlength=n_words)
        else:
            rows = np.flatnonzero(at >= 0)
            spots = at[rows][:, None] + np.arange(settings.window)
            inside = np.minimum(spots, len(text) - 1)
            mine = (spots < len(text)) & (text[inside] == rows[:, None])
            pull = np.bincount(token[inside[mine]], weights=np.repeat(miss[rows] / settings.window, mine.sum(axis=1)), minlength=n_words)
        share = np.bincount(member, weights=(pull / size)[owner], minlength=settings.buckets)
        turn = share @ model.table
        table_sum += share**2
        model.table -= settings.rate * ((share / np.sqrt(table_sum))[:, None] * direction + settings.decay * model.table)
        weight_sum += turn**2
        move = 0.1 * settings.rate * turn / np.sqrt(weight_sum)
        model.weight += np.stack([move, -move])
        bias_sum += miss.sum() ** 2
        model.bias += np.array([1, -1]) * 0.3 * settings.rate * miss.sum() / np.sqrt(bias_sum)
    return model


def held_out(doc_id):
    """Rows kept out of training: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, positive: int = TRAIN_POSITIVE, negative: int = TRAIN_NEGATIVE, chars: int = TRAIN_CHARS) -> tuple[list[str], list[int]]:
    """A bounded sample of the labelled rows, by hash of the id; conflicting labels of one id count as toxic."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = docs.where(F.length("text") <= chars).where(~held_out(F.col("doc_id"))).select("doc_id", "text").join(known, "doc_id")
    picked = []
    for label, most in ((1, positive), (0, negative)):
        part = lowest(rows.where(F.col("toxic") == label).select("doc_id", "text"), F.xxhash64("doc_id"), most)
        picked += [(text, label) for _, text in sorted((r["doc_id"], r["text"]) for r in part.collect())]
    return [t for t, _ in picked], [y for _, y in picked]


def score(docs: DataFrame, scorer: Scorer, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row; null and empty texts get the bias' score."""
    kind = next(f.dataType for f in docs.schema if f.name == "doc_id")
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("score", T.DoubleType())])

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scorer.column(b.column(1)))], names=["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, schema)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def fit_and_score(docs: DataFrame, labels: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Trains on the labelled rows outside the held-out quarter and scores every row."""
    texts, toxic = training_rows(docs, labels)
    return score(docs, train(texts, toxic, settings).scorer())
