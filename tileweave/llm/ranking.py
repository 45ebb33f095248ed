"""Ranked lexical search: accumulator-limited term-at-a-time evaluation over blocks of documents.

The index is a table with one row per block of documents: sorted terms and, for each, the documents that hold it.
It keeps the terms that some item may use. An item's terms are taken rarest first. Waves go through bands of document
frequency; each finds, over all blocks, the k-th highest partial score of every item. Once that is above the
sum of the remaining terms' bounds, no document without an accumulator can reach the first k any more: later terms
create none and only update the accumulators there are. A last pass does this with each item's stopping point
and sends at most k rows of an item and task to the final ranking.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tileweave.session import cut_lineage

from .tokens import Texts, chunks, lower

#: Documents and postings of an index block. They bound memory only.
BLOCK_DOCS, BLOCK_POSTINGS = 8192, 1_000_000
#: Items are evaluated in groups of about so many terms: what a task gets to know of them (some 32 bytes a term).
GROUP_TERMS = 200_000
#: Bits of the sieve of item terms that indexing tasks get (512 KB); it decides which terms are indexed in vain, no more.
SIEVE_BITS = 22
#: Document frequencies of a band are within this factor.
BAND = 8

_TERM = np.zeros(256, bool)
for _low, _high in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    _TERM[_low : _high + 1] = True

_INDEX = "doc_id binary, known binary, size binary, term binary, stop binary, at binary, tf binary, n_docs long, n_terms long"


def terms_of(chunk: Texts):
    """Hash and text number of each term: runs of ASCII letters, digits and signs beyond ASCII, A-Z lower-cased."""
    chunk.white = ~_TERM[chunk.data]
    start, end, text = chunk.words()
    return chunk.hashes(start, end, data=lower(chunk.data)), text


def item_terms(items: DataFrame) -> DataFrame:
    """``item_id, term``, once each. Rows of one ``item_id`` are one item; rows without it are none."""

    def run(batches):
        for b in batches:
            ids = b.column(0)
            for first, chunk in chunks(b.column(1)):
                h, text = terms_of(chunk)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(text + first)), pa.array(h.view(np.int64))], names=["item_id", "term"])

    kind = next(f.dataType.simpleString() for f in items.schema if f.name == "item_id")
    rows = items.where("item_id is not null and text is not null").select("item_id", "text")
    return rows.mapInArrow(run, f"item_id {kind}, term long").distinct()


def _sieve(wanted: DataFrame) -> np.ndarray:
    """One bit for each value of a term hash's highest bits; the driver gets at most 2^(SIEVE_BITS - 6) rows."""
    slot = F.shiftrightunsigned("term", 64 - SIEVE_BITS)
    words = wanted.select(F.shiftright(slot, 6).alias("word"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(term, {64 - SIEVE_BITS}) & 63 as int))").alias("bit"))
    bits = np.zeros(1 << SIEVE_BITS - 6, np.int64)
    for r in words.groupBy("word").agg(F.bit_or("bit").alias("bits")).collect():
        bits[r["word"]] = r["bits"]
    return np.unpackbits(bits.view(np.uint8), bitorder="little").astype(bool)


def index(docs: DataFrame, sieve: np.ndarray, block_docs: int = BLOCK_DOCS, block_postings: int = BLOCK_POSTINGS) -> DataFrame:
    """Blocks of the documents that have a term; of their terms those that pass the sieve."""
    shared = docs.sparkSession.sparkContext.broadcast(sieve)

    def block(parts):
        ids, known, size, doc, term, tf = (np.concatenate([p[k] for p in parts]) for k in range(6))
        order = np.lexsort((doc, term))
        term, doc, tf = term[order], doc[order], tf[order]
        edge = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.empty(0, np.int64)
        arrays = (ids, known, size, term[edge], np.append(edge, len(term))[1:], doc.astype(np.int32), tf.astype(np.int32))
        columns = [pa.array([a.tobytes()], pa.binary()) for a in arrays] + [pa.array([len(ids)]), pa.array([int(size.sum())])]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _INDEX.split(", ")])

    def run(batches):
        parts, n_docs, n_postings = [], 0, 0
        for b in batches:
            ids, known = np.asarray(b.column(0).fill_null(0), np.int64), np.asarray(b.column(0).is_valid())
            for first, chunk in chunks(b.column(1), limit=1 << 18):
                h, text = terms_of(chunk)
                size = np.bincount(text, minlength=chunk.n)
                full = np.flatnonzero(size)
                if not len(full):
                    continue
                at = np.full(chunk.n, -1)
                at[full] = np.arange(len(full)) + n_docs
                pass_ = shared.value[h >> np.uint64(64 - SIEVE_BITS)]
                h, doc = h[pass_], at[text[pass_]]
                order = np.lexsort((h, doc))
                h, doc = h[order], doc[order]
                edge = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])) if len(h) else np.empty(0, np.int64)
                parts.append((ids[first + full], known[first + full], size[full].astype(np.int64), doc[edge], h[edge], np.diff(np.append(edge, len(h)))))
                n_docs, n_postings = n_docs + len(full), n_postings + len(edge)
                if n_docs >= block_docs or n_postings >= block_postings:
                    yield block(parts)
                    parts, n_docs, n_postings = [], 0, 0
        if parts:
            yield block(parts)

    return cut_lineage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, _INDEX))


class Block:
    """One row of the index with the impact of each posting, given the number of documents and of their terms."""

    def __init__(self, row: dict, n_all: int, terms_all: int):
        kinds = (("doc_id", np.int64), ("known", bool), ("size", np.int64), ("term", np.uint64), ("stop", np.int64), ("at", np.int32), ("tf", np.int32))
        self.doc_id, self.known, size, self.term, stop, self.at, tf = (np.frombuffer(row[name], kind) for name, kind in kinds)
        self.bounds = np.concatenate([[0], stop])
        m = 10 + (90 * size * n_all) // terms_all
        tf = tf.astype(np.int64)
        self.impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[self.at])

    def scores(self, item: "Item", creating: int, using: int):
        """Accumulators after the first ``using`` terms, of which only the first ``creating`` create some: documents and sums."""
        total, held = np.zeros(len(self.doc_id), np.int64), np.zeros(len(self.doc_id), bool)
        if not len(self.term):
            return np.empty(0, np.int64), total[:0]
        spot = np.minimum(np.searchsorted(self.term, item.term[:using]), len(self.term) - 1)
        for r in np.flatnonzero(self.term[spot] == item.term[:using]):
            a, b = self.bounds[spot[r]], self.bounds[spot[r] + 1]
            doc, value = self.at[a:b], item.weight[r] * self.impact[a:b]
            if r < creating:
                total[doc] += value
                held[doc] = True
            else:
                there = held[doc]
                total[doc[there]] += value[there]
        doc = np.flatnonzero(total)
        return doc, total[doc]


@dataclass
class Item:
    """The terms of an item, rarest first: hash, weight, band, and ``rest[r]``, the bound of all from ``r`` on."""

    item_id: object
    term: np.ndarray
    weight: np.ndarray
    band: np.ndarray
    rest: np.ndarray
    stop: int | None = None

    def before(self, band: int) -> int:
        return int(np.searchsorted(self.band, band))


def _rows(blocks: DataFrame):
    return [c for c in blocks.columns if c not in ("n_docs", "n_terms")]


def _statistics(blocks: DataFrame, n_all: int, terms_all: int) -> DataFrame:
    """``term, df, top``: documents and the highest impact of each indexed term."""

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                block = Block(row, n_all, terms_all)
                if len(block.term):
                    top = np.maximum.reduceat(block.impact, block.bounds[:-1])
                    yield pa.RecordBatch.from_arrays([pa.array(block.term.view(np.int64)), pa.array(np.diff(block.bounds)), pa.array(top)], names=["term", "df", "top"])

    return blocks.select(_rows(blocks)).mapInArrow(run, "term long, df long, top long").groupBy("term").agg(F.sum("df").alias("df"), F.max("top").alias("top"))


def _group(rows, band: int) -> list[Item]:
    by_item: dict = {}
    for r in rows:
        by_item.setdefault(r["item_id"], []).append((r["df"], r["term"], r["weight"], r["weight"] * r["top"]))
    out = []
    for item_id, terms in by_item.items():
        terms.sort()
        df, term, weight, most = (list(x) for x in zip(*terms))
        rest = np.concatenate([np.cumsum(np.array(most, np.int64)[::-1])[::-1], [0]])
        out.append(Item(item_id, np.array(term, np.int64).view(np.uint64), np.array(weight, np.int64), np.floor(np.log(df) / np.log(band) + 1e-9).astype(int), rest))
    return out


def _best(blocks: DataFrame, items: list[Item], wanted: list[tuple[int, int, int]], k: int, n_all: int, terms_all: int) -> DataFrame:
    """``item, doc_id, score``: each task's ``k`` best accumulators of each (item, creating, using) over its blocks."""
    shared = blocks.sparkSession.sparkContext.broadcast(([items[i] for i, _, _ in wanted], wanted))

    def run(batches):
        parts, plan = shared.value
        best: dict[int, tuple] = {}
        for b in batches:
            for row in b.to_pylist():
                block = Block(row, n_all, terms_all)
                for item, (i, creating, using) in zip(parts, plan):
                    doc, score = block.scores(item, creating, using)
                    if i in best and len(best[i][0]) == k:
                        near = score >= best[i][0][-1]
                        doc, score = doc[near], score[near]
                    if not len(doc):
                        continue
                    ids, known = block.doc_id[doc], block.known[doc]
                    if i in best:
                        score, ids, known = (np.concatenate(x) for x in zip(best[i], (score, ids, known)))
                    if len(score) > k:
                        near = np.flatnonzero(score >= np.partition(score, -k)[-k])
                        score, ids, known = score[near], ids[near], known[near]
                    order = np.lexsort((ids, known, -score))[:k]
                    best[i] = score[order], ids[order], known[order]
        for i, (score, ids, known) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array([i] * len(ids), pa.int32()), pa.array(ids, mask=~known), pa.array(score)], names=["item", "doc_id", "score"])

    rows = blocks.select(_rows(blocks)).mapInArrow(run, "item int, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def stopping_points(blocks: DataFrame, items: list[Item], k: int, n_all: int, terms_all: int) -> None:
    """Sets ``stop`` of each item: how many of its rarest terms create accumulators.

    A wave works on the items that are still open, up to the end of its band. Scores only grow with further
    terms, so a k-th partial score above the rest's bound settles that a document without an accumulator is not
    among the first k; at equality it could be, so creation goes on.
    """
    for band in sorted({int(b) for item in items for b in item.band}):
        wanted = []
        for i, item in enumerate(items):
            using = item.before(band + 1)
            if item.stop is None and using > item.before(band):
                if using == len(item.term):
                    item.stop = using
                else:
                    wanted.append((i, using, using))
        if wanted:
            using = {i: u for i, u, _ in wanted}
            for r in _best(blocks, items, wanted, k, n_all, terms_all).where(F.col("rank") == k).collect():
                if r["score"] > items[r["item"]].rest[using[r["item"]]]:
                    items[r["item"]].stop = using[r["item"]]


def search(docs: DataFrame, items: DataFrame, k: int = 10, block_docs: int = BLOCK_DOCS, block_postings: int = BLOCK_POSTINGS, group_terms: int = GROUP_TERMS, band: int = BAND) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of each item with a score above 0.

    Every row of ``docs`` is a document, so repeated rows are ranked one by one; equal scores go by ``doc_id``, null
    first. Null texts and texts without a term are no documents. Items without a term in any document, and
    either table empty, give no rows. Texts are read whole; other columns of both tables are ignored.
    """
    spark = docs.sparkSession
    kind = next(f.dataType.simpleString() for f in items.schema if f.name == "item_id")
    wanted = cut_lineage(item_terms(items))
    blocks = index(docs, _sieve(wanted), block_docs, block_postings)
    n_all, terms_all = blocks.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    result = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    if not n_all:
        return result
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(2 * n_all + 2) / (2 * F.col("df") + 1)))
    weighed = cut_lineage(wanted.join(_statistics(blocks, n_all, terms_all), "term").withColumn("weight", weight.cast("long")))
    groups = -(-weighed.count() // group_terms)
    for g in range(groups):
        mine = weighed.where(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == g).select("item_id", "term", "df", "weight", "top")
        parts = _group(mine.collect(), band)
        if not parts:
            continue
        stopping_points(blocks, parts, k, n_all, terms_all)
        names = spark.createDataFrame([(i, item.item_id) for i, item in enumerate(parts)], f"item int, item_id {kind}")
        best = _best(blocks, parts, [(i, item.stop, len(item.term)) for i, item in enumerate(parts)], k, n_all, terms_all)
        result = result.union(best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    return result
