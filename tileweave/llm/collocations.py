"""Phrase collocations from weighted acyclic automata of word n-grams.

Tasks turn texts into counted paths of up to three words, sorted by hashes, and cut them at boundaries drawn from a
sample: ranges of prefixes, so a hot first word is spread over several. Each range of a shard becomes a
transducer; the transducers of a range are united, weights summed. With many ranges this takes rounds of
``FAN`` coarser cells, each united in bounded groups and cut again. What is left of a range above the least count is
one small transducer; candidates are read off these, and the counts of their parts by composing each range with
the paths asked for there.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from tileweave.session import cut_lineage

from .automata import Names, Paths, Transducer, _runs, condense, encode
from .tokens import chunks, lower, mix

LEAST, SHARE, FIRST = 10, 50, 2000
#: Words that a task counts before it writes transducers; words of a range; cells that a round cuts a cell into.
FLUSH, RANGE, FAN = 600_000, 1_200_000, 256
#: Rows whose texts a task copies at once.
ROWS = 1000
#: Bound of the ranges (8 bytes each go to the tasks), and sampled keys a range (to the driver, 8 bytes each).
MOST_RANGES, KEYS = 1 << 19, 16
#: Most tasks of a round; with more cells a task has several, one after the other.
MOST_TASKS = 20_000
#: Rows of a table of counts are dealt over so many copies where candidates ask for them: many may share a word.
COPIES = 16
NO_LANG = "und"

_STEP = np.uint64(0x9E3779B97F4A7C15)
_BREAK, _GAP = np.zeros(256, bool), np.zeros(256, bool)
_BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
_GAP[list(b" \t")] = True
_HASHES = "g long, h2 long, h3 long"
_SHIFTS = np.uint64(40), np.uint64(44), np.uint64(20)


def _lang_hash(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))


def first_label(lang_hash, word_hash):
    """The label of a first word: one number for language and word."""
    with np.errstate(over="ignore"):
        return np.maximum(mix(word_hash * _STEP + lang_hash), np.uint64(1))


def order_key(g, h2, h3):
    """64 bits of a path, in the order of its labels; all paths with a common prefix form an interval."""
    a, b, c = _SHIFTS
    return g >> a << a | h2 >> b << c | h3 >> b


def interval(g, h2):
    """The least and greatest key of the paths that begin with ``g`` (and ``h2``, where it is not 0)."""
    low = order_key(g, h2, np.uint64(0))
    return low, low | np.where(h2 > 0, np.uint64((1 << 20) - 1), np.uint64((1 << 40) - 1))


def read(langs: pa.Array, texts: pa.Array):
    """Per chunk of texts, the counted windows of three words inside pieces (shorter at their ends), and the words."""
    codes = langs.cast(pa.string()).fill_null(NO_LANG).dictionary_encode()
    names, code = codes.dictionary.cast(pa.large_string()), codes.indices.to_numpy(zero_copy_only=False)
    hashes = np.array([_lang_hash(x) for x in names.to_pylist()], np.uint64)
    for first, chunk in chunks(texts):
        data = lower(chunk.data)
        breaks = _BREAK[data]
        chunk.white = breaks | _GAP[data]
        start, end, text = chunk.words()
        if not len(start):
            continue
        lang = code[first : first + chunk.n][text]
        h = np.maximum(chunk.hashes(start, end, data=data), np.uint64(1))
        before = np.concatenate([[0], np.cumsum(breaks)])
        more = np.zeros(len(start) + 2, bool)
        more[: len(start) - 1] = (before[start[1:]] == before[end[:-1]]) & (text[1:] == text[:-1])
        next_ = np.concatenate([h, np.zeros(2, np.uint64)])
        h2 = np.where(more[: len(h)], next_[1 : len(h) + 1], np.uint64(0))
        h3 = np.where(more[: len(h)] & more[1 : len(h) + 1], next_[2:], np.uint64(0))
        g = first_label(hashes[lang], h)
        _, at = np.unique(g, return_index=True)
        size = end[at] - start[at]
        offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[_runs(start[at], size)].tobytes())])
        yield Paths(g, h2, h3, np.ones(len(g), np.int64)), Names(g[at], h[at], words, names.take(pa.array(lang[at])))


@dataclass(frozen=True)
class Ranges:
    """Boundaries of ``len(edges) + 1`` ranges of keys, and for each round into how many ranges its cells reach."""

    edges: np.ndarray
    fan: int

    def steps(self) -> list[int]:
        widths, n = [1], len(self.edges) + 1
        while widths[-1] * self.fan < n:
            widths.append(widths[-1] * self.fan)
        return widths[::-1]

    def of(self, keys: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edges, keys, "right")

    def cut(self, g: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """True for prefixes whose paths lie in several ranges."""
        low, high = interval(g, h2)
        return self.of(low) != self.of(high)


def _cells(paths: Paths, names: Names, ranges: Ranges, step: int):
    """A transducer for each cell of ``step`` ranges."""
    cell = ranges.of(order_key(paths.g, paths.h2, paths.h3)) // step
    order = np.argsort(cell, kind="stable")
    bounds = np.concatenate([np.flatnonzero(np.concatenate([[True], np.diff(cell[order]) > 0])), [len(cell)]])
    blobs = [encode(paths.at(order[a:b]), names) for a, b in zip(bounds[:-1], bounds[1:])]
    return pa.RecordBatch.from_arrays([pa.array(cell[order][bounds[:-1]], pa.int32()), pa.array(blobs, pa.binary())], names=["cell", "blob"])


def _union(blobs) -> tuple[Paths, Names]:
    paths, names = [], []
    for blob in blobs:
        part = Transducer(blob)
        paths.append(part.paths())
        names.append(part.names)
    return condense(paths), Names.union(names)


def _again(ranges, step: int):
    def run(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_cells(*_union(table.column("blob").to_pylist()), ranges.value, step)])

    return run


def _boundaries(docs: DataFrame, chars: int, range_words: int, fan: int) -> Ranges:
    """Quantiles of a sample of keys: 1 in 32 rows of large tables, and of those about ``KEYS`` words a range."""
    n = min(MOST_RANGES, -(-chars // (6 * range_words)))
    if n < 2:
        return Ranges(np.empty(0, np.uint64), fan)
    share = 1 / 32 if chars > 1 << 28 else 1.0
    each = np.uint64(max(1, int(share * chars / 6 / (KEYS * n))))

    def run(batches):
        for b in batches:
            for paths, _ in read(b.column(0), b.column(1)):
                key = order_key(paths.g, paths.h2, paths.h3)
                with np.errstate(over="ignore"):
                    taken = mix(key + np.arange(len(key), dtype=np.uint64) * _STEP) % each == 0
                yield pa.RecordBatch.from_arrays([pa.array(key[taken].view(np.int64))], names=["key"])

    keys = docs.sample(share, 7).mapInArrow(run, "key long").toArrow().column("key").to_numpy().astype(np.int64).view(np.uint64)
    keys = np.sort(keys)
    return Ranges(np.unique(keys[np.arange(1, n) * len(keys) // n]) if len(keys) else np.empty(0, np.uint64), fan)


def transducers(docs: DataFrame, least: int = LEAST, flush: int = FLUSH, range_words: int = RANGE, fan: int = FAN) -> tuple[DataFrame, Ranges]:
    """``cell, blob, langs, sizes``: a transducer for each range, and how many words of each language begin there.

    Arcs below ``least`` are left out unless other ranges may hold more of the same path.
    """
    texts = docs.select(F.col("lang").cast("string").alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    chars = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = _boundaries(texts, chars, range_words, fan)
    shared, steps = docs.sparkSession.sparkContext.broadcast(ranges), ranges.steps()

    def count(batches):
        paths, names, n = [], [], 0
        for b in batches:
            for first in range(0, b.num_rows, ROWS):
                for p, words in read(b.column(0).slice(first, ROWS), b.column(1).slice(first, ROWS)):
                    paths.append(p)
                    names.append(words)
                    n += len(p)
                    if n >= flush:
                        yield _cells(condense(paths), Names.union(names), shared.value, steps[0])
                        paths, names, n = [], [], 0
                        pa.default_memory_pool().release_unused()
        if n:
            yield _cells(condense(paths), Names.union(names), shared.value, steps[0])

    cells = texts.mapInArrow(count, "cell int, blob binary")
    for before, step in zip(steps[:-1], steps[1:]):
        groups = max(1, before * range_words // flush)
        dealt = cells.withColumn("part", F.pmod(F.xxhash64("blob"), F.lit(groups)))
        tasks = min(MOST_TASKS, -(-(len(ranges.edges) + 1) // before) * groups)
        cells = dealt.repartition(tasks, "cell", "part").groupBy("cell", "part").applyInArrow(_again(shared, step), "cell int, blob binary")

    def unite(table: pa.Table) -> pa.Table:
        paths, names = _union(table.column("blob").to_pylist())
        begins = np.flatnonzero(np.concatenate([[True], paths.g[1:] != paths.g[:-1]]))
        total = np.add.reduceat(paths.n, begins)
        sizes: dict[str, int] = {}
        for lang, size in zip(names.lang.to_pylist(), total[np.searchsorted(paths.g[begins], names.g)].tolist()):
            sizes[lang] = sizes.get(lang, 0) + size
        blob = encode(_keep(paths, least, shared.value), names)
        return pa.table({"cell": table.column("cell").slice(0, 1), "blob": pa.array([blob], pa.binary()), "langs": [list(sizes)], "sizes": [list(sizes.values())]})

    schema = "cell int, blob binary, langs array<string>, sizes array<long>"
    # As many tasks as ranges: the number follows the data, not a setting.
    dealt = cells.repartition(min(MOST_TASKS, len(ranges.edges) + 1), "cell")
    return cut_lineage(dealt.groupBy("cell").applyInArrow(unite, schema)), ranges


def _keep(paths: Paths, least: int, ranges: Ranges) -> Paths:
    """The paths that matter: rare tails are added up at the longest prefix that is kept."""
    g, h2, h3, n = paths.g, paths.h2.copy(), paths.h3.copy(), paths.n
    h3[n < least] = 0
    new = np.concatenate([[True], (g[1:] != g[:-1]) | (paths.h2[1:] != paths.h2[:-1])])
    begins = np.flatnonzero(new)
    weight = np.add.reduceat(n, begins)[np.cumsum(new) - 1]
    rare = (weight < least) & ~ranges.cut(g, paths.h2)
    h2[rare], h3[rare] = 0, 0
    begins = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    weight = np.add.reduceat(n, begins)[np.searchsorted(g[begins], g)]
    stays = (weight >= least) | ranges.cut(g, np.zeros(len(g), np.uint64))
    return condense([Paths(g[stays], h2[stays], h3[stays], n[stays])])


def candidates(cells: DataFrame, least: int = LEAST) -> DataFrame:
    """``lang, g, h2, h3, g2, g3, a`` of the phrases of two (``h3`` null) and three words with at least ``least`` occurrences.

    ``g2`` and ``g3`` are the labels that the second and third word have as first words.
    """

    def run(batches):
        for b in batches:
            for blob in b.column(0).to_pylist():
                t = Transducer(blob)
                (of1, second, w2), (of2, third, w3) = t.arcs()
                langs = t.names.lang.dictionary_encode()
                hashes = np.array([_lang_hash(x) for x in langs.dictionary.to_pylist()], np.uint64)
                code = np.asarray(langs.indices)
                for root, mid, last, a in ((of1, second, None, w2), (of1[of2], second[of2], third, w3)):
                    base, none = hashes[code[root]] if len(root) else np.empty(0, np.uint64), np.ones(len(root), bool)
                    signed = lambda x: pa.array(x.view(np.int64))
                    tail = [pa.array(np.zeros(len(root), np.int64), mask=none)] * 2 if last is None else [signed(last), signed(first_label(base, last))]
                    lang = t.names.lang.cast(pa.string()).take(pa.array(root))
                    yield pa.RecordBatch.from_arrays([lang, signed(t.names.g[root]), signed(mid), tail[0], signed(first_label(base, mid)), tail[1], pa.array(a)], names=["lang", "g", "h2", "h3", "g2", "g3", "a"])

    rows = cells.select("blob").mapInArrow(run, "lang string, g long, h2 long, h3 long, g2 long, g3 long, a long")
    return cut_lineage(rows.groupBy("lang", "g", "h2", "h3", "g2", "g3").agg(F.sum("a").alias("a")).where(F.col("a") >= least))


def part_counts(cells: DataFrame, ranges: Ranges, parts: DataFrame) -> DataFrame:
    """``g, h2, f, word``: occurrences of the asked paths (``g``, and ``h2`` or 0), and the first word of those of one word.

    A request goes to each range that its prefix reaches into and is composed with the transducer there.
    """
    shared = cells.sparkSession.sparkContext.broadcast(ranges)

    def route(batches):
        for b in batches:
            g, h2 = (np.asarray(b.column(k)).astype(np.int64).view(np.uint64) for k in (0, 1))
            low, high = (shared.value.of(x) for x in interval(g, h2))
            width = high - low + 1
            cell, who = _runs(low, width), np.repeat(np.arange(len(g)), width)
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(g[who].view(np.int64)), pa.array(h2[who].view(np.int64))], names=["cell", "g", "h2"])

    def compose(asked: pa.Table, held: pa.Table) -> pa.Table:
        g, h2 = (asked.column(c).to_numpy().astype(np.int64).view(np.uint64) for c in ("g", "h2"))
        out = [pa.table({"g": pa.array([], pa.int64()), "h2": pa.array([], pa.int64()), "f": pa.array([], pa.int64()), "word": pa.array([], pa.binary())})]
        for blob in held.column("blob").to_pylist():
            t = Transducer(blob)
            f, root = t.weigh(g, h2)
            word = t.names.word.cast(pa.binary()).take(pa.array(root, mask=(root < 0) | (h2 > 0)))
            out.append(pa.table({"g": g.view(np.int64), "h2": h2.view(np.int64), "f": f, "word": word}))
        return pa.concat_tables(out)

    asked = parts.distinct().mapInArrow(route, "cell int, g long, h2 long")
    replies = asked.groupBy("cell").cogroup(cells.select("cell", "blob").groupBy("cell")).applyInArrow(compose, "g long, h2 long, f long, word binary")
    return replies.groupBy("g", "h2").agg(F.sum("f").alias("f"), F.max("word").alias("word"))


def _score(a, left, right):
    """floor(1000000 a a / (left right)), exact for counts below 10^15."""
    a, left, right = (c.cast("decimal(18,0)") for c in (a, left, right))
    return F.call_function("div", (a * a).cast("decimal(31,0)") * F.lit(1_000_000).cast("decimal(7,0)"), left * right)


def collocations(docs: DataFrame, least: int = LEAST, share: int = SHARE, first: int = FIRST, flush: int = FLUSH, range_words: int = RANGE, fan: int = FAN) -> DataFrame:
    """The ``first`` phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    Null texts and empty ones have no words, a null ``lang`` is ``und``; each row counts, repeated or not; very long
    texts are read whole; other columns of ``docs`` are ignored; an empty table gives no rows. Equal scores go by
    ``a``, then by the phrase's bytes; of equal cuts the first counts.
    """
    cells, ranges = transducers(docs, least, flush, range_words, fan)
    found = candidates(cells, least)
    whole = F.col("h3").isNotNull()
    roles = [("w1", F.col("g"), F.lit(0)), ("w2", F.col("g2"), F.lit(0)), ("w3", F.col("g3"), F.lit(0)), ("head", F.when(whole, F.col("g")), F.col("h2")), ("tail", F.when(whole, F.col("g2")), F.col("h3"))]
    role = F.explode(F.array(*[F.struct(F.lit(name).alias("role"), g.alias("pg"), h.cast("long").alias("ph")) for name, g, h in roles]))
    asked = found.select("lang", "g", "h2", "h3", "a", role.alias("part")).select("lang", "g", "h2", "h3", "a", "part.*").where("pg is not null")
    counts = cut_lineage(part_counts(cells, ranges, asked.select(F.col("pg").alias("g"), F.col("ph").alias("h2"))))
    copies = counts.select(F.col("g").alias("pg"), F.col("h2").alias("ph"), "f", "word", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))).alias("copy"))
    joined = asked.withColumn("copy", F.pmod(F.xxhash64("g", "h2", "h3"), F.lit(COPIES)).cast("int")).join(copies, ["pg", "ph", "copy"])

    def of(name, column):
        return F.max(F.when(F.col("role") == name, F.col(column)))

    text = F.concat_ws(" ", *[of(w, "word").cast("string") for w in ("w1", "w2", "w3")])
    known = joined.groupBy("lang", "g", "h2", "h3", "a").agg(text.alias("phrase"), *[of(name, "f").alias(name) for name, _, _ in roles])
    # The longer phrases that hold a phrase of two words: its words begin or end them.
    inner = F.explode(F.array(F.struct(F.col("g"), F.col("h2")), F.struct(F.col("g2").alias("g"), F.col("h3").alias("h2"))))
    around = found.where(whole).select("a", inner.alias("p")).groupBy("p.g", "p.h2").agg(F.max("a").alias("longer"))
    kept = known.join(around, ["g", "h2"], "left").where(F.col("h3").isNotNull() | F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
    one, two = _score(F.col("a"), F.col("w1"), F.coalesce("tail", "w2")), _score(F.col("a"), F.col("head"), F.col("w3"))
    scored = kept.select("lang", "phrase", "a", "w1", "w2", "w3", "head", "tail", one.alias("one"), F.when(F.col("w3").isNotNull(), two).alias("two"))
    late = F.coalesce(F.col("two") < F.col("one"), F.lit(False))
    cut = scored.select("lang", "phrase", "a", F.when(late, F.col("head")).otherwise(F.col("w1")).alias("l"), F.when(late, F.col("w3")).otherwise(F.coalesce("tail", "w2")).alias("r"), F.when(late, F.col("two")).otherwise(F.col("one")).cast("long").alias("score"))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    best = cut.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first)
    sizes = cells.select(F.explode(F.arrays_zip("langs", "sizes")).alias("s")).groupBy(F.col("s.langs").alias("lang")).agg(F.sum("s.sizes").alias("n"))
    return best.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
