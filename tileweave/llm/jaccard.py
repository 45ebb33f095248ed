"""Exact similarity join of texts under the Jaccard distance of their shingle sets.

Ordinary pivots - sampled documents - are useless here: nearly every document is at distance 1 from any other,
so all of them would sit on every region's boundary. The pivots are therefore single shingles, of which each
document is near to exactly those that it holds. A global order (common shingles last) breaks the ties, so a
document lies in the region of its first shingle. The triangle inequality bounds how far a linked document's
sets may differ, and so which regions it must be copied to: those of its first ``n - ceil(t * n) + 1``
shingles. Inside a region, positions in the order and set sizes are distances to the pivot and to the empty
set; they give windows outside of which no link is possible, and the number of regions that two documents
share gives one more. What is left is compared exactly.

Regions of common shingles are joined recursively: documents of the region become pivots, all others are
measured against them, and links found so split the region into classes. Only documents outside a region's
largest class are joined with the rest of it again, which is all that may be missing.

Documents with equal sets are one node. Equality of shingles and sets is that of 64-bit hashes.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tileweave.session import shared_dir

from .components import components
from .frames import fresh
from .tokens import Texts, chunks, lower, mix, shingles

#: Shingles counted this often or more go last in the order; at most so many of them (8 bytes each) are sent to the executors. The order decides speed, never results.
HOT, HOT_MOST = 24, 1 << 20
#: Shingles a task counts at a time, pivots of a crowded region, slots of the sieve of documents to compare.
COUNT_AT_ONCE, PIVOTS, SIEVE = 2_000_000, 4, 1 << 20
#: Regions, in the order of its common shingles, in which a document meets pivots at first.
MEET = 4
#: Rounds in which the small classes of a crowded region get new pivots, before what is left is joined pair by pair.
WAVES = 1


def _sets(column, k: int):
    """For each chunk: (first row, set size per text, text of each element, element hashes sorted within the text)."""
    for row, texts in chunks(column):
        low = Texts(lower(texts.data), texts.at)
        start, end, owner = low.words()
        words = low.hashes(start, end)
        h, _, text = shingles(words, owner, k)
        count = np.bincount(owner, minlength=texts.n)
        short = np.flatnonzero((count > 0) & (count < k))
        if len(short):
            first = np.concatenate([[0], np.cumsum(count)])
            whole = []
            for t in short:
                x = np.array([count[t]], np.uint64)
                for w in words[first[t] : first[t + 1]]:
                    x = mix(x ^ w) + np.uint64(1)
                whole.append(x[0])
            h, text = np.concatenate([h, np.array(whole, np.uint64)]), np.concatenate([text, short])
        h = h.view(np.int64)
        order = np.lexsort((h, text))
        h, text = h[order], text[order]
        keep = np.ones(len(h), bool)
        keep[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
        h, text = h[keep], text[keep]
        yield row, np.bincount(text, minlength=texts.n), text, h


def _node_ids(size: np.ndarray, text: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A hash of each set (sums of its mixed elements wrap around)."""
    with np.errstate(over="ignore"):
        at = np.concatenate([[0], np.cumsum(size)])
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h.view(np.uint64) + np.uint64(0x51ED2701)), dtype=np.uint64)])
        return mix((sums[at[1:]] - sums[at[:-1]]) ^ mix(size.astype(np.uint64))).view(np.int64)


def _written(df: DataFrame) -> DataFrame:
    """The frame as a table in the shared folder: narrow, compressed, and read again if an executor is lost."""
    path = f"{shared_dir(df.sparkSession)}/join-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _nodes(docs: DataFrame, k: int) -> DataFrame:
    """``doc_id, a, b, counted``: rows with a set size and node (a, b), and rows of counted shingles (a times b)."""
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("counted", T.BooleanType())])

    def common(parts):
        h, n = np.unique(np.concatenate(parts), return_counts=True)
        h, n = h[n > 1], n[n > 1]
        return pa.RecordBatch.from_arrays([pa.nulls(len(h), doc_type), pa.array(h), pa.array(n), pa.array(np.ones(len(h), bool))], names=schema.names)

    doc_type = pa.int64() if isinstance(kind, T.LongType) else pa.int32() if isinstance(kind, T.IntegerType) else pa.string()

    def run(batches):
        held, weight = [], 0
        for b in batches:
            sizes, ids = [], []
            for _, size, text, h in _sets(b.column(1), k):
                sizes.append(size)
                ids.append(_node_ids(size, text, h))
                held.append(h)
                weight += len(h)
                if weight >= COUNT_AT_ONCE:
                    yield common(held)
                    held, weight = [], 0
            if sizes:
                n = np.concatenate(sizes).astype(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(np.concatenate(ids)), pa.array(np.zeros(len(n), bool))], names=schema.names)
        if held:
            yield common(held)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _prefixes(docs: DataFrame, k: int, num: int, den: int, hot: np.ndarray) -> DataFrame:
    """``s, node, n, i, h, common``: the first shingles of each set in the global order.

    ``i``: position of ``s``; ``h``: how many of the set's first shingles are common ones. A task writes a node once.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(hot)

    def run(batches):
        late, seen = shared.value, set()
        for b in batches:
            for _, size, text, h in _sets(b.column(0), k):
                ids = _node_ids(size, text, h)
                unseen = np.zeros(len(size), bool)
                for t in np.flatnonzero(size):
                    if ids[t] not in seen:
                        seen.add(ids[t])
                        unseen[t] = True
                if len(seen) > 500_000:
                    seen.clear()
                keep = unseen[text]
                text, h = text[keep], h[keep]
                spot = np.minimum(np.searchsorted(late, h), max(len(late) - 1, 0))
                common = late[spot] == h if len(late) else np.zeros(len(h), bool)
                order = np.lexsort((h, common, text))
                text, h, common = text[order], h[order], common[order]
                left = np.where(unseen, size, 0)
                place = np.arange(len(h)) - (np.cumsum(left) - left)[text]
                first = place < (left - (left * num + den - 1) // den + 1)[text]
                text, h, common, place = text[first], h[first], common[first], place[first]
                hots = np.bincount(text[common], minlength=len(size))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h), pa.array(ids[text]), pa.array(size[text].astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(hots[text].astype(np.int32)), pa.array(common)],
                    names=["s", "node", "n", "i", "h", "common"],
                )

    return docs.select("text").mapInArrow(run, "s bigint, node bigint, n int, i int, h int, common boolean")


def _first(n: str, num: int, den: int):
    """How many first shingles a set of ``n`` is found by: ``n - ceil(t * n) + 1``."""
    return F.col(n).cast("long") - F.floor((F.col(n).cast("long") * num + den - 1) / den) + 1


def _pairs(left: DataFrame, right: DataFrame, num: int, den: int, hot: bool, *more) -> DataFrame:
    """Pairs of different nodes (``x < y``) of one region within the windows, with the sizes and common counts of both."""
    a, b = left.select(*[F.col(c).alias("l_" + c) for c in left.columns]), right.select(*[F.col(c).alias("r_" + c) for c in right.columns])
    n1, n2, i1, i2 = (F.col(c).cast("long") for c in ("l_n", "r_n", "l_i", "r_i"))
    most = F.least(i1, i2) + F.least(n1 - i1, n2 - i2)
    joined = a.join(b.hint("shuffle_hash"), (F.col("l_s") == F.col("r_s")) & (F.col("l_node") != F.col("r_node")))
    joined = joined.where((num + den) * most >= num * (n1 + n2))
    if hot:
        # A set with a common shingle among its first ones has all its rare ones there; pairs that share a rare one are found by it.
        rest = F.least(n1 - (_first("l_n", num, den) - F.col("l_h")), n2 - (_first("r_n", num, den) - F.col("r_h")))
        joined = joined.where((num + den) * rest >= num * (n1 + n2))
    for condition in more:
        joined = joined.where(condition)
    flip = F.col("l_node") > F.col("r_node")
    pick = lambda one, two, name: F.when(flip, F.col(two)).otherwise(F.col(one)).alias(name)
    return joined.select(
        pick("l_node", "r_node", "x"), pick("r_node", "l_node", "y"), pick("l_n", "r_n", "nx"), pick("r_n", "l_n", "ny"), pick("l_h", "r_h", "hx"), pick("r_h", "l_h", "hy"), F.col("l_s").alias("s")
    )


def _likely(pairs: DataFrame, num: int, den: int, hot: bool) -> DataFrame:
    """Pairs that share enough of their first shingles: ``x, y, nx, ny``.

    Where rare shingles were counted, common ones count as shared; where common ones were, no rare one is.
    """
    counted = pairs.groupBy("x", "y").agg(F.first("nx").alias("nx"), F.first("ny").alias("ny"), F.first("hx").alias("hx"), F.first("hy").alias("hy"), F.count("*").alias("c"))
    unseen = F.lit(0) if hot else F.least("hx", "hy")
    rest = F.greatest(F.col("nx") - _first("nx", num, den), F.col("ny") - _first("ny", num, den))
    enough = F.col("c") + unseen + rest
    return counted.where((num + den) * enough >= num * (F.col("nx") + F.col("ny")).cast("long")).select("x", "y", "nx", "ny")


def _element_sets(docs: DataFrame, reps: DataFrame, k: int) -> DataFrame:
    """``node, rep, elements`` for the documents ``reps`` (``node, rep``) and some others.

    Sets are computed again rather than kept from the start: a sieve of ``SIEVE`` slots by ``doc_id`` lets the
    wanted documents through, and by chance a few more.
    """
    slots = reps.select(F.pmod(F.xxhash64("rep"), F.lit(SIEVE)).alias("slot")).distinct()
    sieve = np.zeros(SIEVE, bool)
    sieve[[r["slot"] for r in slots.collect()]] = True
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(sieve))

    def run(batches):
        open_ = np.unpackbits(shared.value).astype(bool)
        for b in batches:
            chosen = np.flatnonzero(open_[b.column(2).to_numpy(zero_copy_only=False)])
            if not len(chosen):
                continue
            part = b.take(pa.array(chosen))
            for row, size, text, h in _sets(part.column(1), k):
                at = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).slice(row, len(size)), pa.array(_node_ids(size, text, h)), pa.ListArray.from_arrays(pa.array(at), pa.array(h))], names=["rep", "node", "elements"]
                )

    schema = T.StructType([T.StructField("rep", docs.schema["doc_id"].dataType), T.StructField("node", T.LongType()), T.StructField("elements", T.ArrayType(T.LongType()))])
    texts = docs.where("doc_id is not null").select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(SIEVE)).alias("slot"))
    return _written(texts.mapInArrow(run, schema))


def _compare(pairs: DataFrame, sets: DataFrame, reps: DataFrame, num: int, den: int) -> DataFrame:
    """``x, y`` of the pairs that are linked, by intersecting their sets."""
    named = pairs.join(reps.toDF("x", "rx"), "x").join(reps.toDF("y", "ry"), "y")
    both = named.join(sets.select(F.col("node").alias("x"), F.col("rep").alias("rx"), F.col("elements").alias("ex")), ["x", "rx"])
    both = both.join(sets.select(F.col("node").alias("y"), F.col("rep").alias("ry"), F.col("elements").alias("ey")), ["y", "ry"])
    common = F.size(F.array_intersect("ex", "ey")).cast("long")
    return both.where(den * common >= num * (F.col("nx") + F.col("ny") - common)).select("x", "y").distinct()


def jaccard_join(docs: DataFrame, k: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row; links are pairs with ``den * |A & B| >= num * |A | B|``.

    A set holds the distinct windows of ``k`` words (A-Z lower-cased), or the whole text as one if it has fewer
    words. ``component_id``: the smallest ``doc_id`` that links reach, itself included. Null texts and texts
    without words have empty sets and are linked with nothing. Rows without ``doc_id`` get no component.
    Repeated rows have equal sets and so are linked; an empty table gives an empty result.
    """
    docs = docs.select("doc_id", "text")
    found = _written(_nodes(docs, k))
    counted = found.where("counted").groupBy("a").agg(F.sum("b").alias("n")).where(F.col("n") >= HOT)
    top = counted.orderBy(F.desc("n"), "a").limit(HOT_MOST).select("a").toPandas()["a"]
    nodes = found.where("not counted").select("doc_id", F.col("a").alias("n"), F.col("b").alias("node"))
    reps = nodes.where("n > 0 and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("rep"))
    first = _written(_prefixes(docs.where("doc_id is not null"), k, num, den, np.sort(top.to_numpy(np.int64))))
    links = _links(docs, first, _written(reps), k, num, den)
    classes = components(links)
    lowest = classes.join(reps, "node").groupBy("label").agg(F.min("rep").alias("low"))
    named = classes.join(lowest, "label").select("node", "low")
    out = nodes.join(reps, "node", "left").join(named, "node", "left")
    own = F.when(F.col("doc_id").isNull(), F.col("doc_id")).when(F.col("n") > 0, F.coalesce("low", "rep")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def _open_regions(hot: DataFrame, links: DataFrame) -> DataFrame:
    """Members of the crowded regions that hold several classes: ``label``, and ``minor`` outside the largest class."""
    placed = hot.join(components(links), "node", "left").withColumn("label", F.coalesce("label", "node"))
    sizes = placed.groupBy("s", "label").agg(F.count("*").alias("c")).groupBy("s").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.count("*").alias("parts"))
    open_ = placed.join(sizes.where("parts > 1"), "s")
    return _written(open_.select(*hot.columns, "label", (F.col("label") != F.col("main")).alias("minor")))


def _pivots(members: DataFrame, num: int, den: int) -> DataFrame:
    """``s, node``: pivots of each region. First those with the fewest rare shingles, which are nearest to what all share."""
    rare = _first("n", num, den) - F.col("h")
    orders = [F.struct(rare, F.xxhash64("node", F.lit(r))) if r % 2 == 0 else F.xxhash64("node", F.lit(r)) for r in range(PIVOTS)]
    chosen = members.groupBy("s").agg(*[F.min_by("node", o).alias(f"p{r}") for r, o in enumerate(orders)])
    return chosen.select("s", F.explode(F.array_distinct(F.array(*[f"p{r}" for r in range(PIVOTS)]))).alias("node"))


def _links(docs: DataFrame, first: DataFrame, reps: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Links of different nodes, enough of them to connect every class."""
    cold = first.where("not common").drop("common").repartition("s").dropDuplicates(["s", "node"])
    likely = _likely(_pairs(cold, cold, num, den, False, F.col("l_node") < F.col("r_node")), num, den, False)
    hot = _written(first.where("common").drop("common").dropDuplicates(["s", "node"]))
    # The regions of one group of copies have the same few pivots; a document meets those of its first common shingles.
    early = F.col("l_i") - (_first("l_n", num, den) - F.col("l_h")) < MEET
    measured = _pairs(hot, hot.join(_pivots(hot, num, den), ["s", "node"]).select(*hot.columns), num, den, True, early)
    wave = _written(likely.unionByName(measured.select("x", "y", "nx", "ny").distinct()).distinct())
    wanted = wave.select(F.col("x").alias("node")).union(wave.select("y")).union(hot.select("node")).distinct()
    wanted = _written(reps.join(wanted, "node", "left_semi"))
    sets = _element_sets(docs, wanted, k)
    links = _written(_compare(wave, sets, wanted, num, den))
    for _ in range(WAVES):
        members = _open_regions(hot, links)
        if members.isEmpty():
            return links
        middle = members.join(_pivots(members.where("minor"), num, den), ["s", "node"], "left_semi")
        measured = _pairs(members, middle.select(*members.columns), num, den, True, F.col("l_label") != F.col("r_label"))
        found = _compare(measured.select("x", "y", "nx", "ny").distinct(), sets, wanted, num, den)
        links = _written(links.union(found))
    members = _open_regions(hot, links)
    missing = _pairs(members.where("minor"), members, num, den, True, F.col("l_label") != F.col("r_label")).distinct()
    return links.union(_compare(_likely(missing, num, den, True), sets, wanted, num, den))


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The documents without near copies: of each class the smallest ``doc_id`` stays, with all its columns.

    Rows that share a ``doc_id`` are one document; they and rows without ``doc_id`` stay as they are, and so
    do documents without words.
    """
    (gone,) = fresh(docs, "copied_doc_id")
    classes = jaccard_join(docs, k, num, den).where("doc_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("low"))
    copies = classes.where("doc_id <> low").select(F.col("doc_id").alias(gone))
    return docs.join(copies.hint("shuffle_hash"), docs["doc_id"] == F.col(gone), "left_anti")
