"""Benchmark decontamination with spaced seeds.

A seed is a mask over consecutive tokens that skips some positions, so a substituted word there does not
hide a match. Hashes of the masked tokens of test items and of documents are joined; every hit fixes a
diagonal (document position minus item position), and around it the aligned tokens are compared: the pair
counts as a leak if some ``window`` aligned positions hold at least ``least`` equal tokens. The masks of a length
hit every way in which so many tokens can be equal, so no pair that this rule admits is missed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from tileweave.session import cut_lineage

from .frames import lower_ascii, words_of

WINDOW, LEAST = 20, 16
#: Test seeds broadcast at a time (some 50 bytes each, and the tokens of their items); more go in blocks, one pass over the
#: documents each. Hits up to this number are broadcast, more are joined by shuffle.
BLOCK_SEEDS = 1_000_000
#: Windows of a piece of text that is compared.
SPOTS = 25


def masks_for(n: int) -> tuple[str, ...]:
    """Masks for ``n`` aligned tokens (``WINDOW`` at most) that hit every pattern with at most one substitution in five.

    Up to four tokens no substitution is left, so the whole item is the seed. Every set was found complete by enumeration,
    which a test repeats.
    """
    if n < 5:
        return ("1" * n,)
    if n < 8:
        return ("11",) if n == 5 else ("111",)
    return ("111011", "11111", "11010011") if n in (10, 11) else ("111011", "11111")


def tokens(text):
    """Words, A-Z lower-cased, without ``.,;:!?"'()`` at their ends."""
    return F.filter(F.transform(words_of(lower_ascii(text)), lambda w: F.btrim(w, F.lit(".,;:!?\"'()"))), lambda w: w != "")


def _hashed(text):
    return F.transform(tokens(text), lambda w: F.xxhash64(w))


def _seeds(rows: DataFrame, masks: tuple[str, ...], every: tuple[str, ...], *keep: str) -> DataFrame:
    """``*keep, pos, mask, h``: the masked hashes at all token positions of the column ``th``; ``mask`` counts in ``every``."""
    least = min(len(m) for m in masks)
    at = rows.where(F.size("th") >= least).select(*keep, "th", F.explode(F.sequence(F.lit(0), F.size("th") - least)).alias("pos"))

    def seed(mask):
        parts = [F.get("th", F.col("pos") + k) for k, bit in enumerate(mask) if bit == "1"]
        return F.when(F.lit(mask in masks) & (F.col("pos") + len(mask) <= F.size("th")), F.xxhash64(*parts))

    return at.select(*keep, "pos", F.posexplode(F.array(*[seed(m) for m in every])).alias("mask", "h")).where("h is not null")


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, least: int = LEAST, block_seeds: int = BLOCK_SEEDS) -> DataFrame:
    """``doc_id, item_id, n_equal, n_aligned``: documents that hold (part of) a test item.

    ``n_equal``: most equal tokens in ``n_aligned`` aligned ones (``window``, or all tokens of a shorter item;
    the same share of them must be equal, so items of one to four tokens must be there as they are). Null texts and those
    without tokens match nothing; rows without ``doc_id`` or ``item_id`` are not judged; very long texts are compared whole,
    in pieces around the hits. Repeated rows count once; rows that
    share a ``doc_id`` are judged one by one and reported under that id. An empty table on either side gives no rows; other
    columns are ignored.
    """
    if 5 * least < 4 * window or window > WINDOW and window % WINDOW:
        raise ValueError("the masks are complete for one substitution in five, in windows up to 20 tokens or multiples of 20")
    items = benchmark.where("item_id is not null").select("item_id", _hashed(F.col("text")).alias("th")).where(F.size("th") > 0).distinct()
    # An item_id may stand for several texts.
    items = cut_lineage(items.select("item_id", F.xxhash64("th").alias("version"), F.least(F.size("th"), F.lit(window)).alias("n"), "th"))
    lengths = sorted(r["n"] for r in items.select(F.least("n", F.lit(WINDOW)).alias("n")).distinct().collect())
    masks = tuple(sorted({m for n in lengths for m in masks_for(n)}))
    rows = docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("sign"), _hashed(F.col("text")).alias("th"))
    kinds = [T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("item_id", items.schema["item_id"].dataType)]
    found = docs.sparkSession.createDataFrame([], T.StructType([*kinds, T.StructField("n_equal", T.IntegerType()), T.StructField("n_aligned", T.IntegerType())]))
    if not lengths:
        return found
    seeds = None
    for n in lengths:
        part = _seeds(items.where(F.least("n", F.lit(WINDOW)) == n), masks_for(n), masks, "item_id", "version", "n")
        seeds = part if seeds is None else seeds.unionByName(part)
    seeds = seeds.withColumnRenamed("pos", "item_pos")
    blocks = -(-seeds.count() // block_seeds)
    for block in range(blocks):
        mine = F.pmod(F.xxhash64("item_id", "version"), F.lit(blocks)) == block
        found = found.union(_matches(rows, masks, items.where(mine), seeds.where(mine), window, least, block_seeds))
    return found.groupBy("doc_id", "item_id").agg(F.max("n_equal").alias("n_equal"), F.max("n_aligned").alias("n_aligned"))


def _matches(rows: DataFrame, masks: tuple[str, ...], items: DataFrame, seeds: DataFrame, window: int, least: int, broadcast_rows: int) -> DataFrame:
    """Leaks of a block of items. Hits of one diagonal within ``window`` positions are one; each meets the piece of its text around it."""
    train = _seeds(rows, masks, masks, "doc_id", "sign")
    diagonal, spot = F.col("pos") - F.col("item_pos"), F.floor(F.col("pos") / window).cast("int")
    hits = train.join(F.broadcast(seeds), ["mask", "h"]).select("doc_id", "sign", "item_id", "version", diagonal.alias("diagonal"), spot.alias("spot")).distinct()
    hits = cut_lineage(hits.withColumn("piece", F.floor(F.col("spot") / SPOTS).cast("int")))
    few = hits.limit(broadcast_rows + 1).count() <= broadcast_rows
    # Windows with a hit begin and end less than a window before and after its spot.
    size, margin = SPOTS * window, window
    cut = F.transform(
        F.sequence(F.lit(0), F.floor((F.size("th") - 1) / size).cast("int")),
        lambda k: F.struct(k.alias("piece"), F.slice("th", F.greatest(k * size - margin, F.lit(0)) + 1, F.lit(size + 2 * margin)).alias("words")),
    )
    hit_rows = hits.select("doc_id", "sign").distinct()
    hit_rows = F.broadcast(hit_rows) if few else hit_rows.hint("shuffle_hash")
    pieces = rows.where(F.size("th") > 0).join(hit_rows, ["doc_id", "sign"], "left_semi").select("doc_id", "sign", F.explode(cut).alias("p")).select("doc_id", "sign", "p.piece", "p.words")
    side = hits if not few else F.broadcast(hits)
    met = pieces.join(side, ["doc_id", "sign", "piece"]).join(F.broadcast(items), ["item_id", "version"])
    return _verify(met, window, least)


def _verify(met: DataFrame, window: int, least: int) -> DataFrame:
    """Compares the aligned tokens around each hit: ``words`` begin a margin before their piece, or with the text."""
    first = F.greatest(F.col("piece") * SPOTS * window - window, F.lit(0))
    begin = F.greatest(F.col("spot") * window - F.col("n") + 1, F.col("diagonal"), F.lit(0))
    end = F.least((F.col("spot") + 1) * window - 1 + F.col("n"), F.col("diagonal") + F.size("th"), first + F.size("words"))
    length = F.greatest(end - begin, F.lit(0))
    theirs = F.slice("th", begin - F.col("diagonal") + 1, length)
    equal = F.zip_with(F.slice("words", begin - first + 1, length), theirs, lambda a, b: (a == b).cast("int"))
    rows = met.select("doc_id", "item_id", F.col("n").alias("n_aligned"), equal.alias("eq")).where(F.size("eq") >= F.col("n_aligned"))
    starts = F.sequence(F.lit(0), F.size("eq") - F.col("n_aligned"))
    sums = F.transform(starts, lambda i: F.aggregate(F.slice("eq", i + 1, F.col("n_aligned")), F.lit(0), lambda a, x: a + x))
    best = rows.select("doc_id", "item_id", F.array_max(sums).alias("n_equal"), "n_aligned")
    return best.where(F.col("n_equal") * window >= F.col("n_aligned") * least)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """The documents without a leak, with all their columns; all rows of a leaking ``doc_id`` go, rows without one stay."""
    bad = leaks(docs, benchmark, **settings).select(F.col("doc_id").alias("leaking_doc_id_")).distinct()
    return docs.join(bad.hint("shuffle_hash"), docs["doc_id"] == bad["leaking_doc_id_"], "left_anti")
