"""Rule statistics of texts, and robust multivariate outliers among them.

The base rules are counts of words, symbols, repeated lines and repeated word windows. On top, statistic
vectors are compared with what is usual for their language and source: location and scatter are minimum
covariance determinant estimates, and a text is rejected by its Mahalanobis distance. Concentration steps
run as aggregations over all texts: a step keeps the ``COVERAGE`` share of a group with the smallest
distances, the cut being read from a histogram of log distances that is exact to a fraction of a percent.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from tileweave.session import cut_lineage

from .frames import fresh
from .tokens import chunks, repeats, shingles

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_points", "n_upper", "n_distinct")
SYMBOLS = b"#*$%&|<>"
REPEAT_SPAN, MIN_WORDS, MAX_REPEAT_PERCENT = 8, 20, 30

#: Rates in a statistic vector: numerator, denominator. The logs of the word counts below complete it.
RATES = (("n_symbols", "n_words"), ("n_points", "n_words"), ("n_upper", "n_words"), ("word_chars", "n_words"), ("n_dup_lines", "n_lines"), ("n_repeat_words", "n_words"))
LOGS = ("n_words", "n_distinct")
#: A rate is shrunk towards the corpus' by so many words; differences below FLOOR (in logs) are never unusual.
PRIOR_WORDS, FLOOR = 60.0, 0.12
#: Concentration: share of a group that defines the usual, steps, smallest group, width of histogram bins.
COVERAGE, STEPS, MIN_GROUP, BIN = 0.75, 4, 200, 0.005
#: With fewer texts than this in the last pool nothing is unusual.
LEAST_GROUP = 40
#: Square of the Mahalanobis distance above which a text is rejected.
CUT = 90.0


def count_batch(column) -> dict[str, np.ndarray]:
    """The counts of each text of an Arrow string column."""
    parts = {c: [] for c in COUNTS}
    for _, t in chunks(column):
        start, end, text = t.words()
        lines = t.lines()
        solid = np.concatenate([[0], np.cumsum(~t.white)])
        full = solid[lines[1]] > solid[lines[0]]
        _, later = repeats(t.hashes(lines[0], lines[1]), lines[2])
        h = t.hashes(start, end)
        _, seen = repeats(h, text)
        windows, first, owner = shingles(h, text, REPEAT_SPAN)
        twice = first[repeats(windows, owner)[0]]
        cover = np.zeros(len(start) + 1, np.int64)
        np.add.at(cover, twice, 1)
        np.add.at(cover, twice + REPEAT_SPAN, -1)
        covered = np.cumsum(cover[:-1]) > 0
        d, per = t.data, lambda owners, keep: np.bincount(owners[keep], minlength=t.n)
        letter = (d & 0xC0) != 0x80
        found = {
            "n_words": np.bincount(text, minlength=t.n), "word_chars": t.count(letter & ~t.white), "n_symbols": t.count(np.isin(d, np.frombuffer(SYMBOLS, np.uint8))),
            "n_dup_lines": per(lines[2], full & later), "n_repeat_words": per(text, covered), "n_lines": per(lines[2], full),
            "n_points": t.count(np.isin(d, np.frombuffer(b".,;:!?", np.uint8))), "n_upper": t.count((d >= 0x41) & (d <= 0x5A)),
            "n_distinct": per(text, ~seen),
        }
        for name, values in found.items():
            parts[name].append(values)
    return {c: np.concatenate(v).astype(np.int64) if v else np.empty(0, np.int64) for c, v in parts.items()}


def statistics(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, source`` and the counts of every text; a null text counts as empty."""
    kinds = {f.name: f.dataType for f in docs.schema}
    schema = T.StructType([T.StructField(c, kinds[c]) for c in ("doc_id", "lang", "source")] + [T.StructField(c, T.LongType()) for c in COUNTS])

    def run(batches):
        for b in batches:
            counts = count_batch(b.column(3))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *[pa.array(counts[c]) for c in COUNTS]], names=["doc_id", "lang", "source", *COUNTS])

    return docs.select("doc_id", "lang", "source", "text").mapInArrow(run, schema)


def base_failed():
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _vectors(stats: DataFrame) -> tuple[DataFrame, list[str]]:
    """Adds the statistic vector ``x0..`` of each text: logs of shrunk rates and of word counts."""
    totals = stats.agg(*[F.sum(c).alias(c) for c in COUNTS]).first()
    out = []
    for top, under in RATES:
        usual = ((totals[top] or 0) + 1.0) / ((totals[under] or 0) + 1.0)
        out.append(F.log((F.col(top) + F.lit(PRIOR_WORDS * usual)) / (F.col(under) + F.lit(PRIOR_WORDS)) + 0.05))
    out += [F.log(F.col(c) + 1.0) for c in LOGS]
    xs = [f"x{k}" for k in range(len(out))]
    return stats.select("*", *[x.alias(name) for x, name in zip(out, xs)]), xs


def _grouped(rows: DataFrame) -> DataFrame:
    """Adds ``grp``: language and source; small groups of a language are pooled, small pools over all languages."""
    lang = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("-"))
    source = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-"))
    rows = rows.withColumn("wide", lang).withColumn("narrow", F.concat(lang, F.lit("\x01"), source))
    sizes = rows.where(~base_failed()).groupBy("narrow").agg(F.count("*").alias("n"), F.min("wide").alias("wide"))
    pools = sizes.where(F.col("n") < MIN_GROUP).groupBy("wide").agg(F.sum("n").alias("pool"))
    named = sizes.join(pools, "wide", "left").select(
        "narrow", F.when(F.col("n") >= MIN_GROUP, F.col("narrow")).when(F.col("pool") >= MIN_GROUP, F.col("wide")).otherwise("").alias("grp")
    )
    return rows.join(named, "narrow", "left").drop("narrow", "wide").withColumn("grp", F.coalesce("grp", F.lit("")))


def _level(rows: DataFrame, keys: list[str], value: str, share: float) -> DataFrame:
    """``keys, level, rows``: the bin (``floor(value / BIN)``) in which the share of a group's rows is reached, and their number."""
    bins = rows.groupBy(*keys, F.floor(F.col(value) / BIN).alias("bin")).agg(F.count("*").alias("n"))
    so_far = Window.partitionBy(*keys).orderBy("bin")
    run = bins.select(*keys, "bin", F.sum("n").over(so_far).alias("run"), F.sum("n").over(Window.partitionBy(*keys)).alias("all"))
    return run.where(F.col("run") >= F.ceil(F.col("all") * share)).groupBy(*keys).agg(F.min("bin").alias("level"), F.max("all").alias("rows"))


def _start(fit: DataFrame, xs: list[str]) -> DataFrame:
    """``grp, loc, inv``: median and median absolute deviation of each coordinate."""
    long = fit.select("grp", F.posexplode(F.array(*xs)).alias("k", "x"))
    mid = _level(long, ["grp", "k"], "x", 0.5).select("grp", "k", ((F.col("level") + 0.5) * BIN).alias("mid"))
    off = long.join(mid, ["grp", "k"]).select("grp", "k", F.abs(F.col("x") - F.col("mid")).alias("off"))
    mad = _level(off, ["grp", "k"], "off", 0.5).select("grp", "k", ((F.col("level") + 0.5) * BIN * 1.4826).alias("mad"))
    each = mid.join(mad, ["grp", "k"]).groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("k", "mid", "mad"))).alias("v"))

    def row(a):
        return F.transform(F.sequence(F.lit(0), F.lit(len(xs) - 1)), lambda j: F.when(a["k"] == j, 1 / (a["mad"] * a["mad"] + FLOOR * FLOOR)).otherwise(0.0))

    return each.select("grp", F.transform("v", lambda a: a["mid"]).alias("loc"), F.flatten(F.transform("v", row)).alias("inv"))


def _folded(model: DataFrame, p: int) -> DataFrame:
    """``inv`` as its upper triangle by rows, the lower one added: half the terms make half the code that the driver compiles for each step."""
    at = [(i * p + j, j * p + i) for i in range(p) for j in range(i, p)]
    one, two = (F.array(*[F.lit(pair[k]) for pair in at]) for k in (0, 1))
    fold = F.zip_with(one, two, lambda a, b: F.when(a == b, F.get("inv", a)).otherwise(F.get("inv", a) + F.get("inv", b)))
    return model.withColumn("inv", fold)


def _with_distance(rows: DataFrame, model: DataFrame, xs: list[str]) -> DataFrame:
    """Adds ``d2``, the squared Mahalanobis distance from the group's estimate, and its log."""
    joined, p = rows.join(_folded(model, len(xs)), "grp", "left"), range(len(xs))
    joined = joined.select("*", *[(F.col(x) - F.get("loc", F.lit(i))).alias(f"e{i}") for i, x in enumerate(xs)])
    pairs = [(i, j) for i in p for j in p if i <= j]
    total = sum((F.col(f"e{i}") * F.col(f"e{j}") * F.get("inv", F.lit(k)) for k, (i, j) in enumerate(pairs)), F.lit(0.0))
    return joined.withColumn("d2", total).drop("loc", "inv", *[f"e{i}" for i in p]).withColumn("log_d2", F.log(F.greatest("d2", F.lit(1e-9))))


def _concentrate(fit: DataFrame, model: DataFrame, xs: list[str]) -> DataFrame:
    """One concentration step: location and inverse scatter of the closest ``COVERAGE`` of each group."""
    p, near = len(xs), _with_distance(fit, model, xs)
    near = near.join(_level(near, ["grp"], "log_d2", COVERAGE).drop("rows"), "grp").where(F.floor(F.col("log_d2") / BIN) <= F.col("level"))
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    moments = near.groupBy("grp").agg(
        F.count("*").alias("n"), *[F.sum(x).alias(f"s{i}") for i, x in enumerate(xs)], *[F.sum(F.col(xs[i]) * F.col(xs[j])).alias(f"q{i}_{j}") for i, j in pairs]
    )

    def invert(frames):
        for m in frames:
            rows = []
            for r in m.to_dict("records"):
                mean = np.array([r[f"s{i}"] for i in range(p)]) / r["n"]
                cov = np.zeros((p, p))
                for i, j in pairs:
                    cov[i, j] = cov[j, i] = r[f"q{i}_{j}"] / r["n"] - mean[i] * mean[j]
                rows.append((r["grp"], mean.tolist(), np.linalg.inv(cov + FLOOR**2 * np.eye(p)).ravel().tolist()))
            yield pd.DataFrame(rows, columns=["grp", "loc", "inv"])

    return moments.mapInPandas(invert, "grp string, loc array<double>, inv array<double>")


def judge(docs: DataFrame, cut: float = CUT, steps: int = STEPS) -> DataFrame:
    """The counts of every text with ``base_failed``, ``distance`` (squared, robust) and ``kept``.

    Texts that fail the base rules take no part in the estimates. Groups of fewer than ``MIN_GROUP`` other
    texts are pooled; pools of fewer than ``LEAST_GROUP`` reject nothing. Distances are scaled so that a group's ``COVERAGE`` quantile is at most that of a normal
    distribution. Null texts count as empty (and fail); null languages or sources are values of their own;
    repeated rows are judged alike, each counting; an empty table gives an empty result.
    """
    rows, xs = _vectors(cut_lineage(statistics(docs)))
    rows = cut_lineage(_grouped(rows))
    fit = rows.where(~base_failed()).select("grp", *xs)
    model = cut_lineage(_start(fit, xs))
    for _ in range(steps):
        model = cut_lineage(_concentrate(fit, model, xs))
    p, z = len(xs), NormalDist().inv_cdf(COVERAGE)
    normal = p * (1 - 2 / (9 * p) + z * math.sqrt(2 / (9 * p))) ** 3
    level = _level(_with_distance(fit, model, xs), ["grp"], "log_d2", COVERAGE)
    factor = F.least(F.lit(normal) / F.exp((F.col("level") + 0.5) * BIN), F.lit(1.0))
    scale = cut_lineage(level.select("grp", F.when(F.col("rows") >= LEAST_GROUP, factor).otherwise(0.0).alias("scale")))
    judged = _with_distance(rows, model, xs).join(scale, "grp", "left")
    distance = F.round(F.coalesce(F.col("d2") * F.col("scale"), F.lit(0.0)), 4)
    return judged.select(
        "doc_id", "lang", "source", *COUNTS, base_failed().alias("base_failed"), distance.alias("distance"),
        (~base_failed() & (distance <= cut)).alias("kept"),
    )


def quality_filter(docs: DataFrame, cut: float = CUT) -> DataFrame:
    """The documents that pass, with all their columns.

    Rows that share a ``doc_id`` stay if one of them passes; rows without ``doc_id`` are judged as one document.
    """
    (key,) = fresh(docs, "passed_doc_id")
    passed = judge(docs, cut).where("kept").select(F.col("doc_id").alias(key)).distinct()
    return docs.join(passed.hint("shuffle_hash"), docs["doc_id"].eqNullSafe(F.col(key)), "left_semi")
