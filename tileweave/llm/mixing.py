"""Mixing of a corpus to target weights with soft domain membership.

A naive Bayes classifier over distinct words, fitted on labelled documents, gives each document a posterior
over domains. Documents get rates (expected copies, 0 or more) so that the expected tokens of each domain,
``sum(rate * tokens * posterior)``, meet the target shares of the corpus' token total. The rates minimise
the squared misses by projected gradient steps from rate 1; a step needs one small aggregate, and the rates
themselves never leave the executors.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from tileweave.session import cut_lineage

from .frames import words_of

#: Domains in order: good prose, poor prose, toxic text. Shares of the mixture.
DOMAINS = ("good", "poor", "toxic")
TARGETS = (0.90, 0.08, 0.02)
#: Bounds of the classifier: labelled documents it is fitted on, and words it keeps (both broadcastable).
TRAIN_DOCS, VOCABULARY, MIN_DOCS = 4000, 4000, 4
#: A word's rate in a domain is shrunk towards its rate in all by so many documents.
SHRINK = 20.0
STEPS, TOLERANCE = 60, 1e-4


def domain(quality, toxic):
    return F.when(toxic == 1, 2).when(quality == 0, 1).when(quality == 1, 0)


def fit_words(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, vocabulary: int = VOCABULARY, min_docs: int = MIN_DOCS) -> DataFrame:
    """``word, w0, w1, w2``: log-likelihoods of a word's presence per domain, relative to good prose; ``''`` holds the priors.

    Fitted on the ``train_docs`` labelled documents whose ids hash lowest. Of words in ``min_docs`` or more of
    them, the ``vocabulary`` words that tell the domains apart best are kept.
    """
    known = labels.groupBy("doc_id").agg(domain(F.min("quality"), F.max("toxic")).alias("d")).where("d is not null and doc_id is not null")
    known = docs.select("doc_id").distinct().join(known, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("d", F.explode(F.array_union(F.array(F.lit("")), words_of(F.col("text")))).alias("word"))
    per = [F.count_if(F.col("d") == k).alias(f"n{k}") for k in range(len(DOMAINS))]
    counts = rows.groupBy("word").agg(*per)
    totals = counts.where("word = ''").select(*[F.col(f"n{k}").alias(f"t{k}") for k in range(len(DOMAINS))])
    scored = counts.join(F.broadcast(totals)).where((F.col("n0") + F.col("n1") + F.col("n2") >= min_docs) | (F.col("word") == ""))
    usual = (F.col("n0") + F.col("n1") + F.col("n2") + 0.5) / (F.col("t0") + F.col("t1") + F.col("t2") + 1.0)
    rate = [F.log((F.col(f"n{k}") + SHRINK * usual) / (F.col(f"t{k}") + SHRINK)) for k in range(len(DOMAINS))]
    prior = [F.log(F.col(f"t{k}") + 1.0) for k in range(len(DOMAINS))]
    weights = [F.when(F.col("word") == "", p - prior[0]).otherwise(r - rate[0]).alias(f"w{k}") for k, (r, p) in enumerate(zip(rate, prior))]
    spread = (F.greatest(*rate) - F.least(*rate)) * F.sqrt(F.col("n0") + F.col("n1") + F.col("n2"))
    return scored.select("word", *weights, spread.alias("gain")).orderBy((F.col("word") != ""), F.desc("gain"), "word").limit(vocabulary + 1).drop("gain")


def posteriors(docs: DataFrame, model: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, p0, p1, p2`` of every document.

    Rows that repeat a ``doc_id`` are one document with the largest of their token counts and the words of
    all; null ids are one document too. A text without known words gets the prior; with an empty model the
    posterior is uniform.
    """
    words = docs.select("doc_id", words_of(F.col("text")).alias("words"))
    each = words.select("doc_id", F.size("words").cast("long").alias("n"), F.explode(F.array_union(F.array(F.lit("")), F.col("words"))).alias("word"))
    known = each.join(F.broadcast(model.withColumn("hit", F.lit(1))), "word", "left").where("hit is not null or word = ''")
    sums = known.groupBy("doc_id").agg(F.max("n").alias("n_tokens"), *[F.sum(F.coalesce(f"w{k}", F.lit(0.0))).alias(f"s{k}") for k in range(len(DOMAINS))])
    top = F.greatest("s0", "s1", "s2")
    odds = [F.exp(F.col(f"s{k}") - top) for k in range(len(DOMAINS))]
    return sums.select("doc_id", "n_tokens", *[F.round(o / sum(odds[1:], odds[0]), 6).alias(f"p{k}") for k, o in enumerate(odds)])


def _largest(m: list[list[float]]) -> float:
    v = [1.0] * len(m)
    for _ in range(60):
        u = [sum(a * b for a, b in zip(row, v)) for row in m]
        norm = math.sqrt(sum(x * x for x in u)) or 1.0
        v = [x / norm for x in u]
    return norm


def fit_rates(members: DataFrame, targets=TARGETS, steps: int = STEPS, tolerance: float = TOLERANCE) -> DataFrame:
    """``members`` with ``rate``: how often to use each document.

    Each miss counts relative to the domain's present share, which makes the Hessian close to the identity;
    the step starts at the inverse of its largest eigenvalue, grows while the misses shrink and is cut when
    they do not. Stops when every domain is within ``tolerance`` of its
    target (as a share of all tokens) or after ``steps`` steps. A domain without mass cannot be met; its share
    stays open. Documents without tokens keep a rate like any other of their posterior.
    """
    n = range(len(targets))
    members = cut_lineage(members)
    weight = F.col("n_tokens").cast("double")
    first = members.agg(
        F.sum(weight).alias("t"), *[F.sum(weight * F.col(f"p{k}")).alias(f"s{k}") for k in n],
        *[F.sum(weight * F.col(f"p{i}") * F.col(f"p{j}")).alias(f"g{i}{j}") for i in n for j in n],
    ).first()
    rate = F.lit(1.0)
    if first["t"]:
        total, share = first["t"], [first[f"s{k}"] / first["t"] for k in n]
        inverse = [1 / s if s > 1e-9 else 0.0 for s in share]
        gram = [[first[f"g{i}{j}"] / total * math.sqrt(inverse[i] * inverse[j]) for j in n] for i in n]
        step = 1 / max(_largest(gram), 1e-9)
        now, best = share, None
        for _ in range(steps):
            miss = [(a - b) * w for a, b, w in zip(now, targets, inverse)]
            far = sum(m * m / w for m, w in zip(miss, inverse) if w)
            if best is None or far < best[0]:
                step, best = step * 1.5 if best else step, (far, rate, miss)
            else:
                step /= 3
            if max(abs(m) / w if w else 0.0 for m, w in zip(best[2], inverse)) <= tolerance:
                break
            rate = F.greatest(F.lit(0.0), best[1] - sum((F.col(f"p{i}") * (step * best[2][i]) for i in n), F.lit(0.0)))
            row = members.agg(*[F.sum(rate * weight * F.col(f"p{i}")).alias(f"s{i}") for i in n]).first()
            now = [row[f"s{i}"] / total for i in n]
        rate = best[1] if best else rate
    return members.withColumn("rate", F.round(rate, 5))


def mix(docs: DataFrame, labels: DataFrame, targets=TARGETS) -> DataFrame:
    """``doc_id, n_tokens, p_good, p_poor, p_toxic, rate`` of every document. Empty tables give an empty result or uniform posteriors."""
    docs = docs.select("doc_id", "text")
    model = cut_lineage(fit_words(docs, labels))
    rated = fit_rates(posteriors(docs, model), targets)
    return rated.select("doc_id", "n_tokens", *[F.col(f"p{k}").alias(f"p_{name}") for k, name in enumerate(DOMAINS)], "rate")
