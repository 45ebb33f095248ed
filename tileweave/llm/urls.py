"""Admission of urls: fixed rules, and per host a tree of path templates judged by the rules' verdicts nearby.

A path is cut into segments. Segments that vary (numbers, hashes, dates, long names) are wildcards from the
start; so are the literal segments of a node with too many different children for its urls, unless they carry labels.
Wildcard branches of a node are merged if they carry labels and their block rates do not differ significantly.
A template's purity is the share of blocked urls among those that a rule labels, smoothed towards the template
above it, up to the host and the blocked share of all urls. Templates above a threshold are rejected; it is chosen from
labelled urls whose first segment is held out, so that what it rejects there is nearly all blocked.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tileweave.session import cut_lineage

from .frames import lower_ascii

#: Segments that a template looks at; the rest of a longer path is one wildcard.
LEVELS = 4
#: Most different literal children of a node with fewer than ``CROWD`` urls each; pseudo-count of the template above.
FANOUT, CROWD, PRIOR = 50, 5, 4.0
#: Blocked share that held-out urls above the threshold must have; least purity to reject if no url has a label.
PRECISION, REJECT = 0.95, 0.8
#: Wildcard branches are merged if their block rates differ by less than so many standard errors.
MERGE_Z = 2.0


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the contract.
RULES = (
    Rule("com", "/", "allow"), Rule("example.com", "/en/", "block"), Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"), Rule("net", "/fr/", "block"),
)


def host_of(url):
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[\s\S]*?://([^/?#]*)", 1))


def path_of(url):
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[\s\S]*?://[^/?#]*([^?#]*)", 1)


def match_rule(host, path, rules=RULES):
    """Name and verdict of the longest fitting rule (null: none). A rule fits its host and all subdomains."""
    order = sorted(rules, key=lambda r: (-len(r.name), r.name))

    def fits(r):
        return ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))

    return F.coalesce(*[F.when(fits(r), F.lit(r.name)) for r in order]), F.coalesce(*[F.when(fits(r), F.lit(r.verdict)) for r in order])


def segments_of(path):
    """Up to ``LEVELS`` segments and the rest; numbers, hex strings, dates and long segments as wildcards, suffixes kept apart."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")

    def general(s):
        stem = F.regexp_replace(s, r"\.[A-Za-z][A-Za-z0-9]{0,4}$", "")
        suffix = F.regexp_extract(s, r"(\.[A-Za-z][A-Za-z0-9]{0,4})$", 1)
        varies = stem.rlike(r"^[0-9]+$|^[0-9a-fA-F-]{8,}$|[0-9]{4,}|^.{25,}$")
        return F.when(varies, F.concat(F.lit("*"), lower_ascii(suffix))).otherwise(s)

    head = F.transform(F.slice(parts, 1, LEVELS), general)
    return F.when(F.size(parts) > LEVELS, F.concat(head, F.array(F.lit("**")))).otherwise(head)


def _templates(counts: DataFrame) -> DataFrame:
    """``host, segments`` with ``template``: the segments after wildcards for the children of crowded nodes, level by level.

    A node is crowded if it has more than ``FANOUT`` literal children and fewer than ``CROWD`` urls for each.
    Children with labels that come more than once stay literal there.
    """
    out = counts.withColumn("template", F.array().cast("array<string>"))
    for level in range(LEVELS + 1):
        here = F.get("segments", F.lit(level))
        kids = out.where(here.isNotNull() & ~F.startswith(here, F.lit("*"))).groupBy("host", "template", here.alias("s"))
        kids = kids.agg(F.sum("n_urls").alias("urls"), F.sum("n_labelled").alias("labels"))
        crowd = kids.groupBy("host", "template").agg(F.count("*").alias("children"), F.sum("urls").alias("all"))
        crowd = crowd.where((F.col("children") > FANOUT) & (F.col("all") < CROWD * F.col("children"))).select("host", "template")
        folded = kids.where((F.col("labels") == 0) | (F.col("urls") < 2)).join(crowd, ["host", "template"])
        # Checkpointed, as the plan would grow threefold with each level.
        folded = cut_lineage(folded.select("host", "template", "s", F.lit(True).alias("fold")))
        out = out.withColumn("s", here).join(folded, ["host", "template", "s"], "left").withColumn(
            "template", F.when(F.col("s").isNull(), F.col("template")).otherwise(F.concat("template", F.array(F.when(F.col("fold"), "*").otherwise(F.col("s")))))
        ).drop("fold", "s")
    return out


def _merged(leaves: DataFrame) -> DataFrame:
    """``host, template`` with ``branch``: templates that differ in a last wildcard only and block alike share one.

    A labelled wildcard branch is merged into its node's common one unless its block rate differs from the other
    wildcards' by ``MERGE_Z`` standard errors or more. Literal branches and branches without labels stay apart.
    """
    node = F.slice("template", 1, F.size("template") - 1)
    kinds = leaves.groupBy("host", "template").agg(F.sum("n_labelled").alias("n"), F.sum("n_blocked").alias("b"))
    kinds = kinds.where((F.col("n") > 0) & (F.size("template") > 0) & F.startswith(F.try_element_at("template", F.lit(-1)), F.lit("*")))
    kinds = kinds.withColumn("node", node)
    whole = kinds.groupBy("host", "node").agg(F.sum("n").alias("all_n"), F.sum("b").alias("all_b"))
    rest_n, rest_b = F.col("all_n") - F.col("n"), F.col("all_b") - F.col("b")
    p = (F.col("all_b") + 1) / (F.col("all_n") + 2)
    error = F.sqrt(p * (1 - p) * (1 / F.col("n") + 1 / F.greatest(rest_n, F.lit(1))))
    gap = F.abs(F.col("b") / F.col("n") - rest_b / F.greatest(rest_n, F.lit(1)))
    alike = (rest_n == 0) | (gap < MERGE_Z * error)
    merged = kinds.join(whole, ["host", "node"]).where(alike).select("host", "template", F.concat("node", F.array(F.lit("+"))).alias("common"))
    both = leaves.join(merged, ["host", "template"], "left")
    return both.select("host", "segments", "template", "n_urls", "n_labelled", "n_blocked", F.coalesce("common", "template").alias("branch"))


def _shaped(urls: DataFrame) -> DataFrame:
    """``host, segments, n_labelled, n_blocked, branch`` with ``purity`` of the branch and ``held``, that without the labels of its first segment.

    Purity: (blocked + PRIOR * base) / (labelled + PRIOR), for the host, for the subtree of the first segment
    and for the branch; the base is the purity one level up, for the host the blocked share of all urls.
    """
    blocked, labelled = F.count_if(F.col("verdict") == "block"), F.count("verdict")
    counts = cut_lineage(urls.groupBy("host", "segments").agg(F.count("*").alias("n_urls"), labelled.alias("n_labelled"), blocked.alias("n_blocked")))
    shaped = cut_lineage(_merged(_templates(counts)))
    shaped = shaped.withColumn("top", F.get("branch", F.lit(0)))
    total = shaped.agg(F.sum("n_blocked").alias("b"), F.sum("n_urls").alias("u")).first()
    above = F.lit(((total["b"] or 0) + 0.5) / ((total["u"] or 0) + 1.0))
    held = above
    for keys in (["host"], ["host", "top"], ["host", "branch"]):
        n, b = "n_" + keys[-1], "b_" + keys[-1]
        level = shaped.groupBy(*keys).agg(F.sum("n_labelled").alias(n), F.sum("n_blocked").alias(b))
        level = level.toDF(*[f"k{i}" for i in range(len(keys))], n, b)
        same = [F.col(k).eqNullSafe(F.col(f"k{i}")) for i, k in enumerate(keys)]
        shaped = shaped.join(level, same, "left").drop(*[f"k{i}" for i in range(len(keys))])
        above = (F.col(b) + PRIOR * above) / (F.col(n) + PRIOR)
        if keys == ["host", "top"]:
            held = (F.col("b_host") - F.col("b_top") + PRIOR * held) / (F.col("n_host") - F.col("n_top") + PRIOR)
    return shaped.select("host", "segments", "n_labelled", "n_blocked", "branch", F.round(above, 6).alias("purity"), F.round(held, 6).alias("held"))


def template_purity(urls: DataFrame) -> DataFrame:
    """``host, segments, template, purity`` from one row per url with ``host, segments, verdict`` (null: no rule)."""
    return _named(_shaped(urls))


def _named(shaped: DataFrame) -> DataFrame:
    return shaped.select("host", "segments", F.concat(F.lit("/"), F.array_join("branch", "/")).alias("template"), "purity")


def _threshold(shaped: DataFrame) -> float:
    """The least purity, in steps of 0.01 from 0.5 up, over which ``PRECISION`` of the held-out labelled urls are blocked; 1 if there is none."""
    bins = shaped.where("n_labelled > 0").groupBy(F.floor(F.col("held") * 100).cast("int").alias("bin")).agg(F.sum("n_labelled").alias("n"), F.sum("n_blocked").alias("b"))
    found = sorted(((r["bin"], r["n"], r["b"]) for r in bins.collect()), reverse=True)
    if not found:
        return REJECT
    best, n, b = 1.0, 0, 0
    for low, more, bad in found:
        n, b = n + more, b + bad
        if low >= 50 and b >= PRECISION * n:
            best = low / 100
    return best


def judge(pages: DataFrame, rules=RULES, reject: float | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict, template, purity`` of every row.

    A rule's verdict stands; other urls are blocked if their template's purity is over ``reject`` (None: chosen
    from held-out labelled urls). Null urls and urls without ``://`` have an empty host and path and share a template. Repeated rows count each.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    name, verdict = match_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", segments_of(F.col("path")).alias("segments"), name.alias("rule"), verdict.alias("verdict"))
    shaped = _shaped(rows)
    if reject is None:
        shaped = cut_lineage(shaped)
        reject = _threshold(shaped)
    judged = rows.join(_named(shaped), ["host", "segments"], "left")
    chosen = F.when(F.col("purity") > reject, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("verdict", chosen).alias("verdict"), "template", "purity")
