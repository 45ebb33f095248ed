import math
import random
import re
from collections import Counter

from tileweave.llm import ranking
from tileweave.session import cut_lineage

from .helpers import LOWER, clashing, documents

ITEMS = "item_id bigint, text string"
TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute(docs, items, k=10):
    bags = [(d, Counter(TERM.findall((t or "").translate(LOWER)))) for d, t in docs]
    bags = [(d, b, sum(b.values())) for d, b in bags if b]
    n_all, terms_all = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    merged = {}
    for i, t in items:
        if i is not None:
            merged.setdefault(i, set()).update(TERM.findall((t or "").translate(LOWER)))
    out = set()
    for i, terms in merged.items():
        scored = []
        for row, (d, b, n) in enumerate(bags):
            m = 10 + (90 * n * n_all) // terms_all
            s = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 8 * m)) for t in terms if t in b)
            if s > 0:
                scored.append((-s, d is not None, d or 0, row))
        for rank, (s, known, d, _) in enumerate(sorted(scored)[:k], 1):
            out.add((i, rank, d if known else None, -s))
    return out


def prose(rng, n):
    return " ".join("W%d" % min(int(rng.paretovariate(0.6)), 3000) for _ in range(n))


def found(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows)) and df.columns == ["item_id", "rank", "doc_id", "score"]
    return set(rows)


def test_against_all_scores(spark):
    rng = random.Random(4)
    docs = [(i, prose(rng, rng.randint(1, 80))) for i in range(300)]
    docs += [(300 + i, docs[i % 5][1]) for i in range(40)]
    items = [(i, docs[7 * i][1][:120] + " " + prose(rng, 6)) for i in range(25)] + [(90, "w1 w2"), (91, "w1"), (92, "zzz"), (93, "..")]
    want = brute(docs, items)
    rows, queries = documents(spark, docs).repartition(3), spark.createDataFrame(items, ITEMS)
    assert found(ranking.search(rows, queries)) == want
    assert found(ranking.search(rows, queries, block_docs=16, group_terms=60, band=2)) == want


def test_creation_stops_early_and_survivors_are_exact(spark):
    rng = random.Random(5)
    rare = " ".join(f"rare{i}" for i in range(12))
    docs = [(i, prose(rng, 40) + (" " + rare if i % 25 == 0 else "")) for i in range(400)]
    items = [(1, rare + " w1 w2 w3")]
    wanted = cut_lineage(ranking.item_terms(spark.createDataFrame(items, ITEMS)))
    blocks = ranking.index(documents(spark, docs), ranking._sieve(wanted))
    n_all, terms_all = blocks.selectExpr("sum(n_docs)", "sum(n_terms)").first()
    stats = wanted.join(ranking._statistics(blocks, n_all, terms_all), "term").selectExpr("*", f"cast(floor(1000.0 * ln({2 * n_all + 2} / (2 * df + 1))) as bigint) as weight")
    parts = ranking._group(stats.collect(), 8)
    ranking.stopping_points(blocks, parts, 10, n_all, terms_all)
    assert parts[0].stop == 12 and len(parts[0].term) == 15
    assert found(ranking.search(documents(spark, docs), spark.createDataFrame(items, ITEMS))) == brute(docs, items)


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, "... !"), (4, "Été x1 ÉTÉ"), (5, "b " * 50_000 + "c"), (6, "b c"), (None, "b c"), (6, "b c"), (7, "c\x00b\x7fd")]
    items = [(1, "b c"), (1, "été"), (None, "b"), (2, None), (3, ""), (4, "É é c"), (5, "d")]
    rows, queries = clashing(documents(spark, docs)), spark.createDataFrame(items, ITEMS).selectExpr("*", "'x' as term", "1 as rank", "'y' as df")
    got = sorted((tuple(r) for r in ranking.search(rows, queries).collect()), key=repr)
    assert set(got) == brute(docs, items) and len(got) == len([r for r in got])
    assert [r[1] for r in got if r[0] == 1] == sorted(r[1] for r in got if r[0] == 1)
    assert ranking.search(documents(spark, []), queries).count() == 0
    assert ranking.search(rows, spark.createDataFrame([], ITEMS)).count() == 0
    assert ranking.search(documents(spark, [(1, None)]), queries).count() == 0
