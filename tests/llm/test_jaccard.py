import random

import pytest

from tileweave.llm import jaccard
from tileweave.llm.components import components

from .helpers import clashing, classes, documents


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def corpus(seed, groups=12, each=6):
    """Groups of copies with more and more substituted words, documents that share a passage, and loners."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(3000)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    texts = []
    for g in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 9, 30, 80, 200]))]
        for k in range(each):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(words) // 40))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(" ".join(w.upper() if rng.random() < 0.1 else w for w in words))
    for _ in range(25):
        texts.append(" ".join([rng.choice(vocabulary) for _ in range(rng.randint(5, 60))] + passage))
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("k,num,hot", [(4, 85, 24), (4, 85, 2), (5, 80, 3)])
def test_against_all_pairs(spark, monkeypatch, k, num, hot):
    monkeypatch.setattr(jaccard, "HOT", hot)
    texts = corpus(hot)
    assert result(jaccard.jaccard_join(documents(spark, texts), k, num)) == classes(texts, k, num, 100)


def test_crowded_region_whose_pivots_do_not_link_everything(spark, monkeypatch):
    """A chain: each document is linked with its neighbours only, and all share common shingles."""
    monkeypatch.setattr(jaccard, "HOT", 2)
    monkeypatch.setattr(jaccard, "PIVOTS", 1)
    body = [f"b{k}" for k in range(60)]
    texts = [(i, " ".join(body[i:] + [f"t{k}" for k in range(i)])) for i in range(0, 30, 2)]
    texts += [(100 + i, " ".join(body[:30] + [f"u{i}_{k}" for k in range(30)])) for i in range(10)]
    got = result(jaccard.jaccard_join(documents(spark, texts), 1, 85))
    assert got == classes(texts, 1, 85, 100) and got[28][1] == 0


def test_threshold_is_exact(spark):
    words = [f"x{k}" for k in range(200)]
    for share, linked in ((17, True), (16, False)):
        texts = [(1, " ".join(words[:20])), (2, " ".join(words[:share] + words[100 : 100 + 20 - share]))]
        texts[1] = (2, " ".join(words[:share]))
        assert (result(jaccard.jaccard_join(documents(spark, texts), 1, 85))[2][1] == 1) is linked


def test_edges(spark):
    long = " ".join(f"v{k}" for k in range(30_000))
    rows = [(4, "Same Text here now"), (3, "same text HERE now"), (9, None), (8, ""), (7, " \n "), (None, "same text here now"), (6, "one"), (5, "ONE"), (2, long), (1, long + " end"), (3, "same text here now")]
    docs = clashing(documents(spark, rows))
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_join(docs).collect()), key=repr)
    want = [(4, 1, 3), (3, 1, 3), (3, 1, 3), (9, 0, 9), (8, 0, 8), (7, 0, 7), (None, 1, None), (6, 1, 5), (5, 1, 5), (2, 29_997, 1), (1, 29_998, 1)]
    assert got == sorted(want, key=repr)
    left = jaccard.keep_one(docs)
    assert sorted((r.doc_id for r in left.collect()), key=repr) == sorted([3, 3, 9, 8, 7, None, 5, 1], key=repr) and left.columns == docs.columns
    assert jaccard.jaccard_join(documents(spark, [])).count() == 0


def test_components_of_a_long_path_and_a_star(spark):
    links = [(k, k + 1) for k in range(100, 160)] + [(5, k) for k in range(200, 230)] + [(7, 7), (160, 100)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "x bigint, y bigint")).collect()}
    assert got == {**{k: 100 for k in range(100, 161)}, 5: 5, **{k: 5 for k in range(200, 230)}}
