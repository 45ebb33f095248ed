import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from tileweave.llm import automata, collocations

from .helpers import DOCS, LOWER, clashing


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 0) for i, t, lang in rows], DOCS)


def brute(rows, least=10, share=50, first=2000):
    f, total = {}, Counter()
    for _, text, lang in rows:
        counts = f.setdefault(lang or "und", Counter())
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            w = tuple(re.findall("[^ \t]+", piece))
            total[lang or "und"] += len(w)
            for k in (1, 2, 3):
                counts.update(w[i : i + k] for i in range(len(w) - k + 1))
    out = set()
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in found.items():
            if len(p) == 2 and any(len(q) == 3 and p in (q[:2], q[1:]) and 100 * b >= share * a for q, b in found.items()):
                continue
            score, k = min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), a, counts[p[:k]], counts[p[k:]], score))
        for rank, (_, _, p, a, left, right, score) in enumerate(sorted(rows)[:first], 1):
            out.add((lang, rank, p.decode(), a, left, right, total[lang], score))
    return out


def got(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def corpus(seed, n, words=60):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = "".join("wÖ%d" % min(int(rng.paretovariate(0.7)), words) + rng.choice(["  ", " ", " ", " ", "\t", ", ", ".", "\n"]) for _ in range(rng.randint(0, 90)))
        if i % 3 == 0:
            text += " New York City hall" * rng.randint(1, 3)
        rows.append((i, text, rng.choice(["en", "fr", None])))
    return rows


def test_against_plain_counts(spark):
    rows = corpus(1, 150)
    want = brute(rows)
    assert len(want) > 100 and any(p.count(" ") == 2 for _, _, p, *_ in want)
    assert got(collocations.collocations(table(spark, rows).repartition(3))) == want


def test_many_ranges_and_rounds(spark):
    rows = corpus(2, 120)
    docs = table(spark, rows).repartition(3)
    assert got(collocations.collocations(docs, flush=300, range_words=100, fan=4)) == brute(rows)
    _, ranges = collocations.transducers(docs, flush=300, range_words=100, fan=4)
    assert len(ranges.steps()) >= 3 and len(ranges.edges) > 16


def test_one_hot_word_is_cut(spark):
    rng = random.Random(3)
    rows = [(i, " ".join("the" if rng.random() < 0.7 else f"x{rng.randint(0, 5)}" for _ in range(60)), "en") for i in range(60)]
    assert got(collocations.collocations(table(spark, rows), flush=200, range_words=60, fan=8, first=20)) == brute(rows, first=20)


def test_transducer_round_trip_shares_states():
    rng = np.random.default_rng(4)
    g, h2, h3 = (rng.integers(1, k, 3000).astype(np.uint64) for k in (40, 9, 5))
    h3[rng.random(3000) < 0.2] = 0
    h2[rng.random(3000) < 0.1] = 0
    h3[h2 == 0] = 0
    paths = automata.condense([automata.Paths(g, h2, h3, np.ones(3000, np.int64))])
    firsts = np.unique(g)
    names = automata.Names(firsts, firsts + np.uint64(7), pa.array([b"w%d" % x for x in firsts], pa.large_binary()), pa.array(["en"] * len(firsts), pa.large_string()))
    t = automata.Transducer(automata.encode(paths, names))
    back = automata.condense([t.paths()])
    assert all((getattr(back, c) == getattr(paths, c)).all() for c in ("g", "h2", "h3", "n"))
    assert t.names.word.equals(names.word) and (t.names.h == names.h).all() and t.names.lang.to_pylist() == ["en"] * len(firsts)
    asked = [(int(a), int(b)) for a in range(0, 42) for b in range(0, 11)]
    weight, _ = t.weigh(*(np.array(x, np.uint64) for x in zip(*asked)))
    for (a, b), w in zip(asked, weight):
        assert w == paths.n[(paths.g == a) & ((paths.h2 == b) | (b == 0))].sum()
    same = automata.Paths(*(np.array(x, np.uint64) for x in ([1, 1, 2, 2, 3], [5, 6, 5, 6, 5], [8, 8, 8, 8, 9])), np.ones(5, np.int64))
    shared = automata.Transducer(automata.encode(same, automata.Names(np.arange(1, 4, dtype=np.uint64), np.arange(1, 4, dtype=np.uint64), pa.array([b"a", b"b", b"c"], pa.large_binary()), pa.array(["en"] * 3, pa.large_string()))))
    assert len(shared.length2) == 2 and len(shared.length3) == 2


def test_edges(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, " .\n", None), (4, "a b " * 20_000, None), (5, "a b", "und"), (None, "c d\n" * 12, "en"), (None, "c d\n" * 12, "en"), (7, "Ä B\tß" + "! é f" * 10, "fr")]
    assert got(collocations.collocations(clashing(table(spark, rows)))) == brute(rows)
    assert collocations.collocations(table(spark, [])).count() == 0
    assert collocations.collocations(table(spark, [(1, None, None)])).count() == 0


def test_scores_are_exact(spark):
    a, left, right = 3_000_000_000_007, 5_000_000_000_011, 7_000_000_000_013
    df = spark.createDataFrame([(a, left, right)], "a long, l long, r long")
    assert df.select(collocations._score(df.a, df.l, df.r)).first()[0] == 10**6 * a * a // (left * right)
