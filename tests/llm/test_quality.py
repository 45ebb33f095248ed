import random

import numpy as np
import pyarrow as pa

from tileweave.llm import quality

from .helpers import clashing, counts, documents

NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def odd_texts(seed, n):
    rng = random.Random(seed)
    pieces = ["a", "b", "é", "##", " ", "  ", "\n", "\t", "\r\n", "x|y", "the cat", "\x0b", "\x85", " ", "Ab", "\n\n", "a b c d e f g h", "a b c d e f g h\n"]
    return ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_counts_against_plain_loops():
    texts = odd_texts(1, 600) + [None, "", "w " * 5000, "line\n" * 3000, "é" * 100_000]
    got = quality.count_batch(pa.array(texts))
    for i, t in enumerate(texts):
        assert tuple(int(got[c][i]) for c in NAMES) == counts(t), repr(t)[:200]


def test_chunk_borders_do_not_show(monkeypatch):
    texts = odd_texts(2, 80)
    whole = quality.count_batch(pa.array(texts))
    monkeypatch.setattr("tileweave.llm.quality.chunks", lambda c: __import__("tileweave.llm.tokens", fromlist=["chunks"]).chunks(c, limit=40))
    small = quality.count_batch(pa.array(texts))
    assert all(np.array_equal(whole[c], small[c]) for c in quality.COUNTS)


def prose(rng, n):
    return " ".join("".join(rng.choice("aeiourstln") for _ in range(rng.randint(2, 8))) + ("." if rng.random() < 0.1 else "") for _ in range(n))


def test_outliers_go_and_prose_stays(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.randint(25, 600))) for i in range(400)]
    rows += [(1000 + i, " ".join(w + "%%%" for w in prose(rng, 120).split())) for i in range(40)]
    rows += [(2000, "too short"), (2001, "again and again and again ok " * 20)]
    kept = {r.doc_id: r for r in quality.judge(documents(spark, rows)).collect()}
    assert sum(kept[i].kept for i in range(400)) >= 398
    assert not any(kept[1000 + i].kept for i in range(40))
    assert kept[2000].base_failed and kept[2001].base_failed and not kept[2001].kept


def test_edges(spark):
    rng = random.Random(4)
    good = prose(rng, 200)
    rows = [(1, good), (1, good), (2, None), (3, ""), (None, good), (4, prose(rng, 20_000))]
    docs = clashing(documents(spark, rows)).selectExpr("* except(lang)", "if(doc_id = 4, null, lang) as lang")
    judged = quality.judge(docs).collect()
    assert sorted(((r.doc_id, r.kept) for r in judged), key=repr) == sorted([(1, True), (1, True), (2, False), (3, False), (None, True), (4, True)], key=repr)
    left = quality.quality_filter(docs)
    assert sorted((r.doc_id for r in left.collect()), key=repr) == sorted([1, 1, None, 4], key=repr) and left.columns == docs.columns
    assert quality.judge(documents(spark, [])).count() == 0 and quality.quality_filter(documents(spark, [])).count() == 0


def test_concentration_step_matches_numpy(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 2)) @ np.array([[1.0, 0.4], [0.0, 0.7]])
    x[:20] += 8
    fit = spark.createDataFrame([("g", float(a), float(b)) for a, b in x], "grp string, x0 double, x1 double")
    start = spark.createDataFrame([("g", [0.0, 0.0], [1.0, 0.0, 0.0, 1.0])], "grp string, loc array<double>, inv array<double>")
    got = quality._concentrate(fit, start, ["x0", "x1"]).first()
    d = (x**2).sum(1)
    level = np.sort(np.floor(np.log(d) / quality.BIN))[int(np.ceil(len(d) * quality.COVERAGE)) - 1]
    near = x[np.floor(np.log(d) / quality.BIN) <= level]
    assert np.allclose(got["loc"], near.mean(0)) and np.allclose(np.linalg.inv(np.array(got["inv"]).reshape(2, 2)), np.cov(near.T, bias=True) + quality.FLOOR**2 * np.eye(2))


def test_distances_have_a_term_for_each_pair(spark):
    rng = np.random.default_rng(6)
    xs, x = ["x0", "x1", "x2"], rng.normal(size=(300, 3)) @ np.array([[1, 0.5, 0], [0, 1, 0.3], [0, 0, 1]])
    fit = spark.createDataFrame([("g", *map(float, r)) for r in x], "grp string, x0 double, x1 double, x2 double")
    model = quality._start(fit, xs)
    for step in (model, quality._concentrate(fit, model, xs)):
        (m,) = quality._folded(step, 3).collect()
        # The driver compiles a step's terms; with one for each place of the matrix its memory came near the limit.
        assert len(m.inv) == 6
        a, b, c, d, e, f = m.inv
        inv = np.array([[a, b / 2, c / 2], [b / 2, d, e / 2], [c / 2, e / 2, f]])
        got = {r.x0: r.d2 for r in quality._with_distance(fit, step, xs).collect()}
        assert all(abs(got[r[0]] - (r - m.loc) @ inv @ (r - m.loc)) < 1e-9 * (1 + got[r[0]]) for r in x)
