import random
import zlib

import pyarrow as pa

from tileweave.llm import toxicity

from .helpers import clashing, documents

LABELS = "doc_id bigint, toxic int"
BAD = ("idiot", "moron", "scumbag", "pathetic")


def corpus(n, seed, twist=False):
    rng = random.Random(seed)
    texts, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(20, 200))]
        bad = i % 4 == 0
        if bad:
            for _ in range(2):
                w = rng.choice(BAD)
                if twist:
                    k = rng.randint(2, len(w) - 1)
                    w = w[:k] + w[k - 1] + w[k:] + rng.choice(["", "s", "ic"])
                words[rng.randrange(len(words))] = w
        texts.append(" ".join(words))
        labels.append(int(bad))
    return texts, labels


def accuracy(scorer, texts, labels):
    got = scorer.column(pa.array(texts)) >= toxicity.THRESHOLD
    return sum(int(g) == y for g, y in zip(got, labels)) / len(labels)


def test_held_out_accuracy_and_unseen_misspellings():
    scorer = toxicity.train(*corpus(400, 1)).scorer()
    assert accuracy(scorer, *corpus(200, 2)) >= 0.97
    assert accuracy(scorer, *corpus(200, 3, twist=True)) >= 0.9


def test_texts_are_scored_whole_and_alone():
    scorer = toxicity.train(*corpus(300, 1)).scorer()
    plain = corpus(8, 5)[0]
    texts = ["", None, "na", "idiot", " " * 50, "la " * 60_000 + "idiot moron", *plain, "a", "...", "\U0001f600 é"]
    together = scorer.column(pa.array(texts))
    alone = [scorer.column(pa.array([t]))[0] for t in texts]
    assert max(abs(together - alone)) < 1e-6
    assert together[0] == together[1] == together[4] and together[5] > 0.3 and all(0 <= together) and all(together <= 1)


def test_query_shape_and_edges(spark):
    texts, labels = corpus(120, 7)
    rows = list(enumerate(texts)) + [(500, None), (501, ""), (None, texts[0]), (3, texts[3])]
    marks = spark.createDataFrame([(i, y) for i, y in enumerate(labels)] + [(4, None), (None, 1), (0, 0)], LABELS)
    out = toxicity.fit_and_score(clashing(documents(spark, rows)), marks).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert r.predicted == int(r.score >= 0.3)
    assert toxicity.fit_and_score(documents(spark, []), marks).count() == 0
    blank = toxicity.fit_and_score(documents(spark, rows), spark.createDataFrame([], LABELS)).collect()
    assert {r.predicted for r in blank} == {0}


def test_held_out_rows_are_never_trained_on(spark):
    texts, labels = corpus(60, 8)
    docs, marks = documents(spark, texts), spark.createDataFrame(list(enumerate(labels)), LABELS)
    used, _ = toxicity.training_rows(docs, marks)
    kept = {t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 4 != 2}
    assert set(used) == kept
    assert len(toxicity.training_rows(docs, marks, positive=3, negative=5)[0]) == 8
