import random

from pyspark.sql import functions as F

from tileweave.llm import mixing

from .helpers import clashing, documents

LABELS = "doc_id bigint, quality int, toxic int"


def corpus(n=240):
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(n):
        kind = 0 if i % 4 < 2 else 1 if i % 4 == 2 else 2
        words = ["plain%d" % rng.randint(0, 40) for _ in range(rng.randint(15, 40))] + [("good", "junk%%", "awful")[kind] + str(rng.randint(0, 5)) for _ in range(4)]
        rng.shuffle(words)
        docs.append((i, " ".join(words)))
        if i < n // 2:
            labels.append((i, 0 if kind == 1 else 1, int(kind == 2)))
    return docs, labels


def test_posteriors_on_unlabelled_documents_and_targets(spark):
    docs, labels = corpus()
    out = mixing.mix(documents(spark, docs), spark.createDataFrame(labels, LABELS)).collect()
    rest = [r for r in out if r.doc_id >= 120]
    right = sum(max((r.p_good, 0), (r.p_poor, 1), (r.p_toxic, 2))[1] == (0 if r.doc_id % 4 < 2 else r.doc_id % 4 - 1) for r in rest)
    assert right >= 0.95 * len(rest)
    total = sum(r.n_tokens for r in out)
    for name, target in zip(mixing.DOMAINS, mixing.TARGETS):
        assert abs(sum(r.rate * r.n_tokens * r["p_" + name] for r in out) / total - target) < 5e-3  # soft members of all domains: no exact solution
    assert all(r.rate >= 0 for r in out)


def test_rates_minimise_the_misses(spark):
    rows = [(1, 100, 1.0, 0.0, 0.0), (2, 100, 0.5, 0.5, 0.0), (3, 200, 0.0, 0.2, 0.8), (4, 0, 0.3, 0.3, 0.4)]
    members = spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint, p0 double, p1 double, p2 double")
    got = {r.doc_id: r.rate for r in mixing.fit_rates(members, (0.6, 0.3, 0.1), steps=200, tolerance=1e-6).collect()}
    share = [sum(got[i] * n * p[k] for i, n, *p in rows) / 400 for k in range(3)]
    assert all(abs(s - t) < 1e-4 for s, t in zip(share, (0.6, 0.3, 0.1)))


def test_unreachable_domain_stays_open(spark):
    members = spark.createDataFrame([(1, 10, 1.0, 0.0, 0.0)], "doc_id bigint, n_tokens bigint, p0 double, p1 double, p2 double")
    assert abs(mixing.fit_rates(members, (0.9, 0.05, 0.05)).first().rate - 0.9) < 1e-3


def test_edges(spark):
    docs, labels = corpus(40)
    rows = docs + [(100, None), (101, ""), (None, "plain1 good1"), (3, docs[3][1]), (102, "new " * 30_000)]
    more = labels + [(3, None, None), (None, 1, 0), (5, 1, 1), (5, 1, 0)]
    out = mixing.mix(clashing(documents(spark, rows)), spark.createDataFrame(more, LABELS))
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == 44 and got[100].n_tokens == 0 and got[102].n_tokens == 30_000 and got[None].n_tokens == 2
    assert all(abs(r.p_good + r.p_poor + r.p_toxic - 1) < 1e-5 for r in got.values())
    empty = spark.createDataFrame([], LABELS)
    assert mixing.mix(documents(spark, []), empty).count() == 0
    assert {round(r.p_good, 3) for r in mixing.mix(documents(spark, docs), empty).collect()} == {0.333}


def test_no_python_in_the_plan(spark):
    docs, labels = corpus(20)
    model = mixing.fit_words(documents(spark, docs), spark.createDataFrame(labels, LABELS))
    plan = mixing.posteriors(documents(spark, docs), model)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
    assert isinstance(F.col("x"), type(mixing.domain(F.col("a"), F.col("b"))))
