import itertools
import random

from tileweave.llm import decontam

from .helpers import clashing, documents

ITEMS = "item_id bigint, text string"


def made(seed, n):
    rng = random.Random(seed)
    return ["w%d" % rng.randint(0, 400) for _ in range(n)]


def brute(docs, items, window=20, least=16):
    out = {}
    strip = ".,;:!?\"'()"
    cut = lambda t: [w for w in ((x.strip(strip)) for x in (t or "").lower().split()) if w]
    for d, text in docs:
        for k, item in items:
            a, b = cut(text), cut(item)
            for diagonal in range(-len(b) + 1, len(a)):
                eq = [int(a[i + diagonal] == b[i]) for i in range(max(0, -diagonal), min(len(b), len(a) - diagonal))]
                n = min(window, len(b))
                best = max((sum(eq[p : p + n]) for p in range(len(eq) - n + 1)), default=0)
                if n and best * window >= n * least:
                    out[d, k] = max(out.get((d, k), (0, 0)), (best, n))
    return out


def test_against_all_diagonals(spark):
    rng = random.Random(3)
    items = [(k, " ".join(made(100 + k, 30 if k < 4 else 12))) for k in range(6)]
    docs = []
    for i in range(24):
        body = made(i, 60)
        if i % 3:
            part = items[i % 6][1].split()
            if i % 4 == 1:
                part = part[: 22]
            part = [w if rng.random() > 0.12 * (i % 5) else "other" for w in part]
            body[20:20] = [w.upper() + "," if i % 2 else w for w in part]
        docs.append((i, " ".join(body)))
    found = decontam.leaks(documents(spark, docs), spark.createDataFrame(items, ITEMS))
    got = {(r.doc_id, r.item_id): (r.n_equal, r.n_aligned) for r in found.collect()}
    assert got == brute(docs, items) and len(got) > 5
    blocks = decontam.leaks(documents(spark, docs), spark.createDataFrame(items, ITEMS), block_seeds=100)
    assert {(r.doc_id, r.item_id): (r.n_equal, r.n_aligned) for r in blocks.collect()} == got


def test_masks_hit_every_admitted_pattern():
    for n in range(1, decontam.WINDOW + 1):
        for wrong in itertools.combinations(range(n), n // 5):
            equal = [i not in wrong for i in range(n)]
            assert any(
                all(equal[at + k] for k, bit in enumerate(m) if bit == "1") for m in decontam.masks_for(n) for at in range(n - len(m) + 1)
            ), (n, wrong)


def test_short_items_and_regular_substitutions(spark):
    items = [(n, " ".join(f"i{n}x{k}" for k in range(n))) for n in (1, 2, 4, 5, 6, 7, 8, 10, 11, 12, 15, 19, 20, 45)]
    docs = []
    for n, text in items:
        for step in (2, 3, 4, 5, 6):
            for start in range(step):
                words = text.split()
                for k in range(start, n, step):
                    words[k] = "z"
                docs.append((len(docs), "a b " + " ".join(words) + " c d"))
        docs.append((len(docs), text))
    found = decontam.leaks(documents(spark, docs), spark.createDataFrame(items, ITEMS)).collect()
    assert {(r.doc_id, r.item_id): (r.n_equal, r.n_aligned) for r in found} == brute(docs, items)


def test_edges(spark):
    item = " ".join(made(9, 40))
    rows = [(1, item), (2, None), (3, ""), (4, "clean " * 50), (None, item), (5, "x " * 20_000 + item), (1, item), (6, " ".join(item.split()[:6])), (7, "not TOO few")]
    bench = spark.createDataFrame([(1, item), (1, item), (2, None), (None, "clean " * 50), (3, "too few"), (4, " ...")], ITEMS)
    docs = clashing(documents(spark, rows))
    assert {(r.doc_id, r.item_id) for r in decontam.leaks(docs, bench).collect()} == {(1, 1), (5, 1), (7, 3)}
    left = decontam.decontaminate(docs, bench)
    assert sorted((r.doc_id for r in left.collect()), key=repr) == sorted([2, 3, 4, None, 6], key=repr) and left.columns == docs.columns
    assert decontam.leaks(documents(spark, []), bench).count() == 0
    assert decontam.decontaminate(docs, spark.createDataFrame([], ITEMS)).count() == len(rows)
