import math
import random
import zlib
from collections import Counter

import pyarrow as pa
import pytest

from tileweave.llm import language

from .helpers import DOCS, clashing

SYLLABLES = {"aa": "ka lo mi nu re", "bb": "the ing sh on er", "cc": "ção ñe éu ß ü", "dd": "жа ли по ре ко"}


def prose(lang, rng, n):
    parts = SYLLABLES[lang].split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n))


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 0) for i, t, lang in rows], DOCS)


def trained(doc_id):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 4 != 2


def grams(text):
    """All 1-, 2- and 3-grams whose inner signs are letters, over the text with its non-letters as blanks."""
    s = " " + "".join(c.lower() if c.isalpha() else " " for c in text or "") + " "
    out = Counter()
    for n in (1, 2, 3):
        for k in range(len(s) - n + 1):
            g = s[k : k + n]
            if g[1] != " " if n == 3 else g.strip():
                out[g] += 1
    return out


def test_features_are_the_ngrams():
    texts = ["Ab cd", None, "", "é", "A1b  C", "жЖ\nx", " a", "b "]
    seen = {i: Counter() for i in range(len(texts))}
    for first, n, row, bucket, count in language.features(pa.array(texts)):
        for r, c in zip(row, count):
            seen[first + r][int(c)] += 1
    for i, text in enumerate(texts):
        assert seen[i] == Counter(grams(text).values()), text


def test_against_plain_naive_bayes(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng.choice(list(SYLLABLES)), rng, 1), rng.choice(list(SYLLABLES))) for i in range(60)]
    model = language.fit(table(spark, rows))
    code = {}
    for i, t, _ in rows:
        for g in grams(t):
            (_, _, _, bucket, count), = language.features(pa.array([t]))
            code[i] = dict(zip(bucket.tolist(), count.tolist()))
    sums, docs = {}, Counter()
    for i, t, lang in rows:
        if trained(i):
            docs[lang] += 1
            sums.setdefault(lang, Counter()).update(code[i])
    want = {}
    for i, t, _ in rows:
        logs = {}
        for lang in docs:
            whole = sum(sums[lang].values()) + language.ALPHA * language.BUCKETS
            logs[lang] = math.log(docs[lang] / sum(docs.values())) + sum(c * math.log((sums[lang][b] + language.ALPHA) / whole) for b, c in code[i].items())
        top = max(logs.values())
        want[i] = {lang: math.exp(v - top) / sum(math.exp(x - top) for x in logs.values()) for lang, v in logs.items()}
    for r in language.predict(table(spark, rows), model).collect():
        assert r.held_out == (not trained(r.doc_id))
        assert abs(want[r.doc_id][r.lang_pred] - r.score) < 1e-4 and r.score > max(want[r.doc_id].values()) - 1e-4


def test_held_out_accuracy(spark):
    rng = random.Random(2)
    rows = [(i, prose(lang, rng, rng.randint(1, 40)), lang) for i, lang in ((i, rng.choice(list(SYLLABLES))) for i in range(400))]
    got = {r.doc_id: r for r in language.fit_and_predict(table(spark, rows)).collect()}
    out = [(got[i].lang_pred == lang) for i, _, lang in rows if got[i].held_out]
    assert len(out) > 60 and sum(out) >= 0.97 * len(out)


def test_edges(spark):
    rows = [(i, f"the sheing oner {i}", "bb") for i in range(8)] + [(i, "kalo minu rere", "aa") for i in range(8, 16)]
    odd = [(20, None, "aa"), (21, "", "bb"), (22, "12 ! \U0001f600", "aa"), (23, "kalo", None), (None, "the the", "bb"), (25, "ka " * 60_000, None), (8, "kalo minu rere", "aa")]
    got = language.fit_and_predict(clashing(table(spark, rows + odd)))
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    found = {r.doc_id: (r.lang_pred, r.score) for r in got.collect()}
    assert found[20] == found[21] == found[22] == ("und", 0.0)
    assert found[23][0] == found[25][0] == "aa" and found[None][0] == "bb" and all(0 <= s <= 1 for _, s in found.values())
    assert got.count() == len(rows + odd)
    empty = language.fit_and_predict(table(spark, []))
    assert empty.count() == 0
    unlabelled = language.fit_and_predict(table(spark, [(1, "the", None)])).collect()
    assert [(r.lang_pred, r.score) for r in unlabelled] == [("und", 0.0)]


def test_many_languages_share_fewer_buckets(spark):
    rows = [(4 * i, prose("aa", random.Random(i), 3), f"l{i}") for i in range(20)]
    model = language.fit(table(spark, rows), cells=1 << 13)
    assert model.logs.shape[1] == 512 or model.logs.shape[1] == 256
    with pytest.raises(ValueError):
        language.fit(table(spark, rows), cells=1 << 10)
