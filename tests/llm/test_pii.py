import hashlib
import random
import re

from tileweave.llm import pii

from .helpers import clashing, documents

PATTERNS = (
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def brute(text):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    fits = (
        lambda m: True, lambda m: all(int(p) <= 255 for p in m.group().split(".")),
        lambda m: 14 <= len(digits(m)) <= 19 and pii.luhn(digits(m)), lambda m: 10 <= len(digits(m)) <= 15,
    )
    return sorted((m.start(), k, m.end()) for k, p in enumerate(PATTERNS) for m in p.finditer(text) if fits[k](m))


def test_patterns_against_plain_regular_expressions():
    rng = random.Random(1)
    for _ in range(30_000):
        text = "".join(rng.choice("aé1234567890.@-+ ()_%\n45") for _ in range(rng.randint(0, 40)))
        assert brute(text) == pii.base_spans(text), text
    pieces = ["4012888888881881", "4012 8888 8888 1881", "+1 (938) 555-1226", "10.0.0.1", "1.2.3.4.5", "300.1.1.1", "a@b.c", "a@b.c@d.e", " ", "x", "-", "."]
    for _ in range(5_000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 8)))
        assert brute(text) == pii.base_spans(text), text


def test_luhn():
    assert pii.luhn("4012888888881881") and not pii.luhn("4012888888881882")


def corpus(n):
    rng = random.Random(2)
    number = lambda: f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"
    out = []
    for i in range(n):
        words = [rng.choice("lorem ipsum dolor sit amet".split()) for _ in range(40)] + ["room", str(rng.randint(1, 99)), "version", "2.0"]
        words[10:10] = [number()] if i % 2 else [f"u{i}@mail.example.com"]
        out.append(" ".join(words))
    return out


def test_repeated_parts_of_a_number_are_labelled():
    field = pii.train(corpus(200))
    text = "call +1 (938) 555-1226 now, or later 555-1226, room 12, version 2.0, order 777-0000"
    added = pii.added_spans(text, pii.base_spans(text), field)
    assert [(pii.KINDS[k], text[a:b]) for a, k, b in added] == [("phone", "555-1226")]
    for clean in corpus(40):
        assert pii.added_spans(clean, pii.base_spans(clean), field) == []


def test_messages_are_exact_on_a_chain():
    import itertools

    import numpy as np

    field = pii.train(corpus(60))
    nodes = pii.nodes_of("call 12 555-1226 7 99", [])
    unary, edges = pii.features(nodes.text) @ field.weight, pii.edges_of(nodes)
    assert len(edges[1]) == 0
    total = np.zeros_like(unary)
    for labels in itertools.product(range(len(pii.KINDS) + 1), repeat=len(nodes.text)):
        score = sum(unary[i, y] for i, y in enumerate(labels)) + sum(field.chain[labels[a], labels[b]] for a, b in edges[0])
        for i, y in enumerate(labels):
            total[i, y] += np.exp(score)
    assert np.allclose(field.marginals(nodes), total / total.sum(1, keepdims=True), atol=1e-3)


def test_edges(spark):
    mail = "write to jo@x.org"
    rows = [(1, mail), (1, mail), (2, None), (3, ""), (None, mail), (4, "a " * 100_000 + "1.2.3.4 é +1 (938) 555-1226"), (5, "9" * 50_000)]
    docs = clashing(documents(spark, rows))
    got = pii.find(docs, pii.fit(docs)).collect()
    assert len(got) == len(rows)
    for r in got:
        text = dict(rows)[r.doc_id] or ""
        want = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in brute(text)) if r.doc_id != 5 else ""
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert set(want.split(",")) <= set(r.spans.split(",")) and (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(want.count(k) for k in pii.KINDS)
    assert pii.find(documents(spark, []), pii.fit(documents(spark, []))).count() == 0
