import random

from tileweave.llm import linedup

from .helpers import clashing, dedup_lines, documents


def test_against_plain_loop(spark):
    rng = random.Random(2)
    texts = [(i, "\n".join(rng.choice("abc") if rng.random() < 0.7 else f"{i}{rng.random()}" for _ in range(rng.randint(0, 14)))) for i in range(40)]
    got = {r.doc_id: r.text for r in linedup.line_dedup(documents(spark, texts)).collect()}
    assert got == dedup_lines(texts)


def test_edges(spark):
    passage = "one\ntwo\nthree\nfour"
    rows = [(5, passage), (2, "start\n" + passage + "\nend"), (7, None), (8, ""), (9, "two lines\nonly"), (None, passage), (10, "\n\n\n\n"), (11, "\n\n\n\n"), (12, passage), (12, passage)]
    out = linedup.line_dedup(clashing(documents(spark, rows)))
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
    want = [(5, ""), (2, "start\n" + passage + "\nend"), (7, None), (8, ""), (9, "two lines\nonly"), (None, passage), (10, "\n\n\n\n"), (11, "\n\n\n\n"), (12, ""), (12, "")]
    assert got == sorted(want, key=repr)
    assert out.columns == clashing(documents(spark, rows)).columns and {r.later for r in out.collect()} == {"later"}
    assert linedup.line_dedup(documents(spark, [])).count() == 0


def test_report_counts_lines(spark):
    rows = [(1, "a\nb\nc"), (2, "x\na\nb\nc"), (3, None), (4, "q")]
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in linedup.line_dedup_report(documents(spark, rows)).collect()}
    assert got == {1: ("a\nb\nc", 3, 0), 2: ("x", 4, 3), 3: (None, 0, 0), 4: ("q", 1, 0)}


def test_repeats_within_a_very_long_text(spark):
    text = "\n".join(["same"] * 3000)
    got = {r.doc_id: r.text for r in linedup.line_dedup(documents(spark, [(1, text), (2, text)])).collect()}
    assert got == {1: "same", 2: ""}
