import importlib
import random

import corpus_pipeline

from .helpers import DOCS


def prose(rng, n):
    return "\n".join(" ".join("".join(rng.choice("aeiourstln") for _ in range(rng.randint(2, 8))) for _ in range(12)) + "." for _ in range(n))


def copied(text):
    """A near copy that shares no three lines in a row."""
    lines = text.split("\n")
    for k in (2, 5):
        lines[k] = " ".join(["changed", *lines[k].split()[1:]])
    return "\n".join(lines)


def test_stages_take_effect_in_order(spark, tmp_path):
    rng = random.Random(1)
    good = [prose(rng, 8) for _ in range(120)]
    passage = prose(rng, 6)
    leak = prose(rng, 3)
    rows = list(enumerate(good))
    rows += [(200, " ".join(w + "%%%" for w in good[0].split())), (201, "short"), (202, copied(good[5])), (203, good[6]), (204, good[7] + "\n" + leak)]
    rows += [(205 + k, prose(rng, 3) + "\n" + passage + "\n" + prose(rng, 3)) for k in range(4)]
    docs = spark.createDataFrame([(i, t, "en", "src1", len(t)) for i, t in rows], DOCS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(i % 10 == 0)) for i in range(0, 120, 2)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs_out = stage(spark, docs, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs_out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs_out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen[k] = {r.doc_id: r for r in docs.collect()}
    assert {200, 201} & set(seen[0]) == set() and set(range(120)) <= set(seen[0])
    assert passage in seen[1][205].text and all(passage not in seen[1][i].text for i in (206, 207, 208)) and seen[1][203].text == ""
    assert 202 not in seen[2] and 5 in seen[2] and 204 in seen[2]
    assert 204 not in seen[3] and set(range(120)) <= set(seen[3])
    assert set(seen[4]) == set(seen[3]) and all(r.rate >= 0 for r in seen[4].values())
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted(seen[4])


def test_entry_registers_every_operator():
    names = importlib.import_module("__spark_entry__").queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
