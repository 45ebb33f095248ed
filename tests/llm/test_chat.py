import random

from tileweave.llm import chat

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def brute(rows):
    convs = {}
    for conv, turn, role, text in set(rows):
        if conv is not None:
            convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    seqs = {c: tuple((r, t) for _, _, r, t in sorted(v)) for c, v in convs.items()}
    longest = [c for c in seqs if not any(len(o) > len(seqs[c]) and o[: len(seqs[c])] == seqs[c] for o in seqs.values())]
    out = {}
    for c in longest:
        same = [d for d in seqs if seqs[d] == seqs[c]]
        out[min(same)] = (len(seqs[c]), len(same), "".join(f"<|{r}|>\n{t}\n" for r, t in seqs[c]))
    return out


def result(df):
    return {r.conv_id: (r.n_turns, r.n_copies, r.rendered) for r in chat.render(df).collect()}


def test_snapshots_against_all_pairs(spark):
    rng = random.Random(1)
    rows = []
    for conv in range(60):
        texts = [rng.choice("ab") for _ in range(rng.randint(1, 6))]
        rows += [(conv, k, "user" if k % 2 == 0 else "assistant", t) for k, t in enumerate(texts)]
    assert result(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_nulls_ties_repeats_and_long_texts(spark):
    rows = [
        (1, None, None, "x"), (1, 1, "user", None), (2, None, "", "x"), (2, 1, "user", ""), (2, 1, "user", ""),
        (None, 0, "user", "lost"), (3, 0, "user", "y" * 100_000), (3, 0, "assistant", "z"), (4, 0, "user", ""),
    ]
    got = result(spark.createDataFrame(rows, SCHEMA))
    assert got == brute(rows)
    assert got[1][:2] == (2, 2) and 2 not in got


def test_empty_table_and_more_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert chat.render(empty).count() == 0 and chat.collapse_snapshots(empty).count() == 0
    more = spark.createDataFrame([(1, 0, "user", "hi")], SCHEMA).selectExpr("*", "1 as pos", "2 as h1", "'r' as rendered", "0 as n_turns")
    assert result(more) == {1: (1, 1, "<|user|>\nhi\n")}


def test_common_first_turn_and_many_copies(spark):
    rows = [(c, 0, "user", "hello") for c in range(300)] + [(c, 1, "assistant", str(c % 5)) for c in range(200)]
    got = result(spark.createDataFrame(rows, SCHEMA))
    assert sorted(got) == [0, 1, 2, 3, 4] and all(v[1] == 40 for v in got.values())
