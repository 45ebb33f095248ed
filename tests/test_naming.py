import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tileweave.functions import paths as pth
from tileweave.operators import naming as nm, ordering as od, tone

PLAN = "ord bigint, naive string"


def values(df, *columns):
    return {r[0]: tuple(r[1:]) if len(columns) > 2 else r[1] for r in df.select(*columns).collect()}


def assign(inputs, taken, last):
    """Brute force: inputs in order, each takes the first free slot of its name."""
    used = {}
    for name, slot in taken:
        used.setdefault(name, set()).add(slot)
    out = {}
    for ord_, name in sorted(inputs):
        slots = used.setdefault(name, set())
        free = next((s for s in range(last + 1) if s not in slots), None)
        out[ord_] = free
        if free is not None:
            slots.add(free)
    return out


@pytest.mark.parametrize("lanes, last", [(1, 9999), (3, 5), (32, 40)])
def test_increment_against_brute_force_with_a_hot_name(spark, lanes, last):
    rng = random.Random(lanes)
    inputs = [(i, "/o/hot.png" if i % 3 == 0 else f"/o/{rng.randrange(20)}.png") for i in range(300)]
    taken = [(f"/o/{rng.randrange(25)}.png", rng.randrange(last + 3)) for _ in range(60)] + [("/o/hot.png", s) for s in (0, 2, 3, 7)]
    out = nm.resolve_increment(
        spark.createDataFrame(inputs, PLAN), spark.createDataFrame(taken, "naive string, slot int"), lanes, last
    )
    assert values(out, "ord", "slot") == assign(inputs, taken, last)


def test_increment_runs_out_after_the_last_sibling(spark):
    inputs = spark.range(10_005).select(F.col("id").alias("ord"), F.lit("a.png").alias("naive"))
    taken = spark.createDataFrame([("a.png", 0)], "naive string, slot int")
    got = values(nm.resolve_increment(inputs, taken, lanes=4), "ord", "slot")
    assert got[0] == 1 and got[9998] == 9999
    assert all(got[i] is None for i in range(9999, 10_005))


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 6)), max_size=25), st.integers(1, 25))
def test_increment_property(spark, taken, n):
    inputs = [(i, "ab"[i % 2]) for i in range(n)]
    out = nm.resolve_increment(
        spark.createDataFrame(inputs, PLAN), spark.createDataFrame(taken, "naive string, slot int"), lanes=2, last_slot=8
    )
    assert values(out, "ord", "slot") == assign(inputs, taken, 8)


def test_increment_names(spark):
    df = spark.createDataFrame([("/o/a.png", 0), ("/o/a.png", 3), ("/o.d/a", 1), ("/o/a.b.png", 2)], "naive string, slot int")
    got = [r[0] for r in df.select(nm.slot_name("naive", "slot")).collect()]
    assert got == ["/o/a.png", "/o/a_3.png", "/o.d/a_1", "/o/a.b_2.png"]


def test_names_that_cross_groups_stay_unique(spark):
    plan = spark.createDataFrame([(1, "a.png"), (2, "a_1.png"), (3, "a.png"), (4, "a_1.png"), (5, "a_1_1.png"), (6, "a.png")], PLAN)
    existing = spark.createDataFrame([("a.png",)], "output string")
    got = values(nm.resolve_increment_all(plan, existing), "ord", "output")
    assert len(set(got.values())) == 6 and None not in got.values() and "a.png" not in got.values()
    assert got[1] == "a_1.png"  # the lowest row id keeps the contested name


def test_taken_slots_of_a_listing(spark):
    df = spark.createDataFrame([("/o/a.png",), ("/o/a_7.png",), ("/o/a_07.png",), ("/o/a_12345.png",)], "output string")
    got = {tuple(r) for r in nm.taken_slots(df).collect()}
    assert ("/o/a.png", 7) in got and ("/o/a_07.png", 0) in got
    assert not any(n == "/o/a.png" and s not in (0, 7) for n, s in got)


def test_skip_and_replace(spark):
    plan = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, "z"), (5, "x")], "ord bigint, output string")
    existing = spark.createDataFrame([("y",)], "output string")
    assert values(nm.resolve_skip(plan, existing), "ord", "status") == {
        1: "written", 2: "skipped", 3: "skipped", 4: "written", 5: "skipped"
    }
    assert values(nm.resolve_replace(plan), "ord", "superseded") == {1: True, 2: True, 3: False, 4: False, 5: False}


def test_rank_of_a_hot_key_and_ties(spark):
    rng = random.Random(5)
    rows = [(i, "hot" if i % 3 else f"k{i % 7}", rng.randrange(4)) for i in range(400)]
    df = spark.createDataFrame(rows, "ord bigint, job_id string, finished_at bigint")
    got = values(od.progress(df), "ord", "done", "total")
    for key in {r[1] for r in rows}:
        mine = sorted((r[2], r[0]) for r in rows if r[1] == key)
        for place, (_, ord_) in enumerate(mine, 1):
            assert got[ord_] == (place, len(mine))
    small = values(od.increment_rank(df.withColumnRenamed("job_id", "naive"), blocks=10), "ord", "increment_rank")
    for key in {r[1] for r in rows}:
        for place, ord_ in enumerate(sorted(r[0] for r in rows if r[1] == key), 1):
            assert small[ord_] == place


def test_append_unique_keeps_first_occurrence(spark):
    old = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a")], "ord bigint, path string")
    new = spark.createDataFrame([(0, "c"), (1, "a"), (2, "c")], "ord bigint, path string")
    rows = od.append_unique(old, new).orderBy("part", "ord").collect()
    assert [(r.path, r.part, r.ord) for r in rows] == [("a", 0, 0), ("b", 0, 1), ("c", 1, 0)]


PATHS = {
    "/a/b.png": ("b", "png", "/a"), "b.png": ("b", "png", ""), "/b": ("b", None, "/"), "/a/.x": (".x", None, "/a"),
    "/a/b.c.d": ("b.c", "d", "/a"), "/a/b.": ("b", "", "/a"), "a//b.png/": ("b", "png", "a"), "a/b/.": ("b", None, "a"),
    "/": (None, None, None), "..": (None, None, None), "": (None, None, None), "/a/foto ção.JPG": ("foto ção", "JPG", "/a"),
}


def test_path_parts(spark):
    df = spark.createDataFrame([(p,) for p in PATHS], "p string")
    rows = df.select("p", pth.stem("p").alias("s"), pth.extension("p").alias("e"), pth.parent("p").alias("d")).collect()
    for r in rows:
        s, e, d = PATHS[r.p]
        assert (r.s, r.e) == (s, e), r.p
        if s is not None:
            assert r.d == d, r.p


def test_output_path(spark):
    one = spark.range(1)

    def out(path, suffix=None, ext="jpg", folder=None):
        return one.select(pth.output_path(F.lit(path), F.lit(suffix) if suffix else None, F.lit(ext), F.lit(folder) if folder else None)).first()[0]

    assert out("/p/a.png") == "/p/a.jpg"
    assert out("/p/a.png", "_50pct") == "/p/a_50pct.jpg"
    assert out("/p/a.png", folder="/o/") == "/o/a.jpg"
    assert out("a.png") == "a.jpg"
    assert out("/a.png") == "/a.jpg"
    assert out("/") is None


def test_suffixes(spark):
    one = spark.range(1)

    def text(column):
        return one.select(column).first()[0]

    assert text(pth.percent_suffix(F.lit(50.0))) == "_50pct"
    assert text(pth.percent_suffix(F.lit(200.0))) == "_200pct"
    assert text(pth.percent_suffix(F.lit(33.3))) == "_33.3pct"
    assert text(pth.percent_suffix(F.lit(0.0001))) == "_0.0001pct"
    assert text(pth.max_edge_suffix(F.lit(1080))) == "_1080"
    assert text(pth.fit_suffix(F.lit(200), F.lit(100))) == "_fit-200x100"
    assert text(pth.crop_suffix(*map(F.lit, (500, 250, 1000, 500)))) == "_crop-1000x500+500+250"
    assert text(pth.rotate_suffix(F.lit(None).cast("int"))) == "_auto"
    assert text(tone.adjust_tag(F.lit(10), F.lit(-20.0), F.lit(0.0), F.lit(1.0))) == "b10_c-20"
    assert text(tone.adjust_tag(F.lit(0), F.lit(0.0), F.lit(0.0), F.lit(1.8))) == "g1.80"
    assert text(tone.adjust_tag(F.lit(0), F.lit(0.0), F.lit(0.0), F.lit(1.0))) == "adj"
    assert text(pth.mask_output_path(F.lit("/p/cat.jpg"))) == "/p/cat_nobg.png"


def in_list_order(inputs, listing, last=nm.LAST_SLOT):
    """One after the other, each takes the first free output among its name and the numbered siblings."""
    taken, out = set(listing), {}
    for ord_, name in sorted(inputs):
        stem, _, ext = name.rpartition(".")
        choices = [name] + [f"{stem}_{s}.{ext}" for s in range(1, min(last, len(inputs) + len(listing) + 1) + 1)]
        out[ord_] = next((c for c in choices if c not in taken), None)
        taken.add(out[ord_])
    return out


@pytest.mark.parametrize(
    "names,want",
    [
        (["a", "a", "a_1", "a_1_1"], ["a", "a_1", "a_1_1", "a_1_1_1"]),
        (["a_1", "a", "a", "a"], ["a_1", "a", "a_2", "a_3"]),
    ],
)
def test_names_are_taken_in_list_order(spark, names, want):
    plan = [(i, f"{n}.png") for i, n in enumerate(names)]
    got = values(nm.resolve_increment_all(spark.createDataFrame(plan, PLAN), spark.createDataFrame([], "output string")), "ord", "output")
    assert got == {i: f"{n}.png" for i, n in enumerate(want)} == in_list_order(plan, [])


def test_tangled_names_against_a_sequential_run(spark):
    rng = random.Random(11)
    stems = ["a", "a_1", "a_2", "a_1_1", "a_1_1_2", "b_1", "b", "c", "a_2_1"]
    plan = [(k, f"/{rng.randint(0, 25)}/{rng.choice(stems)}.png") for k in range(700)]
    listing = [f"/{rng.randint(0, 25)}/{rng.choice(stems)}.png" for _ in range(60)]
    got = values(nm.resolve_increment_all(spark.createDataFrame(plan, PLAN), spark.createDataFrame([(o,) for o in listing], "output string")), "ord", "output")
    assert got == in_list_order(plan, listing)


def test_tangled_names_run_out(spark):
    plan = [(k, "a.png") for k in range(8)] + [(20, "a_2.png"), (21, "a_2.png")]
    got = values(nm.resolve_increment_all(spark.createDataFrame(plan, PLAN), spark.createDataFrame([], "output string"), last_slot=3), "ord", "output")
    assert got == in_list_order(plan, [], last=3) and sum(v is None for v in got.values()) == 4


def test_a_hot_name_among_many_rivals(spark):
    rng = random.Random(12)
    stems = ["hot"] * 10 + [f"hot_{n}" for n in range(1, 40)] + [f"hot_{n}_{m}" for n in range(1, 8) for m in (1, 2, 5)]
    order = rng.sample(range(5000), 900)
    plan = [(o, rng.choice(stems) + ".png") for o in order]
    listing = [f"hot_{n}.png" for n in (3, 4, 60, 200)]
    out = nm.resolve_increment_all(spark.createDataFrame(plan, PLAN), spark.createDataFrame([(o,) for o in listing], "output string"), lanes=4)
    assert values(out, "ord", "output") == in_list_order(sorted(plan), listing)
    assert "Pandas" not in out._jdf.queryExecution().executedPlan().toString()


def test_rows_without_a_name_get_none(spark):
    plan = spark.createDataFrame([(1, None), (2, "a.png"), (3, None)], PLAN)
    assert values(nm.resolve_increment_all(plan, spark.createDataFrame([], "output string")), "ord", "output") == {1: None, 2: "a.png", 3: None}
