"""Deciding which output each input gets when names collide.

Plans carry ``ord`` (unique row id in list order) and an output name. Names may be requested by any
number of inputs, so nothing here groups a name's inputs in one task without a bound.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut_lineage

# Highest numbered sibling, and how a numbered sibling is spelled.
LAST_SLOT = 9999
NUMBERED = r"^([\s\S]*)_([1-9][0-9]{0,3})(\.[^./]*)$"
#: Copies of a name that rows are dealt over.
LANES = 16


def split_existing(plan: DataFrame, existing: DataFrame, output: str = "output") -> tuple[DataFrame, DataFrame]:
    """``(skipped, todo)``: plan rows whose output already exists, and the others.

    The listing is probed once per distinct output; the hits go back to the rows in ``LANES`` copies, so that
    an output asked for by very many rows is spread over as many tasks.
    """
    hits = plan.select(output).distinct().join(existing.select(output).distinct(), output, "left_semi")
    hits = hits.withColumn("_lane", F.explode(F.sequence(F.lit(0), F.lit(LANES - 1))))
    dealt = plan.withColumn("_lane", F.pmod(F.monotonically_increasing_id(), F.lit(LANES)).cast("int"))
    return dealt.join(hits, [output, "_lane"], "left_semi").select(*plan.columns), dealt.join(hits, [output, "_lane"], "left_anti").select(*plan.columns)


def resolve_skip(plan: DataFrame, existing: DataFrame, output: str = "output", ord_: str = "ord") -> DataFrame:
    """``status``: ``written`` for the first input of a free output, ``skipped`` for everything else.

    The listing is probed once per distinct output, and the verdict returns by the unique row id,
    so an output asked for by a third of all rows costs no more than any other.
    """
    firsts = plan.groupBy(output).agg(F.min(ord_).alias(ord_))
    writers = firsts.join(existing.select(output), output, "left_anti").select(ord_, F.lit("written").alias("_status"))
    return plan.join(writers, ord_, "left").withColumn("status", F.coalesce("_status", F.lit("skipped"))).drop("_status")


def resolve_replace(plan: DataFrame, output: str = "output", ord_: str = "ord") -> DataFrame:
    """``superseded`` is false for the last input of every output, which is the one that stays."""
    lasts = plan.groupBy(output).agg(F.max(ord_).alias(ord_)).select(ord_, F.lit(False).alias("_lost"))
    return plan.join(lasts, ord_, "left").withColumn("superseded", F.coalesce("_lost", F.lit(True))).drop("_lost")


def taken_slots(outputs: DataFrame, output: str = "output") -> DataFrame:
    """``naive, slot`` pairs that a listing occupies: slot 0 of its own name, and slot n of ``name`` for ``name_n``."""
    path = F.col(output)
    own = F.struct(path.alias("naive"), F.lit(0).alias("slot"))
    sibling = F.struct(
        F.concat(F.regexp_extract(path, NUMBERED, 1), F.regexp_extract(path, NUMBERED, 3)).alias("naive"),
        F.regexp_extract(path, NUMBERED, 2).try_cast("int").alias("slot"),
    )
    pairs = F.when(path.rlike(NUMBERED), F.array(own, sibling)).otherwise(F.array(own))
    return outputs.select(F.inline(pairs))


def resolve_increment(plan: DataFrame, taken: DataFrame, lanes: int = 256, last_slot: int = LAST_SLOT) -> DataFrame:
    """``slot``: the k-th input of a name takes its k-th free slot; null when all are used up.

    ``plan`` has ``ord, naive``, ``taken`` has ``naive, slot``. A name has at most ``last_slot + 1``
    slots, so an input that is not among the first that many of its own lane (a hash of ``ord``)
    cannot get one, and never meets the rest of its name. What is left per name is bounded by
    ``lanes * (last_slot + 1)`` rows. Free slots are found by merging: if t is the i-th taken
    slot, it pushes up every input whose 0-based rank is at least t - (i - 1).
    """
    slots = last_slot + 1
    local = F.row_number().over(Window.partitionBy("naive", "_salt").orderBy("ord"))
    inputs = plan.withColumn("_salt", F.pmod(F.xxhash64("ord"), F.lit(lanes)).cast("int")).withColumn("_local", local)
    inputs = inputs.withColumn("_lane", F.when(F.col("_local") <= slots, -1).otherwise(F.col("_salt")))
    inputs = inputs.withColumns({"_taken": F.lit(0), "_sort": F.col("ord").cast("bigint")})
    occupied = (
        taken.filter(F.col("slot").between(0, last_slot))
        .select("naive", F.col("slot").cast("bigint").alias("_sort"))
        .distinct()
        .withColumns({"_taken": F.lit(1), "_lane": F.lit(-1)})
    )
    both = inputs.unionByName(occupied, allowMissingColumns=True).repartition("naive", "_lane")
    nth = F.row_number().over(Window.partitionBy("naive", "_lane", "_taken").orderBy("_sort"))
    both = both.withColumn("_at", F.when(F.col("_taken") == 1, F.col("_sort") - (nth - 1)).otherwise(nth - 1))
    merged = Window.partitionBy("naive", "_lane").orderBy("_at", F.desc("_taken")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    slot = F.col("_at") + F.sum("_taken").over(merged)
    placed = both.withColumn("slot", F.when((F.col("_lane") == -1) & (slot <= last_slot), slot))
    return placed.filter(F.col("_taken") == 0).select(*plan.columns, "slot")


def slot_name(naive, slot):
    """``dir/name.ext`` for slot 0, ``dir/name_n.ext`` for slot n."""
    head, ext = F.regexp_extract(naive, r"^([\s\S]*?)(\.[^./]*)?$", 1), F.regexp_extract(naive, r"(\.[^./]*)?$", 1)
    numbered = F.concat(head, F.lit("_"), F.col(slot).cast("string"), ext)
    return F.when(F.col(slot) == 0, F.col(naive)).when(F.col(slot) > 0, numbered)


def _name_table(plan: DataFrame) -> DataFrame:
    """``naive, first, parent, number``: every name asked for, its first row, and the name of which it is a numbered sibling."""
    numbered = F.col("naive").rlike(NUMBERED)
    parent = F.concat(F.regexp_extract("naive", NUMBERED, 1), F.regexp_extract("naive", NUMBERED, 3))
    names = plan.filter("naive IS NOT NULL").groupBy("naive").agg(F.min("ord").alias("first")).select(
        "naive", "first", F.when(numbered, parent).alias("parent"), F.when(numbered, F.regexp_extract("naive", NUMBERED, 2).cast("int")).alias("number")
    )
    # A parent that nobody asks for takes no slots.
    asked = names.select(F.col("naive").alias("_asked"))
    known = names.join(asked, F.col("parent") == F.col("_asked"), "left")
    return known.select("naive", "first", F.col("_asked").alias("parent"), F.when(F.col("_asked").isNotNull(), F.col("number")).alias("number"))


def _ranks(plan: DataFrame, rivals: DataFrame, lanes: int, last_slot: int) -> DataFrame:
    """Adds ``before`` to rivals (``naive, slot, child, first``): rows of ``naive`` earlier than ``first``, as far as they can get a slot.

    Only a name's first ``last_slot + 1`` rows matter; those are the first of their lanes, too, so no task sees more of
    a name than ``lanes`` times as many.
    """
    rows = plan.select("naive", F.col("ord").cast("bigint").alias("_at")).join(rivals.select("naive").distinct(), "naive", "left_semi")
    lane = F.pmod(F.xxhash64("_at"), F.lit(lanes))
    near = rows.withColumn("_nth", F.row_number().over(Window.partitionBy("naive", lane).orderBy("_at"))).filter(F.col("_nth") <= last_slot + 1)
    near = near.withColumn("_nth", F.row_number().over(Window.partitionBy("naive").orderBy("_at"))).filter(F.col("_nth") <= last_slot + 1)
    events = near.select("naive", "_at", F.lit(1).alias("_row")).unionByName(
        rivals.select("naive", "slot", "child", F.col("first").cast("bigint").alias("_at"), F.lit(0).alias("_row")), allowMissingColumns=True
    )
    upto = Window.partitionBy("naive").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return events.withColumn("before", F.sum("_row").over(upto)).filter("_row = 0").select("naive", "slot", "child", "before")


def _settle(rivals: DataFrame, taken: DataFrame) -> DataFrame:
    """``naive, slot`` pairs that rivals decide: slots a name loses to the name spelled like them, and first slots lost to a parent.

    The row that reaches slot s of a name has a rank of s less the slots gone before it. Listed slots are gone for
    all; a rival's slot is gone if the rival's first row comes before that row, which is if no more rivals went
    before than s, less the listed slots before it, less the rows earlier than the rival. So the count of gone rivals
    is a fold of steps ``k + 1 if k <= margin else k`` over the name's rivals in order of slots, of which there
    are at most ``LAST_SLOT``. A slot that is not gone is the name's, and its rival has lost its own first one, which
    has to be known before the rival's turn: names settle parents first.
    """
    settled = taken.limit(0)
    level, lost = rivals.join(rivals.select(F.col("child").alias("naive")), "naive", "left_anti"), taken.limit(0)
    while True:
        level = cut_lineage(level)
        if level.isEmpty():
            return settled
        always = taken.join(level.select("naive").distinct(), "naive", "left_semi").select("naive", "slot").union(lost).distinct()
        open_ = level.join(always, ["naive", "slot"], "left_anti")
        below = Window.partitionBy("naive").orderBy("slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        marked = always.withColumn("_gone", F.lit(1)).unionByName(open_.withColumn("_gone", F.lit(0)), allowMissingColumns=True)
        margins = marked.withColumn("margin", F.col("slot") - F.sum("_gone").over(below) - F.col("before")).filter("_gone = 0")
        steps = F.sort_array(F.collect_list(F.struct("slot", "margin", "child")))
        start = F.struct(F.lit(0).cast("bigint").alias("k"), F.expr("cast(array() as array<int>)").alias("slots"))

        def step(state, rival):
            return F.when(state["k"] <= rival["margin"], F.struct((state["k"] + 1).alias("k"), F.concat(state["slots"], F.array(rival["slot"])).alias("slots"))).otherwise(state)

        folded = margins.groupBy("naive").agg(steps.alias("_steps")).withColumn("_slots", F.aggregate("_steps", start, step, lambda state: state["slots"]))
        decided = cut_lineage(folded.select("naive", F.explode("_steps").alias("_r"), "_slots").select(
            "naive", F.col("_r.slot").alias("slot"), F.col("_r.child").alias("child"), F.array_contains("_slots", F.col("_r.slot")).alias("gone")
        ))
        lost = decided.filter("NOT gone").select(F.col("child").alias("naive"), F.lit(0).alias("slot"))
        settled = settled.union(decided.filter("gone").select("naive", "slot")).union(lost)
        level = rivals.join(level.select(F.col("child").alias("naive")), "naive", "left_semi")


def resolve_increment_all(plan: DataFrame, existing: DataFrame, lanes: int = 256, last_slot: int = LAST_SLOT) -> DataFrame:
    """``output`` for every plan row, as if the rows took their names one after the other in order of ``ord``.

    A row takes the first free output among its name and the numbered siblings; one that finds all
    ``last_slot + 1`` taken gets null, as does a row without a name. ``existing`` has one column, ``output``. Names that are another name's
    numbered sibling compete with it: slot n of ``name`` goes to ``name_n`` exactly if the first row that asks
    for that is earlier than the row of ``name`` whose turn it would be. Which slots that concerns is settled
    first, from ranks and first rows of the names alone; with those slots gone, every row's place follows from its
    rank (``resolve_increment``), in one pass over all rows.
    """
    names = cut_lineage(_name_table(plan))
    taken = taken_slots(existing.select("output")).filter(F.col("slot").between(0, last_slot)).distinct()
    rivals = names.filter("parent IS NOT NULL").filter(F.col("number") <= last_slot)
    rivals = rivals.select(F.col("parent").alias("naive"), F.col("number").alias("slot"), F.col("naive").alias("child"), "first")
    if not rivals.isEmpty():
        taken = taken.union(_settle(cut_lineage(_ranks(plan, rivals, min(lanes, LANES), last_slot)), taken)).distinct()
    placed = resolve_increment(plan.select("ord", "naive").filter("naive IS NOT NULL"), taken, lanes, last_slot)
    every = placed.filter("slot IS NOT NULL").select("ord", slot_name("naive", "slot").alias("output"))
    return plan.join(every, "ord", "left")
