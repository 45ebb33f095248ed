"""Queries on output names: paths, suffixes, collisions, orderings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tileweave.functions import paths as pth
from tileweave.operators import naming as nm, ordering as od, tone
from tileweave.streaming.naming import drain_names

from . import views as v
from .registry import query
from .views import EXISTING, MANIFEST, NAME_PLAN, OUTCOMES, PARAMS, with_views

# Paths of many shapes, made from page urls: hidden files, no extension, double dots, trailing slashes.
_SHAPES_SQL = """shapes AS (
  SELECT page_id, CASE page_id % 9 WHEN 0 THEN concat(u, '/a.tar.gz') WHEN 1 THEN concat(u, '/.hidden') WHEN 2 THEN concat(u, '/plain')
    WHEN 3 THEN concat(u, '/dir.d/') WHEN 4 THEN concat('pic', page_id, '.png') WHEN 5 THEN concat('/pic', page_id, '.') WHEN 6 THEN concat(u, '/..')
    WHEN 7 THEN concat(u, '//x.Y/.') ELSE '/' END AS p
  FROM (SELECT page_id, concat('/w/', page_id % 100, '.d') AS u FROM pages))"""


def _shapes(spark, d):
    k = F.col("page_id")
    u = F.concat(F.lit("/w/"), (k % 100).cast("string"), F.lit(".d"))
    forms = [
        F.concat(u, F.lit("/a.tar.gz")), F.concat(u, F.lit("/.hidden")), F.concat(u, F.lit("/plain")), F.concat(u, F.lit("/dir.d/")),
        F.concat(F.lit("pic"), k.cast("string"), F.lit(".png")), F.concat(F.lit("/pic"), k.cast("string"), F.lit(".")),
        F.concat(u, F.lit("/..")), F.concat(u, F.lit("//x.Y/.")),
    ]
    return v.table(spark, d, "pages").select("page_id", v._pick(k % 9, forms, F.lit("/")).alias("p"))


@query(
    "path_parts",
    with_views(
        """SELECT page_id, coalesce(CASE k WHEN 0 THEN 'a.tar' WHEN 1 THEN '.hidden' WHEN 2 THEN 'plain' WHEN 3 THEN 'dir' WHEN 4 THEN concat('pic', page_id)
          WHEN 5 THEN concat('pic', page_id) WHEN 7 THEN 'x' END, '-') AS stem,
        coalesce(CASE k WHEN 0 THEN 'gz' WHEN 3 THEN 'd' WHEN 4 THEN 'png' WHEN 5 THEN '' WHEN 7 THEN 'Y' END, '-') AS extension,
        coalesce(CASE WHEN k IN (0, 1, 2, 3, 6, 7) THEN concat('/w/', page_id % 100, '.d') WHEN k = 4 THEN '' WHEN k = 5 THEN '/' END, '-') AS parent
        FROM (SELECT page_id, page_id % 9 AS k FROM shapes)""",
        _SHAPES_SQL,
    ),
)
def path_parts(spark, d):
    none = F.lit("-")
    return _shapes(spark, d).select(
        "page_id", F.coalesce(pth.stem("p"), none).alias("stem"), F.coalesce(pth.extension("p"), none).alias("extension"),
        F.coalesce(pth.parent("p"), none).alias("parent"),
    )


@query(
    "output_path",
    with_views(
        """SELECT page_id, coalesce(CASE k WHEN 0 THEN concat(u, '/a.tar_x.jpg') WHEN 1 THEN concat(u, '/.hidden_x.jpg') WHEN 2 THEN concat(u, '/plain_x.jpg')
          WHEN 3 THEN concat(u, '/dir_x.jpg') WHEN 4 THEN concat('pic', page_id, '_x.jpg') WHEN 5 THEN concat('/pic', page_id, '_x.jpg')
          WHEN 7 THEN concat(u, '/x_x.jpg') END, '-') AS beside,
        coalesce(CASE k WHEN 0 THEN '/o/a.tar.png' WHEN 1 THEN '/o/.hidden.png' WHEN 2 THEN '/o/plain.png' WHEN 3 THEN '/o/dir.png'
          WHEN 4 THEN concat('/o/pic', page_id, '.png') WHEN 5 THEN concat('/o/pic', page_id, '.png') WHEN 7 THEN '/o/x.png' END, '-') AS elsewhere
        FROM (SELECT page_id, page_id % 9 AS k, concat('/w/', page_id % 100, '.d') AS u FROM shapes)""",
        _SHAPES_SQL,
    ),
)
def output_path(spark, d):
    none = F.lit("-")
    return _shapes(spark, d).select(
        "page_id", F.coalesce(pth.output_path("p", F.lit("_x"), F.lit("jpg")), none).alias("beside"),
        F.coalesce(pth.output_path("p", None, F.lit("png"), F.lit("/o")), none).alias("elsewhere"),
    )


@query(
    "output_suffixes",
    with_views(
        """SELECT id, concat('_', cx) AS max_edge,
        concat('_', CASE WHEN gamma * 10 % 10 = 0 THEN CAST(CAST(gamma AS BIGINT) AS VARCHAR) ELSE CAST(gamma AS VARCHAR) END, 'pct') AS percent,
        concat('_', cw, 'x', ch) AS exact, concat('_fit-', cw, 'x', ch) AS fit,
        CASE loop_count WHEN 1 THEN '_rot90' WHEN 2 THEN '_rot180' WHEN 3 THEN '_rot270' ELSE '_auto' END AS rotate,
        CASE WHEN id % 2 = 0 THEN '_flipH' ELSE '_flipV' END AS flip, concat('_crop-', cw, 'x', ch, '+', cx, '+', cy) AS crop,
        concat('/m/p', id, '_nobg.png') AS mask FROM params""",
        PARAMS,
    ),
)
def output_suffixes(spark, d):
    degrees = F.when(F.col("loop_count").between(1, 3), F.col("loop_count") * 90)
    return v.params(spark, d).select(
        "id", pth.max_edge_suffix("cx").alias("max_edge"), pth.percent_suffix("gamma").alias("percent"),
        pth.exact_suffix("cw", "ch").alias("exact"), pth.fit_suffix("cw", "ch").alias("fit"),
        pth.rotate_suffix(degrees).alias("rotate"),
        pth.flip_suffix(F.when(F.col("id") % 2 == 0, "horizontal").otherwise("vertical")).alias("flip"),
        pth.crop_suffix("cx", "cy", "cw", "ch").alias("crop"),
        pth.mask_output_path(F.concat(F.lit("/m/p"), F.col("id").cast("string"), F.lit(".jpg"))).alias("mask"),
    )


@query(
    "adjust_tag",
    with_views(
        """SELECT id, coalesce(nullif(concat_ws('_', CASE WHEN brightness <> 0 THEN concat('b', brightness) END,
        CASE WHEN abs(c) > 0.01e0 THEN concat('c', CAST(round(c) AS INTEGER)) END,
        CASE WHEN abs(saturation) > 0.01e0 THEN concat('s', CAST(round(saturation) AS INTEGER)) END,
        CASE WHEN abs(gamma - 1) > 0.001e0 THEN printf('g%.2f', gamma) END), ''), 'adj') AS tag
        FROM (SELECT *, contrast / 4 AS c FROM params)
        UNION ALL SELECT -1 - id, CASE WHEN brightness <> 0 THEN concat('b', brightness) ELSE 'adj' END FROM params""",
        PARAMS,
    ),
)
def adjust_tag(spark, d):
    p = v.params(spark, d)
    full = p.select("id", tone.adjust_tag("brightness", F.col("contrast") / 4, "saturation", "gamma").alias("tag"))
    return full.unionByName(p.select((-1 - F.col("id")).alias("id"), tone.adjust_tag("brightness", 0.0, 0.0, 1.0).alias("tag")))


# --- collisions ----------------------------------------------------------------------------------

@query("existing_outputs_skip", with_views("SELECT ord, naive FROM plan WHERE naive IN (SELECT output FROM existing)", NAME_PLAN, EXISTING))
def existing_outputs_skip(spark, d):
    plan = v.name_plan(spark, d)
    skipped, _ = nm.split_existing(plan.withColumnRenamed("naive", "output"), v.existing_outputs(spark, d))
    return skipped.select("ord", F.col("output").alias("naive"))


@query("existing_outputs_todo", with_views("SELECT ord, naive FROM plan WHERE naive NOT IN (SELECT output FROM existing)", NAME_PLAN, EXISTING))
def existing_outputs_todo(spark, d):
    plan = v.name_plan(spark, d)
    _, todo = nm.split_existing(plan.withColumnRenamed("naive", "output"), v.existing_outputs(spark, d))
    return todo.select("ord", F.col("output").alias("naive"))


@query(
    "resolve_skip",
    with_views(
        """SELECT ord, naive, CASE WHEN naive NOT IN (SELECT output FROM existing) AND row_number() OVER (PARTITION BY naive ORDER BY ord) = 1
        THEN 'written' ELSE 'skipped' END AS status FROM plan""",
        NAME_PLAN, EXISTING,
    ),
)
def resolve_skip(spark, d):
    return nm.resolve_skip(v.name_plan(spark, d), v.existing_outputs(spark, d).withColumnRenamed("output", "naive"), output="naive")


@query(
    "resolve_replace",
    with_views("SELECT ord, naive, ord < max(ord) OVER (PARTITION BY naive) AS superseded FROM plan", NAME_PLAN),
)
def resolve_replace(spark, d):
    return nm.resolve_replace(v.name_plan(spark, d), output="naive")


# Pull form: list all free slots of every name, number them, join by rank.
_TAKEN = """taken AS (
  SELECT DISTINCT output AS naive, 0 AS slot FROM existing UNION
  SELECT regexp_replace(output, '_([1-9][0-9]{0,3})(\\.png)$', '\\2'), CAST(regexp_extract(output, '_([1-9][0-9]{0,3})\\.png$', 1) AS INTEGER)
  FROM existing WHERE regexp_matches(output, '_[1-9][0-9]{0,3}\\.png$'))"""
_FREE = """free AS (
  SELECT n.naive, s.slot, row_number() OVER (PARTITION BY n.naive ORDER BY s.slot) AS k
  FROM (SELECT DISTINCT naive FROM plan) n CROSS JOIN (SELECT unnest(range(0, 10000)) AS slot) s
  WHERE NOT EXISTS (SELECT 1 FROM taken t WHERE t.naive = n.naive AND t.slot = s.slot))"""


@query(
    "resolve_increment",
    with_views(
        """SELECT ord, p.naive, CAST(coalesce(slot, -1) AS BIGINT) AS slot
        FROM (SELECT *, row_number() OVER (PARTITION BY naive ORDER BY ord) AS k FROM plan) p
        LEFT JOIN free ON free.naive = p.naive AND free.k = p.k""",
        NAME_PLAN, EXISTING, _TAKEN, _FREE,
    ),
)
def resolve_increment(spark, d):
    out = nm.resolve_increment(v.name_plan(spark, d), nm.taken_slots(v.existing_outputs(spark, d)))
    return out.withColumn("slot", F.coalesce("slot", F.lit(-1)).cast("bigint"))


# Every fourth input asks for a name that is another group's numbered sibling; a listing holds sibling 2 of
# every third group. In closed form: with r the rank of an input in its name, f the first row that asks for the
# sibling and o2 the group's second row, slot 1 is gone for the group exactly if f is earlier than o2.
_CROSS = """cross_plan AS (
  SELECT o_orderkey AS ord, o_custkey % 5000 AS c, o_orderkey % 4 = 0 AS child,
         row_number() OVER (PARTITION BY o_custkey % 5000, o_orderkey % 4 = 0 ORDER BY o_orderkey) AS r FROM orders),
cross_groups AS (
  SELECT c, min(ord) FILTER (child) AS f, min(ord) FILTER (NOT child AND r = 2) AS o2 FROM cross_plan GROUP BY c),
cross_slots AS (
  SELECT ord, c, child, CASE
      WHEN child THEN CASE WHEN o2 < f THEN r ELSE r - 1 END
      WHEN r = 1 THEN 0
      WHEN f < o2 THEN CASE WHEN c % 3 = 0 THEN r + 1 ELSE r END
      WHEN r = 2 OR c % 3 <> 0 THEN r - 1 ELSE r END AS slot
  FROM cross_plan JOIN cross_groups USING (c))"""


@query(
    "resolve_increment_unique",
    with_views(
        """SELECT ord, concat('/out/g', c, CASE WHEN child THEN '_1' ELSE '' END, CASE WHEN slot = 0 THEN '' ELSE concat('_', slot) END, '.png') AS output
        FROM cross_slots""",
        _CROSS,
    ),
)
def resolve_increment_unique(spark, d):
    """Names that cross groups, with a listing: the outputs of taking them one after the other in list order."""
    k, c = F.col("o_orderkey"), (F.col("o_custkey") % 5000).cast("string")
    orders = v.table(spark, d, "orders")
    plan = orders.select(k.alias("ord"), F.concat(F.lit("/out/g"), c, F.when(k % 4 == 0, "_1.png").otherwise(".png")).alias("naive"))
    listing = orders.filter("o_custkey % 5000 % 3 = 0").select(F.concat(F.lit("/out/g"), c, F.lit("_2.png")).alias("output")).distinct()
    return nm.resolve_increment_all(plan, listing).select("ord", "output")


@query(
    "stream_naming",
    with_views(
        """SELECT ord, concat('/out/g', c, CASE WHEN child THEN '_1' ELSE '' END, CASE WHEN slot = 0 THEN '' ELSE concat('_', slot) END, '.png') AS output
        FROM cross_slots""",
        _CROSS,
    ),
)
def stream_naming(spark, d):
    """The same names from a stream with keyed state: orders are read as a stream and drained."""
    schema = v.table(spark, d, "orders").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "orders.parquet").parquet(d)
    k, c = F.col("o_orderkey"), (F.col("o_custkey") % 5000).cast("string")
    plan = stream.select(k.alias("ord"), F.concat(F.lit("/out/g"), c, F.when(k % 4 == 0, "_1.png").otherwise(".png")).alias("naive"))
    listing = v.table(spark, d, "orders").filter("o_custkey % 5000 % 3 = 0").select(F.concat(F.lit("/out/g"), c, F.lit("_2.png")).alias("output")).distinct()
    return drain_names(plan, listing).select("ord", "output")


@query(
    "increment_rank",
    with_views("SELECT ord, naive, row_number() OVER (PARTITION BY naive ORDER BY ord) AS increment_rank FROM plan", NAME_PLAN),
)
def increment_rank(spark, d):
    return od.increment_rank(v.name_plan(spark, d))


# --- orderings -----------------------------------------------------------------------------------

@query(
    "progress",
    with_views(
        """SELECT ord, job_id, count(*) OVER (PARTITION BY job_id ORDER BY finished_at, ord ROWS UNBOUNDED PRECEDING) AS done,
        count(*) OVER (PARTITION BY job_id) AS total FROM outcomes""",
        OUTCOMES,
    ),
)
def progress(spark, d):
    rows = v.outcomes(spark, d).select("ord", "job_id", "finished_at")
    return od.progress(rows).select("ord", "job_id", "done", "total")


@query(
    "append_unique",
    with_views(
        """SELECT path, part, min(ord) AS ord FROM (
          SELECT path, CASE WHEN ord % 3 = 0 THEN 0 ELSE 1 END AS part, ord FROM manifest)
        GROUP BY path, part QUALIFY part = min(part) OVER (PARTITION BY path)""",
        MANIFEST,
    ),
)
def append_unique(spark, d):
    m = v.manifest(spark, d)
    return od.append_unique(m.filter("ord % 3 = 0"), m.filter("ord % 3 <> 0"))


@query("sort_by_path", with_views("SELECT path, ord FROM manifest ORDER BY path, ord", MANIFEST))
def sort_by_path(spark, d):
    return od.sort_by_path(v.manifest(spark, d).select("path", "ord"), tie="ord")


@query("first_as_sample", with_views("SELECT ord, path FROM manifest ORDER BY ord LIMIT 1", MANIFEST))
def first_as_sample(spark, d):
    return od.first_as_sample(v.manifest(spark, d).select("ord", "path"))
