"""Image-like tables derived from the given ones: in Spark, and as SQL common table expressions.

Rasters have 64 pixels in three shapes (8×8, 16×4, 4×16), so operators that mix up width and height
do not go unnoticed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tileweave.session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def level(index: Column) -> Column:
    """An embedding component as a sample 0–255."""
    v = F.col("embedding")[index].cast("double")
    return F.least(F.greatest(F.floor((v + 0.5) * 255), F.lit(0)), F.lit(255)).cast("int")


def shape_width(image_id: Column) -> Column:
    return F.when(image_id % 3 == 0, 8).when(image_id % 3 == 1, 16).otherwise(4)


def px(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p")
    rows = spread(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")).select(
        F.col("vec_id").cast("bigint").alias("image_id"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("p")
    )
    return rows.withColumn("width", shape_width(F.col("image_id"))).select(
        "image_id",
        (p % F.col("width")).cast("int").alias("x"),
        F.floor(p / F.col("width")).cast("int").alias("y"),
        level(p).alias("r"),
        level((p + 21) % 64).alias("g"),
        level((p + 42) % 64).alias("b"),
        (255 - (p % 2) * 55).cast("int").alias("a"),
        "width",
        (F.lit(64) / F.col("width")).cast("int").alias("height"),
    )


def mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p")
    rows = spread(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")).select(
        F.col("vec_id").cast("bigint").alias("image_id"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("p")
    )
    return rows.withColumn("width", shape_width(F.col("image_id"))).select(
        "image_id",
        (p % F.col("width")).cast("int").alias("x"),
        F.floor(p / F.col("width")).cast("int").alias("y"),
        (F.col("embedding")[63 - p].cast("double") * 2 + 0.5).alias("m"),
    )


def _pick(selector: Column, values: list, other=None) -> Column:
    out = F.when(selector == 0, values[0])
    for i, v in enumerate(values[1:], 1):
        out = out.when(selector == i, v)
    return out if other is None else out.otherwise(other)


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        k.alias("ord"),
        F.concat(
            F.lit("/photos/u"), (F.col("o_custkey") % 50).cast("string"), F.lit("/img"), (k % 4000).cast("string"),
            F.lit("."), _pick(k % 8, ["jpg", "JPG", "png", "webp", "tif", "bmp", "gif"], "part"),
        ).alias("path"),
        ((k * 7919) % 1200 * 1048576).alias("length"),
        (1 + (k * 7919) % 20000).cast("int").alias("width"),
        (1 + (k * 104729) % 20000).cast("int").alias("height"),
        F.when(k % 11 == 0, "png").otherwise(_pick(k % 8, ["jpeg", "jpeg", "png", "webp", "tiff", "bmp", "gif"])).alias("sniffed"),
        F.when(k % 3 == 0, 4).otherwise(3).alias("n_channels"),
    )


def name_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    naive = F.concat(F.lit("/out/"), (F.col("o_custkey") % 97).cast("string"), F.lit(".png"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ord"), naive.alias("naive"))


def existing_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    slot = (F.col("l_linenumber") * 3 % 7).cast("string")
    stem = F.concat(F.lit("/out/"), ((F.col("l_orderkey") * 7 + F.col("l_partkey")) % 30_000).cast("string"))
    name = F.concat(stem, F.when(slot == "0", F.lit(".png")).otherwise(F.concat(F.lit("_"), slot, F.lit(".png"))))
    return table(spark, sf_dir, "lineitem").select(name.alias("output")).distinct()


def outcomes_of(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    return events.select(
        F.col("event_id").alias("ord"),
        (F.col("user_id") % 20).alias("job_id"),
        F.col("ts").alias("finished_at"),
        F.when(kind == "error", "failed").when(kind == "view", "skipped").otherwise("written").alias("status"),
        F.floor(F.col("value") * 1000).cast("bigint").alias("bytes_in"),
        F.when(~kind.isin("error", "view"), F.floor(F.col("value") * 400).cast("bigint")).alias("bytes_out"),
        F.when(kind == "error", F.concat(F.lit("err "), (F.col("event_id") % 7).cast("string"))).alias("error"),
    )


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes_of(table(spark, sf_dir, "events"))


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("event_id") % 97
    names = ["GPSLatitude", "GPSLongitude", "Make", "Model", "Software", "Orientation"]
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("img"), F.col("user_id").cast("string")).alias("path"),
        F.when(F.col("event_id") % 13 == 0, "thumbnail").otherwise("primary").alias("ifd"),
        _pick(t, names, F.concat(F.lit("Tag"), t.cast("string"))).alias("tag"),
        (1 + F.col("event_id") % 8).cast("string").alias("value"),
        F.col("event_id").alias("seq"),
    )


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, n = F.col("doc_id"), F.col("n_chars")
    digest = F.sha2(F.col("text").cast("binary"), 256)
    licenses = ["MIT", "Apache-2.0", "BSD-3-Clause", "BSD-2-Clause", "MPL-2.0", "CC0-1.0", "CC-BY-NC-4.0"]
    return table(spark, sf_dir, "documents").select(
        d.alias("artifact_id"),
        _pick(d % 8, licenses, "mit").alias("license"),
        F.when(d % 10 == 0, "deadbeef").otherwise(F.upper(digest)).alias("expected_sha256"),
        digest.alias("actual_sha256"),
        n.alias("actual_bytes"),
        F.when(d % 9 == 0, n - 20000000).otherwise(n).alias("expected_bytes"),
    )


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = ["cw", "ccw", "r180", "fliph"]
    return table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") % 500).alias("image_id"),
        F.col("turn").alias("seq"),
        "conv_id",
        _pick(F.length("text") % 5, ops, "flipv").alias("op"),
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("anim_id"),
        k.alias("seq"),
        (1 + (k * 37) % 300).cast("int").alias("width"),
        (1 + (k * 53) % 300).cast("int").alias("height"),
        (k % 40).cast("int").alias("delay_ms"),
    )


def geometry_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    sep = F.when(k % 2 == 0, "x").otherwise("X")
    junk = F.when(k % 17 == 0, "-1").when(k % 19 == 0, "9999999999").otherwise((k % 700).cast("string"))
    return table(spark, sf_dir, "part").select(
        k.alias("id"),
        (k % 13).alias("grp"),
        F.concat(size, sep, junk).alias("wh"),
        F.concat(size, F.lit("x"), junk, F.lit("+"), (k % 31).cast("string"), F.lit("+"), (k % 17).cast("string")).alias("geom"),
    )


def params(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        k.alias("id"),
        (k % 260 - 130).cast("int").alias("brightness"),
        (k % 230 - 115).cast("double").alias("contrast"),
        (k % 211 - 105).cast("double").alias("saturation"),
        ((k % 120).cast("double") / 10).alias("gamma"),
        (k % 60).alias("cx"), (k % 50).alias("cy"), (k % 45).alias("cw"), (k % 40).alias("ch"),
        F.lit(64).alias("img_w"), F.lit(48).alias("img_h"),
        (k % 5).cast("int").alias("loop_count"),
        (k % 40 - 5).cast("int").alias("speed"),
    )


# --- the same views for the SQL side -------------------------------------------------------------

_Q = "CAST(least(greatest(floor((CAST(embedding[{i}] AS DOUBLE) + 0.5e0) * 255), 0), 255) AS INTEGER)"
_GRID = """
  SELECT vec_id AS image_id, embedding, p,
         CASE vec_id % 3 WHEN 0 THEN 8 WHEN 1 THEN 16 ELSE 4 END AS width
  FROM embeddings, (SELECT unnest(range(0, 64)) AS p)"""

PX = f"""px AS (
  SELECT CAST(image_id AS BIGINT) AS image_id, CAST(p % width AS INTEGER) AS x, CAST(p // width AS INTEGER) AS y,
         {_Q.format(i='p + 1')} AS r, {_Q.format(i='(p + 21) % 64 + 1')} AS g, {_Q.format(i='(p + 42) % 64 + 1')} AS b,
         CAST(255 - (p % 2) * 55 AS INTEGER) AS a, CAST(width AS INTEGER) AS width, CAST(64 // width AS INTEGER) AS height
  FROM ({_GRID}))"""

MASK = f"""mask AS (
  SELECT CAST(image_id AS BIGINT) AS image_id, CAST(p % width AS INTEGER) AS x, CAST(p // width AS INTEGER) AS y,
         CAST(embedding[64 - p] AS DOUBLE) * 2 + 0.5e0 AS m
  FROM ({_GRID}))"""

MANIFEST = """manifest AS (
  SELECT o_orderkey AS ord,
         concat('/photos/u', o_custkey % 50, '/img', o_orderkey % 4000, '.',
           CASE o_orderkey % 8 WHEN 0 THEN 'jpg' WHEN 1 THEN 'JPG' WHEN 2 THEN 'png' WHEN 3 THEN 'webp'
             WHEN 4 THEN 'tif' WHEN 5 THEN 'bmp' WHEN 6 THEN 'gif' ELSE 'part' END) AS path,
         (o_orderkey * 7919) % 1200 * 1048576 AS length,
         CAST(1 + (o_orderkey * 7919) % 20000 AS INTEGER) AS width,
         CAST(1 + (o_orderkey * 104729) % 20000 AS INTEGER) AS height,
         CASE WHEN o_orderkey % 11 = 0 THEN 'png' WHEN o_orderkey % 8 IN (0, 1) THEN 'jpeg'
              WHEN o_orderkey % 8 = 2 THEN 'png' WHEN o_orderkey % 8 = 3 THEN 'webp' WHEN o_orderkey % 8 = 4 THEN 'tiff'
              WHEN o_orderkey % 8 = 5 THEN 'bmp' WHEN o_orderkey % 8 = 6 THEN 'gif' END AS sniffed,
         CASE WHEN o_orderkey % 3 = 0 THEN 4 ELSE 3 END AS n_channels
  FROM orders)"""

NAME_PLAN = "plan AS (SELECT o_orderkey AS ord, concat('/out/', o_custkey % 97, '.png') AS naive FROM orders)"

EXISTING = """existing AS (
  SELECT DISTINCT concat('/out/', (l_orderkey * 7 + l_partkey) % 30000, CASE WHEN l_linenumber * 3 % 7 = 0 THEN ''
           ELSE concat('_', l_linenumber * 3 % 7) END, '.png') AS output
  FROM lineitem)"""

OUTCOMES = """outcomes AS (
  SELECT event_id AS ord, user_id % 20 AS job_id, ts AS finished_at,
         CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'skipped' ELSE 'written' END AS status,
         CAST(floor(value * 1000) AS BIGINT) AS bytes_in,
         CASE WHEN event_type NOT IN ('error', 'view') THEN CAST(floor(value * 400) AS BIGINT) END AS bytes_out,
         CASE WHEN event_type = 'error' THEN concat('err ', event_id % 7) END AS error
  FROM events)"""

TAGS = """tags AS (
  SELECT concat('img', user_id) AS path, CASE WHEN event_id % 13 = 0 THEN 'thumbnail' ELSE 'primary' END AS ifd,
         CASE event_id % 97 WHEN 0 THEN 'GPSLatitude' WHEN 1 THEN 'GPSLongitude' WHEN 2 THEN 'Make' WHEN 3 THEN 'Model'
           WHEN 4 THEN 'Software' WHEN 5 THEN 'Orientation' ELSE concat('Tag', event_id % 97) END AS tag,
         CAST(1 + event_id % 8 AS VARCHAR) AS value, event_id AS seq
  FROM events)"""

ARTIFACTS = """artifacts AS (
  SELECT doc_id AS artifact_id,
         CASE doc_id % 8 WHEN 0 THEN 'MIT' WHEN 1 THEN 'Apache-2.0' WHEN 2 THEN 'BSD-3-Clause' WHEN 3 THEN 'BSD-2-Clause'
           WHEN 4 THEN 'MPL-2.0' WHEN 5 THEN 'CC0-1.0' WHEN 6 THEN 'CC-BY-NC-4.0' ELSE 'mit' END AS license,
         CASE WHEN doc_id % 10 = 0 THEN 'deadbeef' ELSE upper(sha256(text)) END AS expected_sha256,
         sha256(text) AS actual_sha256, n_chars AS actual_bytes,
         CASE WHEN doc_id % 9 = 0 THEN n_chars - 20000000 ELSE n_chars END AS expected_bytes
  FROM documents)"""

EDITS = """edits AS (
  SELECT conv_id % 500 AS image_id, turn AS seq, conv_id,
         CASE length(text) % 5 WHEN 0 THEN 'cw' WHEN 1 THEN 'ccw' WHEN 2 THEN 'r180' WHEN 3 THEN 'fliph' ELSE 'flipv' END AS op
  FROM conversations)"""

FRAMES = """frames AS (
  SELECT o_custkey AS anim_id, o_orderkey AS seq, CAST(1 + (o_orderkey * 37) % 300 AS INTEGER) AS width,
         CAST(1 + (o_orderkey * 53) % 300 AS INTEGER) AS height, CAST(o_orderkey % 40 AS INTEGER) AS delay_ms
  FROM orders)"""

GEOMETRY_TEXT = """geometry_text AS (
  SELECT p_partkey AS id, p_partkey % 13 AS grp,
         concat(p_size, CASE WHEN p_partkey % 2 = 0 THEN 'x' ELSE 'X' END, junk) AS wh,
         concat(p_size, 'x', junk, '+', p_partkey % 31, '+', p_partkey % 17) AS geom
  FROM (SELECT *, CASE WHEN p_partkey % 17 = 0 THEN '-1' WHEN p_partkey % 19 = 0 THEN '9999999999'
                       ELSE CAST(p_partkey % 700 AS VARCHAR) END AS junk FROM part))"""

PARAMS = """params AS (
  SELECT p_partkey AS id, CAST(p_partkey % 260 - 130 AS INTEGER) AS brightness,
         CAST(p_partkey % 230 - 115 AS DOUBLE) AS contrast, CAST(p_partkey % 211 - 105 AS DOUBLE) AS saturation,
         CAST(p_partkey % 120 AS DOUBLE) / 10 AS gamma, p_partkey % 60 AS cx, p_partkey % 50 AS cy,
         p_partkey % 45 AS cw, p_partkey % 40 AS ch, 64 AS img_w, 48 AS img_h,
         CAST(p_partkey % 5 AS INTEGER) AS loop_count, CAST(p_partkey % 40 - 5 AS INTEGER) AS speed
  FROM part)"""


def with_views(body: str, *views: str) -> str:
    return "WITH " + ",\n".join(views) + "\n" + body
