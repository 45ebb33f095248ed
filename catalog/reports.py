"""Queries on outcomes, tags, artifacts and animations."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from tileweave.operators import admission as adm, frames as fr, images as im, metadata as md, stats
from tileweave.plans.conversion import report
from tileweave.streaming.progress import drain_summary

from . import views as v
from .registry import query
from .views import ARTIFACTS, FRAMES, MANIFEST, OUTCOMES, PARAMS, TAGS, with_views

_SUMMARY = """count(*) FILTER (status = 'written') AS ok, count(*) FILTER (status = 'skipped') AS skip,
  count(*) FILTER (status = 'failed') AS fail, CAST(coalesce(sum(bytes_in), 0) AS BIGINT) AS bytes_in,
  CAST(coalesce(sum(bytes_out) FILTER (status = 'written'), 0) AS BIGINT) AS bytes_out"""


@query("batch_summary", with_views(f"SELECT {_SUMMARY} FROM outcomes", OUTCOMES))
def batch_summary(spark, d):
    return stats.batch_summary(v.outcomes(spark, d))


@query("batch_summary_by_job", with_views(f"SELECT job_id, {_SUMMARY} FROM outcomes GROUP BY job_id", OUTCOMES))
def batch_summary_by_job(spark, d):
    return stats.batch_summary(v.outcomes(spark, d), "job_id")


@query(
    "batch_averages",
    with_views(
        f"""SELECT job_id, ok, bytes_in, bytes_out,
        CAST(CASE WHEN ok > 0 AND bytes_in > 0 AND bytes_out > 0 THEN bytes_in // greatest(ok, 1) ELSE -1 END AS BIGINT) AS avg_in,
        CAST(CASE WHEN ok > 0 AND bytes_in > 0 AND bytes_out > 0 THEN bytes_out // greatest(ok, 1) ELSE -1 END AS BIGINT) AS avg_out
        FROM (SELECT job_id, {_SUMMARY} FROM outcomes GROUP BY job_id)""",
        OUTCOMES,
    ),
)
def batch_averages(spark, d):
    out = stats.batch_averages(stats.batch_summary(v.outcomes(spark, d), "job_id"))
    none = F.lit(-1)
    return out.select(
        "job_id", "ok", "bytes_in", "bytes_out", F.coalesce("avg_in", none).alias("avg_in"), F.coalesce("avg_out", none).alias("avg_out")
    )


@query(
    "first_error",
    with_views("SELECT job_id, min(ord) AS ord, arg_min(error, ord) AS first_error FROM outcomes WHERE status = 'failed' GROUP BY job_id", OUTCOMES),
)
def first_error(spark, d):
    return stats.first_error(v.outcomes(spark, d), "job_id")


@query(
    "exit_code",
    with_views("SELECT user_id, CAST(max(CASE WHEN status = 'failed' THEN 2 ELSE 0 END) AS INTEGER) AS exit_code FROM o GROUP BY user_id",
               OUTCOMES, "o AS (SELECT outcomes.*, user_id FROM outcomes JOIN events ON event_id = ord)"),
)
def exit_code(spark, d):
    rows = v.table(spark, d, "events")
    status = F.when(F.col("event_type") == "error", "failed").otherwise("written")
    return stats.exit_code(rows.select("user_id", status.alias("status")), "user_id")


@query(
    "batch_report",
    with_views(
        f"""SELECT job_id, ok, skip, fail, bytes_in, bytes_out, CAST(bytes_in // greatest(ok, 1) AS BIGINT) AS avg_in,
        CAST(bytes_out // greatest(ok, 1) AS BIGINT) AS avg_out, CAST(CASE WHEN fail > 0 THEN 2 ELSE 0 END AS INTEGER) AS exit_code
        FROM (SELECT job_id, {_SUMMARY} FROM outcomes GROUP BY job_id)""",
        OUTCOMES,
    ),
)
def batch_report(spark, d):
    return report(v.outcomes(spark, d), "job_id")


@query(
    "selection_summary",
    with_views("SELECT sniffed, count(*) AS n_files, CAST(sum(length) AS BIGINT) AS total_bytes FROM (SELECT coalesce(sniffed, '-') AS sniffed, length FROM manifest) GROUP BY sniffed", MANIFEST),
)
def selection_summary(spark, d):
    return stats.selection_summary(v.manifest(spark, d).withColumn("sniffed", F.coalesce("sniffed", F.lit("-"))), "sniffed")


@query(
    "groups_in_order",
    with_views('SELECT sniffed AS "group", min(ord) AS first_ord FROM manifest WHERE sniffed IS NOT NULL GROUP BY sniffed ORDER BY 2', MANIFEST),
)
def groups_in_order(spark, d):
    return stats.groups_in_order(v.manifest(spark, d), "sniffed")


@query(
    "preset_groups",
    with_views(
        """SELECT * FROM (VALUES ('convert', 0), ('resize', 5), ('rotate', 10), ('flip', 14), ('adjust', 16), ('web', 21)) AS t("group", first_ord)
        JOIN (SELECT count(*) AS files FROM manifest) ON true""",
        MANIFEST,
    ),
)
def preset_groups(spark, d):
    """Groups of all renditions of the manifest, in the order the presets declare them."""
    from tileweave.plans.renditions import plan_renditions

    images = v.manifest(spark, d).withColumn("format", F.col("sniffed"))
    plan = plan_renditions(images)
    sizes = plan.groupBy(F.col("preset_group").alias("group"), "preset_id").agg(F.count("*").alias("files"))
    return stats.groups_in_order(plan, "preset_group", "preset_ord").join(
        sizes.groupBy("group").agg(F.max("files").alias("files")), "group"
    )


# --- streaming -----------------------------------------------------------------------------------

@query("stream_summary", with_views(f"SELECT job_id, {_SUMMARY}, count(*) AS done FROM outcomes GROUP BY job_id", OUTCOMES))
def stream_summary(spark, d):
    """The events table read as a stream, drained, and its final totals read back from the sink."""
    schema = v.table(spark, d, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return drain_summary(v.outcomes_of(events))


# --- tags ----------------------------------------------------------------------------------------

_FLAGS = """flags AS (
  SELECT path, bool_or(ifd = 'primary' AND tag IN ('GPSLatitude', 'GPSLongitude')) AS has_gps,
    bool_or(ifd = 'primary' AND tag IN ('Make', 'Model', 'Software')) AS has_camera,
    coalesce(arg_max(CAST(value AS INTEGER), seq) FILTER (ifd = 'primary' AND tag = 'Orientation'), -1) AS orientation,
    count(*) AS n_tags FROM tags GROUP BY path)"""


@query("tag_flags", with_views("SELECT * FROM flags", TAGS, _FLAGS))
def tag_flags(spark, d):
    return md.tag_flags(v.tags(spark, d)).withColumn("orientation", F.coalesce("orientation", F.lit(-1)))


_IMAGES = "imgs AS (SELECT c_custkey, concat('img', c_custkey) AS path FROM customer)"


def _images(spark, d):
    return v.table(spark, d, "customer").select("c_custkey", F.concat(F.lit("img"), F.col("c_custkey").cast("string")).alias("path"))


@query(
    "privacy_flags",
    with_views(
        """SELECT c_custkey, coalesce(has_gps, false) AS has_gps, coalesce(has_camera, false) AS has_camera, coalesce(n_tags, 0) AS n_tags,
        CASE WHEN has_gps THEN 'gps' WHEN has_camera THEN 'camera' ELSE '-' END AS label FROM imgs LEFT JOIN flags USING (path)""",
        TAGS, _FLAGS, _IMAGES,
    ),
)
def privacy_flags(spark, d):
    flagged = md.with_tag_flags(_images(spark, d), v.tags(spark, d))
    return flagged.select("c_custkey", "has_gps", "has_camera", "n_tags", F.coalesce(md.privacy_label(), F.lit("-")).alias("label"))


# --- artifacts -----------------------------------------------------------------------------------

_ALLOWED = "('MIT', 'Apache-2.0', 'BSD-3-Clause', 'BSD-2-Clause', 'MPL-2.0', 'CC0-1.0')"


@query("license_gate", with_views(f"SELECT artifact_id, license, license IN {_ALLOWED} AS allowed FROM artifacts", ARTIFACTS))
def license_gate(spark, d):
    allowed, refused = adm.split_by_license(v.artifacts(spark, d))
    cols = ["artifact_id", "license"]
    return allowed.select(*cols, F.lit(True).alias("allowed")).unionByName(refused.select(*cols, F.lit(False).alias("allowed")))


@query("size_budget", with_views("SELECT artifact_id, actual_bytes <= expected_bytes + 16777216 AS within FROM artifacts", ARTIFACTS))
def size_budget(spark, d):
    return v.artifacts(spark, d).select("artifact_id", adm.size_ok().alias("within"))


@query("hash_gate", with_views("SELECT artifact_id, lower(actual_sha256) = lower(expected_sha256) AS valid FROM artifacts", ARTIFACTS))
def hash_gate(spark, d):
    return v.artifacts(spark, d).select("artifact_id", adm.hash_ok().alias("valid"))


@query(
    "hash_gate_files",
    with_views(
        """SELECT artifact_id, artifact_id % 11 <> 0 AND lower(actual_sha256) = lower(expected_sha256) AS valid,
        CASE WHEN artifact_id % 11 <> 0 THEN actual_sha256 ELSE '-' END AS digest FROM artifacts""",
        ARTIFACTS,
    ),
)
def hash_gate_files(spark, d):
    """Hashes computed from file content and joined back by path; every eleventh file is missing."""
    docs = v.table(spark, d, "documents").filter("doc_id % 11 <> 0")
    path = F.concat(F.lit("/models/"), F.col("doc_id").cast("string"))
    files = docs.select(path.alias("path"), F.col("text").cast("binary").alias("content"), F.octet_length("text").alias("length"))
    wanted = v.artifacts(spark, d).select(
        "artifact_id", "expected_sha256", F.concat(F.lit("/models/"), F.col("artifact_id").cast("string")).alias("path")
    )
    joined = adm.with_file_hashes(wanted, files)
    return joined.select("artifact_id", adm.hash_ok().alias("valid"), F.coalesce("actual_sha256", F.lit("-")).alias("digest"))


@query(
    "admission_report",
    with_views(
        f"""SELECT artifact_id, CASE WHEN license NOT IN {_ALLOWED} THEN 'license' WHEN actual_bytes > expected_bytes + 16777216 THEN 'size'
        WHEN lower(actual_sha256) <> lower(expected_sha256) THEN 'hash' ELSE 'admitted' END AS verdict FROM artifacts""",
        ARTIFACTS,
    ),
)
def admission_report(spark, d):
    return adm.admission_report(v.artifacts(spark, d)).select("artifact_id", "verdict")


# --- animations ----------------------------------------------------------------------------------

@query(
    "frame_plan",
    with_views(
        """SELECT anim_id, seq, width, height, delay, frame_no, start_ms, canvas_width, canvas_height, sw AS scaled_width, sh AS scaled_height,
          (canvas_width - sw) // 2 AS dx, (canvas_height - sh) // 2 AS dy
        FROM (SELECT *, CAST(CASE WHEN larger THEN greatest(round(width * s), 1) ELSE width END AS BIGINT) AS sw,
                CAST(CASE WHEN larger THEN greatest(round(height * s), 1) ELSE height END AS BIGINT) AS sh
              FROM (SELECT *, width > canvas_width OR height > canvas_height AS larger,
                      least(canvas_width::DOUBLE / width, canvas_height::DOUBLE / height) AS s
                    FROM (SELECT anim_id, seq, width, height, greatest(delay_ms, 10)::BIGINT AS delay,
                            row_number() OVER w AS frame_no,
                            CAST(coalesce(sum(greatest(delay_ms, 10)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_ms,
                            CAST(first_value(width) OVER w AS BIGINT) AS canvas_width, CAST(first_value(height) OVER w AS BIGINT) AS canvas_height
                          FROM frames WINDOW w AS (PARTITION BY anim_id ORDER BY seq))))""",
        FRAMES,
    ),
)
def frame_plan(spark, d):
    return fr.frame_plan(v.frames(spark, d)).withColumnRenamed("delay_ms", "delay")


@query(
    "loop_plan",
    with_views(
        """SELECT id, CASE loop_count WHEN 0 THEN 'infinite' WHEN 1 THEN 'once' ELSE 'finite' END AS loop_mode,
        CAST(CASE loop_count WHEN 0 THEN -1 WHEN 1 THEN 0 ELSE loop_count END AS INTEGER) AS repeat,
        CAST(least(greatest(speed, 1), 30) AS INTEGER) AS speed FROM params""",
        PARAMS,
    ),
)
def loop_plan(spark, d):
    p = v.params(spark, d).select("id", fr.loop_plan("loop_count", "speed").alias("l"))
    return p.select("id", "l.loop_mode", F.coalesce("l.repeat", F.lit(-1)).alias("repeat"), "l.speed")


# --- user functions ------------------------------------------------------------------------------

@query(
    "map_images",
    """SELECT doc_id AS ord, concat('/docs/', doc_id) AS input, CASE WHEN doc_id % 7 = 0 THEN 'failed' WHEN doc_id % 5 = 0 THEN 'skipped' ELSE 'written' END AS status,
    CASE WHEN doc_id % 7 = 0 THEN concat('/docs/', doc_id, ': cannot decode') ELSE '-' END AS error, strlen(text) AS bytes_in,
    CASE WHEN doc_id % 7 = 0 OR doc_id % 5 = 0 THEN -1 ELSE strlen(text) // 2 END AS bytes_out FROM documents""",
)
def map_images(spark, d):
    """A user function over document bytes that writes, skips, or fails."""

    def halve(path, content, output):
        number = int(path.rsplit("/", 1)[1])
        if number % 7 == 0:
            raise ValueError("cannot decode")
        return None if number % 5 == 0 else len(content) // 2

    path = F.concat(F.lit("/docs/"), F.col("doc_id").cast("string"))
    files = v.table(spark, d, "documents").select(
        F.col("doc_id").alias("ord"), path.alias("path"), F.concat(path, F.lit(".out")).alias("output"),
        F.col("text").cast("binary").alias("content"),
    )
    out = im.map_images(files, halve)
    return out.select(
        "ord", "input", "status", F.coalesce("error", F.lit("-")).alias("error"), "bytes_in",
        F.coalesce("bytes_out", F.lit(-1)).alias("bytes_out"),
    )


@query(
    "score_images",
    """SELECT image_id, CAST(sum(CASE WHEN p % 2 = 0 THEN 3 ELSE -2 END * q) AS BIGINT) AS score FROM (
      SELECT vec_id AS image_id, p, floor((CAST(embedding[p + 1] AS DOUBLE) + 0.5e0) * 255) AS q
      FROM embeddings, (SELECT unnest(range(0, 64)) AS p)) GROUP BY image_id""",
)
def score_images(spark, d):
    """A linear model opened once per task and applied to whole Arrow batches."""

    def open_session():
        import numpy as np

        return np.where(np.arange(64) % 2 == 0, 3, -2)

    def score(weights, batch: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        levels = np.floor((np.stack(batch["embedding"]).astype("float64") + 0.5) * 255)
        return pd.DataFrame({"image_id": batch["vec_id"], "score": (levels @ weights).astype("int64")})

    rows = v.table(spark, d, "embeddings").select("vec_id", "embedding")
    return im.score_images(rows, open_session, score, "image_id bigint, score bigint")
