"""Queries on text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tileweave.functions import binary, text as tx
from tileweave.operators import stats
from tileweave.functions.paths import file_name

from . import views as v
from .registry import query
from .views import GEOMETRY_TEXT, MANIFEST, OUTCOMES, with_views

_KB, _MB, _GB = "1024.0e0", "1048576.0e0", "1073741824.0e0"

# Sizes over the whole range of units, many of them exactly between two printed values.
_SIZES = "sizes AS (SELECT ord, (length // CASE ord % 4 WHEN 0 THEN 1 WHEN 1 THEN 1024 WHEN 2 THEN 1048576 ELSE 64 END) * CASE ord % 5 WHEN 0 THEN 5 ELSE 1 END AS n FROM manifest)"


def _sizes(spark, d):
    k = F.col("ord")
    divisor = v._pick(k % 4, [1, 1024, 1048576], 64)
    n = F.floor(F.col("length") / divisor) * F.when(k % 5 == 0, 5).otherwise(1)
    return v.manifest(spark, d).select("ord", n.cast("bigint").alias("n"))


@query(
    "format_size",
    with_views(
        f"""SELECT ord, CASE WHEN n >= 1073741824 THEN printf('%.1f GB', n / {_GB}) WHEN n >= 1048576 THEN printf('%.1f MB', n / {_MB})
        WHEN n >= 1024 THEN printf('%.0f KB', n / {_KB}) ELSE concat(n, ' B') END AS text FROM sizes""",
        MANIFEST, _SIZES,
    ),
)
def format_size(spark, d):
    return _sizes(spark, d).select("ord", tx.format_size("n").alias("text"))


@query(
    "format_bytes",
    with_views(
        f"""SELECT ord, CASE WHEN n >= 1073741824 THEN printf('%.1f GB (%d bytes)', n / {_GB}, n) WHEN n >= 1048576 THEN printf('%.1f MB (%d bytes)', n / {_MB}, n)
        WHEN n >= 1024 THEN printf('%.1f KB (%d bytes)', n / {_KB}, n) ELSE concat(n, ' B') END AS text FROM sizes""",
        MANIFEST, _SIZES,
    ),
)
def format_bytes(spark, d):
    return _sizes(spark, d).select("ord", tx.format_bytes("n").alias("text"))


@query(
    "format_duration",
    with_views(
        """SELECT ord, CASE WHEN s < 10 THEN printf('%.1f s', s) WHEN s < 60 THEN printf('%.0f s', s)
        WHEN s < 3600 THEN concat(CAST(floor(s / 60) AS BIGINT), ' min ', CAST(round(s - floor(s / 60) * 60) AS BIGINT), ' s')
        ELSE concat(CAST(floor(s / 3600) AS BIGINT), 'h ', CAST(round((s - floor(s / 3600) * 3600) / 60) AS BIGINT), 'min') END AS text
        FROM (SELECT ord, bytes_in / CASE ord % 4 WHEN 0 THEN 100000.0e0 WHEN 1 THEN 8192.0e0 WHEN 2 THEN 64.0e0 ELSE 10.0e0 END AS s FROM outcomes)""",
        OUTCOMES,
    ),
)
def format_duration(spark, d):
    k = F.col("ord")
    seconds = F.col("bytes_in") / v._pick(k % 4, [100000.0, 8192.0, 64.0], 10.0)
    return v.outcomes(spark, d).select("ord", tx.format_duration(seconds).alias("text"))


@query(
    "size_delta",
    with_views(
        """SELECT ord, CASE WHEN a = 0 OR b = 0 THEN '' WHEN abs(p) < 0.5e0 THEN '≈ mesmo tamanho' WHEN p < 0 THEN printf('−%.0f%%', abs(p)) ELSE printf('+%.0f%%', p) END AS text
        FROM (SELECT *, (b::DOUBLE / nullif(a, 0) - 1) * 100 AS p FROM (
          SELECT ord, CASE WHEN ord % 50 = 0 THEN 0 ELSE bytes_in END AS a, bytes_in + (ord % 41 - 20) * 1000 AS b FROM outcomes))""",
        OUTCOMES,
    ),
)
def size_delta(spark, d):
    a = F.when(F.col("ord") % 50 == 0, 0).otherwise(F.col("bytes_in"))
    b = F.col("bytes_in") + (F.col("ord") % 41 - 20) * 1000
    return v.outcomes(spark, d).select("ord", tx.size_delta(a, b).alias("text"))


@query(
    "files_label",
    with_views(
        """SELECT u, CASE count(*) WHEN 1 THEN arg_min(name, ord) ELSE concat(arg_min(name, ord), ' +', count(*) - 1, ' outros') END AS label
        FROM (SELECT ord, regexp_extract(path, '[^/]+$') AS name, CASE WHEN ord % 100 = 0 THEN concat('single', ord) ELSE regexp_extract(path, '/(u\\d+)/', 1) END AS u FROM manifest)
        GROUP BY u""",
        MANIFEST,
    ),
)
def files_label(spark, d):
    u = F.when(F.col("ord") % 100 == 0, F.concat(F.lit("single"), F.col("ord").cast("string"))).otherwise(
        F.regexp_extract("path", r"/(u\d+)/", 1)
    )
    return stats.selection_label(v.manifest(spark, d).withColumn("u", u), file_name("path"), "u")


@query(
    "parse_geometry",
    with_views(
        """SELECT id, coalesce(CASE WHEN ok THEN CAST(w AS BIGINT) END, -1) AS width, coalesce(CASE WHEN ok THEN CAST(h AS BIGINT) END, -1) AS height
        FROM (SELECT id, w, h, regexp_full_match(h, '\\d+') AND TRY_CAST(h AS UINTEGER) IS NOT NULL AS ok
              FROM (SELECT id, split_part(lower(wh), 'x', 1) AS w, split_part(lower(wh), 'x', 2) AS h FROM geometry_text))""",
        GEOMETRY_TEXT,
    ),
)
def parse_geometry(spark, d):
    g = v.geometry_text(spark, d).select("id", tx.parse_geometry("wh").alias("g"))
    return g.select("id", F.coalesce("g.width", F.lit(-1)).alias("width"), F.coalesce("g.height", F.lit(-1)).alias("height"))


@query(
    "parse_crop",
    with_views(
        """SELECT id, CASE WHEN ok THEN concat(w, ',', h, ',', x, ',', y) ELSE '-' END AS crop
        FROM (SELECT *, regexp_full_match(h, '\\d+') AND TRY_CAST(h AS UINTEGER) IS NOT NULL AS ok FROM (
          SELECT id, split_part(split_part(geom, '+', 1), 'x', 1) AS w, split_part(split_part(geom, '+', 1), 'x', 2) AS h,
                 split_part(geom, '+', 2) AS x, split_part(geom, '+', 3) AS y FROM geometry_text))""",
        GEOMETRY_TEXT,
    ),
)
def parse_crop(spark, d):
    g = v.geometry_text(spark, d).select("id", tx.parse_crop("geom").alias("g"))
    return g.select("id", F.coalesce(F.concat_ws(",", "g.width", "g.height", "g.x", "g.y"), F.lit("-")).alias("crop")).withColumn(
        "crop", F.when(F.col("crop") == "", "-").otherwise(F.col("crop"))
    )


@query("mtime_text", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M') AS text FROM orders")
def mtime_text(spark, d):
    return v.table(spark, d, "orders").select("o_orderkey", tx.mtime_text("o_orderdate").alias("text"))


@query("sha256_hex", "SELECT page_id, sha256(html) AS digest FROM pages")
def sha256_hex(spark, d):
    return v.table(spark, d, "pages").select("page_id", binary.sha256_hex(F.col("html").cast("binary")).alias("digest"))
