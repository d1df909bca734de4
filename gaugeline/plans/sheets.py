"""Queries over views, parts, page regions and the text reader."""

from __future__ import annotations

import zlib

from pyspark.sql import functions as F

from gaugeline.operators import baselines, sheets
from gaugeline.plans.registry import register
from gaugeline.sources.fixtures import duck, view

VIEWS = (("top", 0, 0.0, 0.0, 1.0), ("front", 1, 0.0, 1.0, 0.0), ("iso", 2, 0.6, 0.0, 0.8))
VIEWS_SQL = "(VALUES " + ", ".join(f"('{v}', {p}, {x}::DOUBLE, {y}::DOUBLE, {z}::DOUBLE)" for v, p, x, y, z in VIEWS) + ") v(view, pos, vx, vy, vz)"


@register("view_choice", duck(f"WITH s AS (SELECT solid_id, ord, v.view, pos, abs(dx * vx + dy * vy + dz * vz) AS c FROM face JOIN {VIEWS_SQL} ON true) SELECT solid_id, ord, CASE WHEN max(c) > 0.99 THEN arg_min(view, (-c, pos)) END AS circular, CASE WHEN min(c) < 0.01 THEN arg_min(view, (c, pos)) END AS edge_on FROM s GROUP BY ALL"))
def view_choice(spark, sf_dir):
    views = spark.createDataFrame(VIEWS, "view string, pos int, vx double, vy double, vz double")
    return sheets.view_choice(view(spark, sf_dir, "face"), views)


FEATURES = """SELECT solid_id, concat('f', CAST(CASE WHEN ord = 3 AND solid_id % 20 = 0 THEN 2 ELSE ord END AS VARCHAR(9))) AS fid, CASE WHEN solid_id % 7 = 0 AND ord = 1 THEN 99 ELSE ord END AS face, CASE WHEN ord = 2 THEN CASE WHEN solid_id % 11 = 0 THEN 'f88' ELSE 'f0' END END AS parent FROM face WHERE ord < 4"""


@register(
    "part_faults",
    duck(f"""WITH x AS ({FEATURES}) SELECT solid_id, fid, 'duplicate id' AS reason FROM x GROUP BY 1, 2 HAVING count(*) > 1 UNION SELECT solid_id, fid, 'unknown face' FROM x WHERE face = 99
UNION SELECT solid_id, fid, 'unknown parent' FROM x WHERE parent IS NOT NULL AND NOT EXISTS (SELECT 1 FROM x y WHERE y.solid_id = x.solid_id AND y.fid = x.parent)"""),
)
def part_faults(spark, sf_dir):
    faces = view(spark, sf_dir, "face")
    faces.createOrReplaceTempView("__face_features")
    features = spark.sql(FEATURES.replace("FROM face", "FROM __face_features"))
    features = features.select("solid_id", "fid", F.array("face").alias("faces"), "parent", F.create_map(F.lit("size"), F.lit(1.0)).alias("nominal"))
    return sheets.part_faults(features, faces.select("solid_id", F.col("ord").alias("fid")))


RECTS = """SELECT drawing_id AS page_id, r.k, CASE r.k WHEN 0 THEN 10 WHEN 1 THEN 300 WHEN 2 THEN 50 ELSE 100 END::DOUBLE AS x0, CASE r.k WHEN 0 THEN 10 WHEN 1 THEN 480 WHEN 2 THEN 200 ELSE 12 END::DOUBLE AS y0,
CASE r.k WHEN 0 THEN CASE WHEN drawing_id % 6 = 0 THEN 200 ELSE 790 END WHEN 1 THEN 785 WHEN 2 THEN 250 ELSE 300 + drawing_id % 100 END::DOUBLE AS x1, CASE r.k WHEN 0 THEN 590 WHEN 1 THEN 588 WHEN 2 THEN 300 ELSE 30 + drawing_id % 40 END::DOUBLE AS y1 FROM drawing CROSS JOIN (VALUES (0), (1), (2), (3)) r(k)"""


@register(
    "sheet_regions",
    duck(f"""WITH a AS (SELECT *, greatest(0, x1 - x0) * greatest(0, y1 - y0) AS area FROM ({RECTS})), f AS (SELECT page_id, x0 AS fx0, y0 AS fy0, x1 AS fx1, y1 AS fy1, area AS fa, k AS fk FROM a WHERE area >= 0.6 * 480000 QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY area DESC) = 1)
SELECT f.page_id, fx1, count(*) FILTER (k <> fk AND area >= 0.02 * fa AND x0 >= fx0 - 1 AND y1 <= fy1 + 1 AND (abs(y1 - fy1) < 0.02 * (fy1 - fy0) OR abs(y0 - fy0) < 0.02 * (fy1 - fy0)))::INT AS excluded FROM f JOIN a ON a.page_id = f.page_id GROUP BY ALL"""),
)
def sheet_regions(spark, sf_dir):
    view(spark, sf_dir, "drawing").createOrReplaceTempView("__drawing_rects")
    rects = spark.sql(RECTS.replace("FROM drawing", "FROM __drawing_rects").replace("END::DOUBLE AS", "END * CAST(1 AS DOUBLE) AS"))
    rects = rects.select("page_id", F.struct("x0", "y0", "x1", "y1").alias("box"), F.lit(480000.0).alias("page_area"))
    return baselines.sheet_regions(rects).select("page_id", F.col("frame.x1").alias("fx1"), F.size("excluded").alias("excluded"))


@register("text_widths", "SELECT p_partkey, round((length(p_name) * 0.5 + (length(p_name) - length(replace(p_name, 'i', ''))) * -0.3) * 3 / 0.7, 6)::DOUBLE AS width FROM part")
def text_widths(spark, sf_dir):
    width = sheets.text_width(F.col("p_name"), F.lit(3.0), {"i": 0.2}, other=0.5, cap=0.7)
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.round(width, 6).alias("width"))


# CRC-32 of the five families' names, which DuckDB cannot compute.
FAMILY_SUMS = {name: zlib.crc32(name.encode()) for name in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")}


@register("drawing_seeds", duck(f"SELECT drawing_id, (drawing_id * 1000003 + CASE family {' '.join(f"WHEN '{k}' THEN {v}" for k, v in FAMILY_SUMS.items())} END) % 4294967296 AS seed FROM drawing"))
def drawing_seeds(spark, sf_dir):
    """Seeds of part and family."""
    return view(spark, sf_dir, "drawing").select("drawing_id", sheets.drawing_seed(F.col("drawing_id"), F.col("family")).alias("seed"))
