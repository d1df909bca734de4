"""Queries over part parameters and sheet layout."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeline.functions import tables
from gaugeline.operators import parts
from gaugeline.plans.registry import register
from gaugeline.sources.fixtures import callouts, duck, view

KEY = "drawing_id"


def _u(*parts_: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws(':', '1', {', '.join(parts_)})), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE"


def _list(values) -> str:
    return "[" + ", ".join(f"{v}::DOUBLE" for v in values) + "]"


def _pick(values, name: str) -> str:
    return f"{_list(values)}[CAST(floor({_u(f"'{name}'", 'seed', 'attempt')} * {len(values)}) AS INT) + 1]"


def _snap(x: str, values) -> str:
    return f"(SELECT arg_min(v, (abs({x} - v), v)) FROM (SELECT unnest({_list(values)}) AS v))"


HOLES = "CASE bolt " + " ".join(f"WHEN {k} THEN {v}::DOUBLE" for k, v in parts.CLEARANCE.items()) + " END"
DRAWS = f"""d0 AS (SELECT seed, attempt, {_pick(tables.renard(10, 63.0, 400.0), 'od')} AS od, {_pick(sorted(parts.CLEARANCE), 'bolt')} AS bolt, {_pick([float(c) for c in parts.COUNTS], 'count')}::INT AS bolt_count FROM (SELECT unnest(range(200)) AS seed) CROSS JOIN (SELECT unnest(range(50)) AS attempt)),
d1 AS (SELECT *, {_snap(f"(od * (0.25::DOUBLE + 0.25::DOUBLE * ({_u("'bore'", 'seed', 'attempt')})))", parts.R10)} AS bore, {_snap(f"(od * (0.08::DOUBLE + 0.10::DOUBLE * ({_u("'thickness'", 'seed', 'attempt')})))", parts.R20)} AS thickness, {HOLES} AS bolt_hole FROM d0),
d2 AS (SELECT *, {_snap("((bore + bolt_hole * 2 + od - bolt_hole * 2.5::DOUBLE) / 2)", parts.R20)} AS bcd, least(CASE WHEN bore >= 20 THEN 1 ELSE 0.5 END::DOUBLE, thickness / 3) AS bore_chamfer FROM d1),
fl AS (SELECT *, CASE WHEN bore >= od * 0.8::DOUBLE THEN 'no rim' WHEN (od - bcd) / 2 - bolt_hole / 2 < bolt_hole * 0.75::DOUBLE THEN 'edge distance' WHEN (bcd - bore) / 2 - bolt_hole / 2 < bolt_hole * 0.5::DOUBLE THEN 'bore wall' WHEN pi() * bcd / bolt_count < bolt_hole * 2 THEN 'hole pitch' WHEN bore_chamfer * 2 >= thickness THEN 'chamfer' END AS fault FROM d2)"""


@register("flange_rejects", f"WITH {DRAWS} SELECT coalesce(fault, 'none') AS fault, count(*) AS n FROM fl GROUP BY 1")
def flange_rejects(spark, sf_dir):
    return parts.flange_draws(spark, 200).groupBy(F.coalesce(parts.flange_faults(), F.lit("none")).alias("fault")).agg(F.count(F.lit(1)).alias("n"))


@register("flange_params", f"WITH {DRAWS} SELECT seed, attempt::INT AS attempt, od, bore, thickness, bolt, bolt_hole, bcd, bolt_count, bore_chamfer FROM fl WHERE fault IS NULL QUALIFY row_number() OVER (PARTITION BY seed ORDER BY attempt) = 1")
def flange_params(spark, sf_dir):
    return parts.flanges(spark, 200)


SCORE = """CASE WHEN kind = 'geometric_tolerance' THEN CASE WHEN gtol_symbol = 'position' THEN 3 ELSE 1.5 END * (1 + least(2, 0.1 / greatest(coalesce(nullif(gtol_value, 0), 1), 1e-3)))
WHEN kind <> 'dimension' THEN 0.2 WHEN upper_tol IS NULL OR lower_tol IS NULL THEN 0.3 WHEN abs(upper_tol - lower_tol) / greatest(abs(coalesce(nullif(nominal, 0), 1)), 1e-6) < 0.002 THEN 2 ELSE 1 END::DOUBLE"""


@register("criticality", duck(f"SELECT drawing_id, id, round({SCORE}, 6) AS weight FROM gt_char"))
def criticality(spark, sf_dir):
    return callouts(spark, sf_dir, "gt_char").select(KEY, "id", F.round(parts.criticality(), 6).alias("weight"))


@register("mark_critical", duck(f"""WITH w AS (SELECT *, {SCORE} AS weight, count(*) OVER (PARTITION BY drawing_id) AS n FROM gt_char), r AS (SELECT *, row_number() OVER (PARTITION BY drawing_id ORDER BY -ln({_u("'critical'", 'drawing_id', 'id')} + 1e-12::DOUBLE) / weight, id) AS place FROM w WHERE kind IN ('dimension', 'geometric_tolerance'))
SELECT drawing_id, id FROM r WHERE place <= greatest(1, round_even(n * 0.15::DOUBLE, 0))"""))
def mark_critical(spark, sf_dir):
    return parts.mark_critical(callouts(spark, sf_dir, "gt_char"))


@register("position_zones", "SELECT p_partkey, round_even(least(greatest(p_size * 0.03::DOUBLE, 0.1), 0.6), 2)::DOUBLE AS zone FROM part")
def position_zones(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", parts.position_zone(F.col("p_size").cast("double")).alias("zone"))


@register("position_refs", duck("SELECT drawing_id, array_to_string((list(label ORDER BY label))[1:3], ',') AS refs FROM datum GROUP BY 1"))
def position_refs(spark, sf_dir):
    return view(spark, sf_dir, "datum").groupBy(KEY).agg(F.collect_list("label").alias("labels")).select(KEY, F.array_join(parts.position_refs(F.col("labels")), ",").alias("refs"))


@register("sheet_scales", "SELECT p_partkey, CASE WHEN (p_size + 50) * 10 <= 200 THEN 10 WHEN (p_size + 50) * 5 <= 200 THEN 5 WHEN (p_size + 50) * 2 <= 200 THEN 2 WHEN (p_size + 50) <= 200 THEN 1 ELSE 0.5 END::DOUBLE AS scale FROM part")
def sheet_scales(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", parts.scale_for((F.col("p_size") + 50).cast("double"), 200.0).alias("scale"))
