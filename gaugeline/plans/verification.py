"""Queries that hold drawings against solids."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeline.constants import AXIAL_DATUMS, COARSE_PITCH, DOF, LOCATING, ORIENTING, RUNOUT
from gaugeline.operators import solids as S
from gaugeline.operators import verification as V
from gaugeline.plans.registry import register
from gaugeline.sources.fixtures import callouts, duck, view
from gaugeline.sources.shared import cut

KEY = "drawing_id"


def chars(spark, sf_dir):
    return callouts(spark, sf_dir, "gt_char", ("solid_id",))


def faces(spark, sf_dir):
    return view(spark, sf_dir, "face")


def envelope(spark, sf_dir):
    return view(spark, sf_dir, "envelope")


def quoted(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


FACE = """
us AS (SELECT * FROM face WHERE area >= 1e-6 AND surface <> 'other'), pl AS (SELECT * FROM us WHERE surface = 'plane'), cy AS (SELECT * FROM us WHERE surface = 'cylinder'),
pp AS (SELECT a.solid_id, a.ord AS a, b.ord AS b, abs(a.dx * a.cx + a.dy * a.cy + a.dz * a.cz - a.dx * b.cx - a.dy * b.cy - a.dz * b.cz) AS value FROM pl a JOIN pl b ON a.solid_id = b.solid_id AND a.ord < b.ord WHERE abs(abs(a.dx * b.dx + a.dy * b.dy + a.dz * b.dz) - 1) <= 1e-3),
ax AS (SELECT a.solid_id, a.ord AS a, b.ord AS b, sqrt((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2) AS value FROM cy a JOIN cy b ON a.solid_id = b.solid_id AND a.ord < b.ord),
ap AS (SELECT c.solid_id, c.ord AS a, p.ord AS b, abs((c.cx - p.cx) * p.dx + (c.cy - p.cy) * p.dy + (c.cz - p.cz) * p.dz) AS value FROM cy c JOIN pl p ON c.solid_id = p.solid_id WHERE abs(c.dz * p.dz + c.dx * p.dx) <= 1e-3),
ho AS (SELECT solid_id, round(radius, 4) AS radius, ord, cx - avg(cx) OVER w AS ox, cy - avg(cy) OVER w AS oy, count(*) OVER w AS n FROM cy WINDOW w AS (PARTITION BY solid_id, round(radius, 4))),
an AS (SELECT *, sqrt(ox * ox + oy * oy) AS far, CASE WHEN atan2(-ox, oy) < 0 THEN atan2(-ox, oy) + 2 * pi() ELSE atan2(-ox, oy) END AS ang FROM ho WHERE n >= 3),
ga AS (SELECT *, coalesce(lead(ang) OVER w, first_value(ang) OVER w + 2 * pi()) - ang AS gap FROM an WINDOW w AS (PARTITION BY solid_id, radius ORDER BY ang)),
hp AS (SELECT solid_id, radius, n AS count, 2 * avg(far) AS bolt_circle, max(abs(gap - 2 * pi() / n)) < radians(5) AS uniform FROM ga GROUP BY solid_id, radius, n HAVING avg(far) >= 1e-6 AND stddev_pop(far) <= 0.02 * avg(far)),
sz AS (SELECT DISTINCT solid_id, 'diameter' AS family, 'diameter' AS source, 0 AS rank, 2 * round(radius, 6) AS value FROM cy
 UNION ALL SELECT solid_id, 'diameter', 'bolt_circle', 1, bolt_circle FROM hp WHERE uniform
 UNION ALL SELECT solid_id, 'length', 'plane_pair', 0, value FROM pp WHERE value >= 1e-6 UNION ALL SELECT solid_id, 'length', 'axis_distance', 1, value FROM ax WHERE value >= 1e-6 UNION ALL SELECT solid_id, 'length', 'axis_to_plane', 2, value FROM ap WHERE value >= 1e-6
 UNION ALL SELECT solid_id, 'length', 'envelope', 3, unnest([ex, ey, ez]) FROM envelope UNION ALL SELECT solid_id, 'length', 'bolt_circle', 4, bolt_circle FROM hp WHERE uniform)"""
TARGET = """
gu AS (SELECT g.*, d.units, d.solid_id, d.image_w, d.image_h, d.general_tolerance, CASE WHEN d.units = 'inch' THEN 25.4::DOUBLE ELSE 1::DOUBLE END AS mm FROM gt_char g JOIN drawing d ON g.drawing_id = d.drawing_id),
ta AS (SELECT *, nominal * mm AS target, greatest(abs(coalesce(upper_tol * mm, 0)), abs(coalesce(lower_tol * mm, 0))) + 0.02 AS tight, CASE dim_type WHEN 'linear' THEN 'length' ELSE 'diameter' END AS family FROM gu WHERE kind = 'dimension' AND dim_type IN ('diameter', 'radius', 'linear') AND NOT is_reference),
tw AS (SELECT *, greatest(tight * 8, 0.5) AS wide FROM ta),
cn AS (SELECT * FROM (SELECT t.drawing_id, t.id, t.tight, s.source, s.rank, s.family, CASE t.dim_type WHEN 'radius' THEN s.value / 2 ELSE s.value END AS value, abs(CASE t.dim_type WHEN 'radius' THEN s.value / 2 ELSE s.value END - t.target) AS error, t.wide FROM tw t JOIN sz s ON t.solid_id = s.solid_id AND t.family = s.family) WHERE error <= wide),
cd AS (SELECT drawing_id, id, any_value(tight) AS tight, arg_min(value, (rank, value)) AS value, arg_min(error, (rank, value)) AS error, arg_min(source, (rank, value)) AS source FROM cn GROUP BY drawing_id, id, CASE WHEN family = 'length' THEN round_even(value, 4) ELSE value END, CASE WHEN family = 'length' THEN '' ELSE source END),
tp AS (SELECT DISTINCT t.drawing_id, t.id FROM tw t JOIN (VALUES """ + ", ".join(f"({k}::DOUBLE, {v}::DOUBLE)" for k, v in COARSE_PITCH.items()) + """) p(d, pitch) ON round_even(t.target, 3) = p.d JOIN cy c ON c.solid_id = t.solid_id AND 2 * c.radius BETWEEN t.target - p.pitch - 0.3 AND t.target - 0.5 * p.pitch + 0.3 WHERE t.dim_type = 'diameter'),
nv AS (SELECT DISTINCT t.drawing_id, t.id, t.target, CASE t.dim_type WHEN 'radius' THEN v / 2 ELSE v END AS v FROM tw t JOIN (SELECT DISTINCT solid_id, family, CASE WHEN family = 'length' THEN round_even(value, 4) ELSE value END AS v FROM sz WHERE source <> 'bolt_circle') s ON t.solid_id = s.solid_id AND t.family = s.family),
nr AS (SELECT *, row_number() OVER (PARTITION BY drawing_id, id ORDER BY abs(v - target), v) AS place FROM nv),
n2 AS (SELECT drawing_id, id, max(CASE WHEN place = 1 THEN v END) AS best, max(CASE WHEN place = 2 THEN v END) AS second FROM nr WHERE place <= 2 GROUP BY ALL),
sc AS (SELECT t.drawing_id, t.id, t.tight, t.target, t.units, c.n_any, c.near, c.least, tp.id IS NOT NULL AS tap, n2.best, n2.second FROM tw t LEFT JOIN (SELECT drawing_id, id, count(*) AS n_any, count(*) FILTER (error <= tight) AS near, min(error) AS least FROM cd GROUP BY ALL) c ON t.drawing_id = c.drawing_id AND t.id = c.id LEFT JOIN tp ON t.drawing_id = tp.drawing_id AND t.id = tp.id LEFT JOIN n2 ON t.drawing_id = n2.drawing_id AND t.id = n2.id),
sv AS (SELECT *, CASE WHEN near = 1 THEN 'verified' WHEN n_any > 0 OR tap THEN 'unverifiable' ELSE 'contradicted' END AS verdict FROM sc),
sk AS (SELECT drawing_id, id, 'size_exists' AS "check", verdict, CASE verdict WHEN 'verified' THEN round_even(least(1, 0.75 + 0.25 * (1 - least / greatest(tight, 1e-9))), 3) WHEN 'contradicted' THEN CASE WHEN best IS NULL THEN 0.6 WHEN abs(best - target) < 0.25 * target THEN 0.95 ELSE 0.75 END ELSE 0.5 END AS confidence,
  CASE WHEN verdict = 'contradicted' AND NOT coalesce(abs(second - target) < 1.6 * abs(best - target), false) THEN round_even(best / CASE WHEN units = 'inch' THEN 25.4 ELSE 1 END, 4) END AS correction FROM sv
 UNION ALL SELECT drawing_id, id, 'size_exists', 'unverifiable', 0.5, NULL FROM gt_char WHERE kind = 'dimension' AND is_reference)"""


@register("usable_faces", duck(f"WITH {FACE} SELECT solid_id, ord, surface FROM us"))
def usable_faces(spark, sf_dir):
    return S.usable(faces(spark, sf_dir)).select("solid_id", "ord", "surface")


def _relation(name: str, table: str, f):
    @register(name, duck(f"WITH {FACE} SELECT solid_id, a, b, round(value, 6) AS value FROM {table} WHERE value >= 1e-6"))
    def query(spark, sf_dir):
        return f(faces(spark, sf_dir)).withColumn("value", F.round("value", 6))


_relation("plane_pairs", "pp", S.plane_pairs)
_relation("axis_distances", "ax", S.axis_distances)
_relation("axis_to_plane", "ap", S.axis_to_plane)


@register("hole_patterns", duck(f"WITH {FACE} SELECT solid_id, radius, count, round(bolt_circle, 6) AS bolt_circle, uniform FROM hp"))
def hole_patterns(spark, sf_dir):
    return S.hole_patterns(faces(spark, sf_dir)).select("solid_id", "radius", "count", F.round("bolt_circle", 6).alias("bolt_circle"), "uniform")


@register("distinct_diameters", duck(f"WITH {FACE} SELECT DISTINCT solid_id, 2 * round(radius, 6) AS diameter FROM cy"))
def distinct_diameters(spark, sf_dir):
    return S.sizes(faces(spark, sf_dir), envelope(spark, sf_dir)).where("source = 'diameter'").select("solid_id", F.col("value").alias("diameter"))


@register("index_stats", duck(f"WITH {FACE}, n AS (SELECT solid_id, count(*) AS faces, count(*) FILTER (area >= 1e-6 AND surface <> 'other') AS usable, count(*) FILTER (NOT (area >= 1e-6 AND surface <> 'other')) AS skipped, count(*) FILTER (surface = 'cylinder') AS cylinders, 0::BIGINT AS cones, count(*) FILTER (surface = 'plane' AND area >= 1e-6) AS planes FROM face GROUP BY 1) SELECT n.*, (SELECT count(*) FROM pp WHERE pp.solid_id = n.solid_id AND value >= 1e-6) AS plane_pairs, (SELECT count(*) FROM hp WHERE hp.solid_id = n.solid_id) AS hole_patterns FROM n"))
def index_stats(spark, sf_dir):
    return S.stats(faces(spark, sf_dir))


@register("envelope_sorted", duck("SELECT solid_id, list_reverse_sort([ex, ey, ez])[1] AS longest, list_reverse_sort([ex, ey, ez])[3] AS shortest FROM envelope"))
def envelope_sorted(spark, sf_dir):
    ordered = F.sort_array(F.array("ex", "ey", "ez"), asc=False)
    return envelope(spark, sf_dir).select("solid_id", F.element_at(ordered, 1).alias("longest"), F.element_at(ordered, 3).alias("shortest"))


@register("size_candidates", duck(f"WITH {FACE}, {TARGET} SELECT drawing_id, id, round(value, 6) AS value, round(error, 6) AS error, source FROM cd"))
def size_candidates(spark, sf_dir):
    found = V.candidates(V.checkable(chars(spark, sf_dir)), faces(spark, sf_dir), envelope(spark, sf_dir))
    return found.select(KEY, "id", F.round("value", 6).alias("value"), F.round("error", 6).alias("error"), "source")


@register("tap_drills", duck(f"WITH {FACE}, {TARGET} SELECT * FROM tp"))
def tap_drills(spark, sf_dir):
    return V.tap_drills(V.checkable(chars(spark, sf_dir)), faces(spark, sf_dir))


@register("nearest_sizes", duck(f"WITH {FACE}, {TARGET} SELECT drawing_id, id, place::INT AS place, round(v, 6) AS value FROM nr WHERE place <= 3"))
def nearest_sizes(spark, sf_dir):
    near = V.nearest(V.checkable(chars(spark, sf_dir)), faces(spark, sf_dir), envelope(spark, sf_dir))
    return near.select(KEY, "id", F.posexplode("nearby").alias("p", "v")).select(KEY, "id", (F.col("p") + 1).alias("place"), F.round("v", 6).alias("value"))


@register("size_check", duck(f"WITH {FACE}, {TARGET} SELECT drawing_id, id, verdict, confidence::DOUBLE AS confidence, correction FROM sk"))
def size_check(spark, sf_dir):
    return V.size_check(chars(spark, sf_dir), faces(spark, sf_dir), envelope(spark, sf_dir)).drop("check")


DOF_SQL = "CASE t " + " ".join(f"WHEN '{k}' THEN [{', '.join(map(str, v))}]" for k, v in DOF.items()) + " ELSE [0, 0, 0] END"
FRAMES = f"""
ft AS (SELECT g.drawing_id, g.id, g.gtol_symbol, r.pos, r.label, d.feature_type AS t FROM gt_char g JOIN datum_ref r ON g.drawing_id = r.drawing_id AND g.id = r.id LEFT JOIN datum d ON d.drawing_id = g.drawing_id AND d.label = r.label),
fs AS (SELECT drawing_id, id, gtol_symbol, bool_or(t IS NULL) AS undeclared, bool_or(coalesce(t IN ({quoted(AXIAL_DATUMS)}), false)) AS axial, least(6, sum(({DOF_SQL})[pos + 1])) AS dof FROM ft GROUP BY ALL),
fd AS (SELECT drawing_id, id, CASE WHEN undeclared THEN 'undeclared_datum' WHEN gtol_symbol IN ({quoted(RUNOUT)}) AND NOT axial THEN 'runout_without_an_axis' WHEN gtol_symbol IN ({quoted(ORIENTING)}) AND dof < 3 THEN 'underconstrained_drf' WHEN gtol_symbol IN ({quoted(LOCATING)}) AND dof < CASE WHEN axial THEN 5 ELSE 6 END THEN 'underconstrained_drf' END AS type FROM fs)"""


@register("constrained_dof", duck(f"WITH {FRAMES} SELECT drawing_id, id, dof::INT AS dof FROM fs"))
def constrained_dof(spark, sf_dir):
    rows = V.frame_types(chars(spark, sf_dir).where("size(datum_refs) > 0"), view(spark, sf_dir, "datum"))
    return rows.select(KEY, "id", V.constrained(F.col("types")).alias("dof"))


@register("frame_check", duck(f"WITH {FRAMES} SELECT * FROM fd WHERE type IS NOT NULL"))
def frame_check(spark, sf_dir):
    return V.frame_check(chars(spark, sf_dir), view(spark, sf_dir, "datum"))


@register("undeclared_datums", duck("SELECT DISTINCT r.drawing_id, r.label FROM datum_ref r ANTI JOIN datum d ON r.drawing_id = d.drawing_id AND r.label = d.label"))
def undeclared_datums(spark, sf_dir):
    return view(spark, sf_dir, "datum_ref").join(view(spark, sf_dir, "datum"), [KEY, "label"], "left_anti").select(KEY, "label").distinct()


@register("unused_datums", duck("SELECT d.drawing_id, d.label FROM datum d ANTI JOIN datum_ref r ON r.drawing_id = d.drawing_id AND r.label = d.label"))
def unused_datums(spark, sf_dir):
    return V.unused_datums(chars(spark, sf_dir), view(spark, sf_dir, "datum"))


LINKS = """
fr AS (SELECT * FROM gu WHERE kind = 'geometric_tolerance' AND material_modifier IS NOT NULL),
lk AS (SELECT f.drawing_id, f.id, s.id AS size_id, s.nominal * f.mm AS nominal, coalesce(s.upper_tol * f.mm, 0) AS up, coalesce(s.lower_tol * f.mm, 0) AS lo, s.dim_type, s.raw_text,
  greatest(0, least(f.x1, s.x1) - greatest(f.x0, s.x0)) * greatest(0, least(f.y1, s.y1) - greatest(f.y0, s.y0)) AS inter, (f.x1 - f.x0) * (f.y1 - f.y0) + (s.x1 - s.x0) * (s.y1 - s.y0) AS areas,
  sqrt(((f.x0 + f.x1) / 2 - (s.x0 + s.x1) / 2) ** 2 + ((f.y0 + f.y1) / 2 - (s.y0 + s.y1) / 2) ** 2) / sqrt(f.image_w ** 2 + f.image_h ** 2) AS far
  FROM fr f JOIN gu s ON s.drawing_id = f.drawing_id AND s.view = f.view AND s.kind = 'dimension'),
lb AS (SELECT * FROM lk WHERE inter > 0 OR far <= 0.06 QUALIFY row_number() OVER (PARTITION BY drawing_id, id ORDER BY inter / (areas - inter) DESC, far, size_id) = 1),
mv AS (SELECT f.drawing_id, f.id, f.solid_id, f.general_tolerance, b.size_id, b.nominal, abs(b.up - b.lo) AS span, b.dim_type = 'diameter' AND contains(b.raw_text, '⌀') AS internal, f.gtol_value * f.mm AS zone, b.up, b.lo FROM fr f LEFT JOIN lb b ON f.drawing_id = b.drawing_id AND f.id = b.id),
br AS (SELECT DISTINCT m.drawing_id, m.id FROM mv m JOIN hp ON hp.solid_id = m.solid_id WHERE m.internal AND m.span > 1e-9 AND abs(2 * hp.radius - m.nominal) <= 0.5 AND hp.bolt_circle * sin(pi() / hp.count) <= m.nominal + m.lo - m.zone),
mm AS (SELECT m.*, br.id IS NOT NULL AS breach FROM mv m LEFT JOIN br ON m.drawing_id = br.drawing_id AND m.id = br.id),
mk AS (SELECT drawing_id, id, CASE WHEN size_id IS NULL OR (span <= 1e-9 AND general_tolerance IS NOT NULL) OR breach THEN 'unverifiable' ELSE 'verified' END AS verdict FROM mm WHERE size_id IS NULL OR span > 1e-9 OR general_tolerance IS NOT NULL UNION ALL SELECT drawing_id, id, 'unverifiable' FROM gt_char WHERE kind = 'geometric_tolerance' AND material_modifier IS NULL AND ref_modifier IS NOT NULL),
md AS (SELECT drawing_id, id, CASE WHEN span <= 1e-9 THEN 'modifier_without_size_tolerance' ELSE 'virtual_condition_interference' END AS type FROM mm WHERE (size_id IS NOT NULL AND span <= 1e-9 AND general_tolerance IS NULL) OR breach)"""


@register("linked_sizes", duck(f"WITH {FACE}, {TARGET}, {LINKS} SELECT drawing_id, id, size_id FROM mv"))
def linked_sizes(spark, sf_dir):
    return V.linked_sizes(chars(spark, sf_dir), view(spark, sf_dir, "drawing")).select(KEY, "id", F.col("size.id").alias("size_id"))


@register("modifier_verdicts", duck(f"WITH {FACE}, {TARGET}, {LINKS} SELECT * FROM mk"))
def modifier_verdicts(spark, sf_dir):
    return V.modifier_check(chars(spark, sf_dir), view(spark, sf_dir, "drawing"), faces(spark, sf_dir))[0].select(KEY, "id", "verdict")


@register("modifier_defects", duck(f"WITH {FACE}, {TARGET}, {LINKS} SELECT * FROM md"))
def modifier_defects(spark, sf_dir):
    return V.modifier_check(chars(spark, sf_dir), view(spark, sf_dir, "drawing"), faces(spark, sf_dir))[1]


CHAIN = """
ln AS (SELECT drawing_id, view, id, nominal * mm AS v, coalesce(abs(upper_tol * mm - lower_tol * mm), 0) AS t FROM gu WHERE kind = 'dimension' AND dim_type = 'linear' AND NOT is_reference AND nominal > 0),
c2 AS (SELECT t.drawing_id, t.view, t.id, t.v AS tv, t.t AS tt, [a.id, b.id] AS ids, a.v + b.v AS s, a.t + b.t AS st, least(a.t, b.t, t.t) AS mt FROM ln t JOIN ln a ON a.drawing_id = t.drawing_id AND a.view = t.view AND a.id <> t.id AND a.v >= 0.05 * t.v JOIN ln b ON b.drawing_id = t.drawing_id AND b.view = t.view AND b.id <> t.id AND b.id > a.id AND b.v >= 0.05 * t.v),
c3 AS (SELECT c.drawing_id, c.view, c.id, tv, tt, list_append(ids, d.id) AS ids, s + d.v AS s, st + d.t AS st, least(mt, d.t) AS mt FROM c2 c JOIN ln d ON d.drawing_id = c.drawing_id AND d.view = c.view AND d.id <> c.id AND d.id > ids[2] AND d.v >= 0.05 * tv),
ch AS (SELECT *, list_sort(list_append(ids, id)) AS members FROM (SELECT * FROM c2 UNION ALL SELECT * FROM c3) WHERE abs(s - tv) <= greatest(mt * 0.1, 0.01)),
cf AS (SELECT * FROM ch QUALIFY row_number() OVER (PARTITION BY drawing_id, view, members ORDER BY id, len(ids), ids) = 1)"""


@register("chain_check", duck(f"WITH {FACE}, {TARGET}, {CHAIN} SELECT * FROM (SELECT drawing_id, id, CASE WHEN tt > 0 AND st > 0 THEN 'overdimensioned_chain' WHEN st > tt + 1e-9 THEN 'tolerance_accumulation' END AS type, array_to_string(ids, ',') AS parts FROM cf) WHERE type IS NOT NULL"))
def chain_check(spark, sf_dir):
    return V.chain_check(chars(spark, sf_dir))


@register("unit_check", duck(f"WITH {FACE}, {TARGET}, u AS (SELECT drawing_id, solid_id, max(nominal * mm) AS largest FROM gu WHERE kind = 'dimension' AND dim_type IN ('linear', 'diameter', 'radius') GROUP BY ALL), r AS (SELECT drawing_id, largest / greatest(ex, ey, ez) AS ratio FROM u JOIN envelope e ON u.solid_id = e.solid_id) SELECT drawing_id, 'unit_mismatch' AS type, CASE WHEN abs(ratio - 1 / 25.4::DOUBLE) <= (0.35::DOUBLE * (1 / 25.4::DOUBLE)) THEN 'inches as millimetres' ELSE 'millimetres as inches' END AS looks_like FROM r WHERE abs(ratio - 1) > 0.35::DOUBLE AND (abs(ratio - 1 / 25.4::DOUBLE) <= (0.35::DOUBLE * (1 / 25.4::DOUBLE)) OR abs(ratio - 25.4::DOUBLE) <= (0.35::DOUBLE * 25.4::DOUBLE))"))
def unit_check(spark, sf_dir):
    return V.unit_check(chars(spark, sf_dir), envelope(spark, sf_dir))


REDUCED = """
vv AS (SELECT drawing_id, id, verdict, confidence, "check", 0 AS seq FROM sk UNION ALL SELECT drawing_id, id, verdict, CASE verdict WHEN 'verified' THEN 0.85 ELSE 0.5 END, 'mmc_consistency', 1 FROM mk),
rd AS (SELECT g.drawing_id, g.id, coalesce(v.verdict, 'unverifiable') AS verdict, coalesce(v."check", 'none') AS "check", coalesce(v.confidence, 0.5)::DOUBLE AS confidence FROM gt_char g LEFT JOIN (SELECT * FROM vv QUALIFY row_number() OVER (PARTITION BY drawing_id, id ORDER BY CASE verdict WHEN 'contradicted' THEN 2 WHEN 'unverifiable' THEN 1 ELSE 0 END DESC, confidence DESC, seq) = 1) v ON g.drawing_id = v.drawing_id AND g.id = v.id)"""


def verdicts(spark, sf_dir):
    c, solid = cut(chars(spark, sf_dir)), cut(faces(spark, sf_dir))  # each check reads both
    every = V.size_check(c, solid, envelope(spark, sf_dir)).drop("correction").unionByName(V.modifier_check(c, view(spark, sf_dir, "drawing"), solid)[0])
    return V.reduced(c, every)


@register("verify_drawings", duck(f"WITH {FACE}, {TARGET}, {LINKS}, {REDUCED} SELECT * FROM rd"))
def verify_drawings(spark, sf_dir):
    return verdicts(spark, sf_dir)


@register("verdict_summary", duck(f"WITH {FACE}, {TARGET}, {LINKS}, {REDUCED} SELECT drawing_id, count(*) FILTER (verdict = 'verified') AS verified, count(*) FILTER (verdict = 'unverifiable') AS unverifiable, count(*) FILTER (verdict = 'contradicted') AS contradicted FROM rd GROUP BY 1"))
def verdict_summary(spark, sf_dir):
    return V.verdict_summary(verdicts(spark, sf_dir))
