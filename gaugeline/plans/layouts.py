"""Queries over limits and their rules, boxes on sheets, and the order and place of views and callouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeline.functions import boxes, tables
from gaugeline.functions.writing import value_text
from gaugeline.operators import degrade, layout, parts, perturb
from gaugeline.plans.drawings import IT_SQL, LOWS, SEED, SIZED, _sized, boxed_datums, chars
from gaugeline.plans.parts import SCORE
from gaugeline.plans.registry import register, sql_of
from gaugeline.sources import files
from gaugeline.sources.fixtures import duck, view

KEY = "drawing_id"

# --- limits


@register(
    "limit_sizes",
    f"""WITH f AS ({sql_of("fit_limits")}), s AS (SELECT f.*, p_size * 5::DOUBLE + lower_dev AS low, p_size * 5::DOUBLE + upper_dev AS high, regexp_extract(fit, '^[A-Za-z]+') = upper(regexp_extract(fit, '^[A-Za-z]+')) AS hole FROM f JOIN part p ON p.p_partkey = f.p_partkey)
SELECT p_partkey, fit, round(upper_dev - lower_dev, 6) AS width, round(CASE WHEN hole THEN low ELSE high END, 6) AS most_material, round(CASE WHEN hole THEN high ELSE low END, 6) AS least_material, round(low, 6) AS low, round(high, 6) AS high FROM s""",
)
def limit_sizes(spark, sf_dir):
    rows = _sized(spark, sf_dir).withColumn("fit", F.concat("letter", F.col("g").cast("string")))
    rows = rows.withColumn("s", tables.limit_sizes(F.col("d"), tables.fit_limits(F.col("d"), F.col("fit")), F.col("letter") == F.upper("letter")))
    return rows.select("p_partkey", "fit", *(F.round(f"s.{c}", 6).alias(c) for c in ("width", "most_material", "least_material", "low", "high")))


MEAN = f"sqrt((({LOWS})[i] * ([{', '.join(map(str, tables.RANGES))}])[i])::DOUBLE)"
TIMES = "CASE g " + " ".join(f"WHEN {k} THEN {v}" for k, v in tables.MULTIPLES.items()) + " END"
STEP = IT_SQL.replace("CASE g ", "CASE {} ")
POWER = "CASE lower(letter) " + " ".join(f"WHEN '{k}' THEN {a}::DOUBLE * pow({MEAN}, {b}::DOUBLE)" for k, (a, b) in tables.POWERS.items()) + f" WHEN 'm' THEN ({STEP.format(7)})[i] - ({STEP.format(6)})[i] END"


@register("formula_widths", duck(f"WITH {SIZED} SELECT p_partkey, round({TIMES} * (0.45::DOUBLE * pow({MEAN}, {1 / 3}::DOUBLE) + 0.001::DOUBLE * {MEAN}) * 1e-3, 6) AS width FROM r"))
def formula_widths(spark, sf_dir):
    return _sized(spark, sf_dir).select("p_partkey", F.round(tables.formula_width(F.col("d"), F.col("g")), 6).alias("width"))


@register("formula_deviations", duck(f"WITH {SIZED} SELECT p_partkey, round(({POWER}) * 1e-3, 6) + 0.0 AS deviation FROM r"))
def formula_deviations(spark, sf_dir):
    return _sized(spark, sf_dir).select("p_partkey", (F.round(tables.formula_deviation(F.col("d"), F.lower("letter")), 6) + 0.0).alias("deviation"))


# --- boxes

PADDED = "least(x0, 5 * (drawing_id % 3)) - 2 AS x0, least(y0, 40) - 2 AS y0, greatest(x1, 5 * (drawing_id % 3) + 7) + 2 AS x1, greatest(y1, 40) + 2 AS y1"


@register("padded_hulls", duck(f"SELECT drawing_id, id, {PADDED} FROM gt_char"))
def padded_hulls(spark, sf_dir):
    """Callouts with a segment on their sheet, and a margin around both."""
    x = (5 * (F.col(KEY) % 3)).cast("double")
    segment = boxes.around(F.array(F.struct(x.alias("x"), F.lit(40.0).alias("y")), F.struct((x + 7).alias("x"), F.lit(40.0).alias("y"))))
    rows = chars(spark, sf_dir).withColumn("segment", segment)
    return rows.select(KEY, "id", boxes.padded(boxes.hull(F.array("bbox", "segment")), 2.0).alias("b")).select(KEY, "id", "b.*")


@register("least_extents", duck("SELECT drawing_id, id, CASE WHEN x1 - x0 < 55 THEN (x0 + x1) / 2 - 27.5 ELSE x0 END::DOUBLE AS x0, CASE WHEN x1 - x0 < 55 THEN (x0 + x1) / 2 + 27.5 ELSE x1 END::DOUBLE AS x1, CASE WHEN y1 - y0 < 55 THEN (y0 + y1) / 2 - 27.5 ELSE y0 END::DOUBLE AS y0, CASE WHEN y1 - y0 < 55 THEN (y0 + y1) / 2 + 27.5 ELSE y1 END::DOUBLE AS y1 FROM gt_char"))
def least_extents(spark, sf_dir):
    return chars(spark, sf_dir).select(KEY, "id", boxes.widened(F.col("bbox"), 55.0).alias("b")).select(KEY, "id", "b.*")


@register("view_bounds", duck("SELECT solid_id, 40 + solid_id % 50 AS x0, 30.0::DOUBLE AS y0, 40 + solid_id % 50 + ex * 0.5::DOUBLE AS x1, 30 + ez * 0.5::DOUBLE AS y1, 40 + solid_id % 50 + ex * 0.25::DOUBLE AS label_x, 21.25::DOUBLE AS label_y FROM envelope"))
def view_bounds(spark, sf_dir):
    """The front view of each solid on its sheet at half size, and where its label stands."""
    rows = view(spark, sf_dir, "envelope")
    b = boxes.view_box(boxes.box(F.lit(0.0), F.lit(0.0), F.col("ex"), F.col("ez")), (40 + F.col("solid_id") % 50, F.lit(30.0)), F.lit(0.5))
    rows = rows.select("solid_id", b.alias("b"))
    x, y = boxes.label_spot(F.col("b"), 3.5)
    return rows.select("solid_id", "b.*", x.alias("label_x"), y.alias("label_y"))


LEADER = "hh % 3 = 0"


@register(
    "all_boxes",
    duck(f"""SELECT drawing_id, 'datum' AS kind, label AS owner, 'bbox' AS attribute, x0, y0, x1, y1 FROM datum UNION ALL SELECT drawing_id, 'characteristic', CAST(id AS VARCHAR), 'bbox', x0, y0, x1, y1 FROM gt_char
UNION ALL SELECT drawing_id, 'characteristic', CAST(id AS VARCHAR), 'leader', x0 - 30, y0 - 20, x1 - 30, y1 - 20 FROM gt_char WHERE {LEADER}"""),
)
def all_boxes(spark, sf_dir):
    rows = chars(spark, sf_dir).withColumn("leader", F.when(F.expr(LEADER), layout.moved(F.col("bbox"), F.lit(-30.0), F.lit(-20.0))))
    return degrade.all_boxes(rows, boxed_datums(spark, sf_dir)).select(KEY, "kind", "owner", "attribute", "box.*")


# --- places

CELLS = (("front", 0, 0, "ex", "ez"), ("top", 0, 1, "ex", "ey"), ("right", 1, 0, "ey", "ez"), ("iso", 1, 1, "ez", "ex"))
CELLS_SQL = " UNION ALL ".join(f"SELECT solid_id, '{v}' AS view, {{s}} * {c} AS col, {{s}} * {r} AS r, {w} AS wide, {h} AS high FROM envelope" for v, c, r, w, h in CELLS)
GRID_SQL = """WITH v AS ({cells}), c AS (SELECT solid_id, col, max(wide) AS most FROM v GROUP BY ALL), r AS (SELECT solid_id, r, max(high) AS most FROM v GROUP BY ALL),
cx AS (SELECT solid_id, col, coalesce(sum(most + 12) OVER (PARTITION BY solid_id ORDER BY col ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + most / 2 AS x FROM c),
cy AS (SELECT solid_id, r, coalesce(sum(most + 12) OVER (PARTITION BY solid_id ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + most / 2 AS y FROM r)
SELECT v.solid_id, v.view, x, y FROM v JOIN cx ON v.solid_id = cx.solid_id AND v.col = cx.col JOIN cy ON v.solid_id = cy.solid_id AND v.r = cy.r"""


def _grid(spark, sf_dir, third_angle):
    cells = F.array(*(F.struct(F.lit(v).alias("view"), F.lit(c).alias("col"), F.lit(r).alias("row"), F.col(w).alias("wide"), F.col(h).alias("high")) for v, c, r, w, h in CELLS))
    views = view(spark, sf_dir, "envelope").select("solid_id", F.explode(cells).alias("v")).select("solid_id", "v.*")
    return layout.grid_centres(views, gap=12.0, key="solid_id", third_angle=third_angle)


@register("layout_grid", duck(GRID_SQL.format(cells=CELLS_SQL.format(s="1"))))
def layout_grid(spark, sf_dir):
    return _grid(spark, sf_dir, True)


@register("layout_grid_first_angle", duck(GRID_SQL.format(cells=CELLS_SQL.format(s="-1"))))
def layout_grid_first_angle(spark, sf_dir):
    return _grid(spark, sf_dir, False)


@register("placement_order", duck(f"SELECT drawing_id, id, row_number() OVER (PARTITION BY drawing_id ORDER BY round({SCORE}, 6) DESC, id)::INT AS turn FROM gt_char"))
def placement_order(spark, sf_dir):
    return layout.placement_order(chars(spark, sf_dir), F.round(parts.criticality(), 6))


@register("first_drawings", duck("SELECT drawing_id FROM drawing ORDER BY drawing_id LIMIT 25"))
def first_drawings(spark, sf_dir):
    """A run's limit: its first 25 drawings."""
    return files.limited(view(spark, sf_dir, "drawing").select(KEY), 25)


# --- texts of damaged callouts

NUMBER = "regexp_replace(printf('%.4f', {}), '\\.?0+$', '')"
SHOWN_TEXT = f"concat('⌀', {NUMBER.format('g.nominal')}, ' H7')"


@register(
    "rewritten_texts",
    duck(f"""WITH p AS (SELECT * FROM ({sql_of("perturb_nominal")}))
SELECT g.drawing_id, g.id, CASE WHEN p.after IS NULL THEN {SHOWN_TEXT} ELSE replace({SHOWN_TEXT}, {NUMBER.format('p.before')}, {NUMBER.format('p.after')}) END AS text, coalesce(p.after, g.nominal) AS nominal FROM gt_char g LEFT JOIN p ON g.drawing_id = p.drawing_id AND g.id = p.id WHERE g.kind = 'dimension'"""),
)
def rewritten_texts(spark, sf_dir):
    """Sizes after a digit error, in the number and in the text."""
    every = chars(spark, sf_dir)
    changes = perturb.perturb_nominal(every, SEED)
    shown = every.where("kind = 'dimension'").withColumn("raw_text", F.concat(F.lit("⌀"), value_text(F.col("nominal"), 4, zeros=False), F.lit(" H7")))
    return perturb.rewritten(shown, changes).select(KEY, "id", F.col("raw_text").alias("text"), "nominal")
