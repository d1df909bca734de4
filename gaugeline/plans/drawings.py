"""Queries that validate, read, write, warp, perturb and lay out callouts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gaugeline.constants import DATUM_REQUIRED, FORM_SYMBOLS, NO_MODIFIER, SIZED_DATUMS
from gaugeline.functions import grammar, tables, warps, writing
from gaugeline.operators import degrade, layout, perturb, rules
from gaugeline.plans.registry import register
from gaugeline.plans.verification import DOF_SQL, quoted
from gaugeline.sources.fixtures import callouts, duck, view

KEY = "drawing_id"
SEED = 7


def chars(spark, sf_dir):
    return callouts(spark, sf_dir, "gt_char")


def boxed_datums(spark, sf_dir):
    return view(spark, sf_dir, "datum").withColumn("bbox", F.struct("x0", "y0", "x1", "y1")).drop("x0", "y0", "x1", "y1")


# --- schema rules

REASON = f"""CASE WHEN kind = 'geometric_tolerance' AND gtol_symbol IN ({quoted(DATUM_REQUIRED)}) AND n_refs = 0 THEN 'datum required'
WHEN kind = 'geometric_tolerance' AND gtol_symbol IN ({quoted(FORM_SYMBOLS)}) AND n_refs > 0 THEN 'datum on form'
WHEN kind = 'geometric_tolerance' AND material_modifier IS NOT NULL AND gtol_symbol IN ({quoted(NO_MODIFIER)}) THEN 'modifier without size'
WHEN is_basic AND (coalesce(upper_tol, 0) <> 0 OR coalesce(lower_tol, 0) <> 0) THEN 'basic with tolerance'
WHEN upper_tol < lower_tol THEN 'deviations crossed' END"""


@register("schema_reasons", duck(f"SELECT * FROM (SELECT drawing_id, id, {REASON} AS reason FROM gt_char) WHERE reason IS NOT NULL"))
def schema_reasons(spark, sf_dir):
    return rules.judged(chars(spark, sf_dir)).where("reason IS NOT NULL").select(KEY, "id", "reason")


@register("valid_and_malformed", duck(f"SELECT drawing_id, count(*) FILTER (reason IS NULL) AS valid, count(*) FILTER (reason IS NOT NULL) AS malformed FROM (SELECT drawing_id, {REASON} AS reason FROM gt_char) GROUP BY 1"))
def valid_and_malformed(spark, sf_dir):
    return rules.judged(chars(spark, sf_dir)).groupBy(KEY).agg(F.count_if(F.col("reason").isNull()).alias("valid"), F.count_if(F.col("reason").isNotNull()).alias("malformed"))


SHOWN = "CASE WHEN hh % 25 = 3 THEN id + 100 ELSE id END"


@register(
    "drawing_faults",
    duck(f"""WITH k AS (SELECT drawing_id, {SHOWN} AS id FROM gt_char), r AS (SELECT f.drawing_id, f.label, f.modifier, d.feature_type FROM datum_ref f LEFT JOIN datum d ON f.drawing_id = d.drawing_id AND f.label = d.label)
SELECT drawing_id, 'numbering' AS reason FROM k GROUP BY 1 HAVING count(id) <> count(DISTINCT id) OR min(id) <> 1 OR max(id) <> count(id)
UNION SELECT drawing_id, 'datum not declared' FROM r WHERE feature_type IS NULL UNION SELECT drawing_id, 'modifier on a datum without size' FROM r WHERE modifier IS NOT NULL AND feature_type NOT IN ({quoted(SIZED_DATUMS)})"""),
)
def drawing_faults(spark, sf_dir):
    """Gaps in the numbering are planted, here and in the SQL, by raising some ids; every callout is judged."""
    return rules.drawing_faults(chars(spark, sf_dir).withColumn("id", F.expr(SHOWN)), view(spark, sf_dir, "datum"))


@register("boxes_outside", duck("SELECT g.drawing_id, g.id FROM gt_char g JOIN drawing d ON g.drawing_id = d.drawing_id WHERE x1 > image_w - 60 OR y1 > image_h - 60 OR x0 < 0 OR y0 < 0"))
def boxes_outside(spark, sf_dir):
    sheets = view(spark, sf_dir, "drawing").withColumn("image_w", F.col("image_w") - 60).withColumn("image_h", F.col("image_h") - 60)
    return rules.outside(chars(spark, sf_dir), sheets)


@register("unknown_json_keys", duck("""SELECT event_id, "key" FROM (SELECT event_id, unnest(json_keys(CASE WHEN event_id % 10 = 0 THEN '{"k": 1, "colour": 2}' ELSE props END)) AS "key" FROM events) WHERE "key" <> 'k'"""))
def unknown_json_keys(spark, sf_dir):
    raw = F.when(F.col("event_id") % 10 == 0, '{"k": 1, "colour": 2}').otherwise(F.col("props"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.explode(rules.unknown_keys(raw, ["k"])).alias("key"))


# --- strings

TEXT = "concat('%%c', CAST(CAST(l_quantity AS INT) AS VARCHAR(9)), CASE hh % 5 WHEN 0 THEN ' +/- 0.0' WHEN 1 THEN ' H' WHEN 2 THEN '' WHEN 3 THEN ' THRU' ELSE ' ?' END, CASE WHEN hh % 5 < 2 THEN CAST(5 + hh % 4 AS VARCHAR(9)) ELSE '' END)"


@register(
    "parse_callouts",
    duck(f"""WITH t AS (SELECT drawing_id, id, hh, l_quantity, {TEXT} AS text FROM keyed)
SELECT drawing_id, id, CASE WHEN hh % 5 < 4 THEN 'dimension' END AS kind, CASE WHEN hh % 5 < 4 THEN 'diameter' END AS dim_type, CASE WHEN hh % 5 < 4 THEN l_quantity END AS nominal,
CASE hh % 5 WHEN 0 THEN CAST(concat('0.0', 5 + hh % 4) AS DOUBLE) END AS upper_tol, CASE hh % 5 WHEN 0 THEN 'bilateral' WHEN 1 THEN 'fit' WHEN 2 THEN 'general' WHEN 3 THEN 'general' END AS tol_style,
CASE hh % 5 WHEN 1 THEN concat('H', 5 + hh % 4) END AS fit_class, CASE hh % 5 WHEN 3 THEN 'through' END AS notes, hh % 5 = 4 AS refused FROM t"""),
)
def parse_callouts(spark, sf_dir):
    rows = view(spark, sf_dir, "keyed").selectExpr(KEY, "id", f"{TEXT} AS text").withColumn("c", grammar.parse_callout("text"))
    return rows.select(KEY, "id", "c.kind", "c.dim_type", "c.nominal", "c.upper_tol", "c.tol_style", "c.fit_class", "c.notes", F.col("c.error").isNotNull().alias("refused"))


@register("normalise_text", duck(f"SELECT drawing_id, id, trim(regexp_replace(replace(replace({TEXT}, '%%c', '⌀'), '+/-', '±'), '\\s+', ' ', 'g')) AS text FROM keyed"))
def normalise_text(spark, sf_dir):
    return view(spark, sf_dir, "keyed").selectExpr(KEY, "id", f"{TEXT} AS text").withColumn("text", grammar.normalised(F.col("text")))


@register("format_values", duck("SELECT drawing_id, id, printf('%.2f', nominal) AS fixed, CASE WHEN nominal IS NOT NULL THEN regexp_replace(printf('%.3f', upper_tol), '\\.?0+$', '') END AS short FROM gt_char"))
def format_values(spark, sf_dir):
    return chars(spark, sf_dir).select(KEY, "id", writing.value_text(F.col("nominal"), 2).alias("fixed"), writing.value_text(F.col("upper_tol"), 3, zeros=False).alias("short"))


SIGNED = "concat(CASE WHEN abs({v}) < 1e-3 THEN '{z}' WHEN {v} > 0 THEN '+' ELSE '-' END, printf('%.2f', abs({v})))"
STYLE = "CASE hh % 4 WHEN 0 THEN 'general' WHEN 1 THEN 'bilateral' WHEN 2 THEN 'unilateral' ELSE 'limit' END"


@register(
    "tolerance_texts",
    duck(f"""WITH s AS (SELECT *, {STYLE} AS style, concat(printf('%.0f', nominal), ' ', {SIGNED.format(v="upper_tol", z="+")}, '/', {SIGNED.format(v="lower_tol", z="-")}) AS pair FROM gt_char WHERE upper_tol IS NOT NULL)
SELECT drawing_id, id, CASE style WHEN 'general' THEN printf('%.0f', nominal) WHEN 'unilateral' THEN pair WHEN 'bilateral' THEN CASE WHEN abs(upper_tol + lower_tol) > 1e-9 THEN pair ELSE concat(printf('%.0f', nominal), '±', printf('%.2f', abs(upper_tol))) END
 ELSE concat(printf('%.2f', nominal + upper_tol), '/', printf('%.2f', nominal + lower_tol)) END AS text FROM s"""),
)
def tolerance_texts(spark, sf_dir):
    rows = chars(spark, sf_dir).where("upper_tol IS NOT NULL")
    text = writing.tolerance_text(F.col("nominal"), F.col("upper_tol"), F.col("lower_tol"), F.expr(STYLE), decimals=0, places=2)
    return rows.select(KEY, "id", text.alias("text"))


GLYPH_SQL = "CASE gtol_symbol " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in writing.GLYPHS.items()) + " END"


@register("frame_texts", duck(f"SELECT drawing_id, id, concat({GLYPH_SQL}, '|⌀', printf('%.3f', gtol_value), CASE WHEN material_modifier = 'MMC' THEN 'Ⓜ' ELSE '' END, CASE WHEN n_refs > 0 THEN concat('|A', CASE WHEN ref_modifier = 'MMC' THEN 'Ⓜ' ELSE '' END) ELSE '' END, CASE WHEN n_refs > 1 THEN '|B' ELSE '' END, CASE WHEN n_refs > 2 THEN '|C' ELSE '' END) AS text FROM gt_char WHERE kind = 'geometric_tolerance'"))
def frame_texts(spark, sf_dir):
    rows = chars(spark, sf_dir).where("kind = 'geometric_tolerance'")
    return rows.select(KEY, "id", writing.frame_text(F.col("gtol_symbol"), F.col("gtol_value"), F.col("material_modifier"), F.col("datum_refs"), zone=F.lit("⌀")).alias("text"))


@register("frame_round_trip", duck("SELECT drawing_id, id, true AS agrees FROM gt_char WHERE kind = 'geometric_tolerance'"))
def frame_round_trip(spark, sf_dir):
    """Written frames read back by the grammar: all agree."""
    rows = chars(spark, sf_dir).where("kind = 'geometric_tolerance'")
    text = writing.frame_text(F.col("gtol_symbol"), F.col("gtol_value"), F.col("material_modifier"), F.col("datum_refs"), zone=F.lit("⌀"))
    back = rows.withColumn("c", grammar.parse_callout(text))
    same = (F.col("c.gtol_symbol") == F.col("gtol_symbol")) & (F.abs(F.col("c.gtol_value") - F.col("gtol_value")) < 1e-9) & F.col("c.material_modifier").eqNullSafe(F.col("material_modifier")) & F.col("c.datum_refs").eqNullSafe(F.col("datum_refs"))
    return back.select(KEY, "id", same.alias("agrees"))


# --- tables

IT_SQL = "CASE g " + " ".join(f"WHEN {g} THEN [{', '.join(map(str, v))}]" for g, v in tables.GRADES.items()) + " END"
RANGE_SQL = "CASE " + " ".join(f"WHEN d <= {r} THEN {i + 1}" for i, r in enumerate(tables.RANGES)) + " END"
LETTERS = ("H", "h", "g", "F", "js", "k", "K", "M", "n", "P", "JS", "d")


def _sized(spark, sf_dir):
    letter = F.element_at(F.array(*map(F.lit, LETTERS)), (F.col("p_partkey") % len(LETTERS) + 1).cast("int"))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", (F.col("p_size") * 5.0).alias("d"), (F.col("p_partkey") % 9 + 5).cast("int").alias("g"), letter.alias("letter"))


SIZED = f"s AS (SELECT p_partkey, p_size * 5::DOUBLE AS d, (p_partkey % 9 + 5)::INT AS g, [{quoted(LETTERS)}][p_partkey % {len(LETTERS)} + 1] AS letter FROM part), r AS (SELECT *, {RANGE_SQL} AS i FROM s)"
WIDTH = f"(CASE WHEN g > 11 THEN (CASE g - 5 {' '.join(f'WHEN {k} THEN [{', '.join(map(str, v))}]' for k, v in tables.GRADES.items())} END)[i] * 10 ELSE ({IT_SQL})[i] END * 1e-3)"


@register("it_grades", duck(f"WITH {SIZED} SELECT p_partkey, i::INT AS size_range, round({WIDTH}, 6) AS width FROM r"))
def it_grades(spark, sf_dir):
    rows = _sized(spark, sf_dir)
    return rows.select("p_partkey", tables.size_range(F.col("d")).alias("size_range"), F.round(tables.it_grade(F.col("d"), F.col("g")), 6).alias("width"))


def _devs(table: dict) -> str:
    return "CASE lower(letter) " + " ".join(f"WHEN '{k}' THEN [{', '.join(map(str, v))}]" for k, v in table.items()) + " END"


LOWS = "[1, " + ", ".join(map(str, tables.RANGES[:-1])) + "]"
FIRST = f"(0.8::DOUBLE + 0.02::DOUBLE * sqrt((({LOWS})[i] * ([{', '.join(map(str, tables.RANGES))}])[i])::DOUBLE))"
FOURTH = f"(round_even({FIRST} * pow(pow(([{', '.join(map(str, tables.GRADES[5]))}])[i] / {FIRST}, 0.25::DOUBLE), 3), 0) * 1e-3)"
FINER = "CASE WHEN g = 5 THEN " + FOURTH + " ELSE " + WIDTH.replace("CASE g ", "CASE g - 1 ").replace("CASE g - 5", "CASE g - 6").replace("g > 11", "g - 1 > 11") + " END"


@register(
    "fit_limits",
    duck(f"""WITH {SIZED}, w AS (SELECT *, {WIDTH} AS it, ({_devs(tables.SHAFT_UPPER)})[i] * 1e-3 AS es, CASE WHEN lower(letter) = 'k' AND NOT g BETWEEN 4 AND 7 THEN 0 ELSE ({_devs(tables.SHAFT_LOWER)})[i] * 1e-3 END AS ei, letter = upper(letter) AS hole,
 CASE WHEN i > 1 AND g <= CASE lower(letter) WHEN 'p' THEN 7 WHEN 'k' THEN 8 WHEN 'm' THEN 8 WHEN 'n' THEN 8 END THEN {WIDTH} - ({FINER}) ELSE 0 END AS delta FROM r)
SELECT p_partkey, concat(letter, g) AS fit, round(CASE WHEN lower(letter) = 'js' THEN it / 2 WHEN es IS NOT NULL THEN CASE WHEN hole THEN it - es ELSE es END ELSE CASE WHEN hole THEN delta - ei ELSE ei + it END END + 0.0, 6) AS upper_dev,
round(CASE WHEN lower(letter) = 'js' THEN -it / 2 WHEN es IS NOT NULL THEN CASE WHEN hole THEN -es ELSE es - it END ELSE CASE WHEN hole THEN delta - ei - it ELSE ei END END + 0.0, 6) AS lower_dev FROM w"""),
)
def fit_limits(spark, sf_dir):
    rows = _sized(spark, sf_dir).withColumn("fit", F.concat("letter", F.col("g").cast("string")))
    limits = tables.fit_limits(F.col("d"), F.col("fit"))
    return rows.withColumn("l", limits).select("p_partkey", "fit", (F.round("l.upper", 6) + 0.0).alias("upper_dev"), (F.round("l.lower", 6) + 0.0).alias("lower_dev"))


SERIES = tables.renard(10, 1.0, 1000.0)


@register("snap_to_series", duck(f"WITH v AS (SELECT unnest([{', '.join(map(str, SERIES))}]) AS v), n AS (SELECT p_partkey, p_retailprice / 10 AS x FROM part) SELECT p_partkey, v::DOUBLE AS snapped FROM n JOIN v ON true QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY abs(x - v), v) = 1"))
def snap_to_series(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", tables.snap(F.col("p_retailprice") / 10, SERIES).alias("snapped"))


@register("renard_series", "SELECT 5 AS series, unnest([10.0, 16.0, 25.0, 40.0, 63.0, 100.0])::DOUBLE AS value UNION ALL SELECT 10, unnest([10.0, 12.5, 16.0, 20.0, 25.0, 31.5, 40.0, 50.0, 63.0, 80.0, 100.0])::DOUBLE")
def renard_series(spark, sf_dir):
    return spark.createDataFrame([(s, v) for s in (5, 10) for v in tables.renard(s, 10, 100)], "series int, value double")


# --- boxes and warps


@register("box_clip", duck("SELECT drawing_id, id, greatest(0, least(x0 - 100, 1500)) AS x0, greatest(0, least(y1, 900)) AS y1 FROM gt_char WHERE least(x1 - 100, 1500) - greatest(0, least(x0 - 100, 1500)) >= 1 AND greatest(0, least(y1, 900)) - greatest(0, least(y0, 900)) >= 1"))
def box_clip(spark, sf_dir):
    box = layout.moved(F.col("bbox"), F.lit(-100.0), F.lit(0.0))
    rows = chars(spark, sf_dir).withColumn("c", warps.clip(box, F.lit(1500), F.lit(900))).where("c IS NOT NULL")
    return rows.select(KEY, "id", "c.x0", "c.y1")


MATRIX = (0.98, 0.05, 12.0, -0.04, 1.02, -9.0, 1e-5, 2e-5, 1.0)


def _outline(fx: str, fy: str) -> str:
    return f"""e AS (SELECT g.drawing_id, g.id, u.x, u.y FROM gt_char g CROSS JOIN (SELECT unnest(range(9)) AS k) s CROSS JOIN LATERAL (VALUES (x0 + (x1 - x0) * k / 8.0::DOUBLE, y0), (x0 + (x1 - x0) * k / 8.0::DOUBLE, y1), (x0, y0 + (y1 - y0) * k / 8.0::DOUBLE), (x1, y0 + (y1 - y0) * k / 8.0::DOUBLE)) u(x, y)),
m AS (SELECT drawing_id, id, min({fx}) AS x0, min({fy}) AS y0, max({fx}) AS x1, max({fy}) AS y1 FROM e GROUP BY ALL)"""


ROUNDED = "SELECT drawing_id, id, round(x0, 4) AS x0, round(y0, 4) AS y0, round(x1, 4) AS x1, round(y1, 4) AS y1 FROM m"


def _map(spark, sf_dir, move):
    """Moved boxes of all callouts, also of those without a drawing, as in the SQL."""
    rows = view(spark, sf_dir, "gt_char").select(KEY, "id", F.struct("x0", "y0", "x1", "y1").alias("bbox")).withColumn("b", warps.map_box(F.col("bbox"), move))
    return rows.select(KEY, "id", *(F.round(f"b.{c}", 4).alias(c) for c in ("x0", "y0", "x1", "y1")))


W_SQL = "(1e-5::DOUBLE * x + 2e-5::DOUBLE * y + 1)"


@register("homography_boxes", duck(f"WITH {_outline(f'(0.98::DOUBLE * x + 0.05::DOUBLE * y + 12) / {W_SQL}', f'(-0.04::DOUBLE * x + 1.02::DOUBLE * y - 9) / {W_SQL}')} {ROUNDED}"))
def homography_boxes(spark, sf_dir):
    return _map(spark, sf_dir, warps.Homography(MATRIX))


HALF = "sqrt(1050.0::DOUBLE ** 2 + 750.0::DOUBLE ** 2)"
R2 = f"(((x - 1050) / {HALF}) ** 2 + ((y - 750) / {HALF}) ** 2)"


@register("barrel_boxes", duck(f"WITH {_outline(f'1050 + (x - 1050) * (1 + 0.05::DOUBLE * {R2})', f'750 + (y - 750) * (1 + 0.05::DOUBLE * {R2})')} {ROUNDED}"))
def barrel_boxes(spark, sf_dir):
    return _map(spark, sf_dir, warps.Barrel(0.05, 2100, 1500))


@register("barrel_round_trip", duck("SELECT drawing_id, id, true AS returned FROM gt_char"))
def barrel_round_trip(spark, sf_dir):
    lens = warps.Barrel(0.05, 2100, 1500)
    u, v = lens(F.col("bbox.x0"), F.col("bbox.y0"))
    x, y = lens.inverse(F.col("u"), F.col("v"))
    return chars(spark, sf_dir).withColumn("u", u).withColumn("v", v).select(KEY, "id", (F.hypot(x - F.col("bbox.x0"), y - F.col("bbox.y0")) < 0.5).alias("returned"))


@register("fold_boxes", duck(f"WITH {_outline('x', 'y + 6 * exp(-(((x - 900) / 40.0::DOUBLE) ** 2))')} {ROUNDED}"))
def fold_boxes(spark, sf_dir):
    return _map(spark, sf_dir, warps.Fold(900.0, True, 6.0, 40.0))


SURVIVE = """cl AS (SELECT *, greatest(0, least(x0, 1400)) AS cx0, greatest(0, least(y0, 1000)) AS cy0, greatest(0, least(x1, 1400)) AS cx1, greatest(0, least(y1, 1000)) AS cy1 FROM {t}),
{o} AS (SELECT * FROM cl WHERE cx1 - cx0 >= 1 AND cy1 - cy0 >= 1 AND (cx1 - cx0) * (cy1 - cy0) / greatest((x1 - x0) * (y1 - y0), 1e-9) >= 0.45)"""
KEPT_SQL = "SELECT c.drawing_id, c.id AS old_id, row_number() OVER (PARTITION BY c.drawing_id ORDER BY c.id)::INT AS id FROM {c} c WHERE NOT EXISTS (SELECT 1 FROM datum_ref r WHERE r.drawing_id = c.drawing_id AND r.id = c.id AND NOT EXISTS (SELECT 1 FROM {d} d WHERE d.drawing_id = r.drawing_id AND d.label = r.label))"


@register("degrade_survivors", duck("WITH " + SURVIVE.format(t="gt_char", o="ck") + ", " + SURVIVE.replace("cl AS", "cd AS").replace("FROM cl", "FROM cd").format(t="datum", o="dk") + " " + KEPT_SQL.format(c="ck", d="dk")))
def degrade_survivors(spark, sf_dir):
    left, _ = degrade.map_boxes(chars(spark, sf_dir), boxed_datums(spark, sf_dir), warps.IDENTITY, F.lit(1400), F.lit(1000))
    return left.select(KEY, "old_id", "id")


REGIONS = [(0.0, 0.0, 500.0, 500.0), (1200.0, 800.0, 2200.0, 1600.0)]
COVER = "least(1, (" + " + ".join(f"greatest(0, least(x1, {c}) - greatest(x0, {a})) * greatest(0, least(y1, {d}) - greatest(y0, {b}))" for a, b, c, d in REGIONS) + ") / greatest((x1 - x0) * (y1 - y0), 1e-9))"


@register("degrade_coverage", duck(f"WITH ck AS (SELECT * FROM gt_char WHERE {COVER} < 0.55), dk AS (SELECT * FROM datum WHERE {COVER} < 0.55) " + KEPT_SQL.format(c="ck", d="dk")))
def degrade_coverage(spark, sf_dir):
    left, _ = degrade.remove_covered(chars(spark, sf_dir), boxed_datums(spark, sf_dir), REGIONS)
    return left.select(KEY, "old_id", "id")


@register("destroyed_drawings", duck(f"SELECT DISTINCT drawing_id FROM gt_char ANTI JOIN (SELECT drawing_id FROM gt_char WHERE {COVER} < 0.55) k USING (drawing_id)"))
def destroyed_drawings(spark, sf_dir):
    every = chars(spark, sf_dir)
    return degrade.destroyed(every, every.where(degrade.covered(F.col("bbox"), REGIONS) < degrade.COVERED))


@register("view_projection", duck("SELECT solid_id, ord, round((cx - cy) / sqrt(2.0::DOUBLE) + 0.0, 6) AS u, round((2 * cz - cx - cy) / sqrt(6.0::DOUBLE) + 0.0, 6) AS v FROM face"))
def view_projection(spark, sf_dir):
    axes = warps.view_axes((-1.0, -1.0, -1.0), (0.0, 0.0, 1.0))
    u, v = warps.project((F.col("cx"), F.col("cy"), F.col("cz")), axes)
    return view(spark, sf_dir, "face").select("solid_id", "ord", (F.round(u, 6) + 0.0).alias("u"), (F.round(v, 6) + 0.0).alias("v"))


@register("sheet_pixels", duck("SELECT drawing_id, id, round(x0 / 10 * 150 / 25.4::DOUBLE, 6) AS px, round((297 - y0 / 10) * 150 / 25.4::DOUBLE, 6) AS py FROM gt_char"))
def sheet_pixels(spark, sf_dir):
    x, y = warps.sheet_to_pixel(F.col("bbox.x0") / 10, F.col("bbox.y0") / 10, 297.0, 150)
    return chars(spark, sf_dir).select(KEY, "id", F.round(x, 6).alias("px"), F.round(y, 6).alias("py"))


@register("ray_exits", duck("SELECT drawing_id, id, round(least((x1 - x0) / 2 / cos(0.5::DOUBLE), (y1 - y0) / 2 / sin(0.5::DOUBLE)), 6) AS distance FROM gt_char"))
def ray_exits(spark, sf_dir):
    b = F.col("bbox")
    far = warps.ray_exit((b["x0"] + b["x1"]) / 2, (b["y0"] + b["y1"]) / 2, F.cos(F.lit(0.5)), F.sin(F.lit(0.5)), b)
    return chars(spark, sf_dir).select(KEY, "id", F.round(far, 6).alias("distance"))


@register("pattern_centres", duck("SELECT solid_id, ord, k::INT AS k, round(cx + radius * cos(2 * pi() * k / 4), 6) + 0.0 AS x, round(cy + radius * sin(2 * pi() * k / 4), 6) + 0.0 AS y FROM face CROSS JOIN (SELECT unnest(range(4)) AS k) WHERE surface = 'cylinder'"))
def pattern_centres(spark, sf_dir):
    rows = view(spark, sf_dir, "face").where("surface = 'cylinder'").select("solid_id", "ord", F.posexplode(layout.pattern_centres(F.col("radius"), F.lit(4), F.col("cx"), F.col("cy"))).alias("k", "p"))
    return rows.select("solid_id", "ord", "k", (F.round("p.x", 6) + 0.0).alias("x"), (F.round("p.y", 6) + 0.0).alias("y"))


@register("sheet_tiles", duck("""SELECT drawing_id, r::INT AS "row", c::INT AS col, greatest(0, CAST(trunc(c * w - w * 0.12::DOUBLE) AS INT)) AS x0, greatest(0, CAST(trunc(r * h - h * 0.12::DOUBLE) AS INT)) AS y0, least(w2, CAST(trunc((c + 1) * w + w * 0.12::DOUBLE) AS INT)) AS x1, least(h2, CAST(trunc((r + 1) * h + h * 0.12::DOUBLE) AS INT)) AS y1
FROM (SELECT drawing_id, image_w + (drawing_id % 7)::INT AS w2, image_h AS h2, (image_w + drawing_id % 7) / 2.0::DOUBLE AS w, image_h / 2.0::DOUBLE AS h FROM drawing) CROSS JOIN (VALUES (0), (1)) a(r) CROSS JOIN (VALUES (0), (1)) b(c)"""))
def sheet_tiles(spark, sf_dir):
    rows = view(spark, sf_dir, "drawing").withColumn("w", (F.col("image_w") + F.col(KEY) % 7).cast("int"))
    return rows.select(KEY, F.explode(layout.tiles(F.col("w"), F.col("image_h"))).alias("t")).select(KEY, "t.*")


@register("crop_to_sheet", duck("SELECT drawing_id, id, x0 + 100 AS x0, y0 + 50 AS y0, x1 + 100 AS x1, y1 + 50 AS y1 FROM gt_char"))
def crop_to_sheet(spark, sf_dir):
    return chars(spark, sf_dir).select(KEY, "id", layout.moved(F.col("bbox"), F.lit(100.0), F.lit(50.0)).alias("b")).select(KEY, "id", "b.*")


@register("inside_frame", duck("SELECT drawing_id, id FROM gt_char WHERE (x0 + x1) / 2 BETWEEN 100 AND 1800 AND (y0 + y1) / 2 BETWEEN 80 AND 1200 AND NOT ((x0 + x1) / 2 BETWEEN 1500 AND 1800 AND (y0 + y1) / 2 BETWEEN 1000 AND 1200)"))
def inside_frame(spark, sf_dir):
    def region(*edges):
        return F.struct(*(F.lit(float(v)).alias(k) for k, v in zip(("x0", "y0", "x1", "y1"), edges, strict=True)))

    b = F.col("bbox")
    return chars(spark, sf_dir).where(layout.inside(b, region(100, 80, 1800, 1200)) & ~layout.inside(b, region(1500, 1000, 1800, 1200))).select(KEY, "id")


# --- layout

RUNS = """w AS (SELECT *, CASE WHEN abs({a0} - lag({a0}) OVER o) <= 0.6 * greatest(lag({a1}) OVER o - lag({a0}) OVER o, 1e-6) AND {b0} - lag({b1}) OVER o <= 0.9 * greatest(lag({a1}) OVER o - lag({a0}) OVER o, 1e-6) THEN 0 ELSE 1 END AS s FROM pdf_word WHERE {up} WINDOW o AS (PARTITION BY page_id ORDER BY round_even({a0}, 1), {b0}, ord)),
r AS (SELECT *, sum(s) OVER (PARTITION BY page_id ORDER BY round_even({a0}, 1), {b0}, ord ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM w)"""


def _lines(df):
    return df.select("page_id", "run", "text", "words", "box.x0", "box.y0", "box.x1", "box.y1")


@register("cluster_lines", duck(f"WITH {RUNS.format(a0='top', a1='bottom', b0='x0', b1='x1', up='upright')} SELECT page_id, run, string_agg(text, ' ' ORDER BY x0, ord) AS text, count(*)::INT AS words, min(x0) AS x0, min(top) AS y0, max(x1) AS x1, max(bottom) AS y1 FROM r GROUP BY ALL"))
def cluster_lines(spark, sf_dir):
    return _lines(layout.cluster_lines(view(spark, sf_dir, "pdf_word")))


@register("cluster_columns", duck(f"WITH {RUNS.format(a0='x0', a1='x1', b0='top', b1='bottom', up='NOT upright')} SELECT page_id, run, string_agg(text, '' ORDER BY top DESC, ord DESC) AS text, count(*)::INT AS words, min(x0) AS x0, min(top) AS y0, max(x1) AS x1, max(bottom) AS y1 FROM r GROUP BY ALL"))
def cluster_columns(spark, sf_dir):
    return _lines(layout.cluster_columns(view(spark, sf_dir, "pdf_word")))


@register("merge_stacks")
def merge_stacks(spark, sf_dir):
    """Callouts of stacked lines (no SQL: the outcome depends on the order of merging)."""
    return layout.merge_stacks(layout.cluster_lines(view(spark, sf_dir, "pdf_word"))).select("page_id", "pos", "text", "x0", "y0", "x1", "y1")


@register("sparse_pages", duck("SELECT page_id, count(*) AS words FROM pdf_word WHERE NOT upright GROUP BY 1 HAVING count(*) < 8"))
def sparse_pages(spark, sf_dir):
    return layout.sparse_pages(view(spark, sf_dir, "pdf_word").where("NOT upright"))


@register("reading_order", duck("SELECT drawing_id, id AS old_id, row_number() OVER (PARTITION BY drawing_id ORDER BY y1 DESC, x0, id)::INT AS id FROM gt_char"))
def reading_order(spark, sf_dir):
    rows = chars(spark, sf_dir).withColumn("old_id", F.col("id"))
    return layout.numbered(rows, KEY, F.desc("bbox.y1"), F.col("bbox.x0"), F.col("old_id")).select(KEY, "old_id", "id")


@register("face_numbers", duck("SELECT solid_id, ord, concat('f', lpad(CAST(row_number() OVER (PARTITION BY solid_id ORDER BY surface, round_even(area, 4), cx, cy, cz, coalesce(radius, 0), ord) - 1 AS VARCHAR), 4, '0')) AS fid FROM face"))
def face_numbers(spark, sf_dir):
    place = F.row_number().over(Window.partitionBy("solid_id").orderBy("surface", F.bround("area", 4), "cx", "cy", "cz", F.coalesce("radius", F.lit(0.0)), "ord")) - 1
    return view(spark, sf_dir, "face").select("solid_id", "ord", F.concat(F.lit("f"), F.lpad(place.cast("string"), 4, "0")).alias("fid"))


@register("step_positions", duck("SELECT drawing_id, id, coalesce(sum(nominal) OVER (PARTITION BY drawing_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS z FROM gt_char WHERE kind = 'dimension'"))
def step_positions(spark, sf_dir):
    before = Window.partitionBy(KEY).orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    return chars(spark, sf_dir).where("kind = 'dimension'").select(KEY, "id", F.coalesce(F.sum("nominal").over(before), F.lit(0.0)).alias("z"))


@register("occupancy_cells", duck("SELECT drawing_id, cx, cy, sum(2)::BIGINT AS weight FROM (SELECT drawing_id, cy, unnest(range(CAST(floor(x0 / 50) AS INT), CAST(floor(x1 / 50) AS INT) + 1))::INT AS cx FROM (SELECT *, unnest(range(CAST(floor(y0 / 50) AS INT), CAST(floor(y1 / 50) AS INT) + 1))::INT AS cy FROM gt_char)) GROUP BY ALL"))
def occupancy_cells(spark, sf_dir):
    cells = {a: F.sequence(F.floor(F.col(f"bbox.{a}0") / 50).cast("int"), F.floor(F.col(f"bbox.{a}1") / 50).cast("int")) for a in "xy"}
    rows = chars(spark, sf_dir).select(KEY, F.explode(cells["y"]).alias("cy"), "bbox").select(KEY, "cy", F.explode(cells["x"]).alias("cx"))
    return rows.groupBy(KEY, "cx", "cy").agg(F.sum(F.lit(2)).alias("weight"))


def _readings(spark, sf_dir):
    """Three readings of all callouts of each drawing: one as is, one that misses some, one that misreads some."""
    rows = chars(spark, sf_dir)
    misread = F.when(F.col("pp") < 30, F.col("nominal") * 3).otherwise(F.col("nominal"))
    return rows.withColumn("run", F.lit(0)).unionByName(rows.where("pp >= 20").withColumn("run", F.lit(1))).unionByName(rows.where("pp >= 10").withColumn("nominal", misread).withColumn("run", F.lit(2)))


@register("merge_by_vote")
def merge_by_vote(spark, sf_dir):
    """Callouts that half the readings support (no SQL: pooling is greedy)."""
    return layout.merge_by_vote(_readings(spark, sf_dir))


@register("dedupe_readings")
def dedupe_readings(spark, sf_dir):
    """Readings of overlapping crops without repeats (no SQL: greedy)."""
    rows = _readings(spark, sf_dir).where("run < 2").withColumn("order", F.struct("run", "id"))
    return layout.dedupe(rows, order="order")


# --- perturbations


def _draw(kind: str, *columns: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws(':', '{SEED}:{kind}', {', '.join(columns)})), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE"


def _chosen(kind: str, where: str, table: str = "gt_char") -> str:
    return f"ch AS (SELECT * FROM {table} g WHERE {where} QUALIFY row_number() OVER (PARTITION BY drawing_id ORDER BY {_draw(kind, 'drawing_id', 'id')}, id) = 1)"


@register(
    "perturb_nominal",
    duck(f"""WITH {_chosen("perturb_nominal", "kind = 'dimension' AND nominal <> 0 AND NOT is_reference")}, s AS (SELECT *, floor({_draw("style", "drawing_id")} * 3) AS st FROM ch)
SELECT * FROM (SELECT drawing_id, id, nominal AS before, round_even(CASE st WHEN 0 THEN CASE WHEN nominal < 100 THEN nominal * 10 ELSE nominal / 10 END WHEN 1 THEN nominal + greatest(1, 0.25 * nominal) ELSE nominal * 0.5 END, 4) AS after FROM s) WHERE abs(after - before) >= 1e-6"""),
)
def perturb_nominal(spark, sf_dir):
    return perturb.perturb_nominal(chars(spark, sf_dir), SEED)


@register("unit_confusion", duck("SELECT g.drawing_id, id, round_even(nominal * CASE WHEN units = 'mm' THEN 25.4::DOUBLE ELSE 1 / 25.4::DOUBLE END, 4) AS after FROM gt_char g JOIN drawing d ON g.drawing_id = d.drawing_id WHERE kind = 'dimension'"))
def unit_confusion(spark, sf_dir):
    return perturb.confuse_units(chars(spark, sf_dir))


AXIAL_SQL = "('cylindrical_feature', 'axis')"
OK_SQL = """ok{n} AS (SELECT c.drawing_id, c.id, any_value(c.gtol_symbol) AS sy, least(6, sum(({dof})[p])) AS dof, bool_or(coalesce(t IN {axial}, false)) AS axial FROM (SELECT ch.drawing_id, ch.id, ch.gtol_symbol, u.p, d.feature_type AS t FROM ch CROSS JOIN LATERAL (SELECT unnest({arr}) AS label, unnest(range(1, len({arr}) + 1)) AS p) u LEFT JOIN datum d ON d.drawing_id = ch.drawing_id AND d.label = u.label) c GROUP BY ALL),
is{n} AS (SELECT drawing_id, id, CASE WHEN sy IN ('circular_runout', 'total_runout') THEN axial WHEN sy IN ('perpendicularity', 'parallelism', 'angularity') THEN dof >= 3 WHEN sy IN ('position', 'concentricity', 'symmetry', 'profile_surface') THEN dof >= CASE WHEN axial THEN 5 ELSE 6 END ELSE true END AS ok FROM ok{n})"""


def _ok(n: str, array: str) -> str:
    return OK_SQL.format(n=n, arr=array, dof=DOF_SQL, axial=AXIAL_SQL)


LABELS = "['A', 'B', 'C'][1:n_refs]"


@register("underconstrain_frames", duck(f"WITH {_chosen('underconstrain_drf', 'n_refs >= 2')}, {_ok('a', LABELS + '[1:1]')} SELECT ch.drawing_id, ch.id, array_to_string({LABELS}, '|') AS before, 'A' AS after, ok AS benign FROM ch JOIN isa ON ch.drawing_id = isa.drawing_id AND ch.id = isa.id"))
def underconstrain_frames(spark, sf_dir):
    out = perturb.underconstrain(chars(spark, sf_dir), view(spark, sf_dir, "datum"), SEED)
    return out.withColumn("before", F.array_join("before", "|")).withColumn("after", F.array_join("after", "|"))


@register("shuffle_datum_refs", duck(f"WITH {_chosen('shuffle_datum_refs', 'n_refs >= 2')}, {_ok('a', LABELS)}, {_ok('b', f'list_reverse({LABELS})')} SELECT ch.drawing_id, ch.id, array_to_string(list_reverse({LABELS}), '|') AS after, isa.ok AND isb.ok AS benign FROM ch JOIN isa ON ch.drawing_id = isa.drawing_id AND ch.id = isa.id JOIN isb ON ch.drawing_id = isb.drawing_id AND ch.id = isb.id"))
def shuffle_datum_refs(spark, sf_dir):
    out = perturb.shuffle_refs(chars(spark, sf_dir), view(spark, sf_dir, "datum"), SEED)
    return out.select(KEY, "id", F.array_join("after", "|").alias("after"), "benign")


OTHERS = "list_sort(list_filter(k.known, lambda x: x <> 'A'))"


@register("swap_datum", duck(f"WITH {_chosen('swap_datum', 'n_refs > 0')}, k AS (SELECT drawing_id, list(label) AS known FROM datum GROUP BY 1), n AS (SELECT ch.drawing_id, ch.id, {OTHERS}[CAST(floor({_draw('other', 'ch.drawing_id')} * len({OTHERS})) AS INT) + 1] AS new, {LABELS} AS refs FROM ch JOIN k ON ch.drawing_id = k.drawing_id) SELECT drawing_id, id, new FROM n WHERE NOT list_contains(refs, new)"))
def swap_datum(spark, sf_dir):
    out = perturb.swap_datum(chars(spark, sf_dir), view(spark, sf_dir, "datum"), SEED)
    return out.select(KEY, "id", F.element_at("after", 1).alias("new"))


@register("flip_modifier", duck(f"WITH {_chosen('flip_modifier', "kind = 'geometric_tolerance' AND gtol_symbol IN ('position', 'perpendicularity', 'parallelism', 'angularity')")} SELECT ch.drawing_id, id, material_modifier AS before, CASE WHEN material_modifier IS NULL THEN 'MMC' END AS after, material_modifier IS NOT NULL OR general_tolerance IS NOT NULL AS benign FROM ch JOIN drawing d ON ch.drawing_id = d.drawing_id"))
def flip_modifier(spark, sf_dir):
    return perturb.flip_modifier(chars(spark, sf_dir), view(spark, sf_dir, "drawing"), SEED)


@register("undeclared_injection", duck(f"WITH {_chosen('undeclared_datum', 'n_refs > 0')} SELECT drawing_id, id, ['A', 'B', 'C'][n_refs] AS before, 'X' AS after FROM ch"))
def undeclared_injection(spark, sf_dir):
    return perturb.undeclared_datum(chars(spark, sf_dir), view(spark, sf_dir, "datum"), SEED)


@register(
    "drop_characteristic",
    duck(f"""WITH n AS (SELECT drawing_id, count(*) AS n, count(*) FILTER (n_refs = 0) AS free FROM gt_char GROUP BY 1), {_chosen("drop_characteristic", "n_refs >= 0 AND EXISTS (SELECT 1 FROM n WHERE n.drawing_id = g.drawing_id AND CASE WHEN free > 0 THEN n_refs = 0 AND free >= 2 ELSE n >= 2 END)")}
SELECT g.drawing_id, row_number() OVER (PARTITION BY g.drawing_id ORDER BY g.id)::INT AS new_id, g.id AS old_id FROM gt_char g JOIN ch ON g.drawing_id = ch.drawing_id WHERE g.id <> ch.id"""),
)
def drop_characteristic(spark, sf_dir):
    return perturb.drop_characteristic(chars(spark, sf_dir), SEED)


@register(
    "new_findings",
    duck(f"""WITH {_chosen('undeclared_datum', 'n_refs > 0')}, dm AS (SELECT r.drawing_id, CASE WHEN r.id = ch.id AND r.pos = ch.n_refs - 1 THEN 'X' ELSE r.label END AS label FROM datum_ref r LEFT JOIN ch ON r.drawing_id = ch.drawing_id)
SELECT dm.drawing_id, dm.label FROM dm ANTI JOIN datum d USING (drawing_id, label) EXCEPT SELECT r.drawing_id, r.label FROM datum_ref r ANTI JOIN datum d USING (drawing_id, label)"""),
)
def new_findings(spark, sf_dir):
    """Undeclared labels of drawings with one reference turned into an undeclared one, less those of the drawings as they were."""
    refs, datums = view(spark, sf_dir, "datum_ref"), view(spark, sf_dir, "datum")
    hit = perturb.undeclared_datum(chars(spark, sf_dir), datums, SEED).select(KEY, "id", "after")
    last = F.col("pos") == F.max("pos").over(Window.partitionBy(KEY, "id"))
    damaged = refs.join(hit, [KEY, "id"], "left").withColumn("label", F.when(last, F.coalesce("after", "label")).otherwise(F.col("label")))
    found, before = (x.select(KEY, "label").join(datums, [KEY, "label"], "left_anti") for x in (damaged, refs))
    return perturb.new_findings(found, before)


@register("seeded_drawings", duck("SELECT drawing_id, (drawing_id * 1000003 + length(family)) % 4294967296 AS seed FROM drawing"))
def seeded_drawings(spark, sf_dir):
    return view(spark, sf_dir, "drawing").select(KEY, F.pmod(F.col(KEY) * F.lit(1000003) + F.length("family"), F.lit(4294967296)).alias("seed"))


WEIGHTS = ((0, 0.35), (1, 0.2), (2, 0.2), (3, 0.15), (4, 0.1))


@register("sample_styles", duck(f"WITH u AS (SELECT drawing_id, {_draw('style', 'drawing_id')} AS u FROM drawing) SELECT drawing_id, CASE WHEN u < 0.35 THEN 0 WHEN u < 0.55 THEN 1 WHEN u < 0.75 THEN 2 WHEN u < 0.9 THEN 3 ELSE 4 END AS style FROM u"))
def sample_styles(spark, sf_dir):
    u, style, upto = perturb.draw(SEED, "style", KEY), None, 0.0
    for k, w in WEIGHTS[:-1]:
        upto = round(upto + w, 9)
        style = F.when(u < upto, k) if style is None else style.when(u < upto, k)
    return view(spark, sf_dir, "drawing").select(KEY, style.otherwise(WEIGHTS[-1][0]).alias("style"))

