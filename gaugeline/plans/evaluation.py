"""Queries over ground truth and predictions: units, pair costs, assignment, four tiers, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gaugeline.constants import CRITICAL, ERROR_COSTS
from gaugeline.functions import callouts as C
from gaugeline.operators import matching, scoring
from gaugeline.plans.registry import register
from gaugeline.sources.fixtures import callouts, duck, paired, view
from gaugeline.sources.shared import cut

KEY = "drawing_id"


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return callouts(spark, sf_dir, "gt_char")


def valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return callouts(spark, sf_dir, "pred_char").where(~F.col("malformed"))


def malformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "pred_char").where("malformed").select(KEY, "id")


def by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs known from the way predictions were made: the same drawing and id."""
    return valid(spark, sf_dir).select(KEY, F.col("id").alias("gt_id"), F.col("id").alias("pred_id"))


def known_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.joined(truth(spark, sf_dir), valid(spark, sf_dir), by_id(spark, sf_dir))


#: The pieces of oracle SQL that several queries share.
PAIR = """
gu AS (SELECT g.*, d.units, d.profile, d.family, CASE WHEN d.units = 'inch' THEN 25.4::DOUBLE ELSE 1::DOUBLE END AS mm FROM gt_char g JOIN drawing d ON g.drawing_id = d.drawing_id),
pv AS (SELECT * FROM pred_char WHERE NOT malformed),
kp AS (SELECT g.*, p.nominal AS p_nominal, p.upper_tol AS p_upper, p.lower_tol AS p_lower, p.gtol_symbol AS p_symbol, p.gtol_value AS p_value, p.material_modifier AS p_mod, p.n_refs AS p_refs, p.ref_modifier AS p_rmod, p.raw_text AS p_text,
  CASE WHEN g.nominal IS NULL THEN p.nominal IS NULL ELSE coalesce(abs(g.nominal * mm - p.nominal * mm) <= 1e-9, false) END AS nominal_ok,
  (CASE WHEN g.upper_tol IS NULL THEN p.upper_tol IS NULL ELSE coalesce(abs(g.upper_tol * mm - p.upper_tol * mm) <= 1e-9, false) END) AND (CASE WHEN g.lower_tol IS NULL THEN p.lower_tol IS NULL ELSE coalesce(abs(g.lower_tol * mm - p.lower_tol * mm) <= 1e-9, false) END) AS tol_ok,
  (CASE WHEN g.gtol_value IS NULL THEN p.gtol_value IS NULL ELSE coalesce(abs(g.gtol_value * mm - p.gtol_value * mm) <= 1e-9, false) END) AS value_ok,
  g.gtol_symbol IS NOT DISTINCT FROM p.gtol_symbol AS symbol_ok, g.material_modifier IS NOT DISTINCT FROM p.material_modifier AS mod_ok,
  (g.n_refs = p.n_refs AND g.ref_modifier IS NOT DISTINCT FROM p.ref_modifier) AS refs_ok
 FROM gu g JOIN pv p ON g.drawing_id = p.drawing_id AND g.id = p.id)"""
LSD = "CASE WHEN raw_text IS NULL OR raw_text = '' THEN 2 ELSE coalesce(length(regexp_extract(raw_text, '\\d+\\.(\\d+)', 1)), 0) END"
CHARGES = f"""
ch AS (
 SELECT drawing_id, is_critical, unnest(list_filter([CASE WHEN (kind = 'dimension' AND NOT nominal_ok) OR (kind = 'note' AND raw_text <> p_text) THEN 'wrong_nominal' END,
   CASE WHEN (kind = 'dimension' AND NOT tol_ok) OR (kind = 'geometric_tolerance' AND NOT value_ok) THEN 'wrong_tolerance' END,
   CASE WHEN kind = 'geometric_tolerance' AND NOT symbol_ok THEN 'wrong_symbol' END, CASE WHEN kind = 'geometric_tolerance' AND NOT mod_ok THEN 'wrong_modifier' END,
   CASE WHEN kind = 'geometric_tolerance' AND NOT refs_ok THEN 'wrong_datum_refs' END], lambda x: x IS NOT NULL)) AS error FROM kp
 UNION ALL SELECT g.drawing_id, g.is_critical, 'missed_characteristic' FROM gt_char g ANTI JOIN pv p ON g.drawing_id = p.drawing_id AND g.id = p.id
 UNION ALL SELECT drawing_id, false, unnest(['spurious_characteristic', 'schema_violation']) FROM pred_char WHERE malformed),
cost AS (SELECT ch.*, w.cost * CASE WHEN is_critical THEN {CRITICAL} ELSE 1 END AS amount FROM ch JOIN (VALUES {", ".join(f"('{k}', {v}::DOUBLE)" for k, v in ERROR_COSTS.items())}) w(error, cost) ON ch.error = w.error)"""


@register("unit_normalise", duck("SELECT g.drawing_id, g.id, g.nominal * CASE WHEN d.units = 'inch' THEN 25.4::DOUBLE ELSE 1::DOUBLE END AS nominal_mm FROM gt_char g JOIN drawing d ON g.drawing_id = d.drawing_id"))
def unit_normalise(spark, sf_dir):
    return truth(spark, sf_dir).select(KEY, "id", C.to_mm(F.col("nominal"), F.col("units")).alias("nominal_mm"))


IOU_SQL = """greatest(0, least(g.x1, p.x1) - greatest(g.x0, p.x0)) * greatest(0, least(g.y1, p.y1) - greatest(g.y0, p.y0))"""


@register("bbox_iou", duck(f"WITH b AS (SELECT g.drawing_id, g.id, p.id AS pred_id, {IOU_SQL} AS inter, (g.x1 - g.x0) * (g.y1 - g.y0) + (p.x1 - p.x0) * (p.y1 - p.y0) AS areas FROM gt_char g JOIN pred_char p ON g.drawing_id = p.drawing_id) SELECT drawing_id, id, pred_id, round(CASE WHEN areas - inter <= 0 THEN 0 ELSE inter / (areas - inter) END, 9) AS iou FROM b"))
def bbox_iou(spark, sf_dir):
    g, p = truth(spark, sf_dir).select(KEY, "id", "bbox"), callouts(spark, sf_dir, "pred_char").select(KEY, F.col("id").alias("pred_id"), F.col("bbox").alias("other"))
    return g.join(p, KEY).select(KEY, "id", "pred_id", F.round(C.iou(F.col("bbox"), F.col("other")), 9).alias("iou"))


REL = "CASE WHEN {a} IS NULL AND {b} IS NULL THEN 0 WHEN {a} IS NULL OR {b} IS NULL THEN 1 ELSE least(1, abs({a} - {b}) / greatest(abs({a}), abs({b}), 1e-6)) END"
ALL_PAIRS = f"""
gu AS (SELECT g.*, CASE WHEN d.units = 'inch' THEN 25.4::DOUBLE ELSE 1::DOUBLE END AS mm FROM gt_char g JOIN drawing d ON g.drawing_id = d.drawing_id),
b AS (SELECT g.drawing_id, g.id AS gt_id, p.id AS pred_id, g.kind AS gk, p.kind AS pk, CASE WHEN g.view = p.view THEN 0 ELSE 1 END AS v, CASE WHEN g.dim_type IS NOT DISTINCT FROM p.dim_type THEN 0 ELSE 1 END AS dt,
  CASE WHEN g.gtol_symbol IS NOT DISTINCT FROM p.gtol_symbol THEN 0 ELSE 1 END AS sy, {REL.format(a="(g.nominal * mm)", b="(p.nominal * mm)")} AS rn, {REL.format(a="(g.gtol_value * mm)", b="(p.gtol_value * mm)")} AS rv,
  CASE WHEN greatest(g.n_refs, p.n_refs) = 0 THEN 0 ELSE (abs(g.n_refs - p.n_refs) + CASE WHEN least(g.n_refs, p.n_refs) > 0 AND g.ref_modifier IS DISTINCT FROM p.ref_modifier THEN 0.5 ELSE 0 END) / greatest(g.n_refs, p.n_refs)::DOUBLE END AS rd,
  1 - 2 * (CASE WHEN substr(g.raw_text, 6, 1) = substr(p.raw_text, 6, 1) THEN 6 ELSE 5 END)::DOUBLE / (length(g.raw_text) + length(p.raw_text)) AS td,
  {IOU_SQL} AS inter, (g.x1 - g.x0) * (g.y1 - g.y0) + (p.x1 - p.x0) * (p.y1 - p.y0) AS areas
  FROM gu g JOIN pred_char p ON g.drawing_id = p.drawing_id WHERE NOT p.malformed),
s AS (SELECT *, CASE WHEN gk <> pk THEN 1 WHEN gk = 'dimension' THEN 0.6 * rn + 0.25 * dt + 0.15 * v WHEN gk = 'geometric_tolerance' THEN 0.5 * sy + 0.2 * rv + 0.2 * rd + 0.1 * v ELSE 0.85 * td + 0.15 * v END::DOUBLE AS sem, inter / (areas - inter) AS iou FROM b),
c AS (SELECT *, CASE WHEN gk <> pk OR iou < 0.05 THEN 1 ELSE 0.5 * (1 - iou) + 0.5 * sem END::DOUBLE AS cost FROM s)"""


@register("semantic_distance", duck(f"WITH {ALL_PAIRS} SELECT drawing_id, gt_id, pred_id, round(sem, 6) AS semantic FROM c"))
def semantic_distance(spark, sf_dir):
    return matching.pairs(truth(spark, sf_dir), valid(spark, sf_dir)).select(KEY, F.col("g.id").alias("gt_id"), F.col("p.id").alias("pred_id"), F.round("semantic", 6).alias("semantic"))


@register("pair_cost", duck(f"WITH {ALL_PAIRS} SELECT drawing_id, gt_id, pred_id, round(cost, 6) AS cost FROM c"))
def pair_cost(spark, sf_dir):
    return matching.pairs(truth(spark, sf_dir), valid(spark, sf_dir)).select(KEY, F.col("g.id").alias("gt_id"), F.col("p.id").alias("pred_id"), F.round("cost", 6).alias("cost"))


@register("pair_cost_meaning_only", duck(f"WITH {ALL_PAIRS} SELECT drawing_id, gt_id, pred_id, round(CASE WHEN gk <> pk THEN 1 ELSE sem END, 6)::DOUBLE AS cost FROM c"))
def pair_cost_meaning_only(spark, sf_dir):
    return matching.pairs(truth(spark, sf_dir), valid(spark, sf_dir), C.MEANING_ONLY).select(KEY, F.col("g.id").alias("gt_id"), F.col("p.id").alias("pred_id"), F.round("cost", 6).alias("cost"))


@register(
    "match_total_cost",
    duck(f"""WITH {ALL_PAIRS},
n AS (SELECT drawing_id, max(gi) AS n_gt, max(pj) AS n_pred FROM (SELECT drawing_id, dense_rank() OVER (PARTITION BY drawing_id ORDER BY gt_id) AS gi, dense_rank() OVER (PARTITION BY drawing_id ORDER BY pred_id) AS pj FROM c) GROUP BY drawing_id),
r AS (SELECT drawing_id, dense_rank() OVER (PARTITION BY drawing_id ORDER BY gt_id) AS gi, dense_rank() OVER (PARTITION BY drawing_id ORDER BY pred_id) - 1 AS pj, cost FROM c),
RECURSIVE dp AS (SELECT drawing_id, 0::BIGINT AS gi, 0::BIGINT AS mask, 0::DOUBLE AS cost FROM n
 UNION ALL SELECT drawing_id, gi, mask, min(cost) FROM (
  SELECT dp.drawing_id, dp.gi + 1 AS gi, dp.mask | (1::BIGINT << r.pj) AS mask, dp.cost + r.cost AS cost FROM dp JOIN r ON r.drawing_id = dp.drawing_id AND r.gi = dp.gi + 1 WHERE (dp.mask & (1::BIGINT << r.pj)) = 0
  UNION ALL SELECT dp.drawing_id, dp.gi + 1, dp.mask, dp.cost FROM dp JOIN n ON n.drawing_id = dp.drawing_id WHERE dp.gi < n.n_gt AND n.n_gt > n.n_pred) GROUP BY drawing_id, gi, mask)
SELECT n.drawing_id, n.n_gt, n.n_pred, round(min(dp.cost), 6) AS total_cost FROM n JOIN dp ON n.drawing_id = dp.drawing_id AND dp.gi = n.n_gt AND bit_count(dp.mask) = least(n.n_gt, n.n_pred) GROUP BY ALL"""),
)
def match_total_cost(spark, sf_dir):
    g, p = truth(spark, sf_dir), valid(spark, sf_dir)
    sizes = g.groupBy(KEY).agg(F.count(F.lit(1)).alias("n_gt")).join(p.groupBy(KEY).agg(F.count(F.lit(1)).alias("n_pred")), KEY)
    return sizes.join(matching.assign(g, p).groupBy(KEY).agg(F.round(F.sum("cost"), 6).alias("total_cost")), KEY)


@register("text_decimals", duck(f"SELECT drawing_id, id, CAST({LSD} AS INT) AS decimals FROM gt_char"))
def text_decimals(spark, sf_dir):
    return truth(spark, sf_dir).select(KEY, "id", C.decimals(F.col("raw_text")).cast("int").alias("decimals"))


@register(
    "tier2_flags",
    duck(f"""WITH {PAIR} SELECT drawing_id, id, CASE WHEN kind = 'dimension' THEN nominal_ok END AS nominal_exact, CASE WHEN kind = 'dimension' THEN tol_ok END AS tolerance_exact,
CASE WHEN kind = 'dimension' THEN (CASE WHEN upper_tol IS NULL THEN p_upper IS NULL ELSE coalesce(abs(upper_tol * mm - p_upper * mm) <= pow(10, -({LSD})) * mm + 1e-9, false) END) AND (CASE WHEN lower_tol IS NULL THEN p_lower IS NULL ELSE coalesce(abs(lower_tol * mm - p_lower * mm) <= pow(10, -({LSD})) * mm + 1e-9, false) END) END AS tolerance_within_1lsd,
CASE WHEN kind = 'geometric_tolerance' THEN symbol_ok END AS symbol_accuracy, CASE WHEN kind = 'geometric_tolerance' THEN mod_ok END AS modifier_accuracy, CASE WHEN kind = 'geometric_tolerance' THEN refs_ok END AS datum_ref_exact,
CASE kind WHEN 'dimension' THEN nominal_ok AND tol_ok WHEN 'geometric_tolerance' THEN symbol_ok AND value_ok AND mod_ok AND refs_ok ELSE raw_text = p_text END AS perfect FROM kp"""),
)
def tier2_flags(spark, sf_dir):
    """Flags of the known pairs, which stand in one row of the lines."""
    rows = paired(spark, sf_dir).where(F.col("p").isNotNull() & ~F.col("malformed") & F.col("units").isNotNull())
    return scoring.correctness(rows.select(KEY, F.col("g.id").alias("id"), "g", "p"))


@register(
    "tier2_rates",
    duck(f"""WITH {PAIR}, f AS (SELECT profile, unnest([{{'m': 'nominal_exact', 'v': CASE WHEN kind = 'dimension' THEN nominal_ok END}}, {{'m': 'tolerance_exact', 'v': CASE WHEN kind = 'dimension' THEN tol_ok END}}, {{'m': 'symbol_accuracy', 'v': CASE WHEN kind = 'geometric_tolerance' THEN symbol_ok END}}, {{'m': 'modifier_accuracy', 'v': CASE WHEN kind = 'geometric_tolerance' THEN mod_ok END}}, {{'m': 'datum_ref_exact', 'v': CASE WHEN kind = 'geometric_tolerance' THEN refs_ok END}}]) AS x FROM kp)
SELECT profile, x.m AS metric, count(*) FILTER (x.v) AS hits, count(x.v) AS total, round(count(*) FILTER (x.v) / nullif(count(x.v), 0)::DOUBLE, 9) AS value FROM f GROUP BY ALL"""),
)
def tier2_rates(spark, sf_dir):
    pairs = known_pairs(spark, sf_dir).withColumn("profile", F.col("g.profile"))
    return scoring.tier2(scoring.correctness(pairs), ["profile"]).where("metric <> 'tolerance_within_1lsd'").withColumn("value", F.round("value", 9))


@register(
    "detection_counts",
    duck("""WITH g AS (SELECT drawing_id, count(*) AS n_gt FROM gt_char GROUP BY 1), p AS (SELECT drawing_id, count(*) AS n_pred, count(*) FILTER (malformed) AS malformed FROM pred_char GROUP BY 1)
SELECT g.drawing_id, n_gt, n_pred, n_pred - malformed AS tp, malformed AS fp, n_gt - n_pred + malformed AS fn, malformed FROM g JOIN p ON g.drawing_id = p.drawing_id"""),
)
def detection_counts(spark, sf_dir):
    return scoring.detection(truth(spark, sf_dir), valid(spark, sf_dir), malformed(spark, sf_dir), by_id(spark, sf_dir))


def _recall_sql(column: str) -> str:
    return duck(f"SELECT g.{column}, count(p.id) AS hits, count(*) AS total, round(count(p.id) / count(*)::DOUBLE, 9) AS recall FROM gt_char g LEFT JOIN (SELECT * FROM pred_char WHERE NOT malformed) p ON g.drawing_id = p.drawing_id AND g.id = p.id WHERE g.{column} IS NOT NULL GROUP BY 1")


@register("recall_by_kind", _recall_sql("kind"))
def recall_by_kind(spark, sf_dir):
    return scoring.recall_by(truth(spark, sf_dir), by_id(spark, sf_dir), "kind").withColumn("recall", F.round("recall", 9))


@register("recall_by_symbol", _recall_sql("gtol_symbol"))
def recall_by_symbol(spark, sf_dir):
    return scoring.recall_by(truth(spark, sf_dir), by_id(spark, sf_dir), "gtol_symbol").withColumn("recall", F.round("recall", 9))


@register("recall_critical", _recall_sql("is_critical"))
def recall_critical(spark, sf_dir):
    return scoring.recall_by(truth(spark, sf_dir), by_id(spark, sf_dir), "is_critical").withColumn("recall", F.round("recall", 9))


@register("missed_characteristics", duck("SELECT g.drawing_id, g.id, g.kind FROM gt_char g ANTI JOIN (SELECT * FROM pred_char WHERE NOT malformed) p ON g.drawing_id = p.drawing_id AND g.id = p.id"))
def missed_characteristics(spark, sf_dir):
    return matching.missed(truth(spark, sf_dir), by_id(spark, sf_dir)).select(KEY, "id", "kind")


@register("spurious_characteristics", duck("SELECT p.drawing_id, p.id, p.kind FROM (SELECT * FROM pred_char WHERE NOT malformed) p ANTI JOIN (SELECT * FROM gt_char WHERE kind <> 'note') g ON g.drawing_id = p.drawing_id AND g.id = p.id"))
def spurious_characteristics(spark, sf_dir):
    known = by_id(spark, sf_dir).join(truth(spark, sf_dir).where("kind <> 'note'").select(KEY, F.col("id").alias("gt_id")), [KEY, "gt_id"])
    return matching.spurious(valid(spark, sf_dir), known).select(KEY, "id", "kind")


@register("unscored_predictions", duck("SELECT DISTINCT p.drawing_id FROM pred_char p ANTI JOIN (SELECT * FROM drawing WHERE family <> '5-LOW') d ON p.drawing_id = d.drawing_id"))
def unscored_predictions(spark, sf_dir):
    """Predictions of drawings without ground truth are skipped and reported."""
    known = view(spark, sf_dir, "drawing").where("family <> '5-LOW'")
    return view(spark, sf_dir, "pred_char").select(KEY).distinct().join(known, KEY, "left_anti")


GRAPH = """
ge AS (SELECT g.drawing_id, concat('g', g.id) AS node, p.pos, p.label, CASE WHEN p.pos = 0 THEN g.ref_modifier END AS m FROM gt_char g JOIN (VALUES (0, 'A'), (1, 'B'), (2, 'C')) p(pos, label) ON p.pos < g.n_refs),
pe AS (SELECT g.drawing_id, concat('g', g.id) AS node, p.pos, p.label, CASE WHEN p.pos = 0 THEN g.ref_modifier END AS m FROM pred_char g JOIN (VALUES (0, 'A'), (1, 'B'), (2, 'C')) p(pos, label) ON p.pos < g.n_refs WHERE NOT g.malformed),
gn AS (SELECT drawing_id, label FROM ge UNION SELECT drawing_id, label FROM datum), pn AS (SELECT drawing_id, label FROM pe UNION SELECT drawing_id, label FROM datum WHERE pos < 2),
el AS (SELECT 'g' AS side, drawing_id, node, pos, label, m FROM ge UNION ALL SELECT 'p', drawing_id, node, pos, label, m FROM pe UNION ALL SELECT 'g', drawing_id, NULL, -1, label, NULL FROM gn UNION ALL SELECT 'p', drawing_id, NULL, -1, label, NULL FROM pn),
gd AS (SELECT drawing_id, sum(CASE WHEN n = 1 THEN 1 ELSE 0 END)::BIGINT AS difference, sum(n)::BIGINT AS total FROM (SELECT drawing_id, node, pos, label, m, count(*) AS n FROM el GROUP BY ALL) GROUP BY 1)"""


def _graph(spark, sf_dir):
    datums = view(spark, sf_dir, "datum")
    return scoring.graph_distance(truth(spark, sf_dir), valid(spark, sf_dir), datums, datums.where("pos < 2"), by_id(spark, sf_dir))


@register("datum_graph_distance", duck(f"WITH {GRAPH} SELECT drawing_id, difference, total, round(difference / total::DOUBLE, 9) AS distance FROM gd WHERE drawing_id IN (SELECT drawing_id FROM gt_char)"))
def datum_graph_distance(spark, sf_dir):
    return _graph(spark, sf_dir).withColumn("distance", F.round("distance", 9))


def _charges(spark, sf_dir):
    g, p, m = truth(spark, sf_dir), valid(spark, sf_dir), by_id(spark, sf_dir)
    return scoring.charges(matching.joined(g, p, m), matching.missed(g, m), matching.spurious(p, m), malformed(spark, sf_dir))


@register("weighted_error_cost", duck(f"WITH {PAIR}, {CHARGES} SELECT drawing_id, error, count(*) AS n, round(sum(amount), 6) AS amount FROM cost GROUP BY ALL"))
def weighted_error_cost(spark, sf_dir):
    return _charges(spark, sf_dir).groupBy(KEY, "error").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("amount"), 6).alias("amount"))


@register("cost_breakdown", duck(f"WITH {PAIR}, {CHARGES} SELECT error, round(sum(amount), 3) AS amount, rank() OVER (ORDER BY round(sum(amount), 3) DESC) AS place FROM cost GROUP BY error"))
def cost_breakdown(spark, sf_dir):
    """Charges of all callouts, also of those without a drawing, as in the SQL."""
    known = F.col("p").isNotNull() & ~F.col("malformed") & F.col(KEY).isNotNull()
    costs = paired(spark, sf_dir).select(F.inline(scoring.side_charges(F.col("g"), F.col("p"), F.col("malformed"), known)))
    sums = costs.groupBy("error").agg(F.round(F.sum("amount"), 3).alias("amount"))
    return sums.withColumn("place", F.rank().over(Window.orderBy(F.desc("amount"))).cast("long"))


SCORES = f"""{PAIR}, {GRAPH}, {CHARGES},
pc AS (SELECT drawing_id, count(*) AS n_pred, count(*) FILTER (malformed) AS malformed FROM pred_char GROUP BY 1), gc AS (SELECT drawing_id, count(*) AS n_gt FROM gt_char GROUP BY 1),
im AS (SELECT drawing_id, count(*) FILTER (NOT CASE kind WHEN 'dimension' THEN nominal_ok AND tol_ok WHEN 'geometric_tolerance' THEN symbol_ok AND value_ok AND mod_ok AND refs_ok ELSE raw_text = p_text END) AS imperfect FROM kp GROUP BY 1),
cs AS (SELECT drawing_id, sum(amount) AS cost FROM cost GROUP BY 1),
sc AS (SELECT gc.drawing_id, d.profile, d.family, n_gt, n_pred, n_pred - malformed AS tp, malformed AS fp, n_gt - n_pred + malformed AS fn, malformed, coalesce(cs.cost, 0) AS cost, gd.difference / gd.total::DOUBLE AS graph_distance,
  (n_gt - n_pred + malformed = 0 AND malformed = 0 AND coalesce(imperfect, 0) = 0) AS exact_drawing
  FROM gc JOIN pc ON gc.drawing_id = pc.drawing_id JOIN drawing d ON gc.drawing_id = d.drawing_id JOIN gd ON gc.drawing_id = gd.drawing_id LEFT JOIN im ON gc.drawing_id = im.drawing_id LEFT JOIN cs ON gc.drawing_id = cs.drawing_id)"""
SUMS = """count(*) AS n_drawings, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, sum(malformed)::BIGINT AS malformed, count(*) FILTER (exact_drawing) AS exact_drawings, round(avg(graph_distance), 6) AS mean_graph_distance, round(sum(cost), 3) AS cost,
round(sum(tp) / nullif(sum(tp) + sum(fp), 0)::DOUBLE, 6) AS precision, round(sum(tp) / nullif(sum(tp) + sum(fn), 0)::DOUBLE, 6) AS recall, round(2 * sum(tp) / nullif(2 * sum(tp) + sum(fp) + sum(fn), 0)::DOUBLE, 6) AS f1, round(count(*) FILTER (exact_drawing) / count(*)::DOUBLE, 6) AS exact_rate"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all drawings by the known pairs: the lines are dealt out once, the datums and drawings once each."""
    rows = paired(spark, sf_dir).where(F.col("units").isNotNull())
    known = F.col("p").isNotNull() & ~F.col("malformed")
    return scoring.paired_scores(rows, known, view(spark, sf_dir, "datum").select(KEY, "label", (F.col("pos") < 2).alias("predicted")), also=("profile", "family"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 3 if c == "cost" else 6).alias(c) if t == "double" else c for c, t in df.dtypes))


@register("drawing_scores", duck(f"WITH {SCORES} SELECT drawing_id, n_gt, n_pred, tp, fp, fn, malformed, round(cost, 6) AS cost, round(graph_distance, 9) AS graph_distance, exact_drawing FROM sc"))
def drawing_scores(spark, sf_dir):
    return scores(spark, sf_dir).select(KEY, "n_gt", "n_pred", "tp", "fp", "fn", "malformed", F.round("cost", 6).alias("cost"), F.round("graph_distance", 9).alias("graph_distance"), "exact_drawing")


@register("score_by_profile", duck(f"WITH {SCORES} SELECT profile, {SUMS} FROM sc GROUP BY profile"))
def score_by_profile(spark, sf_dir):
    return _rounded(scoring.run_summary(scores(spark, sf_dir), "profile"))


@register("score_by_family", duck(f"WITH {SCORES} SELECT family, {SUMS} FROM sc GROUP BY family"))
def score_by_family(spark, sf_dir):
    return _rounded(scoring.run_summary(scores(spark, sf_dir), "family"))


@register("run_summary", duck(f"WITH {SCORES} SELECT {SUMS} FROM sc"))
def run_summary(spark, sf_dir):
    return _rounded(scoring.run_summary(scores(spark, sf_dir)))


@register("evaluate_end_to_end")
def evaluate_end_to_end(spark, sf_dir):
    """Scores by profile with the pairs that the global assignment finds (no SQL: ties of equal cost)."""
    g, p = truth(spark, sf_dir), valid(spark, sf_dir)
    m = cut(matching.match(g, p).select(KEY, "gt_id", "pred_id"))  # ids only; every tier reads them
    datums = view(spark, sf_dir, "datum")
    every = scoring.drawing_scores(g, p, malformed(spark, sf_dir), datums, datums.where("pos < 2"), m, matching.joined(g, p, m))
    return _rounded(scoring.run_summary(every.join(view(spark, sf_dir, "drawing").select(KEY, "profile"), KEY), "profile"))
