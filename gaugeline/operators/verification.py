"""Checks of a drawing against the sizes of its solid, with a conservative verdict.

Each check gives rows of verdicts (drawing_id, id, check, verdict, confidence) or of
defects (drawing_id, id, type). Verdicts are reduced per callout: the worst wins.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gaugeline.constants import AXIAL_DATUMS, COARSE_PITCH, DOF, LOCATING, MM_PER_INCH, ORIENTING, RUNOUT
from gaugeline.functions.callouts import iou, to_mm
from gaugeline.operators.solids import hole_patterns, round_faces, sizes
from gaugeline.sources.shared import checked_broadcast, cut

KEY = "drawing_id"
ROUNDING, WIDE, WIDE_FLOOR = 0.02, 8.0, 0.5
TAP_SLOP = 0.3
LINK = 0.06
CLOSURE, CLOSURE_FLOOR, LEAST_SHARE = 0.1, 0.01, 0.05
UNIT_TOLERANCE, LEAST_ENVELOPE = 0.35, 1.0
RANK = {"verified": 0, "unverifiable": 1, "contradicted": 2}


def band(chars: DataFrame) -> Column:
    """How far a real size may be from the stated one: the larger deviation and the rounding of drawings."""
    upper, lower = (F.coalesce(to_mm(F.col(c), F.col("units")), F.lit(0.0)) for c in ("upper_tol", "lower_tol"))
    return F.greatest(F.abs(upper), F.abs(lower)) + ROUNDING


def checkable(chars: DataFrame) -> DataFrame:
    """Sizes that geometry can answer for, with target and bands in millimetres."""
    rows = chars.where((F.col("kind") == "dimension") & F.col("nominal").isNotNull() & F.col("dim_type").isin("diameter", "radius", "linear") & ~F.col("is_reference"))
    return rows.withColumn("target", to_mm(F.col("nominal"), F.col("units"))).withColumn("tight", band(rows)).withColumn("wide", F.greatest(F.col("tight") * WIDE, F.lit(WIDE_FLOOR)))


def solid_sizes(faces: DataFrame, envelope: DataFrame) -> DataFrame:
    """One row a solid with all that its sizes can be: ``length`` and ``diameter`` (rank, value, source), and ``drill``, the diameters of round faces."""
    faces = cut(faces)  # ten relations read it
    found = sizes(faces, envelope).select("solid_id", "family", F.struct("rank", "value", "source").alias("size"))
    drills = round_faces(faces).select("solid_id", F.lit("drill").alias("family"), F.struct(F.lit(0).alias("rank"), (2 * F.col("radius")).alias("value"), F.lit("").alias("source")).alias("size"))
    lists = [F.collect_list(F.when(F.col("family") == f, F.col("size"))).alias(f) for f in ("length", "diameter", "drill")]
    return found.unionByName(drills).groupBy("solid_id").agg(*lists)


def with_sizes(targets: DataFrame, faces: DataFrame, envelope: DataFrame) -> DataFrame:
    """Targets with ``close``, the distinct sizes within the wide band, ``nearby``, all sizes by distance, and ``tap``.

    The sizes of a solid are gathered once and joined as one row, so a solid that
    very many drawings show is no hot key; all the rest is arrays of one target.
    Equal sizes (to 4 places, radii to 6) are one candidate, named by the first
    source; a radius is half a diameter, found in twice the band. Bolt circles
    are candidates but not offered as nearby. ``tap`` tells diameters that may be
    threads whose drilled hole the solid has.
    """
    none = F.array().cast("array<struct<rank:int,value:double,source:string>>")
    linear, target = F.col("dim_type") == "linear", F.col("target")
    half = F.when(F.col("dim_type") == "radius", 2.0).otherwise(1.0)
    pitch = F.create_map(*[F.lit(x) for kv in COARSE_PITCH.items() for x in kv])[F.bround(target, 3)]
    both = targets.join(checked_broadcast(solid_sizes(faces, envelope)), "solid_id", "left")
    both = both.withColumn("found", F.coalesce(F.when(linear, F.col("length")).otherwise(F.col("diameter")), none)).withColumn("pitch", F.when(F.col("dim_type") == "diameter", pitch))
    band = F.filter(F.transform("found", lambda s: F.struct(s["rank"].alias("rank"), (s["value"] / half).alias("value"), s["source"].alias("source"), F.abs(s["value"] / half - target).alias("error"))), lambda s: s["error"] <= F.col("wide"))
    name = lambda s: F.struct(F.when(linear, F.bround(s["value"], 4)).otherwise(s["value"]).alias("one"), F.when(linear, F.lit("")).otherwise(s["source"]).alias("kind"))
    both = both.withColumn("band", F.array_sort(band)).withColumn("names", F.transform("band", name))
    close = F.filter("band", lambda s, i: F.array_position(F.col("names"), F.element_at("names", i + 1)) == i + 1)
    offered = F.array_distinct(F.transform(F.filter("found", lambda s: s["source"] != "bolt_circle"), lambda s: F.when(linear, F.bround(s["value"], 4)).otherwise(s["value"])))
    near = F.array_sort(F.transform(offered, lambda v: F.struct(F.abs(v / half - target).alias("error"), (v / half).alias("value"))))
    low, high = target - F.col("pitch") - TAP_SLOP, target - 0.5 * F.col("pitch") + TAP_SLOP
    tap = F.coalesce(F.exists("drill", lambda d: d["value"].between(low, high)), F.lit(False))
    return both.select(*targets.columns, close.alias("close"), F.transform(near, lambda s: s["value"]).alias("nearby"), tap.alias("tap"))


def candidates(targets: DataFrame, faces: DataFrame, envelope: DataFrame) -> DataFrame:
    """Distinct sizes of the solid within the wide band of each target: (drawing_id, id, value, error, source)."""
    return with_sizes(targets, faces, envelope).select(KEY, "id", F.explode("close").alias("c")).select(KEY, "id", "c.value", "c.error", "c.source")


def tap_drills(targets: DataFrame, faces: DataFrame) -> DataFrame:
    """Diameters that may be threads whose drilled hole the solid has: (drawing_id, id)."""
    none = faces.select("solid_id").limit(0).select("solid_id", *(F.lit(None).cast("double").alias(c) for c in ("ex", "ey", "ez")))
    return with_sizes(targets, faces, none).where("tap").select(KEY, "id").distinct()


def nearest(targets: DataFrame, faces: DataFrame, envelope: DataFrame, *, count: int = 3) -> DataFrame:
    """The closest distinct sizes of the solid for each target, nearest first, the smaller on ties: (drawing_id, id, nearby)."""
    return with_sizes(targets, faces, envelope).select(KEY, "id", F.slice("nearby", 1, count).alias("nearby"))


def size_check(chars: DataFrame, faces: DataFrame, envelope: DataFrame) -> DataFrame:
    """Whether a stated size exists: one close candidate verifies, several or a near one decide nothing, none contradicts.

    ``chars`` has solid_id. Returns verdict rows with ``correction``, the nearest
    size where it clearly stands out, in the drawing's units.
    """
    rows = with_sizes(checkable(chars), faces, envelope)
    near = F.size(F.filter("close", lambda c: c["error"] <= F.col("tight")))
    verdict = F.when(near == 1, "verified").when((F.size("close") > 0) | F.col("tap"), "unverifiable").otherwise("contradicted")
    least = F.array_min(F.transform("close", lambda c: c["error"]))
    sure = F.bround(F.least(F.lit(1.0), 0.75 + 0.25 * (1.0 - least / F.greatest("tight", F.lit(1e-9)))), 3)
    best, second = F.try_element_at("nearby", F.lit(1)), F.try_element_at("nearby", F.lit(2))
    far = F.when(best.isNull(), 0.6).when(F.abs(best - F.col("target")) < 0.25 * F.greatest("target", F.lit(1e-9)), 0.95).otherwise(0.75)
    scale = F.when(F.col("units") == "inch", MM_PER_INCH).otherwise(1.0)
    unclear = second.isNotNull() & (F.abs(second - F.col("target")) < 1.6 * F.abs(best - F.col("target")))
    correction = F.when((F.col("verdict") == "contradicted") & ~unclear, F.bround(best / scale, 4))
    out = rows.withColumn("verdict", verdict)
    confidence = F.when(F.col("verdict") == "verified", sure).when(F.col("verdict") == "contradicted", far).otherwise(0.5)
    answered = out.select(KEY, "id", F.lit("size_exists").alias("check"), "verdict", confidence.alias("confidence"), correction.alias("correction"))
    asked = chars.where((F.col("kind") == "dimension") & F.col("nominal").isNotNull())
    rest = asked.where(~F.col("dim_type").isin("diameter", "radius", "linear") | F.col("is_reference"))
    return answered.unionByName(rest.select(KEY, "id", F.lit("size_exists").alias("check"), F.lit("unverifiable").alias("verdict"), F.lit(0.5).alias("confidence"), F.lit(None).cast("double").alias("correction")))


def constrained(types: Column) -> Column:
    """Degrees of freedom that an ordered array of datum types removes: the first three, 6 at most."""
    table = F.create_map(*[x for k, v in DOF.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    each = F.transform(F.slice(types, 1, 3), lambda t, i: F.coalesce(F.try_element_at(F.try_element_at(table, t), (i + 1).cast("int")), F.lit(0)))
    return F.least(F.lit(6), F.aggregate(each, F.lit(0), lambda s, x: s + x))


def sufficient(symbol: Column, types: Column) -> Column:
    """Whether a frame constrains enough for the tolerance to mean something."""
    axial = F.exists(types, lambda t: t.isin(*AXIAL_DATUMS))
    needed = F.when(symbol.isin(*ORIENTING), 3).when(symbol.isin(*LOCATING), F.when(axial, 5).otherwise(6))
    return F.when(symbol.isin(*RUNOUT), axial).when(needed.isNull(), True).otherwise(constrained(types) >= needed)


def frame_types(chars: DataFrame, datums: DataFrame) -> DataFrame:
    """Callouts with the datum types of their references in order, null for a label that is not declared."""
    known = datums.groupBy(KEY).agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("label", "feature_type")))).alias("known"))
    none = F.create_map().cast("map<string,string>")
    return chars.join(known, KEY, "left").withColumn("types", F.transform("datum_refs", lambda r: F.try_element_at(F.coalesce("known", none), r["label"]))).drop("known")


def frame_check(chars: DataFrame, datums: DataFrame) -> DataFrame:
    """Defects of reference frames: undeclared datums, runout without an axis, too few constraints."""
    rows = frame_types(chars.where((F.col("kind") == "geometric_tolerance") & F.col("gtol_symbol").isNotNull() & (F.size("datum_refs") > 0)), datums)
    symbol = F.col("gtol_symbol")
    type_ = F.when(F.exists("types", lambda t: t.isNull()), "undeclared_datum").when(~sufficient(symbol, F.col("types")), F.when(symbol.isin(*RUNOUT), "runout_without_an_axis").when(symbol.isin(*ORIENTING, *LOCATING), "underconstrained_drf"))
    return rows.select(KEY, "id", type_.alias("type")).where(F.col("type").isNotNull())


def unused_datums(chars: DataFrame, datums: DataFrame) -> DataFrame:
    """Declared datums that no callout references: (drawing_id, label)."""
    used = chars.select(KEY, F.explode("datum_refs").alias("r")).select(KEY, F.col("r.label").alias("label")).distinct()
    return datums.select(KEY, "label").join(used, [KEY, "label"], "left_anti")


def linked_sizes(chars: DataFrame, drawings: DataFrame) -> DataFrame:
    """For each modified tolerance the size that points at the same feature: overlap first, then nearness, then order."""
    frames = chars.where((F.col("kind") == "geometric_tolerance") & F.col("material_modifier").isNotNull())
    found = chars.where((F.col("kind") == "dimension") & F.col("nominal").isNotNull()).select(KEY, "view", F.struct("id", "bbox", "nominal", "upper_tol", "lower_tol", "dim_type", "raw_text").alias("size"))
    both = frames.join(drawings.select(KEY, "image_w", "image_h", "general_tolerance"), KEY).join(found, [KEY, "view"], "left")
    a, b = F.col("bbox"), F.col("size.bbox")
    apart = F.hypot((a["x0"] + a["x1"]) / 2 - (b["x0"] + b["x1"]) / 2, (a["y0"] + a["y1"]) / 2 - (b["y0"] + b["y1"]) / 2)
    both = both.withColumn("overlap", iou(a, b)).withColumn("far", apart / F.hypot(F.col("image_w").cast("double"), F.col("image_h").cast("double")))
    linked = F.col("size").isNotNull() & ((F.col("overlap") > 0) | (F.col("far") <= LINK))
    best = F.min_by(F.when(linked, F.col("size")), F.when(linked, F.struct(-F.col("overlap"), F.col("far"), F.col("size.id"))))
    fields = ["units", "material_modifier", "gtol_value", "general_tolerance", "solid_id"]
    return both.groupBy(KEY, "id").agg(*(F.first(f).alias(f) for f in fields), best.alias("size"))


def modifier_check(chars: DataFrame, drawings: DataFrame, faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Verdicts and defects of material modifiers: a bonus needs a size tolerance, and holes need material between them."""
    rows = linked_sizes(chars, drawings)
    units = F.col("units")
    upper, lower, nominal = (F.coalesce(to_mm(F.col(f"size.{c}"), units), F.lit(0.0)) for c in ("upper_tol", "lower_tol", "nominal"))
    zone = F.coalesce(to_mm(F.col("gtol_value"), units), F.lit(0.0))
    text = F.upper(F.coalesce("size.raw_text", F.lit("")))
    internal = (F.col("size.dim_type") == "diameter") & (F.contains(text, F.lit("⌀")) | text.rlike("HOLE|BORE|THRU"))
    rows = rows.withColumn("span", F.abs(upper - lower)).withColumn("internal", internal).withColumn("size_mm", nominal)
    rows = rows.withColumn("virtual", F.when(F.col("internal"), nominal + lower - zone).otherwise(nominal + upper + zone))
    rings = hole_patterns(faces).where("count >= 2").select("solid_id", (2 * F.col("radius")).alias("hole"), (F.col("bolt_circle") * F.sin(F.lit(math.pi) / F.col("count"))).alias("spacing"))
    breached = rows.where("internal AND span > 1e-9").join(rings, "solid_id").where((F.abs(F.col("hole") - F.col("size_mm")) <= 0.5) & (F.col("spacing") <= F.col("virtual"))).select(KEY, "id").distinct().withColumn("breach", F.lit(True))
    rows = rows.join(breached, [KEY, "id"], "left")
    bare = F.col("size").isNotNull() & (F.col("span") <= 1e-9)
    defect = F.when(bare & F.col("general_tolerance").isNull(), "modifier_without_size_tolerance").when(F.col("breach"), "virtual_condition_interference")
    verdict = F.when(F.col("size").isNull(), "unverifiable").when(bare & F.col("general_tolerance").isNotNull(), "unverifiable").when(bare, None).when(F.col("breach"), "unverifiable").otherwise("verified")
    rows = rows.withColumn("verdict", verdict).withColumn("type", defect)
    verdicts = rows.where(F.col("verdict").isNotNull()).select(KEY, "id", F.lit("mmc_consistency").alias("check"), "verdict", F.when(F.col("verdict") == "verified", 0.85).otherwise(0.5).alias("confidence"))
    on_refs = chars.where((F.col("kind") == "geometric_tolerance") & F.col("material_modifier").isNull() & F.exists("datum_refs", lambda r: r["modifier"].isNotNull()))
    verdicts = verdicts.unionByName(on_refs.select(KEY, "id", F.lit("mmc_consistency").alias("check"), F.lit("unverifiable").alias("verdict"), F.lit(0.5).alias("confidence")))
    return verdicts, rows.where(F.col("type").isNotNull()).select(KEY, "id", "type")


def chain_check(chars: DataFrame) -> DataFrame:
    """Chains of two or three linear sizes of a view that add up to another one: (drawing_id, id, type, parts).

    Self-joins on (drawing, view) with ordered ids; of one set of sizes the first
    total in order counts.
    """
    units = F.col("units")
    rows = chars.where((F.col("kind") == "dimension") & (F.col("dim_type") == "linear") & F.col("nominal").isNotNull() & ~F.col("is_reference"))
    upper, lower = to_mm(F.col("upper_tol"), units), to_mm(F.col("lower_tol"), units)
    rows = rows.select(KEY, "view", "id", to_mm(F.col("nominal"), units).alias("v"), F.coalesce(F.abs(upper - lower), F.lit(0.0)).alias("t")).where("v > 0")
    on = [KEY, "view"]

    def side(name: str) -> DataFrame:
        return rows.select(*on, F.struct("id", "v", "t").alias(name))

    total, a, b, c = (F.col(x) for x in ("total", "a", "b", "c"))
    two = side("total").join(side("a"), on).where((a["id"] != total["id"]) & (a["v"] >= LEAST_SHARE * total["v"])).join(side("b"), on).where((b["id"] > a["id"]) & (b["id"] != total["id"]) & (b["v"] >= LEAST_SHARE * total["v"]))
    # a chain of three is only tried where two parts leave room for a third
    three = two.where(a["v"] + b["v"] < total["v"] * (1 + CLOSURE) + 1).join(side("c"), on).where((c["id"] > b["id"]) & (c["id"] != total["id"]) & (c["v"] >= LEAST_SHARE * total["v"]))
    found = two.select(*on, "total", F.array("a", "b").alias("parts")).unionByName(three.select(*on, "total", F.array("a", "b", "c").alias("parts")))
    add = lambda s, x: s + x
    chain = F.aggregate(F.transform("parts", lambda p: p["v"]), F.lit(0.0), add)
    stacked = F.aggregate(F.transform("parts", lambda p: p["t"]), F.lit(0.0), add)
    least = F.least(F.array_min(F.transform("parts", lambda p: p["t"])), total["t"])
    found = found.where(F.abs(chain - total["v"]) <= F.greatest(least * CLOSURE, F.lit(CLOSURE_FLOOR)))
    ids = F.transform("parts", lambda p: p["id"])
    found = found.withColumn("ids", ids).withColumn("stacked", stacked).withColumn("members", F.array_sort(F.concat("ids", F.array(total["id"]))))
    first = F.row_number().over(Window.partitionBy(KEY, "view", "members").orderBy(total["id"], F.size("ids"), "ids"))
    found = found.withColumn("first", first).where("first = 1")
    type_ = F.when((total["t"] > 0) & (F.col("stacked") > 0), "overdimensioned_chain").when(F.col("stacked") > total["t"] + 1e-9, "tolerance_accumulation")
    return found.select(KEY, total["id"].alias("id"), type_.alias("type"), F.array_join("ids", ",").alias("parts")).where(F.col("type").isNotNull())


def unit_check(chars: DataFrame, envelope: DataFrame) -> DataFrame:
    """Drawings whose largest size is the solid's extent times or by 25.4: (drawing_id, type)."""
    largest = chars.where((F.col("kind") == "dimension") & F.col("dim_type").isin("linear", "diameter", "radius") & (F.col("nominal") > 0)).groupBy(KEY, "solid_id").agg(F.max(to_mm(F.col("nominal"), F.col("units"))).alias("largest"))
    both = largest.join(envelope.select("solid_id", F.greatest("ex", "ey", "ez").alias("across")), "solid_id").where(F.col("across") >= LEAST_ENVELOPE)
    ratio = F.col("largest") / F.col("across")

    def near(factor: float) -> Column:
        return F.abs(ratio - factor) <= UNIT_TOLERANCE * factor

    return both.where(~near(1.0) & (near(1 / MM_PER_INCH) | near(MM_PER_INCH))).select(KEY, F.lit("unit_mismatch").alias("type"), F.when(near(1 / MM_PER_INCH), "inches as millimetres").otherwise("millimetres as inches").alias("looks_like"))


def reduced(chars: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One verdict a callout: the worst, then the surest, then the first check; without any, unverifiable."""
    order = F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv])
    seq = F.when(F.col("check") == "size_exists", 0).otherwise(1)
    best = verdicts.groupBy(KEY, "id").agg(F.max_by(F.struct("verdict", "check", "confidence"), F.struct(order[F.col("verdict")], F.col("confidence"), -seq)).alias("v"))
    rows = chars.select(KEY, "id").join(best, [KEY, "id"], "left")
    return rows.select(KEY, "id", F.coalesce("v.verdict", F.lit("unverifiable")).alias("verdict"), F.coalesce("v.check", F.lit("none")).alias("check"), F.coalesce("v.confidence", F.lit(0.5)).alias("confidence"))


def verdict_summary(verdicts: DataFrame) -> DataFrame:
    """Counts of the three verdicts, a row a drawing."""
    return verdicts.groupBy(KEY).agg(*(F.count_if(F.col("verdict") == v).alias(v) for v in RANK))
