"""The schema as data-quality rules: reasons a callout, a drawing or a datum is not valid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.constants import DATUM_REQUIRED, DIM_TYPES, FORM_SYMBOLS, KINDS, MODIFIERS, NO_MODIFIER, SIZED_DATUMS, SYMBOLS

KEY = "drawing_id"


def extent(box: Column) -> Column:
    return (box["x1"] > box["x0"]) & (box["y1"] > box["y0"])


def callout_rules() -> list[tuple[str, Column]]:
    """(reason, condition under which it holds) in the order in which they are asked."""
    c = F.col
    dimension, tolerance = c("kind") == "dimension", c("kind") == "geometric_tolerance"
    refs, labels = F.size("datum_refs"), F.transform("datum_refs", lambda r: r["label"])
    return [
        ("id", c("id").isNull() | (c("id") < 1)),
        ("kind", ~F.coalesce(c("kind").isin(*KINDS), F.lit(False))),
        ("dim_type", c("dim_type").isNotNull() & ~c("dim_type").isin(*DIM_TYPES)),
        ("symbol", c("gtol_symbol").isNotNull() & ~c("gtol_symbol").isin(*SYMBOLS)),
        ("modifier", c("material_modifier").isNotNull() & ~c("material_modifier").isin(*MODIFIERS)),
        ("box", ~F.coalesce(extent(c("bbox")), F.lit(False))),
        ("dimension without type", dimension & c("dim_type").isNull()),
        ("dimension without nominal", dimension & c("nominal").isNull()),
        ("dimension with symbol", dimension & c("gtol_symbol").isNotNull()),
        ("tolerance without symbol", tolerance & c("gtol_symbol").isNull()),
        ("tolerance without value", tolerance & ~F.coalesce(c("gtol_value") > 0, F.lit(False))),
        ("datum required", tolerance & c("gtol_symbol").isin(*DATUM_REQUIRED) & (refs == 0)),
        ("datum on form", tolerance & c("gtol_symbol").isin(*FORM_SYMBOLS) & (refs > 0)),
        ("modifier without size", tolerance & c("material_modifier").isNotNull() & c("gtol_symbol").isin(*NO_MODIFIER)),
        ("repeated datum", tolerance & (F.size(F.array_distinct(labels)) < refs)),
        ("datums off a tolerance", ~tolerance & (refs > 0)),
        ("modifier off a tolerance", ~tolerance & c("material_modifier").isNotNull()),
        ("basic with tolerance", c("is_basic") & ((F.coalesce("upper_tol", F.lit(0.0)) != 0) | (F.coalesce("lower_tol", F.lit(0.0)) != 0))),
        ("deviations crossed", c("upper_tol") < c("lower_tol")),
    ]


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """The first rule broken, or null."""
    return F.coalesce(*(F.when(F.coalesce(broken, F.lit(False)), F.lit(reason)) for reason, broken in rules))


def judged(chars: DataFrame) -> DataFrame:
    """Callouts with ``reason``: null for valid ones."""
    return chars.withColumn("reason", first_reason(callout_rules()))


def drawing_faults(chars: DataFrame, datums: DataFrame) -> DataFrame:
    """Faults across a drawing: (drawing_id, reason), each once.

    Ids have to run from 1; labels are declared once, references are declared,
    and a modified reference needs a datum with a size.
    """
    ids = chars.groupBy(KEY).agg(F.count("id").alias("n"), F.countDistinct("id").alias("d"), F.min("id").alias("low"), F.max("id").alias("high"))
    numbering = ids.where((F.col("n") != F.col("d")) | (F.col("low") != 1) | (F.col("high") != F.col("n"))).select(KEY, F.lit("numbering").alias("reason"))
    twice = datums.groupBy(KEY, "label").count().where("count > 1").select(KEY, F.lit("datum declared twice").alias("reason"))
    refs = chars.select(KEY, F.explode("datum_refs").alias("r")).select(KEY, "r.label", "r.modifier").join(datums.select(KEY, "label", "feature_type").distinct(), [KEY, "label"], "left")
    of_refs = refs.select(KEY, F.when(F.col("feature_type").isNull(), "datum not declared").when(F.col("modifier").isNotNull() & ~F.col("feature_type").isin(*SIZED_DATUMS), "modifier on a datum without size").alias("reason")).where(F.col("reason").isNotNull())
    return numbering.union(twice).union(of_refs).distinct()


def outside(chars: DataFrame, drawings: DataFrame) -> DataFrame:
    """Callouts whose box leaves the image, where the image's size is known."""
    box = F.col("bbox")
    both = chars.join(drawings.select(KEY, "image_w", "image_h"), KEY).where(F.col("image_w").isNotNull())
    return both.where((box["x0"] < 0) | (box["y0"] < 0) | (box["x1"] > F.col("image_w")) | (box["y1"] > F.col("image_h"))).select(KEY, "id")


def unknown_keys(raw: Column, allowed: list[str]) -> Column:
    """Keys of a JSON object that the schema does not have."""
    return F.array_except(F.json_object_keys(raw), F.array(*map(F.lit, allowed)))
