"""Drawings and predictions as files: strict and lenient reading, writing, and finding what belongs together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.operators.rules import KEY, callout_rules, drawing_faults, first_reason, judged, unknown_keys

CALLOUT_FIELDS = ["id", "kind", "view", "bbox", "leader_target_bbox", "dim_type", "nominal", "upper_tol", "lower_tol", "tol_style", "fit_class", "is_basic", "is_reference", "is_critical", "gtol_symbol", "gtol_value", "gtol_zone", "material_modifier", "datum_refs", "raw_text", "notes"]
CALLOUT = "id INT, kind STRING, view STRING, bbox ARRAY<DOUBLE>, leader_target_bbox ARRAY<DOUBLE>, dim_type STRING, nominal DOUBLE, upper_tol DOUBLE, lower_tol DOUBLE, tol_style STRING, fit_class STRING, is_basic BOOLEAN, is_reference BOOLEAN, is_critical BOOLEAN, gtol_symbol STRING, gtol_value DOUBLE, gtol_zone STRING, material_modifier STRING, datum_refs ARRAY<STRUCT<label: STRING, modifier: STRING>>, raw_text STRING, notes STRING"
DATUM = "STRUCT<label: STRING, feature_type: STRING, view: STRING, bbox: ARRAY<DOUBLE>, geometry_ref: STRING>"
DRAWING = f"drawing_id STRING, source STRING, part_ref STRING, units STRING, projection STRING, image_size ARRAY<INT>, sheet STRUCT<size: STRING, scale: STRING>, title_block STRUCT<part_number: STRING, revision: STRING, material: STRING, general_tolerance: STRING, surface_finish_default: STRING>, datums ARRAY<{DATUM}>, characteristics ARRAY<STRING>, provenance STRUCT<generator_version: STRING, generator_seed: BIGINT, degradation_profile: STRING, house_style: STRING, labeler: STRING>"


def documents(spark: SparkSession, path: str) -> DataFrame:
    """Every JSON file under a folder as (path, stem, text), without manifests."""
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json")
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    rows = rows.select(F.col("_metadata.file_path").alias("path"), F.regexp_replace(name, r"\.json$", "").alias("stem"), F.col("value").alias("text"))
    return rows.where(F.col("stem") != "manifest")


def _box(values: Column) -> Column:
    return F.when(F.size(values) == 4, F.struct(*(F.element_at(values, i + 1).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1")))))


def _callouts(items: DataFrame) -> DataFrame:
    """Columns of a callout from ``raw``, a JSON object; flags default to false, references to none."""
    c = items.withColumn("c", F.from_json("raw", CALLOUT))
    fields = [F.coalesce(f"c.{f}", F.lit(False)).alias(f) if f.startswith("is_") else _box(F.col(f"c.{f}")).alias(f) if f.endswith("bbox") else F.coalesce(f"c.{f}", F.array().cast("ARRAY<STRUCT<label: STRING, modifier: STRING>>")).alias(f) if f == "datum_refs" else F.col(f"c.{f}").alias(f) for f in CALLOUT_FIELDS]
    return c.select(*[x for x in items.columns], *fields)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Predicted items, each judged by itself: (drawing_id, units, idx, raw, callout fields, reason).

    An item with an unknown key, a field that does not convert or a broken rule
    has a reason and is malformed; the file's stem stands in for a missing id.
    Files that are not JSON objects give one malformed item.
    """
    files = documents(spark, path).withColumn("d", F.from_json("text", "drawing_id STRING, units STRING, characteristics ARRAY<STRING>, results ARRAY<STRING>"))
    return items_of(files.select(F.coalesce("d.drawing_id", "stem").alias(KEY), F.coalesce("d.units", F.lit("mm")).alias("units"), F.when(F.try_parse_json("text").isNull(), F.array(F.lit(None).cast("string"))).otherwise(F.coalesce("d.characteristics", "d.results")).alias("items")))


def items_of(payloads: DataFrame) -> DataFrame:
    """The judged items of (drawing_id, units, items), items an array of JSON texts."""
    items = payloads.select(KEY, "units", F.posexplode("items").alias("idx", "raw"))
    rows = _callouts(items)
    keys = F.json_object_keys("raw")
    bad_number = F.lit(False)
    for f in ("nominal", "upper_tol", "lower_tol", "gtol_value"):
        bad_number = bad_number | (F.get_json_object("raw", f"$.{f}").isNotNull() & F.get_json_object("raw", f"$.{f}").try_cast("double").isNull())
    first = [("no JSON object", F.col("raw").isNull() | keys.isNull()), ("unknown key", F.size(unknown_keys(F.col("raw"), CALLOUT_FIELDS)) > 0), ("not a number", bad_number)]
    return rows.withColumn("reason", first_reason(first + callout_rules()))


def read_drawings(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ground truth, strictly: drawings, callouts and datums of files without any fault.

    A file with a fault in any callout or across the drawing is left out of all
    three; ``faults`` below tells why.
    """
    files = documents(spark, path).withColumn("d", F.from_json("text", DRAWING)).where(F.col("d.drawing_id").isNotNull() & (F.size("d.characteristics") > 0))
    drawings = files.select("path", "d.*").withColumn("profile", F.col("provenance.degradation_profile"))
    chars = judged(_callouts(drawings.select("path", KEY, "units", "profile", F.posexplode("characteristics").alias("idx", "raw"))))
    datums = drawings.select("path", KEY, "profile", F.posexplode("datums").alias("pos", "x")).select("path", KEY, "profile", "pos", "x.label", "x.feature_type", "x.view", _box(F.col("x.bbox")).alias("bbox"), "x.geometry_ref")
    bad = faults(chars, datums).select("path").distinct()
    return tuple(t.join(bad, "path", "left_anti") for t in (drawings.drop("characteristics", "datums"), chars.drop("reason"), datums))


def faults(chars: DataFrame, datums: DataFrame) -> DataFrame:
    """(path, reason) of every fault; ``path`` tells files of one drawing id apart."""
    of_items = chars.where(F.col("reason").isNotNull()).select("path", "reason")
    across = drawing_faults(chars.drop(KEY).withColumnRenamed("path", KEY), datums.drop(KEY).withColumnRenamed("path", KEY))
    return of_items.union(across.select(F.col(KEY).alias("path"), "reason"))


def write_drawings(drawings: DataFrame, path: str) -> None:
    """One JSON object a row, nulls kept."""
    drawings.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def folder(path: Column) -> Column:
    return F.regexp_replace(path, r"[^/]*$", "")


def image_of(truth: DataFrame, listing: DataFrame) -> DataFrame:
    """For each (path) of ground truth the first image beside it whose name begins with its stem, overlays aside.

    All beginnings of an image's stem, up to a '_' or the whole, are exploded, so
    that the join is an equality.
    """
    images = listing.where(F.col("path").endswith(".png")).select(F.col("path").alias("image"), folder(F.col("path")).alias("folder"), stem(F.col("path")).alias("name")).where(~F.col("name").endswith("_overlay"))
    parts = F.split("name", "_")
    starts = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "_"))
    images = images.select("image", "folder", F.explode(starts).alias("stem"))
    return truth.select("path", folder(F.col("path")).alias("folder"), stem(F.col("path")).alias("stem")).join(images, ["folder", "stem"], "left").groupBy("path").agg(F.min("image").alias("image"))


def truth_of(images: DataFrame, listing: DataFrame, suffix: str = ".json") -> DataFrame:
    """For each image (path) the file beside it with the longest stem that the image's begins with, qualifier by qualifier."""
    name = stem(F.col("path"))
    parts = F.split(name, "_")
    starts = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "_"))
    wanted = images.select("path", folder(F.col("path")).alias("folder"), F.explode(starts).alias("stem"))
    files = listing.where(F.col("path").endswith(suffix)).select(F.col("path").alias("truth"), folder(F.col("path")).alias("folder"), stem(F.col("path")).alias("stem"))
    return wanted.join(files, ["folder", "stem"], "left").groupBy("path").agg(F.max_by("truth", F.when(F.col("truth").isNotNull(), F.length("stem"))).alias("truth"))


def solid_of(drawings: DataFrame, listing: DataFrame) -> DataFrame:
    """For each drawing (drawing_id, path, part_ref) its solid: the part's path, else its name beside the drawing, else any solid there."""
    solids = listing.where(F.lower("path").rlike(r"\.ste?p$")).select(F.col("path").alias("solid"))
    rows = drawings.withColumn("folder", folder(F.col("path"))).withColumn("beside", F.concat("folder", F.element_at(F.split("part_ref", "/"), -1)))
    rows = rows.join(solids.select(F.col("solid").alias("named")), F.col("part_ref") == F.col("named"), "left")
    rows = rows.join(solids.select(F.col("solid").alias("near")), F.col("beside") == F.col("near"), "left")
    there = solids.groupBy(folder(F.col("solid")).alias("folder")).agg(F.min("solid").alias("there"))
    return rows.join(there, "folder", "left").select(KEY, F.coalesce("named", "near", "there").alias("solid"))


def unfinished(drawings: DataFrame, done: DataFrame) -> DataFrame:
    """Drawings without an output yet."""
    return drawings.join(done.select(KEY).distinct(), KEY, "left_anti")


def limited(drawings: DataFrame, most: int | None, *, order: str = KEY) -> DataFrame:
    """The first drawings of a run, in order; all without a limit."""
    return drawings if most is None else drawings.orderBy(order).limit(most)
