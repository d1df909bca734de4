"""Choosing views, checking parts, measuring text, and counting runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALONG, ACROSS = 0.99, 0.01


def drawing_seed(seed: Column, family: Column) -> Column:
    """A 32-bit seed of a part's seed and family."""
    return F.pmod(seed * F.lit(1000003) + F.crc32(F.encode(family, "UTF-8")), F.lit(4294967296))


def view_choice(features: DataFrame, views: DataFrame, *, key: str = "solid_id") -> DataFrame:
    """For each feature (key, ord, dx, dy, dz) the view that sees its axis end on, and the one that sees it from the side; null where none does.

    ``views`` (view, pos, vx, vy, vz: unit directions) is a sheet's handful of
    views and is joined as a broadcast; the first view wins ties.
    """
    size = F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2 + F.col("dz") ** 2)
    cosine = F.abs(F.col("dx") * F.col("vx") + F.col("dy") * F.col("vy") + F.col("dz") * F.col("vz")) / size
    seen = features.where(size > 0).join(F.broadcast(views)).withColumn("cos", cosine)
    best = seen.groupBy(key, "ord").agg(F.max_by(F.struct("view", "cos"), F.struct("cos", -F.col("pos"))).alias("hi"), F.min_by(F.struct("view", "cos"), F.struct("cos", "pos")).alias("lo"))
    return best.select(key, "ord", F.when(F.col("hi.cos") > ALONG, F.col("hi.view")).alias("circular"), F.when(F.col("lo.cos") < ACROSS, F.col("lo.view")).alias("edge_on"))


def part_faults(features: DataFrame, faces: DataFrame, *, key: str = "solid_id") -> DataFrame:
    """Faults of features (key, fid, faces, parent, nominal): (key, fid, reason), each once."""
    twice = features.groupBy(key, "fid").count().where("count > 1").select(key, "fid", F.lit("duplicate id").alias("reason"))
    used = features.select(key, "fid", F.explode("faces").alias("face"))
    unknown = used.join(faces.select(key, F.col("fid").alias("face")), [key, "face"], "left_anti").select(key, "fid", F.lit("unknown face").alias("reason"))
    parents = features.where(F.col("parent").isNotNull()).select(key, "fid", "parent")
    orphans = parents.join(features.select(key, F.col("fid").alias("parent")), [key, "parent"], "left_anti").select(key, "fid", F.lit("unknown parent").alias("reason"))
    odd = F.exists(F.map_values("nominal"), lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return twice.union(unknown).union(orphans).union(features.where(odd).select(key, "fid", F.lit("not finite").alias("reason"))).distinct()


def text_width(text: Column, height: Column, widths: dict[str, float], *, other: float, cap: float) -> Column:
    """Width of a text at a capital height, from advances per character in units of the font's size."""
    table = F.create_map(*[F.lit(x) for kv in widths.items() for x in kv])
    letters = F.filter(F.split(text, ""), lambda c: c != "")
    total = F.aggregate(F.transform(letters, lambda c: F.coalesce(F.try_element_at(table, c), F.lit(other))), F.lit(0.0), lambda s, x: s + x)
    return total * height / cap


def run_counters(replies: DataFrame) -> DataFrame:
    """Calls, failures and drawings of a run, one row; ``replies`` has drawing_id, response, error."""
    return replies.agg(F.countDistinct("drawing_id").alias("drawings"), F.count(F.lit(1)).alias("calls"), F.count("error").alias("failures"), F.collect_set("error").alias("errors"))


def error_costs(spark, path: str) -> DataFrame:
    """A cost file as rows (error, cost, critical): weights by error and the factor of critical callouts."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "critical_multiplier DOUBLE, weights MAP<STRING, STRUCT<cost: DOUBLE>>").alias("c"))
    return raw.select(F.explode("c.weights").alias("error", "w"), F.col("c.critical_multiplier").alias("critical")).select("error", "w.cost", "critical")
