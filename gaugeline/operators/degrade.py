"""What moving, cropping and covering a sheet does to its labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gaugeline.functions.warps import PointMap, area, clip, map_box

KEY = "drawing_id"
#: A box stays if so much of its area does; it goes if so much of it is covered.
RETAINED, COVERED = 0.45, 0.55


def _mapped(rows: DataFrame, move: PointMap, width: Column, height: Column) -> DataFrame:
    # each step through a generator of one element: else the outline's 36 points would stand in for every use of the box
    rows = rows.withColumn("moved", F.explode(F.array(map_box(F.col("bbox"), move))))
    rows = rows.withColumn("clipped", F.explode(F.array(clip(F.col("moved"), width, height))))
    share = area(F.col("clipped")) / F.greatest(area(F.col("moved")), F.lit(1e-9))
    return rows.where(F.col("clipped").isNotNull() & (share >= RETAINED)).withColumn("bbox", F.col("clipped")).drop("moved", "clipped")


def _with_datums(chars: DataFrame, datums: DataFrame) -> DataFrame:
    """Callouts all of whose datums are still there, numbered anew from 1."""
    lost = chars.select(KEY, "id", F.explode("datum_refs").alias("r")).select(KEY, "id", F.col("r.label").alias("label")).join(datums.select(KEY, "label"), [KEY, "label"], "left_anti").select(KEY, "id").distinct()
    kept = chars.join(lost, [KEY, "id"], "left_anti")
    return kept.withColumn("old_id", F.col("id")).withColumn("id", F.row_number().over(Window.partitionBy(KEY).orderBy("old_id")))


def map_boxes(chars: DataFrame, datums: DataFrame, move: PointMap, width: Column, height: Column) -> tuple[DataFrame, DataFrame]:
    """Callouts and datums after a point map: boxes clipped, those mostly lost dropped with what depends on them."""
    left = _mapped(datums, move, width, height)
    return _with_datums(_mapped(chars, move, width, height), left), left


def covered(box: Column, regions: list[tuple[float, float, float, float]]) -> Column:
    """Share of a box in destroyed regions: overlaps add up, 1 at most."""
    total = F.greatest((box["x1"] - box["x0"]) * (box["y1"] - box["y0"]), F.lit(1e-9))
    zero = F.lit(0.0)
    lost = sum((F.greatest(zero, F.least(box["x1"], F.lit(r[2])) - F.greatest(box["x0"], F.lit(r[0]))) * F.greatest(zero, F.least(box["y1"], F.lit(r[3])) - F.greatest(box["y0"], F.lit(r[1]))) for r in regions), zero)
    return F.least(lost / total, F.lit(1.0))


def remove_covered(chars: DataFrame, datums: DataFrame, regions: list[tuple[float, float, float, float]]) -> tuple[DataFrame, DataFrame]:
    left = datums.where(covered(F.col("bbox"), regions) < COVERED)
    return _with_datums(chars.where(covered(F.col("bbox"), regions) < COVERED), left), left


def destroyed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Drawings of which no callout is left."""
    return before.select(KEY).distinct().join(after.select(KEY).distinct(), KEY, "left_anti")


def all_boxes(chars: DataFrame, datums: DataFrame, *, key: str = "drawing_id", leader: str = "leader") -> DataFrame:
    """Every box of a drawing as (key, kind, owner, attribute, box): of datums, of callouts, and where their leaders point, if they have one."""
    of_datums = datums.select(key, F.lit("datum").alias("kind"), F.col("label").alias("owner"), F.lit("bbox").alias("attribute"), F.col("bbox").alias("box"))
    both = F.array(F.struct(F.lit("bbox").alias("attribute"), F.col("bbox").alias("box")), F.struct(F.lit(leader).alias("attribute"), F.col(leader).alias("box")))
    listed = chars.select(key, F.col("id").cast("string").alias("owner"), F.explode(F.filter(both, lambda b: b["box"].isNotNull())).alias("b"))
    return of_datums.unionByName(listed.select(key, F.lit("characteristic").alias("kind"), "owner", "b.attribute", "b.box"))
