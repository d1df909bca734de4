"""Parameters of parts: seeded draws from preferred sizes, the rules they have to meet, and what a drawing calls critical."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gaugeline.functions import tables

ATTEMPTS = 50
# Clearance holes of the bolts that flanges take, by thread diameter; bolt counts.
CLEARANCE = {6.0: 6.6, 8.0: 9.0, 10.0: 11.0, 12.0: 13.5, 16.0: 17.5, 20.0: 22.0, 24.0: 26.0}
COUNTS = (4, 6, 8, 12)
EDGE, WALL, PITCH = 0.75, 0.5, 2.0
R10, R20 = tables.renard(10, 1.0, 1000.0), tables.renard(20, 1.0, 1000.0)


def draw(seed: int, *columns: Column) -> Column:
    """A number in [0, 1) from columns alone."""
    text = F.concat_ws(":", F.lit(str(seed)), *(c.cast("string") for c in columns))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def pick(values: list, u: Column) -> Column:
    """One of a list by a number in [0, 1)."""
    return F.element_at(F.array(*map(F.lit, values)), (F.floor(u * len(values)) + 1).cast("int"))


def flange_draws(spark: SparkSession, seeds: int, *, attempts: int = ATTEMPTS, seed: int = 1) -> DataFrame:
    """Every attempt at a flange for seeds 0 to ``seeds``: one row each, sizes from the preferred series."""
    rows = spark.range(seeds).withColumnRenamed("id", "seed").withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(attempts - 1))))

    def u(name: str) -> Column:
        return draw(seed, F.lit(name), F.col("seed"), F.col("attempt"))

    rows = _once(rows, od=pick(tables.renard(10, 63.0, 400.0), u("od")), bolt=pick(sorted(CLEARANCE), u("bolt")), bolt_count=pick(list(COUNTS), u("count")))
    holes = F.create_map(*[F.lit(x) for kv in CLEARANCE.items() for x in kv])
    rows = _once(rows, bore=tables.snap(F.col("od") * (0.25 + 0.25 * u("bore")), R10), thickness=tables.snap(F.col("od") * (0.08 + 0.10 * u("thickness")), R20), bolt_hole=holes[F.col("bolt")])
    low, high = F.col("bore") + F.col("bolt_hole") * (2 * WALL + 1), F.col("od") - F.col("bolt_hole") * (2 * EDGE + 1)
    return _once(rows, bcd=tables.snap((low + high) / 2, R20), bore_chamfer=F.least(F.when(F.col("bore") >= 20, 1.0).otherwise(0.5), F.col("thickness") / 3.0))


def _once(rows: DataFrame, **columns: Column) -> DataFrame:
    """Columns computed once a row. A generator of one element keeps the optimizer from putting
    their expressions in place of every later use, which would multiply draws of draws."""
    made = F.array(F.struct(*(c.alias(n) for n, c in columns.items())))
    return rows.select(*rows.columns, F.explode(made).alias("made")).select(*rows.columns, "made.*")


def flange_faults() -> Column:
    """The first rule that a flange breaks, or null."""
    c = F.col
    hole = c("bolt_hole")
    checks = [
        ("no rim", c("bore") >= c("od") * 0.8),
        ("edge distance", (c("od") - c("bcd")) / 2 - hole / 2 < hole * EDGE),
        ("bore wall", (c("bcd") - c("bore")) / 2 - hole / 2 < hole * WALL),
        ("hole pitch", math.pi * c("bcd") / c("bolt_count") < hole * PITCH),
        ("chamfer", c("bore_chamfer") * 2 >= c("thickness")),
    ]
    return F.coalesce(*(F.when(broken, F.lit(name)) for name, broken in checks))


def flanges(spark: SparkSession, seeds: int, *, attempts: int = ATTEMPTS, seed: int = 1) -> DataFrame:
    """The first attempt of each seed that breaks no rule; seeds without one are left out."""
    good = flange_draws(spark, seeds, attempts=attempts, seed=seed).where(flange_faults().isNull())
    first = F.min_by(F.struct("attempt", "od", "bore", "thickness", "bolt", "bolt_hole", "bcd", "bolt_count", "bore_chamfer"), "attempt")
    return good.groupBy("seed").agg(first.alias("p")).select("seed", "p.*")


def criticality() -> Column:
    """How likely a callout is the one that scraps a part: weight by kind, symbol and tightness."""
    c = F.col
    tolerance = F.when(c("gtol_symbol") == "position", 3.0).otherwise(1.5) * (1.0 + F.least(F.lit(2.0), 0.1 / F.greatest(F.coalesce(F.nullif("gtol_value", F.lit(0.0)), F.lit(1.0)), F.lit(1e-3))))
    share = F.abs(c("upper_tol") - c("lower_tol")) / F.greatest(F.abs(F.coalesce(F.nullif("nominal", F.lit(0.0)), F.lit(1.0))), F.lit(1e-6))
    size = F.when(c("upper_tol").isNull() | c("lower_tol").isNull(), 0.3).when(share < 0.002, 2.0).otherwise(1.0)
    return F.when(c("kind") == "geometric_tolerance", tolerance).when(c("kind") == "dimension", size).otherwise(0.2)


def mark_critical(chars: DataFrame, *, fraction: float = 0.15, seed: int = 1, key: str = "drawing_id") -> DataFrame:
    """A weighted sample without replacement of each drawing's sizes and tolerances, about ``fraction`` of all its callouts.

    The least of exponential draws at the rates of the weights; a drawing has a
    handful of callouts, so ranking them is one small window.
    """
    rows = chars.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(key))).where(F.col("kind").isin("dimension", "geometric_tolerance"))
    late = -F.log(draw(seed, F.lit("critical"), F.col(key), F.col("id")) + 1e-12) / criticality()
    place = F.row_number().over(Window.partitionBy(key).orderBy(late, "id"))
    return rows.withColumn("place", place).where(F.col("place") <= F.greatest(F.lit(1), F.bround(F.col("n") * fraction))).select(key, "id")


def position_zone(diameter: Column) -> Column:
    """A positional zone that grows with the hole, within workshop bounds."""
    return F.bround(F.least(F.greatest(diameter * 0.03, F.lit(0.1)), F.lit(0.6)), 2)


def position_refs(labels: Column) -> Column:
    """The first three datums by label."""
    return F.slice(F.array_sort(labels), 1, 3)


def datum_type(feature: Column) -> Column:
    """What kind of datum a feature makes."""
    return F.when(feature.isin("bore", "hole", "boss", "cylinder", "journal"), "cylindrical_feature").when(feature.isin("slot", "keyway", "rib"), "width").otherwise("planar_face")


def scale_for(extent: Column, available: float) -> Column:
    """The largest standard ratio at which an extent fits, else the smallest."""
    # Standard scales, largest first.
    ratios = (10.0, 5.0, 2.0, 1.0, 0.5, 0.2, 0.1, 0.05, 0.02, 0.01)
    fits = F.filter(F.array(*map(F.lit, ratios)), lambda r: extent * r <= available)
    return F.coalesce(F.try_element_at(fits, F.lit(1)), F.lit(ratios[-1]))
