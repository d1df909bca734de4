"""Relations among the faces of a solid, from a table of measured faces.

``faces`` has solid_id, ord, surface, area, radius, a point (cx, cy, cz: a plane's
centroid, a cylinder's axis position) and a direction (dx, dy, dz: normal or axis).
Every relation is an equi-join on the solid with the rest as a predicate, so solids
are dealt evenly and a solid's faces meet in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.sources.shared import cut

#: How far from parallel or perpendicular two unit directions may be.
PARALLEL = 1e-3
LEAST_AREA, LEAST_DISTANCE = 1e-6, 1e-6
Vector = tuple[Column, Column, Column]


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def minus(a: Vector, b: Vector) -> Vector:
    return a[0] - b[0], a[1] - b[1], a[2] - b[2]


def cross(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def unit(a: Vector) -> Vector:
    size = F.sqrt(dot(a, a))
    return tuple(F.when(size < 1e-12, x).otherwise(x / F.when(size >= 1e-12, size)) for x in a)


def usable(faces: DataFrame) -> DataFrame:
    """Faces with an area and a surface of a known kind, with their direction as a unit vector."""
    x, y, z = unit((F.col("dx"), F.col("dy"), F.col("dz")))
    return faces.where((F.col("area") >= LEAST_AREA) & (F.col("surface") != "other")).withColumns({"dx": x, "dy": y, "dz": z})


def planes(faces: DataFrame) -> DataFrame:
    return usable(faces).where("surface = 'plane'")


def cylinders(faces: DataFrame) -> DataFrame:
    return usable(faces).where("surface = 'cylinder' AND radius IS NOT NULL")


def round_faces(faces: DataFrame) -> DataFrame:
    """What a diameter can refer to: cylinders and cones."""
    return usable(faces).where("surface IN ('cylinder', 'cone') AND radius IS NOT NULL")


def _two(a: DataFrame, b: DataFrame, ordered: bool) -> tuple[DataFrame, list[Vector]]:
    both = a.alias("a").join(b.alias("b"), (F.col("a.solid_id") == F.col("b.solid_id")) & ((F.col("a.ord") < F.col("b.ord")) if ordered else F.lit(True)))
    return both, [tuple(F.col(f"{s}.{k}{x}") for x in "xyz") for s in "ab" for k in "cd"]


def plane_pairs(faces: DataFrame) -> DataFrame:
    """Parallel planes and their separation: (solid_id, a, b, value)."""
    both, (ca, na, cb, nb) = _two(planes(faces), planes(faces), True)
    apart = F.abs(dot(na, ca) - dot(na, cb))
    return both.where((F.abs(F.abs(dot(na, nb)) - 1) <= PARALLEL) & (apart >= LEAST_DISTANCE)).select("a.solid_id", F.col("a.ord").alias("a"), F.col("b.ord").alias("b"), apart.alias("value"))


def axis_distances(faces: DataFrame) -> DataFrame:
    """Distances of parallel cylinder axes: (solid_id, a, b, value)."""
    both, (pa, va, pb, vb) = _two(cylinders(faces), cylinders(faces), True)
    delta = minus(pb, pa)
    along = dot(delta, va)
    across = tuple(d - along * v for d, v in zip(delta, va, strict=True))
    apart = F.sqrt(dot(across, across))
    return both.where((F.abs(F.abs(dot(va, vb)) - 1) <= PARALLEL) & (apart >= LEAST_DISTANCE)).select("a.solid_id", F.col("a.ord").alias("a"), F.col("b.ord").alias("b"), apart.alias("value"))


def axis_to_plane(faces: DataFrame) -> DataFrame:
    """Distances of cylinder axes from planes that they run along: (solid_id, a, b, value)."""
    both, (p, v, c, n) = _two(cylinders(faces), planes(faces), False)
    apart = F.abs(dot(minus(p, c), n))
    return both.where((F.abs(dot(v, n)) <= PARALLEL) & (apart >= LEAST_DISTANCE)).select("a.solid_id", F.col("a.ord").alias("a"), F.col("b.ord").alias("b"), apart.alias("value"))


def hole_patterns(faces: DataFrame, *, least: int = 3) -> DataFrame:
    """Equal parallel cylinders on a circle: (solid_id, radius, count, bolt_circle, uniform, members).

    Grouped by radius and axis (a direction and its opposite are one). A group is
    a ring if its axes are equidistant from their centre within 2 %, and uniform
    if they are equally spaced within 5 degrees. The arrays hold the holes of one
    solid.
    """
    x, y, z = (F.col(f"d{k}") for k in "xyz")
    main = F.when((F.abs(x) >= F.abs(y)) & (F.abs(x) >= F.abs(z)), x).when(F.abs(y) >= F.abs(z), y).otherwise(z)
    sign = F.when(main < 0, -1.0).otherwise(1.0)
    rows = cylinders(faces).select("solid_id", "ord", F.bround("radius", 4).alias("radius"), *(F.bround(sign * d, 4).alias(f"u{k}") for k, d in zip("xyz", (x, y, z), strict=True)), "cx", "cy", "cz")
    axis = tuple(F.col(f"u{k}") for k in "xyz")
    point = tuple(F.col(f"c{k}") for k in "xyz")
    flat = tuple(p - dot(point, axis) * u for p, u in zip(point, axis, strict=True))
    rows = rows.select("solid_id", "ord", "radius", "ux", "uy", "uz", *(f.alias(f"f{k}") for k, f in zip("xyz", flat, strict=True)))
    groups = rows.groupBy("solid_id", "radius", "ux", "uy", "uz").agg(F.count(F.lit(1)).alias("count"), *(F.avg(f"f{k}").alias(f"m{k}") for k in "xyz"), F.array_sort(F.collect_list(F.struct("ord", "fx", "fy", "fz"))).alias("holes")).where(F.col("count") >= least)
    side = cross(axis, (F.lit(1.0), F.lit(0.0), F.lit(0.0)))
    other_side = cross(axis, (F.lit(0.0), F.lit(1.0), F.lit(0.0)))
    usual = F.sqrt(dot(side, side)) >= 1e-9
    ref = tuple(F.when(usual, a).otherwise(b) for a, b in zip(unit(side), unit(other_side), strict=True))
    groups = groups.withColumns({f"r{k}": v for k, v in zip("xyz", ref, strict=True)})
    ref = tuple(F.col(f"r{k}") for k in "xyz")
    groups = groups.withColumns({f"s{k}": v for k, v in zip("xyz", cross(axis, ref), strict=True)})
    third = tuple(F.col(f"s{k}") for k in "xyz")
    mean = tuple(F.col(f"m{k}") for k in "xyz")

    def away(h: Column) -> Vector:
        return minus((h["fx"], h["fy"], h["fz"]), mean)

    n = F.col("count").cast("double")
    turn = F.lit(2 * math.pi)
    groups = groups.withColumn("far", F.transform("holes", lambda h: F.sqrt(dot(away(h), away(h))))).withColumn("angles", F.array_sort(F.transform("holes", lambda h: F.pmod(F.atan2(dot(away(h), third), dot(away(h), ref)), turn))))
    groups = groups.withColumn("mean_far", F.aggregate("far", F.lit(0.0), lambda t, d: t + d) / n)
    spread = F.sqrt(F.aggregate("far", F.lit(0.0), lambda t, d: t + (d - F.col("mean_far")) * (d - F.col("mean_far"))) / n)
    following = F.concat(F.slice("angles", 2, F.size("angles") - 1), F.array(F.element_at("angles", 1) + turn))
    uneven = F.array_max(F.zip_with("angles", following, lambda a, b: F.abs(b - a - turn / n)))
    rings = groups.where((F.col("mean_far") >= 1e-6) & (spread <= 0.02 * F.col("mean_far")))
    return rings.select("solid_id", "radius", "count", (2 * F.col("mean_far")).alias("bolt_circle"), (uneven < math.radians(5)).alias("uniform"), F.transform("holes", lambda h: h["ord"]).alias("members"))


def sizes(faces: DataFrame, envelope: DataFrame) -> DataFrame:
    """Every size that a dimension can refer to: (solid_id, family, source, rank, value).

    Family 'diameter' has round faces, by distinct radius, and uniform bolt
    circles; family 'length' has plane pairs, axis distances, axis-to-plane
    distances, extents and uniform bolt circles, ranked in this order.
    """
    rounds = round_faces(faces).select("solid_id", F.bround("radius", 6).alias("radius")).distinct()
    # written: both families read them, and a filter pushed into their arrays would work each array out again and again
    rings = cut(hole_patterns(faces)).where("uniform").select("solid_id", F.col("bolt_circle").alias("value"))
    extents = envelope.select("solid_id", F.explode(F.array("ex", "ey", "ez")).alias("value"))
    parts = [("diameter", "diameter", 0, rounds.select("solid_id", (2 * F.col("radius")).alias("value"))), ("diameter", "bolt_circle", 1, rings), ("length", "plane_pair", 0, plane_pairs(faces)), ("length", "axis_distance", 1, axis_distances(faces)), ("length", "axis_to_plane", 2, axis_to_plane(faces)), ("length", "envelope", 3, extents), ("length", "bolt_circle", 4, rings)]
    out = None
    for family, source, rank, rows in parts:
        part = rows.select("solid_id", F.lit(family).alias("family"), F.lit(source).alias("source"), F.lit(rank).alias("rank"), "value")
        out = part if out is None else out.unionByName(part)
    return out


def stats(faces: DataFrame) -> DataFrame:
    """Counts of faces by use, plane pairs and hole patterns, a row a solid."""
    good = (F.col("area") >= LEAST_AREA) & (F.col("surface") != "other")
    counts = faces.groupBy("solid_id").agg(F.count(F.lit(1)).alias("faces"), F.count_if(good).alias("usable"), F.count_if(~good).alias("skipped"), *(F.count_if(good & (F.col("surface") == s)).alias(f"{s}s") for s in ("cylinder", "cone", "plane")))
    pairs = plane_pairs(faces).groupBy("solid_id").agg(F.count(F.lit(1)).alias("plane_pairs"))
    rings = hole_patterns(faces).groupBy("solid_id").agg(F.count(F.lit(1)).alias("hole_patterns"))
    none = F.lit(0).cast("long")
    return counts.join(pairs, "solid_id", "left").join(rings, "solid_id", "left").withColumns({c: F.coalesce(c, none) for c in ("plane_pairs", "hole_patterns")})
