"""Point maps that move boxes: homography, lens distortion, fold, views and sheets."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

PointMap = Callable[[Column, Column], tuple[Column, Column]]
#: Points sampled on each edge of a box.
EDGE_STEPS = 8
#: The largest double.
FINITE = float(np.finfo(float).max)


@dataclass(frozen=True)
class Homography:
    """A projective map by its nine coefficients, row by row."""

    m: tuple[float, ...]

    def __call__(self, x: Column, y: Column) -> tuple[Column, Column]:
        a, b, c, d, e, f, g, h, i = self.m
        w = g * x + h * y + i
        w = F.when(F.abs(w) < 1e-12, 1e-12).otherwise(w)
        return (a * x + b * y + c) / w, (d * x + e * y + f) / w

    def depth(self, x: Column, y: Column) -> Column:
        """The divisor at a point; where its sign stays, lines stay lines and a box's corners bound its outline."""
        return self.m[6] * x + self.m[7] * y + self.m[8]

    def inverse(self) -> Homography:
        return Homography(tuple(np.linalg.inv(np.reshape(self.m, (3, 3))).ravel().tolist()))

    def about(self, width: float, height: float) -> Homography:
        """The same map about the middle of an image."""
        move = np.array([[1, 0, width / 2], [0, 1, height / 2], [0, 0, 1.0]])
        return Homography(tuple((move @ np.reshape(self.m, (3, 3)) @ np.linalg.inv(move)).ravel().tolist()))


#: The map that moves nothing.
IDENTITY = Homography((1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0))


def corners(source: list[tuple[float, float]], target: list[tuple[float, float]]) -> Homography:
    """The homography that takes four points to four others."""
    rows, right = [], []
    for (x, y), (u, v) in zip(source, target, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    return Homography((*np.linalg.solve(np.array(rows, float), np.array(right, float)).tolist(), 1.0))


@dataclass(frozen=True)
class Barrel:
    """Radial distortion by its first coefficient, the radius in half diagonals."""

    k: float
    width: float
    height: float

    def _rel(self, x: Column, y: Column) -> tuple[Column, Column]:
        half = float(np.hypot(self.width / 2, self.height / 2))
        return (x - self.width / 2) / half, (y - self.height / 2) / half

    def _back(self, u: Column, v: Column) -> tuple[Column, Column]:
        half = float(np.hypot(self.width / 2, self.height / 2))
        return self.width / 2 + u * half, self.height / 2 + v * half

    def __call__(self, x: Column, y: Column) -> tuple[Column, Column]:
        u, v = self._rel(x, y)
        by = 1.0 + self.k * (u * u + v * v)
        return self._back(u * by, v * by)

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        """Five fixed-point steps, folded over a constant array so that the expression does not grow with them."""
        u, v = self._rel(x, y)

        def closer(guess: Column, _: Column) -> Column:
            by = 1.0 + self.k * (guess["u"] * guess["u"] + guess["v"] * guess["v"])
            return F.struct((u / by).alias("u"), (v / by).alias("v"))

        found = F.aggregate(F.sequence(F.lit(1), F.lit(5)), F.struct(u.alias("u"), v.alias("v")), closer)
        return self._back(found["u"], found["v"])

    def bounds(self, box: Column) -> Column:
        """What ``_outline_box`` gives of an ordered box, from its four sides alone; ``k`` must not be negative.

        A coordinate grows with itself, so each bound is on one side. Along a side the
        shift grows with the distance from the middle: towards the middle the bound is at
        the sample nearest to it, away from it at the farther end.
        """

        def squares(low: Column, high: Column, place: int) -> tuple[Column, Column]:
            points = [low + (high - low) * (k / EDGE_STEPS) for k in range(EDGE_STEPS + 1)]
            every = [r * r for r in (self._rel(p, p)[place] for p in points)]
            return F.least(*every), F.greatest(every[0], every[-1])

        def moved(r: Column, other: Column) -> Column:
            return r * (1.0 + self.k * (r * r + other))

        (u0, v0), (u1, v1) = self._rel(box["x0"], box["y0"]), self._rel(box["x1"], box["y1"])
        (near_u, far_u), (near_v, far_v) = squares(box["x0"], box["x1"], 0), squares(box["y0"], box["y1"], 1)
        low = [moved(r, F.when(r < 0, far).otherwise(near)) for r, near, far in ((u0, near_v, far_v), (v0, near_u, far_u))]
        high = [moved(r, F.when(r < 0, near).otherwise(far)) for r, near, far in ((u1, near_v, far_v), (v1, near_u, far_u))]
        return F.struct(*(v.alias(c) for c, v in zip(("x0", "y0", "x1", "y1"), (*self._back(*low), *self._back(*high)), strict=True)))


@dataclass(frozen=True)
class Fold:
    """A crease: points near a line move along it, less with the distance from it."""

    position: float
    vertical: bool
    amplitude: float
    width: float

    def _moved(self, x: Column, y: Column, sign: float) -> tuple[Column, Column]:
        away = ((x if self.vertical else y) - self.position) / self.width
        by = sign * self.amplitude * F.exp(-(away * away))
        return (x, y + by) if self.vertical else (x + by, y)

    def __call__(self, x: Column, y: Column) -> tuple[Column, Column]:
        return self._moved(x, y, 1.0)

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        return self._moved(x, y, -1.0)


def _outline_box(box: Column, move: PointMap) -> Column:
    """Upright bounds of a box's mapped outline, nine points on each edge."""
    steps = F.sequence(F.lit(0), F.lit(EDGE_STEPS))
    wide, high = box["x1"] - box["x0"], box["y1"] - box["y0"]

    def edge(x: Callable[[Column], Column], y: Callable[[Column], Column]) -> Column:
        def point(k: Column) -> Column:
            t = k.cast("double") / EDGE_STEPS
            u, v = move(x(t), y(t))
            return F.struct(u.alias("u"), v.alias("v"))

        return F.transform(steps, point)

    along_x, along_y = (lambda t: box["x0"] + wide * t), (lambda t: box["y0"] + high * t)
    points = F.concat(edge(along_x, lambda t: box["y0"]), edge(along_x, lambda t: box["y1"]), edge(lambda t: box["x0"], along_y), edge(lambda t: box["x1"], along_y))
    us, vs = F.transform(points, lambda p: p["u"]), F.transform(points, lambda p: p["v"])
    return F.struct(F.array_min(us).alias("x0"), F.array_min(vs).alias("y0"), F.array_max(us).alias("x1"), F.array_max(vs).alias("y1"))


def map_box(box: Column, move: PointMap) -> Column:
    """Upright bounds of a box after a point map.

    The identity is the box itself; of a homography the four corners are enough,
    but where the box crosses the line that goes to infinity. Barrel distortion
    has its bounds on known sides. Other maps bend edges, so points along the
    whole outline are mapped, as they are of boxes turned inside out or not finite.
    """
    if move == IDENTITY:
        return box
    if isinstance(move, Barrel) and move.k >= 0:
        ordered = (box["x1"] - box["x0"]).between(0.0, FINITE) & (box["y1"] - box["y0"]).between(0.0, FINITE)
        return F.when(ordered, move.bounds(box)).otherwise(_outline_box(box, move))
    if not isinstance(move, Homography):
        return _outline_box(box, move)
    spots = [(box[x], box[y]) for x in ("x0", "x1") for y in ("y0", "y1")]
    us, vs = zip(*(move(x, y) for x, y in spots), strict=True)
    plain = F.struct(F.least(*us).alias("x0"), F.least(*vs).alias("y0"), F.greatest(*us).alias("x1"), F.greatest(*vs).alias("y1"))
    if not move.m[6] and not move.m[7]:
        return plain
    depths = [move.depth(x, y) for x, y in spots]
    return F.when((F.least(*depths) > 1e-9) | (F.greatest(*depths) < -1e-9), plain).otherwise(_outline_box(box, move))


def area(box: Column) -> Column:
    return F.greatest(F.lit(0.0), box["x1"] - box["x0"]) * F.greatest(F.lit(0.0), box["y1"] - box["y0"])


def clip(box: Column, width: Column, height: Column) -> Column:
    """The part of a box on the image; null if under a pixel is left of a side."""

    def within(v: Column, most: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(v, most.cast("double")))

    x0, y0, x1, y1 = within(box["x0"], width), within(box["y0"], height), within(box["x1"], width), within(box["y1"], height)
    return F.when((x1 - x0 >= 1) & (y1 - y0 >= 1), F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")))


def sheet_to_pixel(x: Column, y: Column, sheet_height: float, dpi: int) -> tuple[Column, Column]:
    """Millimetres from the lower left to pixels from the upper left."""
    return x * (dpi / 25.4), (sheet_height - y) * (dpi / 25.4)


def view_axes(direction: tuple[float, float, float], up: tuple[float, float, float]) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """Right and up of a view along a direction, perpendicular to it and each other."""
    d = np.array(direction, float) / np.linalg.norm(direction)
    u = np.array(up, float) - np.dot(up, d) * d
    if np.linalg.norm(u) < 1e-9:
        raise ValueError("up is parallel to the direction of view")
    u /= np.linalg.norm(u)
    return tuple(np.cross(u, d).tolist()), tuple(u.tolist())


def project(point: tuple[Column, Column, Column], axes: tuple[tuple[float, ...], tuple[float, ...]]) -> tuple[Column, Column]:
    """Where a point of space appears in a view."""
    return tuple(sum((p * a for p, a in zip(point, axis, strict=True)), F.lit(0.0)) for axis in axes)


def ray_exit(x: Column, y: Column, cos: Column, sin: Column, box: Column) -> Column:
    """How far a ray runs before it leaves a box; 0 from outside. A side it runs along is no bound."""

    def bound(step: Column, low: Column, high: Column, here: Column) -> Column:
        return F.when(F.abs(step) >= 1e-12, (F.when(step > 0, high).otherwise(low) - here) / F.when(F.abs(step) >= 1e-12, step))

    inside = x.between(box["x0"], box["x1"]) & y.between(box["y0"], box["y1"])
    return F.when(inside, F.greatest(F.lit(0.0), F.least(bound(cos, box["x0"], box["x1"], x), bound(sin, box["y0"], box["y1"], y)))).otherwise(0.0)
