"""Boxes on a sheet: padding, hulls, the least extent, and where a view and its label stand."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EDGES = ("x0", "y0", "x1", "y1")
# The least extent of a recorded box in sheet mm; a label's drop below its view in text heights.
LEAST_EXTENT, LABEL_DROP = 0.6, 2.5


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(*(v.alias(k) for k, v in zip(EDGES, (x0, y0, x1, y1), strict=True)))


def padded(b: Column, margin: float) -> Column:
    return box(b["x0"] - margin, b["y0"] - margin, b["x1"] + margin, b["y1"] + margin)


def hull(boxes: Column) -> Column:
    """The box around an array of boxes; null around none."""
    def edge(name: str) -> Column:
        return F.transform(boxes, lambda b: b[name])

    x0, y0, x1, y1 = F.array_min(edge("x0")), F.array_min(edge("y0")), F.array_max(edge("x1")), F.array_max(edge("y1"))
    return F.when(F.size(boxes) > 0, box(x0, y0, x1, y1))


def around(points: Column) -> Column:
    """The box around an array of points (x, y); null around none."""
    return hull(F.transform(points, lambda p: box(p["x"], p["y"], p["x"], p["y"])))


def widened(b: Column, least: float = LEAST_EXTENT) -> Column:
    """A box of at least so much width and height, about its middle."""
    out = {}
    for lo, hi in (("x0", "x1"), ("y0", "y1")):
        middle, thin = (b[lo] + b[hi]) / 2, b[hi] - b[lo] < least
        out[lo], out[hi] = F.when(thin, middle - least / 2).otherwise(b[lo]), F.when(thin, middle + least / 2).otherwise(b[hi])
    return box(*(out[k] for k in EDGES))


def to_sheet(x: Column, y: Column, origin: tuple[Column, Column], scale: Column) -> tuple[Column, Column]:
    """A view's millimetres on the sheet."""
    return origin[0] + x * scale, origin[1] + y * scale


def view_box(b: Column, origin: tuple[Column, Column], scale: Column) -> Column:
    """A view's bounds on the sheet."""
    return box(*to_sheet(b["x0"], b["y0"], origin, scale), *to_sheet(b["x1"], b["y1"], origin, scale))


def label_spot(b: Column, text_height: float) -> tuple[Column, Column]:
    """Where a view's label is centred, below its bounds on the sheet."""
    return (b["x0"] + b["x1"]) / 2, b["y0"] - text_height * LABEL_DROP
