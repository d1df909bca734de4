"""Column expressions over callouts: units, boxes, distances and the equality rules of scoring.

A callout is a struct (or a row) with the fields of the characteristic table; ``g`` and
``p`` below are a ground-truth and a predicted one.
"""

from __future__ import annotations

from dataclasses import dataclass
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeline.constants import MM_PER_INCH


def to_mm(value: Column, units: Column) -> Column:
    """Millimetres; null stays null, an unknown unit is an error."""
    return F.when(value.isNull(), F.lit(None).cast("double")).when(units == "mm", value).when(units == "inch", value * F.lit(MM_PER_INCH)).otherwise(F.raise_error(F.concat(F.lit("unknown units: "), F.coalesce(units, F.lit("null")))).cast("double"))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of boxes (x0, y0, x1, y1); 0 where the union is empty."""
    zero = F.lit(0.0)
    wide = F.greatest(zero, F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    high = F.greatest(zero, F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    both = wide * high
    union = (a["x1"] - a["x0"]) * (a["y1"] - a["y0"]) + (b["x1"] - b["x0"]) * (b["y1"] - b["y0"]) - both
    return F.when(union <= 0, zero).otherwise(both / F.when(union > 0, union))


def relative(a: Column, b: Column) -> Column:
    """Difference by the larger magnitude, at most 1; 0 of two nulls, 1 of one."""
    scale = F.greatest(F.abs(a), F.abs(b), F.lit(1e-6))
    return F.when(a.isNull() & b.isNull(), 0.0).when(a.isNull() | b.isNull(), 1.0).otherwise(F.least(F.lit(1.0), F.abs(a - b) / scale))


def refs_distance(a: Column, b: Column) -> Column:
    """Positional distance of two reference sequences: 1 for a label that differs, 0.5 for a modifier."""
    span = F.greatest(F.size(a), F.size(b))
    place = F.zip_with(a, b, lambda x, y: F.when(x["label"].isNull() | y["label"].isNull() | (x["label"] != y["label"]), 1.0).when(x["modifier"].eqNullSafe(y["modifier"]), 0.0).otherwise(0.5))
    return F.when(span == 0, 0.0).otherwise(F.aggregate(place, F.lit(0.0), lambda total, x: total + x) / F.when(span > 0, span))


def text_ratio(a: str | None, b: str | None) -> float:
    if not a or not b:
        return 0.0 if not a and not b else 1.0
    return 1.0 - SequenceMatcher(None, a, b).ratio()


def _text_ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    """A batch at a time, each distinct pair once."""
    kept: dict[tuple, float] = {}
    out = []
    for pair in zip(a, b, strict=True):
        if pair not in kept:
            kept[pair] = text_ratio(*pair)
        out.append(kept[pair])
    return pd.Series(out, dtype="float64")


text_distance = F.pandas_udf(_text_ratios, T.DoubleType())  # a type object: workers import this module without a session


def _differs(a: Column, b: Column) -> Column:
    return F.when(a.eqNullSafe(b), 0.0).otherwise(1.0)


def semantic_distance(g: Column, p: Column, text: Column) -> Column:
    """How different two callouts say they are; 1 on a kind mismatch. ``text`` is their text distance."""
    view = _differs(g["view"], p["view"])
    dimension = 0.60 * relative(to_mm(g["nominal"], g["units"]), to_mm(p["nominal"], p["units"])) + 0.25 * _differs(g["dim_type"], p["dim_type"]) + 0.15 * view
    tolerance = 0.50 * _differs(g["gtol_symbol"], p["gtol_symbol"]) + 0.20 * relative(to_mm(g["gtol_value"], g["units"]), to_mm(p["gtol_value"], p["units"])) + 0.20 * refs_distance(g["datum_refs"], p["datum_refs"]) + 0.10 * view
    return F.when(~g["kind"].eqNullSafe(p["kind"]), 1.0).when(g["kind"] == "dimension", dimension).when(g["kind"] == "geometric_tolerance", tolerance).otherwise(0.85 * text + 0.15 * view)


@dataclass(frozen=True)
class MatchConfig:
    """Weights and thresholds of the assignment; without a geometric weight only meaning counts."""

    geometric: float = 0.5
    semantic: float = 0.5
    max_cost: float = 0.6
    min_iou: float = 0.05

    def __post_init__(self):
        if self.geometric < 0 or self.semantic <= 0:
            raise ValueError("the geometric weight must not be negative, the semantic one must be positive")
        if not 0 < self.max_cost < 1:
            raise ValueError("the largest cost of a match lies between 0 and 1: mismatches cost 1")


MEANING_ONLY = MatchConfig(geometric=0.0, semantic=1.0, max_cost=0.5)
SAME_CALLOUT = MatchConfig(max_cost=0.35)


def pair_cost(g: Column, p: Column, text: Column, config: MatchConfig) -> Column:
    """1 for other kinds and boxes that hardly meet, else the weighted sum of misplacement and meaning."""
    meaning = semantic_distance(g, p, text)
    if not config.geometric:
        return F.when(~g["kind"].eqNullSafe(p["kind"]), 1.0).otherwise(config.semantic * meaning)
    overlap = iou(g["bbox"], p["bbox"])
    return F.when(~g["kind"].eqNullSafe(p["kind"]) | (overlap < config.min_iou), 1.0).otherwise(config.geometric * (1.0 - overlap) + config.semantic * meaning)


def decimals(text: Column) -> Column:
    """Most decimal places of a number in the text; 2 without text, 0 without such a number."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"\d+\.(\d+)"), 1), lambda x: F.length(x))
    return F.when(text.isNull() | (text == ""), 2).otherwise(F.coalesce(F.array_max(found), F.lit(0)))


def close(a: Column, b: Column, by: float = 1e-9) -> Column:
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(F.abs(a - b) <= by)


def mm_pair(g: Column, p: Column, field: str) -> tuple[Column, Column]:
    return to_mm(g[field], g["units"]), to_mm(p[field], p["units"])


def nominal_equal(g: Column, p: Column) -> Column:
    return close(*mm_pair(g, p, "nominal"))


def tolerances_equal(g: Column, p: Column) -> Column:
    return close(*mm_pair(g, p, "upper_tol")) & close(*mm_pair(g, p, "lower_tol"))


def within_one_digit(g: Column, p: Column) -> Column:
    """Both deviations within one step of the last digit that the text shows."""
    step = to_mm(F.pow(F.lit(10.0), -decimals(g["raw_text"])), g["units"])

    def near(field: str) -> Column:
        a, b = mm_pair(g, p, field)
        return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(F.abs(a - b) <= step + 1e-9)

    return near("upper_tol") & near("lower_tol")


def refs_equal(g: Column, p: Column) -> Column:
    return g["datum_refs"].eqNullSafe(p["datum_refs"])


def perfect(g: Column, p: Column) -> Column:
    """Every scored field agrees."""
    same = {f: g[f].eqNullSafe(p[f]) for f in ("kind", "view", "dim_type", "is_basic", "gtol_symbol", "material_modifier")}
    dimension = same["dim_type"] & nominal_equal(g, p) & tolerances_equal(g, p) & same["is_basic"]
    tolerance = same["gtol_symbol"] & close(*mm_pair(g, p, "gtol_value")) & same["material_modifier"] & refs_equal(g, p)
    other = F.coalesce(g["raw_text"], F.lit("")) == F.coalesce(p["raw_text"], F.lit(""))
    return same["kind"] & same["view"] & F.when(g["kind"] == "dimension", dimension).when(g["kind"] == "geometric_tolerance", tolerance).otherwise(other)
