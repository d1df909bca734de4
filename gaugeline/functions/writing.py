"""Writing values, tolerances and control frames the way drawings do."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Signs of the geometric characteristics and modifiers.
GLYPHS = {"flatness": "⏥", "straightness": "⏤", "circularity": "○", "cylindricity": "⌭", "perpendicularity": "⊥", "parallelism": "∥", "angularity": "∠", "position": "⌖", "concentricity": "◎", "symmetry": "⌯", "circular_runout": "↗", "total_runout": "⌰", "profile_surface": "⌓"}
MODIFIER_GLYPHS = {"MMC": "Ⓜ", "LMC": "Ⓛ"}


def value_text(value: Column, decimals: int, *, zeros: bool = True) -> Column:
    """A value to fixed places, never -0; without trailing zeros if asked."""
    text = F.when(value.isNotNull(), F.format_string(f"%.{decimals}f", F.bround(value, decimals) + 0.0))
    return text if zeros else F.when(F.contains(text, F.lit(".")), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


def _signed(value: Column, decimals: int, zero: str, zeros: bool) -> Column:
    sign = F.when(F.abs(value) < 10.0 ** -(decimals + 1), zero).when(value > 0, "+").otherwise("-")
    return F.concat(sign, value_text(F.abs(value), decimals, zeros=zeros))


def tolerance_text(nominal: Column, upper: Column, lower: Column, style: Column, *, decimals: int = 2, places: int = 2, zeros: bool = True, prefix: Column | None = None, fit: Column | None = None) -> Column:
    """The size with its tolerance in one of six styles; null where a style lacks what it needs."""
    prefix = F.lit("") if prefix is None else prefix
    base = F.concat(prefix, value_text(nominal, decimals, zeros=zeros))
    pair = F.concat(base, F.lit(" "), _signed(upper, places, "+", zeros), F.lit("/"), _signed(lower, places, "-", zeros))
    even = F.concat(base, F.lit("±"), value_text(F.abs(upper), places, zeros=zeros))
    most = max(decimals, places)
    limits = F.concat(prefix, value_text(nominal + upper, most, zeros=zeros), F.lit("/"), value_text(nominal + lower, most, zeros=zeros))
    return F.when(style.isin("basic", "general"), base).when(style == "fit", F.concat(base, F.lit(" "), F.lit(None).cast("string") if fit is None else fit)).when(style == "bilateral", F.when(F.abs(upper + lower) > 1e-9, pair).otherwise(even)).when(style == "unilateral", pair).when(style == "limit", limits)


def _glyph(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def frame_compartments(symbol: Column, value: Column, modifier: Column, refs: Column, *, decimals: int = 3, zone: Column | None = None) -> Column:
    """The compartments of a control frame, in order."""
    tolerance = F.concat(F.lit("") if zone is None else zone, value_text(value, decimals), F.coalesce(_glyph(MODIFIER_GLYPHS, modifier), F.lit("")))
    labels = F.transform(refs, lambda r: F.concat(r["label"], F.coalesce(_glyph(MODIFIER_GLYPHS, r["modifier"]), F.lit(""))))
    return F.concat(F.array(_glyph(GLYPHS, symbol), tolerance), labels)


def frame_text(*args, separator: str = "|", **how) -> Column:
    return F.array_join(frame_compartments(*args, **how), separator)


def datum_text(label: Column, style: str = "boxed") -> Column:
    return F.concat(F.lit("-"), label, F.lit("-")) if style == "dashed" else label
