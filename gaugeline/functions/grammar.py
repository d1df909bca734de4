"""Reading callout strings: dimensions, control frames, threads and surface finishes.

A string is folded to one spelling, then has to match one of four productions as a
whole. What does not match is refused with a reason; nothing is guessed.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Spellings and the sign each stands for, replaced in this order.
ALIASES = (("%%c", "⌀"), ("%%C", "⌀"), ("Ø", "⌀"), ("ø", "⌀"), ("⏀", "⌀"), ("%%d", "°"), ("%%D", "°"), ("DEG", "°"), ("%%p", "±"), ("%%P", "±"), ("+/-", "±"), ("+-", "±"), ("(M)", "Ⓜ"), ("(MMC)", "Ⓜ"), ("(L)", "Ⓛ"), ("(LMC)", "Ⓛ"), ("(S)", ""), ("(RFS)", ""), ("×", "X"), ("x", "X"), ("*", "X"), ("THRU ALL", "THRU"), ("THROUGH", "THRU"), ("C'BORE", "⌴"), ("CBORE", "⌴"), ("SPOTFACE", "⌴"), ("SF", "⌴"), ("C'SINK", "⌵"), ("CSK", "⌵"), ("CSINK", "⌵"), ("DEEP", "↧"), ("DP", "↧"), ("DIA", "⌀"))

# Names and signs of the geometric characteristics.
SYMBOL_NAMES = {
    "flatness": ("⏥", "FLAT", "FLATNESS"),
    "straightness": ("⏤", "STR", "STRAIGHTNESS"),
    "circularity": ("○", "◯", "CIRC", "ROUND", "ROUNDNESS", "CIRCULARITY"),
    "cylindricity": ("⌭", "CYL", "CYLINDRICITY"),
    "profile_surface": ("⌓", "PROF", "PROFILE"),
    "perpendicularity": ("⊥", "PERP", "PERPENDICULARITY", "SQUARENESS"),
    "parallelism": ("∥", "//", "PARA", "PARALLELISM"),
    "angularity": ("∠", "ANG", "ANGULARITY"),
    "position": ("⌖", "POS", "TP", "POSITION", "TRUE POSITION"),
    "concentricity": ("◎", "CONC", "CONCENTRICITY"),
    "symmetry": ("⌯", "SYM", "SYMMETRY"),
    "circular_runout": ("↗", "RUNOUT", "CIRCULAR RUNOUT"),
    "total_runout": ("⌰", "TOTAL RUNOUT", "TIR"),
}
MODIFIER_SIGNS = {"Ⓜ": "MMC", "Ⓛ": "LMC"}
# What a size's prefix says.
PREFIXES = {"S⌀": ("diameter", "spherical"), "SR": ("radius", "spherical"), "⌀": ("diameter", None), "R": ("radius", None), "□": ("linear", "square")}
WORDS = ("THRU", "TYP", "REF", "MAX", "MIN", "X")

_BY_NAME = {n: s for s, names in SYMBOL_NAMES.items() for n in names}
_PLAIN = r"[+-]?(?:\d+,\d+|\d+\.\d*|\.\d+|\d+)"
_NUMBER = rf"(?:\d+\s*-\s*\d+/\d+|\d+/\d+|{_PLAIN})"
_PREFIX = "|".join(sorted(map(re.escape, PREFIXES), key=len, reverse=True))
_NAME = "|".join(sorted(map(re.escape, _BY_NAME), key=len, reverse=True))
_BAR = r"[\s|]*"
_SYMBOL = re.compile(rf"[| ]*({_NAME})(?![^\W\d_])")
_FRAME = re.compile(rf"{_BAR}(?P<round>⌀)?\s*(?P<value>{_PLAIN})\s*(?P<mod>[ⓂⓁ])?(?P<refs>(?:{_BAR}[A-Z]{{1,2}}(?![A-Za-z])\s*[ⓂⓁ]?)*){_BAR}$")
_REF = re.compile(r"([A-Z]{1,2})\s*([ⓂⓁ])?")
_METRIC = re.compile(r"M(?P<size>\d+(?:\.\d+)?)\s*(?:X\s*(?P<pitch>\d+(?:\.\d+)?))?\s*(?:-\s*(?P<class>\d[A-Za-z]{1,2}))?(?P<left>\s*-\s*LH)?$")
_UNIFIED = re.compile(r"(?:(?P<whole>\d+)\s*-\s*)?(?:(?P<num>\d+)/(?P<den>\d+)|(?P<size>\d+(?:\.\d+)?))\s*-\s*(?P<tpi>\d+)\s*(?P<form>UNC|UNF|UNEF|UN|NPT|NPTF)(?:\s*-\s*(?P<class>\d[AB]))?$")
_FINISH = re.compile(r"(?P<kind>R[aAzZ]|ra)\s*(?P<value>\d+(?:[.,]\d+)?)\s*(?:µm|um|μm)?$|(?P<micro>\d+(?:\.\d+)?)\s*(?:µin|uin|microinch)$")
_SIZE = re.compile(rf"\s*(?P<prefix>{_PREFIX})?\s*(?P<nominal>{_NUMBER})\s*(?P<degree>°)?\s*")
_TOLERANCE = re.compile(
    rf"±\s*(?P<both>{_PLAIN})|(?P<first>[+-](?>\d+,\d+|\d+\.\d*|\.\d+|\d+))\s*/?\s*(?P<second>{_PLAIN})|(?P<fit>(?!(?:{'|'.join(WORDS)})(?![A-Za-z0-9]))[A-Za-z]{{1,2}}\d{{1,2}})(?:/[A-Za-z]{{1,2}}\d{{1,2}})?(?![\w.])|/\s*(?P<limit>{_PLAIN})"
)
_BROKEN = re.compile(r"[±+/-]")
_TRAIL = re.compile(rf"\s*(?:↧\s*(?P<depth>{_NUMBER})|(?P<bore>[⌴⌵])|(?P<count>\d+)\s*X(?![\w.])|(?P<prefix>{_PREFIX})\s*(?P<size>(?=[.\d]){_NUMBER})|(?P<word>[A-Za-z][A-Za-z0-9'\-]*))\s*")

FIELDS = [("kind", T.StringType()), ("dim_type", T.StringType()), ("nominal", T.DoubleType()), ("upper_tol", T.DoubleType()), ("lower_tol", T.DoubleType()), ("tol_style", T.StringType()), ("fit_class", T.StringType()), ("is_reference", T.BooleanType()), ("count", T.IntegerType()), ("gtol_symbol", T.StringType()), ("gtol_value", T.DoubleType()), ("gtol_zone", T.StringType()), ("material_modifier", T.StringType()), ("datum_refs", T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("modifier", T.StringType())]))), ("notes", T.StringType()), ("error", T.StringType())]
SCHEMA = T.StructType([T.StructField(n, t) for n, t in FIELDS])


class Refused(ValueError):
    """The string is not a callout."""


def normalise(text: str) -> str:
    for source, target in ALIASES:
        text = text.replace(source, target)
    return " ".join(text.split())


def normalised(text: Column) -> Column:
    """The same in column expressions."""
    for source, target in ALIASES:
        text = F.replace(text, F.lit(source), F.lit(target))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def number(text: str) -> float:
    if "/" in text:
        whole, _, part = text.rpartition("-")
        top, bottom = part.split("/")
        return (int(whole) if whole.strip() else 0) + int(top) / int(bottom)
    return float(text.replace(",", "."))


def _frame(symbol: str, rest: str) -> dict:
    m = _FRAME.match(rest)
    if not m:
        raise Refused("a control frame is a value, a modifier, and datums")
    refs = [{"label": a, "modifier": MODIFIER_SIGNS.get(b)} for a, b in _REF.findall(m["refs"])]
    if number(m["value"]) <= 0 or len(refs) > 3:
        raise Refused("a tolerance zone is positive and has three datums at most")
    return {"kind": "geometric_tolerance", "gtol_symbol": symbol, "gtol_value": number(m["value"]), "gtol_zone": "diametral" if m["round"] else "linear", "material_modifier": MODIFIER_SIGNS.get(m["mod"]), "datum_refs": refs}


def _thread(text: str) -> dict | None:
    if m := _METRIC.match(text):
        notes = [f"pitch {m['pitch']}" if m["pitch"] else "", f"class {m['class']}" if m["class"] else "", "left hand" if m["left"] else ""]
        size = float(m["size"])
    elif m := _UNIFIED.match(text):
        size = int(m["num"]) / int(m["den"]) + int(m["whole"] or 0) if m["num"] else float(m["size"])
        notes = [f"{m['tpi']} tpi", m["form"], f"class {m['class']}" if m["class"] else ""]
    else:
        return None
    return {"kind": "thread", "dim_type": "thread", "nominal": size, "notes": ", ".join(filter(None, notes)) or None}


def _finish(text: str) -> dict | None:
    if not (m := _FINISH.match(text)):
        return None
    notes = f"{m['micro']} microinch" if m["micro"] else f"{m['kind'].capitalize()} {m['value'].replace(',', '.')}"
    return {"kind": "surface_finish", "notes": notes}


def _limits(nominal: float, other: float, text: str) -> dict:
    shown = re.search(r"\d+\.(\d+)", text)
    middle = (nominal + other) / 2
    return {"nominal": round(middle, max(3, len(shown[1]) if shown else 0)), "upper_tol": round(max(nominal, other) - middle, 6), "lower_tol": round(min(nominal, other) - middle, 6), "tol_style": "limit"}


def _deviations(m: re.Match, nominal: float, text: str) -> dict:
    if m["both"]:
        by = abs(number(m["both"]))
        return {"upper_tol": by, "lower_tol": -by, "tol_style": "bilateral"}
    if m["first"]:
        lower, upper = sorted((number(m["first"]), number(m["second"])))
        return {"upper_tol": upper, "lower_tol": lower, "tol_style": "bilateral" if upper > 0 and upper == abs(lower) else "unilateral"}
    if m["fit"]:
        return {"fit_class": m["fit"], "tol_style": "fit"}
    return _limits(nominal, number(m["limit"]), text)


def _dimension(text: str) -> dict:
    if not (m := _SIZE.match(text)):
        raise Refused("a dimension needs a value")
    type_, extra = PREFIXES.get(m["prefix"], ("linear", None))
    out = {"kind": "dimension", "nominal": number(m["nominal"]), "dim_type": "angular" if m["degree"] else type_, "tol_style": "general"}
    at = m.end()
    if tol := _TOLERANCE.match(text, at):
        out |= _deviations(tol, out["nominal"], text)
        at = tol.end()
    elif _BROKEN.match(text, at):
        raise Refused("a tolerance needs its values")
    if after := re.compile(r"\s*°").match(text, at):
        out["dim_type"], at = "angular", after.end()
    notes: list[str] = []
    while text[at:].strip():
        t = _TRAIL.match(text, at)
        if t and t["prefix"] and not notes:  # a second size only follows a note on the first
            t = re.compile(r"\s*(?P<word>[A-Za-z][A-Za-z0-9'\-]*)\s*").match(text, at)
        if not t:
            raise Refused("unexpected text after the dimension")
        g = t.groupdict()
        if g.get("depth"):
            notes.append(f"depth {number(g['depth']):g}")
        elif g.get("bore"):
            notes.append("counterbore" if g["bore"] == "⌴" else "countersink")
        elif g.get("count"):
            out.setdefault("count", int(g["count"]))
        elif g.get("prefix"):
            notes.append(f"{g['prefix']}{number(g['size']):g}")
        elif g["word"].upper() == "REF":
            out["is_reference"] = True
        else:
            notes.append({"THRU": "through", "TYP": "typical"}.get(g["word"].upper(), g["word"]))
        at = t.end()
    notes += [extra] if extra else []
    return out | {"notes": ", ".join(notes) or None}


def parse(text: str | None, hint: str | None = None) -> dict:
    """The callout's fields; raises Refused. A hint narrows the productions that are tried."""
    whole = normalise(text or "")
    reference = whole.startswith("(") and whole.endswith(")")
    whole = whole[1:-1].strip() if reference and whole else whole
    if not whole:
        raise Refused("empty callout")
    count = None
    if m := re.match(r"(\d+)\s*X\s*(?=\D)", whole):
        count, whole = int(m[1]), whole[m.end() :].strip()
    if hint in (None, "geometric_tolerance") and (m := _SYMBOL.match(whole)):
        return _frame(_BY_NAME[m[1]], whole[m.end() :])
    if hint in (None, "thread") and (out := _thread(whole)):
        return out | ({"count": count} if count is not None else {})
    if hint in (None, "surface_finish") and (out := _finish(whole)):
        return out
    if hint in (None, "dimension"):
        out = _dimension(whole)
        if reference:
            out["is_reference"] = True
        return out | ({"count": count} if count is not None else {})
    raise Refused("not a callout of that kind")


def _parse_row(text: str | None) -> dict:
    out = dict.fromkeys(n for n, _ in FIELDS)
    try:
        out |= parse(text)
    except Refused as e:
        out["error"] = str(e)
    return out


#: A callout string's fields as a struct, ``error`` set where it is refused.
parse_callout = F.udf(_parse_row, SCHEMA, useArrow=True)
