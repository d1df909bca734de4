"""ISO 286 limits and preferred numbers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper bounds of the principal size ranges in mm.
RANGES = (3, 6, 10, 18, 30, 50, 80, 120, 180, 250, 315, 400, 500)
# Widths of the tolerance grades in micrometres by size range.
GRADES = {
    5: (4, 5, 6, 8, 9, 11, 13, 15, 18, 20, 23, 25, 27),
    6: (6, 8, 9, 11, 13, 16, 19, 22, 25, 29, 32, 36, 40),
    7: (10, 12, 15, 18, 21, 25, 30, 35, 40, 46, 52, 57, 63),
    8: (14, 18, 22, 27, 33, 39, 46, 54, 63, 72, 81, 89, 97),
    9: (25, 30, 36, 43, 52, 62, 74, 87, 100, 115, 130, 140, 155),
    10: (40, 48, 58, 70, 84, 100, 120, 140, 160, 185, 210, 230, 250),
    11: (60, 75, 90, 110, 130, 160, 190, 220, 250, 290, 320, 360, 400),
}
# Upper deviations of clearance shafts, lower deviations of interference shafts, micrometres by size range.
SHAFT_UPPER = {
    "d": (-20, -30, -40, -50, -65, -80, -100, -120, -145, -170, -190, -210, -230),
    "e": (-14, -20, -25, -32, -40, -50, -60, -72, -85, -100, -110, -125, -135),
    "f": (-6, -10, -13, -16, -20, -25, -30, -36, -43, -50, -56, -62, -68),
    "g": (-2, -4, -5, -6, -7, -9, -10, -12, -14, -15, -17, -18, -20),
    "h": (0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0),
}
SHAFT_LOWER = {
    "k": (0, 1, 1, 1, 2, 2, 2, 3, 3, 4, 4, 4, 5),
    "m": (2, 4, 6, 7, 8, 9, 11, 13, 15, 17, 20, 21, 23),
    "n": (4, 8, 10, 12, 15, 17, 20, 23, 27, 31, 34, 37, 40),
    "p": (6, 12, 15, 18, 22, 26, 32, 37, 43, 50, 56, 62, 68),
}
# The coarsest grade at which a hole of the letter is corrected.
CORRECTED = {"k": 8, "m": 8, "n": 8, "p": 7}
# Grades as multiples of the tolerance factor; factor and exponent of the deviations that have a formula, micrometres.
MULTIPLES = {5: 7, 6: 10, 7: 16, 8: 25, 9: 40, 10: 64, 11: 100, 12: 160, 13: 250, 14: 400, 15: 640, 16: 1000}
POWERS = {"d": (-16.0, 0.44), "e": (-11.0, 0.41), "f": (-5.5, 0.41), "g": (-2.5, 0.34), "h": (0.0, 1.0), "k": (0.6, 1 / 3), "n": (5.0, 0.34)}
# One decade of the Renard series.
RENARD = {
    5: (1.00, 1.60, 2.50, 4.00, 6.30),
    10: (1.00, 1.25, 1.60, 2.00, 2.50, 3.15, 4.00, 5.00, 6.30, 8.00),
    20: (1.00, 1.12, 1.25, 1.40, 1.60, 1.80, 2.00, 2.24, 2.50, 2.80, 3.15, 3.55, 4.00, 4.50, 5.00, 5.60, 6.30, 7.10, 8.00, 9.00),
    40: (1.00, 1.06, 1.12, 1.18, 1.25, 1.32, 1.40, 1.50, 1.60, 1.70, 1.80, 1.90, 2.00, 2.12, 2.24, 2.36, 2.50, 2.65, 2.80, 3.00, 3.15, 3.35, 3.55, 3.75, 4.00, 4.25, 4.50, 4.75, 5.00, 5.30, 5.60, 6.00, 6.30, 6.70, 7.10, 7.50, 8.00, 8.50, 9.00, 9.50),
}


def size_range(d: Column) -> Column:
    """Place (from 1) of the size range that a diameter is in: open below, closed above; null outside."""
    bounds = F.array(*(F.lit(float(r)) for r in RANGES))
    place = F.size(F.filter(bounds, lambda b: b < d)) + 1
    return F.when((d > 0) & (d <= float(RANGES[-1])), place)


def _row(table: dict, key: Column, place: Column) -> Column:
    """The value of a small table at a key and a size range; null where there is none."""
    made = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.array(*(F.lit(float(n)) for n in v)))])
    return F.try_element_at(F.try_element_at(made, key), place)


def it_grade(d: Column, grade: Column) -> Column:
    """Width of a tolerance grade at a diameter, in mm; null outside grades 1 to 16 and sizes to 500.

    Grades from 12 up repeat those five below tenfold; grades 1 to 4 grow
    geometrically from a linear rule to grade 5.
    """
    place = size_range(d)
    low = F.array(F.lit(1.0), *(F.lit(float(r)) for r in RANGES[:-1]))
    mean = F.sqrt(F.element_at(low, place) * F.element_at(F.array(*(F.lit(float(r)) for r in RANGES)), place))
    first = 0.8 + 0.020 * mean
    fine = F.bround(first * F.pow(F.pow(_row(GRADES, F.lit(5), place) / first, F.lit(0.25)), grade - 1))
    listed = _row(GRADES, F.when(grade > 11, grade - 5).otherwise(grade), place)
    return F.when(grade.between(5, 11), listed).when(grade.between(12, 16), listed * 10).when(grade.between(1, 4), fine) * 1e-3


def fit_parts(designation: Column) -> tuple[Column, Column]:
    """Letter and grade of a fit such as H7; nulls if it is none or its letter is not known."""
    text = F.trim(designation)
    letter, grade = F.regexp_extract(text, r"^([A-Z]{1,2}|[a-z]{1,2})\s*(\d{1,2})$", 1), F.regexp_extract(text, r"^([A-Z]{1,2}|[a-z]{1,2})\s*(\d{1,2})$", 2)
    known = F.lower(letter).isin(*SHAFT_UPPER, *SHAFT_LOWER, "js")
    return F.when(known, letter), F.when(known, grade.try_cast("int"))


def fit_limits(nominal: Column, designation: Column) -> Column:
    """Struct of upper and lower deviation in mm; fields null for what the tables do not cover.

    A hole mirrors the shaft of its letter; holes of the transition and
    interference letters are corrected by the step to the next finer grade.
    """
    letter, grade = fit_parts(designation)
    key, hole, place = F.lower(letter), letter == F.upper(letter), size_range(nominal)
    width = it_grade(nominal, grade)
    above = _row(SHAFT_UPPER, key, place) * 1e-3
    below = F.when((key == "k") & ~grade.between(4, 7), 0.0).otherwise(_row(SHAFT_LOWER, key, place) * 1e-3)
    most = F.create_map(*[F.lit(x) for kv in CORRECTED.items() for x in kv])
    step = F.when((place > 1) & grade.between(F.lit(2), F.try_element_at(most, key)), width - it_grade(nominal, grade - 1)).otherwise(0.0)
    upper = F.when(key == "js", width / 2).when(above.isNotNull(), F.when(hole, width - above).otherwise(above)).otherwise(F.when(hole, step - below).otherwise(below + width))
    lower = F.when(key == "js", -width / 2).when(above.isNotNull(), F.when(hole, 0.0 - above).otherwise(above - width)).otherwise(F.when(hole, step - below - width).otherwise(below))
    return F.struct((upper + 0.0).alias("upper"), (lower + 0.0).alias("lower"))


def limit_sizes(nominal: Column, limits: Column, hole: Column) -> Column:
    """Struct of a fit's width, its sizes of most and of least material, and its bounds, from the deviations."""
    low, high = nominal + limits["lower"], nominal + limits["upper"]
    return F.struct((limits["upper"] - limits["lower"]).alias("width"), F.when(hole, low).otherwise(high).alias("most_material"), F.when(hole, high).otherwise(low).alias("least_material"), low.alias("low"), high.alias("high"))


def mean_size(d: Column) -> Column:
    """Geometric mean of the bounds of a diameter's size range; the first range begins at 1."""
    place = size_range(d)
    low = F.array(F.lit(1.0), *(F.lit(float(r)) for r in RANGES[:-1]))
    return F.sqrt(F.element_at(low, place) * F.element_at(F.array(*(F.lit(float(r)) for r in RANGES)), place))


def formula_width(d: Column, grade: Column) -> Column:
    """A grade's width in mm by the rule behind the table, for grades 5 to 16; null elsewhere."""
    mean, times = mean_size(d), F.create_map(*[F.lit(x) for kv in MULTIPLES.items() for x in kv])
    return F.try_element_at(times, grade) * (0.45 * F.pow(mean, F.lit(1 / 3)) + 0.001 * mean) * 1e-3


def formula_deviation(d: Column, letter: Column) -> Column:
    """A shaft's fundamental deviation in mm by the rule behind the table; null for letters without one.

    That of m is the step from grade 6 to grade 7.
    """
    mean, out = mean_size(d), F.when(letter == "m", it_grade(d, F.lit(7)) - it_grade(d, F.lit(6)))
    for key, (factor, power) in POWERS.items():
        out = out.when(letter == key, factor * F.pow(mean, F.lit(power)) * 1e-3)
    return out


def renard(series: int, low: float, high: float) -> list[float]:
    """The series' values from low to high."""
    if series not in RENARD or not 0 < low <= high:
        raise ValueError(f"no series {series} from {low} to {high}")
    decades = range(-9, 13)
    return sorted({v for e in decades for x in RENARD[series] if low <= (v := round(x * 10.0**e, 6)) <= high})


def snap(value: Column, series: list[float]) -> Column:
    """The nearest of a sorted series, the smaller on ties, the end beyond it."""
    listed = F.array(*map(F.lit, series))
    below = F.array_max(F.filter(listed, lambda x: x < value))
    above = F.array_min(F.filter(listed, lambda x: x >= value))
    return F.when(below.isNull(), above).when(above.isNull(), below).when(value - below <= above - value, below).otherwise(above)
