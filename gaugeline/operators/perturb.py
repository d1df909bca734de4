"""Deliberate errors in true drawings: one seeded choice a drawing, and whether geometry could tell.

The choice is the candidate with the least hash of (seed, kind, drawing, id): one
minimum a drawing, no random state to carry between tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gaugeline.constants import MM_PER_INCH
from gaugeline.functions.writing import value_text
from gaugeline.operators.verification import frame_types, sufficient

KEY = "drawing_id"
FLIPPED = ("position", "perpendicularity", "parallelism", "angularity")
SPARE_LABELS = ("X", "Y", "Z", "W", "V")


def draw(seed: int, kind: str, *columns: str) -> Column:
    """A number in [0, 1) from a seed, a kind and columns, the same in any engine that has md5."""
    text = F.concat_ws(":", F.lit(f"{seed}:{kind}"), *(F.col(c).cast("string") for c in columns))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def chosen(candidates: DataFrame, seed: int, kind: str) -> DataFrame:
    """One candidate a drawing."""
    pick = F.min_by(F.col("id"), F.struct(draw(seed, kind, KEY, "id"), F.col("id")))
    return candidates.groupBy(KEY).agg(pick.alias("id")).join(candidates, [KEY, "id"])


def perturb_nominal(chars: DataFrame, seed: int) -> DataFrame:
    """A digit error: a decade, a quarter more, or half. (drawing_id, id, before, after)"""
    rows = chosen(chars.where((F.col("kind") == "dimension") & (F.col("nominal") != 0) & F.col("dim_type").isin("linear", "diameter", "radius") & ~F.col("is_reference")), seed, "perturb_nominal")
    style = F.floor(draw(seed, "style", KEY) * 3)
    before = F.col("nominal")
    after = F.when(style == 0, F.when(before < 100, before * 10).otherwise(before / 10)).when(style == 1, before + F.greatest(F.lit(1.0), 0.25 * before)).otherwise(before * 0.5)
    return rows.select(KEY, "id", before.alias("before"), F.bround(after, 4).alias("after")).where(F.abs(F.col("after") - F.col("before")) >= 1e-6)


def rewritten(chars: DataFrame, changes: DataFrame) -> DataFrame:
    """The callouts with changed sizes (drawing_id, id, before, after) put in, in the number and in the text that shows it."""
    hit = chars.join(changes.select(KEY, "id", F.col("before").alias("__before"), F.col("after").alias("__after")), [KEY, "id"], "left")
    old, new = (value_text(F.col(c), 4, zeros=False) for c in ("__before", "__after"))
    text = F.when(F.col("__after").isNotNull(), F.replace(F.coalesce("raw_text", F.lit("")), old, new)).otherwise(F.col("raw_text"))
    return hit.withColumn("raw_text", text).withColumn("nominal", F.coalesce("__after", "nominal")).drop("__before", "__after")


def _labels(refs: str = "datum_refs") -> Column:
    return F.transform(refs, lambda r: r["label"])


def _benign(rows: DataFrame, datums: DataFrame, before: str, after: str) -> DataFrame:
    """Whether both frames constrain enough, so that no geometry can tell them apart."""
    out = rows
    for name in (before, after):
        typed = frame_types(out.withColumn("datum_refs", F.transform(name, lambda x: F.struct(x.alias("label"), F.lit(None).cast("string").alias("modifier")))), datums)
        out = typed.withColumn(f"{name}_ok", sufficient(F.col("gtol_symbol"), F.transform("types", lambda t: F.coalesce(t, F.lit(""))))).drop("types", "datum_refs")
    return out.withColumn("benign", F.col(f"{before}_ok") & F.col(f"{after}_ok"))


def shuffle_refs(chars: DataFrame, datums: DataFrame, seed: int) -> DataFrame:
    """The references of a frame in reverse order. (drawing_id, id, before, after, benign)"""
    rows = chosen(chars.where(F.size("datum_refs") >= 2), seed, "shuffle_datum_refs")
    rows = rows.select(KEY, "id", "gtol_symbol", _labels().alias("before"), F.reverse(_labels()).alias("after"))
    return _benign(rows, datums, "before", "after").select(KEY, "id", "before", "after", "benign")


def underconstrain(chars: DataFrame, datums: DataFrame, seed: int) -> DataFrame:
    """A frame cut down to its first datum; benign if that is enough."""
    rows = chosen(chars.where((F.size("datum_refs") >= 2) & F.col("gtol_symbol").isNotNull()), seed, "underconstrain_drf")
    rows = rows.select(KEY, "id", "gtol_symbol", _labels().alias("before"), F.slice(_labels(), 1, 1).alias("after"))
    return _benign(rows, datums, "before", "after").select(KEY, "id", "before", "after", F.col("after_ok").alias("benign"))


def swap_datum(chars: DataFrame, datums: DataFrame, seed: int) -> DataFrame:
    """The primary datum replaced by another declared one; nothing if the frame has that one already."""
    known = datums.groupBy(KEY).agg(F.array_sort(F.collect_set("label")).alias("known"))
    rows = chosen(chars.where(F.size("datum_refs") > 0), seed, "swap_datum").join(known, KEY).withColumn("before", _labels())
    others = F.array_except("known", F.slice("before", 1, 1))
    rows = rows.withColumn("others", others).where(F.size("others") > 0)
    new = F.element_at("others", (F.floor(draw(seed, "other", KEY) * F.size("others")) + 1).cast("int"))
    rows = rows.withColumn("new", new).where(~F.array_contains("before", F.col("new")))
    rows = rows.select(KEY, "id", "gtol_symbol", "before", F.concat(F.array("new"), F.slice("before", 2, F.greatest(F.size("before") - 1, F.lit(0)))).alias("after"))
    return _benign(rows, datums, "before", "after").select(KEY, "id", "before", "after", "benign")


def flip_modifier(chars: DataFrame, drawings: DataFrame, seed: int) -> DataFrame:
    """A modifier dropped or invented; only an invented one on a sheet without general tolerances can be told."""
    rows = chosen(chars.where((F.col("kind") == "geometric_tolerance") & F.col("gtol_symbol").isin(*FLIPPED)), seed, "flip_modifier").join(drawings.select(KEY, "general_tolerance"), KEY)
    before = F.col("material_modifier")
    after = F.when(before.isNull(), "MMC")
    return rows.select(KEY, "id", before.alias("before"), after.alias("after"), (after.isNull() | F.col("general_tolerance").isNotNull()).alias("benign"))


def drop_characteristic(chars: DataFrame, seed: int) -> DataFrame:
    """All callouts but one, numbered anew: (drawing_id, id, old_id). Frames with datums are spared where others remain."""
    spared = (F.col("kind") == "geometric_tolerance") & (F.size("datum_refs") > 0)
    counts = chars.groupBy(KEY).agg(F.count(F.lit(1)).alias("n"), F.count_if(~spared).alias("free"))
    rows = chars.join(counts, KEY)
    candidates = rows.where(F.when(F.col("free") > 0, ~spared & (F.col("free") >= 2)).otherwise(F.col("n") >= 2))
    gone = chosen(candidates, seed, "drop_characteristic").select(KEY, "id")
    kept = chars.join(gone, [KEY, "id"], "left_anti").join(gone.select(KEY), KEY, "left_semi")
    return kept.select(KEY, F.row_number().over(Window.partitionBy(KEY).orderBy("id")).alias("new_id"), F.col("id").alias("old_id"))


def undeclared_datum(chars: DataFrame, datums: DataFrame, seed: int) -> DataFrame:
    """The last reference of a frame replaced by the first spare letter. (drawing_id, id, before, after)"""
    known = datums.groupBy(KEY).agg(F.collect_set("label").alias("known"))
    rows = chosen(chars.where(F.size("datum_refs") > 0), seed, "undeclared_datum").join(known, KEY, "left")
    spare = F.array_except(F.array(*map(F.lit, SPARE_LABELS)), F.coalesce("known", F.array().cast("array<string>")))
    return rows.select(KEY, "id", F.element_at(_labels(), -1).alias("before"), F.try_element_at(spare, F.lit(1)).alias("after")).where(F.col("after").isNotNull())


def confuse_units(chars: DataFrame) -> DataFrame:
    """Every size as if the sheet were in the other unit. (drawing_id, id, after)"""
    by = F.when(F.col("units") == "mm", MM_PER_INCH).otherwise(1 / MM_PER_INCH)
    return chars.where((F.col("kind") == "dimension") & F.col("nominal").isNotNull()).select(KEY, "id", F.bround(F.col("nominal") * by, 4).alias("after"))


def new_findings(damaged: DataFrame, clean: DataFrame) -> DataFrame:
    """Findings of the damaged drawing that the clean one did not have."""
    return damaged.subtract(clean.select(*damaged.columns))
