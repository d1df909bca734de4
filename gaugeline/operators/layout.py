"""Words of a page to callouts, readings to votes, tiles and numbering."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gaugeline.functions.callouts import SAME_CALLOUT, MatchConfig
from gaugeline.operators.matching import pairs

LINE, GAP, STACK_GAP, OVERHANG = 0.6, 0.9, 0.8, 0.3
FEW_WORDS = 8


def _islands(words: DataFrame, along: tuple[str, str], across: tuple[str, str], page: str, order: str) -> DataFrame:
    """Runs of words: a new one where a word leaves the line or the gap to the word before is wide.

    ``along`` are the start and end in reading direction, ``across`` those of the
    line. One window a page: lag for the word before, a running sum for the run.
    """
    lead = Window.partitionBy(page).orderBy(F.bround(across[0], 1), along[0], order)
    before = {c: F.lag(c).over(lead) for c in (*along, *across)}
    high = F.greatest(before[across[1]] - before[across[0]], F.lit(1e-6))
    joins = (F.abs(F.col(across[0]) - before[across[0]]) <= high * LINE) & (F.col(along[0]) - before[along[1]] <= high * GAP)
    return words.withColumn("starts", F.when(joins, 0).otherwise(1)).withColumn("run", F.sum("starts").over(lead.rowsBetween(Window.unboundedPreceding, 0)))


def cluster_lines(words: DataFrame, *, page: str = "page_id", order: str = "ord") -> DataFrame:
    """Upright words in runs along a line: (page, run, text, words, box, height)."""
    runs = _islands(words.where("upright"), ("x0", "x1"), ("top", "bottom"), page, order)
    return _gathered(runs, page, F.struct("x0", F.col(order)), " ", False)


def cluster_columns(words: DataFrame, *, page: str = "page_id", order: str = "ord") -> DataFrame:
    """Words turned on their side, in runs along a column and read from the bottom up, without blanks."""
    runs = _islands(words.where("NOT upright"), ("top", "bottom"), ("x0", "x1"), page, order)
    return _gathered(runs, page, F.struct((-F.col("top")).alias("top"), (-F.col(order)).alias("o")), "", True)


def _gathered(runs: DataFrame, page: str, order: Column, between: str, rotated: bool) -> DataFrame:
    one = runs.groupBy(page, "run").agg(
        F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col("text")))).alias("ws"),
        F.struct(F.min("x0").alias("x0"), F.min("top").alias("y0"), F.max("x1").alias("x1"), F.max("bottom").alias("y1")).alias("box"),
        F.max(F.col("bottom") - F.col("top")).alias("height"),
    )
    return one.select(page, "run", F.array_join(F.transform("ws", lambda w: w["text"]), between).alias("text"), F.size("ws").alias("words"), "box", "height", F.lit(rotated).alias("rotated"))


@F.arrow_udf(returnType=T.ArrayType(T.ArrayType(T.IntegerType())))
def _hosted(boxes: pa.Array) -> pa.Array:
    """The places of the lines of each callout, callouts in order of their first line.

    A line joins the first callout that it stands on: mostly the same columns, about
    one centre, a small gap. Boxes are read from Arrow's own buffers, so a batch of
    pages takes 40 bytes a line here, and only one page's callouts are held. A line
    without a box (NaN here) stands on none.
    """
    sizes = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(boxes), 0).to_numpy(zero_copy_only=False)))
    flat = boxes.flatten()
    edges = [pc.struct_field(flat, [k]) for k in range(5)]
    groups, lengths, places = [0], [], []
    for start, stop in itertools.pairwise(sizes.tolist()):
        made: list[list[float]] = []  # callouts as they have grown: x0, y0, x1, y1, height
        members: list[list[int]] = []
        for k, (x0, y0, x1, y1, high) in enumerate(zip(*(e.slice(start, stop - start).to_numpy(zero_copy_only=False).tolist() for e in edges), strict=True)):
            for m, of in zip(made, members, strict=True):
                a0, b0, a1, b1, h = m
                shared = (a1 if a1 < x1 else x1) - (a0 if a0 > x0 else x0)
                if shared > 0:
                    wide, width, most = a1 - a0, x1 - x0, max(h, high)
                    gap = y0 - b1 if y0 >= b1 else b0 - y1
                    if -OVERHANG * most <= gap <= STACK_GAP * most and shared >= 0.5 * max(min(wide, width), 1e-6) and abs(a0 + a1 - x0 - x1) / 2 <= 0.6 * max(wide, width):
                        m[:] = min(a0, x0), min(b0, y0), max(a1, x1), max(b1, y1), most
                        of.append(k)
                        break
            else:
                made.append([x0, y0, x1, y1, high])
                members.append([k])
        lengths += map(len, members)
        places += itertools.chain.from_iterable(members)
        groups.append(len(lengths))
    inner = pa.ListArray.from_arrays(np.append(0, np.cumsum(lengths)).astype("int32"), pa.array(places, pa.int32()))
    return pa.ListArray.from_arrays(np.array(groups, "int32"), inner)


def merge_stacks(lines: DataFrame, *, page: str = "page_id") -> DataFrame:
    """Lines that stand on each other joined to one callout, in order; a callout grows as it takes lines.

    The outcome depends on the order, so a page's boxes go to one function call;
    a page is a sheet, its lines a few hundred. Texts stay where they are.
    """
    edges = {"x0": F.array_min, "y0": F.array_min, "x1": F.array_max, "y1": F.array_max}
    gathered = lines.groupBy(page).agg(F.array_sort(F.collect_list(F.struct("run", "text", "box", "height", "rotated"))).alias("lines"))
    boxes = F.transform("lines", lambda c: F.struct(*(c["box"][e].cast("double").alias(e) for e in edges), c["height"].cast("double").alias("height")))

    def each(of: Column, e: str) -> Column:
        return F.transform(of, lambda c: c["box"][e].cast("double"))

    def merged(places: Column) -> Column:
        of = F.transform(places, lambda k: F.element_at("lines", k + 1))
        text = F.array_join(F.transform(of, lambda c, k: F.concat(F.when((k == 0) | c["rotated"], "").otherwise(" "), c["text"])), "")
        bounds = (pick(each(of, e)).alias(e) for e, pick in edges.items())
        return F.struct(text.alias("text"), *bounds, F.array_max(F.transform(of, lambda c: c["height"].cast("double"))).alias("height"))

    made = gathered.withColumn("members", _hosted(boxes)).select(page, F.transform("members", merged).alias("made"))
    return made.select(page, F.posexplode("made").alias("pos", "c")).select(page, "pos", "c.*")


def sparse_pages(words: DataFrame, *, page: str = "page_id", least: int = FEW_WORDS) -> DataFrame:
    """Pages with too few words to hold text: scans."""
    return words.groupBy(page).agg(F.count(F.lit(1)).alias("words")).where(F.col("words") < least)


def inside(box: Column, region: Column) -> Column:
    """Whether a box's middle is in a closed region."""
    x, y = (box["x0"] + box["x1"]) / 2, (box["y0"] + box["y1"]) / 2
    return x.between(region["x0"], region["x1"]) & y.between(region["y0"], region["y1"])


def to_pixels(box: Column, scale: Column, width: Column, height: Column) -> Column:
    """A page box as whole pixels on the image; null if under a pixel is left."""
    x0, y0 = F.greatest(F.lit(0.0), box["x0"] * scale), F.greatest(F.lit(0.0), box["y0"] * scale)
    x1, y1 = F.least(width.cast("double"), box["x1"] * scale), F.least(height.cast("double"), box["y1"] * scale)
    return F.when((x1 - x0 >= 1) & (y1 - y0 >= 1), F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")))


def tiles(width: Column, height: Column, *, rows: int = 2, columns: int = 2, overlap: float = 0.12) -> Column:
    """An array of overlapping crops that cover an image, whole pixels, row by row."""
    wide, high = width / columns, height / rows

    def crop(k: Column) -> Column:
        row, column = F.floor(k / columns), k % columns
        x0, y0 = F.greatest(F.lit(0), (column * wide - wide * overlap).cast("int")), F.greatest(F.lit(0), (row * high - high * overlap).cast("int"))
        x1, y1 = F.least(width, ((column + 1) * wide + wide * overlap).cast("int")), F.least(height, ((row + 1) * high + high * overlap).cast("int"))
        return F.struct(row.cast("int").alias("row"), column.cast("int").alias("col"), x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))

    return F.transform(F.sequence(F.lit(0), F.lit(rows * columns - 1)), crop)


def moved(box: Column, dx: Column, dy: Column) -> Column:
    """A box from crop to sheet coordinates."""
    return F.struct((box["x0"] + dx).alias("x0"), (box["y0"] + dy).alias("y0"), (box["x1"] + dx).alias("x1"), (box["y1"] + dy).alias("y1"))


def numbered(rows: DataFrame, key: str, *order: Column | str) -> DataFrame:
    """Ids from 1 in an order, without gaps."""
    return rows.withColumn("id", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


VOTES = T.ArrayType(T.StructType([T.StructField("place", T.IntegerType()), T.StructField("votes", T.IntegerType())]))


@F.udf(returnType=VOTES, useArrow=True)
def _voted(runs, same):
    """Clusters in order of their first reading; each takes one reading a run."""
    alike = {(int(s["a"]), int(s["b"])) for s in (same if same is not None else [])}
    clusters: list[tuple[int, set[int]]] = []
    for place, run in enumerate(runs if runs is not None else []):
        host = next((c for c in clusters if run not in c[1] and (c[0], place) in alike), None)
        if host is None:
            clusters.append((place, {run}))
        else:
            host[1].add(run)
    return [{"place": p, "votes": len(s)} for p, s in clusters]


def merge_by_vote(readings: DataFrame, *, key: str = "drawing_id", run: str = "run", order: str = "id", config: MatchConfig = SAME_CALLOUT, least: int | None = None) -> DataFrame:
    """Readings of several runs pooled: (key, place, votes, id) of each first reading that half the runs support.

    Which readings are alike is one self-join on the drawing; the greedy pooling
    depends on the order and runs on a drawing's array of positions.
    """
    listed = readings.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(run, order)) - 1)
    alike = pairs(listed, listed, config, key=key).where((F.col("g.place") < F.col("p.place")) & (F.col("cost") <= config.max_cost)).groupBy(key).agg(F.collect_list(F.struct(F.col("g.place").alias("a"), F.col("p.place").alias("b"))).alias("same"))
    arrays = listed.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", run))), lambda s: s[run]).alias("runs"), F.countDistinct(run).alias("n"))
    voted = arrays.join(alike, key, "left").select(key, "n", F.explode(_voted("runs", "same")).alias("v")).select(key, "n", "v.*")
    needed = F.lit(least) if least is not None else F.greatest(F.lit(1), F.ceil(F.col("n") / 2))
    kept = voted.where(F.col("votes") >= needed)
    return kept.select(key, "place", "votes", F.row_number().over(Window.partitionBy(key).orderBy("place")).alias("id"))


@F.udf(returnType=T.ArrayType(T.IntegerType()), useArrow=True)
def _first_of_each(n, same):
    alike = {(int(s["a"]), int(s["b"])) for s in (same if same is not None else [])}
    kept: list[int] = []
    for place in range(int(n)):
        if not any((k, place) in alike for k in kept):
            kept.append(place)
    return kept


def dedupe(items: DataFrame, *, key: str = "drawing_id", order: str = "id", config: MatchConfig = SAME_CALLOUT) -> DataFrame:
    """Places of the items that are not alike any kept before: (key, place)."""
    listed = items.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1)
    alike = pairs(listed, listed, config, key=key).where((F.col("g.place") < F.col("p.place")) & (F.col("cost") <= config.max_cost)).groupBy(key).agg(F.collect_list(F.struct(F.col("g.place").alias("a"), F.col("p.place").alias("b"))).alias("same"))
    return listed.groupBy(key).agg(F.count(F.lit(1)).alias("n")).join(alike, key, "left").select(key, F.explode(_first_of_each("n", "same")).alias("place"))


def pattern_centres(radius: Column, count: Column, x: Column, y: Column) -> Column:
    """Centres of holes equally spaced on a circle."""
    return F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.struct((x + radius * F.cos(2 * math.pi * k / count)).alias("x"), (y + radius * F.sin(2 * math.pi * k / count)).alias("y")))


def grid_centres(views: DataFrame, *, gap: float, key: str = "drawing_id", third_angle: bool = True) -> DataFrame:
    """Centres of views (key, view, col, row, wide, high) on a grid: (key, view, x, y), from the lower left corner.

    A column is as wide as its widest view, a row as high as its highest; views stand
    in the middle of their cells. First angle puts each view on the other side of the
    primary one. A sheet has a handful of views, so the running sums are small windows.
    """
    sign = 1 if third_angle else -1
    placed = views.withColumn("col", F.col("col") * sign).withColumn("row", F.col("row") * sign)
    for cell, extent, centre in (("col", "wide", "x"), ("row", "high", "y")):
        lanes = placed.groupBy(key, cell).agg(F.max(extent).alias("most"))
        before = Window.partitionBy(key).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
        lanes = lanes.select(key, cell, (F.coalesce(F.sum(F.col("most") + gap).over(before), F.lit(0.0)) + F.col("most") / 2).alias(centre))
        placed = placed.join(lanes, [key, cell])
    return placed.select(key, "view", "x", "y")


def placement_order(chars: DataFrame, importance: Column, *, key: str = "drawing_id", order: str = "id") -> DataFrame:
    """(key, id, turn): callouts in the order in which they are placed, the most important first, ties as listed."""
    return chars.select(key, "id", F.row_number().over(Window.partitionBy(key).orderBy(importance.desc(), order)).alias("turn"))
