"""Queries that failed on large tables: the same results, and plans that deal the lines out once."""

import itertools
import math
import random

from pyspark.sql import functions as F

from gaugeline.functions import warps
from gaugeline.operators import layout
from gaugeline.plans import registry

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


def test_barrel_bounds_equal_the_whole_outline(spark):
    dice, lens = random.Random(3), warps.Barrel(0.05, 2100, 1500)
    rows = []
    for _ in range(400):
        x, y = dice.uniform(-300, 2300), dice.uniform(-300, 1700)
        rows.append((x, y, x + dice.choice((0.0, 1.0, dice.uniform(0, 1500))), y + dice.choice((0.0, 1.0, dice.uniform(0, 1500)))))
    odd = [(0.0, 0.0, 2100.0, 1500.0), (1050.0, 750.0, 1050.0, 750.0), (500.0, 20.0, 400.0, 10.0), (None, 1.0, 2.0, 3.0), (1.0, 2.0, math.nan, 5.0), (1.0, 2.0, math.inf, 5.0)]
    boxes = spark.createDataFrame([(r,) for r in [*rows, *odd]], f"b {BOX}")
    plain = lambda b: [None if v is None else "nan" if math.isnan(v) else v if math.isinf(v) else round(v, 9) for v in b]
    for got, want in boxes.select(warps.map_box(F.col("b"), lens), warps._outline_box(F.col("b"), lens)).collect():
        assert plain(got) == plain(want)


def test_barrel_maps_few_points_of_each_box(spark):
    """A box's bounds come from its sides; only odd boxes go point by point."""
    boxes = spark.createDataFrame([((0.0, 0.0, 1.0, 1.0),)], f"b {BOX}")
    plan = boxes.select(warps.Barrel(0.05, 2100, 1500).bounds(F.col("b")).alias("m"))._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(" not in plan


def test_stacks_send_boxes_only_and_take_lines_without_a_box(spark):
    """Texts stay out of the worker, whose memory failed; a line without a box stands alone."""
    lines = [(1, k, f"w{k}", (10.0, y, 50.0, y + 10.0) if y is not None else None, 10.0 if y is not None else None, turned) for k, (y, turned) in enumerate([(0.0, False), (12.0, False), (None, False), (24.0, True), (500.0, False)])]
    rows = spark.createDataFrame(lines, f"page_id int, run int, text string, box {BOX}, height double, rotated boolean")
    got = layout.merge_stacks(rows)
    assert [(r.pos, r.text, r.x0, r.y1, r.height) for r in got.orderBy("pos").collect()] == [(0, "w0 w1w3", 10.0, 34.0, 10.0), (1, "w2", None, None, None), (2, "w4", 10.0, 510.0, 10.0)]
    assert layout._hosted.returnType.simpleString() == "array<array<int>>"


def lines_numbered(df):
    """How often the plan numbers the lines of a drawing, before any reuse."""
    return df._jdf.queryExecution().executedPlan().toString().count("Window [row_number()")


def test_known_pairs_number_the_lines_once(spark):
    for name in ("tier2_flags", "cost_breakdown", "drawing_scores", "score_by_profile", "score_by_family", "run_summary"):
        assert lines_numbered(registry.queries()[name](spark, "/root/testdata/sf0.001")) == 1
