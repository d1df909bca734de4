"""Three ways to read a sheet, from rows of sheets to judged items: one prompt, tiles with votes, and the page's own text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gaugeline.functions.callouts import SAME_CALLOUT
from gaugeline.functions.grammar import parse_callout
from gaugeline.operators import layout
from gaugeline.operators.rules import callout_rules, first_reason
from gaugeline.sources import calls

KEY = "drawing_id"
FRAME, BLOCK, EDGE = 0.6, 0.02, 0.02


def area(box: Column) -> Column:
    return F.greatest(F.lit(0.0), box["x1"] - box["x0"]) * F.greatest(F.lit(0.0), box["y1"] - box["y0"])


def sheet_regions(rects: DataFrame, *, page: str = "page_id") -> DataFrame:
    """(page, frame, excluded) from the drawn rectangles of pages (page, box, page_area).

    The frame is the largest rectangle of at least 60 % of the page; excluded are
    those of at least 2 % of the frame within it that touch its upper or lower
    edge. Pages without a frame give no row.
    """
    sized = rects.withColumn("area", area(F.col("box")))
    frames = sized.where(F.col("area") >= FRAME * F.col("page_area")).groupBy(page).agg(F.max_by("box", F.struct("area", "box")).alias("frame"))
    b, f = F.col("box"), F.col("frame")
    near = EDGE * (f["y1"] - f["y0"])
    block = (b != f) & (F.col("area") >= BLOCK * area(f)) & (b["x0"] >= f["x0"] - 1) & (b["y1"] <= f["y1"] + 1) & ((F.abs(b["y1"] - f["y1"]) < near) | (F.abs(b["y0"] - f["y0"]) < near))
    return sized.join(frames, page).groupBy(page).agg(F.first("frame").alias("frame"), F.array_sort(F.collect_list(F.when(block, b))).alias("excluded"))


def _asked(sheets: DataFrame, prompt: Column, cache: DataFrame | None, make_provider: Callable, temperature: float) -> DataFrame:
    """Replies to a prompt a row, from the cache where it has them: the rows with digest, response and error."""
    image = F.sha2(F.coalesce("image", F.lit(b"")), 256)
    rows = sheets.withColumn("prompt", prompt).withColumn("digest", calls.request_digest(F.col("model"), F.sha2("prompt", 256), image, F.lit(temperature), F.col("sample"), F.create_map(F.lit("tile"), F.col("tile"))))
    if cache is None:
        return calls.call(rows, make_provider)
    hits, misses = calls.split_cached(rows, cache)
    answered = calls.call(misses, make_provider)
    return answered.unionByName(hits.withColumn("error", F.lit(None).cast("string")).select(*answered.columns))


def zero_shot(sheets: DataFrame, prompt: str, make_provider: Callable, *, model: str = "scripted", cache: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Items of one call a sheet, and the replies. ``sheets`` has drawing_id, units and image (binary)."""
    rows = sheets.withColumn("model", F.lit(model)).withColumn("sample", F.lit(0)).withColumn("tile", F.lit("whole"))
    replies = _asked(rows, F.format_string(prompt.replace("{drawing_id}", "%s"), F.col(KEY).cast("string")) if "{drawing_id}" in prompt else F.lit(prompt), cache, make_provider, 0.0)
    return calls.reply_items(replies), replies


def tiled(sheets: DataFrame, prompt: str, make_provider: Callable, *, model: str = "scripted", samples: int = 3, cache: DataFrame | None = None) -> DataFrame:
    """Items that half of several samples agree on, each sample read tile by tile.

    ``sheets`` has drawing_id, units, image, width and height. Items come back
    in sheet coordinates; repeats from overlapping tiles go before the vote.
    """
    rows = sheets.withColumn("t", F.explode(layout.tiles(F.col("width"), F.col("height")))).withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    rows = rows.withColumn("tile", F.concat_ws(",", "t.x0", "t.y0", "t.x1", "t.y1")).withColumn("model", F.lit(model))
    part = F.concat(F.lit(prompt + " "), F.col("tile"))
    replies = _asked(rows, part, cache, make_provider, 0.7)
    # a reply is one (drawing, sample, tile); its items keep that as their drawing until they are placed
    tagged = replies.withColumn("whole", F.col(KEY)).withColumn(KEY, F.struct(F.col("whole").alias("d"), "sample", "t"))
    items = calls.reply_items(tagged).where(F.col("reason").isNull())
    moved = layout.moved(F.col("bbox"), F.col(f"{KEY}.t.x0"), F.col(f"{KEY}.t.y0"))
    items = items.withColumn("bbox", moved).withColumn("sample", F.col(f"{KEY}.sample")).withColumn("place", F.struct(F.col(f"{KEY}.t.row").alias("r"), F.col(f"{KEY}.t.col").alias("c"), "idx")).withColumn(KEY, F.col(f"{KEY}.d"))
    items = items.withColumn("id", F.row_number().over(Window.partitionBy(KEY, "sample").orderBy("place"))).drop("place", "raw", "reason", "idx")
    each = items.withColumn("run_key", F.struct(KEY, "sample"))
    kept = layout.dedupe(each, key="run_key", order="id").select(F.col("run_key"), (F.col("place") + 1).alias("id"))
    single = each.join(kept, ["run_key", "id"]).drop("run_key")
    voted = layout.merge_by_vote(single, run="sample", order="id", config=SAME_CALLOUT)
    placed = single.withColumn("place", F.row_number().over(Window.partitionBy(KEY).orderBy("sample", "id")) - 1).drop("id")
    return placed.join(voted, [KEY, "place"]).drop("place", "sample")


def from_text(words: DataFrame, regions: DataFrame, sheets: DataFrame, *, page: str = "page_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Items that the grammar reads from a page's words, the clusters it refuses, and the pages that are scans.

    ``sheets`` has page, scale, width and height of the image. Clusters outside
    the frame or in an excluded block are no callouts; ``refused`` can be sent to
    a provider.
    """
    scans = layout.sparse_pages(words, page=page)
    words = words.join(scans, page, "left_anti")
    lines = layout.merge_stacks(layout.cluster_lines(words, page=page), page=page).withColumn("side", F.lit(0))
    columns = layout.merge_stacks(layout.cluster_columns(words, page=page), page=page).withColumn("side", F.lit(1))
    clusters = lines.unionByName(columns).withColumn("box", F.struct("x0", "y0", "x1", "y1")).drop("x0", "y0", "x1", "y1", "height").join(regions, page, "left")
    out = F.col("frame").isNotNull() & (~layout.inside(F.col("box"), F.col("frame")) | F.exists(F.coalesce("excluded", F.array().cast("array<struct<x0:double,y0:double,x1:double,y1:double>>")), lambda r: layout.inside(F.col("box"), r)))
    clusters = clusters.where(~out).join(sheets.select(page, "scale", "width", "height"), page)
    clusters = clusters.withColumn("bbox", layout.to_pixels(F.col("box"), F.col("scale"), F.col("width"), F.col("height"))).where(F.col("bbox").isNotNull())
    read = clusters.withColumn("c", parse_callout("text"))
    good = read.where(F.col("c.error").isNull()).select(page, "side", "pos", "bbox", F.col("text").alias("raw_text"), *(F.col(f"c.{f}").alias(f) for f in ("kind", "dim_type", "nominal", "upper_tol", "lower_tol", "tol_style", "fit_class", "gtol_symbol", "gtol_value", "gtol_zone", "material_modifier", "notes")), F.coalesce("c.is_reference", F.lit(False)).alias("is_reference"), F.coalesce("c.datum_refs", F.array().cast("array<struct<label:string,modifier:string>>")).alias("datum_refs"))
    good = good.withColumn("id", F.row_number().over(Window.partitionBy(page).orderBy("side", "pos"))).withColumn("is_basic", F.lit(False)).withColumn("view", F.lit("unknown"))
    judged = good.withColumn("reason", first_reason(callout_rules()))
    valid = judged.where(F.col("reason").isNull())
    items = valid.withColumn("id", F.row_number().over(Window.partitionBy(page).orderBy("side", "pos"))).drop("reason", "side", "pos")
    refused = read.where(F.col("c.error").isNotNull()).select(page, "side", "pos", "text", "bbox", F.col("c.error").alias("reason"))
    refused = refused.unionByName(judged.where(F.col("reason").isNotNull()).select(page, "side", "pos", F.col("raw_text").alias("text"), "bbox", "reason"))
    return items, refused, scans


READERS = {"zero_shot": zero_shot, "tiled": tiled, "from_text": from_text}
