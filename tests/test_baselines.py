import json

from pyspark.sql import functions as F

from gaugeline.operators import baselines, sheets
from gaugeline.sources import calls

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


def item(nominal, box, **more):
    return {"kind": "dimension", "view": "front", "bbox": box, "dim_type": "linear", "nominal": nominal} | more


def pages(spark, n=2):
    return spark.createDataFrame([(k, "mm", b"image%d" % k, 400, 300) for k in range(n)], "drawing_id long, units string, image binary, width int, height int")


def test_zero_shot_fills_in_and_uses_the_cache(spark, tmp_path):
    answer = json.dumps({"characteristics": [item(5.0, [0, 0, 40, 20]), item(7.0, [0, 50, 40, 70], colour=1)]})
    items, replies = baselines.zero_shot(pages(spark), "Read sheet {drawing_id}.", calls.scripted({"sheet 0": answer}, otherwise="I cannot."))
    rows = {(r.drawing_id, r.idx): (r.reason, r.id) for r in items.collect()}
    assert rows == {(0, 0): (None, 1), (0, 1): ("unknown key", 2), (1, 0): ("no JSON object", None)}
    calls.save_responses(replies, str(tmp_path / "c"))
    again, second = baselines.zero_shot(pages(spark), "Read sheet {drawing_id}.", calls.scripted({}), cache=spark.read.parquet(str(tmp_path / "c")))
    assert second.where("error IS NOT NULL").count() == 0 and again.count() == 3


def test_tiles_are_placed_deduplicated_and_voted(spark):
    # tiles of a 400 x 300 sheet overlap: the same callout is seen from two of them, in their own coordinates
    left, right = json.dumps({"characteristics": [item(5.0, [190, 10, 215, 30])]}), json.dumps({"characteristics": [item(5.0, [14, 10, 39, 30]), item(9.0, [100, 100, 130, 120])]})
    answers = {"0,0,224,168": left, "176,0,400,168": right}
    out = baselines.tiled(pages(spark, 1), "Read tile", calls.scripted(answers, otherwise='{"characteristics": []}')).orderBy("id").collect()
    assert [(r.id, r.nominal, r.bbox.x0, r.votes) for r in out] == [(1, 5.0, 190.0, 3), (2, 9.0, 276.0, 3)]


def test_text_reader(spark):
    words = [(1, 0, "⌀44", 100.0, 50.0, 20.0), (1, 1, "H7", 122.0, 50.0, 12.0), (1, 2, "NOTE", 300.0, 50.0, 24.0), (1, 3, "A", 2.0, 2.0, 6.0), (1, 4, "±0.1", 100.0, 200.0, 24.0), (1, 5, "12", 100.0, 188.0, 24.0), (1, 6, "R5", 300.0, 300.0, 12.0), (1, 7, "X1", 500.0, 560.0, 12.0), (2, 0, "12", 100.0, 100.0, 12.0)]
    words = spark.createDataFrame([(p, o, t, True, x, y, x + w, y + 10.0) for p, o, t, x, y, w in words], "page_id long, ord int, text string, upright boolean, x0 double, top double, x1 double, bottom double")
    rects = spark.createDataFrame([(1, (10.0, 10.0, 790.0, 590.0), 480000.0), (1, (400.0, 500.0, 790.0, 590.0), 480000.0)], f"page_id long, box {BOX}, page_area double")
    sized = spark.createDataFrame([(1, 2.0, 1600, 1200), (2, 2.0, 1600, 1200)], "page_id long, scale double, width int, height int")
    items, refused, scans = baselines.from_text(words, baselines.sheet_regions(rects), sized)
    got = {r.raw_text: (r.dim_type, r.nominal, r.fit_class, r.upper_tol, r.bbox.x0) for r in items.collect()}
    assert got == {"⌀44 H7": ("diameter", 44.0, "H7", None, 200.0), "12 ±0.1": ("linear", 12.0, None, 0.1, 200.0), "R5": ("radius", 5.0, None, None, 600.0)}
    assert sorted(r.id for r in items.collect()) == [1, 2, 3]
    assert [r.text for r in refused.collect()] == ["NOTE"] and [r.page_id for r in scans.collect()] == [2]


def test_run_counters_and_costs(spark, tmp_path):
    replies = spark.createDataFrame([(1, "x", None), (1, None, "E: a"), (2, "y", None)], "drawing_id long, response string, error string")
    r = sheets.run_counters(replies).first()
    assert (r.drawings, r.calls, r.failures, r.errors) == (2, 3, 1, ["E: a"])
    (tmp_path / "costs.json").write_text(json.dumps({"critical_multiplier": 4.0, "weights": {"a": {"cost": 1.5, "rationale": "x"}}}))
    assert [tuple(r) for r in sheets.error_costs(spark, str(tmp_path / "costs.json")).collect()] == [("a", 1.5, 4.0)]
    import zlib

    got = spark.range(1).select(sheets.drawing_seed(F.lit(7), F.lit("flange")).alias("s")).first().s
    assert got == (7 * 1000003 + zlib.crc32(b"flange")) % 2**32
