import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeline.functions import tables, warps
from gaugeline.operators import pixels, verification
from gaugeline.plans import evaluation
from gaugeline.sources import calls, files, reports
from gaugeline.streaming import runs

ITEM = {"id": 1, "kind": "dimension", "view": "front", "bbox": [0, 0, 10, 10], "dim_type": "linear", "nominal": 5.0, "datum_refs": []}
DRAWING = {"drawing_id": "d1", "source": "synthetic", "units": "mm", "projection": "first_angle", "image_size": [100, 100], "sheet": {"size": "A3", "scale": "1:1"}, "title_block": {"part_number": "p", "revision": "A"}, "datums": [{"label": "A", "feature_type": "axis", "view": "front", "bbox": [0, 0, 5, 5]}], "characteristics": [ITEM], "provenance": {"generator_version": "1", "degradation_profile": "clean"}}


def put(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value, indent=2), encoding="utf-8")


def test_strict_reading_keeps_only_whole_drawings(spark, tmp_path):
    put(tmp_path / "a/d1.json", DRAWING)
    put(tmp_path / "a/b/d2.json", DRAWING | {"drawing_id": "d2", "characteristics": [ITEM, ITEM | {"id": 2, "nominal": None}]})
    put(tmp_path / "d3.json", DRAWING | {"drawing_id": "d3", "characteristics": [ITEM | {"id": 2}]})
    put(tmp_path / "manifest.json", {"x": 1})
    put(tmp_path / "other.json", {"hello": 1})
    drawings, chars, datums = files.read_drawings(spark, str(tmp_path))
    assert [r.drawing_id for r in drawings.collect()] == ["d1"] and chars.count() == 1 and datums.count() == 1
    files.write_drawings(drawings, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1


def test_lenient_reading_judges_each_item(spark, tmp_path):
    put(tmp_path / "p1.json", {"characteristics": [ITEM, ITEM | {"colour": 1}, ITEM | {"nominal": "wide"}, 7, ITEM | {"kind": "frame"}, ITEM | {"bbox": [5, 5, 5, 9]}]})
    put(tmp_path / "p2.json", "no json at all")
    rows = {(r.drawing_id, r.idx): r.reason for r in files.read_predictions(spark, str(tmp_path)).collect()}
    assert rows == {("p1", 0): None, ("p1", 1): "unknown key", ("p1", 2): "not a number", ("p1", 3): "no JSON object", ("p1", 4): "kind", ("p1", 5): "box", ("p2", 0): "no JSON object"}


def test_calls_are_cached_and_fail_softly(spark, tmp_path):
    requests = spark.createDataFrame([(1, "m", "read d1", None), (2, "m", "read d2", None), (3, "m", "broken", None)], "n int, model string, prompt string, image binary")
    requests = requests.withColumn("digest", calls.request_digest(F.col("model"), F.sha2("prompt", 256), F.lit(""), F.lit(0.0), F.lit(0)))
    replies = calls.call(requests, calls.scripted({"read": json.dumps({"characteristics": [{"kind": "note", "bbox": [0, 0, 3, 3], "raw_text": "x"}]})})).cache()
    assert [r.error is None for r in replies.orderBy("n").collect()] == [True, True, False]
    calls.save_responses(replies, str(tmp_path / "cache"))
    hits, misses = calls.split_cached(requests, spark.read.parquet(str(tmp_path / "cache")))
    assert hits.count() == 2 and [r.n for r in misses.collect()] == [3]
    items = calls.reply_items(replies.select(F.col("n").alias("drawing_id"), F.lit("mm").alias("units"), "response")).collect()
    assert {(r.drawing_id, r.reason) for r in items} == {(1, None), (2, None), (3, "no JSON object")} and {r.view for r in items if r.reason is None} == {"unknown"}


def test_reports(spark, tmp_path):
    text = reports.write_report(evaluation.scores(spark, "/root/testdata/sf0.001"), str(tmp_path / "r"), title="Run")
    assert "| Recall |" in text and "profile_5" in text
    assert spark.read.json(str(tmp_path / "r/by_profile")).count() == 6
    verdicts = spark.createDataFrame([(1, 1, "verified", "size_exists", 1.0)], "drawing_id long, id int, verdict string, check string, confidence double")
    reports.write_verification(verdicts, verdicts.select("drawing_id", "id", F.lit("t").alias("type")), str(tmp_path / "v"))
    assert spark.read.json(str(tmp_path / "v")).first().summary.verified == 1
    reports.write_manifest(spark, str(tmp_path / "m"), drawings=3)
    assert json.loads(spark.read.text(str(tmp_path / "m")).first().value) == {"drawings": 3}


def test_streams(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    pred = evaluation.valid(spark, folder).where("drawing_id < 200")
    pred.write.parquet(str(tmp_path / "in"))
    truth = evaluation.truth(spark, folder)
    stream = spark.readStream.schema(pred.schema).parquet(str(tmp_path / "in"))
    q = runs.score_batches(stream, truth, str(tmp_path / "out"), str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    sums = runs.totals(spark, str(tmp_path / "out")).first()
    assert sums.n_pred == pred.count() and 0 < sums.tp <= sums.n_pred
    put(tmp_path / "ev/a.json", "\n".join(json.dumps({"ts": f"2024-01-01T00:0{m}:00Z", "profile": "p", "outcome": o}) for m, o in ((1, "tp"), (2, "fp"), (7, "tp"))))
    events = spark.readStream.schema("ts timestamp, profile string, outcome string").json(str(tmp_path / "ev"))
    q = runs.counts_by_window(events).writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.tp, r.fp) for r in spark.sql("SELECT tp, fp FROM windows ORDER BY window").collect()] == [(1, 1), (1, 0)]


@pytest.mark.parametrize(("nominal", "fit", "upper", "lower"), [(44, "H7", 0.025, 0), (44, "g6", -0.009, -0.025), (44, "P7", -0.017, -0.042), (10, "js7", 0.0075, -0.0075), (2, "K7", 0, -0.01), (44, "ZZ7", None, None), (600, "H7", None, None)])
def test_fits(spark, nominal, fit, upper, lower):
    r = spark.range(1).select(tables.fit_limits(F.lit(float(nominal)), F.lit(fit)).alias("l")).first().l
    assert (r.upper, r.lower) == (pytest.approx(upper, abs=1e-9) if upper is not None else None, pytest.approx(lower, abs=1e-9) if lower is not None else None)


def test_preferred_numbers():
    assert tables.renard(10, 10, 100) == [10.0, 12.5, 16.0, 20.0, 25.0, 31.5, 40.0, 50.0, 63.0, 80.0, 100.0]
    with pytest.raises(ValueError):
        tables.renard(7, 1, 10)


def test_warps_return(spark):
    h = warps.corners([(0, 0), (100, 0), (100, 80), (0, 80)], [(2, 1), (97, 3), (101, 82), (-1, 78)])
    row = spark.createDataFrame([(30.0, 40.0)], "x double, y double")
    u, v = h(F.col("x"), F.col("y"))
    x, y = h.inverse()(F.col("u"), F.col("v"))
    r = row.select(u.alias("u"), v.alias("v")).select(x.alias("x"), y.alias("y")).first()
    assert (r.x, r.y) == (pytest.approx(30), pytest.approx(40))


@pytest.mark.parametrize("profile", list(pixels.PROFILES))
def test_degraded_sheets(spark, profile):
    rng = np.random.default_rng(1)
    sheet = np.full((120, 160, 3), 255, np.uint8)
    boxes = np.array([[20 + 30 * k, 30 + 10 * k, 45 + 30 * k, 42 + 10 * k] for k in range(4)], float)
    for x0, y0, x1, y1 in boxes.astype(int):
        sheet[y0 + 3 : y1 - 3, x0 + 3 : x1 - 3] = rng.integers(0, 60)
    a, b = pixels.degrade(sheet, boxes, profile, 5), pixels.degrade(sheet, boxes, profile, 5)
    assert np.array_equal(a.pixels, b.pixels) and a.applied == b.applied and a.alive.mean() >= 0.7
    if profile == "clean":
        assert np.array_equal(a.pixels, sheet) and np.array_equal(a.boxes, boxes)
    assert all(pixels.has_ink(a.pixels, box, 200) for box in a.boxes[a.alive])
    df = spark.createDataFrame([(1, profile, 5, 120, 160, sheet.tobytes(), boxes.tolist())], "drawing_id long, profile string, seed long, height int, width int, pixels binary, boxes array<array<double>>")
    out = pixels.degrade_images(df).first()
    assert out.applied == a.applied and len(out.pixels) == sheet.size


def test_frames_that_suffice(spark):
    cases = [("position", ["planar_face", "planar_face", "planar_face"], True), ("position", ["planar_face"], False), ("position", ["axis", "planar_face"], True), ("total_runout", ["planar_face"], False), ("total_runout", ["axis"], True), ("perpendicularity", ["planar_face"], True), ("flatness", [], True)]
    df = spark.createDataFrame(cases, "s string, t array<string>, want boolean")
    assert all(r.got == r.want for r in df.select(verification.sufficient(F.col("s"), F.col("t")).alias("got"), "want").collect())
