"""Queries over listings, requests and replies."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeline.plans.registry import register
from gaugeline.sources import calls, files
from gaugeline.sources.fixtures import duck, view

KEY = "drawing_id"

#: Files as a run would leave them, from the drawings' ids.
LISTING = """
SELECT concat('/run/', CAST(drawing_id % 10 AS VARCHAR(9)), '/d', CAST(drawing_id AS VARCHAR(12)), '.json') AS path FROM drawing WHERE drawing_id % 9 > 0
UNION ALL SELECT concat('/run/', CAST(drawing_id % 10 AS VARCHAR(9)), '/d', CAST(drawing_id AS VARCHAR(12)), '_150dpi.png') FROM drawing WHERE drawing_id % 4 > 0
UNION ALL SELECT concat('/run/', CAST(drawing_id % 10 AS VARCHAR(9)), '/d', CAST(drawing_id AS VARCHAR(12)), '_150dpi_overlay.png') FROM drawing
UNION ALL SELECT concat('/run/', CAST(drawing_id % 10 AS VARCHAR(9)), '/d', CAST(drawing_id AS VARCHAR(12)), '_150dpi_fax.png') FROM drawing WHERE drawing_id % 5 = 0
UNION ALL SELECT concat('/run/', CAST(drawing_id % 10 AS VARCHAR(9)), '/p', CAST(drawing_id AS VARCHAR(12)), '.step') FROM drawing WHERE drawing_id % 10 < 5 AND drawing_id % 3 = 0"""


def listing(spark, sf_dir):
    view(spark, sf_dir, "drawing").createOrReplaceTempView("__drawing_listing")
    return spark.sql(LISTING.replace("FROM drawing", "FROM __drawing_listing"))


@register(
    "image_for_truth",
    duck(f"""WITH l AS ({LISTING}), i AS (SELECT concat(regexp_extract(path, '^(/run/\\d/d\\d+)_', 1), '.json') AS truth, min(path) AS image FROM l WHERE path LIKE '%.png' AND path NOT LIKE '%_overlay.png' GROUP BY 1)
SELECT j.path, i.image FROM l j LEFT JOIN i ON j.path = i.truth WHERE j.path LIKE '%.json'"""),
)
def image_for_truth(spark, sf_dir):
    every = listing(spark, sf_dir)
    return files.image_of(every.where("path LIKE '%.json'"), every)


@register("truth_for_image", duck(f"WITH l AS ({LISTING}) SELECT p.path, j.path AS truth FROM l p LEFT JOIN l j ON j.path LIKE '%.json' AND j.path = concat(regexp_extract(p.path, '^(/run/\\d/d\\d+)_', 1), '.json') WHERE p.path LIKE '%.png'"))
def truth_for_image(spark, sf_dir):
    every = listing(spark, sf_dir)
    return files.truth_of(every.where("path LIKE '%.png'"), every)


PART = "CASE drawing_id % 4 WHEN 0 THEN concat('/run/', CAST(drawing_id % 10 AS VARCHAR(9)), '/p', CAST(drawing_id AS VARCHAR(12)), '.step') WHEN 1 THEN concat('/elsewhere/p', CAST(drawing_id AS VARCHAR(12)), '.step') END"


@register(
    "solid_for_drawing",
    duck(f"""WITH l AS ({LISTING}), s AS (SELECT path FROM l WHERE path LIKE '%.step'), d AS (SELECT drawing_id, concat('/run/', drawing_id % 10, '/') AS folder, {PART} AS part_ref FROM drawing), f AS (SELECT regexp_extract(path, '^/run/\\d/') AS folder, min(path) AS there FROM s GROUP BY 1)
SELECT d.drawing_id, coalesce(a.path, b.path, f.there) AS solid FROM d LEFT JOIN s a ON d.part_ref = a.path LEFT JOIN s b ON b.path = concat(d.folder, regexp_extract(d.part_ref, '[^/]*$')) LEFT JOIN f ON f.folder = d.folder"""),
)
def solid_for_drawing(spark, sf_dir):
    path = F.concat(F.lit("/run/"), (F.col(KEY) % 10).cast("string"), F.lit("/d"), F.col(KEY).cast("string"), F.lit(".json"))
    drawings = view(spark, sf_dir, "drawing").select(KEY, path.alias("path"), F.expr(PART).alias("part_ref"))
    return files.solid_of(drawings, listing(spark, sf_dir))


@register("unfinished_drawings", duck("SELECT d.drawing_id FROM drawing d ANTI JOIN (SELECT drawing_id FROM pred_char WHERE malformed) p ON d.drawing_id = p.drawing_id"))
def unfinished_drawings(spark, sf_dir):
    return files.unfinished(view(spark, sf_dir, "drawing").select(KEY), view(spark, sf_dir, "pred_char").where("malformed"))


def _requests(spark, sf_dir):
    digest = calls.request_digest(F.col("model"), F.sha2("text", 256), F.lit(""), F.lit(0.5), F.col("sample"))
    return view(spark, sf_dir, "request").withColumn("digest", digest)


@register("request_digests", duck("""SELECT conv_id, turn, sha256(concat('{"extra":{},"image":"","model":"', model, '","prompt":"', sha256(text), '","sample":', sample, ',"temperature":0.5}')) AS digest FROM request"""))
def request_digests(spark, sf_dir):
    return _requests(spark, sf_dir).select("conv_id", "turn", "digest")


SAME = "SELECT DISTINCT model, text, sample FROM request WHERE conv_id % 3 = 0 AND turn % 4 < 2"


@register("cache_stats", duck(f"WITH c AS ({SAME}) SELECT count(c.model) AS hits, count(*) - count(c.model) AS misses FROM request r LEFT JOIN c ON r.model = c.model AND r.text = c.text AND r.sample = c.sample"))
def cache_stats(spark, sf_dir):
    requests = _requests(spark, sf_dir)
    cache = requests.where("conv_id % 3 = 0 AND turn % 4 < 2").select("digest", F.lit("{}").alias("response"))
    return calls.call_stats(requests, cache)


@register("cache_misses", duck(f"WITH c AS ({SAME}) SELECT r.conv_id, r.turn FROM request r ANTI JOIN c ON r.model = c.model AND r.text = c.text AND r.sample = c.sample"))
def cache_misses(spark, sf_dir):
    requests = _requests(spark, sf_dir)
    cache = requests.where("conv_id % 3 = 0 AND turn % 4 < 2").select("digest", F.lit("{}").alias("response"))
    return calls.split_cached(requests, cache)[1].select("conv_id", "turn")


ITEM = """'{"kind": "note", "bbox": [0, 0, 5, 5], "raw_text": "a } brace"}'"""
REPLY = """CASE event_id % 6 WHEN 0 THEN concat('Here you are:\\n```json\\n{"characteristics": [', @, ', {"kind": "note", "colour": 1}]}\\n```\\nDone.') WHEN 1 THEN 'I see { nothing else'
WHEN 2 THEN concat('[', @, ']') WHEN 3 THEN concat('Sure! {"results": [', @, ', 5]} and } that is it') WHEN 4 THEN 'no answer' ELSE '{"characteristics": []}' END""".replace("@", ITEM)


@register(
    "replies_to_items",
    """SELECT event_id AS drawing_id, idx::INT AS idx, CASE WHEN k = 'bad' THEN 'no JSON object' WHEN k = 'key' THEN 'unknown key' END AS reason FROM (
SELECT event_id, unnest(CASE event_id % 6 WHEN 0 THEN ['ok', 'key'] WHEN 1 THEN ['bad'] WHEN 2 THEN ['ok'] WHEN 3 THEN ['ok', 'bad'] WHEN 4 THEN ['bad'] ELSE [] END) AS k, unnest(CASE event_id % 6 WHEN 0 THEN [0, 1] WHEN 3 THEN [0, 1] WHEN 5 THEN [] ELSE [0] END) AS idx FROM events)""",
)
def replies_to_items(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias(KEY), F.lit("mm").alias("units"), F.expr(REPLY).alias("response"))
    return calls.reply_items(rows).select(KEY, "idx", "reason")


KEYWAYS = ((12, 4.0, 2.5), (17, 5.0, 3.0), (22, 6.0, 3.5), (30, 8.0, 4.0), (38, 10.0, 5.0), (44, 12.0, 5.0), (50, 14.0, 5.5))


@register("keyway_lookup", "SELECT p_partkey, min(w)::DOUBLE AS width FROM part LEFT JOIN (VALUES " + ", ".join(f"({a}, {b})" for a, b, _ in KEYWAYS) + ") k(d, w) ON p_size <= d GROUP BY 1")
def keyway_lookup(spark, sf_dir):
    """The first row of a size table that a diameter does not exceed."""
    table = spark.createDataFrame([(float(a), b) for a, b, _ in KEYWAYS], "bound double, width double")
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size")
    return rows.join(F.broadcast(table), F.col("p_size") <= F.col("bound"), "left").groupBy("p_partkey").agg(F.min_by("width", "bound").alias("width"))
