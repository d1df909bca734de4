"""Where results go: score tables, reports, verification files and run manifests."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.operators.scoring import run_summary

KEY = "drawing_id"


def percent(value: float | None) -> str:
    return "n/a" if value is None else f"{100 * value:.1f} %"


def markdown(summary: dict, by_profile: list[dict], *, title: str) -> str:
    """A table of the headline figures, every rate with its counts, then a row a profile."""
    lines = [f"# {title}", "", "| Figure | Value | Counts |", "|---|---:|---:|"]
    tp, fp, fn = (summary[k] for k in ("tp", "fp", "fn"))
    lines += [f"| Precision | {percent(summary['precision'])} | {tp} / {tp + fp} |", f"| Recall | {percent(summary['recall'])} | {tp} / {tp + fn} |", f"| F1 | {percent(summary['f1'])} | |", f"| Exact drawings | {percent(summary['exact_rate'])} | {summary['exact_drawings']} / {summary['n_drawings']} |", f"| Graph distance | {summary['mean_graph_distance']:.3f} | |", f"| Error cost | {summary['cost']:.1f} | |"]
    if len(by_profile) > 1:
        lines += ["", "| Profile | Drawings | Precision | Recall | F1 |", "|---|---:|---:|---:|---:|"]
        lines += [f"| {r['profile']} | {r['n_drawings']} | {percent(r['precision'])} | {percent(r['recall'])} | {percent(r['f1'])} |" for r in sorted(by_profile, key=lambda r: r["profile"])]
    return "\n".join(lines) + "\n"


def write_report(scores: DataFrame, path: str, *, title: str = "Report") -> str:
    """Scores, summary and slices as tables under a folder, and the report as text beside them.

    Only the summary and its slices, a row a profile, come to the driver.
    """
    spark = scores.sparkSession
    scores.write.mode("overwrite").parquet(f"{path}/scores")
    scores = spark.read.parquet(f"{path}/scores")
    whole, slices = run_summary(scores), run_summary(scores, "profile")
    whole.write.mode("overwrite").json(f"{path}/summary")
    slices.write.mode("overwrite").json(f"{path}/by_profile")
    text = markdown(whole.first().asDict(), [r.asDict() for r in slices.collect()], title=title)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/report_md")
    return text


def write_verification(verdicts: DataFrame, defects: DataFrame, path: str) -> None:
    """One JSON object a drawing: its verdicts with their summary, and its defects."""
    per = verdicts.groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct("id", "verdict", "check", "confidence"))).alias("per_characteristic"), *(F.count_if(F.col("verdict") == v).alias(v) for v in ("verified", "contradicted", "unverifiable")))
    found = defects.groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct("id", "type"))).alias("drawing_defects"))
    none = F.array().cast("array<struct<id:int,type:string>>")
    per.join(found, KEY, "left").select(KEY, F.struct("verified", "contradicted", "unverifiable").alias("summary"), "per_characteristic", F.coalesce("drawing_defects", none).alias("drawing_defects")).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_predictions(items: DataFrame, path: str) -> None:
    """Valid items as one JSON object a drawing."""
    valid = items.where(F.col("reason").isNull())
    fields = [c for c in valid.columns if c not in (KEY, "units", "idx", "raw", "reason")]
    valid.groupBy(KEY, "units").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", F.struct(*fields).alias("c")))), lambda x: x["c"]).alias("characteristics")).write.mode("overwrite").json(path)


def write_manifest(spark, path: str, **facts) -> None:
    """The facts of a run as one JSON object."""
    spark.createDataFrame([(json.dumps(facts, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)
