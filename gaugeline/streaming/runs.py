"""Scoring as predictions arrive: counts per profile and window, first responses, and running totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.operators import matching, scoring

KEY = "drawing_id"


def counts_by_window(events: DataFrame, *, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Counts of found, missed and invented callouts by profile and window of event time.

    ``events`` is a stream of (ts, profile, outcome: tp, fp or fn). State is one
    row a profile and open window, dropped behind the watermark.
    """
    out = events.withWatermark("ts", late).groupBy(F.window("ts", window), "profile")
    return out.agg(*(F.count_if(F.col("outcome") == o).alias(o) for o in ("tp", "fp", "fn")))


def first_responses(calls: DataFrame, *, late: str = "1 hour") -> DataFrame:
    """Each request digest once, as long as its repeats come within the watermark."""
    return calls.withWatermark("ts", late).dropDuplicatesWithinWatermark(["digest"])


def score_batches(predictions: DataFrame, truth: DataFrame, path: str, checkpoint: str):
    """A query that matches each micro-batch of predictions to the ground truth and appends per-drawing counts.

    Drawings have to arrive whole. A batch that is run again replaces its own
    folder, so restarts do not count twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        known = truth.join(batch.select(KEY).distinct(), KEY, "left_semi")
        matched = matching.match(known, batch)
        none = batch.limit(0).select(KEY, "id")
        scoring.detection(known, batch, none, matched).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return predictions.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def totals(spark, path: str) -> DataFrame:
    """What all batches so far add up to."""
    return spark.read.parquet(path).agg(*(F.sum(c).alias(c) for c in ("n_gt", "n_pred", "tp", "fp", "fn")))
