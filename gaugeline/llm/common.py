"""What several corpus operators share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A word is a run of anything but the ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only where the session names none and runs on one machine (tests) is a
    temporary folder made and set; on a cluster that is an error.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="gaugeline-")
        spark.conf.set("spark.checkpoint.dir", named)
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """The same rows from files in the shared folder, without the lineage before."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, what: str) -> DataFrame:
    """The same rows from a Parquet table in the shared folder."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


#: Bytes of an Arrow batch on its way to a worker; Spark's default is eight times that.
BATCH = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Let the session send texts to workers in batches of ``BATCH`` bytes at most.

    A batch exists several times at once (in the JVM, on the way, in the worker),
    for each task and each Python step of it, beside whatever idle workers keep.
    Plans read the setting when they run, so it stays lowered in the session;
    operators that send texts to workers call this.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(spark.conf.get(name, "64m")).lower()
    size = int(re.match(r"-?\d+", now)[0]) * {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(now.rstrip("b")[-1:], 1)
    if not 0 < size <= BATCH:
        spark.conf.set(name, str(BATCH))


def words(text: Column) -> Column:
    """Number of words; null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def checked_broadcast(df: DataFrame, rows: int = 1 << 18) -> DataFrame:
    """The same rows, written first; broadcast if they are at most so many, else left to a shuffled join."""
    held = cut(df)
    return F.broadcast(held) if held.count() <= rows else held


#: A key is hot with more than this share of all rows: so there are fewer hot keys than its inverse.
SHARES = 1 << 14


def spread_join(many: DataFrame, one: DataFrame, key: str, total: int) -> DataFrame:
    """``many`` joined to the one row a key that ``one`` has, without a task for all rows of a hot key.

    ``one`` has in ``n`` the rows of its key in ``many``, ``total`` in all. Keys of
    more than a ``SHARES``-th of the rows number fewer than ``SHARES``, which
    bounds what is broadcast for them; rows of all other keys are shuffled.
    """
    hot = F.broadcast(one.where(F.col("n") * SHARES > total))
    rest = one.where(F.col("n") * SHARES <= total)
    return many.join(hot, key).unionByName(many.join(hot.select(key), key, "left_anti").join(rest, key)).drop("n")


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, *, rows: int, size: int) -> DataFrame:
    """(doc_id, label, text) for a fit, one row a key, on disk: bounded in rows and in bytes.

    Keys come in the order of a hash, at most ``rows`` of them, and as long as the
    texts before add up to less than ``size`` bytes; texts are whole. Of several
    texts of a key the least counts.
    """
    chosen = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    held = cut(texts.groupBy("doc_id").agg(F.min(label).cast("int").alias(label), F.min(F.coalesce("text", F.lit(""))).alias("text")))
    before = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, -1)  # over at most ``rows`` sizes
    sizes = held.select("doc_id", F.octet_length("text").cast("long").alias("bytes"))
    fits = sizes.withColumn("upto", F.coalesce(F.sum("bytes").over(before), F.lit(0))).where(F.col("upto") < size)
    return held.join(F.broadcast(fits.select("doc_id")), "doc_id")
