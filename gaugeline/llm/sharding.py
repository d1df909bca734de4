"""Weighted rendezvous sharding of records, in DataFrame operations only.

Every (record key, shard) pair gets a hash in (0, 1) and the record goes to the
shard with the least ``-ln(hash) / weight``. The scores of the other shards do
not change when one is added, so a larger shard count moves records only into
the new shard, and each shard gets records in proportion to its weight.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Slots are numbered within (shard, chunk) and moved up by the chunks before,
#: so that no task sorts a whole shard.
CHUNKS = 256

_SCALE = float(1 << 52)


def _score(key: Column, shard: int, weight: float) -> Column:
    """An exponential draw at rate ``weight`` that depends on key and shard alone."""
    drawn = F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 12).cast("double")
    return -F.log((drawn + 0.5) / F.lit(_SCALE)) / F.lit(float(weight))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a key among ``len(weights)`` shards; ties go to the smaller shard.

    A null key is hashed like any other value. Weights must be positive.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a positive weight")
    return F.array_min(F.array(*(F.struct(_score(key, s, w).alias("score"), F.lit(s).alias("shard")) for s, w in enumerate(weights))))["shard"]


def shard_records(df: DataFrame, *, key: str = "doc_id", text: str = "text", weights: Sequence[float] = (1.0,) * 24, grown: Sequence[float] | None = None, chunks: int = CHUNKS) -> DataFrame:
    """Every row with its shard, its slot in the shard, and its shard after growth.

    ``grown`` are the weights of the larger fleet (default: one more shard like
    the last). Null text counts as empty. Rows that agree in key, size and text
    CRC are interchangeable: they are counted before the shuffle and get
    consecutive slots. Other columns are ignored, an empty table gives no rows.
    """
    weights, grown = list(weights), list(grown or [*weights, weights[-1]])
    whole = F.coalesce(F.col(text), F.lit("")).cast("string")
    rows = (
        df.select(F.col(key).alias("doc_id"), (F.octet_length(whole) + 8).cast("long").alias("size"), F.crc32(F.encode(whole, "UTF-8")).cast("long").alias("text_crc32"))
        .groupBy("doc_id", "size", "text_crc32")
        .agg(F.count(F.lit(1)).alias("copies"))
        .withColumn("shard", rendezvous(F.col("doc_id"), weights))
        .withColumn("grown_shard", rendezvous(F.col("doc_id"), grown))
        .withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text_crc32", F.lit("chunk")), F.lit(chunks)))
    )
    before = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("shard", "chunk").agg(F.sum("copies").alias("held")).select("shard", "chunk", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("shard", "chunk").orderBy("doc_id", "size", "text_crc32")
    return (
        rows.withColumn("upto", F.sum("copies").over(within.rowsBetween(Window.unboundedPreceding, -1)))
        .join(offsets, ["shard", "chunk"])
        .withColumn("first", F.col("base") + F.coalesce("upto", F.lit(0)))
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("copies") - 1)).alias("slot"), "grown_shard")
    )
