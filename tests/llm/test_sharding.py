import zlib

import pytest
from pyspark.sql import functions as F

from gaugeline.llm import sharding


def test_growth_moves_rows_only_into_the_new_shard(spark):
    df = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("clash").alias("shard"))
    out = sharding.shard_records(df).collect()
    counts, moved = [0] * 24, 0
    for r in out:
        counts[r.shard] += 1
        assert r.grown_shard in (r.shard, 24)
        moved += r.grown_shard == 24
    assert len(out) == 20000 and max(counts) < 1.2 * 20000 / 24 and min(counts) > 0.8 * 20000 / 24
    assert 0.8 * 20000 / 25 < moved < 1.2 * 20000 / 25
    for s in range(24):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(counts[s]))


def test_weights(spark):
    df = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    counts = {r.shard: r["count"] for r in sharding.shard_records(df, weights=[1, 2, 5]).groupBy("shard").count().collect()}
    for s, w in enumerate([1, 2, 5]):
        assert counts[s] == pytest.approx(20000 * w / 8, rel=0.1)
    with pytest.raises(ValueError):
        sharding.rendezvous(F.col("doc_id"), [1, 0])


def test_odd_rows(spark, docs, odd):
    df = docs([*odd, (None, "n"), (None, "n"), (7, "again"), (7, "again")])
    out = sharding.shard_records(df).collect()
    assert len(out) == len(odd) + 4 and {r.law for r in out} == {"key"}
    for r in out:
        if r.doc_id is not None and r.doc_id != 7:
            t = (odd[r.doc_id] or "").encode()
            assert r.size == len(t) + 8 and r.text_crc32 == zlib.crc32(t)
    slots = {}
    for r in out:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert len({r.shard for r in out if r.doc_id is None}) == 1
    assert sharding.shard_records(df.limit(0)).count() == 0
