import pytest
from pyspark.sql import functions as F

from gaugeline.llm import mixing


def plain_targets(sizes, most=3):
    """Targets by resharing the excess again and again."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (i % 3) + 1 for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            return share | {s: float(most * sizes[s]) for s in capped}
        capped |= over


@pytest.mark.parametrize("sizes", [{"a": 10}, {"a": 1, "b": 1000, "c": 5, None: 70}, {"a": 0, "b": 9}, {"é": 3, "z": 40, "Z": 1, "": 7, None: 2, "b": 900}, {"a": 0, None: 0}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    want = plain_targets(sizes)
    assert got.keys() == want.keys()
    for s, t in want.items():
        assert got[s] == pytest.approx(t, rel=1e-9, abs=1e-9)


def test_mix_comes_near_targets_and_reruns_agree(spark):
    rows = spark.range(6000).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', cast(1 + id % 97 as int))").alias("text"), F.expr("case when id % 3 = 0 then 'hot' when id % 50 = 1 then null else concat('s', id % 5) end").alias("source")).withColumn("size", F.lit("clash"))
    a, b = (mixing.mix(rows.repartition(n)).collect() for n in (3, 7))
    assert sorted(map(repr, a)) == sorted(map(repr, b)) and len(a) == 6000
    taken, target = {}, {}
    for r in a:
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
    for s, t in target.items():
        assert abs(taken[s] - t) <= 0.02 * t + 300


def test_odd_rows(spark, docs, odd):
    out = mixing.mix(docs([*odd, (None, "x y", None), (None, "x y", None), (5, "same", "b"), (5, "same", "b")])).collect()
    assert len(out) == len(odd) + 4
    assert all(r.size == 0 and r.taken == 0 for r in out if r.doc_id in (0, 1, 2))
    assert mixing.mix(docs([]).limit(0)).count() == 0


def test_keys_that_are_no_numbers_and_clashing_columns(spark):
    rows = [(f"key-{i}" if i % 7 else None, "w " * (i % 5), f"s{i % 2}", i) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id string, text string, source string, __size long").withColumn("home", F.lit(1)).withColumn("row", F.lit(2)).withColumn("copies", F.lit(3))
    out = mixing.mix(df).collect()
    assert len(out) == 60
    whole = mixing.mixed_rows(df)
    assert whole.columns == df.columns and whole.count() == sum(r.copies for r in out)
