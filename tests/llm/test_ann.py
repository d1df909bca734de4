import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeline.llm import ann


def plain(ids, x, every=50, near=5):
    out = {}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for i, q in enumerate(ids):
        if q % every == 0:
            s = (unit * unit[i]).sum(axis=1)
            order = sorted((k for k in range(len(ids)) if k != i), key=lambda k: (-s[k], ids[k]))[:near]
            out[q] = [(ids[k], s[k]) for k in order]
    return out


def recall(got, want):
    return np.mean([len({v for v, _ in want[q]} & set(got.get(q, []))) / len(want[q]) for q in want])


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
def test_recall(spark, folder):
    df = spark.read.parquet(f"/root/testdata/{folder}/embeddings.parquet")
    rows = df.collect()
    ids, x = [r.vec_id for r in rows], np.array([r.embedding for r in rows], np.float64)
    want, got, scores = plain(ids, x), {}, {}
    for r in ann.search(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
        scores[r.query_id, r.vec_id] = r.score
    assert all(len(v) == 5 for v in got.values()) and recall(got, want) >= 0.95
    for q, found in want.items():
        for v, s in found:
            if (q, v) in scores:
                assert scores[q, v] == pytest.approx(s, abs=1e-12)


def test_anisotropic_codes_lose_less_along_the_vector():
    rng = np.random.default_rng(0)
    x = ann._unit(rng.normal(size=(2000, 32)))
    index = ann.fit(x)
    left, own = index.split(x - index.centres[index.order(x)[:, 0]]), index.split(x)

    def parallel(eta):
        codes = ann.assign(left, own, index.books, eta)
        error = left - index.books[np.arange(len(index.books))[None], codes]
        return np.abs((error * own).sum(axis=(1, 2))).mean(), (error**2).sum(axis=(1, 2)).mean()

    assert index.eta > 1 and parallel(index.eta)[0] < parallel(1.0)[0] and parallel(index.eta)[1] >= parallel(1.0)[1]


def test_ties_go_to_smaller_ids(spark):
    rng = np.random.default_rng(1)
    common = rng.normal(size=16).tolist()
    rows = [(i, common if i % 3 else rng.normal(size=16).tolist()) for i in range(1, 6001)]
    out = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    by = {}
    for r in sorted(out, key=lambda r: (r.query_id, r["rank"])):
        by.setdefault(r.query_id, []).append(r.vec_id)
    assert all(v == ([x for x in (1, 2, 4, 5, 7, 8) if x != q][:5]) for q, v in by.items() if q % 3)


def test_odd_rows(spark):
    good = [[1.0, 0.0, 0.5], [0.9, 0.1, 0.4], [-1.0, 0.2, 0.0], [1e200, 0.0, 5e199], [1e-200, 0.0, 5e-201]]
    bad = [None, [], [0.0, 0.0, 0.0], [1.0, None, 2.0], [float("nan"), 1.0, 1.0], [float("inf"), 1.0, 1.0], [1.0, 2.0]]
    rows = [(i, v) for i, v in enumerate(good)] + [(100 + i, v) for i, v in enumerate(bad)] + [(None, good[0]), (0, good[0]), (50, good[1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("clash"))
    out = ann.search(df).orderBy("query_id", "rank").collect()
    # two rows have the key 0 and the same vector: each is nearest to the other and to the scaled ones
    assert sorted((r["rank"], r.vec_id) for r in out if r.query_id == 0) == sorted([(1, 0), (2, 3), (3, 4), (4, 1), (5, 50)] * 2)
    assert {r.query_id for r in out} == {0, 50}
    assert not {100 + i for i in range(len(bad))} & {r.vec_id for r in out}
    assert ann.search(df.limit(0)).count() == 0
    assert ann.search(df.where("vec_id = 50")).count() == 0


def test_lengths_are_searched_each_on_its_own(spark):
    rows = [(i, [1.0 + i, 2.0, 3.0][: 2 + i % 2]) for i in range(100)]
    out = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.query_id, r["rank"]) for r in out) == [(q, k) for q in (0, 50) for k in range(1, 6)]
    assert all(r.vec_id % 2 == 0 for r in out)
    many = spark.createDataFrame([(i, [1.0] * (1 + i)) for i in range(70)], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="lengths"):
        ann.search(many)


def test_a_crowded_cell_is_dealt_in_parts(spark, monkeypatch):
    monkeypatch.setattr(ann, "PART", 200)
    monkeypatch.setattr(ann, "QUERIES", 5)
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=8) + 0.05 * rng.normal(size=(700, 8)), rng.normal(size=(1300, 8))])
    ids = rng.permutation(2000).tolist()
    got = {}
    for r in ann.search(spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert recall(got, plain(ids, x)) >= 0.95


def test_scan_of_a_tight_cluster_is_exact():
    rng = np.random.default_rng(4)
    tight = rng.normal(size=64) + 0.02 * rng.normal(size=(20000, 64))
    x = ann._unit(np.concatenate([tight, rng.normal(size=(40000, 64))]))
    index = ann.fit(x[rng.choice(len(x), 8000, replace=False)], rounds=3)
    cell, codes = index.encode(x[:20000])
    at = np.flatnonzero(cell == np.bincount(cell).argmax())[: ann.PART]
    assert len(at) > 3000
    rows = ann.Rows(index, cell[at[0]], at, at, x[at], codes[at])
    query, row, _ = ann.scan(index, rows, at[:40], x[at[:40]], 5)
    for k, q in enumerate(at[:40]):
        scores = x[at] @ x[q]
        order = at[np.argsort(-scores)]
        assert set(at[row[query == k]]) == set(order[order != q][:5])
