import zlib

import numpy as np
from pyspark.sql import functions as F

from gaugeline.llm import toxicity


def test_gradients_equal_differences(monkeypatch):
    rng = np.random.default_rng(2)
    model = toxicity.untrained(3)
    model.embedding = model.embedding.astype(np.float64)
    model.filters = [f.astype(np.float64) for f in model.filters]
    ids, sizes = rng.integers(0, 50, (17, 3)).astype(np.int32), np.array([5, 0, 9, 1, 2])
    labels = np.array([1, 0, 1, 0, 1.0])

    def loss():
        z, _ = model.forward(ids, sizes)
        return np.mean(np.log1p(np.exp(z)) - labels * z)

    logits, cache = model.forward(ids, sizes)
    slope = (1 / (1 + np.exp(-logits)) - labels) / len(labels)
    dense, used, sparse = toxicity.gradients(model, ids, sizes, slope, cache)
    for part, grad in zip(model.parts()[1:], dense, strict=True):
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in part.shape)
            was, step = part[at], 1e-3
            part[at] = was + step
            up = loss()
            part[at] = was - step
            down = loss()
            part[at] = was
            assert abs((up - down) / (2 * step) - grad[at]) < 2e-3
    for i in rng.integers(0, len(used), 5):
        was = model.embedding[used[i], 0]
        model.embedding[used[i], 0] = was + 1e-3
        up = loss()
        model.embedding[used[i], 0] = was - 1e-3
        down = loss()
        model.embedding[used[i], 0] = was
        assert abs((up - down) / 2e-3 - sparse[i, 0]) < 2e-3


def test_pooling_stays_within_a_text():
    model = toxicity.untrained(1)
    texts = ["one two three", "", None, "four", "five six " * 2000, "one two three"]
    alone = np.concatenate([model.score([t]) for t in texts])
    assert np.allclose(model.score(texts), alone, atol=1e-5) and np.isclose(alone[0], alone[-1])


def test_cut_by_language():
    z = np.r_[np.linspace(-3, 3, 100), np.linspace(0, 6, 100)]
    y = np.r_[np.linspace(-3, 3, 100) > 1, np.linspace(0, 6, 100) > 4].astype(float)
    cut = toxicity.cuts(z, y, np.repeat([0, 1], 100))
    assert abs(cut[0] - 1) < 0.1 and abs(cut[1] - 4) < 0.1


def test_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    out = toxicity.scores(docs.join(labels, "doc_id", "left_semi"), model).join(labels, "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in out)
    hit = [r.predicted == r.toxic for r in out]
    found = [r.predicted for r in out if r.toxic]
    assert len(out) > 600 and np.mean(hit) > 0.97 and np.mean(found) > 0.85


def test_odd_rows(spark, docs, odd):
    df = docs([*odd, (3, "a"), (None, "b")]).withColumn("toxic", F.lit("clash"))
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(13)] + [(None, 1, 1), (2, 1, None)], "doc_id long, quality int, toxic int")
    for model in (toxicity.train(df, labels), toxicity.train(df.limit(0), labels)):
        out = toxicity.scores(df, model).collect()
        assert len(out) == len(odd) + 2 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out is not None for r in out)
        assert len({r.score for r in out if r.doc_id in (0, 1, 2)}) == 1
        assert toxicity.scores(df.limit(0), model).count() == 0
