import numpy as np
from pyspark.sql import functions as F

from gaugeline.llm import quality


def test_thresholds_are_ordered_and_grades_are_learned():
    rng = np.random.default_rng(4)
    grades = rng.integers(0, 4, 800)
    words = [[f"{'bad' if rng.random() < (0.8, 0.5, 0.2, 0.05)[g] else 'good'}{rng.integers(3)}" for _ in range(60)] for g in grades]
    rows = [quality.features(" ".join(w)) for w in words]
    model = quality.fit(rows[:600], grades[:600], 4)
    assert (np.diff(model.thresholds) > 0).all()
    above = model.above(np.array([model.position(*r) for r in rows[600:]]))
    assert (np.diff(above, axis=1) <= 0).all()
    assert np.corrcoef(above.sum(axis=1), grades[600:])[0, 1] > 0.85


def test_gradient_of_the_likelihood():
    """The fit's likelihood is no worse than nearby weights' give."""
    rng = np.random.default_rng(1)
    grades = rng.integers(0, 3, 300)
    rows = [quality.features(" ".join(rng.choice(["aa", "bb", "cc"], 20, p=((0.6, 0.3, 0.1), (0.4, 0.3, 0.3), (0.1, 0.2, 0.7))[g]))) for g in grades]
    model = quality.fit(rows, grades, 3, rounds=1500, rate=0.05)

    def loss(m):
        p = np.c_[np.ones(len(rows)), m.above(np.array([m.position(*r) for r in rows])), np.zeros(len(rows))]
        return -np.log(p[np.arange(len(rows)), grades] - p[np.arange(len(rows)), grades + 1]).mean() + 5e-5 * (m.weights**2).sum()

    best = loss(model)
    used = np.unique(np.concatenate([r[0] for r in rows]))
    for _ in range(40):
        w = model.weights.copy()
        w[used] += rng.normal(0, 0.3, len(used)).astype(np.float32)
        assert loss(quality.Model(w, model.thresholds)) > best - 1e-4
        assert loss(quality.Model(model.weights, model.thresholds + rng.normal(0, 0.2, 2))) > best - 1e-4


def test_held_out_accuracy_and_selection(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    taught = F.pmod(F.xxhash64("doc_id"), F.lit(4)) != 0
    model = quality.train(docs, quality.graded(labels.where(taught)), count=3)
    out = quality.scores(docs, model).join(labels.where(~taught), "doc_id").collect()
    right = [(r.tail_probability >= 0.5) == (r.quality == 1) for r in out]
    assert len(out) > 60 and np.mean(right) > 0.95
    kept = {r.doc_id for r in quality.keep(docs, model).select("doc_id").collect()}
    assert kept == {r.doc_id for r in quality.scores(docs, model).collect() if r.tail_probability >= 0.5}


def test_odd_rows(spark, docs, odd):
    df = docs([*odd, (3, "a"), (None, "b")]).withColumn("grade", F.lit("clash"))
    ratings = spark.createDataFrame([(0, 1), (5, 0), (5, 2), (7, 2), (None, 1), (9, None), (8, 9), (999, 1)], "doc_id long, grade int")
    model = quality.train(df, ratings, count=3)
    out = quality.scores(df, model).collect()
    assert len(out) == len(odd) + 2 and all(0 <= r.tail_probability <= 1 and 0 <= r.expected_grade <= 2 for r in out)
    assert len({r.tail_probability for r in out if r.doc_id in (0, 1, 2)}) == 1
    nothing = quality.train(df.limit(0), ratings.limit(0), count=3)
    assert quality.keep(df, nothing).count() == len(odd) + 2
    assert quality.scores(df.limit(0), nothing).count() == 0
