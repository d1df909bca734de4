"""Quality by ordinal regression with cumulative links on graded ratings.

One weight vector over hashed text features gives each document a position; the
probability of a grade above k is logistic in the position less an ordered
threshold. From these follow the expected grade and the probability of reaching
a grade, by which documents are selected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.common import labelled_texts, small_batches

#: Hash space of features; documents, and bytes of their texts, that the fit takes at most; words that a worker keeps.
SPACE = 1 << 18
SAMPLE, SAMPLE_BYTES = 6000, 32 << 20
KEPT_WORDS, KEPT_CHARS = 60_000, 48

_UPPER, _LOWER, _DIGIT = (re.compile(p) for p in (r"[A-ZÀ-ÖØ-Þ]+", r"[^\W\d_A-ZÀ-ÖØ-Þ]+", r"\d+"))


def shape(word: str) -> str:
    """Runs of capitals, small letters and digits as one sign each; the rest stays, runs of a sign as one."""
    runs = _DIGIT.sub("9", _LOWER.sub("a", _UPPER.sub("A", word)))
    return re.sub(r"(.)\1+", r"\1", runs)


class Words(dict):
    """Two feature numbers for each word: its own and its shape's, packed in one int."""

    def __missing__(self, word: str) -> int:
        own = xxhash.xxh32_intdigest(word.lower(), 1) % SPACE
        made = own << 32 | xxhash.xxh32_intdigest(shape(word), 2)
        if len(word) <= KEPT_CHARS and len(self) < KEPT_WORDS:
            self[word] = made
        return made


_words = Words()


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted feature numbers and values of a whole text.

    Features are words, word shapes, pairs of shapes, repeats of the word before
    and repeated lines; a value is the root of its share.
    """
    found = (text or "").split()
    n = len(found)
    if not n:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    packed = np.fromiter(map(_words.__getitem__, found), np.int64, n)
    shapes = (packed & 0xFFFFFFFF).astype(np.uint64)
    pairs = (shapes[:-1] * np.uint64(0x9E3779B1) + shapes[1:] * np.uint64(0x85EBCA6B) + np.uint64(7)) >> np.uint64(13)
    same = int((packed[1:] == packed[:-1]).sum())
    lines = [x for x in text.split("\n") if x]
    extra = {SPACE: same / n, SPACE + 1: 1 - len(set(lines)) / max(1, len(lines)), SPACE + 2: 1 / (1 + n)}
    ids = np.concatenate([packed >> 32, (shapes % np.uint64(SPACE)).astype(np.int64), (pairs % np.uint64(SPACE)).astype(np.int64)])
    ids, counts = np.unique(ids, return_counts=True)
    more = [(i, v) for i, v in extra.items() if v]
    return np.r_[ids, [i for i, _ in more]].astype(np.int32), np.sqrt(np.r_[counts / n, [v for _, v in more]]).astype(np.float32)


@dataclass
class Model:
    """Weights by feature number and ordered thresholds, one less than there are grades."""

    weights: np.ndarray
    thresholds: np.ndarray

    def position(self, ids: np.ndarray, values: np.ndarray) -> float:
        return float(self.weights[ids] @ values)

    def above(self, positions: np.ndarray) -> np.ndarray:
        """Probabilities of a grade above each threshold, a row a position."""
        return 1 / (1 + np.exp(self.thresholds[None, :] - positions[:, None]))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, count: int, *, rounds: int = 150, rate: float = 0.1, shrink: float = 1e-4) -> Model:
    """Cumulative-link weights and thresholds by full gradients with Adam.

    With no rows or one grade only, weights are zero and every threshold says
    what was seen, or, of nothing, that every grade is reached.
    """
    size = SPACE + 3
    if not len(rows) or len(np.unique(grades)) < 2:
        seen = grades[0] if len(grades) else count - 1
        return Model(np.zeros(size, np.float32), np.where(np.arange(count - 1) < seen, -5.0, 5.0))
    at = np.repeat(np.arange(len(rows)), [len(i) for i, _ in rows])
    ids = np.concatenate([i for i, _ in rows])
    used, ids = np.unique(ids, return_inverse=True)
    values = np.concatenate([v for _, v in rows]).astype(np.float64)
    share = np.clip((grades[:, None] > np.arange(count - 1)[None, :]).mean(axis=0), 1e-3, 1 - 1e-3)
    w, base, gaps = np.zeros(len(used)), -np.log(share[0] / (1 - share[0])), np.log(np.maximum(0.1, -np.diff(np.log(share / (1 - share)))))
    state = [np.zeros(len(used) + count - 1) for _ in range(2)]
    for step in range(1, rounds + 1):
        cuts = base + np.r_[0, np.cumsum(np.exp(gaps))]
        position = np.bincount(at, values * w[ids], minlength=len(rows))
        edges = np.r_[-np.inf, cuts, np.inf]
        lower, upper = (1 / (1 + np.exp(np.clip(edges[grades + k] - position, -700, 700))) for k in (0, 1))  # P(grade or more), P(more)
        mass = np.maximum(lower - upper, 1e-9)
        d_lower, d_upper = lower * (1 - lower) / mass, upper * (1 - upper) / mass
        slope = -(d_lower - d_upper) / len(rows)
        cut_slope = np.zeros(count + 1)
        np.add.at(cut_slope, grades, d_lower / len(rows))
        np.add.at(cut_slope, grades + 1, -d_upper / len(rows))
        cut_slope = cut_slope[1:count]
        grad = np.r_[np.bincount(ids, values * slope[at], minlength=len(used)) + shrink * w, cut_slope.sum(), [cut_slope[k + 1 :].sum() * np.exp(gaps[k]) for k in range(count - 2)]]
        state[0] = 0.9 * state[0] + 0.1 * grad
        state[1] = 0.999 * state[1] + 0.001 * grad * grad
        move = rate * state[0] / (1 - 0.9**step) / (np.sqrt(state[1] / (1 - 0.999**step)) + 1e-8)
        w, base, gaps = w - move[: len(used)], base - move[len(used)], gaps - move[len(used) + 1 :]
    weights = np.zeros(size, np.float32)
    weights[used] = w
    return Model(weights, base + np.r_[0, np.cumsum(np.exp(gaps))])


def _emit_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [features(t) for t in batch.column(1).to_pylist()]
        yield pa.record_batch([batch.column(0), pa.array([i.tobytes() for i, _ in made], pa.binary()), pa.array([v.tobytes() for _, v in made], pa.binary())], names=["grade", "ids", "values"])


def train(docs: DataFrame, ratings: DataFrame, *, count: int, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` rated documents, the first by a hash of the key, of ``SAMPLE_BYTES`` in all.

    ``ratings`` has doc_id and grade (0 to count - 1); null keys and grades are
    dropped, and of several grades or texts of a key the least counts. Texts are
    read whole; features are made by the workers.
    """
    small_batches(docs.sparkSession)
    rated = ratings.select("doc_id", F.col("grade").cast("int").alias("grade")).dropna().where(F.col("grade").between(0, count - 1)).groupBy("doc_id").agg(F.min("grade").alias("grade"))
    texts = labelled_texts(docs, rated, "grade", rows=sample, size=SAMPLE_BYTES).select("grade", "text")
    rows = texts.mapInArrow(_emit_features, "grade int, ids binary, values binary").collect()
    rows.sort(key=lambda r: (r.grade, bytes(r.ids)))
    return fit([(np.frombuffer(r.ids, np.int32), np.frombuffer(r["values"], np.float32)) for r in rows], np.array([r.grade for r in rows], np.int64), count)


def scores(df: DataFrame, model: Model, *, at_least: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's key, expected grade and probability of a grade of ``at_least`` or more.

    Null and empty texts have no features and get the thresholds' own
    probabilities. Rows are handled one by one.
    """
    small_batches(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            above = m.above(np.array([m.position(*features(t)) for t in batch.column(1).to_pylist()], np.float64))
            yield pa.record_batch([batch.column(0), pa.array(above.sum(axis=1)), pa.array(above[:, at_least - 1])], names=["doc_id", "expected_grade", "tail_probability"])

    rows = df.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, expected_grade double, tail_probability double")


def keep(df: DataFrame, model: Model, *, at_least: int = 1, probability: float = 0.5, text: str = "text") -> DataFrame:
    """The rows, whole, whose text reaches the grade with at least that probability."""
    small_batches(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def reaches(texts: pd.Series) -> pd.Series:
        m = sent.value
        return pd.Series(m.above(np.array([m.position(*features(t)) for t in texts], np.float64))[:, at_least - 1] >= probability, dtype=bool)

    return df.where(reaches(F.col(text)))


def graded(labels: DataFrame) -> DataFrame:
    """Ratings from the two label columns: 0 poor, 1 sound but toxic, 2 sound."""
    grade: Column = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("toxic") == 0, 2)
    return labels.select("doc_id", grade.alias("grade"))
