"""Toxicity by a small convolutional text classifier, trained in numpy.

A word's embedding is the sum of hashed vectors of the word and of its first
letters. Filters of several widths run over the words, each is max-pooled over
the whole text, and a logistic unit reads the pooled values. The threshold is
calibrated by language; the language is guessed from the text's function words,
and a score is shifted so that 0.5 is the threshold of its language.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.common import labelled_texts, small_batches

#: Hash space of words, size of an embedding, widths of filters and filters a width.
SPACE, DIM, WIDTHS, FILTERS = 1 << 16, 8, (1, 2, 3), 8
#: First letters that are hashed beside the word.
PREFIXES = (3, 5)
#: Documents, and bytes of their texts, that the fit takes at most; words that a worker keeps; words scored at once.
SAMPLE, SAMPLE_BYTES, KEPT_WORDS, CHUNK = 6000, 32 << 20, 150_000, 200_000

# Function words by which a language is guessed.
FUNCTION_WORDS = {
    "en": "the of and to that is was for with this from are by be as at it or an on have not which",
    "fr": "le la les des est et une un dans pour que qui sur par avec pas au aux du ce il ne se plus",
    "de": "der die das und ist den von mit für auf nicht ein eine zu dem sich des im als auch es an werden",
    "es": "el la los las que en por una con para es del un se no su al lo como más pero sus le ha",
}
LANGUAGES = (*FUNCTION_WORDS, "other")
_SPLIT = re.compile(r"\w+")


class Words(dict):
    """For each word (small letters) its row in ``ids``; ``ids`` has the hashes of the word and of its first letters."""

    def __init__(self):
        super().__init__()
        self.ids = np.zeros((4096, 1 + len(PREFIXES)), np.int32)
        self.tongue = np.zeros((4096, len(FUNCTION_WORDS)), np.int8)
        self.known = [frozenset(w.split()) for w in FUNCTION_WORDS.values()]

    def __missing__(self, word: str) -> int:
        at = len(self)
        if at >= len(self.ids):
            self.ids, self.tongue = (np.concatenate([x, np.zeros_like(x)]) for x in (self.ids, self.tongue))
        parts = [word, *(f"{k}{word[:k]}" if len(word) > k else f"={word}" for k in PREFIXES)]
        self.ids[at] = [xxhash.xxh32_intdigest(p, 3) % SPACE for p in parts]
        self.tongue[at] = [word in k for k in self.known]
        self[word] = at
        return at


_words = Words()


def word_ids(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words' hashes (a row a word), the words of each text, and each text's language."""
    global _words
    if len(_words) > KEPT_WORDS:
        _words = Words()  # begin anew rather than grow
    rows, sizes = [], []
    for text in texts:
        found = _SPLIT.findall((text or "").lower())
        rows.append(np.fromiter(map(_words.__getitem__, found), np.int64, len(found)))
        sizes.append(len(found))
    rows, sizes = np.concatenate([*rows, np.zeros(0, np.int64)]), np.array(sizes, np.int64)
    votes = np.zeros((len(sizes), len(FUNCTION_WORDS) + 1))
    some = sizes > 0
    if some.any():
        votes[some, :-1] = np.add.reduceat(_words.tongue[rows], (np.cumsum(sizes) - sizes)[some], axis=0, dtype=np.int64)
    votes[:, -1] = 0.5
    return _words.ids[rows], sizes, votes.argmax(axis=1)


@dataclass
class Model:
    """Embedding, filters (width * DIM, FILTERS) with biases, and the logistic unit; a cut for each language."""

    embedding: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    base: np.ndarray
    cuts: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [self.embedding, *self.filters, *self.biases, self.out, self.base]

    def forward(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, list]:
        """The logit of each text, and what the backward pass needs."""
        starts, some = np.cumsum(sizes) - sizes, sizes > 0
        words = self.embedding[ids].sum(axis=1)
        # the words of a text are followed by blanks, so that no filter sees two texts
        pad = max(WIDTHS) - 1
        at = np.arange(len(words)) + np.repeat(np.arange(len(sizes)) * pad, sizes)
        laid = np.zeros((len(words) + pad * len(sizes) + pad, DIM), np.float32)
        laid[at] = words
        pooled, kept = np.zeros((len(sizes), len(WIDTHS) * FILTERS), np.float32), []
        for k, width in enumerate(WIDTHS):
            seen = sum(laid[j : j + len(laid) - pad] @ self.filters[k][j * DIM : (j + 1) * DIM] for j in range(width))[at] if len(at) else np.zeros((0, FILTERS), np.float32)
            if some.any():
                best = np.maximum.reduceat(seen, starts[some], axis=0)
                pooled[some, k * FILTERS : (k + 1) * FILTERS] = np.maximum(best + self.biases[k], 0)
            kept.append(seen)
        return pooled @ self.out + self.base[0], [laid, at, pooled, kept, starts, some]

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Shifted probabilities; 0.5 is the threshold of the text's language."""
        out, at = [], 0
        while at < len(texts):
            end, held = at, 0
            while end < len(texts) and (end == at or held + len(texts[end] or "") // 6 <= CHUNK):
                held += len(texts[end] or "") // 6
                end += 1
            ids, sizes, tongues = word_ids(texts[at:end])
            logits, _ = self.forward(ids, sizes)
            out.append(1 / (1 + np.exp(-(logits.astype(np.float64) - self.cuts[tongues]))))
            at = end
        return np.concatenate(out) if out else np.zeros(0)


def untrained(seed: int = 5) -> Model:
    rng = np.random.default_rng(seed)
    draw = lambda *shape, s: rng.normal(0, s, shape).astype(np.float32)
    return Model(draw(SPACE, DIM, s=0.1), [draw(w * DIM, FILTERS, s=0.3) for w in WIDTHS], [np.zeros(FILTERS, np.float32) for _ in WIDTHS], draw(len(WIDTHS) * FILTERS, s=0.3), np.zeros(1, np.float32), np.zeros(len(LANGUAGES)))


def gradients(model: Model, ids: np.ndarray, sizes: np.ndarray, slope: np.ndarray, cache: list) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Of the dense parts after the embedding; then rows of the embedding with their gradients."""
    laid, at, pooled, kept, starts, some = cache
    d_out, d_pooled = pooled.T @ slope, slope[:, None] * model.out[None, :] * (pooled > 0)
    d_filters, d_biases, rows, grads = [], [], [], []
    texts = np.flatnonzero(some)
    for k, width in enumerate(WIDTHS):
        d = d_pooled[:, k * FILTERS : (k + 1) * FILTERS]
        d_biases.append(d.sum(axis=0))
        d_filter = np.zeros_like(model.filters[k])
        seen = kept[k]
        for i in texts[np.abs(d[texts]).sum(axis=1) > 0]:
            best = seen[starts[i] : starts[i] + sizes[i]].argmax(axis=0) + starts[i]
            for f in np.flatnonzero(d[i]):
                for j in range(width):
                    spot = best[f] + j
                    if spot < starts[i] + sizes[i]:
                        d_filter[j * DIM : (j + 1) * DIM, f] += d[i, f] * laid[at[spot]]
                        rows.append(spot)
                        grads.append(d[i, f] * model.filters[k][j * DIM : (j + 1) * DIM, f])
        d_filters.append(d_filter)
    if not rows:
        return [*d_filters, *d_biases, d_out, np.array([slope.sum()])], np.zeros(0, np.int64), np.zeros((0, DIM), np.float32)
    used, place = np.unique(ids[np.array(rows)].ravel(), return_inverse=True)
    total = np.zeros((len(used), DIM), np.float32)
    np.add.at(total, place, np.repeat(np.array(grads, np.float32), ids.shape[1], axis=0))
    return [*d_filters, *d_biases, d_out, np.array([slope.sum()])], used, total


def fit(rows: list[tuple[np.ndarray, int, int]], *, rounds: int = 8, batch: int = 32, rate: float = 0.01, seed: int = 5) -> Model:
    """Adam over (hashes, language, label) rows; every fourth row is held back to set the cuts.

    Without both labels the model says what was seen: 0 if nothing was.
    """
    model = untrained(seed)
    labels = np.array([y for _, _, y in rows], np.float32)
    if len(rows) < 8 or len(np.unique(labels)) < 2:
        model.out[:] = 0
        model.base[:] = 4 if len(labels) and labels[0] else -4
        return model
    back = np.arange(len(rows)) % 4 == 3
    parts = model.parts()
    moment = [[np.zeros_like(p) for p in parts] for _ in range(2)]
    rng, step, taught = np.random.default_rng(seed), 0, np.flatnonzero(~back)
    model.base[0] = np.log(labels.mean() / (1 - labels.mean()))
    for turn in range(rounds):
        rng.shuffle(taught)
        for start in range(0, len(taught), batch):
            picked = taught[start : start + batch]
            ids, sizes = np.concatenate([rows[i][0] for i in picked]), np.array([len(rows[i][0]) for i in picked])
            logits, cache = model.forward(ids, sizes)
            slope = ((1 / (1 + np.exp(-logits)) - labels[picked]) / len(picked)).astype(np.float32)
            dense, used, sparse = gradients(model, ids, sizes, slope, cache)
            step += 1
            pace = rate * (1 - turn / rounds) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for p, a, b, g in zip(parts[1:], moment[0][1:], moment[1][1:], dense, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= pace * a / (np.sqrt(b) + 1e-6)
            a, b = moment[0][0], moment[1][0]
            a[used] += 0.1 * (sparse - a[used])
            b[used] += 0.001 * (sparse * sparse - b[used])
            model.embedding[used] -= pace * a[used] / (np.sqrt(b[used]) + 1e-6)
    held = np.flatnonzero(back)
    logits = np.concatenate([model.forward(rows[i][0], np.array([len(rows[i][0])]))[0] for i in held])
    model.cuts[:] = cuts(logits, labels[held], np.array([rows[i][1] for i in held]))
    return model


def cuts(logits: np.ndarray, labels: np.ndarray, tongues: np.ndarray, *, least: int = 20) -> np.ndarray:
    """For each language the logit in the middle of those that give the best F1; with few positives, that of all."""

    def best(z: np.ndarray, y: np.ndarray) -> float:
        order = np.argsort(-z, kind="stable")
        z, y = z[order], y[order]
        hits = np.cumsum(y)
        f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
        k = int(f1.argmax())
        return float((z[k] + z[min(k + 1, len(z) - 1)]) / 2)

    if not labels.sum():
        return np.zeros(len(LANGUAGES))
    whole = best(logits, labels)
    return np.array([best(logits[tongues == t], labels[tongues == t]) if labels[tongues == t].sum() >= least else whole for t in range(len(LANGUAGES))])


def _emit_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [word_ids([t]) for t in batch.column(1).to_pylist()]
        yield pa.record_batch([batch.column(0), pa.array([int(t[0]) for _, _, t in made], pa.int32()), pa.array([i.tobytes() for i, _, _ in made], pa.binary())], names=["toxic", "tongue", "ids"])


def held_out(key: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled documents that are not held out, the first by a hash of the key, of ``SAMPLE_BYTES`` in all.

    Null keys and labels are dropped; of several labels of a key the greatest
    counts, of several texts the least.
    """
    small_batches(docs.sparkSession)
    known = labels.select("doc_id", "toxic").dropna().where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = labelled_texts(docs, known, "toxic", rows=sample, size=SAMPLE_BYTES).select("toxic", "text")
    rows = texts.mapInArrow(_emit_words, "toxic int, tongue int, ids binary").collect()
    rows.sort(key=lambda r: xxhash.xxh64_intdigest(bytes(r.ids)))
    return fit([(np.frombuffer(r.ids, np.int32).reshape(-1, 1 + len(PREFIXES)), r.tongue, r.toxic) for r in rows])


def scores(df: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's key, whether its label was held out, its score and the prediction.

    The score depends on the text alone; null and empty texts get the score of a
    text without words. Rows are handled one by one.
    """
    small_batches(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array(m.score(batch.column(1).to_pylist()))], names=["doc_id", "score"])

    rows = df.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    made = rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
    return made.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
