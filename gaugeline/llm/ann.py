"""Approximate nearest neighbours by score-aware quantisation.

Vectors are scaled to length one, so that the inner product is the cosine. An
index has cells (k-means, as many as the root of the number of vectors) and a product quantiser of four-bit codes for what is
left of a vector within its cell. Codes are chosen by an anisotropic loss: error
parallel to the vector, which shifts the large inner products, costs ``eta`` times
what error across it does. A query scans the codes of its nearest cells with
tables of partial products, and of each part all rows are ranked again by exact
cosine of the original vectors that could, by the measured error of their codes,
be among the best of the part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gaugeline.llm.common import cut

#: Vectors the index is fitted on at most, dimensions a code, threshold of the anisotropic loss.
SAMPLE, STEP, THRESHOLD = 16384, 2, 0.2
#: Sample vectors a cell at least; within that, cells are the root of the number of vectors.
OF_CELL = 8
#: Rows of a cell that one task scans, queries that it scans them for.
PART, QUERIES = 4096, 1 << 18
#: What sums of table entries in single precision may be off, at most.
ROUNDING = 1e-4
#: Share of true neighbours that the probed cells have to hold, on the sample.
PROBED = 0.997
#: Lengths of vectors, each searched among its own, that one call takes.
LENGTHS = 64


@dataclass
class Index:
    """Cell centres, codebooks (subspace, 16, STEP), cells that a query probes, and the vectors' length."""

    centres: np.ndarray
    books: np.ndarray
    probes: int
    size: int
    eta: float

    def split(self, x: np.ndarray) -> np.ndarray:
        """Vectors as (rows, subspaces, STEP), padded with zeros."""
        width = len(self.books) * STEP
        return np.pad(x, ((0, 0), (0, width - x.shape[1]))).reshape(len(x), -1, STEP)

    def order(self, x: np.ndarray) -> np.ndarray:
        """Cells of each vector, nearest first."""
        return np.argsort(-(x @ self.centres.T - (self.centres**2).sum(axis=1) / 2), axis=1, kind="stable")

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell and the packed four-bit codes of each vector."""
        cell = self.order(x)[:, 0]
        codes = assign(self.split(x - self.centres[cell]), self.split(x), self.books, self.eta)
        if codes.shape[1] % 2:
            codes = np.pad(codes, ((0, 0), (0, 1)))
        return cell, codes[:, ::2] << 4 | codes[:, 1::2]

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """What packed codes stand for, as (rows, subspaces, STEP)."""
        single = np.stack([codes >> 4, codes & 15], axis=2).reshape(len(codes), -1)[:, : len(self.books)]
        return self.books[np.arange(len(self.books))[None], single]

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Partial products of each query with every pair of codes: (queries, bytes, 256)."""
        single = np.einsum("qsd,skd->qsk", self.split(q), self.books)
        if single.shape[1] % 2:
            single = np.pad(single, ((0, 0), (0, 1), (0, 0)))
        return (single[:, ::2, :, None] + single[:, 1::2, None, :]).reshape(len(q), -1, 256)


def assign(left: np.ndarray, x: np.ndarray, books: np.ndarray, eta: float, passes: int = 2) -> np.ndarray:
    """Codes of residuals ``left`` of unit vectors ``x``, subspace by subspace, by the anisotropic loss."""
    n, spaces, _ = left.shape
    gap = ((left[:, :, None, :] - books[None]) ** 2).sum(axis=3)
    along = np.einsum("nsd,nsd->ns", left, x)[:, :, None] - np.einsum("nsd,skd->nsk", x, books)
    codes = gap.argmin(axis=2)
    rows = np.arange(n)
    parallel = np.take_along_axis(along, codes[:, :, None], 2)[:, :, 0].sum(axis=1)
    for _ in range(passes):
        for s in range(spaces):
            others = parallel - along[rows, s, codes[:, s]]
            codes[:, s] = (gap[:, s] + (eta - 1) * (others[:, None] + along[:, s]) ** 2).argmin(axis=1)
            parallel = others + along[rows, s, codes[:, s]]
    return codes.astype(np.uint8)


def fit(x: np.ndarray, *, cells: int = 32, near: int = 5, rounds: int = 8, seed: int = 3) -> Index:
    """Cells, codebooks and the number of probes from a sample of unit vectors."""
    n, size = x.shape
    rng = np.random.default_rng(seed)
    cells = max(1, min(cells, n // OF_CELL))
    centres = x[rng.choice(n, cells, replace=False)] if n else np.zeros((1, size))
    for _ in range(rounds if n else 0):
        cell = (x @ centres.T - (centres**2).sum(axis=1) / 2).argmax(axis=1)
        counts = np.bincount(cell, minlength=cells)
        sums = np.zeros_like(centres)
        for d in range(size):
            sums[:, d] = np.bincount(cell, x[:, d], minlength=cells)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    spaces = -(-size // STEP)
    eta = max(1.0, THRESHOLD**2 / (1 - THRESHOLD**2) * (size - 1))
    index = Index(centres, np.zeros((spaces, 16, STEP)), cells, size, eta)
    if not n:
        return index
    cell = index.order(x)[:, 0]
    left, own = index.split(x - centres[cell]), index.split(x)
    index.books = left[rng.choice(n, 16)].transpose(1, 0, 2).copy() + rng.normal(0, 1e-4, (spaces, 16, STEP))
    for _ in range(rounds):
        codes = assign(left, own, index.books, eta, 1)
        error = left - index.books[np.arange(spaces)[None], codes]
        parallel = np.einsum("nsd,nsd->ns", error, own)
        for s in range(spaces):
            goal = parallel.sum(axis=1) - parallel[:, s] + np.einsum("nd,nd->n", left[:, s], own[:, s])
            for k in range(16):
                mine = codes[:, s] == k
                if mine.any():
                    a, b = own[mine, s], left[mine, s]
                    index.books[s, k] = np.linalg.solve(mine.sum() * np.eye(STEP) + (eta - 1) * a.T @ a, b.sum(axis=0) + (eta - 1) * a.T @ goal[mine])
    asked = x[rng.choice(n, min(n, 400), replace=False)]
    scores = asked @ x.T
    best = np.argpartition(-scores, min(near, n - 1), axis=1)[:, : near + 1]
    place = np.argsort(index.order(asked), axis=1)
    held = np.sort(np.take_along_axis(place, cell[best], 1).ravel())
    index.probes = int(held[min(len(held) - 1, int(PROBED * len(held)))]) + 1
    return index


def usable(vector: Column) -> Column:
    """True for vectors without null or non-finite components that are not zero; never null."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(raw, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.float64).reshape(-1, size)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the norm
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def scan(index: Index, rows: Rows, ids: np.ndarray, vectors: np.ndarray, near: int) -> tuple[np.ndarray, ...]:
    """The best of one part of a cell for each of some queries: the query's place, the row's place and the cosine.

    A row's cosine is the cell centre's product, its table score, and at most
    the length of its quantisation error (the query has length one) more. The
    best by score set a floor; all rows that can reach it are ranked exactly.
    """
    asked = _unit(vectors)
    tables = index.tables(asked).astype(np.float32)
    found = np.zeros((len(ids), len(rows.ids)), np.float32)
    for k in range(rows.codes.shape[1]):
        found += np.take(tables[:, k], rows.codes[:, k], axis=1)
    own = ids[:, None] == rows.ids[None, :]
    found[own] = -np.inf
    if found.shape[1] > near:
        first = np.argpartition(-found, near - 1, axis=1)[:, :near]
        sure = np.einsum("qnd,qd->qn", rows.unit[first], asked)
        sure[np.take_along_axis(own, first, 1)] = -np.inf
        floor = sure.min(axis=1)
    else:
        floor = np.full(len(ids), -np.inf)
    reach = found + (rows.error[None, :] + (asked @ rows.centre)[:, None])
    query, row = np.nonzero((reach >= (floor - ROUNDING)[:, None]) & ~own)
    exact = np.concatenate([np.einsum("nd,nd->n", rows.unit[row[k : k + 65536]], asked[query[k : k + 65536]]) for k in range(0, len(row), 65536)] or [np.zeros(0)])
    order = np.lexsort((rows.keys[row], -exact, query))
    query, row, exact = query[order], row[order], exact[order]
    rank = np.arange(len(query)) - np.searchsorted(query, query)
    keep = rank < near
    return query[keep], row[keep], exact[keep]


class Rows:
    """The rows of one part of a cell, ready to be scanned."""

    def __init__(self, index: Index, cell: int, ids: np.ndarray, keys: np.ndarray, vectors: np.ndarray, codes: np.ndarray):
        self.ids, self.keys, self.codes, self.unit = ids, keys, codes, _unit(vectors)
        self.centre = index.centres[cell]
        self.error = np.sqrt(((index.split(self.unit - self.centre) - index.decode(codes)) ** 2).sum(axis=(1, 2)))


def search(df: DataFrame, *, every: int = 50, near: int = 5, key: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE) -> DataFrame:
    """For each row whose key is divisible by ``every``, its nearest rows by cosine.

    Returns query_id, rank (from 1), vec_id and score (cosine in double
    precision); fewer rows where there are fewer candidates. Rows with a null
    key take no part, nor do unusable vectors. Rows that repeat a key are rows
    like any other: each is a candidate of the others, and each whose key is
    divisible is a query with ranks of its own. Vectors of different lengths have
    no cosine: each length is searched among its own, and more than ``LENGTHS``
    lengths are an error. The index is fitted on at most ``sample`` rows, the
    first by a hash of the key, but holds every row.
    """
    rows = df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector")).where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    sizes = {r.size: r["count"] for r in rows.groupBy(F.size("vector").alias("size")).count().limit(LENGTHS + 1).collect()}
    if len(sizes) > LENGTHS:
        raise ValueError(f"vectors of more than {LENGTHS} lengths")
    found = [_search(rows.where(F.size("vector") == size), size, count, every=every, near=near, sample=sample) for size, count in sorted(sizes.items())]
    if not found:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return reduce(DataFrame.union, found)


def _search(rows: DataFrame, size: int, count: int, *, every: int, near: int, sample: int) -> DataFrame:
    spark = rows.sparkSession
    fitted = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "vector").limit(sample).select("vector").toArrow().column(0)
    x = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in fitted.chunks] or [np.zeros(0)]).reshape(-1, size)
    index = spark.sparkContext.broadcast(fit(_unit(x), cells=int(count**0.5), near=near))  # cells and codebooks: bounded by the sample

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            for start in range(0, len(x), 2000):
                part = x[start : start + 2000]
                unit = _unit(part)
                cell, codes = index.value.encode(unit)
                ids = batch.column(0).slice(start, len(part))
                asked = np.flatnonzero(ids.to_numpy() % every == 0)
                probed: list = [None] * len(part)
                for at, cells in zip(asked, np.sort(index.value.order(unit[asked])[:, : index.value.probes], axis=1).astype(np.int32), strict=True):
                    probed[at] = cells
                yield pa.record_batch([ids, pa.array([v.tobytes() for v in part], pa.binary()), pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(probed, pa.list_(pa.int32()))], names=["vec_id", "vector", "cell", "codes", "probed"])

    # written once: every row is encoded once and keeps its number
    placed = rows.mapInArrow(place, "vec_id long, vector binary, cell int, codes binary, probed array<int>")
    placed = cut(placed.withColumn("row", F.monotonically_increasing_id()))
    held = {r.cell: r["count"] for r in placed.groupBy("cell").count().collect()}  # a row a cell
    asking = {r.cell: r["count"] for r in placed.select(F.explode("probed").alias("cell")).groupBy("cell").count().collect()}
    cells = range(len(index.value.centres))
    parts = F.array(*(F.lit(max(1, -(-held.get(c, 0) // PART))) for c in cells))
    blocks = F.array(*(F.lit(max(1, -(-asking.get(c, 0) // QUERIES))) for c in cells))
    of = lambda counts: F.element_at(counts, F.col("cell") + 1)
    each = lambda counts: F.explode(F.sequence(F.lit(0), of(counts) - 1))
    own = lambda counts, salt: F.pmod(F.xxhash64("row", F.lit(salt)), of(counts)).cast("int")
    columns = ["cell", "part", "block", "asks", "row", "vec_id", "vector", "codes"]
    rows_ = placed.select("cell", own(parts, 0).alias("part"), each(blocks).alias("block"), F.lit(False).alias("asks"), "row", "vec_id", "vector", "codes")
    queries = placed.where(F.col("probed").isNotNull()).select("row", "vec_id", "vector", F.explode("probed").alias("cell"))
    queries = queries.select("cell", each(parts).alias("part"), own(blocks, 1).alias("block"), F.lit(True).alias("asks"), "row", "vec_id", "vector", F.lit(None).cast("binary").alias("codes"))

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, kept, ready = None, [], None  # the place in hand, its rows as they come, and made ready for its queries
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)])
            edges = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), len(batch)]
            for start, end in zip(edges, edges[1:], strict=False):
                if start == end:
                    continue
                some, place = batch.slice(start, end - start), tuple(keys[:3, start])
                if place != at:
                    at, kept, ready = place, [], None
                if not keys[3, start]:
                    kept.append(some)
                    continue
                if not kept:
                    continue
                if ready is None:
                    table = pa.Table.from_batches(kept)
                    ready = Rows(index.value, at[0], table["row"].to_numpy(), table["vec_id"].to_numpy(), _matrix(table["vector"].to_pylist(), size), np.frombuffer(b"".join(table["codes"].to_pylist()), np.uint8).reshape(len(table), -1))
                for k in range(0, len(some), 256):
                    few = some.slice(k, 256)
                    query, row, score = scan(index.value, ready, few.column(4).to_numpy(), _matrix(few.column(6).to_pylist(), size), near)
                    yield pa.record_batch([few.column(4).take(pa.array(query)), few.column(5).take(pa.array(query)), pa.array(ready.keys[row]), pa.array(score)], names=["query", "query_id", "vec_id", "score"])

    # rows of a place come before its queries, which stream past them
    met = rows_.unionByName(queries).select(*columns).repartition("cell", "part", "block").sortWithinPartitions("cell", "part", "block", "asks")
    found = met.mapInArrow(scanned, "query long, query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= near).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
