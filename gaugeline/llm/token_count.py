"""Counting byte-pair tokens without making them.

A text's characters are the first symbols. Adjacent symbols whose concatenation
is a piece can merge; a heap gives the pair of lowest rank (leftmost on ties) and
a doubly linked list joins it, until no pair is left. The count is the number of
first symbols less the merges; a character outside the vocabulary stands for its
UTF-8 bytes and never merges.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.common import small_batches

SPACE = "▁"
#: Counts of so many distinct words, of so many characters at most, are kept by each worker.
KEPT_WORDS, KEPT_CHARS = 300_000, 48


def read_ranks(model: bytes) -> dict[str, int]:
    """Ranks of the mergeable pieces of a serialized byte-pair piece model, with byte fallback and identity normalisation."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    m = proto.ModelProto()
    m.ParseFromString(model)
    spec = m.normalizer_spec
    if m.trainer_spec.model_type != m.trainer_spec.BPE or not m.trainer_spec.byte_fallback or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or any(p.type == p.USER_DEFINED for p in m.pieces):
        raise ValueError("only byte-pair models with byte fallback, identity normalisation and a leading blank are counted")
    return {p.piece: round(-p.score) for p in m.pieces if p.type == p.NORMAL}


def merges(symbols: str, ranks: dict[str, int]) -> int:
    """How many merges the symbols undergo."""
    n = len(symbols)
    if n < 2:
        return 0
    heap = []
    for i in range(n - 1):
        pair = symbols[i : i + 2]
        if (rank := ranks.get(pair)) is not None:
            heap.append((rank, i, i + 1, 2))
    if not heap:
        return 0
    heapq.heapify(heap)
    length, before, after, done = [1] * n, list(range(-1, n - 1)), list(range(1, n + 1)), 0
    while heap:
        _, left, right, size = heapq.heappop(heap)
        if not length[left] or not length[right] or length[left] + length[right] != size:
            continue  # one of the two has merged meanwhile
        length[left], length[right] = size, 0
        done += 1
        after[left] = follower = after[right]
        if follower < n:
            before[follower] = left
            if (rank := ranks.get(symbols[left : left + size + length[follower]])) is not None:
                heapq.heappush(heap, (rank, left, follower, size + length[follower]))
        if (ahead := before[left]) >= 0 and (rank := ranks.get(symbols[ahead : left + size])) is not None:
            heapq.heappush(heap, (rank, ahead, left, length[ahead] + size))
    return done


def count(symbols: str, ranks: dict[str, int]) -> int:
    first = sum(1 if c in ranks else len(c.encode()) for c in symbols)
    return first - merges(symbols, ranks)


def splitter(ranks: dict[str, int]) -> Callable[[str], list[str]]:
    """Cuts a text where no merge can reach across, so that words can be counted alone.

    With no piece that has a blank after another character, and none with a line
    end, these are the places before blanks and around line ends.
    """
    if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in ranks):
        return lambda symbols: [symbols]
    return re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n").findall


class Counter(dict):
    """Token counts of words, computed where absent and kept up to a bound."""

    def __init__(self, ranks: dict[str, int]):
        super().__init__()
        self.ranks, self.split = ranks, splitter(ranks)

    def __missing__(self, word: str) -> int:
        n = count(word, self.ranks)
        if len(word) <= KEPT_CHARS and len(self) < KEPT_WORDS:
            self[word] = n
        return n

    def tokens(self, text: str) -> int:
        if not text:
            return 0
        return sum(map(self.__getitem__, self.split(SPACE + text.replace(" ", SPACE))))


_counters: dict[str, Counter] = {}


def kept_counter(model_path: str, ranks: Broadcast) -> Counter:
    """The worker's counter for a model; a worker serves many tasks."""
    if model_path not in _counters:
        _counters[model_path] = Counter(ranks.value)
    return _counters[model_path]


def count_tokens(df: DataFrame, model_path: str, *, key: str = "doc_id", text: str = "text", limit: int = 4096) -> DataFrame:
    """Every row's key with the bytes and tokens of its whole text.

    The model file is read by the driver; its ranks (a fixed vocabulary) go to
    the workers as a broadcast. Null text counts as empty: 0 bytes, 0 tokens.
    Rows are counted one by one, so repeated keys stay and other columns are
    ignored.
    """
    with open(model_path, "rb") as f:
        ranks = df.sparkSession.sparkContext.broadcast(read_ranks(f.read()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = kept_counter(model_path, ranks)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.record_batch([batch.column(0), pa.array([counter.tokens(t) for t in texts], pa.int64()), batch.column(2)], names=["doc_id", "n_tokens", "n_bytes"])

    small_batches(df.sparkSession)
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.col(key).alias("doc_id"), whole.alias("text"), F.octet_length(whole).cast("long").alias("n_bytes"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    counted = rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, n_bytes long")
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
