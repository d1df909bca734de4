"""Encoding and decoding with a piece table by a relational lattice.

A word's lattice has an edge for each substring that is a piece, and for each
character that is none. Edges come from exploding the substrings of bounded length and
joining them to the piece table; grouped by word, a Viterbi fold over the positions
takes the path of greatest summed score.

Two forms share that plan. ``encode_words`` states it in DataFrame operations, with
Spark's higher-order ``aggregate`` as the fold. ``encode`` runs it on the distinct words
of each Arrow batch, where the explode, the join (a search in the sorted piece hashes,
verified on the piece itself) and the fold are array operations over all words at once:
so the words of a document need not be shuffled to meet their pieces and back.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from gaugeline.llm.common import small_batches, written

SPACE = "▁"
#: What a character outside the table costs beyond the worst piece.
UNKNOWN = 10.0
#: Size of the bit tables before the search for a piece.
FILTER = 1 << 20
#: Longer words are folded alone, words of so many characters at most are kept by a worker, up to so many.
LONG, KEPT_CHARS, KEPT_WORDS = 64, 40, 200_000


@dataclass
class Pieces:
    """A piece table: text, id and score of each piece; ids of the 256 byte pieces."""

    texts: list[str]
    ids: np.ndarray
    scores: np.ndarray
    bytes_: np.ndarray

    def __post_init__(self):
        self.longest = max(map(len, self.texts), default=1)
        self.least = float(self.scores.min()) if len(self.scores) else 0.0
        self.rank = {t: k for k, t in enumerate(self.texts)}
        self.raw = [b""] * (int(max(self.ids.max(initial=0), self.bytes_.max(initial=0))) + 1)  # by id
        for t, i in zip(self.texts, self.ids.tolist(), strict=True):
            self.raw[i] = t.encode()
        for b, i in enumerate(self.bytes_.tolist()):
            self.raw[i] = bytes((b,))
        hashes = name(self.texts, self.longest)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.places = hashes[order], order
        if (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("two pieces share a hash")
        self.codes = points(self.texts, self.longest)
        # low bits of the hashes of pieces and of their beginnings: what is in neither needs no search
        self.whole, self.begun = np.zeros(FILTER, bool), np.zeros(FILTER, bool)
        self.whole[hashes & np.uint64(FILTER - 1)] = True
        self.begun[name(list({t[:k] for t in self.texts for k in range(1, len(t))}), self.longest) & np.uint64(FILTER - 1)] = True
        # neighbours within a piece: between others every path has an edge's end
        self.joined = np.zeros(FILTER, bool)
        for k in range(1, self.codes.shape[1]):
            inner = self.codes[:, k] > 0
            self.joined[pair(self.codes[inner, k - 1] - np.uint32(1), self.codes[inner, k] - np.uint32(1))] = True

    def table(self, spark: SparkSession) -> DataFrame:
        """The pieces as rows (piece, id, score)."""
        rows = [(t, int(i), float(s)) for t, i, s in zip(self.texts, self.ids, self.scores, strict=True)]
        return spark.createDataFrame(rows, "piece string, id int, score double")


def read_pieces(path: str) -> Pieces:
    """The normal pieces of a serialized piece model with byte fallback and identity normalisation."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    m = proto.ModelProto()
    with open(path, "rb") as f:
        m.ParseFromString(f.read())
    spec = m.normalizer_spec
    if not m.trainer_spec.byte_fallback or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix:
        raise ValueError("only piece tables with byte fallback, identity normalisation and a leading blank are read")
    normal = [(p.piece, i, p.score) for i, p in enumerate(m.pieces) if p.type == p.NORMAL]
    if any(SPACE in t.lstrip(SPACE) for t, _, _ in normal):
        raise ValueError("a piece goes on past the end of a word")
    by = {p.piece: i for i, p in enumerate(m.pieces) if p.type == p.BYTE}
    return Pieces([t for t, _, _ in normal], np.array([i for _, i, _ in normal], np.int32), np.array([s for _, _, s in normal], np.float64), np.array([by[f"<0x{b:02X}>"] for b in range(256)], np.int32))


def points(words: list[str], width: int) -> np.ndarray:
    """Code points, a row a word, zero past its end; all are moved up by one."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.zeros((len(words), width), np.uint32)
    row = np.repeat(np.arange(len(words)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat + 1
    return out


def name(words: list[str], width: int) -> np.ndarray:
    """A hash of each word of up to ``width`` characters, as the lattice makes them step by step."""
    codes, out = points(words, width), np.zeros(len(words), np.uint64)
    for k in range(width):
        out = np.where(codes[:, k] > 0, step(out, codes[:, k]), out)
    return out


def step(held: np.ndarray, code: np.ndarray) -> np.ndarray:
    """The hash of a string and one more character."""
    x = (held ^ code.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(31))


def pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A place in a bit table for each two code points."""
    return (left * np.uint32(0x9E3779B1) ^ right * np.uint32(0x85EBCA77)) >> np.uint32(12)


def fold(words: list[str], pieces: Pieces) -> list[bytes]:
    """The ids of each word's best path, as the bytes of 32-bit numbers, so that texts are joins of words."""
    if not words:
        return []
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(-sizes, kind="stable")  # so that the words that reach a position lead
    sizes = sizes[order]
    codes = points([words[i] for i in order], int(sizes[0]))
    n, width = codes.shape
    best = np.full((n, width + 1), -np.inf)
    best[:, 0] = 0
    via = np.full((n, width + 1), -1, np.int32)  # place of the last piece, -1 for an unknown character
    start = np.zeros((n, width + 1), np.int16)
    unknown = pieces.least - UNKNOWN
    for at in range(width):
        rows = int(np.searchsorted(-sizes, -at, "left"))  # words longer than at
        if not rows:
            break
        alone = best[:rows, at] + unknown
        better = alone > best[:rows, at + 1]
        best[:rows, at + 1] = np.where(better, alone, best[:rows, at + 1])
        start[:rows, at + 1] = np.where(better, at, start[:rows, at + 1])
        via[:rows, at + 1] = np.where(better, -1, via[:rows, at + 1])
        held, open_ = np.zeros(rows, np.uint64), np.arange(rows)  # words whose characters from at on may still begin a piece
        for k in range(min(pieces.longest, width - at)):
            more = sizes[open_] > at + k
            open_ = open_[more]
            held = step(held[more], codes[open_, at + k])
            low = held & np.uint64(FILTER - 1)
            maybe = np.flatnonzero(pieces.whole[low])
            spot = np.minimum(np.searchsorted(pieces.hashes, held[maybe]), len(pieces.hashes) - 1)
            found = pieces.hashes[spot] == held[maybe]
            hit, place = open_[maybe[found]], pieces.places[spot[found]]
            if len(hit):
                true = (pieces.codes[place, : k + 1] == codes[hit, at : at + k + 1]).all(axis=1)
                hit, place = hit[true], place[true]
                score = best[hit, at] + pieces.scores[place]
                won = score > best[hit, at + k + 1]
                hit, place = hit[won], place[won]
                best[hit, at + k + 1], via[hit, at + k + 1], start[hit, at + k + 1] = score[won], place, at
            go = pieces.begun[low]
            open_, held = open_[go], held[go]
            if not len(open_):
                break
    left, spot, steps = np.arange(n), sizes.copy(), []
    while len(left):
        place, begin = via[left, spot[left]], start[left, spot[left]]
        steps.append((left, place, begin))
        spot[left] = begin
        left = left[spot[left] > 0]
    rows, places, begins = (np.concatenate(x) for x in zip(*reversed(steps), strict=True))
    rows = order[rows]
    along = np.argsort(rows, kind="stable")  # pieces of a word stand together, first to last
    rows, places, begins = rows[along], places[along], begins[along]
    flat = pieces.ids[places]
    raw, ends = flat.tobytes(), np.searchsorted(rows, np.arange(n), "right")
    out = [raw[a:b] for a, b in zip([0, *(4 * ends).tolist()], (4 * ends).tolist(), strict=False)]
    for row in np.unique(rows[places < 0]).tolist():  # characters outside the table: their bytes
        at = range(ends[row - 1] if row else 0, ends[row])
        out[row] = b"".join(flat[k].tobytes() if places[k] >= 0 else pieces.bytes_[list(words[row][begins[k]].encode())].tobytes() for k in at)
    return out


def fold_long(word: str, pieces: Pieces) -> bytes:
    """The same for one word of any length."""
    n = len(word)
    best, via = [0.0] + [-np.inf] * n, [(0, -1)] * (n + 1)
    rank, scores, unknown = pieces.rank, pieces.scores.tolist(), pieces.least - UNKNOWN
    for at in range(n):
        if best[at] + unknown > best[at + 1]:
            best[at + 1], via[at + 1] = best[at] + unknown, (at, -1)
        for end in range(at + 1, min(n, at + pieces.longest) + 1):
            if (p := rank.get(word[at:end])) is not None and best[at] + scores[p] > best[end]:
                best[end], via[end] = best[at] + scores[p], (at, p)
    parts, at = [], n
    while at:
        begin, p = via[at]
        parts.append(pieces.ids[p].tobytes() if p >= 0 else pieces.bytes_[list(word[begin].encode())].tobytes())
        at = begin
    return b"".join(reversed(parts))


_SPLIT = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n").findall


def split(text: str | None) -> list[str]:
    """A text's words: a run of blanks and what follows, up to the next blank; line ends are words."""
    return _SPLIT(SPACE + text.replace(" ", SPACE)) if text else []


#: Characters of text that are cut into words at once.
BLOCK = 1 << 20


def finer(texts: list[str | None], pieces: Pieces) -> tuple[pa.StringArray, np.ndarray]:
    """The words of all texts, one after the other, and how many each text has.

    They are those of ``split``, cut also between any two characters that stand side by
    side in no piece (but for collisions in a bit table). No edge crosses such a place, so
    the best path of a word is the best paths of its parts, and more words are alike.
    """
    made, counts, at = [], np.zeros(len(texts), np.int64), 0
    while at < len(texts):
        end, held = at, 0
        while end < len(texts) and held < BLOCK:
            held += len(texts[end] or "")
            end += 1
        part = [SPACE + t.replace(" ", SPACE) if t else "" for t in texts[at:end]]
        line = "".join(part)
        if line:
            codes = np.frombuffer(line.encode("utf-32-le"), np.uint32)
            blank, line_end, begins = codes == ord(SPACE), codes == ord("\n"), np.ones(len(codes), bool)
            begins[1:] = ~pieces.joined[pair(codes[:-1], codes[1:])] | (blank[1:] & ~blank[:-1]) | line_end[1:] | line_end[:-1]
            sizes = np.fromiter(map(len, part), np.int64, len(part))
            begins[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
            before = np.concatenate([[0], np.cumsum(begins)])
            counts[at:end] = np.diff(before[np.concatenate([[0], np.cumsum(sizes)])])
            data = line.encode()
            ends = np.append(np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)[begins], len(data)).astype(np.int32)
            made.append(pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(data)))
        at = end
    return (pa.concat_arrays(made) if made else pa.array([], pa.string())), counts


def laid_out(words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the words and where each begins, with the end of the last."""
    if not len(words):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    starts = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    return np.frombuffer(words.buffers()[2], np.uint8)[starts[0] : starts[-1]], starts - starts[0]


def runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


class Encoder:
    """Encodes texts; the ids of short words are kept up to a bound."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.kept: dict[str, bytes] = {}

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        cut = [split(t) for t in texts]
        new = list(set(chain.from_iterable(cut)).difference(self.kept))
        room = max(0, KEPT_WORDS - len(self.kept))
        short = [w for w in new if len(w) <= LONG]
        for w in new:
            if len(w) > LONG:
                self.kept[w] = fold_long(w, self.pieces)
        for at in range(0, len(short), 20_000):
            self.kept.update(zip(short[at : at + 20_000], fold(short[at : at + 20_000], self.pieces), strict=True))
        out = [np.frombuffer(b"".join(map(self.kept.__getitem__, words)), np.int32) for words in cut]
        for w in [w for w in new if len(w) > KEPT_CHARS] + [w for w in new if len(w) <= KEPT_CHARS][room:]:
            del self.kept[w]
        return out


def decode(ids, pieces: Pieces) -> str:
    """The text that the ids stand for, without the blank put before it."""
    text = b"".join(map(pieces.raw.__getitem__, ids)).decode("utf-8", "replace").replace(SPACE, " ")
    return text[1:] if text.startswith(" ") else text


_encoders: dict[str, Encoder] = {}


def kept_encoder(path: str, pieces: Broadcast) -> Encoder:
    """The worker's encoder for a model; a worker serves many tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(pieces.value)
    return _encoders[path]


def encode(df: DataFrame, model_path: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's key, the ids of its whole text, and whether decoding them gives the text back.

    Decoding loses nothing but the difference between a blank and the sign that
    stands for it, so ``round_trip`` compares with that sign read as a blank.
    Null and empty texts have no ids. Rows are handled one by one. Paths are those
    of the greatest summed score. For a table of merge ranks, as of a BPE model,
    these are not the merges that the model's own library makes: such ids are for
    the round trip and for counts here, not for a consumer of that model.
    """
    small_batches(df.sparkSession)
    pieces = df.sparkSession.sparkContext.broadcast(read_pieces(model_path))  # a fixed vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept_encoder(model_path, pieces)
        for batch in batches:
            for start in range(0, len(batch), 1000):
                part = batch.slice(start, 1000)
                texts = part.column(1).to_pylist()
                ids = encoder.encode(texts)
                same = [decode(i.tolist(), encoder.pieces) == (t or "").replace(SPACE, " ") for i, t in zip(ids, texts, strict=True)]
                sizes = np.cumsum([0, *map(len, ids)])
                yield pa.record_batch([part.column(0), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32))), pa.array(same)], names=["doc_id", "ids", "round_trip"])

    rows = df.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>, round_trip boolean")


def decode_ids(df: DataFrame, model_path: str, *, ids: str = "ids") -> DataFrame:
    """The rows with a column ``decoded``, the text of their ids (null for null)."""
    pieces = df.sparkSession.sparkContext.broadcast(read_pieces(model_path))

    @F.udf("string", useArrow=True)
    def text_of(found):
        return None if found is None else decode([int(i) for i in found], pieces.value)

    return df.withColumn("decoded", text_of(F.col(ids)))


def encode_words(words: DataFrame, table: DataFrame, *, longest: int, unknown: float) -> DataFrame:
    """(word, pieces) of the distinct words of column ``word``, all in DataFrame operations.

    ``pieces`` are the texts of the best path's edges; a character outside the
    table is an edge of its own. The table is a fixed vocabulary and is joined as
    a broadcast. Null words are dropped; the empty word has no pieces.
    """
    words = words.select("word").where(F.col("word").isNotNull()).distinct()
    paths = best_paths(words, table, longest=longest, unknown=unknown)
    parts = F.transform(F.sequence(F.lit(2), F.size("cuts")), lambda i: F.substring(F.col("word"), F.element_at("cuts", i - 1), F.element_at("cuts", i) - F.element_at("cuts", i - 1)))
    return paths.select("word", parts.alias("pieces")).union(words.where(F.length("word") == 0).select("word", F.array().cast("array<string>").alias("pieces")))


def best_paths(words: DataFrame, table: DataFrame, *, longest: int, unknown: float, by: tuple[str, ...] = (), carry: str | None = None) -> DataFrame:
    """(by..., word, carry, cuts) of rows that are distinct in (by, word) and not empty: where the edges of a word's best path begin, from 1, and its end.

    Words are grouped by (by, word), which moves no row where they are dealt by ``by``
    or ``word``. ``carry`` rides on a word's first edge only.
    """
    size, also = F.length("word"), [carry] if carry else []
    spans = words.select(*by, "word", *also, F.explode(F.sequence(F.lit(1), size)).alias("begin")).where(size > 0)
    spans = spans.select(*by, "word", *also, "begin", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), size - F.col("begin") + 1))).alias("chars"))
    first = (F.col("begin") == 1) & (F.col("chars") == 1)
    spans = spans.select(*by, "word", *(F.when(first, F.col(c)).alias(c) for c in also), "begin", "chars", F.substring("word", F.col("begin"), F.col("chars")).alias("piece"))
    edges = spans.join(F.broadcast(table), "piece", "left").withColumn("score", F.coalesce("score", F.when(F.col("chars") == 1, F.lit(unknown))))
    edges = edges.where(F.col("score").isNotNull()).select(*by, "word", *also, F.struct((F.col("begin") + F.col("chars") - 1).alias("end"), "begin", "score").alias("edge"))
    lattice = edges.groupBy(*by, "word").agg(F.sort_array(F.collect_list("edge")).alias("edges"), *(F.first(c, ignorenulls=True).alias(c) for c in also))

    # the fold holds, for each position from 0 on, the best score there and where its last edge begins;
    # edges come by their end, so all that lead to an edge's beginning have been seen
    held = "array<struct<score:double,begin:int>>"

    def better(state: Column, edge: Column) -> Column:
        score = F.element_at(state, edge["begin"])["score"] + edge["score"]
        last = F.element_at(state, -1)
        made = F.struct(score.alias("score"), edge["begin"].cast("int").alias("begin"))
        grown = F.concat(state, F.array(made))
        again = F.concat(F.slice(state, 1, F.size(state) - 1), F.array(made))
        return F.when(F.size(state) <= edge["end"], grown).when(score > last["score"], again).otherwise(state)

    start = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("begin"))).cast(held)
    folded = lattice.select(*by, "word", *also, F.aggregate("edges", start, better).alias("state"))

    def earlier(ends: Column, _: Column) -> Column:
        first = F.element_at(ends, 1)
        return F.when(first > 1, F.concat(F.array(F.element_at(F.col("state"), first)["begin"]), ends)).otherwise(ends)

    # from the last position back to 1, positions of the state where an edge begins
    path = F.aggregate(F.sequence(F.lit(1), size), F.array(F.size("state")), earlier)
    return folded.select(*by, "word", *also, path.alias("cuts"))


#: Bytes of text in a chunk of ``encode_relational`` and for each shard that words are dealt to; most shards.
CHUNK, SHARD, SHARDS = 8 << 20, 1 << 20, 1 << 15


def chunked(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, pa.Table]]:
    """Rows (doc_id, text) in runs of about ``size`` bytes of text, each with a name made of its content."""

    def named(held: list[pa.RecordBatch]) -> tuple[int, pa.Table]:
        table = pa.Table.from_batches(held).combine_chunks()
        digest = xxhash.xxh3_64()
        for t in table.column(1).to_pylist():
            digest.update(b"\x00" if t is None else t.encode() + b"\xff")
        digest.update(str(table.column(0).to_pylist()))
        return digest.intdigest() - (1 << 63), table

    held, total = [], 0
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start, base = 0, 0
        while start < len(batch):
            last = int(np.searchsorted(ends, base + size - total, "left"))
            held.append(batch.slice(start, min(last, len(batch) - 1) - start + 1))
            if last >= len(batch):
                total += int(ends[-1]) - base
                break
            yield named(held)
            held, total, base, start = [], 0, int(ends[last]), last + 1
    if held:
        yield named(held)


def dealt(words: pa.StringArray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of the words of at most ``LONG`` characters, by shard and in order within it, and their shards."""
    short = np.flatnonzero(pc.utf8_length(words).to_numpy() <= LONG)
    data, starts = laid_out(words.take(pa.array(short)))
    if not len(short):
        return short, np.zeros(0, np.int32)
    within = np.arange(len(data)) - np.repeat(starts[:-1], np.diff(starts))
    mixed = np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * _POWERS[within], starts[:-1])
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    shard = ((mixed ^ (mixed >> np.uint64(32))) % np.uint64(shards)).astype(np.int32)
    order = np.argsort(shard, kind="stable")
    return short[order], shard[order]


#: A factor for each byte of a short word.
_POWERS = np.cumprod(np.full(4 * LONG, 0x9E3779B97F4A7C15, np.uint64))


def edges_of(words: pa.StringArray, cuts: bytes, pieces: Pieces) -> tuple[np.ndarray, np.ndarray] | None:
    """The ids of the words, one after the other, and how many each has; None where the cuts are not theirs.

    ``cuts`` has the characters of each edge as a sign, 64 up, and a blank between words.
    """
    if not len(words):
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    data, _ = laid_out(words)
    signs = np.frombuffer(cuts, np.uint8)
    blank = np.flatnonzero(signs == 32)
    many = np.diff(np.concatenate([[-1], blank, [len(signs)]])) - 1
    chars = signs[signs != 32].astype(np.int64) - 64
    heads = np.flatnonzero((data & 0xC0) != 0x80)
    if len(many) != len(words) or (many < 1).any() or chars.sum() != len(heads):
        return None
    starts = np.append(heads[np.cumsum(chars) - chars], len(data))
    edges = pa.StringArray.from_buffers(len(chars), pa.py_buffer(starts.astype(np.int32)), pa.py_buffer(data))
    place = pc.fill_null(pc.index_in(edges, value_set=pa.array(pieces.texts)), -1).to_numpy()
    known, size = place >= 0, np.diff(starts)
    each = np.where(known, 1, size)  # a character outside the table: its bytes
    ids = np.repeat(pieces.ids[place], each)
    other = ~known
    ids[runs((np.cumsum(each) - each)[other], size[other])] = pieces.bytes_[data[runs(starts[:-1][other], size[other])]]
    return ids, np.add.reduceat(each, np.cumsum(many) - many)


def undone(words: pa.StringArray, ids: np.ndarray, many: np.ndarray, pieces: Pieces) -> np.ndarray:
    """Whether what a word's ids stand for, joined, is not the word."""
    if not len(words):
        return np.zeros(0, bool)
    sizes = np.fromiter(map(len, pieces.raw), np.int64, len(pieces.raw))
    raw, begin = np.frombuffer(b"".join(pieces.raw), np.uint8), np.cumsum(sizes) - sizes
    data, starts = laid_out(words)
    back = raw[runs(begin[ids], sizes[ids])]
    ends = np.concatenate([[0], np.cumsum(sizes[ids])])[np.concatenate([[0], np.cumsum(many)])]
    if np.array_equal(ends, starts) and np.array_equal(back, data):
        return np.zeros(len(words), bool)
    return np.array([not np.array_equal(back[a:b], data[c:d]) for a, b, c, d in zip(ends[:-1], ends[1:], starts[:-1], starts[1:], strict=True)])


def encode_relational(df: DataFrame, model_path: str, *, key: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """What ``encode`` returns, with the lattice of all distinct words made by ``best_paths``.

    Runs of rows make chunks of about ``chunk`` bytes, which are shuffled once, packed.
    A chunk asks for its distinct words, those of ``finer``; these are dealt by a hash to
    shards, where each word is folded once for all chunks, and the cuts of its words come
    back to each chunk, in the order of the words, which need not come back themselves. Words of more
    than ``LONG`` characters are folded where the texts are; so are a chunk's words where
    no answer names it, as when a lost input came back in another order. The cuts are
    written to the shared folder. Decoding joins what the pieces stand for, so a text comes
    back if each of its words does, which is tried on every distinct word of a chunk. Null
    and empty texts have no ids; rows are handled one by one.
    """
    spark = df.sparkSession
    small_batches(spark)
    held = read_pieces(model_path)
    pieces = spark.sparkContext.broadcast(held)  # a fixed vocabulary
    rows = df.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    shards = min(SHARDS, max(8, size // SHARD))  # so many that a shard's edges are grouped in memory
    schema, key_type = rows.schema["doc_id"].dataType.simpleString(), to_arrow_type(rows.schema["doc_id"].dataType)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name_, table in chunked(batches, chunk):
            words = finer(table.column(1).to_pylist(), pieces.value)[0].unique()
            places, shard = dealt(words, shards)
            by, firsts = np.unique(shard, return_index=True)
            lists = pa.ListArray.from_arrays(pa.array(np.append(firsts, len(shard)), pa.int32()), words.take(pa.array(places)))
            yield pa.record_batch([pa.array(by, pa.int32()), pa.array([name_] * len(by), pa.int64()), pc.binary_join(lists, " ")], names=["shard", "chunk", "words"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name_, table in chunked(batches, chunk):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))) as out:
                out.write_table(table)
            yield pa.record_batch([pa.array([name_], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["chunk", "packed"])

    asked = rows.mapInArrow(ask, "shard int, chunk long, words string").repartition(shards, "shard").distinct()  # equal chunks ask once
    words = asked.select("shard", "chunk", F.posexplode(F.split("words", " ")).alias("at", "word")).groupBy("shard", "word").agg(F.collect_list(F.struct("chunk", "at")).alias("chunks"))
    paths = best_paths(words, held.table(spark), longest=held.longest, unknown=held.least - UNKNOWN, by=("shard",), carry="chunks")
    lengths = F.transform(F.sequence(F.lit(2), F.size("cuts")), lambda i: F.char(F.element_at("cuts", i) - F.element_at("cuts", i - 1) + 64))
    each = paths.select("shard", F.array_join(lengths, "").alias("cut"), F.inline("chunks"))
    answers = each.groupBy("shard", "chunk").agg(F.sort_array(F.collect_list(F.struct("at", "cut"))).alias("cuts"))
    with grouped_in_memory(spark):
        answers = written(answers.select("chunk", "shard", F.array_join(F.col("cuts")["cut"], " ").alias("cuts")), "cuts")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        p, tables = pieces.value, [pa.ipc.open_stream(b).read_all() for b in left["packed"].to_pylist()]
        if not tables:
            return pa.table({"doc_id": pa.array([], key_type), "ids": pa.array([], pa.list_(pa.int32())), "round_trip": pa.array([], pa.bool_())})
        table = pa.concat_tables(tables)
        all_, counts = finer(table.column(1).to_pylist(), p)
        coded = all_.dictionary_encode()
        words, spots = coded.dictionary, coded.indices.to_numpy()
        places, shard = dealt(words, shards)
        given = dict(zip(right["shard"].to_pylist(), right["cuts"].to_pylist(), strict=True))
        by, firsts, asked_ = np.unique(shard, return_index=True, return_counts=True)
        whole = np.array([given.get(s, "").count(" ") + 1 == n for s, n in zip(by.tolist(), asked_.tolist(), strict=True)], bool)
        answered = np.repeat(whole, asked_)
        found = edges_of(words.take(pa.array(places[answered])), " ".join(given[s] for s in by[whole].tolist()).encode(), p)
        if found is None:
            answered, found = np.zeros(len(places), bool), (np.zeros(0, np.int32), np.zeros(0, np.int64))
        # words without an answer, and long ones
        rest = np.concatenate([places[~answered], np.setdiff1d(np.arange(len(words)), places)]).astype(np.int64)
        unfolded = words.take(pa.array(rest)).to_pylist()
        missing = len(places) - int(answered.sum())
        raw = [*fold(unfolded[:missing], p), *(fold_long(w, p) for w in unfolded[missing:])]
        ids = np.concatenate([found[0], np.frombuffer(b"".join(raw), np.int32)])
        many = np.concatenate([found[1], np.fromiter(map(len, raw), np.int64, len(raw)) // 4])
        order = np.concatenate([places[answered], rest]).astype(np.int64)
        bad, back = undone(words.take(pa.array(order)), ids, many, p), np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        spots = back[spots]
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]), pa.int32()), pa.array(ids)).take(pa.array(spots))
        ends = np.concatenate([[0], np.cumsum(counts)])
        listed = pa.ListArray.from_arrays(lists.offsets.take(pa.array(ends)), lists.values)
        same = np.diff(np.concatenate([[0], np.cumsum(bad[spots])])[ends]) == 0
        return pa.table({"doc_id": table.column(0), "ids": listed, "round_trip": pa.array(same, pa.bool_())})

    packed = rows.mapInArrow(pack, "chunk long, packed binary")
    return packed.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(meet, f"doc_id {schema}, ids array<int>, round_trip boolean")


@contextmanager
def grouped_in_memory(spark: SparkSession):
    """Lists of a shard's words are gathered in a hash table, which ``SHARD`` bounds, and not sorted; the setting is put back."""
    name_ = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
    before = spark.conf.get(name_)
    spark.conf.set(name_, str(1 << 16))
    try:
        yield
    finally:
        spark.conf.set(name_, before)
