"""Exact substring dedup by bucket-pointer refinement, without a global suffix array.

The removal rule needs only the order of suffixes down to ``length`` bytes, and of
that only which suffixes fall in one bucket. Buckets are named, not numbered: a
position's first bucket is its eight bytes, and the bucket of a longer prefix is
a mix of the buckets of two later offsets, each refined before (8, 16, 24, 48,
96, 100 bytes). Equal strings get equal names wherever they are, so no sort of all
positions is needed.

To keep the shuffle far below one row a byte, each string of ``length`` bytes is
assigned to its *anchor*, the least 24-byte bucket within it. Consecutive strings
of one anchor form a group. Groups meet by anchor (an initial q-gram bucket); of
groups that are equal as a whole the first stays, and if no other group has the
anchor its strings are all distinct. Only what is left, groups that share an anchor
but differ, is refined: first to blocks of eight strings, which meet by the 93 bytes
that all of them have, and of these only what differs still to single strings. The
first string of each final bucket is kept, every later one is removed.

Names are 64-bit hashes; two strings are taken as equal only if 128 bits agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gaugeline.llm.common import checked_broadcast, small_batches

#: Bytes of a string whose repetition counts, and of the anchors within it.
LENGTH, GRAM = 100, 24
#: Strings of a block, and the bytes that all of them have.
BLOCK, CORE = 8, LENGTH - 7
#: Bytes of text that a task holds at once.
CHUNK = 2 << 20
#: Rows that repeat a key are dealt by so many bits of a hash of their text; the rest of a place counts bytes.
DEALT, OFFSET = 14, 39

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


def _mix(a: np.ndarray, b: np.ndarray, salt: int = 0) -> np.ndarray:
    """A name for the pair of two names."""
    x = a * _M1
    x ^= x >> np.uint64(32)
    x += b
    x += np.uint64(salt)
    x *= _M2
    x ^= x >> np.uint64(29)
    x *= _M3
    x ^= x >> np.uint64(32)
    return x


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as one number, zero past the end."""
    padded = np.zeros(len(data) + 16, np.uint8)
    padded[: len(data)] = data
    out = np.empty(-(-len(data) // 8) * 8 + 8, np.uint64)
    for k in range(8):
        whole = padded[k : k + (len(data) - k + 7) // 8 * 8] if k < len(data) else padded[:0]
        seen = whole[: len(whole) // 8 * 8].view("<u8")
        out[k : k + 8 * len(seen) : 8] = seen
    return out[: len(data)]


def grams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 8-byte and the 24-byte bucket of each position; the latter only where 24 bytes follow."""
    b8 = eights(data)
    n = max(0, len(data) - GRAM + 1)
    b16 = _mix(b8[:n], b8[8 : 8 + n])
    return b8, _mix(b16, b8[16 : 16 + n])


def string_names(b24: np.ndarray, at: np.ndarray, salt: int = 0) -> np.ndarray:
    """The bucket of the 100 bytes from each of the given positions."""
    b48 = _mix(b24[at], b24[at + 24], salt)
    b96 = _mix(b48, _mix(b24[at + 48], b24[at + 72], salt), salt)
    return _mix(b96, b24[at + LENGTH - GRAM], salt)


def anchors(b24: np.ndarray) -> np.ndarray:
    """For each string the position of its least 24-byte bucket, the first on ties.

    The sliding minimum takes names' upper halves over positions, doubling the
    reach with each pass.
    """
    span = LENGTH - GRAM + 1
    packed = (b24 & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(b24), dtype=np.uint64)
    reach = 1
    while 2 * reach <= span:
        packed = np.minimum(packed[:-reach], packed[reach:])
        reach *= 2
    if span > reach:
        packed = np.minimum(packed[: len(packed) - (span - reach)], packed[span - reach :])
    return (packed & np.uint64(0xFFFFFFFF)).astype(np.int64)


class Text:
    """Whole texts laid end to end, with the strings that stay within one text."""

    def __init__(self, texts: list[bytes], bases: list[int]):
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        sizes = np.array([len(t) for t in texts], np.int64)
        self.starts = np.r_[0, np.cumsum(sizes)][:-1]
        self.sizes, self.shift = sizes, np.array(bases, np.int64) - self.starts

    def groups(self) -> tuple[np.ndarray, ...]:
        """Of each group of strings with one anchor: text, first and last string, anchor's bucket, the group's name; then all 24-byte buckets."""
        none = np.zeros(0, np.int64)
        if len(self.data) < LENGTH:
            return none, none, none, none.view(np.uint64), none.view(np.uint64), none.view(np.uint64)
        _, b24 = grams(self.data)
        anchor = anchors(b24)
        strings = np.maximum(self.sizes - LENGTH + 1, 0)
        owner = np.repeat(np.arange(len(strings)), strings)
        at = np.arange(len(owner)) + np.repeat(self.starts - np.r_[0, np.cumsum(strings)][:-1], strings)
        anchor = anchor[at]
        new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])]) if len(at) else none
        first, last = at[new], at[np.r_[new[1:], len(at)] - 1] if len(at) else none
        name = _mix(string_names(b24, first), string_names(b24, last), 1) + (last - first).astype(np.uint64)
        return owner[new], first, last, b24[anchor[new]], name, b24


def _chunks(batches: Iterator[pa.RecordBatch], size: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Rows with their texts (second column) in bytes, some megabytes at a time."""
    for batch in batches:
        at, held, texts = 0, 0, []
        column = batch.column(1)
        for i in range(len(batch)):
            t = column[i]
            raw = t.as_buffer().to_pybytes() if t.is_valid else b""
            texts.append(raw)
            held += len(raw)
            if held >= size:
                yield batch.slice(at, i + 1 - at), texts
                at, held, texts = i + 1, 0, []
        if texts:
            yield batch.slice(at), texts


def _ranks(keys: pa.Array) -> np.ndarray:
    """Places of keys in order, equal for equal keys, null first."""
    return pc.rank(keys, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy(zero_copy_only=False).astype(np.int64)


def _leads(keys: list[np.ndarray], doc: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows equal in all keys the earliest; and whether another row has the same first key."""
    order = np.lexsort((first, doc, *keys[::-1]))
    sets = [k[order] for k in keys]
    lead = order[np.r_[True, np.any([k[1:] != k[:-1] for k in sets], axis=0)]] if len(order) else order
    k = keys[0][lead]
    same = k[1:] == k[:-1]
    return lead, np.r_[same, False] | np.r_[False, same] if len(lead) else np.zeros(0, bool)


# A place packs in a long, from the top: first string, strings less one (7 bits), whether others share the anchor.


def _emit_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each group; of groups that are equal within a chunk only the first, and a mark where an anchor has several.

    Groups known to differ from another with the same anchor are dealt by anchor
    and name, with one mark a chunk for the anchor itself: so not even an anchor
    that a large part of the corpus has brings many rows into one task.
    """
    for rows, texts in _chunks(batches):
        text = Text(texts, rows.column(2).to_pylist())
        owner, first, last, anchor, name, _ = text.groups()
        if not len(first):
            continue
        start = first + text.shift[owner]
        lead, twin = _leads([anchor, name], _ranks(rows.column(0))[owner], start)
        lone, apart = lead[~twin], lead[twin]
        marks = np.unique(anchor[apart])
        taken = np.r_[lone, apart]
        place = start[taken] << 8 | (last - first)[taken] << 1 | np.r_[np.zeros(len(lone), np.int64), np.ones(len(apart), np.int64)]
        yield pa.record_batch(
            [
                pa.array(np.r_[anchor[lone], _mix(anchor[apart], name[apart], 2), marks].view(np.int64)),
                pa.array(np.r_[name[taken].view(np.int64), np.zeros(len(marks), np.int64)]),
                pa.concat_arrays([rows.column(0).take(pa.array(owner[taken])), pa.nulls(len(marks), rows.column(0).type)]),
                pa.array(np.r_[place, np.full(len(marks), -1)]),
            ],
            names=["anchor", "name", "doc", "place"],
        )


def blocks_of(text: Text, owner: np.ndarray, first: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, ...]:
    """The blocks of groups: text, first string, strings less one, core, bytes before and after the core.

    Blocks lie at fixed steps from the anchor, so equal strings are in blocks
    with the same core. A block that begins or ends within a step has the bytes
    of its own strings only; the top byte of ``after`` is where it begins.
    """
    b8, b24 = grams(text.data)
    origin = anchors(b24)[first] - (LENGTH - GRAM)
    low, high = (first - origin) // BLOCK, (first + more - origin) // BLOCK
    count = high - low + 1
    group = np.repeat(np.arange(len(first)), count)
    step = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + low[group]
    begin = origin[group] + step * BLOCK
    own_first = np.maximum(first[group], begin)
    own_last = np.minimum((first + more)[group], begin + BLOCK - 1)
    skip, upto = (own_first - begin).astype(np.uint64), (own_last - begin).astype(np.uint64)
    eight, one = np.uint64(8), np.uint64(1)
    before = (b8[own_first] & ((one << (eight * (np.uint64(BLOCK - 1) - skip))) - one)) << (eight * skip)
    after = b8[np.minimum(begin + LENGTH, len(b8) - 1)] & ((one << (eight * upto)) - one) | skip << np.uint64(56)
    at = begin + BLOCK - 1
    core = _mix(_mix(b24[at], b24[at + 24]), _mix(b24[at + 48], b24[at + CORE - GRAM]), 3)
    core = _mix(core, step.astype(np.uint64), 4)
    return owner[group], own_first, own_last - own_first, core, before, after


def _emit_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each block of the groups to be refined, told apart and marked as groups are."""
    for rows, texts in _chunks(batches):
        text = Text(texts, rows.column(2).to_pylist())
        if len(text.data) < LENGTH:
            continue
        owner, first, more = [], [], []
        for i, places in enumerate(rows.column(3)):
            found = places.values.to_numpy(zero_copy_only=False)
            found = found[(found & 1) == 1]
            at = (found >> 8) - text.shift[i]
            own = (at >= text.starts[i]) & (at < text.starts[i] + text.sizes[i])  # rows of one home share their places
            first.append(at[own])
            more.append(found[own] >> 1 & 127)
            owner.append(np.full(len(first[-1]), i))
        owner, first, more = (np.concatenate(x) for x in (owner, first, more))
        if not len(first):
            continue
        owner, first, more, core, before, after = blocks_of(text, owner, first, more)
        start = first + text.shift[owner]
        lead, twin = _leads([core, before, after], _ranks(rows.column(0))[owner], start)
        lone, apart = lead[~twin], lead[twin]
        marks = np.unique(core[apart])
        taken, none = np.r_[lone, apart], np.zeros(len(marks), np.int64)
        place = start[taken] << 8 | more[taken] << 1 | np.r_[np.zeros(len(lone), np.int64), np.ones(len(apart), np.int64)]
        yield pa.record_batch(
            [
                pa.array(np.r_[core[lone], _mix(_mix(core[apart], before[apart]), after[apart]), marks].view(np.int64)),
                *(pa.array(np.r_[x[taken].view(np.int64), none]) for x in (core, before, after)),
                pa.concat_arrays([rows.column(0).take(pa.array(owner[taken])), pa.nulls(len(marks), rows.column(0).type)]),
                pa.array(np.r_[place, none - 1]),
            ],
            names=["anchor", "core", "before", "after", "doc", "place"],
        )


def removed_runs(size: int, base: int, places: np.ndarray) -> list[tuple[int, int]]:
    """Maximal removed runs [start, end) of a text from the places of its strings that stay."""
    strings = size - LENGTH + 1
    if strings <= 0:
        return []
    steps = np.zeros(strings + 1, np.int64)
    first, more = (places >> 8) - base, places >> 1 & 127
    mine = ((places & 1) == 0) & (first >= 0) & (first < strings)
    np.add.at(steps, first[mine], 1)
    np.add.at(steps, np.minimum(first[mine] + more[mine] + 1, strings), -1)
    gone = np.cumsum(steps[:-1]) <= 0
    edge = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
    runs: list[tuple[int, int]] = []
    for start, end in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        end += LENGTH - 1
        if runs and start <= runs[-1][1]:
            runs[-1] = (runs[-1][0], end)
        else:
            runs.append((start, end))
    return runs


def _cut_texts(batches: Iterator[pa.RecordBatch], whole_characters: bool) -> Iterator[pa.RecordBatch]:
    none = np.zeros(0, np.int64)
    tidy = (lambda piece: piece.decode("utf-8", "ignore").encode()) if whole_characters else bytes
    for rows, texts in _chunks(batches):
        bases, kept, spans, gone = rows.column(2).to_pylist(), [], [], []
        for i, raw in enumerate(texts):
            found = [rows.column(c)[i] for c in (3, 4)]
            runs = removed_runs(len(raw), bases[i], np.concatenate([x.values.to_numpy(zero_copy_only=False) if x.is_valid else none for x in found]))
            left, at = [], 0
            for start, end in runs:
                left.append(tidy(raw[at:start]))
                at = end
            kept.append(b"".join([*left, tidy(raw[at:])]) if runs else raw)
            spans.append([{"start": s, "end": e} for s, e in runs])
            gone.append(sum(e - s for s, e in runs))
        yield pa.record_batch(
            [rows.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary()), rows.column(5)],
            names=["doc_id", "n_bytes", "n_removed", "spans", "kept", "carried"],
        )


def _earliest(rows: DataFrame, names: list[str]) -> DataFrame:
    """Of rows equal in anchor and names the earliest; the last bit of its place says whether others have the anchor."""
    met = rows.repartition("anchor").groupBy("anchor", *names).agg(F.min(F.when(F.col("place") >= 0, F.struct("doc", "place"))).alias("least"), F.max(F.col("place").bitwiseAND(F.lit(1))).alias("shared"))
    of_anchor = Window.partitionBy("anchor")
    refine = F.greatest((F.count(F.lit(1)).over(of_anchor) > 1).cast("long"), F.max("shared").over(of_anchor))
    return met.withColumn("refine", refine).where(F.col("least").isNotNull()).select("least.doc", F.col("least.place").bitwiseAND(F.lit(-2)).bitwiseOR(F.col("refine")).alias("place"), *names)


def _earliest_strings(blocks: DataFrame) -> DataFrame:
    """Places of the first of equal strings, of blocks that share a core but differ.

    A string is named by the core, where it begins in its block, and its own
    bytes before and after the core.
    """
    skip = F.shiftrightunsigned("after", 56)
    more = F.shiftright("place", 1).bitwiseAND(F.lit(127))
    each = blocks.select("doc", "core", "before", "after", (F.shiftright("place", 8) - skip).alias("begin"), F.explode(F.sequence(skip, skip + more)).alias("j"))
    bits = (F.col("j") * 8).cast("int")
    own = each.withColumn("b", F.call_function("shiftrightunsigned", "before", bits)).withColumn("a", F.col("after").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1))
    named = own.select("doc", (F.col("begin") + F.col("j")).alias("first"), F.xxhash64("core", "j", "b", "a").alias("k1"), F.xxhash64("a", "b", "j", "core", F.lit(1)).alias("k2"))
    return named.groupBy("k1", "k2").agg(F.min(F.struct("doc", "first")).alias("least")).select("least.doc", F.shiftleft("least.first", 8).alias("place"))


def dedup_substrings(df: DataFrame, *, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = (), whole_characters: bool = False) -> DataFrame:
    """Every row without the bytes of 100-byte strings that also start earlier.

    Returns doc_id, n_bytes, n_removed, spans (removed runs, array of start and
    end), kept (the other bytes, binary) and ``carried``, a struct of the columns
    named in ``carry``. Earlier means a smaller key, null first; rows with one
    key are ordered by ``DEALT`` bits of a hash of their text, then by text, and
    stay separate texts, so of equal rows the first is kept whole, and no task has
    to hold all rows of a key. Null text counts as empty. An empty table gives no rows. With
    ``whole_characters`` the bytes of a character that a cut leaves in part go too,
    so that ``kept`` is UTF-8; counts and spans stay those of the rule.

    Texts are shuffled once, by key; every later step reads that shuffle again.
    """
    small_batches(df.sparkSession)
    carried = F.struct(*([F.col(c) for c in carry] or [F.lit(None).cast("int").alias("none")])).alias("carried")
    rows = df.select(F.col(key).alias("doc"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"), carried)
    kind = rows.schema["doc"].dataType.simpleString()
    # rows are brought together by a hash of the key and of some bits of the text; keys that share one only share a numbering
    repeated = df.groupBy(F.col(key).alias("again")).agg(F.count(F.lit(1)).alias("times")).where(F.col("times") > 1)
    rows = rows.join(checked_broadcast(repeated), F.col("doc").eqNullSafe(F.col("again")), "left")
    bits = F.when(F.col("times") > 1, F.xxhash64("text").bitwiseAND(F.lit((1 << DEALT) - 1))).otherwise(F.lit(0).cast("long"))
    rows = rows.select("doc", "text", "carried", bits.alias("bits"))
    bits = F.col("bits")
    rows = rows.withColumn("home", F.xxhash64("doc", bits))
    home_of = F.xxhash64("doc", F.shiftright("place", OFFSET + 8))
    earlier = Window.partitionBy("home").orderBy("doc", "text").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("base", F.shiftleft(bits, OFFSET) + F.coalesce(F.sum(F.octet_length("text").cast("long")).over(earlier), F.lit(0).cast("long")))

    # carried columns go along everywhere, else each step would shuffle texts anew without them
    along = ["carried"] if carry else []
    groups = rows.select("doc", "text", "base", *along).mapInArrow(_emit_groups, f"anchor long, name long, doc {kind}, place long")
    firsts = _earliest(groups, ["name"]).select(home_of.alias("home"), "place")
    places = firsts.groupBy("home").agg(F.collect_list("place").alias("places"))

    placed = rows.join(places, "home", "left")
    refined = placed.where(F.exists("places", lambda p: p.bitwiseAND(F.lit(1)) == 1)).select("doc", "text", "base", "places", *along)
    blocks = _earliest(refined.mapInArrow(_emit_blocks, f"anchor long, core long, before long, after long, doc {kind}, place long"), ["core", "before", "after"])
    whole = blocks.where(F.col("place").bitwiseAND(F.lit(1)) == 0).select("doc", "place")
    finer = whole.union(_earliest_strings(blocks.where(F.col("place").bitwiseAND(F.lit(1)) == 1)))
    finer = finer.groupBy(home_of.alias("home")).agg(F.collect_list("place").alias("finer"))

    joined = placed.join(finer, "home", "left").select("doc", "text", "base", "places", "finer", "carried")
    fields = joined.schema["carried"].dataType.simpleString()
    return joined.mapInArrow(lambda batches: _cut_texts(batches, whole_characters), f"doc_id {kind}, n_bytes long, n_removed long, spans array<struct<start:bigint,end:bigint>>, kept binary, carried {fields}")
