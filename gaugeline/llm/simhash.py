"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint's bits are the majority of the bits of its shingles' hashes. Two
fingerprints that differ in at most ``distance`` bits agree in all but
``distance`` of ``blocks`` blocks of bits, so they meet in the bucket of some
choice of ``blocks - distance`` blocks. In each bucket the Hamming distance is
verified, and links join documents to components.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gaugeline.llm.common import checked_broadcast, cut, small_batches, spread_join
from gaugeline.llm.components import components

SEED = 42
#: Buckets up to this size compare all their pairs; larger ones grow trees.
SMALL = 8
#: Buckets of more nodes are cut into chunks of about so many, and every two chunks meet in a task of their own.
CHUNK = 1 << 18
#: Groups of texts of more words are cut into chunks of about so many, and every two chunks meet in a task of their own.
WORDS = 1 << 20
#: Groups of least hashes that make a candidate where all of one agree, and hashes a group.
BANDS, ROWS = 24, 6


def shingle_hashes(text: str | None, n: int) -> list[int]:
    """XXH64 of each run of n words, blanks joined, A-Z lower-cased; of all words if fewer."""
    found = (text or "").encode().lower().split()
    if not found:
        return []
    joined = b" ".join(found)
    if len(found) <= n:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    ends = list(accumulate((len(w) + 1 for w in found), initial=-1))
    of = xxhash.xxh64_intdigest
    return [of(joined[s + 1 : e], SEED) for s, e in zip(ends, ends[n:])]  # noqa: B905  ends short by n on purpose


def majority(hashes: list[int]) -> int:
    """The bits set in over half of the hashes; zero of none."""
    if not hashes:
        return 0
    rows = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(rows), 8192):
        ones += np.unpackbits(rows[at : at + 8192], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = 4) -> DataFrame:
    """Each row's key with the 64-bit fingerprint of its whole text, as a signed long.

    Null and empty texts have fingerprint zero. Rows are handled one by one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [majority(shingle_hashes(t.as_py(), shingle)) for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    small_batches(df.sparkSession)
    rows = df.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def block_masks(blocks: int, distance: int) -> list[int]:
    """For each choice of ``blocks - distance`` of the blocks, a mask of their bits."""
    if not distance < blocks <= 64:
        raise ValueError("there must be more blocks than differing bits")
    edges = [64 * i // blocks for i in range(blocks + 1)]
    each = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(each, blocks - distance)]


def tree(found: np.ndarray, distance: int) -> tuple[list[int], list[int]]:
    """Links (positions) that join whatever of the fingerprints is joined by links within the distance.

    A breadth-first walk compares each fingerprint with those not reached yet
    only, so a cluster of any size gives one link less than it has members.
    """
    a, b = [], []
    left = np.arange(len(found))
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(found[left] ^ found[at]) <= distance
            reached = left[near]
            if len(reached):
                a += [at] * len(reached)
                b += reached.tolist()
                queue += reached.tolist()
                left = left[~near]
    return a, b


def bucket_links(choice: np.ndarray, found: np.ndarray, block: np.ndarray, masks: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (positions) within the buckets of rows sorted by (choice, bucket, block)."""
    bucket = found & masks[choice]
    starts = np.flatnonzero(np.r_[True, (choice[1:] != choice[:-1]) | (bucket[1:] != bucket[:-1]) | (block[1:] != block[:-1])]) if len(found) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[starts, len(found)])
    group = np.repeat(np.arange(len(starts)), sizes)
    few = np.repeat((sizes > 1) & (sizes <= SMALL), sizes)
    a, b = [], []
    for step in range(1, SMALL):
        at = np.flatnonzero(few[:-step] & (group[:-step] == group[step:]))
        at = at[np.bitwise_count(found[at] ^ found[at + step]) <= distance]
        a.append(at)
        b.append(at + step)
    for start, size in zip(starts[sizes > SMALL], sizes[sizes > SMALL], strict=True):
        near = tree(found[start : start + size], distance)
        a.append(np.array(near[0], np.int64) + start)
        b.append(np.array(near[1], np.int64) + start)
    return np.concatenate(a).astype(np.int64), np.concatenate(b).astype(np.int64)


def meetings(node: Column, parts: Column) -> Column:
    """The blocks that a node goes to, so that any two nodes meet in one: a block for each pair of parts."""
    own = F.pmod(F.xxhash64(node), parts).cast("int")
    meets = F.transform(F.sequence(F.lit(0), parts - 1), lambda k: F.least(own, k) * parts + F.greatest(own, k))
    return F.when(parts == 1, F.array(F.lit(0))).otherwise(meets)


def links(nodes: DataFrame, *, distance: int = 4, blocks: int = 7, chunk: int = CHUNK) -> DataFrame:
    """Links (a, b) of nodes with fingerprints (columns ``node``, ``fp``), enough to join all that are within the distance.

    Each node goes to one bucket a choice of blocks; rows arrive sorted, so a
    task holds one bucket at a time, seventeen bytes a node. A bucket of more
    than ``chunk`` nodes is cut into chunks, and each pair of chunks (a chunk
    with itself too) is a bucket of its own, so that no task holds more than two
    chunks and no pair is lost. In a bucket of many nodes the walk starts at the
    first in the order of ``node``.
    """
    masks = block_masks(blocks, distance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.array(masks, np.uint64)
        held: list[tuple[np.ndarray, ...]] = []  # the rows of the last bucket and block so far

        def out(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
            choice, found, node, block = (np.concatenate(x) for x in zip(*parts, strict=True))
            a, b = bucket_links(choice, found, block, table, distance)
            if len(a):
                yield pa.record_batch([pa.array(node[a]), pa.array(node[b])], names=["a", "b"])

        for batch in batches:
            if not len(batch):
                continue
            choice, found, node, block = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            found = found.view(np.uint64)
            bucket = found & table[choice]
            starts = np.flatnonzero((choice[1:] != choice[:-1]) | (bucket[1:] != bucket[:-1]) | (block[1:] != block[:-1])) + 1
            if held and (held[-1][0][-1] != choice[0] or held[-1][1][-1] & table[held[-1][0][-1]] != bucket[0] or held[-1][3][-1] != block[0]):
                yield from out(held)
                held = []
            if len(starts):
                yield from out([*held, tuple(x[: starts[-1]] for x in (choice, found, node, block))])
                held = []
                choice, found, node, block = (x[starts[-1] :] for x in (choice, found, node, block))
            held.append((choice, found, node, block))
        if held:
            yield from out(held)

    signed = F.array(*map(F.lit, np.array(masks, np.uint64).view(np.int64).tolist()))
    bucket = F.col("fp").bitwiseAND(F.element_at(signed, F.col("choice") + 1))
    dealt = nodes.select("node", "fp", F.explode(F.sequence(F.lit(0), F.lit(len(masks) - 1))).alias("choice"))
    large = dealt.groupBy("choice", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > chunk)
    dealt = dealt.withColumn("bucket", bucket).join(checked_broadcast(large), ["choice", "bucket"], "left")
    dealt = dealt.withColumn("parts", F.coalesce(F.ceil(F.col("n") / chunk), F.lit(1)).cast("int"))
    dealt = dealt.select("choice", "fp", "node", F.explode(meetings(F.col("node"), F.col("parts"))).alias("block"))
    # the bucket is made again behind the shuffle rather than sent
    dealt = dealt.repartition("choice", bucket, "block").withColumn("bucket", bucket).sortWithinPartitions("choice", "bucket", "block", "node")
    return dealt.select(F.col("choice").cast("long"), "fp", "node", F.col("block").cast("long")).mapInArrow(run, "a long, b long")


def near_duplicates(df: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = 4, distance: int = 4, blocks: int = 7) -> DataFrame:
    """Every row's key, fingerprint (signed long) and component: the least key that links reach.

    Rows of one fingerprint are linked; all work past fingerprints is on
    distinct ones. A null key takes part, but never names a component unless
    all keys of a component are null. An empty table gives no rows.
    """
    found = cut(fingerprints(df, key=key, text=text, shingle=shingle))
    distinct = cut(found.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    total, texts = found.count(), distinct.count()
    joined = components(links(distinct.select(F.col("fp").alias("node"), "fp"), distance=distance, blocks=blocks))
    members = joined.join(distinct, joined["node"] == distinct["fp"]).select("fp", "root", "least")
    names = members.groupBy("root").agg(F.min("least").alias("component"), F.count(F.lit(1)).alias("n"))
    named = spread_join(members, names, "root", texts).select("fp", "component")
    whole = distinct.join(named, "fp", "left").select("fp", F.coalesce("component", "least").alias("component_id"), "n")
    return spread_join(found, whole, "fp", total).select("doc_id", "fp", "component_id")


def band_keys(hashes: list[int], bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """For each band a 64-bit mix of the least values of the hashes under ``rows`` of its own multipliers; none of no hashes.

    Two sets agree in one such value with a probability of their Jaccard
    similarity, whatever their sizes and wherever they differ.
    """
    if not hashes:
        return np.zeros(0, np.uint64)
    rng = np.random.default_rng(SEED)
    factors = rng.integers(0, 1 << 63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)
    offsets = rng.integers(0, 1 << 63, bands * rows, np.uint64)
    x = np.array(hashes, np.uint64)
    least = np.full(bands * rows, np.iinfo(np.uint64).max)
    for at in range(0, len(x), 2048):
        least = np.minimum(least, (x[None, at : at + 2048] * factors[:, None] + offsets[:, None]).min(axis=1))
    return np.array([xxhash.xxh64_intdigest(band.tobytes(), k) for k, band in enumerate(least.reshape(bands, rows))], np.uint64)


def word_fingerprints(df: DataFrame, seeds: tuple[int, ...], shingle: int) -> DataFrame:
    """Rows of (doc_id, digest, text) with fingerprints ``fp0``, ``fp1``... of the set of the text's words, one a seed, the number of words and the band keys of the runs of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, sizes, bands = [], [], []
            for t in batch.column(2):
                bands.append(band_keys(shingle_hashes(t.as_py(), shingle)).view(np.int64))
                words = (t.as_py() or "").encode().lower().split()
                distinct = set(words)
                found.append([majority([xxhash.xxh64_intdigest(w, seed) for w in distinct]) for seed in seeds])
                sizes.append(len(words))
            each = np.array(found, np.uint64).reshape(-1, len(seeds)).view(np.int64)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64())), *(pa.array(each[:, k].copy()) for k in range(len(seeds)))], names=["doc_id", "digest", "words", "bands", *(f"fp{k}" for k in range(len(seeds)))])

    fields = ", ".join(f"fp{k} long" for k in range(len(seeds)))
    return df.select("doc_id", "digest", "text").mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, digest binary, words long, bands array<long>, {fields}")


def shingle_sets(df: DataFrame, *, shingle: int) -> DataFrame:
    """For each row of (root, blocks, node, row) the distinct 64-bit hashes of the runs of words of the row's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(np.array(shingle_hashes(t.as_py(), shingle), np.uint64)).view(np.int64) for t in batch.column(3).field("text")]
            yield pa.record_batch([*(batch.column(i) for i in range(3)), pa.array(sets, pa.list_(pa.int64()))], names=["root", "blocks", "node", "shingles"])

    return df.select("root", "blocks", "node", "row").mapInArrow(run, "root long, blocks array<int>, node long, shingles array<long>")


def similar_tree(flat: np.ndarray, sizes: np.ndarray, similarity: float) -> tuple[list[int], list[int]]:
    """Links (positions) that join whatever of the sets is joined by pairs of the Jaccard similarity or more.

    The sets lie one after the other in ``flat``. A set is reached by a verified
    link only, and is compared until then with every set that was reached or began a walk.
    """
    _, ids = np.unique(flat, return_inverse=True)
    holders = np.repeat(np.arange(len(sizes)), sizes)[np.argsort(ids, kind="stable")]
    ends = np.cumsum(np.bincount(ids)) if len(ids) else np.zeros(0, np.int64)
    begins = np.r_[0, ends[:-1]] if len(ends) else ends
    place = np.r_[0, np.cumsum(sizes)]
    a, b = [], []
    left = np.arange(len(sizes))
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            mine = ids[place[at] : place[at + 1]]
            lists = [holders[x:y] for x, y in zip(begins[mine], ends[mine], strict=True)]
            shared = np.bincount(np.concatenate(lists), minlength=len(sizes))[left] if lists else np.zeros(len(left), np.int64)
            near = shared >= similarity * (sizes[at] + sizes[left] - shared)
            reached = left[near]
            if len(reached):
                a += [at] * len(reached)
                b += reached.tolist()
                queue += reached.tolist()
                left = left[~near]
    return a, b


def similar_links(sets: DataFrame, *, similarity: float) -> DataFrame:
    """Links (a, b), enough to join all sets (root, block, node, shingles) of one root and block that pairs of the similarity join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the rows of the last root and block so far

        def out(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            node = np.concatenate([p.column(2).to_numpy() for p in parts])
            flat = np.concatenate([p.column(3).flatten().to_numpy() for p in parts])
            sizes = np.concatenate([p.column(3).value_lengths().to_numpy() for p in parts]).astype(np.int64)
            a, b = similar_tree(flat, sizes, similarity)
            if len(a):
                yield pa.record_batch([pa.array(node[a]), pa.array(node[b])], names=["a", "b"])

        for batch in batches:
            if not len(batch):
                continue
            root, block = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if held and (held[-1].column(0)[-1].as_py() != root[0] or held[-1].column(1)[-1].as_py() != block[0]):
                yield from out(held)
                held = []
            edges = [0, *(np.flatnonzero((root[1:] != root[:-1]) | (block[1:] != block[:-1])) + 1).tolist()]
            for start, end in zip(edges, edges[1:], strict=False):
                yield from out([*held, batch.slice(start, end - start)])
                held = []
            held.append(batch.slice(edges[-1]))
        if held:
            yield from out(held)

    dealt = sets.repartition("root", "block").sortWithinPartitions("root", "block", "node")
    return dealt.select("root", "block", "node", "shingles").mapInArrow(run, "a long, b long")


def named(key: Column, digest: Column) -> Column:
    """128 bits that stand for a key, null or not, and a text's digest."""
    held = F.coalesce(F.concat(F.lit(b"k"), key.cast("string").cast("binary")), F.lit(b"n"))
    return F.unhex(F.md5(F.concat(digest, held)))


def one_of_each(df: DataFrame, *, shingle: int = 5, similarity: float = 0.8, distance: int = 5, blocks: int = 8, seeds: tuple[int, ...] = (SEED,), chunk: int = WORDS) -> DataFrame:
    """The rows, whole, less near-duplicates: of each group of linked documents the one with the least key stays.

    Equal texts, by 128 bits, are linked. Texts whose sets of words have
    fingerprints, of any seed, that differ in at most ``distance`` bits are joined
    to groups, as are texts whose sets of runs agree in a band of least hashes,
    and in a group all texts are linked whose sets of ``shingle``-word runs have,
    verified on 64-bit hashes, a Jaccard similarity of ``similarity`` or more; a
    group of more than ``chunk`` words is cut into chunks that meet in pairs.
    Words rather than runs make the fingerprint, since one changed word changes
    ``shingle`` runs and so about five times the share of what the fingerprint
    sums up. A passage more or less moves a fingerprint further, at the same
    similarity; such pairs are found by the bands, of which two texts of
    similarity 0.8 share one with a probability of 0.999. Texts without words are
    one group. A null key counts as the greatest; of rows that agree in key and
    text any one stays. Other columns go along, whatever they are called; an empty
    table gives no rows.

    Rows are shuffled once; the sets of runs and the rows that stay are both made
    from that shuffle.
    """
    small_batches(df.sparkSession)
    digest = F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    found = word_fingerprints(df.select("doc_id", digest.alias("digest"), "text"), seeds, shingle)
    found = found.groupBy("digest").agg(F.min("doc_id").alias("least"), F.min("words").alias("words"), F.min("bands").alias("bands"), *(F.min(f"fp{k}").alias(f"fp{k}") for k in range(len(seeds))))
    found = cut(found.withColumn("node", F.monotonically_increasing_id()))  # written, so a node keeps its number
    total = found.count()
    rows = df.select(F.struct("*").alias("row"), named(F.col("doc_id"), digest).alias("home"))
    rows = rows.withColumn("first", F.row_number().over(Window.partitionBy("home").orderBy("home"))).where(F.col("first") == 1)

    near = reduce(DataFrame.union, (links(found.select("node", F.col(f"fp{k}").alias("fp")), distance=distance, blocks=blocks) for k in range(len(seeds))))
    near = near.union(links(found.select("node", F.explode("bands").alias("fp")), distance=0, blocks=1))
    groups = components(near).join(found, "node").select("root", "node", "words", named(F.col("least"), F.col("digest")).alias("home"))
    large = groups.groupBy("root").agg(F.sum("words").alias("n")).where(F.col("n") > chunk)
    parted = groups.join(checked_broadcast(large), "root", "left").withColumn("parts", F.coalesce(F.ceil(F.col("n") / chunk), F.lit(1)).cast("int"))
    dealt = parted.select("root", "home", "node", meetings(F.col("node"), F.col("parts")).alias("blocks"))
    sets = shingle_sets(rows.join(dealt, "home"), shingle=shingle).select("root", F.explode("blocks").alias("block"), "node", "shingles")
    close = similar_links(sets, similarity=similarity)
    members = cut(components(close).join(found, "node").select("node", "root", F.struct(F.col("least").isNull().alias("null"), "least", "node").alias("place")))
    firsts = members.groupBy("root").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    losers = spread_join(members, firsts, "root", total).where(F.col("node") != F.col("first.node")).select("node")
    kept = found.join(losers, "node", "left_anti").select(named(F.col("least"), F.col("digest")).alias("home"))
    return rows.join(kept, "home", "left_semi").select("row.*")


def hexadecimal(fp: Column) -> Column:
    """Sixteen lower-case digits of a fingerprint."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
