import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gaugeline.llm import simhash
from gaugeline.llm.components import components


def plain(text, n=4):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    s = [" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def reach(ids, fps, distance=4):
    """Component by brute force."""
    out = dict(zip(ids, ids, strict=True))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if (a ^ b).bit_count() <= distance and out[ids[j]] > out[ids[i]]:
                    out[ids[j]], changed = out[ids[i]], True
    return out


def test_every_close_pair_meets_in_a_bucket():
    rng = random.Random(1)
    masks = simhash.block_masks(7, 4)
    assert len(masks) == 35
    for _ in range(3000):
        x = rng.getrandbits(64)
        y = x
        for k in rng.sample(range(64), rng.randrange(5)):
            y ^= 1 << k
        assert any(not (x ^ y) & m for m in masks)


def test_fingerprints(spark, docs, odd):
    texts = [*odd, "A b C d E", "a b", "Ünï CODE ÀB c d", "one two three four"]
    got = {r.doc_id: r.fp % 2**64 for r in simhash.fingerprints(docs(texts).withColumn("fp", F.lit("clash"))).collect()}
    assert got == {i: plain(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize(("seed", "chunk"), [(1, simhash.CHUNK), (2, 5), (3, 1)])
def test_components_equal_brute_force(spark, seed, chunk):
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(25)]
    fps = []
    for c in centres:
        for _ in range(rng.choice([1, 1, 3, 40])):
            x = c
            for k in rng.sample(range(64), rng.randrange(6)):
                x ^= 1 << k
            fps.append(x)
    fps = sorted(set(fps))
    rng.shuffle(fps)
    df = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in fps], "fp long")
    want = reach(list(range(len(fps))), fps)
    where = {x: i for i, x in enumerate(fps)}
    out = components(simhash.links(df.repartition(5).withColumn("node", F.col("fp")), chunk=chunk)).collect()
    got = {}
    for r in out:
        got.setdefault(r.root, set()).add(where[r.node % 2**64])
    groups = {}
    for i, c in want.items():
        groups.setdefault(c, set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g in groups.values() if len(g) > 1)


def test_components_of_a_long_chain(spark):
    n = 300
    order = list(range(n))
    random.Random(5).shuffle(order)
    df = spark.createDataFrame([*zip(order, order[1:], strict=False), (7, 7), (None, 3), (1000, 1001)], "a long, b long")
    out = dict(components(df).collect())
    assert out == {**dict.fromkeys(range(n), 0), 1000: 1000, 1001: 1000}
    assert components(df.limit(0)).count() == 0


def test_documents(spark, docs, odd):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = simhash.near_duplicates(df).collect()
    ids, fps = [r.doc_id for r in out], [r.fp % 2**64 for r in out]
    assert {r.doc_id: r.component_id for r in out} == reach(ids, fps)
    out = simhash.near_duplicates(docs([*odd, (3, "a"), (None, "a"), (None, "only here in this text")])).collect()
    assert len(out) == len(odd) + 3
    by = {(r.doc_id, r.fp): r.component_id for r in out}
    assert len({by[i, 0] for i in (0, 1, 2, 11)}) == 1 and by[0, 0] == 0
    assert [r.component_id for r in out if r.doc_id == 3] == [3, 3]
    assert {r.component_id for r in out if r.doc_id in (5, 10)} == {5}
    assert simhash.near_duplicates(docs(odd).limit(0)).count() == 0
