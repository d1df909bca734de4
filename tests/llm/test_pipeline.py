import random
import re

import corpus_pipeline
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gaugeline.llm import lattice, mixing, quality, simhash

FOLDER = "/root/testdata/sf0.001"


def test_stages_by_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    stage = {n: f for n, f in corpus_pipeline.STAGES}

    kept = stage[names[0]](spark, docs, FOLDER)
    model = quality.train(docs, quality.graded(spark.read.parquet(f"{FOLDER}/labels.parquet")), count=3)
    want = {r.doc_id for r in docs.collect() if model.above(np.array([model.position(*quality.features(r.text))]))[0, 0] >= 0.5}
    assert {r.doc_id for r in kept.collect()} == want and kept.columns == docs.columns and 0 < len(want) < docs.count()

    one = stage[names[1]](spark, kept, FOLDER)
    rows = sorted(kept.collect())
    sets = {}
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text.lower())
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    group = {r.doc_id: r.doc_id for r in rows}
    for _ in rows:
        moved = False
        for a in rows:
            for b in rows:
                x, y = sets[a.doc_id], sets[b.doc_id]
                if group[b.doc_id] > group[a.doc_id] and len(x & y) >= 0.8 * len(x | y):
                    group[b.doc_id], moved = group[a.doc_id], True
        if not moved:
            break
    left = {r.doc_id for r in one.collect()}
    want = set(group.values())
    assert left >= want and len(left - want) <= 0.03 * len(rows) and one.columns == docs.columns

    cut = stage[names[2]](spark, one, FOLDER)
    seen, texts = set(), {}
    for r in sorted(one.collect()):
        raw = r.text.encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - 99):
            gone[i : i + 100] |= raw[i : i + 100] in seen
            seen.add(raw[i : i + 100])
        edge = [0, *(np.flatnonzero(np.diff(gone.astype(int))) + 1).tolist(), len(raw)]
        text = "".join(raw[a:b].decode("utf-8", "ignore") for a, b in zip(edge, edge[1:], strict=False) if a < b and not gone[a])
        if not gone.any() or text.strip(" "):
            texts[r.doc_id] = text
    assert {r.doc_id: r.text for r in cut.collect()} == texts
    assert all(r.n_chars == len(r.text) for r in cut.collect()) and cut.columns == docs.columns

    mixed = stage[names[3]](spark, cut, FOLDER)
    want = sorted((r.doc_id, r.copies) for r in mixing.mix(cut).collect() if r.copies)
    got = {}
    for r in mixed.collect():
        assert r.text == texts[r.doc_id]
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert sorted(got.items()) == want and mixed.columns == docs.columns

    last = stage[names[4]](spark, mixed, FOLDER).collect()
    assert len(last) == sum(got.values()) and all(r.round_trip for r in last)


def test_run(spark):
    out = corpus_pipeline.run(spark, FOLDER)
    assert out.count() > 50 and out.where(~F.col("round_trip")).count() == 0


def test_one_of_each(spark, docs, odd):
    base = " ".join(f"w{i}" for i in range(200))
    near = base.replace("w100 ", "other ")
    far = " ".join(f"v{i}" for i in range(200))
    rows = [(9, base), (4, near), (6, base), (2, far), (2, far), (None, base), (None, "alone here"), (None, "alone here"), (30, base.upper().replace(" ", "\n"))]
    out = simhash.one_of_each(docs(rows).withColumn("node", F.lit("clash")).withColumn("least", F.lit(1))).collect()
    assert sorted((r.doc_id or -1, r.text) for r in out) == sorted([(4, near), (2, far), (-1, "alone here")]) and out[0].node == "clash"
    out = simhash.one_of_each(docs(odd)).collect()
    assert {r.doc_id for r in out} == set(range(len(odd))) - {1, 2, 11, 10}
    assert simhash.one_of_each(docs(odd).limit(0)).count() == 0


def test_mixed_rows(spark, docs, odd):
    rows = [*enumerate(odd), (5, odd[5]), (5, odd[5]), (None, "no key", None), (None, "no key", None), (77, "b b", "b"), (78, "c c c", "c")]
    df = docs(rows).withColumn("size", F.lit("clash")).withColumn("n", F.lit("clash"))
    got = {}
    for r in mixing.mixed_rows(df).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    want = {}
    for r in mixing.mix(df).collect():
        if r.copies:
            want[r.doc_id] = want.get(r.doc_id, 0) + r.copies
    assert got == want
    assert mixing.mixed_rows(df.limit(0)).count() == 0


def test_stages_take_odd_rows(spark, docs, odd):
    df = docs([*odd, (5, odd[5]), (None, "no key")]).withColumn("kept", F.lit("clash"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, df, FOLDER).count() > 0
        assert stage(spark, df.limit(0), FOLDER).count() == 0
    assert lattice.encode(df, corpus_pipeline.public_tokenizers.path("piece_bpe_32k.model")).count() == len(odd) + 2


def brute_groups(texts, similarity=0.8):
    """The least position of each group of texts that pairs of the similarity join."""
    sets = []
    for text in texts:
        w = text.split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    first = list(range(len(texts)))

    def top(i):
        while first[i] != i:
            i = first[i]
        return i

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            both = len(x & y)
            if both >= similarity * (len(x) + len(y) - both):
                a, b = sorted((top(i), top(j)))
                first[b] = a
    return {top(i) for i in range(len(texts))}


@pytest.mark.parametrize("chunk", [simhash.WORDS, 5000])
def test_many_edited_copies(spark, docs, chunk):
    rng = random.Random(11)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    texts = []
    for _ in range(150):
        share = rng.uniform(0, 0.05)
        texts.append(" ".join(f"e{rng.randrange(10**9)}" if rng.random() < share else w for w in base))
    got = {r.doc_id for r in simhash.one_of_each(docs(texts), chunk=chunk).collect()}
    # texts may stay where no fingerprint comes near, but none of the group that the fingerprints join
    fps = [[simhash.majority([xxhash.xxh64_intdigest(w.encode(), s) for w in set(t.split())]) for s in (simhash.SEED, simhash.SEED + 1)] for t in texts]
    loose = simhash_groups(fps)
    want = {m for g in loose for m in (g[k] for k in brute_groups([texts[i] for i in g]))}
    assert got == want


def simhash_groups(fps, distance=5):
    """Positions joined by either fingerprint, each group in order."""
    left, out = set(range(len(fps))), []
    while left:
        queue = [left.pop()]
        group = set(queue)
        while queue:
            at = queue.pop()
            near = {j for j in left if any((x ^ y).bit_count() <= distance for x, y in zip(fps[at], fps[j], strict=True))}
            left -= near
            group |= near
            queue += near
        out.append(sorted(group))
    return out


def test_copies_with_a_passage_more_or_less(spark, docs):
    rng = random.Random(3)

    def text(n):
        return [f"w{rng.randrange(10**6)}" for _ in range(n)]

    rows = []
    for i in range(0, 240, 2):
        base = text(200)
        other = [base + text(40), base[:-30], base[30:]][i // 2 % 3]
        rows += [(i, " ".join(base)), (i + 1, " ".join(other))]
    assert {r.doc_id for r in simhash.one_of_each(docs(rows)).collect()} == set(range(0, 240, 2))
