import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gaugeline.llm import suffix_dedup


def plain(rows):
    """Kept bytes and removed runs of (key, text) rows by a set of all strings seen; rows of one key come by hash bits, then text."""
    seen, out = set(), []
    bits = (1 << suffix_dedup.DEALT) - 1
    for _, raw in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, xxhash.xxh64_intdigest(r[1], 42) & bits, r[1])):
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - 99):
            s = raw[i : i + 100]
            if s in seen:
                gone[i : i + 100] = True
            seen.add(s)
        edge = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(int))).tolist()
        out.append((_, bytes(np.frombuffer(raw, np.uint8)[~gone]), list(zip(edge[::2], edge[1::2], strict=True))))
    return sorted(out, key=repr)


def run(df, **how):
    return sorted(((r.doc_id, bytes(r.kept), [(s.start, s.end) for s in r.spans]) for r in suffix_dedup.dedup_substrings(df, **how).collect()), key=repr)


@pytest.mark.parametrize("seed", range(4))
def test_equal_to_brute_force(spark, docs, seed, monkeypatch):
    rng = random.Random(seed)

    def noise(n, letters="abcd efgh\nüé日"):
        return "".join(rng.choice(letters) for _ in range(n))

    passages = [noise(rng.choice([99, 100, 101, 130, 400])) for _ in range(6)]
    rows = []
    for i in range(80):
        parts = [noise(rng.randrange(200)) if rng.random() < 0.6 else rng.choice(passages)[rng.randrange(10) :] for _ in range(rng.randrange(6))]
        if rng.random() < 0.2:
            parts.append(rng.choice("ab") * rng.randrange(400))
        if rng.random() < 0.2:
            parts.append(noise(rng.randrange(1, 30)) * rng.randrange(20))
        rows.append((rng.randrange(-5, 60) if seed == 3 else i, "".join(parts)))
    rows += rng.sample(rows, 10) if seed == 3 else [(500 + i, t) for i, (_, t) in enumerate(rng.sample(rows, 10))]
    df = docs(rows).repartition(5)
    assert run(df) == plain([(i, t.encode()) for i, t in rows])


def test_odd_rows(spark, docs, odd):
    rows = [*enumerate(odd), (3, "x" * 150), (3, "x" * 150), (None, "y" * 120), (None, "y" * 120)]
    df = docs(rows).withColumn("base", F.lit("clash")).withColumn("places", F.lit(1))
    assert run(df, carry=("source", "base")) == plain([(i, (t or "").encode()) for i, t in rows])
    assert run(df.limit(0)) == []


def test_one_common_passage_in_different_surroundings(spark, docs):
    rng = random.Random(9)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(180))
    rows = [(i, f"{rng.random()} {i}" * 3 + passage + f"{i} {rng.random()}" * 3) for i in range(300)]
    assert run(docs(rows).repartition(6)) == plain([(i, t.encode()) for i, t in rows])


def test_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text.encode()) for r in df.select("doc_id", "text").collect()]
    assert run(df) == plain(rows)
