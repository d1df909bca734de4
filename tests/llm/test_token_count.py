import random

import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

from gaugeline.llm import token_count

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_equal_to_the_library():
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    counter = token_count.Counter(token_count.read_ranks(open(MODEL, "rb").read()))
    rng = random.Random(3)
    letters = "abcdeilnorst   \n\té ü▁日本😀<s></unk>0x"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(200))) for _ in range(1500)]
    texts += ["", " ", "   ", "<s> hi </s>", "<0x0A>", "a" * 3000, " " * 100, "\n\n \n", "▁▁ ▁a"]
    assert [counter.tokens(t) for t in texts] == [len(x) for x in lib.encode(texts)]


def test_rows(spark, docs, odd):
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    df = docs([*odd, (3, "twice"), (3, "twice"), (None, "no id")]).withColumn("n_tokens", F.lit("clash"))
    out = token_count.count_tokens(df, MODEL).collect()
    assert len(out) == len(odd) + 3
    by = {r.doc_id: r for r in out if r.doc_id not in (3, None)}
    for i, t in enumerate(odd):
        if i != 3:
            assert by[i].n_tokens == len(lib.encode(t or "")) and by[i].n_bytes == len((t or "").encode()) and by[i].over_limit == (by[i].n_tokens > 4096)
    assert token_count.count_tokens(df.limit(0), MODEL).count() == 0


def test_documents(spark):
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = dict(df.select("doc_id", "text").collect())
    out = token_count.count_tokens(df, MODEL).collect()
    assert {r.doc_id: r.n_tokens for r in out} == dict(zip(texts, map(len, lib.encode(list(texts.values()))), strict=True))
