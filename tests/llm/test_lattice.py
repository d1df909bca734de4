import pathlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as proto

from gaugeline.llm import lattice
from gaugeline.llm.common import shared_folder

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pieces():
    return lattice.read_pieces(MODEL)


@pytest.fixture(scope="module")
def library():
    """The library's own Viterbi search over the same pieces and scores."""
    m = proto.ModelProto()
    m.ParseFromString(open(MODEL, "rb").read())
    m.trainer_spec.model_type = m.trainer_spec.UNIGRAM
    return sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())


def some_texts(n, seed=2):
    rng = random.Random(seed)
    letters = "abcdeilnorstth   \n\té ü▁日本😀<s></unk>0x"
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(150))) for _ in range(n)]


def total(ids, pieces):
    scores = {int(i): s for i, s in zip(pieces.ids, pieces.scores, strict=True)}
    return sum(scores.get(i, 0.0) for i in ids)


def test_best_paths_equal_the_library(pieces, library):
    texts = some_texts(800) + ["", " ", "    ", "a" * 500, "the quick brown fox " * 30]
    for text, ids in zip(texts, lattice.Encoder(pieces).encode(texts), strict=True):
        want = library.encode(text)
        assert lattice.decode(ids.tolist(), pieces) == text.replace("▁", " ")
        assert ids.tolist() == want or total(ids.tolist(), pieces) == pytest.approx(total(want, pieces))


def test_long_words_fold_alike(pieces):
    words = [w for t in some_texts(300, 5) for w in lattice.split(t)] + ["▁" + "ab" * 30]
    assert lattice.fold(words, pieces) == [lattice.fold_long(w, pieces) for w in words]


def test_relational_form_equals_the_batch_form(spark, pieces):
    words = sorted({w for t in some_texts(60, 8) for w in lattice.split(t)})
    df = spark.createDataFrame([(w,) for w in [*words, words[0], None, ""]], "word string")
    out = dict(lattice.encode_words(df, pieces.table(spark), longest=pieces.longest, unknown=pieces.least - lattice.UNKNOWN).collect())
    assert out.pop("") == [] and sorted(out) == words
    for w, raw in zip(words, lattice.fold(words, pieces), strict=True):
        ids, parts = np.frombuffer(raw, np.int32).tolist(), out[w]
        made = [i for p in parts for i in ([int(pieces.ids[pieces.rank[p]])] if p in pieces.rank else pieces.bytes_[list(p.encode())].tolist())]
        assert "".join(parts) == w and (made == ids or total(made, pieces) == pytest.approx(total(ids, pieces)))


def test_documents(spark, docs, odd, pieces):
    df = docs([*odd, (3, "a"), (None, "b")]).withColumn("ids", F.lit("clash"))
    out = lattice.encode(df, MODEL).collect()
    assert len(out) == len(odd) + 2 and all(r.round_trip for r in out)
    assert all(r.ids == [] for r in out if r.doc_id in (0, 1))
    back = {r.doc_id: r.decoded for r in lattice.decode_ids(lattice.encode(df, MODEL), MODEL).collect()}
    assert back[7] == odd[7] and back[9] == odd[9] and back[2] == " "
    assert lattice.encode(df.limit(0), MODEL).count() == 0


def test_relational_plan_equals_the_batch_form(spark):
    long = "x" * 70 + "日本" * 40
    texts = [*some_texts(60, seed=9), None, "", long, f"a {long} b", "a a a", "a a a", "▁ ▁"]
    rows = [(k % 61, t, "other") for k, t in enumerate(texts)] + [(None, "no key", "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string")

    def result(encode, **more):
        return sorted((str(r.doc_id), list(r.ids), r.round_trip) for r in encode(docs, MODEL, **more).collect())

    assert result(lattice.encode_relational) == result(lattice.encode) == result(lattice.encode_relational, chunk=500)
    assert lattice.encode_relational(docs.limit(0), MODEL).count() == 0


def test_words_are_cut_where_no_piece_goes_on(pieces):
    texts = [*some_texts(200, 11), None, "", "▁ ▁\n\n,", "the end, the end.", "x" * 80 + "日本" * 40]
    words, counts = lattice.finer(texts, pieces)
    words, at = words.to_pylist(), 0
    for text, n, ids in zip(texts, counts.tolist(), lattice.Encoder(pieces).encode(texts), strict=True):
        mine, at = words[at : at + n], at + n
        assert "".join(mine) == "".join(lattice.split(text))
        assert b"".join(lattice.fold_long(w, pieces) for w in mine) == ids.tobytes()
    assert at == len(words) and {"▁end", ",", "."} <= set(words)


def test_each_part_of_a_word_is_asked_for_once(spark):
    """Four words with five signs each: their twenty forms have nine parts."""
    folder = pathlib.Path(shared_folder(spark).removeprefix("file:"))
    seen = set(folder.glob("cuts-*"))
    docs = spark.createDataFrame([(1, " ".join(w + s for w in ("end", "house", "water", "light") for s in ",.;:!"))], "doc_id long, text string")
    assert lattice.encode_relational(docs, MODEL).first().round_trip
    (made,) = set(folder.glob("cuts-*")) - seen
    assert sum(len(r.cuts.split(" ")) for r in spark.read.parquet(str(made)).collect()) == 9


def test_answers_of_other_words_are_not_taken(pieces):
    words = pa.array(["▁the", "日", "𓀀", "▁of"])
    assert "𓀀" not in pieces.rank
    ids, many = lattice.edges_of(words, b"D A A C", pieces)
    the, day, of = (int(pieces.ids[pieces.rank[t]]) for t in ("▁the", "日", "▁of"))
    assert ids.tolist() == [the, day, *pieces.bytes_[list("𓀀".encode())].tolist(), of] and many.tolist() == [1, 1, 4, 1]
    assert not lattice.undone(words, ids, many, pieces).any()
    assert lattice.edges_of(words, b"D A A", pieces) is None and lattice.edges_of(words, b"D A A D", pieces) is None
    ids[0] = ids[-1]
    assert lattice.undone(words, ids, many, pieces).tolist() == [True, False, False, False]
