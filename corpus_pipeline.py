"""The corpus pipeline: stages over documents, each written and read again.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept.
All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.llm import lattice, mixing, quality, simhash, suffix_dedup
from gaugeline.llm.common import documents, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are likelier than not of the middle grade or better."""
    docs = _columns(docs)
    model = quality.train(docs, quality.graded(spark.read.parquet(f"{sf_dir}/labels.parquet")), count=3)
    return quality.keep(docs, model)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five words, a similarity of 0.8 or more."""
    return simhash.one_of_each(_columns(docs), shingle=5, similarity=0.8)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without 100-byte strings that start earlier; documents of which nothing is left go."""
    docs = _columns(docs)
    out = suffix_dedup.dedup_substrings(docs, carry=("text", "lang", "source", "n_chars"), whole_characters=True)
    changed = F.col("n_removed") > 0
    text = F.when(changed, F.col("kept").cast("string")).otherwise(F.col("carried.text"))
    out = out.where(~changed | (F.length(F.trim(F.col("kept").cast("string"))) > 0))
    return out.select("doc_id", text.alias("text"), "carried.lang", "carried.source", F.when(changed, F.length(text).cast("long")).otherwise(F.col("carried.n_chars")).alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight asks."""
    return mixing.mixed_rows(_columns(docs))


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text's pieces; decoding them gives the text back."""
    encoded = lattice.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return encoded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_pieces"), "round_trip")


STAGES = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", simhash_near_dedup),
    ("suffix-array dedup", suffix_array_dedup),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", sentencepiece_encoding),
]

#: No SQL states a learned classifier, fingerprints or suffix buckets; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
