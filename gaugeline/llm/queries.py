"""The corpus queries, each the thin digest of an operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.llm import ann, lattice, mixing, quality, sharding, simhash, suffix_dedup, tiff, token_count, toxicity
from gaugeline.llm.common import documents


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.dedup_substrings(documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(documents(spark, sf_dir), shingle=4, distance=4)
    return out.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def op3_anisotropic_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), every=50, near=5)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = lattice.encode_relational(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), "round_trip")


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op6_tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = tiff.tiff_pages(tiff.texts_to_tiff(documents(spark, sf_dir)))
    return pages.select(
        "doc_id",
        "n_bytes",
        F.octet_length("pixels").cast("long").alias("payload_bytes"),
        F.sha2("pixels", 256).alias("payload_sha256"),
        F.crc32(F.substring("pixels", -16, 16)).cast("long").alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


def op7_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality.train(docs, quality.graded(spark.read.parquet(f"{sf_dir}/labels.parquet")), count=3)
    return quality.scores(docs, model).select("doc_id", "expected_grade", "tail_probability", (F.col("tail_probability") >= 0.5).alias("kept"))


def op8_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_records(documents(spark, sf_dir))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.scores(docs, model)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_dedup": op1_suffix_dedup,
        "op2_simhash": op2_simhash,
        "op3_anisotropic_neighbours": op3_anisotropic_neighbours,
        "op4_sentencepiece": op4_sentencepiece,
        "op5_mix_sources": op5_mix_sources,
        "op6_tiff_pages": op6_tiff_pages,
        "op7_ordinal_quality": op7_ordinal_quality,
        "op8_rendezvous_shards": op8_rendezvous_shards,
        "op9_token_counts": op9_token_counts,
        "op10_toxicity": op10_toxicity,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_mix_sources": mixing.ORACLE}
