"""The operators as queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rondas.llm import (
    bpe,
    decontamination,
    hosttrust,
    langid,
    licences,
    merkle,
    partenum,
    pivots,
    poisson,
    recompression,
    repetition,
    search,
    sitequality,
)
from rondas.llm.sql import ORACLES
from rondas.llm.tables import read

__all__ = ["ORACLES", "QUERIES"]


#: Fixed values.
URL_RULES = [
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
]


def op1_host_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hosttrust.judge_urls(read(spark, sf_dir, "pages"), URL_RULES)


def op2_byte_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read(spark, sf_dir, "documents"))


def op3_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.judge(read(spark, sf_dir, "documents"))


def op4_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitequality.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_partenum_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.near_duplicates(read(spark, sf_dir, "documents"), n=3, percent=90)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(read(spark, sf_dir, "documents"))


def op7_pivot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.largest_products(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op8_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return poisson.replicate(docs, poisson.temperature_rates(docs))


def op9_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = recompression.remove_repeats(read(spark, sf_dir, "documents"), columns=["doc_id"])
    return cut.select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256")
    )


def op10_byte_pair_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    tokenizer = bpe.definition(public_tokenizers.path("word_bpe_49k.json"))
    encoded = bpe.encode(read(spark, sf_dir, "documents"), tokenizer, columns=["doc_id"])
    return encoded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op11_pipelined_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_host_trust": op1_host_trust,
    "op2_byte_network": op2_byte_network,
    "op3_repetition_rules": op3_repetition_rules,
    "op4_site_quality": op4_site_quality,
    "op5_partenum_join": op5_partenum_join,
    "op6_license_scan": op6_license_scan,
    "op7_pivot_search": op7_pivot_search,
    "op8_poisson_mix": op8_poisson_mix,
    "op9_recompression": op9_recompression,
    "op10_byte_pair_tokens": op10_byte_pair_tokens,
    "op11_pipelined_search": op11_pipelined_search,
    "op12_decontamination": op12_decontamination,
    "op13_merkle_manifest": op13_merkle_manifest,
}
