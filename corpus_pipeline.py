"""A corpus from raw documents to token ids, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it
as Parquet in the shared folder and reads it back as the next stage's ``docs``.
All but the last return the columns of ``documents``; other columns of the input, whatever their names, are left out. A null or
empty text goes in the first stage, an empty table passes through all of them. Of repeated rows one stays in the second
stage, as of copies; of equal copies the one of least ``doc_id``, null last. Very long texts pass whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rondas.llm import bpe, partenum, poisson, recompression, repetition
from rondas.llm.tables import read
from rondas.sources.shared import write_out

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep."""
    return repetition.keep(docs).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with linked sets of five-word shingles."""
    return partenum.one_of_each(docs, n=5, percent=80).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of windows that stand more than once; other texts stay as they are."""
    cut = recompression.remove_repeats(docs, columns=["doc_id", "lang", "source"], untouched=True)
    return cut.withColumn("text", F.col("kept_text")).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's rate asks for, in mixed order."""
    return poisson.replicate(docs, poisson.temperature_rates(docs)).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids) of every row."""
    import public_tokenizers

    tokenizer = bpe.definition(public_tokenizers.path("word_bpe_49k.json"))
    return bpe.encode(docs, tokenizer, columns=["doc_id", "lang", "source"]).drop("decoded")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("source_mix", source_mix),
    ("tokens", tokens),
]

#: Encoding with a vocabulary file has no SQL; tests/llm holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = write_out(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
