"""Mixing sources to target weights by Poisson replication.

A source whose weight asks for a rate r of its documents gets each of them k times,
k drawn from the Poisson distribution with mean r: a number in [0, 1) made from the
document's id, text and the seed is looked up in the distribution's cumulative sums. Copies then
go to partitions by another hash and are ordered by it inside them, so neighbours
come from all sources.

Draws depend on a row's own id and text alone, so a lost task repeats them; the rates are
one small row per source, written to the shared folder. Defined results: a null source is a source of its own; null ids, null texts
and empty texts are drawn like others (their weight in characters is 0); repeated rows get the same
count; a source without characters has rate 0; an empty table gives no rows. All columns are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rondas.sources.shared import write_out

#: Weights are characters to this power: 1 keeps the mix, 0 makes all sources equal.
TEMPERATURE = 0.5
#: Rates above are cut into parts of at most this, each drawn by itself (exp(-rate) would vanish).
PART_RATE = 16.0
#: Terms of the cumulative sums kept for a part; the rest has a probability below 1e-12.
TERMS = 64
SEED = "mix"


def _sizes(docs: DataFrame) -> DataFrame:
    return docs.groupBy("source").agg(F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"))


def temperature_rates(docs: DataFrame, temperature: float = TEMPERATURE) -> DataFrame:
    """(source, rate): mean copies of a source's documents that bring its characters to their target share.

    Targets are proportional to characters ** ``temperature``; their sum is the characters there are.
    """
    sizes = _sizes(docs)
    total = sizes.agg(F.sum("chars")).scalar()
    parts = sizes.agg(F.sum(F.pow("chars", F.lit(temperature)))).scalar()
    rate = total * F.pow("chars", F.lit(temperature)) / parts / F.col("chars")
    return sizes.select("source", F.when(F.col("chars") > 0, rate).otherwise(0.0).alias("rate"))


def weight_rates(docs: DataFrame, weights: DataFrame) -> DataFrame:
    """(source, rate) for given weights (source, weight), one per source; sources without one have rate 0."""
    given = weights.select(F.col("source").alias("_source"), F.col("weight").cast("double").alias("weight"))
    shares = _sizes(docs).join(given, F.col("source").eqNullSafe(F.col("_source")), "left")
    total, parts = shares.agg(F.sum("chars")).scalar(), shares.agg(F.sum("weight")).scalar()
    rate = total * F.col("weight") / parts / F.col("chars")
    return shares.select("source", F.when((F.col("chars") > 0) & (F.col("weight") > 0), rate).otherwise(0.0).alias("rate"))


def with_sums(rates: DataFrame) -> DataFrame:
    """(source, rate, parts, sums): into how many parts a rate is cut, and the cumulative probabilities for one."""
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / PART_RATE).cast("int"))
    term = (
        f"aggregate(sequence(1, {TERMS}), named_struct('p', exp(-part), 's', exp(-part), 'all', array(exp(-part))), "
        "(a, k) -> named_struct('p', a.p * part / k, 's', a.s + a.p * part / k, "
        "'all', array_append(a.all, a.s + a.p * part / k))).all"
    )
    return (
        rates.withColumn("parts", parts)
        .withColumn("part", F.col("rate") / F.col("parts"))
        .select("source", "rate", "parts", F.expr(term).alias("sums"))
    )


def replicate(docs: DataFrame, rates: DataFrame, *, seed: str = SEED, copy: str = "copy") -> DataFrame:
    """``docs`` with each row as often as drawn, in an order mixed over all sources; column ``copy`` counts from 1.

    A column of that name in ``docs`` is replaced.
    """
    names = [c for c in docs.columns if c != copy]
    at = {c: f"d{i}" for i, c in enumerate(names)}
    # One row per source, written out: Spark sees its size and, while it is small, leaves the documents where they are.
    sums = write_out(with_sums(rates).select(F.col("source").alias("drawn_from"), "parts", "sums"))
    rows = docs.select(*[F.col(f"`{c}`").alias(d) for c, d in at.items()])
    text, doc_id, source = (F.col(at[c]) for c in ("text", "doc_id", "source"))
    # Parts and the document's name; a part's number in [0, 1) has 48 bits of their MD5.
    name = F.concat_ws("|", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit(""))))
    drawn = (
        "aggregate(sequence(1, parts), 0, (n, j) -> n + size(filter(sums, s -> s <= "
        f"CAST(conv(substring(md5(concat_ws('|', name, j)), 1, 12), 16, 10) AS DOUBLE) / {float(1 << 48)!r}D)))"
    )
    copies = (
        rows.join(sums, source.eqNullSafe(F.col("drawn_from")))
        .withColumn("name", name)
        .withColumn("copies", F.expr(drawn))
        .filter("copies > 0")
        .withColumn("copy", F.explode(F.expr("sequence(1, copies)")))
        .withColumn("place", F.xxhash64("name", "copy"))
    )
    mixed = copies.repartition("place").sortWithinPartitions("place")
    return mixed.select(*[F.col(d).alias(c) for c, d in at.items()], F.col("copy").cast("int").alias(copy))
