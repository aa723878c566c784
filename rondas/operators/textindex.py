"""Search for texts inside columns through posting tables of character n-grams.

The index of a column has two tables. ``values`` numbers the distinct texts (upper and lower case alike), so a name that stands in a third of
all rows is one entry. ``postings`` lists, for every run of one, two or three characters, the texts that hold it, sorted by the run: a search
reads the row groups of the runs of its text and no others. A text of three characters or more is the
intersection of its runs of three, a shorter one is a run itself. What is found is verified on the text, so runs in another order do not count.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Longest run that is indexed.
RUN = 3


def _folded(text: Column) -> Column:
    return F.lower(text.cast("string"))


def _runs(text: Column) -> Column:
    """The distinct runs of one to ``RUN`` characters."""
    runs = [
        F.when(
            F.char_length(text) >= k,
            F.transform(F.sequence(F.lit(1), F.char_length(text) - (k - 1)), lambda i: F.substring(text, i, F.lit(k))),
        ).otherwise(F.array().cast("array<string>"))
        for k in range(1, RUN + 1)
    ]
    return F.array_distinct(F.concat(*runs))


def write_index(rows: DataFrame, column: str, path: str, *, rows_per_group: int = 1 << 20) -> None:
    """Write ``values`` (value, text) and ``postings`` (run, value) of a column; nulls hold nothing and are left out."""
    spark = rows.sparkSession
    texts = rows.select(_folded(F.col(f"`{column}`")).alias("text")).filter("text IS NOT NULL").distinct()
    # Numbers need only be distinct; written once, they stay.
    texts.withColumn("value", F.monotonically_increasing_id()).write.parquet(f"{path}/values")
    values = spark.read.parquet(f"{path}/values")
    (
        values.select(F.explode(_runs(F.col("text"))).alias("run"), "value")
        .repartitionByRange("run", "value")
        .sortWithinPartitions("run", "value")
        .write.option("parquet.block.row.count.limit", rows_per_group)
        .parquet(f"{path}/postings")
    )


def runs_of(text: str) -> list[str]:
    """The runs that a text is looked up by."""
    small = text.lower()
    if len(small) <= RUN:
        return [small] if small else []
    return sorted({small[i : i + RUN] for i in range(len(small) - RUN + 1)})


def matching_values(spark: SparkSession, path: str, text: str) -> DataFrame:
    """(value, text) of the distinct texts that contain ``text``."""
    values = spark.read.parquet(f"{path}/values")
    asked = runs_of(text)
    if not asked:
        return values.select("value", "text")
    hits = spark.read.parquet(f"{path}/postings").filter(F.col("run").isin(*asked))
    if len(asked) > 1:
        # (run, value) is unique, so as many rows as runs means all of them.
        hits = hits.groupBy("value").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == len(asked))
    found = values.join(hits.select("value"), "value", "left_semi").select("value", "text")
    return found.filter(F.col("text").contains(text.lower()))


def search(rows: DataFrame, indexes: Mapping[str, str], contains: Mapping[str, str]) -> DataFrame:
    """``rows`` whose columns contain the given texts, as by ``visits.column_filter_sort``; ``indexes`` has a path per column."""
    for column, text in contains.items():
        found = matching_values(rows.sparkSession, indexes[column], text).select(F.col("text").alias("_text"))
        rows = rows.join(found, _folded(F.col(f"`{column}`")) == F.col("_text"), "left_semi")
    return rows
