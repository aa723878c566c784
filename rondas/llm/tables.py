"""Reading the given tables, and passing texts to numpy in bounded batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts reach Python in batches of at most so many bytes (or one row).
BATCH_BYTES = 8 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_batches(df: DataFrame, function, schema: str) -> DataFrame:
    """``mapInArrow`` over batches bounded in bytes, so that long texts do not add up."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(function, schema)


def identity() -> list[Column]:
    """Two numbers, ``rid`` and ``tag``, that tell a document by its id and text (by its text where the id is null)."""
    return [
        F.coalesce("doc_id", F.xxhash64("text")).cast("long").alias("rid"),
        # Seeded, so that it adds to ``rid`` where that is a hash of the text too.
        F.xxhash64(F.lit(1), F.col("text")).alias("tag"),
    ]
