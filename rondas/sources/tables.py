"""Readers with the declared schemas."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rondas import schema as S


def _conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def read_visits(spark: SparkSession, path: str) -> DataFrame:
    return _conform(spark.read.parquet(path), S.VISIT_SCHEMA)


def read_attendance(spark: SparkSession, path: str) -> DataFrame:
    return _conform(spark.read.parquet(path), S.ATTENDANCE_SCHEMA)


def read_lookup(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A parquet lookup file under the names and types of ``schema``, column by column."""
    target = T.StructType.fromDDL(schema)
    df = spark.read.parquet(path)
    return df.select(*[F.col(c).cast(f.dataType).alias(f.name) for c, f in zip(df.columns, target.fields, strict=True)])


def read_universities(spark: SparkSession, path: str) -> DataFrame:
    """Universities from one JSON object {"code": "name", ...}."""
    entries = F.from_json("value", T.MapType(T.StringType(), T.StringType()))
    return (
        spark.read.text(path, wholetext=True)
        .select(F.explode(entries).alias("codigo", "universidad"))
        .select(F.col("codigo").cast("int").alias("codigo"), "universidad")
    )


def rows_to_visits(spark: SparkSession, rows: Iterable[Mapping]) -> DataFrame:
    """Visits from row dictionaries in transport form (a page's worth, as a form or a test holds)."""
    text = T.StructType(
        [
            T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.DateType) else f.dataType)
            for f in S.VISIT_SCHEMA.fields
        ]
    )
    names = text.fieldNames()
    return spark.createDataFrame([tuple(row.get(n) for n in names) for row in rows], text)


def rows_to_attendance(spark: SparkSession, rows: Iterable[Mapping]) -> DataFrame:
    names = S.ATTENDANCE_SCHEMA.fieldNames()
    return spark.createDataFrame([tuple(row.get(n) for n in names) for row in rows], S.ATTENDANCE_SCHEMA)


def read_database(
    spark: SparkSession,
    url: str,
    table: str,
    schema: T.StructType,
    *,
    lower: int,
    upper: int,
    partitions: int,
    key: str = "programada_id",
    fetch_size: int = 10_000,
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """A database table read in ``partitions`` key ranges at once; filters and columns go to the database.

    Needs the database's JDBC driver on the class path and credentials in
    ``options``. ``lower`` and ``upper`` only place the cuts, no row is left out.
    """
    reader = spark.read.format("jdbc").options(**jdbc_options(url, table, lower, upper, partitions, key, fetch_size))
    return _conform(reader.options(**(options or {})).load(), schema)


def jdbc_options(url: str, table: str, lower: int, upper: int, partitions: int, key: str, fetch_size: int) -> dict[str, str]:
    return {
        "url": url,
        "dbtable": table,
        "partitionColumn": key,
        "lowerBound": str(lower),
        "upperBound": str(upper),
        "numPartitions": str(partitions),
        "fetchsize": str(fetch_size),
    }
