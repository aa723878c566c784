"""Writers. A snapshot always goes to a new folder: the one being read is never overwritten."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rondas.functions.checks import fail_when

#: A quote is doubled, blanks and line breaks are kept, a null is an empty cell and an empty text a quoted one.
CSV = {
    "header": True,
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
    "nullValue": "",
    "emptyValue": '""',
}


def write_export(df: DataFrame, path: str, *, by_month_of: str | None = None, rows_per_file: int = 100_000) -> None:
    """Labelled sheet as CSV with a header, in one folder per month if a date column is named.

    A spreadsheet opens these files; ``sources.workbook`` writes sheets of its own kind. Cells may hold line breaks, so a file is read by
    one task: files have at most ``rows_per_file`` rows.
    """
    options = CSV | {"maxRecordsPerFile": rows_per_file}
    if by_month_of is None:
        df.write.options(**options).csv(path)
        return
    month = F.date_format(F.col(f"`{by_month_of}`"), "yyyy-MM")
    df.withColumn("mes", month).write.partitionBy("mes").options(**options).csv(path)


#: The reader takes any empty cell for a null; a quoted one passes as this mark, that no sheet holds.
EMPTY = "\x01"


def _unmarked(schema: T.StructType) -> list[Column]:
    columns = [F.col(f"`{f.name}`") for f in schema.fields]
    return [
        F.when(c == EMPTY, "").otherwise(c).alias(f.name) if isinstance(f.dataType, T.StringType) else c
        for c, f in zip(columns, schema.fields, strict=True)
    ]


def read_export(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of a sheet; a broken line fails the query. ``checked_export`` sets such lines aside."""
    return checked_export(spark, path, schema, strict=True)[0]


def write_store(df: DataFrame, path: str) -> None:
    """Rows as JSON lines, the form a page keeps them in."""
    df.write.json(path, ignoreNullFields=False)


#: Where the text of a line goes that does not fit the schema.
BROKEN = "_linea"


def _split(rows: DataFrame, schema: T.StructType, *, strict: bool) -> tuple[DataFrame, DataFrame]:
    """Rows that were read whole, and (archivo, linea) of the others; with ``strict`` a broken line fails the query."""
    names = schema.fieldNames()
    # Readers judge a line by the columns a query asks for; this test asks for all of them, and is never false itself.
    read_whole = F.xxhash64(*[F.col(f"`{c}`") for c in names]).cast("string") != ""
    broken = ~(F.col(BROKEN).isNull() & read_whole)
    if strict:
        held = rows.select(
            *[fail_when(broken, "a line does not fit the schema", F.col(f"`{c}`")).alias(c) for c in names]
        )
    else:
        held = rows.filter(~broken).select(*[F.col(f"`{c}`") for c in names])
    return held, rows.filter(broken).select(F.col("_metadata.file_name").alias("archivo"), F.col(BROKEN).alias("linea"))


def _marked(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(BROKEN, T.StringType())])


def checked_store(spark: SparkSession, path: str, schema: T.StructType, *, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """The rows of a store, and its broken lines: (archivo, linea).

    A line that is cut, is no JSON or holds a value of another type is broken as a whole; it is never read as a row of nulls.
    """
    reader = spark.read.schema(_marked(schema)).options(mode="PERMISSIVE", columnNameOfCorruptRecord=BROKEN)
    return _split(reader.json(path), schema, strict=strict)


def checked_export(spark: SparkSession, path: str, schema: T.StructType, *, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """The rows of a sheet, and its broken lines: too few or too many cells, or a cell of another type."""
    reader = spark.read.schema(_marked(schema)).options(mode="PERMISSIVE", columnNameOfCorruptRecord=BROKEN)
    rows = reader.options(**CSV | {"emptyValue": EMPTY, "multiLine": True}).csv(path)
    held, broken = _split(rows, schema, strict=strict)
    return held.select(*_unmarked(schema)), broken


def read_store(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of a store; a broken line fails the query. ``checked_store`` sets such lines aside."""
    return checked_store(spark, path, schema, strict=True)[0]


def write_snapshot(df: DataFrame, base: str, version: int) -> str:
    """Write one version of a table; fails if that version exists."""
    path = f"{base}/version={version}"
    df.write.mode("errorifexists").parquet(path)
    return path


def read_snapshot(spark: SparkSession, base: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{base}/version={version}")


def save_bucketed(df: DataFrame, table: str, buckets: int, key: str = "programada_id") -> None:
    """Save a table bucketed by visit: joins of visits with attendance then read matching buckets, unshuffled.

    Both tables need the same number of buckets. Rows are gathered by key first,
    so each bucket is one file and not one per task.
    """
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).mode("errorifexists").saveAsTable(table)
