"""Tables sorted by key and written with Bloom filters, so that a lookup reads only the row groups that may hold its keys.

Files hold ranges of the key, and each row group a Bloom filter of it. Spark hands a list of keys to the Parquet reader, which
leaves out row groups by their least and greatest key first and by the filter next; the filter matters for keys
inside the range that are not there, and for further columns such as a school's number, by which rows are not sorted.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rondas.operators.attendance import attendance_lookup
from rondas.operators.visits import visits_by_id

#: Up to so many distinct keys are handed to the reader as a list; more of them are a join, which reads the table once.
LISTED_KEYS = 1000


def write_keyed(
    rows: DataFrame, path: str, keys: Sequence[str] = ("programada_id",), *, bloom: Sequence[str] = (), rows_per_file: int = 5_000_000
) -> None:
    """Write ``rows`` sorted by ``keys``, with a Bloom filter on the first of them and on the columns ``bloom``."""
    writer = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).write
    for column in dict.fromkeys((keys[0], *bloom)):
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
        writer = writer.option(f"parquet.bloom.filter.expected.ndv#{column}", str(rows_per_file))
    # Bloom filters are written where a column is not wholly dictionary-coded.
    for column in bloom:
        writer = writer.option(f"parquet.enable.dictionary#{column}", "false")
    writer.option("maxRecordsPerFile", rows_per_file).parquet(path)


def listed_keys(wanted: DataFrame, key: str, limit: int = LISTED_KEYS) -> list | None:
    """The distinct keys of ``wanted`` if they are at most ``limit``, else nothing."""
    found = wanted.select(key).filter(F.col(key).isNotNull()).distinct().limit(limit + 1).collect()
    return None if len(found) > limit else sorted(row[0] for row in found)


def with_keys(rows: DataFrame, key: str, keys: Iterable | None) -> DataFrame:
    """The rows that hold one of the keys; all rows where there is no list."""
    return rows if keys is None else rows.filter(F.col(key).isin(list(keys)))


def visits_from(spark: SparkSession, path: str, wanted: DataFrame, *, listed: int = LISTED_KEYS) -> DataFrame:
    """``visits.visits_by_id`` on a keyed table. Few ids are read by list, many are joined."""
    keys = listed_keys(wanted, "programada_id", listed)
    return visits_by_id(with_keys(spark.read.parquet(path), "programada_id", keys), wanted)


def answers_from(spark: SparkSession, path: str, asked: DataFrame, *, listed: int = LISTED_KEYS) -> DataFrame:
    """``attendance.attendance_lookup`` on a keyed table of answers."""
    keys = listed_keys(asked, "programada_id", listed)
    return attendance_lookup(with_keys(spark.read.parquet(path), "programada_id", keys), asked)
