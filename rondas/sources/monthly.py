"""Visits kept in one folder per year and month, of which an edit reads and writes only those it touches.

Months are partition columns ``anio`` and ``mes``, so a month of any year is a matter of folders, whatever the rest of the
filter. Visits without a date are in the partition of nulls. Writing goes through Spark's dynamic
partition overwrite: the new rows of the touched months are first written to the shared folder, in full, and then
replace those months; all other folders are left alone. A month that loses its last visit loses its folder.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rondas.operators import changes as C
from rondas.sources.shared import remove, scratch, write_out

MONTH = ["anio", "mes"]


def _months(fecha: Column) -> list[Column]:
    return [F.year(fecha).alias("anio"), F.month(fecha).alias("mes")]


def _write(visits: DataFrame, path: str, *, rows_per_file: int, mode: str = "overwrite") -> None:
    """Rows are split by range: a task writes few months, and a large month is written by several tasks."""
    rows = visits.select("*", *_months(F.col("fecha")))
    order = [*MONTH, "fecha", "programada_id"]
    (
        rows.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .write.partitionBy(*MONTH)
        .option("partitionOverwriteMode", "dynamic")
        .option("maxRecordsPerFile", rows_per_file)
        .mode(mode)
        .parquet(path)
    )


def write_monthly(visits: DataFrame, path: str, *, rows_per_file: int = 5_000_000) -> None:
    """Write all of ``visits``; months that ``path`` holds and ``visits`` does not have stay."""
    _write(visits, path, rows_per_file=rows_per_file)


def read_monthly(
    spark: SparkSession, path: str, months: DataFrame | Iterable[tuple[int, int]] | None = None, *, month: int = 0
) -> DataFrame:
    """The visits of all months, of a calendar month of every year, or of the (anio, mes) in ``months``.

    A list of months is a filter on folders; a table of months (with one row per month, so it is small) is joined, and Spark
    prunes the folders at run time. Null stands for visits without a date in a list.
    """
    rows = spark.read.parquet(path)
    if month:
        rows = rows.filter(F.col("mes") == month)
    if isinstance(months, DataFrame):
        asked = F.broadcast(months.select(*MONTH).distinct())
        rows = rows.join(asked, MONTH, "left_semi")
    elif months is not None:
        listed = list(months)
        among = F.lit(False)
        for anio, mes in listed:
            among = among | ((F.col("anio") == anio) & (F.col("mes") == mes) if anio is not None else F.col("anio").isNull())
        rows = rows.filter(among)
    return rows.drop(*MONTH)


def touched_months(changes: DataFrame) -> list[tuple[int | None, int | None]]:
    """(anio, mes) of the dates that the visits of ``changes`` have and of those they get. A row per calendar month reaches the driver."""
    target = F.when((F.col("accion") == C.PATCH) & (F.col("campo") == "fecha"), F.to_date("valor"))
    moved = (F.col("accion") == C.PATCH) & (F.col("campo") == "fecha")
    # A visit that loses its date moves to those without one.
    dates = F.when(moved, F.array(F.col("fecha_propia"), target)).otherwise(F.array("fecha_propia"))
    found = changes.select(F.explode(dates).alias("fecha")).select(*_months(F.col("fecha"))).distinct()
    return [tuple(row) for row in found.collect()]


def _months_of(rows: DataFrame, column: str) -> list[tuple[int | None, int | None]]:
    """A row per calendar month reaches the driver."""
    return [tuple(row) for row in rows.select(*_months(F.col(column))).distinct().collect()]


def _replace(
    spark: SparkSession, path: str, months: list[tuple], edited: Callable[[DataFrame], DataFrame], rows_per_file: int
) -> None:
    """Write the months as ``edited`` makes them from what they hold."""
    if not months:
        return
    new = write_out(edited(read_monthly(spark, path, months)))
    left = set(_months_of(new, "fecha"))
    # All rows are in place before the first folder is replaced; a run that ends before that is repeated from the start.
    _write(new, path, rows_per_file=rows_per_file)
    for month in set(months) - left:
        remove(spark, f"{path}/{_folder(*month)}")


def apply_monthly(spark: SparkSession, path: str, changes: DataFrame, *, rows_per_file: int = 5_000_000) -> list[tuple]:
    """Apply a change table (see ``changes.apply_changes``) with the date of each visit as ``fecha_propia``; the touched months.

    Only these months are read and written. ``fecha_propia`` is what the form that asks for the change was
    opened with; a visit that has another date by now is not found there, and ``stale`` lists its changes beforehand.
    """
    with scratch(spark):
        changes = write_out(changes)
        months = touched_months(changes)
        _replace(spark, path, months, lambda rows: C.apply_changes(rows, changes.drop("fecha_propia")), rows_per_file)
    return months


def close_monthly(
    spark: SparkSession, path: str, closings: DataFrame, holidays: DataFrame, *, rows_per_file: int = 5_000_000
) -> list[tuple]:
    """Apply closings (see ``changes.close_visits``) with the date of each visit as ``fecha_propia``; the touched months."""
    with scratch(spark):
        closings = write_out(closings)
        months = _months_of(closings, "fecha_propia")
        _replace(spark, path, months, lambda rows: C.close_visits(rows, closings.drop("fecha_propia"), holidays), rows_per_file)
    return months


def insert_monthly(
    spark: SparkSession, path: str, requests: DataFrame, season_limit: dt.date | str, *, rows_per_file: int = 5_000_000
) -> list[tuple]:
    """Add new visits (see ``changes.insert_visits``) as further files of their months; these months.

    Nothing is rewritten: of the visits there are, the months asked for are read for the places of their dates, and
    all others for their largest id alone.
    """
    with scratch(spark):
        requests = write_out(requests)
        months = _months_of(requests, "fecha")
        if months:
            last_id = read_monthly(spark, path).agg(F.max("programada_id")).first()[0] or 0
            new = C.new_visits(read_monthly(spark, path, months), requests, season_limit, last_id=last_id)
            _write(write_out(new), path, rows_per_file=rows_per_file, mode="append")
    return months


def stale(spark: SparkSession, path: str, changes: DataFrame) -> DataFrame:
    """Changes whose visit is not in the month of its ``fecha_propia``."""
    held = read_monthly(spark, path, touched_months(changes)).select("programada_id", F.col("fecha").alias("fecha_propia"))
    return changes.join(held, (changes.programada_id == held.programada_id) & changes.fecha_propia.eqNullSafe(held.fecha_propia), "left_anti")


def _folder(anio: int | None, mes: int | None) -> str:
    null = "__HIVE_DEFAULT_PARTITION__"
    return f"anio={null if anio is None else anio}/mes={null if mes is None else mes}"
