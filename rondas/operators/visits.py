"""Queries over the visit table."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rondas import schema as S
from rondas.functions.dates import as_date, in_month
from rondas.operators.ordinals import HOT_ROWS, with_ordinal

DATE_ORDER = ("fecha", "orden", "programada_id")


def is_active() -> Column:
    return F.col("estatus").isin(*S.ACTIVE_STATUSES)


def upcoming_active(visits: DataFrame, as_of: dt.date | str) -> DataFrame:
    """Visits still to come that are not suspended or done."""
    return visits.filter((F.col("fecha") >= F.lit(as_date(as_of))) & is_active())


def visit_type(as_of: dt.date | str, season_limit: dt.date | str) -> Column:
    """0 upcoming, 3 upcoming but suspended, 1 past and open, 2 past and closed."""
    to_come = F.col("fecha") >= F.lit(as_date(as_of))
    return (
        F.when(to_come & (F.col("estatus") == S.SUSPENDED), S.TYPE_SUSPENDED)
        .when(to_come, S.TYPE_UPCOMING)
        .when(F.col("fecha_lim") != F.lit(as_date(season_limit)), S.TYPE_CLOSED)
        .otherwise(S.TYPE_OVERDUE)
    )


def visits_by_month(visits: DataFrame, month: int = 0, *, years: list[int] | None = None) -> DataFrame:
    """Visits of a calendar month (0 = all), whatever their status, by date."""
    rows = visits.select(*S.GRID_COLUMNS)
    if month:
        rows = rows.filter(in_month("fecha", month, years))
    return rows.orderBy(*DATE_ORDER)


def visits_on_date(visits: DataFrame, fecha: dt.date | str | None = None, *, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Active visits of each date, numbered within the date; of one date if given."""
    rows = visits.filter(is_active())
    if fecha is not None:
        rows = rows.filter(F.col("fecha") == F.lit(as_date(fecha)))
    rows = rows.select("fecha", F.col("orden").alias("_orden"), "programada_id", "rbd", "nombre", "organizador", "estatus")
    return with_ordinal(rows, ["fecha"], ["_orden", "programada_id"], hot_rows=hot_rows).select(
        "fecha", "programada_id", *S.DATE_GRID_COLUMNS
    )


def organizer_agenda(
    visits: DataFrame,
    as_of: dt.date | str,
    season_limit: dt.date | str,
    *,
    user: int | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Visits each organiser still sees, numbered per organiser and classed by ``tipo``."""
    rows = visits.filter(F.col("fecha_lim") >= F.lit(as_date(as_of)))
    if user is not None:
        rows = rows.filter(F.col("organizador_id") == user)
    rows = rows.select(
        "organizador_id",
        "programada_id",
        F.col("orden").alias("_orden"),
        "rbd",
        "nombre",
        "fecha",
        "fecha_lim",
        visit_type(as_of, season_limit).alias("tipo"),
        "estatus",
    )
    return with_ordinal(
        rows, ["organizador_id"], ["_orden", "programada_id"], spread="fecha", hot_rows=hot_rows
    ).select("organizador_id", "programada_id", "orden", "rbd", "nombre", "fecha", "fecha_lim", "tipo", "estatus")


def pending_confirmation_count(visits: DataFrame, as_of: dt.date | str, season_limit: dt.date | str) -> DataFrame:
    """Past visits per organiser whose outcome was never confirmed."""
    pending = visit_type(as_of, season_limit) == S.TYPE_OVERDUE
    return (
        visits.filter(F.col("fecha_lim") >= F.lit(as_date(as_of)))
        .filter(pending & F.col("organizador_id").isNotNull())
        .groupBy("organizador_id")
        .agg(F.count(F.lit(1)).alias("pendientes"))
    )


def edit_flags(visits: DataFrame, as_of: dt.date | str, season_limit: dt.date | str) -> DataFrame:
    """What may still be done with each visit on the day ``as_of``."""
    tipo = visit_type(as_of, season_limit)
    listed = F.col("fecha_lim") >= F.lit(as_date(as_of))
    return visits.select(
        "programada_id",
        "organizador_id",
        tipo.alias("tipo"),
        F.coalesce(F.col("fecha") >= F.lit(as_date(as_of)), F.lit(False)).alias("respuesta_editable"),
        F.coalesce(listed & tipo.isin(S.TYPE_UPCOMING, S.TYPE_SUSPENDED), F.lit(False)).alias("visita_editable"),
        F.coalesce(listed & tipo.isin(S.TYPE_OVERDUE, S.TYPE_CLOSED), F.lit(False)).alias("realizacion_confirmable"),
    )


def visits_by_id(visits: DataFrame, wanted: DataFrame) -> DataFrame:
    """The visits whose ``programada_id`` is asked for."""
    # Distinct first: an id asked for very often is one row after map-side combine.
    return visits.join(wanted.select("programada_id").distinct(), "programada_id", "left_semi")


def unknown_ids(visits: DataFrame, wanted: DataFrame) -> DataFrame:
    """Asked-for ids that no visit has; each is an error for a single fetch."""
    return wanted.select("programada_id").distinct().join(visits.select("programada_id"), "programada_id", "left_anti")


def column_filter_sort(
    rows: DataFrame,
    contains: Mapping[str, str] | None = None,
    sort: Sequence[str] = (),
    *,
    descending: Iterable[str] = (),
    unique: str = "programada_id",
) -> DataFrame:
    """Keep rows whose columns contain the given texts, upper or lower case alike, then sort.

    The unique column settles ties: the sort key then splits evenly over tasks
    even when a column has a handful of values.
    """
    for column, text in (contains or {}).items():
        rows = rows.filter(F.lower(F.col(column).cast("string")).contains(text.lower()))
    if sort:
        down = set(descending)
        rows = rows.orderBy(*[F.col(c).desc() if c in down else F.col(c).asc() for c in (*sort, unique)])
    return rows


def labelled_columns(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Ordered columns under their display labels."""
    return rows.select(*[F.col(c).alias(S.LABELS[c]) for c in columns])
