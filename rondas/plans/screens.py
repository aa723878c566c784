"""The sets of views the application shows together."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rondas import schema as S
from rondas.operators import attendance as A
from rondas.operators import availability
from rondas.operators import visits as V


@dataclass(frozen=True)
class Tables:
    visits: DataFrame
    attendance: DataFrame
    universities: DataFrame
    schools: DataFrame
    communes: DataFrame
    holidays: DataFrame
    slots: DataFrame


@dataclass(frozen=True)
class Season:
    as_of: dt.date
    limit: dt.date
    capacity: int


def advisory(tables: Tables, season: Season) -> DataFrame:
    """Open invitations and overdue confirmations per university."""
    return A.advisory_counts(
        tables.universities.filter(F.col("codigo") != S.PUBLIC_USER),
        A.open_invitation_count(tables.attendance, tables.visits, season.as_of),
        V.pending_confirmation_count(tables.visits, season.as_of, season.limit),
    )


def refresh(tables: Tables, season: Season, *, month: int = 0) -> Mapping[str, DataFrame]:
    """Every view that can change after a write, each for all users at once.

    The views share ``tables.visits`` and ``tables.attendance``; persist those
    two first when several views are written in a row.
    """
    counts = advisory(tables, season)
    return {
        "visits_by_month": V.visits_by_month(tables.visits, month),
        "visits_on_date": V.visits_on_date(tables.visits),
        "organizer_agenda": V.organizer_agenda(tables.visits, season.as_of, season.limit),
        "invitations": A.invitations(tables.attendance, tables.visits, tables.communes, season.as_of),
        "blocked_dates": availability.blocked_dates(tables.visits, season.capacity),
        "advisory_text": A.advisory_text(counts),
        "advisory_hidden": A.advisory_hidden(counts),
    }
