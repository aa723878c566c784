"""Date, time and label expressions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from rondas import schema as S

_TIME_PATTERN = r"^([01]?\d|2[0-3]):[0-5]?\d:[0-5]?\d$"


def as_date(value: dt.date | str) -> dt.date:
    """Accept a date or its ISO text, as every ``as_of`` argument does."""
    return value if isinstance(value, dt.date) else dt.date.fromisoformat(value)


def in_month(column: str, month: int, years: list[int] | None = None) -> Column:
    """True on dates of a calendar month, of any year or of the given years.

    With years the test is a set of date ranges, which the parquet reader can
    use to skip row groups; ``month(fecha) = m`` alone cannot be pushed down.
    """
    date = F.col(column)
    if not years:
        return F.month(date) == month
    test = F.lit(False)
    for year in years:
        after = dt.date(year + month // 12, month % 12 + 1, 1)
        test = test | ((date >= F.lit(dt.date(year, month, 1))) & (date < F.lit(after)))
    return test


def _pick(labels: tuple[str, ...], index: Column) -> Column:
    return F.get(F.array(*[F.lit(label) for label in labels]), index)


def date_label_es(date: Column) -> Column:
    """``Lunes, 02 de Marzo de 2026``."""
    return F.concat(
        _pick(S.WEEKDAYS, F.weekday(date)),
        F.lit(", "),
        F.date_format(date, "dd"),
        F.lit(" de "),
        _pick(S.MONTHS, F.month(date) - 1),
        F.lit(" de "),
        F.date_format(date, "yyyy"),
    )


def short_month_label(month: Column) -> Column:
    """``Ene`` .. ``Dic``; month 0 is the label of "all months"."""
    return F.when(month == 0, F.lit(S.ALL_MONTHS_LABEL)).otherwise(_pick(S.SHORT_MONTHS, month - 1))


def short_date(date: Column) -> Column:
    """``2 Mar 2026`` (English month, no leading zero)."""
    return F.date_format(date, "d MMM yyyy")


def note(text: Column) -> Column:
    """Text in parentheses; ``()`` for null."""
    return F.concat(F.lit("("), F.coalesce(text.cast("string"), F.lit("")), F.lit(")"))


def clamp_month(month: Column, first: int = 3) -> Column:
    """Months before the season (0 included) show the season's first month."""
    return F.greatest(F.lit(first), month)


def is_time(text: Column) -> Column:
    """True for a valid time of day with seconds; leading zeros may lack."""
    return text.rlike(_TIME_PATTERN)


def parse_date(text: Column) -> Column:
    """ISO date or null; month and day may lack the leading zero."""
    return F.try_to_date(text, "yyyy-M-d")


def parse_time(text: Column) -> Column:
    """``HH:mm:ss`` when the text is a valid time of day, else null."""
    parts = F.split(text, ":")
    return F.when(is_time(text), F.concat_ws(":", *[F.lpad(F.get(parts, F.lit(i)), 2, "0") for i in range(3)]))


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))
