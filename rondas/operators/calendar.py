"""Calendar pages, business days and season months.

Everything here is computed on distinct dates or months, a table bounded by the
calendar itself, and joined back to rows where needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rondas import schema as S
from rondas.functions.checks import fail_when
from rondas.functions.dates import in_month, short_month_label
from rondas.operators.ordinals import HOT_ROWS, cell_counts, with_ordinal


def business_day_offset(
    days: DataFrame, holidays: DataFrame, offset: int, *, column: str = "fecha", strict: bool = False
) -> DataFrame:
    """The ``offset``-th non-holiday day in the 14 days from each date on, as ``habil``.

    Day 0 is the date itself unless it is a holiday. Where the window holds
    too few business days the day is null, or fails the query if strict. Returns one row per distinct date.
    """
    starts = days.select(F.col(column).alias("fecha")).filter(F.col("fecha").isNotNull()).distinct()
    window = F.sequence("fecha", F.date_add("fecha", S.BUSINESS_DAY_WINDOW - 1))
    closed = holidays.select(F.col("fecha").alias("_dia"))
    open_days = (
        starts.select("fecha", F.explode(window).alias("_dia"))
        .join(closed, "_dia", "left_anti")
        .groupBy("fecha")
        .agg(F.sort_array(F.collect_list("_dia")).alias("_dias"))  # at most 14 days
        .select("fecha", F.get("_dias", F.lit(offset)).alias("habil"))
    )
    found = starts.join(open_days, "fecha", "left")
    if not strict:
        return found
    missing = F.col("habil").isNull()
    return found.withColumn("habil", fail_when(missing, "no business day left in the window", F.col("habil")))


def next_open_date(
    days: DataFrame, holidays: DataFrame, *, today: str = "hoy", season_start: str = "inicio", strict: bool = False
) -> DataFrame:
    """First business day from the season's start and from today, whichever is later, and its month.

    Where either has no business day in its window there is no date, never an earlier one; strict makes it an error.
    """
    pairs = days.select(F.col(today).alias("hoy"), F.col(season_start).alias("inicio")).distinct()
    starts = pairs.select(F.explode(F.array("hoy", "inicio")).alias("fecha"))
    habil = business_day_offset(starts, holidays, 0, strict=strict)
    both = F.col("_desde_inicio").isNotNull() & F.col("_desde_hoy").isNotNull()
    opening = F.when(both, F.greatest("_desde_inicio", "_desde_hoy"))
    return (
        pairs.join(habil.select(F.col("fecha").alias("hoy"), F.col("habil").alias("_desde_hoy")), "hoy", "left")
        .join(habil.select(F.col("fecha").alias("inicio"), F.col("habil").alias("_desde_inicio")), "inicio", "left")
        .select("hoy", "inicio", opening.alias("fecha"), F.month(opening).alias("mes"))
    )


def _cell(day: Column) -> tuple[Column, Column]:
    """(week row, weekday column) of a Monday-to-Friday day on its month's page.

    Row 0 is the week of the month's first weekday, which is the following week
    when the month opens on a weekend.
    """
    first = F.trunc(day, "MM")
    first = F.date_add(first, F.when(F.weekday(first) > 4, 7 - F.weekday(first)).otherwise(F.lit(0)))
    row = F.floor(F.datediff(F.trunc(day, "WEEK"), F.trunc(first, "WEEK")) / 7).cast("int")
    return row, F.weekday(day)


def calendar_index(months: DataFrame, *, column: str = "mes") -> DataFrame:
    """Page position of every Monday-to-Friday day of each month; ``column`` holds any date of the month."""
    firsts = months.filter(F.col(column).isNotNull()).select(F.trunc(column, "MM").alias("mes")).distinct()
    days = firsts.select("mes", F.explode(F.sequence("mes", F.last_day("mes"))).alias("fecha"))
    row, weekday = _cell(F.col("fecha"))
    return days.filter(F.weekday("fecha") < 5).select("mes", "fecha", row.alias("fila"), weekday.alias("columna"))


def calendar_shape(index: DataFrame) -> DataFrame:
    """Rows and columns of each month's page."""
    return index.groupBy("mes").agg((F.max("fila") + 1).alias("filas"), F.lit(5).alias("columnas"))


def _events(visits: DataFrame, month: int) -> DataFrame:
    rows = visits.filter(in_month("fecha", month)) if month else visits
    return rows.select(
        "fecha",
        F.col("orden").alias("_orden"),
        "programada_id",
        F.substring("nombre", 1, S.CALENDAR_NAME_WIDTH).alias("nombre"),  # display width in characters
    )


def calendar_day_events(visits: DataFrame, month: int = 0, *, hot_rows: int = HOT_ROWS) -> DataFrame:
    """School names per (month, day), whatever the year and status, in visit order.

    One row per name with its position: a day's list has no size limit, so it is
    not gathered into an array.
    """
    rows = _events(visits, month).select(
        F.month("fecha").alias("mes"), F.dayofmonth("fecha").alias("dia"), "fecha", "_orden", "programada_id", "nombre"
    )
    return with_ordinal(
        rows, ["mes", "dia"], ["_orden", "programada_id"], name="n", spread="fecha", hot_rows=hot_rows
    ).select("mes", "dia", "n", "programada_id", "nombre")


def calendar_grid(visits: DataFrame, month: int = 0, *, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Each month's page: a row per event in its cell, and a row without event for an empty day."""
    rows = _events(visits, month).filter(F.col("fecha").isNotNull())
    # A row per date, for the numbering and for the pages.
    counts = cell_counts(rows, ["fecha"])
    dates = counts.select("fecha")
    index = calendar_index(dates, column="fecha")
    events = with_ordinal(rows, ["fecha"], ["_orden", "programada_id"], name="n", hot_rows=hot_rows, counts=counts)
    # The index has one row per calendar day at most, so it fits every executor;
    # the events are then placed without a shuffle and a crowded day stays split.
    placed = events.join(F.broadcast(index), "fecha").select("mes", "fecha", "fila", "columna", "n", "nombre")
    empty = index.join(F.broadcast(dates), "fecha", "left_anti").select(
        "mes", "fecha", "fila", "columna", F.lit(None).cast("long").alias("n"), F.lit(None).cast("string").alias("nombre")
    )
    return placed.unionByName(empty)


def calendar_grid_misses(visits: DataFrame) -> DataFrame:
    """Weekend visits: the page has no cell for them."""
    return visits.filter(F.weekday("fecha") > 4).select("programada_id", "fecha", "nombre")


def season_months(seasons: DataFrame) -> DataFrame:
    """Month options of each season (temporada, inicio, fin): 0 = all, then its months.

    A season that ends in an earlier month than it starts in, over New Year, has the option 0 alone.
    """
    within = F.month("inicio") <= F.month("fin")
    months = F.concat(F.array(F.lit(0)), F.when(within, F.sequence(F.month("inicio"), F.month("fin"))).otherwise(F.array()))
    rows = seasons.select("temporada", F.explode(months).alias("value"))
    return rows.select("temporada", "value", short_month_label(F.col("value")).alias("label"))
