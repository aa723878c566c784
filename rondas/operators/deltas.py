"""Views brought up to date from what a batch changed, instead of computed anew.

A batch is given as signed rows: the changed rows as they were with ``signo`` -1 and as they are with +1. Counts are kept
tables (key, count) to which the signs are added. Numbered lists are kept with their numbers: only cells
(a group, or a group's date) that hold a signed row are numbered again, from rows of these cells alone; in other cells of the
group numbers move by what the cells before have gained or lost.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rondas import schema as S
from rondas.functions.dates import as_date
from rondas.operators.visits import is_active, upcoming_active, visit_type

SIGN = "signo"


def _same(columns: list[str], prefix: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(prefix + c)) for c in columns])


def _marked(df: DataFrame, columns: list[str], *values: Column) -> DataFrame:
    return df.select(*[F.col(c).alias(f"_s_{c}") for c in columns], *values)


def signed_rows(before: DataFrame, after: DataFrame, touched: DataFrame, keys: tuple[str, ...] = ("programada_id",)) -> DataFrame:
    """The rows of ``touched`` keys in both versions, with their sign; both versions have the same columns.

    Each version is read once for these keys; where it is kept by key or by month, only there.
    """
    asked = touched.select(*keys).distinct()
    old = before.join(asked, list(keys), "left_semi").withColumn(SIGN, F.lit(-1))
    new = after.join(asked, list(keys), "left_semi").withColumn(SIGN, F.lit(1))
    return old.unionByName(new)


def updated_counts(kept: DataFrame, changes: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(keys, name): ``kept`` counts plus the signs of ``changes``; keys whose count is 0 go."""
    gained = changes.groupBy(*keys).agg(F.sum(SIGN).cast("long").alias(name))
    return kept.select(*keys, name).unionByName(gained).groupBy(*keys).agg(F.sum(name).alias(name)).filter(F.col(name) != 0)


def active_changes(changes: DataFrame) -> DataFrame:
    """Signed rows that count for ``availability.active_per_date``, by ``fecha``."""
    return changes.filter(is_active() & F.col("fecha").isNotNull())


def pending_changes(changes: DataFrame, as_of: dt.date | str, season_limit: dt.date | str) -> DataFrame:
    """Signed rows that count for ``visits.pending_confirmation_count``, by ``organizador_id``."""
    listed = F.col("fecha_lim") >= F.lit(as_date(as_of))
    overdue = visit_type(as_of, season_limit) == S.TYPE_OVERDUE
    return changes.filter(listed & overdue & F.col("organizador_id").isNotNull())


def open_changes(
    visits_before: DataFrame, visits_after: DataFrame, attendance_before: DataFrame, attendance_after: DataFrame,
    touched: DataFrame, as_of: dt.date | str,
) -> DataFrame:
    """Signed (codigo, programada_id) that count for ``attendance.open_invitation_count``, by ``codigo``.

    ``touched`` holds every visit that changed itself or in one of its answers.
    """
    asked = touched.select("programada_id").distinct()

    def pairs(visits: DataFrame, attendance: DataFrame, sign: int) -> DataFrame:
        planned = upcoming_active(visits.join(asked, "programada_id", "left_semi"), as_of).select("programada_id")
        unanswered = (F.col("asiste") == S.ANSWER_OPEN) & F.col("codigo").isNotNull()
        return (
            attendance.filter(unanswered).select("programada_id", "codigo")
            .join(planned, "programada_id", "left_semi").distinct().withColumn(SIGN, F.lit(sign))
        )

    return pairs(visits_before, attendance_before, -1).unionByName(pairs(visits_after, attendance_after, 1))


def updated_ordinals(
    kept: DataFrame,
    changes: DataFrame,
    after: DataFrame,
    keys: list[str],
    order: list[str],
    *,
    spread: str | None = None,
    name: str = "orden",
) -> DataFrame:
    """``after`` numbered as by ``ordinals.with_ordinal``, from the ``kept`` numbers of the version before.

    ``kept`` has the columns of ``after`` and ``name``; ``changes`` are the signed rows between the two versions. Of ``after``, only
    cells with a signed row are used. The cells, one per group and date, are counted from ``kept``.
    """
    present = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    cell = [*keys, spread] if spread else list(keys)
    gained = changes.filter(present).groupBy(*cell).agg(F.sum(SIGN).alias("_gana"))
    counts = kept.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n"))
    zero = F.lit(0).cast("long")
    cells = (
        counts.withColumn("_gana", F.lit(None).cast("long"))
        .unionByName(gained.withColumn("_n", zero))
        .groupBy(*cell)
        .agg(F.sum("_n").alias("_n"), F.sum("_gana").alias("_gana"))
    )
    if spread:
        # A group has at most one cell per calendar date.
        earlier = Window.partitionBy(*keys).orderBy(F.col(spread).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
        moved = F.coalesce(F.sum(F.coalesce("_gana", F.lit(0))).over(earlier), zero)
        ahead = F.coalesce(F.sum(F.col("_n") + F.coalesce("_gana", F.lit(0))).over(earlier), zero)
    else:
        moved = ahead = zero
    cells = cells.select(*cell, moved.alias("_mueve"), ahead.alias("_antes"), F.col("_gana").isNotNull().alias("_tocada"))

    quiet = _marked(cells.filter("NOT _tocada"), cell, F.col("_mueve"))
    same = kept.join(quiet, _same(cell, "_s_")).withColumn(name, F.col(name) + F.col("_mueve"))
    busy = _marked(cells.filter("_tocada"), cell, F.col("_antes"))
    place = F.row_number().over(Window.partitionBy(*cell).orderBy(*order)).cast("long")
    # Numbered inside the cell first: the offsets are joined to what the cell already is.
    anew = after.filter(present).join(busy, _same(cell, "_s_")).withColumn(name, place + F.col("_antes"))
    return same.select(*kept.columns).unionByName(anew.select(*kept.columns))
