"""Differences between versions of a visit, and snapshots with changes applied.

Changes arrive as tables. A field change is a row (seq, programada_id, accion,
campo, valor): a change to null is a row with a null ``valor``, an untouched
field has no row. Several changes to one field of one visit are settled by the
largest ``seq``. Every function reduces its change table to one row per key with
a map-side aggregate, so a key with very many changes costs no more than one
with a few, and then joins the snapshot once. That reduced table is written to
the shared folder when the function is called; Spark reads its size from the files
and broadcasts it while it is small, and the snapshot then needs no shuffle.

What cannot be applied (an unknown visit, pair, field or action) changes nothing and
is listed by ``rejected_changes`` and ``unmatched``.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rondas import schema as S
from rondas.functions.checks import fail_when
from rondas.functions.dates import as_date, blank_to_null, parse_date, parse_time
from rondas.operators.calendar import business_day_offset
from rondas.operators.ordinals import HOT_ROWS, number_all, with_ordinal
from rondas.sources.shared import write_out

PATCH, DELETE = "patch", "delete"
KEY = "programada_id"
#: Fields that a form may not leave empty.
REQUIRED = ("fecha",)


# ------------------------------------------------------------------ transport


def transport_encode(visits: DataFrame) -> DataFrame:
    """Dates as ISO text; times already are text."""
    return visits.withColumns({c: F.col(c).cast("string") for c in S.DATE_COLUMNS})


def transport_decode(rows: DataFrame, *, strict: bool = False) -> DataFrame:
    """Typed visits from transport rows. Text that is no date or time becomes null, or fails the query if strict."""
    parsed = {
        **{c: parse_date(F.col(c)) for c in S.DATE_COLUMNS},
        **{c: parse_time(F.col(c)) for c in S.TIME_COLUMNS},
    }
    if strict:
        parsed = {c: fail_when(_unreadable(c, p), f"no date or time in {c}", p) for c, p in parsed.items()}
    return rows.withColumns(parsed)


def _unreadable(column: str, parsed: Column) -> Column:
    return F.col(column).isNotNull() & (F.col(column) != "") & parsed.isNull()


def undecodable(rows: DataFrame) -> DataFrame:
    """(programada_id, campo, valor) of the texts that ``transport_decode`` cannot read."""
    bad = [
        F.when(_unreadable(c, parse(F.col(c))), F.struct(F.lit(c).alias("campo"), F.col(c).alias("valor")))
        for columns, parse in ((S.DATE_COLUMNS, parse_date), (S.TIME_COLUMNS, parse_time))
        for c in columns
    ]
    return rows.select(KEY, F.inline(F.array_compact(F.array(*bad))))


# ----------------------------------------------------------------- difference


def changed_fields(stored: DataFrame, submitted: DataFrame) -> DataFrame:
    """One row per field whose submitted value differs from the stored one.

    ``submitted`` is in transport form; its empty texts count as null. A value
    that was removed is a change too. A ``seq`` column is kept. Forms for visits that are
    not stored have no rows here; ``unmatched`` lists them.
    """
    fields = S.FORM_FIELDS
    keys = [c for c in ("seq", "programada_id") if c in submitted.columns]
    old = transport_encode(stored).selectExpr("programada_id", *[f"CAST({f} AS STRING) AS _{f}" for f in fields])
    new = submitted.selectExpr(*keys, *[f"nullif(CAST({f} AS STRING), '') AS {f}" for f in fields])
    entries = ", ".join(
        f"CASE WHEN NOT ({f} <=> _{f}) THEN struct('{f}' AS campo, _{f} AS anterior, {f} AS nuevo) END" for f in fields
    )
    return (
        new.join(old, "programada_id")
        .select(*keys, F.expr(f"inline(array_compact(array({entries})))"))
    )


def _normal_value(field: Column, value: Column) -> Column:
    """The value in the one form its field is stored in, null when it has none."""
    return (
        F.when(field.isin(*S.DATE_COLUMNS), parse_date(value).cast("string"))
        .when(field.isin(*S.TIME_COLUMNS), parse_time(value))
        .when(field == "comuna_id", value.try_cast("int").cast("string"))
        .otherwise(value)
    )


def typed_patch(changes: DataFrame, *, field: str = "campo", value: str = "valor") -> DataFrame:
    """Bring changed values into stored form; ``valido`` is false where a value does not fit its field.

    Emptying a field that needs a value does not fit either.
    """
    normal = _normal_value(F.col(field), F.col(value))
    empty_time = F.col(field).isin(*S.TIME_COLUMNS) & (F.col(value) == "")
    emptied = F.col(value).isNull() & ~F.col(field).isin(*REQUIRED)
    valid = emptied | normal.isNotNull() | empty_time
    return changes.withColumns({value: normal, "valido": F.coalesce(valid, F.lit(False))})


# ---------------------------------------------------------------------- apply


def _stored(field: T.StructField) -> str:
    """The change to a field as its type; a text that does not fit is an error, never a null."""
    value = f"_{field.name}.valor"
    if isinstance(field.dataType, T.StringType):
        return value
    typed = f"try_cast({value} AS {field.dataType.simpleString()})"
    return f"IF({value} IS NOT NULL AND {typed} IS NULL, raise_error('a value does not fit {field.name}'), {typed})"


def apply_changes(visits: DataFrame, changes: DataFrame) -> DataFrame:
    """Snapshot after patches and deletes. A deleted visit stays deleted whatever else was sent for it.

    Every column but the key can be patched. Values must be in stored form (see ``typed_patch``); one
    that is not fails the query rather than turning into null.
    """
    fields = [f for f in visits.schema.fields if f.name != KEY]
    # One aggregate per field: changes are shuffled once, one row per visit and task.
    latest = [
        F.expr(f"max(CASE WHEN accion = '{PATCH}' AND campo = '{f.name}' THEN struct(seq, valor) END)").alias(f"_{f.name}")
        for f in fields
    ]
    per_visit = write_out(
        changes.groupBy(KEY).agg(*latest, F.coalesce(F.max(F.col("accion") == DELETE), F.lit(False)).alias("_borrada"))
    )
    patched = [
        f.name if f.name == KEY else f"CASE WHEN _{f.name} IS NOT NULL THEN {_stored(f)} ELSE {f.name} END AS {f.name}"
        for f in visits.schema.fields
    ]
    return visits.join(per_visit, KEY, "left").filter("NOT coalesce(_borrada, false)").selectExpr(*patched)


def rejected_changes(visits: DataFrame, changes: DataFrame) -> DataFrame:
    """Changes that ``apply_changes`` cannot apply, with the reason as ``motivo``."""
    fields = [c for c in visits.columns if c != KEY]
    known = visits.select(KEY, F.lit(True).alias("_conocida"))
    action = F.coalesce(F.col("accion").isin(PATCH, DELETE), F.lit(False))
    field = (F.col("accion") == DELETE) | F.coalesce(F.col("campo").isin(*fields), F.lit(False))
    reason = (
        F.when(~action, "accion desconocida")
        .when(~field, "campo desconocido")
        .when(F.col("_conocida").isNull(), "visita desconocida")
    )
    return (
        changes.join(known, KEY, "left")
        .select(*changes.columns, reason.alias("motivo"))
        .filter(F.col("motivo").isNotNull())
    )


def unmatched(snapshot: DataFrame, changes: DataFrame, keys: tuple[str, ...] = (KEY,)) -> DataFrame:
    """Changes whose key is not in the snapshot: forms, closings or answers that find nothing to change."""
    return changes.join(snapshot.select(*keys), list(keys), "left_anti").select(*changes.columns)


def insert_visits(
    visits: DataFrame, requests: DataFrame, season_limit: dt.date | str, *, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Snapshot with new visits added.

    Zero and empty inputs become null. Ids continue after the largest one in
    ``seq`` order, ``orden`` after the largest of the date, also in ``seq`` order; ``fecha_lim``
    starts at the season limit. A visit without a date has no place in one.
    """
    # A number, not rows, comes to the driver.
    last_id = visits.agg(F.max(KEY)).first()[0] or 0
    new = new_visits(visits, requests, season_limit, last_id=last_id, hot_rows=hot_rows)
    return visits.select(*S.VISIT_SCHEMA.fieldNames()).unionByName(new)


def new_visits(
    visits: DataFrame, requests: DataFrame, season_limit: dt.date | str, *, last_id: int, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """The rows that ``insert_visits`` adds. Of ``visits``, only those on the dates asked for matter."""
    numbered = number_all(requests, ["seq"], name="_n")
    dated = with_ordinal(numbered, ["fecha"], ["seq"], name="_k", hot_rows=hot_rows)
    # One row per calendar date.
    last_place = visits.groupBy("fecha").agg(F.max("orden").alias("_ultimo"))
    undated = numbered.filter(F.col("fecha").isNull()).withColumns(
        {"_k": F.lit(None).cast("long"), "_ultimo": F.lit(None).cast("long")}
    )
    new = dated.join(last_place, "fecha", "left").unionByName(undated)
    columns = []
    for f in S.VISIT_SCHEMA.fields:
        if f.name == "programada_id":
            value = F.lit(last_id) + F.col("_n")
        elif f.name == "fecha_lim":
            value = F.lit(as_date(season_limit))
        elif f.name == "orden":
            value = F.coalesce("_ultimo", F.lit(0)) + F.col("_k")
        elif f.name not in requests.columns:
            value = F.lit(None)
        elif isinstance(f.dataType, T.StringType):
            value = blank_to_null(F.col(f.name))
        elif isinstance(f.dataType, T.DateType):
            value = F.col(f.name)
        else:
            value = F.nullif(F.col(f.name), F.lit(0))
        columns.append(value.cast(f.dataType).alias(f.name))
    return new.select(*columns)


def close_visits(visits: DataFrame, closings: DataFrame, holidays: DataFrame) -> DataFrame:
    """Set the outcome of visits: (seq, programada_id, estatus, hoy), ``hoy`` being the day of the change.

    A closing that repeats the current status does nothing. One that changes it
    also moves ``fecha_lim`` forward to the business day after ``hoy``, if that
    is earlier. Several closings for one visit act one by one in ``seq`` order, whether their days
    go forward or back. A day whose window has no business day left fails the query.
    """
    next_day = business_day_offset(closings, holidays, 1, column="hoy", strict=True)
    dated = closings.join(next_day.withColumnRenamed("fecha", "hoy"), "hoy", "left")
    # A closing acts if its status differs from the one before; the first one is compared with the stored status
    # below. The closings of one visit are sorted, never gathered.
    before = F.lag("estatus").over(Window.partitionBy(KEY).orderBy("seq"))
    per_visit = write_out(
        dated.withColumn("_antes", before)
        .groupBy(KEY)
        .agg(
            F.max(F.struct("seq", "estatus"))["estatus"].alias("_estatus"),
            F.min(F.struct("seq", "estatus", "habil")).alias("_primera"),
            F.min(F.when(F.col("_antes") != F.col("estatus"), F.col("habil"))).alias("_despues"),
        )
    )
    first = F.when(F.coalesce("estatus", F.lit("")) != F.col("_primera.estatus"), F.col("_primera.habil"))
    return (
        visits.join(per_visit, KEY, "left")
        .withColumns({"fecha_lim": F.least("fecha_lim", first, "_despues"), "estatus": F.coalesce("_estatus", "estatus")})
        .select(*visits.columns)
    )


def _set_answer(attendance: DataFrame, answers: DataFrame, column: str) -> DataFrame:
    key = [KEY, "codigo"]
    latest = write_out(answers.groupBy(*key).agg(F.max(F.struct("seq", F.col(column).alias("_valor"))).alias("_nuevo")))
    value = F.when(F.col("_nuevo").isNotNull(), F.col("_nuevo._valor")).otherwise(F.col(column))
    return attendance.join(latest, key, "left").withColumn(column, value).select(*attendance.columns)


def answer_invitation(attendance: DataFrame, answers: DataFrame) -> DataFrame:
    """Set ``asiste`` of (visit, university) pairs: rows (seq, programada_id, codigo, asiste)."""
    return _set_answer(attendance, answers, "asiste")


def flag_invitation(attendance: DataFrame, flags: DataFrame) -> DataFrame:
    """Set ``invitacion`` of (visit, university) pairs: rows (seq, programada_id, codigo, invitacion)."""
    return _set_answer(attendance, flags, "invitacion")
