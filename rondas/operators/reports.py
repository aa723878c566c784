"""Visit report lines and labelled exports."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rondas import schema as S
from rondas.functions.dates import date_label_es, in_month
from rondas.operators.attendance import answer_label, attendance_lists, attendance_matrix, attendance_roster
from rondas.operators.lookups import with_commune, with_slot_label
from rondas.operators.visits import labelled_columns

_TEXT_ITEMS = ("direccion", "orientador", "asistentes")


def _formatted(visits: DataFrame, communes: DataFrame, slots: DataFrame, *, strict: bool) -> DataFrame:
    """Report values as text: dates and times labelled, some blanks for nulls."""
    rows = with_commune(visits, communes, strict=strict).withColumn("comuna_id", F.col("comuna"))
    for column in S.TIME_COLUMNS:
        rows = with_slot_label(rows, slots, column, strict=strict)
    return rows.withColumns(
        {
            "fecha": date_label_es(F.col("fecha")),
            **{c: F.coalesce(c, F.lit("")) for c in _TEXT_ITEMS},
        }
    )


def _line(section: str, position: int, label: str, value: str) -> str:
    return (
        f"struct('{section}' AS seccion, {position} AS posicion, {label} AS etiqueta, CAST({value} AS STRING) AS valor)"
    )


def _item_lines() -> list[str]:
    return [
        _line("Información general:", n, f"'{label}'", item)
        for n, (item, label) in enumerate(S.REPORT_ITEMS.items(), start=1)
    ]


def visit_report_items(visits: DataFrame, communes: DataFrame, slots: DataFrame, *, strict: bool = False) -> DataFrame:
    """Twelve (posicion, etiqueta, valor) lines per visit."""
    rows = _formatted(visits.select("programada_id", *S.REPORT_ITEMS), communes, slots, strict=strict)
    return rows.select("programada_id", F.expr(f"inline(array({', '.join(_item_lines())}))")).drop("seccion")


def visit_report(
    visits: DataFrame,
    attendance: DataFrame,
    universities: DataFrame,
    communes: DataFrame,
    slots: DataFrame,
    *,
    user: int = S.PUBLIC_USER,
) -> DataFrame:
    """Whole report of every visit as lines (seccion, posicion, etiqueta, valor).

    The public sees the general items and who comes; an accredited university
    also sees programme, notes, all three lists and its own answer.
    """
    columns = ["programada_id", "seccion", "posicion", "etiqueta", "valor"]
    shown = attendance if user != S.PUBLIC_USER else attendance.filter(F.col("asiste") == S.ANSWER_YES)
    # Joined before the lists are made: both then use one shuffle by visit.
    shown = shown.join(visits.select("programada_id"), "programada_id", "left_semi")
    roster = attendance_roster(shown, universities).select(
        "programada_id",
        F.col("titulo").alias("seccion"),
        F.col("n").alias("posicion"),
        F.lit(None).cast("string").alias("etiqueta"),
        F.concat(F.col("n").cast("string"), F.lit(") "), "universidad").alias("valor"),
    )
    lines = _item_lines()
    fields = [*S.REPORT_ITEMS]
    if user != S.PUBLIC_USER:
        lines += [
            _line("Detalle", 1, "'Asistencia/Programación'", "coalesce(asistentes_prog, '')"),
            _line("Detalle", 2, "'Observaciones'", "coalesce(observaciones, '')"),
            _line("Asistencia a visita:", 1, "_usuario", "_respuesta"),
        ]
        fields += ["asistentes_prog", "observaciones"]
    rows = visits.select("programada_id", *fields)
    if user != S.PUBLIC_USER:
        # Read off the same lists as the roster, so attendance is read and grouped once.
        mine = (
            attendance_lists(shown)
            .filter(F.array_contains("codigos", user))
            .select("programada_id", answer_label().alias("_respuesta"))
        )
        own_name = universities.filter(F.col("codigo") == user).select("universidad").scalar()
        rows = rows.join(mine, "programada_id", "left").withColumn("_usuario", own_name)
    rows = _formatted(rows, communes, slots, strict=False)
    return rows.select("programada_id", F.expr(f"inline(array({', '.join(lines)}))")).select(*columns).unionByName(roster)


def export_public(visits: DataFrame, month: int = 0, *, years: list[int] | None = None) -> DataFrame:
    """Six labelled columns of the visits of a month (0 = all), by date."""
    rows = visits.filter(in_month("fecha", month, years)) if month else visits
    shown = [c for c in S.GRID_COLUMNS if c not in ("orden", "organizador_id")]
    return labelled_columns(rows.orderBy("fecha", "orden", "programada_id"), shown)


def export_detail(
    visits: DataFrame,
    attendance: DataFrame,
    universities: Mapping[int, str],
    communes: DataFrame,
    month: int = 0,
    *,
    years: list[int] | None = None,
    strict: bool = True,
) -> DataFrame:
    """Twenty-one labelled columns and one per university; a visit nobody was asked to is left out."""
    rows = visits.filter(in_month("fecha", month, years)) if month else visits
    rows = with_commune(rows.select(*S.DETAIL_COLUMNS), communes, strict=strict)
    rows = rows.withColumn("comuna_id", F.col("comuna")).drop("comuna")
    if month:  # answers of other months are neither grouped nor shuffled twice
        attendance = attendance.join(rows.select("programada_id"), "programada_id", "left_semi")
    matrix = attendance_matrix(attendance, universities, strict=strict)
    shown = [c for c in S.DETAIL_COLUMNS if c not in ("orden", "organizador_id")]
    # Sorted last: a join does not keep the order of its input.
    ordered = rows.join(matrix, "programada_id").orderBy("fecha", "orden", "programada_id")
    return ordered.select(
        *[F.col(c).alias(S.LABELS[c]) for c in shown], *[F.col(f"`{name}`") for name in universities.values()]
    )


def date_labels(visits: DataFrame) -> DataFrame:
    return visits.select("programada_id", "fecha", date_label_es(F.col("fecha")).alias("etiqueta"))


def time_labels(visits: DataFrame, slots: DataFrame, *, strict: bool = False) -> DataFrame:
    """Slot label of start, end and set-up time of each visit."""
    rows = visits.select("programada_id", *S.TIME_COLUMNS)
    for column in S.TIME_COLUMNS:
        rows = with_slot_label(rows, slots, column, strict=strict)
    return rows
