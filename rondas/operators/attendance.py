"""Queries that join visits with the universities' answers."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rondas import schema as S
from rondas.functions.checks import fail_when
from rondas.operators.lookups import with_commune, with_university
from rondas.operators.ordinals import HOT_ROWS, with_ordinal
from rondas.operators.visits import upcoming_active
from rondas.sources.shared import cut_lineage


def invitations(
    attendance: DataFrame,
    visits: DataFrame,
    communes: DataFrame,
    as_of: dt.date | str,
    *,
    user: int | None = None,
    answer: int | None = None,
    strict: bool = False,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Upcoming active visits each university is invited to, numbered per (university, answer)."""
    asked = attendance.select("programada_id", "codigo", "asiste", "invitacion")
    if user is not None:
        asked = asked.filter(F.col("codigo") == user)
    if answer is not None:
        asked = asked.filter(F.col("asiste") == answer)
    planned = upcoming_active(visits, as_of).select(
        "programada_id", F.col("orden").alias("_orden"), "fecha", "rbd", "nombre", "direccion", "comuna_id"
    )
    # Joined once, for the counts and for the rows; Spark's cleaner removes it once it is out of use.
    numbered = with_ordinal(
        cut_lineage(asked.join(planned, "programada_id")),
        ["codigo", "asiste"],
        ["_orden", "programada_id"],
        spread="fecha",
        hot_rows=hot_rows,
    )
    return with_commune(numbered, communes, strict=strict).select(
        "codigo", "asiste", "programada_id", "orden", "fecha", "rbd", "nombre", "direccion", "comuna", "invitacion"
    )


def open_invitation_count(attendance: DataFrame, visits: DataFrame, as_of: dt.date | str) -> DataFrame:
    """Upcoming active visits each university has not answered."""
    return (
        attendance.filter((F.col("asiste") == S.ANSWER_OPEN) & F.col("codigo").isNotNull())
        .select("programada_id", "codigo")
        .join(upcoming_active(visits, as_of).select("programada_id"), "programada_id", "left_semi")
        .groupBy("codigo")
        .agg(F.countDistinct("programada_id").alias("invitaciones"))
    )


def advisory_counts(users: DataFrame, open_counts: DataFrame, pending_counts: DataFrame) -> DataFrame:
    """Both counts of the advisory banner, 0 where a user has none."""
    return (
        users.select("codigo", "universidad")
        .join(open_counts, "codigo", "left")
        .join(pending_counts.withColumnRenamed("organizador_id", "codigo"), "codigo", "left")
        .fillna(0, ["invitaciones", "pendientes"])
    )


def advisory_text(counts: DataFrame) -> DataFrame:
    """Banner text: nothing, invitations to answer, outcomes to confirm, or both."""
    asked = F.concat(F.lit(" "), F.col("invitaciones"), F.lit(" invitaciones por confirmar asistencia"))
    overdue = F.concat(F.lit(" "), F.col("pendientes"), F.lit(" visitas sin confirmación de realización"))
    has_asked, has_overdue = F.col("invitaciones") > 0, F.col("pendientes") > 0
    text = (
        F.when(has_asked & has_overdue, F.concat(F.lit("Advertencia: Restan"), asked, F.lit(" y"), overdue, F.lit(".")))
        .when(has_asked, F.concat(F.lit("Advertencia: Restan"), asked, F.lit(".")))
        .when(has_overdue, F.concat(F.lit("Advertencia: Permanecen"), overdue, F.lit(".")))
        .otherwise(F.lit(""))
    )
    return counts.select("codigo", "universidad", text.alias("texto"))


def advisory_hidden(counts: DataFrame) -> DataFrame:
    """True for users without anything to answer or confirm."""
    hidden = (F.col("invitaciones") == 0) & (F.col("pendientes") == 0)
    return counts.select("codigo", hidden.alias("oculta"))


def attendance_lists(attendance: DataFrame) -> DataFrame:
    """Codes per visit and answer, ascending, nulls first; every row is listed, repeated ones too.

    (programada_id, codigo) is the table's key, so a list is as long as the table
    of universities, and longer only by what breaks that rule.
    """
    codes = F.sort_array(F.collect_list("codigo"))
    nulls = F.array_repeat(F.lit(None).cast("int"), F.count_if(F.col("codigo").isNull()).cast("int"))
    listed = F.concat(nulls, codes)
    return attendance.groupBy("programada_id", "asiste").agg(listed.alias("codigos"))


def attendance_roster(attendance: DataFrame, universities: DataFrame, *, strict: bool = False) -> DataFrame:
    """Numbered names per visit and answer: who comes, who does not, who has not said."""
    ranks = F.when(F.col("asiste") == S.ANSWER_YES, 1).when(F.col("asiste") == S.ANSWER_NO, 2).otherwise(3)
    title = F.lit(None).cast("string")
    for answer, text in S.SECTION_TITLES.items():
        title = F.when(F.col("asiste") == answer, F.lit(text)).otherwise(title)
    listed = (
        attendance_lists(attendance)
        .filter(F.col("asiste").isin(*S.SECTION_TITLES))
        .select("programada_id", ranks.alias("seccion"), title.alias("titulo"), F.posexplode("codigos").alias("n", "codigo"))
        .withColumn("n", F.col("n") + 1)
    )
    return with_university(listed, universities, strict=strict).select(
        "programada_id", "seccion", "titulo", "n", "codigo", "universidad"
    )


def attendance_lookup(attendance: DataFrame, asked: DataFrame) -> DataFrame:
    """Answer of each asked (programada_id, codigo); null for the public, ``hallada`` false where no row exists."""
    answers = attendance.select("programada_id", "codigo", "asiste", F.lit(True).alias("_hit"))
    public = F.col("codigo") == S.PUBLIC_USER
    return asked.join(answers, ["programada_id", "codigo"], "left").select(
        "programada_id",
        "codigo",
        F.when(~public, F.col("asiste")).alias("asiste"),
        (public | F.coalesce("_hit", F.lit(False))).alias("hallada"),
    )


def answer_label(strict: bool = True) -> Column:
    """``No``, ``Sí`` or ``No confirmada``; null stays null."""
    label = F.lit(None).cast("string")
    for answer, text in S.ANSWER_LABELS.items():
        label = F.when(F.col("asiste") == answer, F.lit(text)).otherwise(label)
    if not strict:
        return label
    return fail_when(F.col("asiste").isNotNull() & ~F.col("asiste").isin(*S.ANSWER_LABELS), "unknown answer", label)


def attendance_matrix(attendance: DataFrame, universities: Mapping[int, str], *, strict: bool = True) -> DataFrame:
    """One row per visit, one column per active university, the answer's label in the cell.

    One integer aggregate per university with map-side combine and a single
    shuffle, where ``pivot`` needs two. Strict: a repeated (visit, university)
    or an unknown answer fails the query.
    """
    codes = list(universities)
    # -1 marks a row without an answer, so that a cell tells rows from no rows.
    cells = attendance.groupBy("programada_id").agg(
        F.count_if(F.col("codigo").isin(*codes)).alias("_filas"),
        *[F.expr(f"max(CASE WHEN codigo = {code} THEN coalesce(asiste, -1) END)").alias(f"_{code}") for code in codes],
    )
    labels = " ".join(f"WHEN {answer} THEN '{text}'" for answer, text in S.ANSWER_LABELS.items())
    if strict:
        filled = " + ".join(f"int(_{code} IS NOT NULL)" for code in codes)
        cells = cells.filter(f"CASE WHEN _filas > {filled} THEN raise_error('a university answers a visit twice') ELSE true END")
        labels += " WHEN -1 THEN NULL ELSE raise_error('unknown answer')"
    return cells.select(
        "programada_id",
        *[
            F.expr(f"CASE WHEN _{code} IS NOT NULL THEN CASE _{code} {labels} END END").alias(name)
            for code, name in universities.items()
        ],
    )


def duplicate_answers(attendance: DataFrame) -> DataFrame:
    """(visit, university) pairs that occur more than once."""
    return (
        attendance.groupBy("programada_id", "codigo")
        .agg(F.count(F.lit(1)).alias("filas"))
        .filter(F.col("filas") > 1)
    )
