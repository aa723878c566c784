"""Every operator as a query over the star-schema test tables.

Requests, forms, answers and closings, which the application gets from its
users, are derived here from whole tables by plain rules.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rondas import schema as S
from rondas.functions import dates as D
from rondas.operators import attendance as A
from rondas.operators import availability, calendar, changes, deltas, lookups, replay, reports, textindex
from rondas.operators import visits as V
from rondas.operators.ordinals import with_ordinal
from rondas.plans import editing, screens
from rondas.sources import keyed, monthly, sinks, sqlviews, tables, workbook
from rondas.sources import star_schema as X
from rondas.sources.shared import shared_dir, write_out

Query = Callable[[SparkSession, str], DataFrame]

MONTH = 6
RANGE_ROWS = 100
#: Visits of this year are edited in a batch, and universities with lower codes answer in one.
SEASON = 1998
ANSWERING = 9
REPORT_USER = 1


def _season(spark: SparkSession, d: str) -> screens.Season:
    return screens.Season(X.AS_OF, X.SEASON_LIMIT, X.capacity(spark, d))


def _universities(spark: SparkSession, d: str) -> DataFrame:
    return lookups.active_universities(X.all_universities(spark, d), X.EXCLUDED_CODES)


def _tables(spark: SparkSession, d: str) -> screens.Tables:
    return screens.Tables(
        visits=X.visits(spark, d),
        attendance=X.attendance(spark, d),
        universities=_universities(spark, d),
        schools=X.schools(spark, d),
        communes=X.communes(spark, d),
        holidays=X.holidays(spark, d),
        slots=X.time_slots(spark),
    )


# -------------------------------------------------- inputs derived from tables


def _forms(visits: DataFrame) -> DataFrame:
    """A submitted form per visit: moved, confirmed, cleared, annotated or untouched by priority."""
    edited = {
        "fecha": "CAST(IF(observaciones = '1-URGENT', date_add(fecha, 7), fecha) AS STRING) AS fecha",
        "estatus": f"IF(observaciones = '2-HIGH', '{S.CONFIRMED}', estatus) AS estatus",
        "hora_ini": "IF(observaciones = '3-MEDIUM', '', hora_ini) AS hora_ini",
        "observaciones": "IF(observaciones = '5-LOW', 'Urgente', observaciones) AS observaciones",
    }
    return visits.selectExpr("programada_id", *[edited.get(f, f) for f in S.FORM_FIELDS])


def _hard_forms(visits: DataFrame) -> DataFrame:
    """The forms with a ``seq``: some hold no time of day, an empty date or a short time, some name no visit."""
    spoiled = {
        "fecha": "IF(programada_id % 17 = 0, '', fecha) AS fecha",
        "hora_ini": "IF(programada_id % 13 = 0, '99:99:99', hora_ini) AS hora_ini",
        "hora_fin": "IF(programada_id % 19 = 0, '9:05:00', hora_fin) AS hora_fin",
    }
    forms = _forms(visits).selectExpr(
        "programada_id AS seq", "programada_id", *[spoiled.get(f, f) for f in S.FORM_FIELDS]
    )
    strangers = forms.filter("programada_id % 23 = 0").withColumns(
        {"seq": -F.col("seq") - 1, "programada_id": -F.col("programada_id") - 1}
    )
    return forms.unionByName(strangers)


def _edit(spark: SparkSession, d: str) -> editing.Edit:
    visits = X.visits(spark, d)
    return editing.submit_forms(visits, _hard_forms(visits), X.capacity(spark, d))


def _mixed_changes(visits: DataFrame) -> DataFrame:
    """The change table with a school's number patched, and changes that cannot be applied."""
    extra = F.array(
        *[
            F.struct(F.lit(action).alias("accion"), F.lit(field).alias("campo"), F.lit(value).alias("valor"))
            for action, field, value in (
                (changes.PATCH, "rbd", "7"), (changes.PATCH, "color", "rojo"), ("mover", "fecha", None),
            )
        ]
    )
    key = F.col("programada_id")
    known = visits.filter(key % 29 == 0).select(key.alias("seq"), "programada_id", F.inline(extra))
    unknown = visits.filter(key % 31 == 0).select(
        key.alias("seq"),
        (-key - 1).alias("programada_id"),
        F.lit(changes.PATCH).alias("accion"),
        F.lit("direccion").alias("campo"),
        F.lit("nadie").alias("valor"),
    )
    return _field_changes(visits).unionByName(known).unionByName(unknown)


def _field_changes(visits: DataFrame) -> DataFrame:
    """Field differences of the forms as a change table, and the deletion of late suspended visits."""
    differences = changes.changed_fields(visits, _forms(visits)).select(
        F.col("programada_id").alias("seq"),
        "programada_id",
        F.lit(changes.PATCH).alias("accion"),
        "campo",
        F.col("nuevo").alias("valor"),
    )
    gone = (F.col("estatus") == S.SUSPENDED) & (F.col("fecha") < F.lit(X.AS_OF))
    deleted = visits.filter(gone).select(
        F.col("programada_id").alias("seq"),
        "programada_id",
        F.lit(changes.DELETE).alias("accion"),
        F.lit(None).cast("string").alias("campo"),
        F.lit(None).cast("string").alias("valor"),
    )
    return differences.unionByName(deleted)


def _raw_changes(spark: SparkSession, d: str) -> DataFrame:
    """Three changed texts per visit, some of them not dates or times."""
    key = F.col("o_orderkey")
    date = F.date_format("o_orderdate", "yyyy-MM-dd")
    lines = F.array(
        F.struct(
            F.lit("fecha").alias("campo"),
            F.when(key % 7 == 0, F.concat(date, F.lit("x"))).otherwise(date).alias("valor"),
        ),
        F.struct(
            F.lit("hora_fin").alias("campo"),
            F.format_string("%02d:%02d:00", (key % 26).cast("int"), (key % 60).cast("int")).alias("valor"),
        ),
        F.struct(F.lit("observaciones").alias("campo"), F.col("o_orderpriority").alias("valor")),
    )
    return X.table(spark, d, "orders").select(key.alias("programada_id"), F.inline(lines))


def _closings(visits: DataFrame) -> DataFrame:
    """Each past visit is closed some days after its date, according to its priority, and some again on another day."""
    outcome = F.when(F.col("observaciones") == "1-URGENT", S.SUSPENDED).otherwise(S.DONE)
    key = F.col("programada_id")
    again = F.when(
        key % 3 == 0,
        F.struct((2 * key + 1).alias("seq"), F.lit(S.CONFIRMED).alias("estatus"), F.date_add("fecha", 4 - (key % 7).cast("int")).alias("hoy")),
    )
    first = F.struct((2 * key).alias("seq"), outcome.alias("estatus"), F.date_add("fecha", (key % 5).cast("int")).alias("hoy"))
    return (
        visits.filter(F.col("fecha") < F.lit(X.AS_OF))
        .select("programada_id", F.inline(F.array_compact(F.array(first, again))))
        .select("seq", "programada_id", "estatus", "hoy")
    )


def _answers(attendance: DataFrame) -> DataFrame:
    """Every open answer becomes a yes or a no, after an empty one; some answers are for pairs that nobody asked."""
    rows = attendance.filter(F.col("asiste") == S.ANSWER_OPEN)
    key = F.col("programada_id")
    answer = ((key + F.col("codigo")) % 2).cast("int")
    none = F.lit(None).cast("int")
    given = F.array(
        F.struct((2 * key + 1).alias("seq"), key.alias("programada_id"), answer.alias("asiste"), answer.alias("invitacion")),
        F.struct((2 * key).alias("seq"), key.alias("programada_id"), none.alias("asiste"), none.alias("invitacion")),
        F.struct((2 * key).alias("seq"), (-key - 1).alias("programada_id"), answer.alias("asiste"), answer.alias("invitacion")),
    )
    return rows.select("codigo", F.inline(given)).select("seq", "programada_id", "codigo", "asiste", "invitacion")


def _with_closure(spark: SparkSession, d: str) -> DataFrame:
    """The holidays and three closed weeks, longer than any window of business days."""
    # One row, as the span of the holidays, makes the three weeks.
    closure = X.holidays(spark, d).agg(F.min("fecha").alias("fecha")).select(
        F.explode(F.sequence(F.lit(dt.date(1997, 7, 7)), F.lit(dt.date(1997, 7, 27)))).alias("fecha")
    )
    return X.holidays(spark, d).union(closure).distinct()


def _new_requests(spark: SparkSession, d: str) -> DataFrame:
    """A request per order for its first shipping date; suppliers stand in for schools."""
    return (
        X.table(spark, d, "lineitem")
        .groupBy("l_orderkey")
        .agg(F.min(F.col("l_shipdate").cast("date")).alias("fecha"), F.min("l_suppkey").alias("rbd"))
        .select(
            F.col("l_orderkey").alias("seq"),
            "fecha",
            "rbd",
            F.when(F.col("l_orderkey") % 5 == 0, S.SUSPENDED).otherwise(S.UNCONFIRMED).alias("estatus"),
        )
    )


def _guard_input(visits: DataFrame, new: DataFrame) -> DataFrame:
    """New visits and moves in one queue; every third is a move from the visit's own date."""
    own = visits.select(F.col("programada_id").alias("seq"), F.col("fecha").alias("_propia"))
    return new.join(own, "seq", "left").select(
        *new.columns, F.when(F.col("seq") % 3 == 0, F.col("_propia")).alias("fecha_propia")
    )


def _replay_input(visits: DataFrame, new: DataFrame) -> DataFrame:
    """Moves of urgent visits by up to two days and new visits in one queue; some visits move again later."""
    key = F.col("programada_id")
    urgent = visits.filter(F.col("observaciones") == "1-URGENT")

    def moved(seq: Column, days: Column) -> DataFrame:
        return urgent.select(
            seq.alias("seq"), key.alias("programada_id"), F.date_add("fecha", days.cast("int")).alias("fecha"),
            F.when(key % 13 == 0, S.SUSPENDED).otherwise(F.col("estatus")).alias("estatus"), F.lit(None).cast("long").alias("rbd"),
        )

    again = moved(4 * key + 2, 2 - key % 3).filter(key % 4 == 0)
    asked = new.filter(F.col("seq") % 6 == 0).select(
        (4 * F.col("seq") + 1).alias("seq"), F.lit(None).cast("long").alias("programada_id"), "fecha", "estatus", "rbd"
    )
    return moved(4 * key, key % 3).unionByName(again).unionByName(asked)


def _moves(visits: DataFrame) -> DataFrame:
    """Every visit asks for a date up to two days later than its own."""
    return visits.select(
        "programada_id",
        F.date_add("fecha", (F.col("programada_id") % 3).cast("int")).alias("fecha"),
        F.col("fecha").alias("fecha_propia"),
    )


# ------------------------------------------------------------------- queries


def visits_by_month(spark, d):
    return V.visits_by_month(X.visits(spark, d), MONTH)


def visits_all_months(spark, d):
    return V.visits_by_month(X.visits(spark, d))


def visits_on_date(spark, d):
    return V.visits_on_date(X.visits(spark, d))


def organizer_agenda(spark, d):
    return V.organizer_agenda(X.visits(spark, d), X.AS_OF, X.SEASON_LIMIT)


def pending_confirmation_count(spark, d):
    return V.pending_confirmation_count(X.visits(spark, d), X.AS_OF, X.SEASON_LIMIT)


def invitations(spark, d):
    return A.invitations(X.attendance(spark, d), X.visits(spark, d), X.communes(spark, d), X.AS_OF)


def open_invitation_count(spark, d):
    return A.open_invitation_count(X.attendance(spark, d), X.visits(spark, d), X.AS_OF)


def advisory_text(spark, d):
    return A.advisory_text(screens.advisory(_tables(spark, d), _season(spark, d)))


def advisory_hidden(spark, d):
    return A.advisory_hidden(screens.advisory(_tables(spark, d), _season(spark, d)))


def attendance_lists(spark, d):
    # Lines as they are: a university may stand several times, or without a code.
    raw = X.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("programada_id"),
        F.when(F.col("l_suppkey") % 7 != 0, F.col("l_suppkey") % X.CODES).cast("int").alias("codigo"),
        F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "R", 0).otherwise(2).alias("asiste"),
    )
    return A.attendance_lists(raw).withColumn("codigos", F.array_join("codigos", ",", "-"))


def attendance_roster(spark, d):
    return A.attendance_roster(X.attendance(spark, d), _universities(spark, d))


def attendance_lookup(spark, d):
    asked = X.visits(spark, d).select("programada_id", F.col("organizador_id").alias("codigo"))
    return A.attendance_lookup(X.attendance(spark, d), asked)


def attendance_matrix(spark, d):
    return A.attendance_matrix(X.attendance(spark, d), X.UNIVERSITY_NAMES)


def duplicate_answers(spark, d):
    raw = X.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("programada_id"), F.col("l_suppkey").cast("int").alias("codigo")
    )
    return A.duplicate_answers(raw)


def export_public(spark, d):
    return reports.export_public(X.visits(spark, d))


def export_detail(spark, d):
    return reports.export_detail(X.visits(spark, d), X.attendance(spark, d), X.UNIVERSITY_NAMES, X.communes(spark, d))


def export_detail_month(spark, d):
    return reports.export_detail(
        X.visits(spark, d), X.attendance(spark, d), X.UNIVERSITY_NAMES, X.communes(spark, d), MONTH
    )


def calendar_day_events(spark, d):
    return calendar.calendar_day_events(X.visits(spark, d))


def calendar_grid(spark, d):
    return calendar.calendar_grid(X.visits(spark, d))


def calendar_grid_misses(spark, d):
    return calendar.calendar_grid_misses(X.visits(spark, d))


def calendar_index(spark, d):
    return calendar.calendar_index(X.visits(spark, d), column="fecha")


def calendar_shape(spark, d):
    return calendar.calendar_shape(calendar.calendar_index(X.visits(spark, d), column="fecha"))


def business_day_offset(spark, d):
    return calendar.business_day_offset(X.visits(spark, d), _with_closure(spark, d), 1)


def next_open_date(spark, d):
    days = X.visits(spark, d).select(
        F.col("fecha").alias("hoy"), F.make_date(F.year("fecha"), F.lit(3), F.lit(1)).alias("inicio")
    )
    return calendar.next_open_date(days, _with_closure(spark, d))


def season_months(spark, d):
    seasons = (
        X.visits(spark, d)
        .groupBy(F.year("fecha").alias("temporada"))
        .agg(F.min("fecha").alias("inicio"), F.max("fecha").alias("fin"))
    )
    # Every other season starts half a year earlier and so goes over New Year.
    early = F.when(F.col("temporada") % 2 == 0, F.add_months("inicio", -6)).otherwise(F.col("inicio"))
    shorter = F.when(F.col("temporada") % 2 == 0, F.add_months("fin", -9)).otherwise(F.col("fin"))
    return calendar.season_months(seasons.select("temporada", early.alias("inicio"), shorter.alias("fin")))


def blocked_dates(spark, d):
    return availability.blocked_dates(X.visits(spark, d), X.capacity(spark, d))


def date_availability(spark, d):
    visits = X.visits(spark, d)
    return availability.date_availability(_moves(visits), availability.blocked_dates(visits, X.capacity(spark, d)))


def guarded_insert(spark, d):
    visits = X.visits(spark, d)
    return availability.guard_requests(visits, _guard_input(visits, _new_requests(spark, d)), X.capacity(spark, d))


def guarded_replay(spark, d):
    visits = X.visits(spark, d)
    return replay.guarded_replay(visits, _replay_input(visits, _new_requests(spark, d)), X.capacity(spark, d))


# ------------------------------------------------- an edit of one season's visits


def _season_changes(visits: DataFrame) -> DataFrame:
    """The field changes and deletions of one year's visits, each with the date its visit has."""
    year = visits.filter(F.year("fecha") == SEASON)
    own = year.select("programada_id", F.col("fecha").alias("fecha_propia"))
    return _field_changes(year).join(own, "programada_id")


def _monthly(spark: SparkSession, d: str) -> str:
    path = _folder(spark, "months")
    monthly.write_monthly(X.visits(spark, d), path)
    return path


def monthly_changes(spark, d):
    """Visits kept by month after the changes of a season were applied to the months they touch."""
    path = _monthly(spark, d)
    monthly.apply_monthly(spark, path, _season_changes(X.visits(spark, d)))
    return monthly.read_monthly(spark, path)


def monthly_closings(spark, d):
    """Visits kept by month after past ones were closed in their months."""
    path, visits = _monthly(spark, d), X.visits(spark, d)
    own = visits.select("programada_id", F.col("fecha").alias("fecha_propia"))
    monthly.close_monthly(spark, path, _closings(visits).join(own, "programada_id"), X.holidays(spark, d))
    return monthly.read_monthly(spark, path)


def monthly_inserts(spark, d):
    """Visits kept by month after new ones were added as files of their months."""
    path = _monthly(spark, d)
    monthly.insert_monthly(spark, path, _new_requests(spark, d), X.SEASON_LIMIT)
    return monthly.read_monthly(spark, path)


def month_folders(spark, d):
    """Visits of a calendar month of all years, read from the folders of that month."""
    return V.visits_by_month(monthly.read_monthly(spark, _monthly(spark, d), month=MONTH))


def _batch(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Visits before and after the changes of a season, and the signed rows between the two."""
    before = X.visits(spark, d)
    changed = write_out(_season_changes(before).drop("fecha_propia"))
    after = write_out(changes.apply_changes(before, changed))
    return before, after, write_out(deltas.signed_rows(before, after, changed))


def _occupied(visits: DataFrame) -> DataFrame:
    return availability.active_per_date(visits)


def blocked_after_batch(spark, d):
    """Full dates from the kept counts of dates and the signed rows of a batch."""
    before, _, signed = _batch(spark, d)
    counts = deltas.updated_counts(_occupied(before), deltas.active_changes(signed), ["fecha"], "activas")
    return counts.filter(F.col("activas") >= X.capacity(spark, d))


def pending_after_batch(spark, d):
    """Outcomes to confirm from the kept counts of organisers and the signed rows of a batch."""
    before, _, signed = _batch(spark, d)
    kept = V.pending_confirmation_count(before, X.AS_OF, X.SEASON_LIMIT)
    changed = deltas.pending_changes(signed, X.AS_OF, X.SEASON_LIMIT)
    return deltas.updated_counts(kept, changed, ["organizador_id"], "pendientes")


def open_after_batch(spark, d):
    """Open invitations from the kept counts of universities, after a batch of visits and one of answers."""
    before, after, signed = _batch(spark, d)
    asked = X.attendance(spark, d)
    answers = write_out(_answers(asked.filter(F.col("codigo") < ANSWERING)).drop("invitacion"))
    answered = changes.answer_invitation(asked, answers)
    kept = A.open_invitation_count(asked, before, X.AS_OF)
    touched = signed.select("programada_id").union(answers.select("programada_id"))
    changed = deltas.open_changes(before, after, asked, answered, touched, X.AS_OF)
    return deltas.updated_counts(kept, changed, ["codigo"], "invitaciones")


def on_date_after_batch(spark, d):
    """Active visits numbered within their date, of which only the dates of a batch are numbered again."""
    before, after, signed = _batch(spark, d)
    columns = ["fecha", "programada_id", F.col("orden").alias("_orden"), "rbd", "nombre", "organizador", "estatus"]

    def listed(visits: DataFrame, *more: str) -> DataFrame:
        return visits.filter(V.is_active()).select(*columns, *more)

    kept = write_out(with_ordinal(listed(before), ["fecha"], ["_orden", "programada_id"]))
    rows = deltas.updated_ordinals(kept, listed(signed, deltas.SIGN), listed(after), ["fecha"], ["_orden", "programada_id"])
    return rows.select("fecha", "programada_id", *S.DATE_GRID_COLUMNS)


def agenda_after_batch(spark, d):
    """Visits numbered per organiser, of which the dates of a batch are numbered again and later ones moved."""
    before, after, signed = _batch(spark, d)
    columns = ["organizador_id", "programada_id", F.col("orden").alias("_orden"), "fecha", "nombre"]

    def listed(visits: DataFrame, *more: str) -> DataFrame:
        return visits.filter(F.col("fecha_lim") >= F.lit(X.AS_OF)).select(*columns, *more)

    order = ["_orden", "programada_id"]
    kept = write_out(with_ordinal(listed(before), ["organizador_id"], order, spread="fecha"))
    rows = deltas.updated_ordinals(
        kept, listed(signed, deltas.SIGN), listed(after), ["organizador_id"], order, spread="fecha"
    )
    return rows.drop("_orden")


def school_enrichment(spark, d):
    # Suppliers ask too: keys beyond the schools' show the unknown case.
    asked = X.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("programada_id"), F.col("l_linenumber").alias("linea"), F.col("l_partkey").alias("rbd")
    )
    return lookups.school_enrichment(asked, X.schools(spark, d), X.communes(spark, d))


def lookup_misses(spark, d):
    asked = X.table(spark, d, "lineitem").select(F.col("l_partkey").alias("rbd"))
    return lookups.lookup_misses(asked, X.schools(spark, d), "rbd", "rbd")


def visit_report_items(spark, d):
    return reports.visit_report_items(X.visits(spark, d), X.communes(spark, d), X.time_slots(spark))


def _report(spark, d, user):
    t = _tables(spark, d)
    return reports.visit_report(t.visits, t.attendance, t.universities, t.communes, t.slots, user=user)


def visit_report_public(spark, d):
    return _report(spark, d, S.PUBLIC_USER)


def visit_report_full(spark, d):
    return _report(spark, d, REPORT_USER)


def date_label_es(spark, d):
    return reports.date_labels(X.visits(spark, d))


def time_label(spark, d):
    return reports.time_labels(X.visits(spark, d), X.time_slots(spark))


def active_universities(spark, d):
    return lookups.users(_universities(spark, d))


def university_options(spark, d):
    return lookups.options(lookups.users(_universities(spark, d)), "codigo", "universidad")


def school_options(spark, d):
    return lookups.options(X.schools(spark, d), "rbd", "nombre")


def commune_options(spark, d):
    return lookups.commune_options(X.communes(spark, d))


def slot_options(spark, d):
    """The times of day at which visits start, as options."""
    used = X.visits(spark, d).select(F.col("hora_ini").alias("hora")).distinct()
    return lookups.slot_options(X.time_slots(spark).join(used, "hora", "left_semi"))


def lookup_file(spark, d):
    """Communes written under other names and types and read as a lookup."""
    path = _folder(spark, "communes")
    X.communes(spark, d).selectExpr("CAST(comuna_id AS BIGINT) AS code", "comuna AS name").write.parquet(path)
    return tables.read_lookup(spark, path, S.COMMUNE_SCHEMA)


def attendance_file(spark, d):
    """The attendance table written with wider types and read with its declared schema."""
    path = _folder(spark, "attendance")
    X.attendance(spark, d).selectExpr(
        "CAST(codigo AS BIGINT) AS codigo", "programada_id", "CAST(asiste AS BIGINT) AS asiste", "invitacion"
    ).write.parquet(path)
    return tables.read_attendance(spark, path)


def universities_file(spark, d):
    """Universities written as one JSON object and read back; their number is that of the nations."""
    path = _folder(spark, "universities")
    entries = F.map_from_entries(F.collect_list(F.struct(F.col("codigo").cast("string"), "universidad")))
    X.all_universities(spark, d).agg(F.to_json(entries).alias("value")).write.text(path)
    return tables.read_universities(spark, path)


def ordinals_by_range(spark, d):
    """Visits numbered by status, a few groups of which one holds most rows, all of them split by range."""
    rows = X.visits(spark, d).select("estatus", "fecha", "programada_id")
    return with_ordinal(rows, ["estatus"], ["fecha", "programada_id"], name="n", hot_rows=RANGE_ROWS)


def edit_flags(spark, d):
    return V.edit_flags(X.visits(spark, d), X.AS_OF, X.SEASON_LIMIT)


def changed_fields(spark, d):
    visits = X.visits(spark, d)
    return changes.changed_fields(visits, _forms(visits))


def typed_patch(spark, d):
    return changes.typed_patch(_raw_changes(spark, d))


def apply_changes(spark, d):
    visits = X.visits(spark, d)
    return changes.apply_changes(visits, _mixed_changes(visits))


def rejected_changes(spark, d):
    visits = X.visits(spark, d)
    return changes.rejected_changes(visits, _mixed_changes(visits))


def apply_inserts(spark, d):
    return changes.insert_visits(X.visits(spark, d), _new_requests(spark, d), X.SEASON_LIMIT)


def submit_forms(spark, d):
    return _edit(spark, d).snapshot


def form_decisions(spark, d):
    return _edit(spark, d).decisions.select("seq", "fecha", "decision")


def form_invalid(spark, d):
    return _edit(spark, d).invalid


def form_unmatched(spark, d):
    return _edit(spark, d).unmatched


def add_visits(spark, d):
    t = _tables(spark, d)
    asked = _new_requests(spark, d).withColumn("organizador_id", (F.col("seq") % 2 + 1).cast("int"))
    return editing.add_visits(
        t.visits, asked, t.schools, t.communes, t.universities, X.capacity(spark, d), X.SEASON_LIMIT
    ).snapshot


def close_visits(spark, d):
    visits = X.visits(spark, d)
    return changes.close_visits(visits, _closings(visits), X.holidays(spark, d))


def answer_invitation(spark, d):
    attendance = X.attendance(spark, d)
    return changes.answer_invitation(attendance, _answers(attendance).drop("invitacion"))


def unmatched_answers(spark, d):
    attendance = X.attendance(spark, d)
    answers = _answers(attendance).drop("invitacion")
    return changes.unmatched(attendance, answers, ("programada_id", "codigo"))


def flag_invitation(spark, d):
    attendance = X.attendance(spark, d)
    return changes.flag_invitation(attendance, _answers(attendance).drop("asiste"))


def transport_encode(spark, d):
    return changes.transport_encode(X.visits(spark, d))


def transport_decode(spark, d):
    return changes.transport_decode(_raw_rows(spark, d))


def undecodable(spark, d):
    return changes.undecodable(_raw_rows(spark, d))


def _raw_rows(spark: SparkSession, d: str) -> DataFrame:
    """Visits in transport form, with bad, short and empty texts among the dates and times."""
    key = F.col("programada_id")
    return changes.transport_encode(X.visits(spark, d)).withColumns(
        {
            "fecha": F.when(key % 7 == 0, "1997-02-30").when(key % 11 == 0, "").otherwise(F.col("fecha")),
            "hora_ini": F.when(key % 5 == 0, "9:5:00").when(key % 13 == 0, "24:00:00").otherwise(F.col("hora_ini")),
            "hora_fin": F.when(key % 17 == 0, "").otherwise(F.col("hora_fin")),
        }
    )


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def export_file(spark, d):
    """The detailed export, with blanks, quotes, line breaks and empty texts, written as CSV by month and read back."""
    key = F.col("programada_id")
    texts = (
        F.when(key % 5 == 0, "  con espacios  ")
        .when(key % 5 == 1, "linea 1\nlinea 2, \"citada\"")
        .when(key % 5 == 2, "")
        .when(key % 5 == 3, "\\ fin \\")
    )
    visits = X.visits(spark, d).withColumns({"observaciones": texts, "asistentes_prog": texts})
    sheet = reports.export_detail(visits, X.attendance(spark, d), X.UNIVERSITY_NAMES, X.communes(spark, d))
    path = _folder(spark, "export")
    sinks.write_export(sheet, path, by_month_of="Fecha")
    return sinks.read_export(spark, path, sheet.schema)


def export_sheets(spark, d):
    """The public export written as spreadsheet files, one or more for each task, and read back."""
    sheet = reports.export_public(X.visits(spark, d))
    path = _folder(spark, "sheets")
    workbook.write_sheets(sheet, path)
    return workbook.read_sheets(spark, path, sheet.schema)


def page_store(spark, d):
    """The attendance table written as a page's row store and read back."""
    rows = X.attendance(spark, d)
    path = _folder(spark, "store")
    sinks.write_store(rows, path)
    return sinks.read_store(spark, path, S.ATTENDANCE_SCHEMA)


def _spoiled_store(spark: SparkSession, d: str) -> str:
    """A page's row store in which some lines are cut and some hold a word for a number."""
    rows = X.attendance(spark, d)
    key = F.col("programada_id")
    line = F.to_json(F.struct(*[F.col(c) for c in rows.columns]))
    spoiled = (
        F.when(key % 7 == 0, F.expr("substring(_linea, 1, length(_linea) - 5)"))
        .when(key % 11 == 0, F.regexp_replace("_linea", '"asiste":[0-9]', '"asiste":"quizas"'))
        .otherwise(F.col("_linea"))
    )
    path = _folder(spark, "store")
    rows.withColumn("_linea", line).select(spoiled.alias("value")).write.text(path)
    return path


def store_rows(spark, d):
    """The whole lines of a spoiled row store."""
    return sinks.checked_store(spark, _spoiled_store(spark, d), S.ATTENDANCE_SCHEMA)[0]


def store_quarantine(spark, d):
    """The broken lines of a spoiled row store."""
    return sinks.checked_store(spark, _spoiled_store(spark, d), S.ATTENDANCE_SCHEMA)[1].select("linea")


def blocked_by_sql(spark, d):
    """Moves to full dates, by a SQL table function that is joined to each of them."""
    visits = X.visits(spark, d)
    sqlviews.register(spark, visits)
    return spark.sql(
        """SELECT m.programada_id, m.fecha, b.activas
           FROM {moves} m, LATERAL (SELECT activas FROM bloqueadas(:lugares) WHERE fecha = m.fecha) b""",
        args={"lugares": X.capacity(spark, d)},
        moves=_moves(visits),
    )


def snapshot_file(spark, d):
    """The visit table written as a snapshot and read with its declared schema."""
    return tables.read_visits(spark, sinks.write_snapshot(X.visits(spark, d), _folder(spark, "visits"), 1))


def visit_by_id(spark, d):
    wanted = X.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("programada_id"))
    return V.visits_by_id(X.visits(spark, d), wanted)


def unknown_ids(spark, d):
    wanted = X.table(spark, d, "lineitem").select(F.col("l_partkey").alias("programada_id"))
    # Ids beyond the table's: negative ones, and those between.
    beyond = wanted.select((F.col("programada_id") * 7 - 500).alias("programada_id"))
    return V.unknown_ids(X.visits(spark, d), wanted.union(beyond))


def column_filter_sort(spark, d):
    rows = V.visits_on_date(X.visits(spark, d))
    return V.column_filter_sort(rows, {"nombre": "R#0000001", "estatus": "POR confirm"}, ["organizador", "estatus"])


def text_search(spark, d):
    """Visits whose school's name and status contain texts, found through the posting tables of both columns."""
    rows = X.visits(spark, d).select("programada_id", "fecha", "nombre", "estatus")
    indexes = {c: _folder(spark, f"index-{c}") for c in ("nombre", "estatus")}
    for column, path in indexes.items():
        textindex.write_index(rows, column, path)
    return textindex.search(rows, indexes, {"nombre": "r#0000001", "estatus": "IRM"})


def keyed_visits(spark, d):
    """The visits that parts ask for, from a table sorted by key."""
    path = _folder(spark, "keyed")
    keyed.write_keyed(X.visits(spark, d), path)
    wanted = X.table(spark, d, "supplier").select((F.col("s_suppkey") * 3).alias("programada_id"))
    return keyed.visits_from(spark, path, wanted)


def keyed_answers(spark, d):
    """The answers of organisers to the visits that suppliers ask for, from a table sorted by key."""
    path = _folder(spark, "keyed")
    keyed.write_keyed(X.attendance(spark, d), path, ("programada_id", "codigo"))
    asked = X.table(spark, d, "supplier").select(
        (F.col("s_suppkey") * 3).alias("programada_id"), (F.col("s_suppkey") % X.CODES).cast("int").alias("codigo")
    )
    return keyed.answers_from(spark, path, asked)


def labelled_columns(spark, d):
    return V.labelled_columns(X.visits(spark, d), [f.name for f in S.VISIT_SCHEMA.fields])


def small_projections(spark, d):
    return X.visits(spark, d).select(
        "programada_id",
        F.month("fecha").alias("mes"),
        D.clamp_month(F.month("fecha")).alias("mes_calendario"),
        D.note(D.short_date(F.col("fecha"))).alias("nota_fecha"),
        D.note(F.col("hora_ini")).alias("nota_hora"),
        D.short_month_label(F.month("fecha")).alias("mes_corto"),
    )


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        visits_by_month, visits_all_months, visits_on_date, organizer_agenda, pending_confirmation_count,
        invitations, open_invitation_count, advisory_text, advisory_hidden,
        attendance_lists, attendance_roster, attendance_lookup, attendance_matrix, duplicate_answers,
        export_public, export_detail, export_detail_month,
        calendar_day_events, calendar_grid, calendar_grid_misses, calendar_index, calendar_shape,
        business_day_offset, next_open_date, season_months,
        blocked_dates, date_availability, guarded_insert, guarded_replay,
        monthly_changes, monthly_closings, monthly_inserts, month_folders, blocked_after_batch, pending_after_batch, open_after_batch,
        on_date_after_batch, agenda_after_batch,
        school_enrichment, lookup_misses, visit_report_items, visit_report_public, visit_report_full,
        date_label_es, time_label, active_universities, university_options, school_options, commune_options, slot_options,
        lookup_file, attendance_file, universities_file, ordinals_by_range, edit_flags,
        changed_fields, typed_patch, apply_changes, rejected_changes, apply_inserts,
        submit_forms, form_decisions, form_invalid, form_unmatched, add_visits, close_visits,
        answer_invitation, flag_invitation, unmatched_answers, transport_encode, transport_decode, undecodable,
        export_file, export_sheets, page_store, store_rows, store_quarantine, blocked_by_sql, snapshot_file,
        visit_by_id, unknown_ids, column_filter_sort, text_search, keyed_visits, keyed_answers, labelled_columns, small_projections,
    )
}
