import pytest
from pyspark.sql import functions as F

import fixtures as X
from rondas import schema as S
from rondas.operators import attendance as A
from rondas.operators import reports
from rondas.operators import visits as V
from rondas.plans import screens


@pytest.fixture(scope="module")
def tables(spark):
    return screens.Tables(
        X.edge_visits(spark), X.edge_attendance(spark), X.universities(spark), X.schools(spark),
        X.communes(spark), X.holidays(spark), X.slots(spark),
    )


SEASON = screens.Season(X.AS_OF, X.LIMIT, 2)


def test_invitations_hide_past_and_suspended(tables):
    got = A.invitations(tables.attendance, tables.visits, tables.communes, X.AS_OF)
    assert X.rows(got, "codigo", "asiste", "orden", "programada_id", "comuna") == [
        (1, 0, 1, 9, None), (1, 1, 1, 1, "Ñuñoa"), (1, 2, 1, 7, "Ñuñoa"), (1, 2, 2, 8, None),
        (2, 1, 1, 7, "Ñuñoa"), (2, 2, 1, 1, "Ñuñoa"), (26, 2, 1, 1, "Ñuñoa"),
    ]
    one = A.invitations(tables.attendance, tables.visits, tables.communes, X.AS_OF, user=1, answer=2)
    assert X.rows(one, "orden", "programada_id") == [(1, 7), (2, 8)]


def test_open_count(tables):
    assert X.rows(A.open_invitation_count(tables.attendance, tables.visits, X.AS_OF)) == [(1, 2), (2, 1), (26, 1)]


def test_advisory_has_four_texts(spark):
    counts = spark.createDataFrame(
        [(1, "a", 0, 0), (2, "b", 3, 0), (4, "c", 0, 2), (9, "d", 3, 2)],
        "codigo int, universidad string, invitaciones long, pendientes long",
    )
    assert [r.texto for r in A.advisory_text(counts).orderBy("codigo").collect()] == [
        "",
        "Advertencia: Restan 3 invitaciones por confirmar asistencia.",
        "Advertencia: Permanecen 2 visitas sin confirmación de realización.",
        "Advertencia: Restan 3 invitaciones por confirmar asistencia y 2 visitas sin confirmación de realización.",
    ]
    assert X.rows(A.advisory_hidden(counts)) == [(1, True), (2, False), (4, False), (9, False)]


def test_advisory_of_all_users(tables):
    assert X.rows(screens.advisory(tables, SEASON)) == [(1, "U uno", 2, 3), (2, "U dos", 1, 0), (4, "U cuatro", 0, 0)]


def test_lists_are_sorted_and_keep_null_codes(tables):
    got = X.rows(A.attendance_lists(tables.attendance))
    assert (1, 2, [2, 26]) in got and (9, 1, [None]) in got
    assert sum(len(codes) for _, _, codes in got) == tables.attendance.count()


def test_roster(tables):
    got = X.rows(A.attendance_roster(tables.attendance, tables.universities).filter("programada_id = 1"))
    assert got == [
        (1, 1, "Universidades que asisten:", 1, 1, "U uno"),
        (1, 3, "Universidades sin confirmación:", 1, 2, "U dos"),
        (1, 3, "Universidades sin confirmación:", 2, 26, None),
    ]
    with pytest.raises(Exception, match="no university for a key"):
        A.attendance_roster(tables.attendance, tables.universities, strict=True).collect()


def test_lookup(spark, tables):
    asked = spark.createDataFrame([(1, 2), (1, 0), (1, 4)], "programada_id long, codigo int")
    assert X.rows(A.attendance_lookup(tables.attendance, asked)) == [(1, 0, None, True), (1, 2, 2, True), (1, 4, None, False)]


def test_matrix_drops_excluded_and_fills_missing(tables):
    got = {r[0]: tuple(r)[1:] for r in A.attendance_matrix(tables.attendance, X.UNIVERSITIES).collect()}
    assert got[1] == ("Sí", "No confirmada", None)
    assert got[9] == ("No", None, None)
    cells = sum(value is not None for row in got.values() for value in row)
    assert cells == tables.attendance.filter(F.col("codigo").isin(*X.UNIVERSITIES)).count()


def test_matrix_refuses_repeated_and_unknown_answers(spark):
    repeated = X.attendance(spark, (1, 1, 1, 0), (1, 1, 1, 0))
    with pytest.raises(Exception, match="answers a visit twice"):
        A.attendance_matrix(repeated, X.UNIVERSITIES).collect()
    assert X.rows(A.attendance_matrix(repeated, X.UNIVERSITIES, strict=False)) == [(1, "Sí", None, None)]
    assert X.rows(A.duplicate_answers(repeated)) == [(1, 1, 2)]
    with pytest.raises(Exception, match="unknown answer"):
        A.attendance_matrix(X.attendance(spark, (1, 1, 5, 0)), X.UNIVERSITIES).collect()
    assert X.rows(A.attendance_matrix(X.attendance(spark, (1, 1, None, 0)), X.UNIVERSITIES)) == [(1, None, None, None)]


def test_exports(tables):
    public = reports.export_public(tables.visits, 6)
    assert public.columns == ["ID", "Fecha", "RBD", "Colegio", "Organizador", "Estatus"]
    assert [r.ID for r in public.collect()] == [5, 6, 3, 4, 1, 2]
    detail = reports.export_detail(tables.visits, tables.attendance, X.UNIVERSITIES, tables.communes, strict=False)
    assert len(detail.columns) == 21 + len(X.UNIVERSITIES)
    # Visits nobody was asked to are left out, the rest is by date, order, id.
    assert [r.ID for r in detail.collect()] == [3, 1, 2, 9, 7, 8]
    with pytest.raises(Exception, match="no commune for a key"):
        reports.export_detail(tables.visits, tables.attendance, X.UNIVERSITIES, tables.communes).collect()


def test_report_items(tables):
    got = reports.visit_report_items(tables.visits, tables.communes, tables.slots)
    one = [r.valor for r in got.filter("programada_id = 1").orderBy("posicion").collect()]
    assert one == ["Confirmada", "U1", "Colegio 1", "100", "Lunes, 15 de Junio de 2026", "", "Ñuñoa", None,
                   "09:15 hrs.", "10:45 hrs.", "", ""]
    assert got.count() == 12 * 11


def test_report_roles(tables):
    arguments = (tables.visits, tables.attendance, tables.universities, tables.communes, tables.slots)
    public = reports.visit_report(*arguments)
    assert X.rows(public.filter("programada_id = 1 AND seccion != 'Información general:'"), "seccion", "valor") == [
        ("Universidades que asisten:", "1) U uno")
    ]
    full = reports.visit_report(*arguments, user=2).filter("programada_id = 1 AND seccion != 'Información general:'")
    assert X.rows(full, "seccion", "etiqueta", "valor") == [
        ("Asistencia a visita:", "U dos", "No confirmada"),
        ("Detalle", "Asistencia/Programación", ""),
        ("Detalle", "Observaciones", ""),
        ("Universidades que asisten:", None, "1) U uno"),
        ("Universidades sin confirmación:", None, "1) U dos"),
        ("Universidades sin confirmación:", None, None),
    ]


def test_refreshed_views_agree_with_the_operators(tables):
    views = screens.refresh(tables, SEASON, month=6)
    assert X.rows(views["visits_by_month"]) == X.rows(V.visits_by_month(tables.visits, 6))
    assert X.rows(views["blocked_dates"]) == [(X.day("2026-07-01"), 3)]
    assert [r.texto for r in views["advisory_text"].orderBy("codigo").collect()][2] == ""
    assert X.rows(views["advisory_hidden"]) == [(1, False), (2, False), (4, True)]
    assert S.PUBLIC_USER not in [r.codigo for r in views["advisory_hidden"].collect()]
