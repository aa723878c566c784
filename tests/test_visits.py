import pytest
from pyspark.sql import functions as F

import fixtures as X
from rondas import schema as S
from rondas.functions import dates as D
from rondas.operators import lookups
from rondas.operators import visits as V


def test_visit_type_branches(spark):
    got = X.rows(X.edge_visits(spark).select("programada_id", V.visit_type(X.AS_OF, X.LIMIT)))
    assert dict(got) == {1: 0, 2: 3, 3: 1, 4: 2, 5: 2, 6: 2, 7: 0, 8: 0, 9: 0, 10: 1, 11: 1}


def test_agenda_numbers_each_organiser(spark):
    got = X.rows(V.organizer_agenda(X.edge_visits(spark), X.AS_OF, X.LIMIT), "organizador_id", "orden", "programada_id")
    # The visit without a date comes first, the one past its limit is gone.
    assert [r for r in got if r[0] == 1] == [(1, 1, 11), (1, 2, 10), (1, 3, 5), (1, 4, 3), (1, 5, 4), (1, 6, 1), (1, 7, 2)]
    assert [r for r in got if r[0] == 2] == [(2, 1, 9), (2, 2, 7), (2, 3, 8)]


def test_agenda_of_one_user(spark):
    whole = V.organizer_agenda(X.edge_visits(spark), X.AS_OF, X.LIMIT).filter("organizador_id = 2")
    assert X.rows(V.organizer_agenda(X.edge_visits(spark), X.AS_OF, X.LIMIT, user=2)) == X.rows(whole)


def test_pending_count(spark):
    assert X.rows(V.pending_confirmation_count(X.edge_visits(spark), X.AS_OF, X.LIMIT)) == [(1, 3)]


def test_month_filter_shows_every_status(spark):
    ids = lambda df: [r.programada_id for r in df.collect()]
    assert ids(V.visits_by_month(X.edge_visits(spark), 6)) == [5, 6, 3, 4, 1, 2]
    assert ids(V.visits_by_month(X.edge_visits(spark), 6, years=[2026])) == [5, 6, 3, 4, 1, 2]
    assert ids(V.visits_by_month(X.edge_visits(spark), 6, years=[2025])) == []
    assert len(ids(V.visits_by_month(X.edge_visits(spark)))) == 11


def test_december_with_years(spark):
    df = X.visits(spark, X.visit(1, "2026-12-31"), X.visit(2, "2027-01-01"), X.visit(3, "2026-11-30"))
    assert X.rows(V.visits_by_month(df, 12, years=[2026]), "programada_id") == [(1,)]


def test_one_date(spark):
    got = V.visits_on_date(X.edge_visits(spark), "2026-07-01")
    assert X.rows(got, "orden", "programada_id") == [(1, 9), (2, 7), (3, 8)]
    assert X.rows(V.visits_on_date(X.edge_visits(spark), "2026-06-16")) == []  # suspended


def test_edit_flags(spark):
    got = {r.programada_id: r for r in V.edit_flags(X.edge_visits(spark), X.AS_OF, X.LIMIT).collect()}
    assert (got[1].respuesta_editable, got[1].visita_editable, got[1].realizacion_confirmable) == (True, True, False)
    assert (got[2].visita_editable, got[3].realizacion_confirmable, got[4].realizacion_confirmable) == (True, True, True)
    assert (got[6].visita_editable, got[6].realizacion_confirmable) == (False, False)
    assert got[11].respuesta_editable is False


def test_fetch_by_id(spark):
    wanted = spark.createDataFrame([(1,), (1,), (99,)], "programada_id long")
    assert X.rows(V.visits_by_id(X.edge_visits(spark), wanted), "programada_id") == [(1,)]
    assert X.rows(V.unknown_ids(X.edge_visits(spark), wanted)) == [(99,)]


def test_text_filter_ignores_case_and_reads_numbers_as_text(spark):
    df = X.edge_visits(spark)
    assert X.rows(V.column_filter_sort(df, {"nombre": "ÑUÑOA"}), "programada_id") == [(7,)]
    assert V.column_filter_sort(df, {"rbd": "10"}).count() == 11
    got = V.column_filter_sort(df, sort=["organizador"], descending=["organizador"]).collect()
    assert [r.programada_id for r in got][:4] == [7, 8, 9, 1]


def test_labels(spark):
    df = V.labelled_columns(X.edge_visits(spark), S.GRID_COLUMNS)
    assert df.columns == ["ID", "orden", "Fecha", "RBD", "Colegio", "Código", "Organizador", "Estatus"]


def test_small_expressions(spark):
    df = spark.createDataFrame([("2026-03-02", "a", 1), (None, None, 0)], "f string, t string, m int")
    df = df.withColumn("f", F.to_date("f"))
    got = df.select(
        D.date_label_es(F.col("f")),
        D.short_date(F.col("f")),
        D.note(F.col("t")),
        D.clamp_month(F.col("m")),
        D.short_month_label(F.col("m")),
    ).collect()
    assert tuple(got[0]) == ("Lunes, 02 de Marzo de 2026", "2 Mar 2026", "(a)", 3, "Ene")
    assert tuple(got[1]) == (None, None, "()", 3, "Todos")


def test_all_weekday_and_month_labels(spark):
    df = spark.sql("SELECT explode(sequence(DATE'2026-01-01', DATE'2026-12-31')) AS f")
    for f, label in df.select("f", D.date_label_es(F.col("f"))).collect():
        assert label == f"{S.WEEKDAYS[f.weekday()]}, {f:%d} de {S.MONTHS[f.month - 1]} de {f.year}"


def test_school_lookup(spark):
    asked = spark.createDataFrame([(1, 100), (2, 200), (3, 300), (4, None)], "id int, rbd long")
    got = lookups.school_enrichment(asked, X.schools(spark), X.communes(spark))
    assert X.rows(got, "id", "nombre", "comuna_id", "comuna") == [
        (1, "Liceo A", 7, "Ñuñoa"), (2, "Liceo B", 99, None), (3, None, None, None), (4, None, None, None),
    ]
    assert X.rows(lookups.lookup_misses(asked, X.schools(spark), "rbd", "rbd")) == [(300, 1)]


def test_strict_lookup_fails_on_unknown_keys_only(spark):
    fine = X.visits(spark, X.visit(1, "2026-06-15"), X.visit(2, "2026-06-15", comuna_id=None))
    assert X.rows(lookups.with_commune(fine, X.communes(spark), strict=True), "comuna") == [("Ñuñoa",), (None,)]
    with pytest.raises(Exception, match="no commune for a key"):
        lookups.with_commune(X.edge_visits(spark), X.communes(spark), strict=True).collect()


def test_users(spark):
    active = lookups.active_universities(X.universities(spark), [4])
    assert X.rows(lookups.users(active)) == [(0, S.PUBLIC_USER_LABEL), (1, "U uno"), (2, "U dos")]
    assert lookups.options(active, "codigo", "universidad").columns == ["value", "label"]
