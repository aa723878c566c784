import datetime as dt

import pytest

import fixtures as X
from rondas.operators import availability, calendar


def days(spark, *texts, column="fecha"):
    return spark.createDataFrame([(X.day(t),) for t in texts], f"{column} date")


def test_business_days(spark):
    closed = X.holidays(spark, "2026-05-01", "2026-09-18")
    wanted = days(spark, "2026-04-30", "2026-05-01", "2026-05-02", "2026-09-17", "2026-04-30")
    assert X.rows(calendar.business_day_offset(wanted, closed, 0)) == [
        (X.day("2026-04-30"), X.day("2026-04-30")),
        (X.day("2026-05-01"), X.day("2026-05-04")),
        (X.day("2026-05-02"), X.day("2026-05-04")),
        (X.day("2026-09-17"), X.day("2026-09-17")),
    ]
    # From a holiday, offset 1 is the second business day.
    assert dict(X.rows(calendar.business_day_offset(wanted, closed, 1))) == {
        X.day("2026-04-30"): X.day("2026-05-04"),
        X.day("2026-05-01"): X.day("2026-05-05"),
        X.day("2026-05-02"): X.day("2026-05-05"),
        X.day("2026-09-17"): X.day("2026-09-21"),
    }


def test_business_days_run_out(spark):
    closed = days(spark, *[(dt.date(2026, 3, 1) + dt.timedelta(i)).isoformat() for i in range(14)])
    assert X.rows(calendar.business_day_offset(days(spark, "2026-03-01"), closed, 0)) == [(X.day("2026-03-01"), None)]
    assert X.rows(calendar.business_day_offset(days(spark, "2026-03-02"), closed, 0)) == [
        (X.day("2026-03-02"), X.day("2026-03-15"))
    ]


def test_a_closed_window_gives_no_earlier_date(spark):
    closed = days(spark, *[(dt.date(2026, 3, 5) + dt.timedelta(i)).isoformat() for i in range(21)])
    pairs = spark.createDataFrame([(X.day("2026-03-10"), X.day("2026-03-02"))], "hoy date, inicio date")
    assert X.rows(calendar.next_open_date(pairs, closed)) == [(X.day("2026-03-10"), X.day("2026-03-02"), None, None)]
    with pytest.raises(Exception, match="no business day"):
        calendar.next_open_date(pairs, closed, strict=True).collect()


def test_season_over_new_year(spark):
    season = spark.createDataFrame([(2026, X.day("2025-11-01"), X.day("2026-02-27"))], "temporada int, inicio date, fin date")
    assert X.rows(calendar.season_months(season)) == [(2026, 0, "Todos")]


def test_next_open_date(spark):
    pairs = spark.createDataFrame(
        [(X.day("2026-01-10"), X.day("2026-03-01")), (X.day("2026-06-13"), X.day("2026-03-01"))], "hoy date, inicio date"
    )
    got = calendar.next_open_date(pairs, X.holidays(spark))
    assert X.rows(got, "hoy", "fecha", "mes") == [
        (X.day("2026-01-10"), X.day("2026-03-02"), 3), (X.day("2026-06-13"), X.day("2026-06-15"), 6),
    ]


def test_calendar_page(spark):
    # August 2026 opens on a Saturday: its first row is the week of the 3rd.
    index = calendar.calendar_index(days(spark, "2026-08-20", "2026-08-01"), column="fecha")
    cells = {r.fecha.day: (r.fila, r.columna) for r in index.collect()}
    assert len(cells) == 21 and cells[3] == (0, 0) and cells[7] == (0, 4) and cells[31] == (4, 0)
    assert X.rows(calendar.calendar_shape(index)) == [(X.day("2026-08-01"), 5, 5)]
    # April 2026 opens on a Wednesday.
    april = {r.fecha.day: (r.fila, r.columna) for r in calendar.calendar_index(days(spark, "2026-04-09"), column="fecha").collect()}
    assert april[1] == (0, 2) and april[6] == (1, 0) and april[30] == (4, 3)


def test_day_events_are_cut_and_ordered(spark):
    got = X.rows(calendar.calendar_day_events(X.edge_visits(spark), 7))
    assert got == [
        (7, 1, 1, 9, "Colegio 9"),
        (7, 1, 2, 7, X.LONG_NAME[:40]),
        (7, 1, 3, 8, "Colegio 8"),
    ]
    assert len(got[1][4]) == 40


def test_day_events_merge_years(spark):
    df = X.visits(spark, X.visit(1, "2027-03-02"), X.visit(2, "2026-03-02"), X.visit(3, "2026-03-02", orden=0))
    assert X.rows(calendar.calendar_day_events(df), "mes", "dia", "n", "programada_id") == [(3, 2, 1, 3), (3, 2, 2, 2), (3, 2, 3, 1)]


def test_grid(spark):
    got = calendar.calendar_grid(X.edge_visits(spark), 6)
    by_day = {}
    for r in got.collect():
        by_day.setdefault(r.fecha.day, []).append((r.fila, r.columna, r.n, r.nombre))
    assert len(by_day) == 22  # weekdays of June 2026
    assert by_day[2] == [(0, 1, None, None)]
    assert sorted(by_day[1]) == [(0, 0, 1, "Colegio 5"), (0, 0, 2, "Colegio 6")]
    assert X.rows(calendar.calendar_grid_misses(X.edge_visits(spark)), "programada_id") == [(3,), (4,)]


def test_season_months(spark):
    season = spark.createDataFrame([(2026, X.day("2026-03-01"), X.day("2026-11-30"))], "temporada int, inicio date, fin date")
    got = [(r.value, r.label) for r in calendar.season_months(season).orderBy("value").collect()]
    assert got[0] == (0, "Todos") and got[1] == (3, "Mar") and got[-1] == (11, "Nov") and len(got) == 10


def test_blocked_and_own_date(spark):
    visits = X.edge_visits(spark)
    blocked = availability.blocked_dates(visits, 3)
    assert X.rows(blocked) == [(X.day("2026-07-01"), 3)]
    asked = spark.createDataFrame(
        [(1, X.day("2026-07-01"), None), (2, X.day("2026-07-01"), X.day("2026-07-01")),
         (3, X.day("2026-07-02"), None), (4, X.day("2026-07-01"), X.day("2026-07-02"))],
        "id int, fecha date, fecha_propia date",
    )
    assert X.rows(availability.date_availability(asked, blocked), "id", "bloqueada") == [
        (1, True), (2, False), (3, False), (4, True),
    ]


def replay(used, requests, capacity):
    """One request after the other."""
    used, decisions = dict(used), {}
    for seq, fecha, rbd, estatus, own in sorted(requests):
        if not rbd or fecha is None:
            decisions[seq] = "ignorada"
        elif fecha == own:
            decisions[seq] = "aceptada"
        elif used.get(fecha, 0) >= capacity:
            decisions[seq] = "rechazada"
        else:
            decisions[seq] = "aceptada"
            used[fecha] = used.get(fecha, 0) + (estatus in ("Confirmada", "Por confirmar"))
    return decisions


def test_guard_equals_a_replay(spark):
    import random

    rng = random.Random(7)
    dates = [X.day(f"2026-07-{d:02d}") for d in range(1, 6)] + [None]
    visits = X.visits(
        spark, *[X.visit(i, f"2026-07-{rng.randint(1, 5):02d}", rng.choice(["Confirmada", "Suspendida"])) for i in range(12)]
    )
    used = {r.fecha: r.activas for r in availability.blocked_dates(visits, 1).collect()}
    requests = [
        (seq, rng.choice(dates), rng.choice([None, 0, 5, 6, 7]), rng.choice(["Confirmada", "Suspendida", "Por confirmar"]),
         rng.choice([None, None, dates[0], dates[1]]))
        for seq in range(120)
    ]
    df = spark.createDataFrame(requests, "seq long, fecha date, rbd long, estatus string, fecha_propia date")
    for capacity in (1, 4, 9):
        got = dict(X.rows(availability.guard_requests(visits, df, capacity), "seq", "decision"))
        assert got == replay(used, requests, capacity)
