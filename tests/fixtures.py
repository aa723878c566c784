"""Small hand-made tables that reach every branch."""

import datetime as dt

from rondas import schema as S

AS_OF = dt.date(2026, 6, 15)  # a Monday
LIMIT = dt.date(2026, 12, 31)
LONG_NAME = "Liceo Bicentenario Ñuñoa José Núñez Ávalos de Educación"


def day(text):
    return dt.date.fromisoformat(text)


def visit(programada_id, fecha, estatus=S.CONFIRMED, **values):
    row = {f.name: None for f in S.VISIT_SCHEMA.fields}
    row.update(
        programada_id=programada_id,
        orden=1,
        organizador_id=1,
        organizador="U1",
        fecha=day(fecha) if fecha else None,
        rbd=100,
        nombre=f"Colegio {programada_id}",
        comuna_id=7,
        estatus=estatus,
        fecha_lim=LIMIT,
    )
    row.update(values)
    return tuple(row[f.name] for f in S.VISIT_SCHEMA.fields)


def visits(spark, *rows):
    return spark.createDataFrame(list(rows), S.VISIT_SCHEMA)


def edge_visits(spark):
    return visits(
        spark,
        visit(1, "2026-06-15", hora_ini="09:15:00", hora_fin="10:45:00"),  # today
        visit(2, "2026-06-16", S.SUSPENDED),
        visit(3, "2026-06-14", S.DONE),  # past, never closed
        visit(4, "2026-06-14", S.DONE, fecha_lim=day("2026-06-16")),  # past and closed
        visit(5, "2026-06-01", S.DONE, fecha_lim=AS_OF),  # last day it is seen
        visit(6, "2026-06-01", S.DONE, fecha_lim=day("2026-06-14")),  # no longer seen
        visit(7, "2026-07-01", S.UNCONFIRMED, organizador_id=2, organizador="U2", nombre=LONG_NAME, orden=2),
        visit(8, "2026-07-01", S.UNCONFIRMED, organizador_id=2, organizador="U2", comuna_id=99, orden=2),
        visit(9, "2026-07-01", organizador_id=2, organizador="U2", comuna_id=None, orden=1),
        visit(10, "2026-03-02", S.SUSPENDED, direccion="Calle 1", asistentes="40"),
        visit(11, None, S.UNCONFIRMED, fecha_lim=LIMIT),
    )


def attendance(spark, *rows):
    return spark.createDataFrame(list(rows), S.ATTENDANCE_SCHEMA)


def edge_attendance(spark):
    return attendance(
        spark,
        (1, 1, 1, 0),
        (1, 2, 2, 1),
        (1, 26, 2, 1),  # excluded university
        (2, 2, 2, 1),  # suspended visit
        (3, 2, 2, 1),  # past visit
        (7, 1, 2, 1),
        (7, 2, 1, 0),
        (8, 1, 2, 1),
        (9, 1, 0, 1),
        (9, None, 1, 1),
    )


UNIVERSITIES = {1: "U uno", 2: "U dos", 4: "U cuatro"}


def universities(spark):
    return spark.createDataFrame(list(UNIVERSITIES.items()), S.UNIVERSITY_SCHEMA)


def communes(spark):
    return spark.createDataFrame([(7, "Ñuñoa"), (8, "Maipú")], S.COMMUNE_SCHEMA)


def schools(spark):
    return spark.createDataFrame([(100, "Liceo A", 7), (200, "Liceo B", 99)], S.SCHOOL_SCHEMA)


def slots(spark):
    rows = [(f"{h:02d}:{m:02d}:00", f"{h:02d}:{m:02d}") for h in range(24) for m in (0, 15, 30, 45)]
    return spark.createDataFrame(rows, S.SLOT_SCHEMA)


def holidays(spark, *extra, year=2026):
    days = [dt.date(year, 1, 1) + dt.timedelta(n) for n in range(365)]
    rows = [(d,) for d in days if d.weekday() > 4] + [(day(e),) for e in extra]
    return spark.createDataFrame(sorted(set(rows)), S.HOLIDAY_SCHEMA)


def rows(df, *columns):
    """Sorted plain tuples."""
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)
