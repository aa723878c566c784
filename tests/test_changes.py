import random

import pytest
from pyspark.sql import functions as F

import fixtures as X
from rondas import schema as S
from rondas.operators import changes as C
from rondas.plans import editing


def form_of(df):
    return C.transport_encode(df).select("programada_id", *S.FORM_FIELDS)


def patches(spark, *rows):
    return spark.createDataFrame(list(rows), S.CHANGE_SCHEMA)


def test_transport_round_trip(spark):
    df = X.edge_visits(spark)
    assert X.rows(C.transport_decode(C.transport_encode(df))) == X.rows(df)
    text = C.transport_encode(df).filter("programada_id = 1").first()
    assert (text.fecha, text.fecha_lim, text.hora_ini) == ("2026-06-15", "2026-12-31", "09:15:00")


def test_decode_nulls_what_is_no_date_or_time(spark):
    df = C.transport_encode(X.edge_visits(spark).filter("programada_id = 1"))
    bad = df.withColumns({"fecha": F.lit("2026-02-30"), "hora_ini": F.lit("24:00:00"), "fecha_lim": F.lit("2026-3-1")})
    got = C.transport_decode(bad).first()
    assert (got.fecha, got.hora_ini, got.fecha_lim) == (None, None, X.day("2026-03-01"))


def test_changed_fields(spark):
    stored = X.visits(spark, X.visit(1, "2026-07-01", direccion="a", hora_ini="09:00:00"), X.visit(2, "2026-07-01"))
    form = form_of(stored).withColumns(
        {
            "fecha": F.when(F.col("programada_id") == 1, "2026-07-02").otherwise(F.col("fecha")),
            "hora_ini": F.lit(""),  # cleared on 1, already null on 2
            "comuna_id": F.when(F.col("programada_id") == 1, 8).otherwise(F.col("comuna_id")),
        }
    )
    assert X.rows(C.changed_fields(stored, form)) == [
        (1, "comuna_id", "7", "8"), (1, "fecha", "2026-07-01", "2026-07-02"), (1, "hora_ini", "09:00:00", None),
    ]
    assert C.changed_fields(stored, form_of(stored)).count() == 0


def test_differences_applied_give_the_form(spark):
    stored = X.edge_visits(spark)
    form = form_of(stored).withColumns(
        {"direccion": F.concat(F.lit("Calle "), "programada_id"), "estatus": F.lit(S.SUSPENDED), "hora_fin": F.lit("11:00:00")}
    )
    found = C.changed_fields(stored, form).select(
        F.lit(1).cast("long").alias("seq"), "programada_id", F.lit("patch").alias("accion"), "campo", F.col("nuevo").alias("valor")
    )
    assert X.rows(form_of(C.apply_changes(stored, found))) == X.rows(form)


def test_typed_patch(spark):
    df = patches(
        spark,
        (1, 1, "patch", "fecha", "2026-7-3"),
        (2, 1, "patch", "fecha", "mañana"),
        (3, 1, "patch", "hora_fin", "09:15:00"),
        (4, 1, "patch", "hora_fin", "9:15"),
        (9, 1, "patch", "hora_fin", "9:5:00"),
        (10, 1, "patch", "fecha", None),
        (5, 1, "patch", "hora_ini", ""),
        (6, 1, "patch", "comuna_id", "x"),
        (7, 1, "patch", "direccion", None),
        (8, 1, "patch", "direccion", "Calle"),
    )
    got = {r.seq: (r.valor, r.valido) for r in C.typed_patch(df).collect()}
    assert got == {
        1: ("2026-07-03", True), 2: (None, False), 3: ("09:15:00", True), 4: (None, False), 5: (None, True),
        6: (None, False), 7: (None, True), 8: ("Calle", True), 9: ("09:05:00", True), 10: (None, False),
    }


def test_apply_last_patch_wins_and_deletes_stay(spark):
    df = X.visits(spark, *[X.visit(i, "2026-07-01", direccion="a", hora_ini="09:00:00") for i in range(1, 6)])
    batch = patches(
        spark,
        (2, 1, "patch", "direccion", "c"),
        (1, 1, "patch", "direccion", "b"),
        (1, 2, "patch", "hora_ini", None),
        (1, 3, "delete", None, None),
        (2, 3, "patch", "direccion", "z"),
        (1, 4, "patch", "comuna_id", "8"),
        (2, 4, "patch", "fecha", "2026-07-09"),
        (1, 99, "patch", "direccion", "nobody"),
        (1, 5, "patch", "rbd", "9"),
        (1, 5, "patch", "colour", "red"),
        (1, 5, "move", None, None),
    )
    got = {r.programada_id: r for r in C.apply_changes(df, batch).collect()}
    assert sorted(got) == [1, 2, 4, 5]
    assert (got[1].direccion, got[2].hora_ini, got[2].direccion) == ("c", None, "a")
    assert (got[4].comuna_id, got[4].fecha, got[5].direccion) == (8, X.day("2026-07-09"), "a")
    assert got[5].rbd == 9
    assert X.rows(C.rejected_changes(df, batch), "programada_id", "campo", "motivo") == [
        (5, "colour", "campo desconocido"), (5, None, "accion desconocida"), (99, "direccion", "visita desconocida"),
    ]
    assert C.apply_changes(df, batch).schema == df.schema


def test_apply_equals_one_by_one(spark):
    rng = random.Random(11)
    texts = ["direccion", "contacto", "observaciones"]
    stored = {i: {t: rng.choice([None, "a", "b"]) for t in texts} | {"comuna_id": rng.choice([None, 7])} for i in range(40)}
    df = X.visits(spark, *[X.visit(i, "2026-07-01", **values) for i, values in stored.items()])
    batch, seq = [], 0
    for _ in range(400):
        # One visit gets a third of all changes.
        key, seq = (5 if rng.random() < 1 / 3 else rng.randrange(45)), seq + 1
        if rng.random() < 0.02 and key != 5:
            batch.append((seq, key, "delete", None, None))
        else:
            field = rng.choice([*texts, "comuna_id"])
            batch.append((seq, key, "patch", field, rng.choice([None, "8", "9"])))
    expected = {i: dict(values) for i, values in stored.items()}
    for _, key, action, field, value in batch:
        if key not in expected:
            continue
        if action == "delete":
            del expected[key]
        else:
            expected[key][field] = int(value) if field == "comuna_id" and value else value
    rng.shuffle(batch)
    after = C.apply_changes(df, patches(spark, *batch))
    got = {r.programada_id: {t: r[t] for t in [*texts, "comuna_id"]} for r in after.collect()}
    assert got == expected and len(got) < len(stored)


def test_apply_refuses_a_value_in_the_wrong_form(spark):
    df = X.visits(spark, X.visit(1, "2026-07-01"))
    with pytest.raises(Exception, match="a value does not fit fecha"):
        C.apply_changes(df, patches(spark, (1, 1, "patch", "fecha", "mañana"))).collect()


def test_insert_drops_blanks_and_numbers_on(spark):
    df = X.visits(spark, X.visit(7, "2026-07-01"))
    new = spark.createDataFrame(
        [(20, 2, X.day("2026-07-05"), 0, ""), (10, 1, X.day("2026-07-04"), 300, "Calle")],
        "seq long, organizador_id int, fecha date, rbd long, direccion string",
    )
    got = {r.programada_id: r for r in C.insert_visits(df, new, X.LIMIT).collect()}
    assert sorted(got) == [7, 8, 9]
    assert (got[8].rbd, got[8].direccion, got[8].fecha_lim, got[8].orden) == (300, "Calle", X.LIMIT, 1)
    assert (got[9].rbd, got[9].direccion, got[9].organizador_id) == (None, None, 2)


def close_one_by_one(status, limit, closings, next_day):
    for _, new, today in sorted(closings):
        if new != status:
            status, limit = new, min(limit, next_day[today])
    return status, limit


def test_closing_equals_one_by_one(spark):
    from rondas.operators.calendar import business_day_offset

    rng = random.Random(3)
    closed = X.holidays(spark)
    days = [f"2026-06-{d:02d}" for d in range(10, 28)]
    next_day = dict(
        X.rows(business_day_offset(spark.createDataFrame([(X.day(t),) for t in days], "fecha date"), closed, 1))
    )
    stored = [(i, rng.choice(S.STATUSES), rng.choice([X.LIMIT, X.day("2026-06-16")])) for i in range(30)]
    df = X.visits(spark, *[X.visit(i, "2026-06-01", status, fecha_lim=limit) for i, status, limit in stored])
    closings = {}
    for i, _, _ in stored:
        times = rng.sample(range(len(days)), rng.randint(0, 4))  # days go forward and back
        closings[i] = [(k, rng.choice(S.STATUSES), X.day(days[t])) for k, t in enumerate(times)]
    rows = [(i * 10 + k, i, new, today) for i, cs in closings.items() for k, new, today in cs]
    batch = spark.createDataFrame(rows, "seq long, programada_id long, estatus string, hoy date")
    got = {r.programada_id: (r.estatus, r.fecha_lim) for r in C.close_visits(df, batch, closed).collect()}
    assert got == {i: close_one_by_one(s, limit, closings[i], next_day) for i, s, limit in stored}


def test_answers(spark):
    df = X.edge_attendance(spark)
    batch = spark.createDataFrame(
        [(1, 1, 2, 0), (2, 1, 2, 1), (1, 7, 1, None), (1, 500, 1, 1)], "seq long, programada_id long, codigo int, asiste int"
    )
    got = {(r.programada_id, r.codigo): r.asiste for r in C.answer_invitation(df, batch).collect()}
    assert (got[1, 2], got[7, 1], got[8, 1], got[9, None]) == (1, None, 2, 1)
    assert len(got) == df.count()
    assert X.rows(C.unmatched(df, batch, ("programada_id", "codigo")), "programada_id", "codigo") == [(500, 1)]
    flags = batch.withColumnRenamed("asiste", "invitacion")
    assert {r.invitacion for r in C.flag_invitation(df, flags).filter("programada_id = 1 AND codigo = 2").collect()} == {1}


def test_submit_forms_rejects_whole_forms(spark):
    stored = X.visits(
        spark, X.visit(1, "2026-07-01"), X.visit(2, "2026-07-02"), X.visit(3, "2026-07-03"), X.visit(4, "2026-07-04")
    )
    key = F.col("programada_id")
    form = (
        form_of(stored)
        .withColumn("fecha", F.when(key.isin(2, 3), "2026-07-01").when(key == 4, "pronto").otherwise(F.col("fecha")))
        .withColumn("direccion", F.lit("nueva"))
        .withColumn("seq", key)
    )
    edit = editing.submit_forms(stored, form, capacity=2)
    got = {r.programada_id: (r.fecha, r.direccion) for r in edit.snapshot.collect()}
    assert got == {
        1: (X.day("2026-07-01"), "nueva"),
        2: (X.day("2026-07-01"), "nueva"),
        3: (X.day("2026-07-03"), None),
        4: (X.day("2026-07-04"), None),
    }
    assert X.rows(edit.decisions, "seq", "decision") == [(2, "aceptada"), (3, "rechazada")]
    assert X.rows(edit.invalid, "programada_id", "campo") == [(4, "fecha")]


def test_an_unfit_form_takes_no_place(spark):
    stored = X.visits(spark, X.visit(1, "2026-07-01"), X.visit(2, "2026-07-02"))
    key = F.col("programada_id")
    form = (
        form_of(stored)
        .withColumns({"fecha": F.lit("2026-07-20"), "hora_ini": F.when(key == 1, "99:99:99")})
        .withColumn("seq", key)
    )
    stranger = form.filter("seq = 1").withColumns({"seq": F.lit(9).cast("long"), "programada_id": F.lit(77).cast("long")})
    edit = editing.submit_forms(stored, form.unionByName(stranger), capacity=1)
    assert X.rows(edit.decisions, "seq", "decision") == [(2, "aceptada")]
    assert X.rows(edit.snapshot, "programada_id", "fecha") == [(1, X.day("2026-07-01")), (2, X.day("2026-07-20"))]
    assert X.rows(edit.unmatched) == [(9, 77)]


def test_new_visits_come_last_on_their_date(spark):
    stored = X.visits(spark, X.visit(1, "2026-07-01", orden=4), X.visit(2, "2026-07-01", orden=9))
    new = spark.createDataFrame(
        [(20, 1, X.day("2026-07-01")), (10, 1, X.day("2026-07-01")), (30, 1, X.day("2026-07-02")), (40, 1, None)],
        "seq long, organizador_id int, fecha date",
    )
    after = C.insert_visits(stored, new, X.LIMIT)
    assert X.rows(after.filter("programada_id > 2"), "programada_id", "fecha", "orden") == [
        (3, X.day("2026-07-01"), 10), (4, X.day("2026-07-01"), 11), (5, X.day("2026-07-02"), 1), (6, None, None),
    ]


def test_strict_decode_fails(spark):
    bad = C.transport_encode(X.edge_visits(spark)).withColumn("hora_ini", F.lit("24:00:00"))
    assert C.undecodable(bad).select("campo").distinct().collect()[0].campo == "hora_ini"
    with pytest.raises(Exception, match="no date or time in hora_ini"):
        C.transport_decode(bad, strict=True).collect()


def test_add_visits(spark):
    stored = X.visits(spark, X.visit(1, "2026-07-01"))
    new = spark.createDataFrame(
        [(1, 1, X.day("2026-07-01"), 100, S.CONFIRMED, 8), (2, 2, X.day("2026-07-01"), 200, S.CONFIRMED, None),
         (3, 2, X.day("2026-07-02"), 100, S.CONFIRMED, None), (4, 2, X.day("2026-07-02"), None, S.CONFIRMED, None)],
        "seq long, organizador_id int, fecha date, rbd long, estatus string, comuna_id int",
    )
    edit = editing.add_visits(stored, new, X.schools(spark), X.communes(spark), X.universities(spark), 2, X.LIMIT)
    assert X.rows(edit.decisions, "seq", "decision") == [(1, "aceptada"), (2, "rechazada"), (3, "aceptada"), (4, "ignorada")]
    assert X.rows(edit.snapshot.filter("programada_id > 1"), "programada_id", "organizador", "nombre", "comuna_id") == [
        (2, "U uno", "Liceo A", 8), (3, "U dos", "Liceo A", 7),
    ]
