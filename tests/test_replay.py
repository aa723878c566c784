"""Requests decided in rounds against one pass over them in order."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

import fixtures as X
from rondas import schema as S
from rondas.operators import changes, replay
from rondas.plans import editing

DAY = dt.date(2026, 3, 2)
REQUESTS = "seq long, programada_id long, fecha date, estatus string, rbd long"


def one_by_one(visits, requests, capacity):
    active = lambda s: s in S.ACTIVE_STATUSES
    at = {v: (d, active(s)) for v, d, s in visits}
    used = {}
    for d, holds in at.values():
        if holds and d:
            used[d] = used.get(d, 0) + 1
    out = {}
    for seq, visit, day, status, rbd in sorted(requests):
        if day is None or (visit is None and not rbd) or (visit is not None and visit not in at):
            out[seq] = "ignorada"
            continue
        own, holds = at.get(visit, (None, False))
        if own == day:
            out[seq] = "aceptada"
            if visit is not None and holds != active(status):
                # The place itself counts from the next batch on; what the visit frees later does not.
                at[visit] = (day, active(status))
        elif used.get(day, 0) >= capacity:
            out[seq] = "rechazada"
        else:
            out[seq] = "aceptada"
            if active(status):
                used[day] = used.get(day, 0) + 1
            if holds and own:
                used[own] -= 1
            if visit is not None:
                at[visit] = (day, active(status))
    return out


def decided(spark, visits, requests, capacity):
    v = spark.createDataFrame(visits, "programada_id long, fecha date, estatus string")
    r = spark.createDataFrame(requests, REQUESTS).withColumn("nota", F.lit("x"))
    got = replay.guarded_replay(v, r, capacity)
    assert got.columns == [*r.columns, "decision"]
    rows = got.collect()
    assert len(rows) == len(requests)
    return {row.seq: row.decision for row in rows}


def days(*numbers):
    return [DAY + dt.timedelta(n) for n in numbers]


@pytest.mark.parametrize(("seed", "several"), [(1, False), (2, True)])
def test_rounds_equal_one_by_one(spark, seed, several):
    rng = random.Random(seed)
    status = [*S.ACTIVE_STATUSES, "Suspendida", None]
    calendar = [*days(*range(6)), None]
    visits = [(i, rng.choice(calendar), rng.choice(status)) for i in range(40)]
    keys = [rng.choice([None, None, rng.randrange(40), 99]) for _ in range(60)] if several else [None] * 25 + rng.sample(range(40), 35)
    rng.shuffle(keys)
    requests = [(s * 3 - 50, k, rng.choice(calendar), rng.choice(status), rng.choice([0, 5, 5, None])) for s, k in enumerate(keys)]
    capacity = 3 + seed % 3
    assert decided(spark, visits, requests, capacity) == one_by_one(visits, requests, capacity)


def test_a_freed_place_is_free_at_once_along_a_chain(spark):
    # Each date is full; the last visit moves to an empty date first, then each takes the place of the one before it.
    calendar = days(*range(9))
    visits = [(i, d, "Confirmada") for i, d in enumerate(calendar[:-1])]
    forward = [(10 - i, i, calendar[i + 1], "Confirmada", None) for i in range(8)]
    assert set(decided(spark, visits, forward, 1).values()) == {"aceptada"}
    # The other way round, each comes before its place is free.
    backward = [(i, i, calendar[i + 1], "Confirmada", None) for i in range(8)]
    assert decided(spark, visits, backward, 1) == one_by_one(visits, backward, 1)


def test_a_date_above_its_places_is_full_until_it_is_below(spark):
    here, there = days(0, 1)
    visits = [(i, here, "Confirmada") for i in range(4)]
    requests = [(1, 0, there, "Confirmada", None), (2, None, here, "Por confirmar", 7), (3, 1, there, "Suspendida", None),
                (4, 2, there, "Confirmada", None), (5, None, here, "Por confirmar", 7), (6, None, here, "Por confirmar", 7)]
    got = decided(spark, visits, requests, 2)
    assert got == one_by_one(visits, requests, 2) == {1: "aceptada", 2: "rechazada", 3: "aceptada", 4: "aceptada", 5: "aceptada", 6: "rechazada"}


def test_a_crowded_date_is_settled_in_a_few_rounds(spark, monkeypatch):
    rounds = []
    inner = replay._round
    monkeypatch.setattr(replay, "_round", lambda *a: rounds.append(1) or inner(*a))
    (here,) = days(0)
    requests = [(i, None, here, "Por confirmar", 1) for i in range(3000)]
    got = decided(spark, [(1, here, "Confirmada")], requests, 100)
    assert [got[i] for i in range(3000)] == ["aceptada"] * 99 + ["rechazada"] * 2901
    assert len(rounds) == 1


def test_no_date_or_visit_is_one_window(spark):
    rows = spark.range(100).selectExpr("id AS seq", "CAST(id >= 0 AS INT) - 1 AS k", "CAST(id DIV 10 AS INT) AS tramo", "id % 7 AS n")
    got = replay.running(rows, "k", {"suma": ("sum", F.col("n")), "mayor": ("max", F.col("n"))}).orderBy("seq").collect()
    values = [i % 7 for i in range(100)]
    assert [(r.suma, r.mayor) for r in got] == [(sum(values[:i]) if i else None, max(values[:i], default=None)) for i in range(100)]
    plan = replay.running(rows, "k", {"suma": ("sum", F.col("n"))})._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(k" in plan and "tramo" in plan


def test_nothing_to_decide(spark):
    assert decided(spark, [(1, DAY, "Confirmada")], [], 2) == {}


def test_forms_that_take_freed_places(spark):
    visits = X.visits(spark, X.visit(1, "2026-07-01"), X.visit(2, "2026-07-02"), X.visit(3, "2026-07-03"))
    to = F.element_at(F.create_map(*[F.lit(x) for x in (1, "2026-07-09", 2, "2026-07-01", 3, "2026-07-03")]), F.col("programada_id").cast("int"))
    forms = changes.transport_encode(visits).select("programada_id", *S.FORM_FIELDS).withColumns(
        {"seq": F.col("programada_id"), "fecha": to, "direccion": F.lit("otra")}
    )
    for at_once, second in ((False, "rechazada"), (True, "aceptada")):
        edit = editing.submit_forms(visits, forms, 1, at_once=at_once)
        assert {r.seq: r.decision for r in edit.decisions.collect()} == {1: "aceptada", 2: second}
        got = {r.programada_id: (str(r.fecha), r.direccion) for r in edit.snapshot.collect()}
        moved = ("2026-07-01", "otra") if at_once else ("2026-07-02", None)
        assert got == {1: ("2026-07-09", "otra"), 2: moved, 3: ("2026-07-03", "otra")}


def test_an_edit_computes_only_what_is_asked_for(spark, monkeypatch):
    visits = X.edge_visits(spark)
    monkeypatch.setattr(editing.C, "apply_changes", lambda *a: pytest.fail("the snapshot was not asked for"))
    forms = changes.transport_encode(visits).select("programada_id", *S.FORM_FIELDS).withColumn("seq", F.col("programada_id"))
    edit = editing.submit_forms(visits, forms, 1)
    assert edit.decisions.count() == edit.invalid.count() == edit.unmatched.count() == 0
    assert edit.differences is edit.differences
    with pytest.raises(AttributeError):
        edit.nothing
