"""Kept views brought up to date against the same views computed anew."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from rondas.operators import availability, deltas
from rondas.operators import attendance as A
from rondas.operators import visits as V
from rondas.operators.ordinals import with_ordinal

AS_OF, LIMIT = dt.date(2026, 5, 10), dt.date(2026, 12, 31)
STATUS = ["Confirmada", "Por confirmar", "Suspendida", "Realizada", None]
VISITS = "programada_id long, orden long, organizador_id int, fecha date, fecha_lim date, estatus string"


def random_visits(rng, keys):
    days = [None, *[AS_OF + dt.timedelta(d) for d in range(-4, 5)]]
    return {
        k: (k, rng.randrange(3), rng.choice([None, 1, 2, 3]), rng.choice(days), rng.choice([None, AS_OF, LIMIT, LIMIT]), rng.choice(STATUS))
        for k in keys
    }


@pytest.fixture(scope="module")
def versions(spark):
    rng = random.Random(5)
    before = random_visits(rng, range(80))
    after = {k: v for k, v in before.items() if k % 13}  # some go
    after |= random_visits(rng, range(3, 70, 7))  # some change
    after |= random_visits(rng, range(80, 86))  # some are new
    touched = [k for k in {*before, *after} if before.get(k) != after.get(k)] + [5]  # one was touched and stayed the same
    frames = [spark.createDataFrame(list(x.values()), VISITS) for x in (before, after)]
    return *frames, spark.createDataFrame([(k,) for k in touched], "programada_id long")


def rows(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=repr)


def test_counts(versions):
    before, after, touched = versions
    signed = deltas.signed_rows(before, after, touched)
    kept = availability.active_per_date(before)
    got = deltas.updated_counts(kept, deltas.active_changes(signed), ["fecha"], "activas")
    assert rows(got) == rows(availability.active_per_date(after))
    kept = V.pending_confirmation_count(before, AS_OF, LIMIT)
    got = deltas.updated_counts(kept, deltas.pending_changes(signed, AS_OF, LIMIT), ["organizador_id"], "pendientes")
    assert rows(got) == rows(V.pending_confirmation_count(after, AS_OF, LIMIT))


def test_open_invitations_with_repeated_answers(spark, versions):
    before, after, touched = versions
    rng = random.Random(6)
    asked = [(rng.randrange(90), rng.choice([None, 1, 2, 3]), rng.randrange(3)) for _ in range(300)]
    answered = [(v, c, 1 if v % 5 == 0 else a) for v, c, a in asked]
    schema = "programada_id long, codigo int, asiste int"
    old, new = spark.createDataFrame(asked, schema), spark.createDataFrame(answered, schema)
    all_touched = touched.union(old.filter("programada_id % 5 = 0").select("programada_id"))
    changed = deltas.open_changes(before, after, old, new, all_touched, AS_OF)
    got = deltas.updated_counts(A.open_invitation_count(old, before, AS_OF), changed, ["codigo"], "invitaciones")
    assert rows(got) == rows(A.open_invitation_count(new, after, AS_OF))


@pytest.mark.parametrize(("keys", "spread"), [(["fecha"], None), (["organizador_id"], "fecha"), (["organizador_id", "estatus"], "fecha")])
def test_ordinals(versions, keys, spread):
    before, after, touched = versions
    named = [v.withColumnRenamed("orden", "_orden") for v in (before, after)]
    order = ["_orden", "programada_id"]
    kept = with_ordinal(named[0], keys, order, spread=spread)
    signed = deltas.signed_rows(*named, touched)
    got = deltas.updated_ordinals(kept, signed, named[1], keys, order, spread=spread)
    assert rows(got) == rows(with_ordinal(named[1], keys, order, spread=spread))


def test_only_touched_cells_are_numbered_again(spark, versions):
    before, after, touched = versions
    named = [v.withColumnRenamed("orden", "_orden").filter("fecha IS NOT NULL") for v in (before, after)]
    order = ["_orden", "programada_id"]
    signed = deltas.signed_rows(*named, touched.filter("programada_id = 3"))
    days = {r.fecha for r in signed.collect()}
    # Rows of other cells that look different in the new version are not read.
    strange = named[1].withColumn("estatus", F.when(F.col("fecha").isin(*days), F.col("estatus")).otherwise("extraña"))
    kept = with_ordinal(named[0], ["fecha"], order)
    got = deltas.updated_ordinals(kept, signed, strange, ["fecha"], order)
    assert got.filter("estatus = 'extraña'").count() == 0


def test_nothing_changed(versions):
    before, _, touched = versions
    signed = deltas.signed_rows(before, before, touched)
    kept = availability.active_per_date(before)
    assert rows(deltas.updated_counts(kept, deltas.active_changes(signed), ["fecha"], "activas")) == rows(kept)
