import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import fixtures as X
from rondas.operators import attendance as A
from rondas.operators import calendar
from rondas.operators import visits as V
from rondas.operators.ordinals import number_all, with_ordinal
from rondas.sources.shared import cut_lineage, shared_dir

SCHEMA = "grupo string, fecha date, peso int, id long"


def skewed(spark, n=3000, seed=1):
    """A third of the rows in one (group, date), another third in one group, with nulls and ties."""
    rng = random.Random(seed)
    days = [None] + [dt.date(2026, 3, 1) + dt.timedelta(i) for i in range(20)]
    rows = []
    for i in range(n):
        kind = rng.random()
        if kind < 1 / 3:
            group, date = "a", days[5]
        elif kind < 2 / 3:
            group, date = "b", rng.choice(days)
        else:
            group, date = rng.choice("cdefg"), rng.choice(days)
        rows.append((group, date, rng.choice([None, 1, 2, 3]), i))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA)


def expected(df, keys, order):
    window = Window.partitionBy(*keys).orderBy(*order)
    return sorted(tuple(r) for r in df.select("id", F.row_number().over(window)).collect())


@pytest.mark.parametrize("hot_rows", [40, 100, 500, 10_000])
def test_equals_row_number_with_dates_spread(spark, hot_rows):
    df = skewed(spark)
    got = with_ordinal(df, ["grupo"], ["peso", "id"], name="n", spread="fecha", hot_rows=hot_rows)
    assert sorted(tuple(r) for r in got.select("id", "n").collect()) == expected(df, ["grupo"], ["fecha", "peso", "id"])
    assert got.columns == [*df.columns, "n"]


@pytest.mark.parametrize("hot_rows", [50, 10_000])
def test_equals_row_number_without_spread(spark, hot_rows):
    df = skewed(spark, seed=2)
    got = with_ordinal(df, ["grupo"], ["fecha", "peso", "id"], name="n", hot_rows=hot_rows)
    assert sorted(tuple(r) for r in got.select("id", "n").collect()) == expected(df, ["grupo"], ["fecha", "peso", "id"])


def test_hot_null_date(spark):
    rows = [("a", None, 1, i) for i in range(200)] + [("a", dt.date(2026, 3, 2), 1, 1000 + i) for i in range(50)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = with_ordinal(df, ["grupo"], ["peso", "id"], name="n", spread="fecha", hot_rows=20)
    assert [r[1] for r in sorted(got.select("id", "n").collect())] == list(range(1, 251))


def test_null_keys_belong_to_nobody(spark):
    df = spark.createDataFrame([(None, None, 1, 1), ("a", None, 1, 2)], SCHEMA)
    got = with_ordinal(df, ["grupo"], ["id"], name="n", spread="fecha")
    assert [(r.id, r.n) for r in got.collect()] == [(2, 1)]


def test_number_all(spark):
    df = skewed(spark, seed=3)
    got = number_all(df, ["id"], name="n", parts=7)
    assert sorted(tuple(r) for r in got.select("id", "n").collect()) == [(i, i + 1) for i in range(3000)]


def test_numbering_survives_without_the_first_plan(spark):
    """The numbered rows come from the shared folder: reading twice gives the same numbers."""
    df = skewed(spark, seed=4)
    got = with_ordinal(df, ["grupo"], ["peso", "id"], name="n", spread="fecha", hot_rows=40)
    assert X.rows(got) == X.rows(got)


@pytest.mark.parametrize("hot_rows", [1, 2, 1000])
def test_operators_do_not_depend_on_the_split(spark, hot_rows):
    visits, attendance = X.edge_visits(spark), X.edge_attendance(spark)
    pairs = [
        (V.organizer_agenda, (visits, X.AS_OF, X.LIMIT)),
        (V.visits_on_date, (visits,)),
        (A.invitations, (attendance, visits, X.communes(spark), X.AS_OF)),
        (calendar.calendar_day_events, (visits,)),
        (calendar.calendar_grid, (visits,)),
    ]
    for operator, arguments in pairs:
        assert X.rows(operator(*arguments, hot_rows=hot_rows)) == X.rows(operator(*arguments))


def test_shared_folder_is_the_configured_one(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert folder in shared_dir(spark)
    assert cut_lineage(spark.range(3)).count() == 3
