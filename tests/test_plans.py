"""Shapes of physical plans that must hold at any size."""

import contextlib
import io
import re

import pytest

import fixtures as X
from rondas import schema as S
from rondas.operators import attendance as A
from rondas.operators import availability, changes, lookups
from rondas.operators import visits as V
from rondas.plans.catalogue import QUERIES
from rondas.sources import sinks
from rondas.sources import star_schema as star


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@contextlib.contextmanager
def conf(spark, name, value):
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_join_and_no_python(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    found = re.findall(
        r"CartesianProduct|BroadcastNestedLoopJoin|\w*EvalPython|\w+InPandas|\w+InArrow|\b(?:Global|Local|Collect)Limit", text
    )
    assert not found


@pytest.mark.parametrize(
    "name", ["visits_on_date", "organizer_agenda", "invitations", "calendar_day_events", "attendance_matrix", "apply_changes"]
)
def test_nothing_passes_one_task(spark, sf_dir, name):
    assert "SinglePartition" not in plan(QUERIES[name](spark, sf_dir))


def test_agenda_never_groups_by_organiser_alone(spark, sf_dir):
    text = plan(V.organizer_agenda(star.visits(spark, sf_dir), star.AS_OF, star.SEASON_LIMIT))
    windows = re.findall(r"Arguments: \[row_number\(\).*?\], \[(.*?)\]", text)
    assert windows and all("organizador_id" in w and "fecha" in w for w in windows)


def test_matrix_needs_one_shuffle(spark, tmp_path):
    X.edge_attendance(spark).write.parquet(f"{tmp_path}/a")
    text = plan(A.attendance_matrix(spark.read.parquet(f"{tmp_path}/a"), X.UNIVERSITIES))
    assert len(re.findall(r"^\(\d+\) Exchange$", text, re.M)) == 1
    assert "SortAggregate" not in text


def test_guard_limits_each_date_before_the_shuffle(spark, sf_dir):
    requests = star.visits(spark, sf_dir).selectExpr(
        "programada_id AS seq", "fecha", "rbd", "estatus", "CAST(NULL AS DATE) AS fecha_propia"
    )
    text = plan(availability.guard_requests(star.visits(spark, sf_dir), requests, 4))
    assert "WindowGroupLimit" in text


def test_month_with_years_reaches_the_reader(spark, tmp_path):
    X.edge_visits(spark).write.parquet(f"{tmp_path}/v")
    stored = spark.read.parquet(f"{tmp_path}/v")
    text = plan(V.visits_by_month(stored, 6, years=[2026]))
    assert re.search(r"PushedFilters: .*GreaterThanOrEqual\(fecha,2026-06-01\).*LessThan\(fecha,2026-07-01\)", text)
    schema = re.search(r"ReadSchema: (.*)", plan(V.pending_confirmation_count(stored, X.AS_OF, X.LIMIT))).group(1)
    assert schema == "struct<organizador_id:int,fecha:date,estatus:string,fecha_lim:date>"


def test_bucketed_tables_join_without_a_shuffle(spark):
    sinks.save_bucketed(X.edge_visits(spark), "visitas", 4)
    sinks.save_bucketed(X.edge_attendance(spark), "asistencia", 4)
    visits, attendance = spark.table("visitas"), spark.table("asistencia")
    with conf(spark, "spark.sql.autoBroadcastJoinThreshold", -1):
        text = plan(attendance.join(visits, "programada_id"))
        matrix = plan(A.attendance_matrix(attendance, X.UNIVERSITIES).join(visits, "programada_id"))
        counts = A.open_invitation_count(attendance, visits, X.AS_OF)
        assert "Exchange" not in text and "Exchange" not in matrix
        assert X.rows(counts) == [(1, 2), (2, 1), (26, 1)]


def test_small_batches_leave_the_snapshot_unshuffled(spark, tmp_path):
    X.edge_visits(spark).write.parquet(f"{tmp_path}/v")
    stored = spark.read.parquet(f"{tmp_path}/v")
    batch = spark.createDataFrame([(1, 1, "patch", "direccion", "x")], S.CHANGE_SCHEMA)
    small = changes.apply_changes(stored, batch)
    assert "BroadcastHashJoin" in plan(small) and "SortMergeJoin" not in plan(small)
    rows = X.rows(small)
    with conf(spark, "spark.sql.autoBroadcastJoinThreshold", -1):
        large = changes.apply_changes(stored, batch)
        assert "SortMergeJoin" in plan(large)
        assert X.rows(large) == rows


def test_hot_school_is_split(spark):
    """A third of the rows ask for one school: the sort-merge join splits that partition at run time."""
    asked = spark.range(0, 60_000, 1, 8).selectExpr("id", "IF(id % 3 = 0, 1, id % 500) AS rbd")
    schools = spark.range(500).selectExpr("id AS rbd", "concat('Liceo ', id) AS nombre", "CAST(id % 20 AS INT) AS cod_com")
    communes = spark.range(20).selectExpr("CAST(id AS INT) AS comuna_id", "concat('C', id) AS comuna")
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": -1,
        "spark.sql.adaptive.autoBroadcastJoinThreshold": -1,
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": 2,
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
    }
    with contextlib.ExitStack() as stack:
        for name, value in settings.items():
            stack.enter_context(conf(spark, name, value))
        df = lookups.school_enrichment(asked, schools, communes)
        assert df.filter("comuna IS NULL").count() == 0
        df.collect()
        assert "skew=true" in plan(df)


def test_small_dimension_is_broadcast_and_large_one_is_not(spark, sf_dir):
    query = QUERIES["school_enrichment"]
    assert plan(query(spark, sf_dir)).count("BroadcastHashJoin") >= 2
    with conf(spark, "spark.sql.autoBroadcastJoinThreshold", 1):
        assert "SortMergeJoin" in plan(query(spark, sf_dir))
