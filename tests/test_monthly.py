"""Snapshots by month: what an edit reads, writes and leaves alone."""

import datetime as dt
from pathlib import Path

from pyspark.sql import functions as F

from rondas import schema as S
from rondas.operators import changes as C
from rondas.operators import visits as V
from rondas.sources import monthly
from rondas.sources.tables import _conform

CHANGES = "seq long, programada_id long, accion string, campo string, valor string, fecha_propia date"


def visits(spark, rows):
    df = spark.createDataFrame(rows, "programada_id long, orden long, fecha date, estatus string, nombre string")
    for f in S.VISIT_SCHEMA.fields:
        if f.name not in df.columns:
            df = df.withColumn(f.name, F.lit(None))
    return _conform(df, S.VISIT_SCHEMA)


def sample(spark):
    rows = [(i, i, dt.date(2024 + i % 3, 1 + i % 12, 1 + i % 28), "Confirmada", f"Colegio {i}") for i in range(120)]
    return visits(spark, [*rows, (500, 1, None, "Confirmada", "sin fecha"), (501, 1, dt.date(2030, 5, 5), "Confirmada", "sola")])


def files(path):
    return {str(f.relative_to(path)): (f.stat().st_mtime_ns, f.stat().st_ino) for f in Path(path).rglob("*.parquet")}


def local(path):
    return str(path).removeprefix("file:")


def test_an_edit_reads_and_writes_only_its_months(spark, tmp_path):
    path = str(tmp_path / "visits")
    before = sample(spark)
    monthly.write_monthly(before, path)
    assert sorted(r.programada_id for r in monthly.read_monthly(spark, path).collect()) == sorted(r.programada_id for r in before.collect())
    old = files(path)
    own = {r.programada_id: r.fecha for r in before.collect()}
    rows = [
        (1, 0, "patch", "fecha", "2026-02-10", own[0]),  # 2024-01 to 2026-02
        (2, 36, "patch", "nombre", "otro", own[36]),
        (3, 501, "delete", None, None, own[501]),  # the only one of its month
        (4, 500, "patch", "fecha", "2024-01-31", None),  # the only one without a date
    ]
    change = spark.createDataFrame(rows, CHANGES)
    months = monthly.apply_monthly(spark, path, change)
    assert set(months) == {(2024, 1), (2026, 2), (2030, 5), (None, None)}
    expected = C.apply_changes(before, change.drop("fecha_propia"))
    got = monthly.read_monthly(spark, path)
    assert got.columns == expected.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, expected.collect()), key=repr)
    new = files(path)
    touched = ("anio=2024/mes=1/", "anio=2026/mes=2/", "anio=2030/mes=5/", "anio=__HIVE")
    assert {f: s for f, s in old.items() if not f.startswith(touched)} == {f: s for f, s in new.items() if not f.startswith(touched)}
    assert not any(f.startswith(touched[2:]) for f in new)
    assert not set(old) & {f for f in new if f.startswith(touched[:2])}


def test_months_are_folders_in_the_plan(spark, tmp_path):
    path = str(tmp_path / "visits")
    monthly.write_monthly(sample(spark), path)
    june = V.visits_by_month(monthly.read_monthly(spark, path, month=6), 6)
    read = june.inputFiles()
    plan = june._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(mes" in plan
    scan = monthly.read_monthly(spark, path, month=6)
    assert {r[0] for r in scan.select(F.month("fecha")).distinct().collect()} == {6}
    assert len(read) == len(files(path))  # Spark lists all files, the filter on folders picks
    assert _files_read(scan) == len([f for f in files(path) if "/mes=6/" in f]) > 0
    listed = monthly.read_monthly(spark, path, [(2024, 1), (None, None)])
    assert _files_read(listed) == len([f for f in files(path) if f.startswith(("anio=2024/mes=1/", "anio=__HIVE"))]) == 2


def _files_read(df):
    """Number of files that the scans of a finished query opened."""
    execution = df._jdf.queryExecution()
    execution.executedPlan().executeCollect()
    plan, out = execution.executedPlan(), []

    def walk(node):
        if node.nodeName().startswith("Scan"):
            out.append(node.metrics().apply("numFiles").value())
        if node.nodeName() == "AdaptiveSparkPlan":
            walk(node.executedPlan())
        elif "QueryStage" in node.nodeName():
            walk(node.plan())
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(plan)
    return sum(out)


def test_a_table_of_months_prunes_at_run_time(spark, tmp_path):
    path = str(tmp_path / "visits")
    monthly.write_monthly(sample(spark), path)
    asked = spark.createDataFrame([(2025, 2, "a"), (2026, 3, "a"), (2024, 4, "b")], "anio int, mes int, quien string")
    asked.coalesce(1).write.parquet(str(tmp_path / "asked"))
    wanted = spark.read.parquet(str(tmp_path / "asked")).filter("quien = 'a'")
    rows = monthly.read_monthly(spark, path, wanted)
    assert "dynamicpruning" in rows._jdf.queryExecution().executedPlan().toString()
    assert _files_read(rows) <= 2 + 1  # and the one of ``asked``
    assert {(r.fecha.year, r.fecha.month) for r in rows.collect()} == {(2025, 2), (2026, 3)}


def test_large_months_are_split_over_tasks(spark, tmp_path):
    rows = spark.range(4000).selectExpr(
        "id AS programada_id", "id AS orden", "date_add(DATE '2026-06-01', CAST(id % 30 AS INT)) AS fecha", "'Confirmada' AS estatus", "'x' AS nombre"
    )
    for f in S.VISIT_SCHEMA.fields:
        if f.name not in rows.columns:
            rows = rows.withColumn(f.name, F.lit(None))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        monthly.write_monthly(_conform(rows, S.VISIT_SCHEMA), str(tmp_path / "v"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(files(tmp_path / "v")) == 8


def test_changes_for_a_date_the_visit_no_longer_has(spark, tmp_path):
    path = str(tmp_path / "visits")
    monthly.write_monthly(sample(spark), path)
    own = {r.programada_id: r.fecha for r in sample(spark).collect()}
    change = spark.createDataFrame(
        [(1, 0, "patch", "nombre", "x", own[0]), (2, 1, "patch", "nombre", "x", own[1] + dt.timedelta(40)), (3, 500, "delete", None, None, None)], CHANGES
    )
    assert [r.seq for r in monthly.stale(spark, path, change).collect()] == [2]
    assert monthly.apply_monthly(spark, path, change.limit(0)) == []


def test_inserts_add_files_and_rewrite_none(spark, tmp_path):
    path = str(tmp_path / "visits")
    before = sample(spark)
    monthly.write_monthly(before, path)
    old = files(path)
    requests = spark.createDataFrame(
        [(1, dt.date(2024, 1, 1), 5, "Confirmada"), (2, dt.date(2031, 7, 7), 5, "Confirmada"), (3, None, 5, None), (4, dt.date(2024, 1, 1), 6, "x")],
        "seq long, fecha date, rbd long, estatus string",
    )
    months = monthly.insert_monthly(spark, path, requests, "2026-12-31")
    assert set(months) == {(2024, 1), (2031, 7), (None, None)}
    new = files(path)
    assert {f: new[f] for f in old} == old
    assert {f.rsplit("/", 1)[0] for f in set(new) - set(old)} == {monthly._folder(*m) for m in months}
    expected = C.insert_visits(before, requests, "2026-12-31")
    assert sorted(map(tuple, monthly.read_monthly(spark, path).collect()), key=repr) == sorted(map(tuple, expected.collect()), key=repr)


def test_closings_touch_the_months_of_their_visits(spark, tmp_path):
    path = str(tmp_path / "visits")
    before = sample(spark)
    monthly.write_monthly(before, path)
    old = files(path)
    own = {r.programada_id: r.fecha for r in before.collect()}
    closings = [(1, 0, "Realizada", own[0] + dt.timedelta(3), own[0]), (2, 36, "Suspendida", own[36], own[36])]
    closings = spark.createDataFrame(closings, "seq long, programada_id long, estatus string, hoy date, fecha_propia date")
    holidays = spark.createDataFrame([(dt.date(2024, 1, 6),)], "fecha date")
    assert monthly.close_monthly(spark, path, closings, holidays) == [(2024, 1)]
    expected = C.close_visits(before, closings.drop("fecha_propia"), holidays)
    assert sorted(map(tuple, monthly.read_monthly(spark, path).collect()), key=repr) == sorted(map(tuple, expected.collect()), key=repr)
    assert {f for f, s in files(path).items() if old.get(f) != s} == {f for f in files(path) if f.startswith("anio=2024/mes=1/")}
