import json
import time

import pytest

import fixtures as X
from rondas import schema as S
from rondas.operators import changes as C
from rondas.operators import availability, reports
from rondas.sources import sinks, sqlviews, tables


def test_parquet_round_trip(spark, tmp_path):
    df = X.edge_visits(spark)
    path = sinks.write_snapshot(df, str(tmp_path), 1)
    assert X.rows(tables.read_visits(spark, path)) == X.rows(df)
    assert X.rows(sinks.read_snapshot(spark, str(tmp_path), 1)) == X.rows(df)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        sinks.write_snapshot(df, str(tmp_path), 1)


def test_readers_give_the_declared_types(spark, tmp_path):
    X.edge_attendance(spark).selectExpr("cast(codigo as long) codigo", "*").drop("asiste").toDF(
        "codigo", "programada_id", "codigo2", "invitacion"
    ).selectExpr("codigo", "programada_id", "cast(1 as long) asiste", "invitacion").write.parquet(f"{tmp_path}/a")
    assert tables.read_attendance(spark, f"{tmp_path}/a").schema == S.ATTENDANCE_SCHEMA
    spark.createDataFrame([(7, "x")], "cod long, name string").write.parquet(f"{tmp_path}/c")
    assert tables.read_lookup(spark, f"{tmp_path}/c", S.COMMUNE_SCHEMA).dtypes == [("comuna_id", "int"), ("comuna", "string")]


def test_universities_from_json(spark, tmp_path):
    file = tmp_path / "u.json"
    file.write_text(json.dumps({"1": "Uno", "26": "Excluida", "4": "Ñandú"}, indent=1), encoding="utf-8")
    assert X.rows(tables.read_universities(spark, str(file))) == [(1, "Uno"), (26, "Excluida"), (4, "Ñandú")]


def test_rows_in_transport_form(spark):
    df = X.edge_visits(spark)
    dictionaries = [r.asDict() for r in C.transport_encode(df).collect()]
    assert X.rows(C.transport_decode(tables.rows_to_visits(spark, dictionaries))) == X.rows(df)
    answers = X.edge_attendance(spark)
    assert X.rows(tables.rows_to_attendance(spark, [r.asDict() for r in answers.collect()])) == X.rows(answers)


def test_store_keeps_nulls_and_accents(spark, tmp_path):
    df = C.transport_encode(X.edge_visits(spark))
    sinks.write_store(df, f"{tmp_path}/store")
    assert X.rows(sinks.read_store(spark, f"{tmp_path}/store", df.schema)) == X.rows(df)


def test_export_by_month(spark, tmp_path):
    sheet = reports.export_public(X.edge_visits(spark).dropna(subset=["fecha"]))
    sinks.write_export(sheet, f"{tmp_path}/all")
    assert X.rows(sinks.read_export(spark, f"{tmp_path}/all", sheet.schema)) == X.rows(sheet)
    sinks.write_export(sheet, f"{tmp_path}/months", by_month_of="Fecha")
    assert X.rows(sinks.read_export(spark, f"{tmp_path}/months", sheet.schema)) == X.rows(sheet)
    folders = {f.name for f in (tmp_path / "months").iterdir() if f.is_dir()}
    assert folders == {"mes=2026-03", "mes=2026-06", "mes=2026-07"}


def test_sheets_keep_every_text(spark, tmp_path):
    texts = ["  blanks  ", "line 1\nline 2", 'a "quote", and a comma', "", None, "\\ end \\", "ñ"]
    sheet = spark.createDataFrame(list(enumerate(texts)), "id int, texto string")
    sinks.write_export(sheet, f"{tmp_path}/t")
    assert X.rows(sinks.read_export(spark, f"{tmp_path}/t", sheet.schema)) == X.rows(sheet)


def test_scratch_tables_go(spark):
    from pathlib import Path

    from rondas.sources.shared import scratch, shared_dir, write_out

    folder = Path(shared_dir(spark).removeprefix("file:"))
    before = set(folder.glob("table-*"))
    with scratch(spark):
        assert write_out(spark.range(3)).count() == 3
        assert set(folder.glob("table-*")) - before
    assert set(folder.glob("table-*")) == before


def shuffle_files(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {x for x in manager.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in x and x.endswith(".data")}


@pytest.mark.parametrize("setting", [None, "false"])
def test_shuffles_of_a_written_table_go(spark, setting):
    from rondas.sources.shared import CLEANUP, write_out

    spark.conf.unset(CLEANUP) if setting is None else spark.conf.set(CLEANUP, setting)
    default = spark.conf.get(CLEANUP, None)
    try:
        grouped = spark.range(5000).selectExpr("id % 700 AS key", "id").groupBy("key").agg({"id": "sum"})
        before = shuffle_files(spark)
        grouped.write.format("noop").mode("overwrite").save()
        assert shuffle_files(spark) - before
        before |= shuffle_files(spark)
        written = write_out(grouped)
        end = time.time() + 20
        while (left := shuffle_files(spark) - before) and time.time() < end:
            time.sleep(0.1)
        assert not left
        assert spark.conf.get(CLEANUP, None) == default
        # The same frame can be used again, and so can what is read back.
        assert X.rows(written) == X.rows(grouped) == X.rows(write_out(grouped))
    finally:
        spark.conf.unset(CLEANUP)


def test_database_read_is_cut_by_key():
    options = tables.jdbc_options("jdbc:postgresql://h/db", "programadas", 1, 1_000_000, 64, "programada_id", 10_000)
    assert options["partitionColumn"] == "programada_id" and options["numPartitions"] == "64"
    assert (options["lowerBound"], options["upperBound"]) == ("1", "1000000")


BROKEN = ['{"programada_id": 1, "codigo": 2, "asiste": 1, "inv', "no json", "5", '{"programada_id": 1, "codigo": "dos"}']


def test_broken_lines_of_a_store_are_set_aside(spark, tmp_path):
    good = ['{"programada_id": 7, "codigo": 1, "asiste": null, "invitacion": 0}', '{"programada_id": 8}', '{"programada_id":9,"otra":1}']
    (tmp_path / "a.json").write_text("\n".join([good[0], *BROKEN[:2], good[1]]), encoding="utf-8")
    (tmp_path / "b.json").write_text("\n".join([good[2], "", *BROKEN[2:]]), encoding="utf-8")
    rows, broken = sinks.checked_store(spark, str(tmp_path), S.ATTENDANCE_SCHEMA)
    assert rows.schema == S.ATTENDANCE_SCHEMA
    assert X.rows(rows) == [(7, 1, None, 0), (8, None, None, None), (9, None, None, None)]
    assert X.rows(broken) == sorted([("a.json", BROKEN[0]), ("a.json", BROKEN[1]), ("b.json", BROKEN[2]), ("b.json", BROKEN[3])])
    # Whichever columns a query uses, the same lines are whole.
    assert rows.select("invitacion").count() == rows.count() == rows.filter("programada_id > 0").count() == 3
    assert broken.select("archivo").count() == broken.count() == broken.select("linea").count() == 4
    with pytest.raises(Exception, match="a line does not fit the schema"):
        sinks.read_store(spark, str(tmp_path), S.ATTENDANCE_SCHEMA).select("programada_id").collect()


def test_broken_lines_of_a_sheet_are_set_aside(spark, tmp_path):
    (tmp_path / "s.csv").write_text('Codigo,Fecha,Nota\n1,2026-03-02,"a\nb"\n2,ayer,x\n3,2026-03-04\n4,,""\n5,2026-03-05,y,z\n', encoding="utf-8")
    schema = spark.createDataFrame([], "Codigo int, Fecha date, Nota string").schema
    rows, broken = sinks.checked_export(spark, str(tmp_path), schema)
    assert [(r.Codigo, r.Nota) for r in rows.orderBy("Codigo").collect()] == [(1, "a\nb"), (4, "")]
    assert sorted(r.linea for r in broken.collect()) == ["2,ayer,x", "3,2026-03-04", "5,2026-03-05,y,z"]
    assert rows.select("Nota").count() == 2
    with pytest.raises(Exception, match="a line does not fit the schema"):
        sinks.read_export(spark, str(tmp_path), schema).collect()


def test_sheets_are_split_by_rows(spark, tmp_path):
    rows = spark.range(0, 1000, 1, 1).selectExpr("id AS Codigo", "DATE '2026-03-02' AS Fecha")
    sinks.write_export(rows, f"{tmp_path}/s", by_month_of="Fecha", rows_per_file=300)
    assert len(list((tmp_path / "s" / "mes=2026-03").glob("*.csv"))) == 4
    assert sinks.read_export(spark, f"{tmp_path}/s", rows.schema).count() == 1000


def test_table_functions(spark):
    visits = X.edge_visits(spark)
    sqlviews.register(spark, visits, X.edge_attendance(spark))
    for capacity in (1, 2, 3):
        expected = availability.blocked_dates(visits, capacity)
        assert X.rows(spark.sql(f"SELECT fecha, activas FROM bloqueadas({capacity})")) == X.rows(expected)
    asked = spark.createDataFrame([(1, "a"), (3, "b")], "lugares int, quien string")
    got = spark.sql("SELECT quien, fecha FROM {asked}, LATERAL bloqueadas(lugares)", asked=asked)
    expected = [(q, r.fecha) for n, q in ((1, "a"), (3, "b")) for r in availability.blocked_dates(visits, n).collect()]
    assert X.rows(got) == sorted(expected)
    july = spark.sql("SELECT fecha FROM ocupadas(DATE '2026-07-01', DATE '2026-07-31')").collect()
    assert [str(r.fecha) for r in july] == ["2026-07-01"]
    assert "LATERAL" not in got._jdf.queryExecution().executedPlan().toString()
