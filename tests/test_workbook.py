"""Spreadsheet files: round trips, commit and abort, and that other programs can read them."""

import datetime as dt
import io
import zipfile
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from rondas.sources import workbook

SCHEMA = "`Código` long, Nombre string, Fecha date, `Sí` boolean, Nota double"
TEXTS = ["", "  dos  ", "a\nb\tc\rd", "<&>\"'", "Ñandú 😀", "_x000D_", "\x01\x1f", "1", None, "=1+1"]


def sample(spark):
    rows = [(i, t, dt.date(2026, 1, 1) + dt.timedelta(i) if i % 3 else None, [True, False, None][i % 3], i / 3) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, (None, None, dt.date(1900, 3, 1), None, None)], SCHEMA)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def names(path):
    return sorted(f.name for f in path.iterdir() if not f.name.endswith(".crc"))


def test_round_trip(spark, tmp_path):
    df = sample(spark).repartition(3)
    workbook.write_sheets(df, str(tmp_path / "s"))
    assert all(n.endswith(".xlsx") for n in names(tmp_path / "s")) and 1 <= len(names(tmp_path / "s")) <= 3
    back = workbook.read_sheets(spark, f"file://{tmp_path}/s", df.schema)
    assert back.schema == df.schema and rows(back) == rows(df)
    assert back.rdd.getNumPartitions() == len(names(tmp_path / "s"))


def test_a_large_partition_is_several_sheets(spark, tmp_path):
    df = spark.range(0, 25, 1, 1).withColumnRenamed("id", "Código")
    workbook.write_sheets(df, str(tmp_path / "s"), max_rows=10)
    assert len(names(tmp_path / "s")) == 3
    assert rows(workbook.read_sheets(spark, str(tmp_path / "s"), df.schema)) == rows(df)
    workbook.write_sheets(df, str(tmp_path / "s"), max_rows=5)  # appends
    assert workbook.read_sheets(spark, str(tmp_path / "s"), df.schema).count() == 50
    df.write.format(workbook.FORMAT).mode("overwrite").save(str(tmp_path / "s"))
    assert len(names(tmp_path / "s")) == 1


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    workbook.write_sheets(spark.range(3).withColumnRenamed("id", "Código"), str(tmp_path / "s"))
    before = names(tmp_path / "s")
    bad = spark.range(0, 100, 1, 4).select(
        F.when(F.col("id") == 77, F.raise_error(F.lit("roto"))).otherwise(F.col("id")).cast("long").alias("Código")
    )
    with pytest.raises(Exception, match="roto"):
        workbook.write_sheets(bad, str(tmp_path / "s"))
    assert names(tmp_path / "s") == before


def test_an_empty_table_is_no_sheet(spark, tmp_path):
    df = spark.range(0).withColumnRenamed("id", "Código")
    workbook.write_sheets(df, str(tmp_path / "s"))
    assert names(tmp_path / "s") == []


def test_columns_a_sheet_cannot_hold(spark, tmp_path):
    with pytest.raises(Exception, match="a sheet cannot hold the columns"):
        workbook.write_sheets(spark.range(2).select(F.array("id").alias("x")), str(tmp_path / "s"))


def test_the_parts_are_well_formed_and_name_each_other():
    out = io.BytesIO()
    assert workbook.write_sheet(out, ["a", "b"], iter([(1, "x"), (2, None), (3, "y")]), 2) == 2
    with zipfile.ZipFile(out) as file:
        assert file.testzip() is None
        parts = {n: ElementTree.fromstring(file.read(n)) for n in file.namelist()}
    named = {e.get("PartName").lstrip("/") for e in parts["[Content_Types].xml"] if e.get("PartName")}
    assert named <= set(parts) and workbook.SHEET in named
    cells = [[c.get("t") for c in row] for row in parts[workbook.SHEET].iter(f"{{{workbook.MAIN}}}row")]
    assert cells == [["inlineStr", "inlineStr"], [None, "inlineStr"], [None, None]]
