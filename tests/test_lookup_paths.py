"""Search through posting tables, lookups in keyed tables: same rows as full scans, and what is read for them."""

import pytest
from pyspark.sql import functions as F

from rondas.operators import attendance as A
from rondas.operators import textindex
from rondas.operators import visits as V
from rondas.sources import keyed

NAMES = ["Liceo Nº 1 Ñuñoa", "LICEO ñuñoa", "Colegio Ávalos", "colegio avalos", "aba", "bab", "abab", "x", "", None, "İstanbul", "100%_a", "Liceo Nº 1 Ñuñoa"]


def scan_rows(df):
    """Rows that left the scans of a query, after row groups were left out."""
    execution = df._jdf.queryExecution()
    execution.executedPlan().executeCollect()
    out = []

    def walk(node):
        if node.nodeName().startswith("Scan"):
            out.append(node.metrics().apply("numOutputRows").value())
        if node.nodeName() == "AdaptiveSparkPlan":
            walk(node.executedPlan())
        elif "QueryStage" in node.nodeName():
            walk(node.plan())
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(execution.executedPlan())
    return sum(out)


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    rows = spark.createDataFrame([(i, n, i) for i, n in enumerate(NAMES)], "programada_id long, nombre string, numero long")
    paths = {c: str(tmp_path_factory.mktemp(c)) for c in ("nombre", "numero")}
    for column, path in paths.items():
        textindex.write_index(rows, column, path)
    return rows, paths


@pytest.mark.parametrize("text", ["ñ", "ÑU", "liceo", "LICEO nº 1 ñuñoa", "ab", "aba", "abab", "baba", "zz", "%", "_a", "İ", "avalos", "Áv", "", " "])
def test_search_equals_scan(indexed, text):
    rows, paths = indexed
    got = textindex.search(rows, paths, {"nombre": text})
    expected = V.column_filter_sort(rows, {"nombre": text})
    assert sorted(r.programada_id for r in got.collect()) == sorted(r.programada_id for r in expected.collect())


def test_search_in_several_columns(indexed):
    rows, paths = indexed
    got = textindex.search(rows, paths, {"nombre": "ñuñ", "numero": "1"})
    assert sorted(r.programada_id for r in got.collect()) == [1, 12]


def test_only_postings_asked_for_are_read(spark, tmp_path):
    rows = spark.range(20_000).selectExpr("id AS programada_id", "concat('Escuela ', sha2(CAST(id AS STRING), 256)) AS nombre")
    textindex.write_index(rows, "nombre", str(tmp_path), rows_per_group=5_000)
    postings = spark.read.parquet(f"{tmp_path}/postings")
    asked = textindex.runs_of("c0ffee")
    hits = postings.filter(F.col("run").isin(*asked))
    assert "PushedFilters: [In(run" in hits._jdf.queryExecution().executedPlan().toString()
    assert scan_rows(hits) < 0.2 * postings.count()
    found = textindex.search(rows, {"nombre": str(tmp_path)}, {"nombre": "C0FFE"})
    assert found.count() == rows.filter("nombre LIKE '%c0ffe%'").count() > 0


def test_a_name_of_many_rows_is_one_entry(spark, tmp_path):
    spark.range(3000).selectExpr("id AS programada_id", "'Liceo' AS nombre").transform(
        lambda df: textindex.write_index(df, "nombre", str(tmp_path)) or df
    )
    assert spark.read.parquet(f"{tmp_path}/values").count() == 1
    assert spark.read.parquet(f"{tmp_path}/postings").count() == 5 + 4 + 3


# ---------------------------------------------------------------------- keyed


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("keyed")) + "/t"
    # Even keys only, so that odd ones lie between them.
    rows = spark.range(100_000).selectExpr(
        "id * 2 AS programada_id", "CAST(id % 7 AS INT) AS codigo", "CAST(id % 3 AS INT) AS asiste", "hash(id) AS rbd"
    )
    keyed.write_keyed(rows, path, ("programada_id", "codigo"), bloom=("rbd",), rows_per_file=5_000)
    return spark.read.parquet(path), path


def test_files_without_the_key_are_left_out(spark, table):
    rows, path = table
    one = keyed.with_keys(rows, "programada_id", [4_242])
    assert one.count() == 1 and scan_rows(one) <= 5_000
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(programada_id), EqualTo(programada_id,4242)]" in plan or "In(programada_id" in plan


def test_bloom_filters_leave_out_what_ranges_cannot(spark, table):
    rows, _ = table
    assert scan_rows(rows.filter("programada_id = 4243")) == 0  # inside a file's range, but not there
    known = rows.limit(1).collect()[0].rbd
    by_school = rows.filter(F.col("rbd") == known)
    assert by_school.count() >= 1 and scan_rows(by_school) <= 15_000  # rows are not sorted by it


@pytest.mark.parametrize("listed", [1000, 2])
def test_lookups_equal_full_scans(spark, table, listed):
    rows, path = table
    wanted = spark.createDataFrame([(4,), (4,), (5,), (199_998,), (None,), (-1,)], "programada_id long")
    got = keyed.visits_from(spark, path, wanted, listed=listed)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, V.visits_by_id(rows, wanted).collect()))
    asked = spark.createDataFrame([(4, 2), (4, 3), (5, 1), (8, 0), (None, 1)], "programada_id long, codigo int")
    got = keyed.answers_from(spark, path, asked, listed=listed)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, A.attendance_lookup(rows, asked).collect()), key=repr)
    assert (scan_rows(keyed.visits_from(spark, path, wanted, listed=listed)) < 20_000) == (listed > 2)


def test_no_keys(spark, table):
    _, path = table
    wanted = spark.createDataFrame([], "programada_id long")
    assert keyed.visits_from(spark, path, wanted).count() == 0
