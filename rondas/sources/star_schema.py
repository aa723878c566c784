"""The visit model as views over the star-schema test tables (see FIXTURES.md).

Orders stand in for visits, order lines for attendance, customers for schools,
nations for universities and communes. Nothing is read until a query runs, and
then only the columns it uses.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rondas import schema as S

AS_OF = dt.date(1998, 6, 15)
SEASON_LIMIT = dt.date(2001, 12, 31)
VISITS_PER_PLACE = 2700  # about half of the requests for a date then find a place, at any scale
CODES = 25
EXCLUDED_CODES = (3, 5, 8, 13)
UNIVERSITY_NAMES = {code: f"NATION_{code}" for code in range(CODES) if code not in EXCLUDED_CODES}
FIXED_HOLIDAYS = (dt.date(1998, 1, 1), dt.date(1998, 5, 1), dt.date(1998, 9, 18), dt.date(1998, 12, 25))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def capacity(spark: SparkSession, sf_dir: str) -> int:
    """Places per date: they follow the number of visits, of which there is a fixed number of dates. One number."""
    return max(1, table(spark, sf_dir, "orders").count() // VISITS_PER_PLACE)


def _clock(hours: str, minutes: str) -> str:
    return f"concat(lpad({hours}, 2, '0'), ':', lpad({minutes}, 2, '0'), ':00')"


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    timed = "o_orderkey % 11 <> 0"
    minute = "(o_orderkey % 4) * 15"
    fecha = "CAST(o_orderdate AS DATE)"
    limit = f"DATE '{SEASON_LIMIT}'"
    values = {
        "programada_id": "o_orderkey",
        "orden": "o_orderkey % 97",
        "organizador_id": f"o_custkey % {CODES}",
        "organizador": f"concat('NATION_', o_custkey % {CODES})",
        "fecha": fecha,
        "rbd": "o_custkey",
        "nombre": "c_name",
        "direccion": "c_mktsegment",
        "comuna_id": "c_nationkey",
        "hora_ini": f"CASE WHEN {timed} THEN {_clock('8 + (o_orderkey % 40) div 4', minute)} END",
        "hora_fin": f"CASE WHEN {timed} THEN {_clock('9 + (o_orderkey % 40) div 4', minute)} END",
        "asistentes": "concat(o_orderkey % 90 + 10, ' estudiantes')",
        "estatus": f"CASE WHEN o_orderstatus = 'P' THEN '{S.SUSPENDED}' WHEN o_orderstatus = 'O' THEN '{S.UNCONFIRMED}'"
        f" WHEN {fecha} < DATE '{AS_OF}' THEN '{S.DONE}' ELSE '{S.CONFIRMED}' END",
        "observaciones": "o_orderpriority",
        "fecha_lim": f"CASE WHEN o_orderpriority = '5-LOW' THEN least({limit}, date_add({fecha}, 30)) ELSE {limit} END",
    }
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return orders.join(customers, F.expr("o_custkey = c_custkey")).selectExpr(
        *[f"CAST({values.get(f.name, 'NULL')} AS {f.dataType.simpleString()}) AS {f.name}" for f in S.VISIT_SCHEMA.fields]
    )


def attendance(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "R", 0).otherwise(2)
    # Grouped before the join, so an order with very many lines shrinks on the
    # map side instead of filling one task.
    answers = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("programada_id"), (F.col("l_suppkey") % CODES).cast("int").alias("codigo"))
        .agg(F.max(answer).alias("asiste"))
    )
    organizer = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("programada_id"), (F.col("o_custkey") % CODES).cast("int").alias("_organizador")
    )
    own = F.when(F.col("codigo") == F.col("_organizador"), 0).otherwise(1)
    return answers.join(organizer, "programada_id").select("programada_id", "codigo", "asiste", own.alias("invitacion"))


def all_universities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("codigo"), F.col("n_name").alias("universidad"))


def schools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("rbd"), F.col("c_name").alias("nombre"), F.col("c_nationkey").alias("cod_com")
    )


def communes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("comuna_id"), F.col("n_name").alias("comuna"))


def holidays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekends and the fixed holidays, from the first visit date to 60 days after the last."""
    span = table(spark, sf_dir, "orders").agg(
        F.min("o_orderdate").cast("date").alias("first"), F.max("o_orderdate").cast("date").alias("last")
    )
    days = span.select(F.explode(F.sequence("first", F.date_add("last", 60))).alias("fecha"))
    return days.filter((F.weekday("fecha") > 4) | F.col("fecha").isin(*FIXED_HOLIDAYS))


def time_slots(spark: SparkSession) -> DataFrame:
    """The 96 quarter hours of a day."""
    hora = _clock("id div 4", "(id % 4) * 15")
    return spark.range(96).selectExpr(f"{hora} AS hora", f"substring({hora}, 1, 5) AS etiqueta")
