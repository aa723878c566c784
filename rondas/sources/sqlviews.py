"""The tables as SQL views, and what the application asks its database for as SQL table functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rondas import schema as S

VISITS, ATTENDANCE = "programadas", "asisten"


def register(spark: SparkSession, visits: DataFrame, attendance: DataFrame | None = None) -> None:
    """Make the session's views ``programadas`` and ``asisten`` and the table functions over them.

    ``bloqueadas(capacidad)`` returns (fecha, activas) of the dates whose active visits reach the capacity, and
    ``ocupadas(desde, hasta)`` those of all dates of a span. Both are plain queries to Spark: they are planned with the query that calls
    them, and can be joined to each row of a table with LATERAL; with an equality (on ``fecha``, say) that is an ordinary join.
    """
    visits.createOrReplaceTempView(VISITS)
    if attendance is not None:
        attendance.createOrReplaceTempView(ATTENDANCE)
    active = ", ".join(f"'{status}'" for status in S.ACTIVE_STATUSES)
    counted = f"""SELECT fecha AS dia, count(*) AS n FROM {VISITS}
        WHERE estatus IN ({active}) AND fecha IS NOT NULL GROUP BY fecha"""
    _function(spark, "bloqueadas", "capacidad INT", f"SELECT dia, n FROM ({counted}) WHERE n >= capacidad")
    _function(spark, "ocupadas", "desde DATE, hasta DATE", f"SELECT dia, n FROM ({counted}) WHERE dia BETWEEN desde AND hasta")


def _function(spark: SparkSession, name: str, arguments: str, body: str) -> None:
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS TABLE (fecha DATE, activas BIGINT) RETURN {body}")
