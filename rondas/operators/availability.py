"""Which dates still take visits, and which requests get the remaining places."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rondas.operators.visits import is_active


def active_per_date(visits: DataFrame) -> DataFrame:
    """(fecha, activas) of every date with active visits."""
    return visits.filter(is_active() & F.col("fecha").isNotNull()).groupBy("fecha").agg(F.count(F.lit(1)).alias("activas"))


def blocked_dates(visits: DataFrame, capacity: int) -> DataFrame:
    """Dates whose active visits reach ``capacity``."""
    return active_per_date(visits).filter(F.col("activas") >= capacity)


def date_availability(requests: DataFrame, blocked: DataFrame) -> DataFrame:
    """Mark each requested ``fecha`` as blocked or not.

    A ``fecha_propia`` column holds the date a moved visit has itself, which is
    never blocked for it. A repeated date in ``blocked`` counts once, so one row per calendar
    date bounds the broadcast.
    """
    marks = blocked.select("fecha").distinct().withColumn("_llena", F.lit(True))
    taken = F.coalesce(F.col("_llena"), F.lit(False))
    if "fecha_propia" in requests.columns:
        taken = taken & ~F.col("fecha").eqNullSafe(F.col("fecha_propia"))
    return requests.join(F.broadcast(marks), "fecha", "left").withColumn("bloqueada", taken).drop("_llena")


def guard_requests(visits: DataFrame, requests: DataFrame, capacity: int) -> DataFrame:
    """Decide requests as if they came one by one in ``seq`` order: aceptada, rechazada or ignorada.

    Columns of ``requests``: seq (unique), fecha, estatus, fecha_propia (null
    for a new visit) and, for new visits, rbd. A request takes a place when its visit is active and
    the date is not its own; it is rejected when the date was already full. A
    place freed by a move counts from the next batch on. Requests without a
    school or a date are ignored.

    A date fills up at one point in time, the ``seq`` of the request that takes
    its last place, so only that point is computed per date and requests
    themselves are never grouped or ranked as a whole.
    """
    used = active_per_date(visits)
    ignored = F.col("fecha").isNull()
    if "rbd" in requests.columns:
        ignored = ignored | (F.coalesce(F.col("rbd"), F.lit(0)) == 0)
    own = F.col("fecha").eqNullSafe(F.col("fecha_propia"))
    takers = requests.filter(~ignored & ~own & is_active()).select("fecha", "seq")
    # rank <= capacity is applied on the map side too (window group limit), so a
    # crowded date sends only `capacity` rows per task to the shuffle.
    ranked = (
        takers.withColumn("_n", F.row_number().over(Window.partitionBy("fecha").orderBy("seq")))
        .filter(F.col("_n") <= capacity)
        .join(F.broadcast(used), "fecha", "left")
        .withColumn("_libres", F.lit(capacity) - F.coalesce("activas", F.lit(0)))
    )
    filled = ranked.filter(F.col("_n") == F.col("_libres")).select("fecha", F.col("seq").alias("_llena_en"))
    state = F.coalesce("activas", F.lit(0)) >= capacity
    decision = (
        F.when(ignored, F.lit("ignorada"))
        .when(own, F.lit("aceptada"))
        .when(state | (F.col("seq") > F.col("_llena_en")), F.lit("rechazada"))
        .otherwise(F.lit("aceptada"))
    )
    return (
        requests.join(F.broadcast(used), "fecha", "left")
        .join(F.broadcast(filled), "fecha", "left")
        .select(*requests.columns, decision.alias("decision"))
    )
