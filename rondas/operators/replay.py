"""Requests for dates decided one by one in ``seq`` order, places freed by a move being free at once.

Whether a request finds a place depends on the moves before it, and those on others on other dates. Here all
requests are decided together, in rounds. A round counts every date twice: the most visits it can have at each point
(no move away whose outcome is open has happened) and the least (all of them have). A request that finds a
place even at the most is accepted, one that finds none even at the least is rejected, and the rest wait for the next
round. The open request with the least ``seq`` is always settled, so rounds end; there are about as many
as the longest chain of moves that wait for each other.

Given the moves away, a date's arrivals are settled without going through them one by one: if every arrival stayed, ``x`` visits
would be there; the rejected ones are as many as ``x`` has exceeded the places so far at most. Both are running sums and
maxima, and these are taken inside ranges of ``seq`` and carried from range to range, so neither a crowded date nor a
visit with very many requests is one task's work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rondas.operators.availability import active_per_date
from rondas.operators.visits import is_active
from rondas.sources.shared import scratch, write_out

ACCEPTED, REJECTED, IGNORED = "aceptada", "rechazada", "ignorada"
#: Per event: arrivals and departures at most and at least, and whether moves away are unknown from here on.
COUNTS = ("llega_max", "llega_min", "sale_max", "sale_min", "dudas")
_FOLD = {"sum": F.sum, "max": F.max}


def running(rows: DataFrame, key: str, values: dict[str, tuple[str, Column]]) -> DataFrame:
    """Add, per value, the sum or maximum over the rows of the same ``key`` with a smaller ``seq``; null where there are none.

    Rows are in ranges ``tramo`` of ``seq``: a window runs inside (key, range) only, and what earlier ranges come to is
    a small table with a row per (key, range).
    """
    inside = Window.partitionBy(key, "tramo").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(key).orderBy("tramo").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({f"_v_{name}": value for name, (_, value) in values.items()})
    cells = rows.groupBy(key, "tramo").agg(*[_FOLD[how](f"_v_{n}").alias(f"_c_{n}") for n, (how, _) in values.items()])
    before = cells.select(
        key, "tramo", *[_FOLD[how](f"_c_{n}").over(earlier).alias(f"_b_{n}") for n, (how, _) in values.items()]
    )
    out = rows.withColumns({f"_i_{n}": _FOLD[how](f"_v_{n}").over(inside) for n, (how, _) in values.items()})
    out = out.join(before, [key, "tramo"])
    both = {}
    for n, (how, _) in values.items():
        i, b = F.col(f"_i_{n}"), F.col(f"_b_{n}")
        both[n] = F.coalesce(i + b, i, b) if how == "sum" else F.greatest(i, b)
    return out.select(*[c for c in rows.columns if not c.startswith("_v_")], *[v.alias(n) for n, v in both.items()])


def _prepared(visits: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests with the date their visit has, whether it holds a place there and takes one, and a range of ``seq``."""
    parts = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = F.lit(True).alias("_conocida")
    stored = visits.select(F.col("programada_id").alias("visita"), F.col("fecha").alias("propia"), is_active().alias("libera"), known)
    school = F.coalesce(F.col("rbd"), F.lit(0)) != 0 if "rbd" in requests.columns else F.lit(True)
    asked = requests.select(
        "seq", F.col("programada_id").alias("visita"), "fecha", F.coalesce(is_active(), F.lit(False)).alias("ocupa"), school.alias("_rbd")
    )
    # Written before use: all rounds must see the same ranges.
    ranged = write_out(asked.repartitionByRange(parts, "seq").withColumn("tramo", F.spark_partition_id()))
    several = ranged.filter("visita IS NOT NULL").groupBy("visita").agg((F.count(F.lit(1)) > 1).alias("varias"))
    new = F.col("visita").isNull()
    fits = F.col("fecha").isNotNull() & F.when(new, F.col("_rbd")).otherwise(F.col("_conocida").isNotNull())
    return write_out(
        ranged.join(stored, "visita", "left")
        .join(several, "visita", "left")
        .select(
            "seq", "tramo", "visita", "fecha", "ocupa", "propia",
            F.coalesce("libera", F.lit(False)).alias("libera"),
            F.coalesce("varias", F.lit(False)).alias("varias"),
            F.when(~fits, F.lit(IGNORED)).alias("decision"),
        )
    )


def _with_sources(state: DataFrame, chains: bool) -> DataFrame:
    """Add the date each visit has when its request comes: ``origen``, ``libre`` (it holds a place there), ``conocido``.

    A visit with one request has its stored date. With several, it has that of the last accepted one, which is known once
    all earlier requests are settled. Until then ``previa`` is the target of the request before: the visit may leave that date.
    """
    plain = state.withColumns(
        {"origen": F.col("propia"), "libre": F.col("libera"), "conocido": F.lit(True), "previa": F.lit(None).cast("date")}
    )
    if not chains:
        return plain
    open_ = F.col("decision").isNull()
    accepted = F.coalesce(F.col("decision") == ACCEPTED, F.lit(False))
    chained = running(
        state.filter("varias"),
        "visita",
        {
            "_aceptada": ("max", F.when(accepted, F.struct("seq", "fecha", "ocupa"))),
            "_abierta": ("max", F.when(open_, F.col("seq"))),
            "_previa": ("max", F.when(open_ | accepted, F.struct("seq", "fecha"))),
        },
    )
    known = F.col("_abierta").isNull()
    moved = F.col("_aceptada").isNotNull()
    chained = chained.withColumns(
        {
            "origen": F.when(moved, F.col("_aceptada.fecha")).otherwise(F.col("propia")),
            "libre": F.when(moved, F.col("_aceptada.ocupa")).otherwise(F.col("libera")),
            "conocido": known,
            "previa": F.when(~known, F.col("_previa.fecha")),
        }
    ).drop("_aceptada", "_abierta", "_previa")
    return plain.filter("NOT varias").unionByName(chained)


def _events(placed: DataFrame) -> DataFrame:
    """What live requests do to dates: each arrival and departure with its count at most and at least, and doubts."""
    open_ = F.col("decision").isNull()
    # A request for the date its visit has takes no place.
    moves = ~(F.col("conocido") & F.col("fecha").eqNullSafe(F.col("origen")))

    def event(day: str, *, asks: bool, **counts: Column) -> Column:
        values = [F.coalesce(counts.get(c, F.lit(False)), F.lit(False)).cast("int").alias(c) for c in COUNTS]
        return F.struct(F.col(day).alias("dia"), F.lit(asks).alias("pide"), *values)

    arrival = event(
        "fecha", asks=True, llega_max=moves & F.col("ocupa"), llega_min=moves & F.col("ocupa") & F.col("conocido")
    )
    departure = event(
        "origen",
        asks=False,
        sale_max=~open_,
        sale_min=F.lit(True),
        # If this request is rejected, a later one of the same visit may leave the date.
        dudas=open_ & F.col("varias"),
    )
    doubt = event("previa", asks=False, dudas=F.lit(True))
    leaves = moves & F.col("libre") & F.col("conocido") & F.col("origen").isNotNull()
    happens = F.array(arrival, F.when(leaves, departure), F.when(F.col("previa").isNotNull(), doubt))
    live = open_ | (F.col("decision") == ACCEPTED)
    return placed.filter(live).select("*", F.inline(F.array_compact(happens)))


def _present(rows: DataFrame, capacity: int) -> DataFrame:
    """Add ``a_lo_mas`` and ``a_lo_menos``: the visits on the date right before each event. ``activas`` are those at the start."""
    stored = F.coalesce("activas", F.lit(0))
    # Of a date above its places, the first departures only bring it down to them.
    above = F.greatest(stored - capacity, F.lit(0))

    def unbounded(arrived: Column, left: Column) -> Column:
        return F.least(stored, F.lit(capacity)) + arrived - F.greatest(left - above, F.lit(0))

    # Both scans read their rows twice, so these are written first.
    rows = running(write_out(rows), "dia", {f"_{c}": ("sum", F.col(c)) for c in COUNTS})
    rows = write_out(rows.withColumns({f"_{c}": F.coalesce(F.col(f"_{c}"), F.lit(0)) for c in COUNTS}))
    after = {
        f"_pico_{end}": ("max", unbounded(F.col(f"_llega_{end}") + F.col(f"llega_{end}"), F.col(f"_sale_{end}") + F.col(f"sale_{end}")))
        for end in ("max", "min")
    }
    rows = running(rows, "dia", after)
    here = {
        name: unbounded(F.col(f"_llega_{end}"), F.col(f"_sale_{end}"))
        - F.greatest(F.coalesce(F.col(f"_pico_{end}"), F.lit(0)) - capacity, F.lit(0))
        for name, end in (("a_lo_mas", "max"), ("a_lo_menos", "min"))
    }
    return rows.withColumns(here)


def _round(state: DataFrame, used: DataFrame, capacity: int, chains: bool) -> DataFrame:
    """``state`` with every open request settled whose outcome no other open one can change."""
    open_ = F.col("decision").isNull()
    wanted = state.filter(open_).select(F.col("fecha").alias("dia")).distinct()
    events = _events(_with_sources(state, chains)).join(wanted, "dia", "left_semi").join(used, "dia", "left")
    asked = _present(events, capacity).filter(F.col("pide") & open_)
    stays = F.col("conocido") & F.col("fecha").eqNullSafe(F.col("origen"))
    full = F.col("conocido") & (F.col("_dudas") == 0) & (F.col("a_lo_menos") >= capacity)
    decision = F.when(stays | (F.col("a_lo_mas") < capacity), F.lit(ACCEPTED)).when(full, F.lit(REJECTED))
    return state.filter(~open_).unionByName(asked.withColumn("decision", decision).select(*state.columns))


def guarded_replay(visits: DataFrame, requests: DataFrame, capacity: int) -> DataFrame:
    """Decide requests one by one in ``seq`` order: ``requests`` with a ``decision`` aceptada, rechazada or ignorada.

    Columns of ``requests``: seq (unique), programada_id (null for a new visit), fecha, estatus and, for new visits,
    rbd. A request is rejected when its date is full at its turn, unless the visit already has that date. An
    accepted one takes a place if its status is active, and frees the one its visit had, at once; later
    requests for the same visit start from the new date. Requests without a date, for an unknown visit or for a new one without a
    school are ignored. A status that changes on the visit's own date counts from the next batch on.
    """
    spark = requests.sparkSession
    with scratch(spark):
        state = _prepared(visits, requests)
        used = write_out(active_per_date(visits).withColumnRenamed("fecha", "dia"))
        # Two numbers a round: whether a visit has several requests, and how many are open.
        chains, left = state.agg(F.max("varias"), F.count_if(F.col("decision").isNull())).first()
        while left:
            state = write_out(_round(state, used, capacity, bool(chains)))
            left = state.agg(F.count_if(F.col("decision").isNull())).first()[0]
        settled = write_out(state.select("seq", "decision"), keep=True)
    return requests.join(settled, "seq").select(*requests.columns, "decision")
