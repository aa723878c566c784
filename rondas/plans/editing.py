"""Whole edits: a batch of forms or of new visits, decided and applied."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rondas.operators import changes as C
from rondas.operators.availability import guard_requests
from rondas.operators.lookups import school_enrichment, with_university
from rondas.operators.replay import ACCEPTED, REJECTED, guarded_replay
from rondas.sources.shared import write_out


class Edit:
    """A decided edit; each part is computed when it is first asked for.

    The new ``snapshot``, the ``decisions`` on requests for dates, ``invalid`` fields whose value did not fit, and ``unmatched``
    forms for no visit. Asking for decisions does not build the snapshot's change table.
    """

    def __init__(self, **parts: Callable[[Edit], DataFrame]):
        self._parts = parts
        self._known: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self._parts:
            raise AttributeError(name)
        if name not in self._known:
            self._known[name] = self._parts[name](self)
        return self._known[name]


def submit_forms(visits: DataFrame, forms: DataFrame, capacity: int, *, at_once: bool = False) -> Edit:
    """Apply edit forms (seq, programada_id, form fields in transport form).

    A form that holds a value that does not fit its field is rejected as a whole before any place is
    given away; of the rest, a form that moves its visit to a date already full is. A place freed by a
    move counts from the next batch on, or with ``at_once`` for the forms after it.
    """

    def decisions(edit: Edit) -> DataFrame:
        moves = (
            edit.differences.filter(F.col("campo") == "fecha")
            .join(edit.unfit, "seq", "left_anti")
            .select("seq", "programada_id", F.to_date("valor").alias("fecha"), F.to_date("anterior").alias("fecha_propia"))
            .join(forms.select("seq", "estatus"), "seq")
        )
        decided = guarded_replay(visits, moves, capacity) if at_once else guard_requests(visits, moves, capacity)
        return decided.drop("programada_id")

    def snapshot(edit: Edit) -> DataFrame:
        rejected = edit.decisions.filter(F.col("decision") == REJECTED).select("seq").union(edit.unfit)
        patches = edit.differences.join(rejected, "seq", "left_anti").select(
            "seq", "programada_id", F.lit(C.PATCH).alias("accion"), "campo", "valor"
        )
        return C.apply_changes(visits, patches)

    return Edit(
        # Several parts share the one join with the snapshot, so it is written out.
        differences=lambda edit: write_out(
            C.typed_patch(C.changed_fields(visits, forms).withColumnRenamed("nuevo", "valor"))
        ),
        invalid=lambda edit: edit.differences.filter("NOT valido").select("seq", "programada_id", "campo"),
        unfit=lambda edit: edit.invalid.select("seq").distinct(),
        decisions=decisions,
        snapshot=snapshot,
        unmatched=lambda edit: C.unmatched(visits, forms.select("seq", "programada_id")),
    )


def add_visits(
    visits: DataFrame,
    requests: DataFrame,
    schools: DataFrame,
    communes: DataFrame,
    universities: DataFrame,
    capacity: int,
    season_limit: dt.date | str,
) -> Edit:
    """Add requested visits (seq, organizador_id, fecha, rbd, estatus, ...) while their dates have places.

    A commune given in the request stands; otherwise it is the school's.
    """
    asked = requests.withColumn("fecha_propia", F.lit(None).cast("date"))

    def snapshot(edit: Edit) -> DataFrame:
        accepted = edit.decisions.filter(F.col("decision") == ACCEPTED).drop("decision")
        named = with_university(accepted, universities, key="organizador_id", name="organizador")
        if "comuna_id" in requests.columns:
            named = named.withColumnRenamed("comuna_id", "_comuna_id")
        named = school_enrichment(named, schools, communes)
        if "comuna_id" in requests.columns:
            named = named.withColumn("comuna_id", F.coalesce("_comuna_id", "comuna_id"))
        return C.insert_visits(visits, named, season_limit)

    return Edit(
        decisions=lambda edit: write_out(guard_requests(visits, asked, capacity).drop("fecha_propia")), snapshot=snapshot
    )
