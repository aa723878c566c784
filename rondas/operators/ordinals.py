"""Exact 1..n numbering inside groups of any size.

A plain ``row_number`` sends a whole group to one task. Few groups (a dozen
universities) over many rows would then be a dozen tasks. Here the group is
numbered date by date: a small table of counts per (group, date) says how many
rows come before each date, and ``row_number`` runs inside (group, date) only.
A (group, date) with more than ``HOT_ROWS`` rows is split by range over the session's tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rondas.sources.shared import cut_lineage, write_out

HOT_ROWS = 2_000_000

_PART_BITS = 33  # monotonically_increasing_id: partition number above, row number below


def _all_same(columns: list[str], prefix: str) -> Column:
    """Null-safe equality of each column with its prefixed twin."""
    return reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(prefix + c)) for c in columns])


def with_ordinal(
    rows: DataFrame,
    keys: list[str],
    order: list[str],
    *,
    name: str = "orden",
    spread: str | None = None,
    hot_rows: int = HOT_ROWS,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Add ``name`` = position of the row in its ``keys`` group, ordered by ``spread`` then ``order``.

    ``order`` must end in a unique column. Rows with a null key belong to no
    group and are left out; nulls in ``spread`` and ``order`` come first.
    The counts are computed (and kept in the shared folder) when this is called, unless
    the caller has them from ``cell_counts``.
    """
    for key in keys:
        rows = rows.filter(F.col(key).isNotNull())
    cell = [*keys, spread] if spread else list(keys)
    counts = cell_counts(rows, cell) if counts is None else counts
    hot = F.col("_n") > hot_rows
    cells, hot_total = counts.filter(hot).agg(F.count(F.lit(1)), F.sum("_n")).first()

    before = F.lit(0)
    if spread:
        # A group has at most one row here per calendar date.
        earlier = Window.partitionBy(*keys).orderBy(spread).rowsBetween(Window.unboundedPreceding, -1)
        before = F.coalesce(F.sum("_n").over(earlier), F.lit(0))
    offsets = counts.select(*cell, "_n", before.alias("_before"))
    if not cells:
        return _number_by_cell(rows, offsets, cell, order, name, bool(spread))

    # At most rows / hot_rows cells are hot, and here their number is known.
    marks = offsets.filter(hot).select(*[F.col(c).alias(f"_s_{c}") for c in cell], "_before")
    match = _all_same(cell, "_s_")
    cold = _number_by_cell(rows.join(marks, match, "left_anti"), offsets, cell, order, name, bool(spread))
    large = rows.join(marks, match).select(*rows.columns, "_before")
    # As many ranges as the hot rows need, at most as many as the session shuffles into.
    most = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(int(-(-2 * hot_total // hot_rows)), most))
    numbered = _number_by_range(large, cell, order, parts)
    return cold.unionByName(
        numbered.select(*rows.columns, (F.col("_before") + F.col("_in_cell")).alias(name))
    )


def _number_by_cell(
    rows: DataFrame, offsets: DataFrame, cell: list[str], order: list[str], name: str, spread: bool
) -> DataFrame:
    """Number inside each (group, date) and add what comes before; one shuffle serves window and join."""
    in_cell = F.row_number().over(Window.partitionBy(*cell).orderBy(*order)).cast("long")
    if not spread:
        return rows.withColumn(name, in_cell)
    # A null date finds no partner: nulls come first, so nothing precedes it.
    return (
        rows.withColumn("_in_cell", in_cell)
        .join(offsets.select(*cell, "_before"), cell, "left")
        .select(*rows.columns, (F.coalesce("_before", F.lit(0)) + F.col("_in_cell")).alias(name))
    )


def cell_counts(rows: DataFrame, cell: list[str]) -> DataFrame:
    """Rows per cell as ``_n``, kept in the shared folder."""
    return cut_lineage(rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n")))


def number_all(rows: DataFrame, order: list[str], *, name: str, parts: int | None = None) -> DataFrame:
    """Number the whole table 1..n without bringing it into one task; in as many ranges as the session shuffles into."""
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _number_by_range(rows, [], order, parts).withColumnRenamed("_in_cell", name)


def _number_by_range(rows: DataFrame, cell: list[str], order: list[str], parts: int) -> DataFrame:
    """Sort the rows over range partitions; position = rows before in earlier partitions + place in this one."""
    keys = [*cell, *order]
    # Written before use: both reads below must see the same partition bounds.
    placed = write_out(
        rows.repartitionByRange(parts, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_at", _PART_BITS))
    )
    # A range partition holds neighbouring cells, so there are at most
    # (partitions + cells) spans.
    spans = placed.groupBy(*cell, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*cell).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(
        *[F.col(c).alias(f"_s_{c}") for c in [*cell, "_part"]],
        "_first",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_prev"),
    )
    match = _all_same([*cell, "_part"], "_s_")
    columns = [c for c in placed.columns if c not in ("_at", "_part")]
    return placed.join(spans, match).select(
        *columns, (F.col("_at") - F.col("_first") + 1 + F.col("_prev")).alias("_in_cell")
    )
