"""Exact search for the largest inner products with a pivot-distance index.

Vectors become whole numbers, floor(scale * component). One more component makes all of
them equally long, so the largest inner product is the least distance. Every
vector is keyed by its nearest pivot and its distance to it; a cell is a pivot and a range of
distances. A query first looks into the cell whose ring passes nearest to it. Its k-th score there bounds
the distance of what it still seeks, and by the triangle inequality it must look only into
rings that come within that distance: the annuli to expand. Inside a cell, rows are sorted by
distance, and a query takes only the rows within its bound.

Pivots and ring borders are fitted on a bounded sample (``SAMPLE`` vectors, those of least hash); every
vector is indexed, and the answer does not depend on the fit. What comes to the driver is the sample, and
one row per cell, of which there are ``PIVOTS * RINGS`` at most. Large cells are cut into blocks of
about ``BLOCK_ROWS`` by id and vector, many queries for a cell into chunks of about ``CHUNK_QUERIES``,
so no task's group grows with the data.

Defined results: a vector that is null, empty of numbers (null or non-finite components) or has no id takes no part; rows
of one id all do, repeated or with different vectors, each as a row, and its vectors as queries of that id; missing
trailing components count as 0; rows with the query's id are its own; ties go to the smaller id. Vectors so large that a product is no longer exact in a double are an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Over
from pyspark.sql import functions as F

from rondas.sources.shared import write_out

PIVOTS = 32
RINGS = 16
SAMPLE = 8192
BLOCK_ROWS = 8192
CHUNK_QUERIES = 2048
FIT_ROUNDS = 6
EXACT = float(1 << 53)
#: Distances are compared with this much to spare for rounding.
SLACK = 1e-9


def whole_vectors(table: DataFrame, scale: int, k: int) -> DataFrame:
    """(vec_id, vector): whole-number vectors that take part; of rows alike in id and embedding ``k`` at most, as no answer holds more."""
    proper = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & F.expr(
        "forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))"
    )
    return (
        table.filter(proper)
        .groupBy(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
        .agg(F.least(F.count(F.lit(1)), F.lit(k)).alias("copies"))
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
        .select("vec_id", F.expr(f"transform(embedding, x -> floor(CAST(x AS DOUBLE) * {scale}))").alias("vector"))
    )


def dense(lists: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of numbers, padded with 0."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(lists), width))
    out[np.repeat(np.arange(len(lists)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


class Index:
    """Pivots in the lengthened space, and the borders of their rings."""

    def __init__(self, sample: np.ndarray, longest: float, width: int, pivots: int = PIVOTS, rings: int = RINGS):
        self.longest, self.width, self.rings = longest, width, rings
        rows = self.lengthened(sample)
        centres = np.zeros((1, width + 1)) if not len(rows) else rows[:: max(1, len(rows) // pivots)][:pivots].copy()
        for _ in range(FIT_ROUNDS if len(rows) else 0):
            nearest = self.distances(rows, centres).argmin(axis=1)
            for p in np.unique(nearest):
                centres[p] = rows[nearest == p].mean(axis=0)
        self.centres = centres
        self.borders = np.zeros((len(centres), rings - 1))
        if len(rows):
            gaps = self.distances(rows, centres)
            nearest = gaps.argmin(axis=1)
            for p in range(len(centres)):
                own = gaps[nearest == p, p]
                self.borders[p] = np.quantile(own if len(own) else gaps[:, p], np.arange(1, rings) / rings)

    def lengthened(self, rows: np.ndarray, queries: bool = False) -> np.ndarray:
        last = np.zeros(len(rows)) if queries else np.sqrt(np.maximum(self.longest - (rows * rows).sum(axis=1), 0))
        return np.column_stack([rows, last])

    @staticmethod
    def distances(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
        square = (rows * rows).sum(axis=1)[:, None] + (centres * centres).sum(axis=1) - 2 * rows @ centres.T
        return np.sqrt(np.maximum(square, 0))

    def keys(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell of each row, and its distance to the cell's pivot."""
        gaps = self.distances(self.lengthened(rows), self.centres)
        nearest = gaps.argmin(axis=1)
        gap = gaps[np.arange(len(rows)), nearest]
        ring = (gap[:, None] > self.borders[nearest]).sum(axis=1)
        return nearest * self.rings + ring, gap

    def least_distances(self, queries: np.ndarray, cells: np.ndarray, inner: np.ndarray, outer: np.ndarray) -> np.ndarray:
        """No row of a cell (pivot distances ``inner`` to ``outer``) is nearer to the query than this."""
        gaps = self.distances(self.lengthened(queries, queries=True), self.centres)[:, cells // self.rings]
        return np.maximum(np.maximum(gaps - outer, inner - gaps), 0)

    def reach(self, queries: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """Distance at which a row would have this score (nan, for none yet, is any distance)."""
        square = (queries * queries).sum(axis=1) + self.longest - 2 * scores
        distance = np.sqrt(np.maximum(square, 0))
        return np.where(np.isnan(scores), np.inf, distance * (1 + SLACK) + SLACK * np.sqrt(self.longest) + SLACK)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to smaller ids."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= least)
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def _look(index: Index, rows: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """The k best rows of one block for each query of one chunk."""
    ids, vectors = rows.column("vec_id").to_numpy(), dense(rows.column("vector"), index.width)
    gap = rows.column("gap").to_numpy()
    order = np.argsort(gap, kind="stable")
    ids, vectors, gap = ids[order], vectors[order], gap[order]
    names, wanted = queries.column("query_id").to_numpy(), dense(queries.column("vector"), index.width)
    out = []
    if len(ids) and len(names):
        pivot = rows.column("cell")[0].as_py() // index.rings
        to_pivot = index.distances(index.lengthened(wanted, queries=True), index.centres[pivot : pivot + 1])[:, 0]
        reach = index.reach(wanted, queries.column("bound").to_numpy(zero_copy_only=False).astype(np.float64))
        spare = SLACK * np.sqrt(index.longest)
        lo = np.searchsorted(gap, to_pivot - reach - spare, side="left")
        hi = np.searchsorted(gap, to_pivot + reach + spare, side="right")
        for a in range(0, len(names), 256):  # 256 queries against the rows that any of them needs
            b = min(a + 256, len(names))
            left, right = int(lo[a:b].min()), int(hi[a:b].max())
            scores = wanted[a:b] @ vectors[left:right].T if left < right else np.zeros((b - a, 0))
            for q in range(a, b):
                x, y = max(lo[q], left), hi[q]
                own = scores[q - a, x - left : y - left]
                other = ids[x:y] != names[q]
                own, of = own[other], ids[x:y][other]
                best = _best(of, own, k)
                out.append((np.full(len(best), names[q]), of[best], own[best].astype(np.int64)))
    columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, dtype=np.int64)] * 3
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), columns, strict=True)})


def largest_products(table: DataFrame, queries: Column, *, k: int = 5, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): for the rows that ``queries`` is true for, the k other rows of largest product."""
    spark = table.sparkSession
    vectors = write_out(whole_vectors(table, scale, k))
    square = F.expr("aggregate(vector, 0.0D, (s, x) -> s + CAST(x AS DOUBLE) * x)")
    longest, width = vectors.agg(F.max(square), F.max(F.size("vector"))).first()
    longest, width = longest or 0.0, width or 0
    if longest >= EXACT:
        raise ValueError("vectors too large for exact products")
    sample = vectors.orderBy(F.xxhash64("vec_id", "vector"), "vec_id", "vector").limit(SAMPLE).select("vector").toArrow()
    index = Index(dense(sample.column(0), width), longest, width)
    shared = spark.sparkContext.broadcast(index)  # PIVOTS * (width + RINGS) numbers

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, gaps = shared.value.keys(dense(batch.column(1), width))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cells.astype(np.int32)), pa.array(gaps)], names=["vec_id", "vector", "cell", "gap"]
            )

    keyed = write_out(vectors.mapInArrow(placed, "vec_id bigint, vector array<bigint>, cell int, gap double"))
    # One row per cell.
    cells = keyed.groupBy("cell").agg(F.min("gap").alias("inner"), F.max("gap").alias("outer"), F.count(F.lit(1)).alias("n")).orderBy("cell").toArrow()
    number, inner, outer, held = (cells.column(c).to_numpy() for c in ("cell", "inner", "outer", "n"))
    blocks = {int(c): int(-(-n // BLOCK_ROWS)) for c, n in zip(number, held, strict=True)}
    asked = keyed.filter(queries).select(F.col("vec_id").alias("query_id"), "vector").distinct()

    def by_cell(values: dict[int, int], column: str) -> Column:
        """A number for each cell, from a map of PIVOTS * RINGS entries at most."""
        entries = [F.lit(x) for pair in values.items() for x in pair]
        return F.coalesce(F.element_at(F.create_map(*entries), F.col(column)), F.lit(1)) if entries else F.lit(1)

    def visit(bounded: DataFrame, first: bool) -> DataFrame:
        """The best rows for queries (query_id, vector, bound, seen) in the cells they must look into."""

        def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for batch in batches:
                points = dense(batch.column(1), width)
                least = own.least_distances(points, number, inner, outer)
                if first:
                    row, at = np.arange(len(points)), least.argmin(axis=1)
                else:
                    reach = own.reach(points, batch.column(2).to_numpy(zero_copy_only=False).astype(np.float64))
                    row, at = np.nonzero(least <= reach[:, None] + SLACK * np.sqrt(longest))
                taken = [c.take(pa.array(row)) for c in batch.columns]
                yield pa.RecordBatch.from_arrays(
                    [*taken, pa.array(number[at].astype(np.int32))], names=["query_id", "vector", "bound", "cell"]
                )

        schema = "query_id bigint, vector array<bigint>, bound double, cell int"
        visits = bounded.mapInArrow(chosen, schema)
        # One row per cell.
        many = {r[0]: int(-(-r[1] // CHUNK_QUERIES)) for r in visits.groupBy("cell").count().collect()}
        to_blocks = visits.withColumn("chunk", F.pmod(F.xxhash64("query_id", "vector"), by_cell(many, "cell")).cast("int")).withColumn(
            "block", F.explode(F.sequence(F.lit(0), by_cell(blocks, "cell") - 1))
        )
        to_chunks = keyed.withColumn("block", F.pmod(F.xxhash64("vec_id", "vector"), by_cell(blocks, "cell")).cast("int")).withColumn(
            "chunk", F.explode(F.sequence(F.lit(0), by_cell(many, "cell") - 1))
        )

        def looked(rows: pa.Table, asking: pa.Table) -> pa.Table:
            return _look(shared.value, rows, asking, k)

        unit = ["cell", "block", "chunk"]
        return to_chunks.groupBy(*unit).cogroup(to_blocks.groupBy(*unit)).applyInArrow(
            looked, "query_id bigint, vec_id bigint, score bigint"
        )

    if not len(number):
        return keyed.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.col("vec_id").alias("score"))
    best = Over.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    near = visit(asked.withColumn("bound", F.lit(None).cast("double")), first=True)
    kth = near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") == k).select("query_id", F.col("score").cast("double").alias("bound"))
    kth = write_out(kth)
    # The first cell is looked into once more, so that all candidates come from one pass.
    found = visit(asked.join(kth, "query_id", "left"), first=False)
    return (
        found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )
