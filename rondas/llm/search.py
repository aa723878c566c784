"""Ranked lexical search with pipelined term partitioning.

The terms of the items are dealt to ``OWNERS`` owners, the rarest to the first. An owner holds the postings of its terms,
cut into blocks of documents. A bundle of items passes the owners one after the other and carries, for every
block, the sparse accumulators of its items: (item, document, score so far). At each owner accumulators and postings of a block meet
in a cogroup, and the owner adds its integer contributions.

Between owners the tenth best score of each item so far is known, and for each item the most that the owners still
ahead can add. An accumulator that cannot reach the tenth best any more is dropped, and an item whose owners ahead
cannot lift a new document there opens no accumulators. Both bounds are exact, ties included, so the result is that of all
documents; rare terms come first, which makes the bounds tight before the long postings are read.

Bundles hold about ``BUNDLE_TERMS`` pairs of item and term (one item at least), whose terms every task gets; a larger benchmark is more bundles,
each of which has postings of its own terms made. Terms are compared by a 64-bit hash of their bytes.

Defined results: null and empty texts have no terms: they count neither as documents nor are they found. Items without terms find nothing.
Every row of ``docs`` is a document of its own, repeated rows and repeated ids too, and every row of ``items`` an item of its own. Equal scores are
ordered by doc_id, null last. Empty tables give an empty result. A very long text is a block of its own.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as Over

from rondas.llm import words as W
from rondas.llm.tables import map_batches
from rondas.sources.shared import write_out

BEST = 10
#: Pairs of item and term in a bundle.
BUNDLE_TERMS = 1 << 20
#: Share of all postings up to which each owner holds the terms, rarest first.
OWNERS = (1 / 64, 1 / 16, 1 / 4, 1)
#: Documents and bytes of text of a block.
BLOCK_DOCS = 1024
BLOCK_BYTES = 2 << 20
#: Cells (items by documents) that an owner adds up at once.
CELLS = 1 << 21
#: Fixed values.
TERM_BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ENTRY = np.dtype([("item", "<i4"), ("doc", "<i4"), ("score", "<i8")])
POSTING = np.dtype([("term", "<i4"), ("doc", "<i4"), ("value", "<i4")])


def terms(text: str | Column) -> Column:
    small = F.translate(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(small, TERM_BREAK), "")


def term_hashes(listed: list[str]) -> np.ndarray:
    """The hashes that ``W.word_hashes`` gives to these words in a text."""
    if not listed:
        return np.zeros(0, dtype=np.uint64)
    out = []
    for block in W.blocks(pa.array(listed)):
        data = W.lowered(block.data)
        out.append(W.word_hashes(data, W.Words(block.offsets[:-1], block.offsets[1:], block.offsets)))
    return np.concatenate(out)


# ------------------------------------------------------------------- postings


def postings(docs: DataFrame, hashes: np.ndarray) -> DataFrame:
    """A row per block of documents: block, ids, lengths of the documents, and the postings of the sorted ``hashes`` in it.

    ``value`` of a posting is the number of occurrences.
    """
    known = docs.sparkSession.sparkContext.broadcast(hashes)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = known.value
        number = 0
        for batch in batches:
            ids, texts = batch.columns
            for block in W.blocks(texts, BLOCK_BYTES):
                data = W.lowered(block.data)
                words = W.split(W.Block(block.lo, block.hi, data, block.offsets), W.PUNCTUATED)
                found = W.word_hashes(data, words)
                at = np.minimum(np.searchsorted(wanted, found), max(len(wanted) - 1, 0))
                hit = wanted[at] == found if len(wanted) else np.zeros(len(found), dtype=bool)
                owner = words.owner()
                for lo in range(0, block.hi - block.lo, BLOCK_DOCS):
                    hi = min(lo + BLOCK_DOCS, block.hi - block.lo)
                    own = hit & (owner >= lo) & (owner < hi)
                    keys, counts = np.unique(at[own].astype(np.int64) * BLOCK_DOCS + (owner[own] - lo), return_counts=True)
                    held = np.zeros(len(keys), dtype=POSTING)
                    held["term"], held["doc"], held["value"] = keys // BLOCK_DOCS, keys % BLOCK_DOCS, counts
                    # Unique among the blocks of all tasks.
                    name = (TaskContext.get().partitionId() << 33) + number
                    number += 1
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([name], pa.int64()),
                            pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), ids.slice(block.lo + lo, hi - lo)),
                            pa.array([words.counts[lo:hi].astype(np.int64).tobytes()], pa.binary()),
                            pa.array([held.tobytes()], pa.binary()),
                        ],
                        names=["block", "ids", "lengths", "postings"],
                    )

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return write_out(map_batches(source, rows, "block long, ids array<long>, lengths binary, postings binary"))


@dataclass(frozen=True)
class Statistics:
    """Documents with terms, their terms with repeats, and per known term the documents that hold it."""

    documents: int
    terms: int
    holders: np.ndarray

    def weights(self) -> np.ndarray:
        n = self.documents
        return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(df) + 1))) for df in self.holders], dtype=np.int64)


def _summed(index: DataFrame, column: str, function, size: int) -> np.ndarray:
    """Sums or maxima per term over all blocks: (term, value) rows, combined by Spark; ``size`` numbers reach the driver."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                held = np.frombuffer(data, dtype=POSTING)
                present, first = np.unique(held["term"], return_index=True)
                value = function(held, first) if len(held) else np.zeros(0, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(present), pa.array(value.astype(np.int64))], names=["term", "value"])

    combine = F.sum if function is _count else F.max
    found = map_batches(index.select(column), rows, "term int, value long").groupBy("term").agg(combine("value").alias("value"))
    out = np.zeros(size, dtype=np.int64)
    for row in found.collect():
        out[row["term"]] = row["value"]
    return out


def _count(held: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.diff(np.append(first, len(held)))


def _most(held: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.maximum.reduceat(held["value"].astype(np.int64), first)


def statistics(index: DataFrame, size: int) -> Statistics:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                lengths = np.frombuffer(data, dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int((lengths > 0).sum())]), pa.array([int(lengths.sum())])], names=["documents", "terms"]
                )

    total = map_batches(index.select("lengths"), rows, "documents long, terms long").agg(F.sum("documents"), F.sum("terms")).first()
    return Statistics(total[0] or 0, total[1] or 0, _summed(index, "postings", _count, size))


def impacts(occurrences: np.ndarray, lengths: np.ndarray, stats: Statistics) -> np.ndarray:
    """What a term adds for each unit of its weight."""
    spread = 100 - 90 + (90 * lengths * stats.documents) // stats.terms
    return (1_000_000_000 * occurrences) // (1000 * occurrences + 8 * spread)


def owned(index: DataFrame, stats: Statistics, owner: np.ndarray) -> DataFrame:
    """(block, ids, owner_0, owner_1, ...): the postings of each owner in a column of its own, with impacts as values."""
    names = [f"owner_{k}" for k in range(len(OWNERS))]
    dealt = index.sparkSession.sparkContext.broadcast(owner)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list[bytes]] = [[] for _ in names]
            for lengths, data in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                held = np.frombuffer(data, dtype=POSTING).copy()
                held["value"] = impacts(held["value"].astype(np.int64), np.frombuffer(lengths, dtype=np.int64)[held["doc"]], stats)
                owners = dealt.value[held["term"]]
                for k, column in enumerate(columns):
                    column.append(held[owners == k].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *[pa.array(c, pa.binary()) for c in columns]], names=["block", "ids", *names]
            )

    schema = ", ".join(["block long, ids array<long>", *[f"{n} binary" for n in names]])
    return write_out(map_batches(index, rows, schema))


# --------------------------------------------------------------------- stages


@dataclass(frozen=True)
class Owner:
    """What an owner needs to know of a bundle: pairs sorted by term, tenth best scores, and bounds of what follows."""

    #: Terms of the owner, where each one's items begin, the items, and the weights of the terms.
    terms: np.ndarray
    first: np.ndarray
    items: np.ndarray
    weights: np.ndarray
    #: Per item: the tenth best score so far, the most this owner and the later ones add, and the most the later ones add.
    tenth: np.ndarray
    ahead: np.ndarray
    after: np.ndarray


def add(owner: Owner, carried: np.ndarray, held: np.ndarray, n_docs: int) -> np.ndarray:
    """The accumulators of a block after an owner's contributions, sorted by item and document.

    Items are added up a few at a time, so that at most ``CELLS`` cells (or one item's) are in memory.
    """
    n_items = len(owner.tenth)
    step = max(1, CELLS // max(n_docs, 1))
    present, first = np.unique(held["term"], return_index=True)
    ends = np.append(first[1:], len(held))
    # A block may hold terms of the owner that add nothing to any item.
    asked = np.isin(present, owner.terms)
    place, first, ends = np.searchsorted(owner.terms, present[asked]), first[asked], ends[asked]
    may_open = owner.ahead >= owner.tenth
    out = []
    for lo in range(0, n_items, step):
        hi = min(lo + step, n_items)
        scores = np.zeros((hi - lo, n_docs), dtype=np.int64)
        a, b = np.searchsorted(carried["item"], [lo, hi])
        scores[carried["item"][a:b] - lo, carried["doc"][a:b]] = carried["score"][a:b]
        known = scores > 0
        for k, s, e in zip(place, first, ends, strict=True):
            items = owner.items[owner.first[k] : owner.first[k + 1]]
            items = items[(items >= lo) & (items < hi)] - lo
            if len(items):
                # Documents of a term are distinct, and so are its items.
                scores[np.ix_(items, held["doc"][s:e])] += owner.weights[k] * held["value"][s:e].astype(np.int64)
        bound = scores + owner.after[lo:hi, None]
        keep = (scores > 0) & (bound >= owner.tenth[lo:hi, None]) & (known | may_open[lo:hi, None])
        item, doc = np.nonzero(keep)
        rows = np.zeros(len(item), dtype=ENTRY)
        rows["item"], rows["doc"], rows["score"] = item + lo, doc, scores[item, doc]
        out.append(rows)
    return np.concatenate(out) if out else np.zeros(0, dtype=ENTRY)


def _leading(entries: np.ndarray, ids: np.ndarray | None) -> np.ndarray:
    """Places of the ten best entries of each item in a block, with ``ids`` by id among equal scores."""
    keys = (-entries["score"], entries["item"]) if ids is None else (ids[entries["doc"]], -entries["score"], entries["item"])
    order = np.lexsort(keys)
    items = entries["item"][order]
    starts = np.flatnonzero(np.append(True, items[1:] != items[:-1])) if len(items) else np.zeros(0, dtype=int)
    rank = np.arange(len(items)) - np.repeat(starts, np.diff(np.append(starts, len(items))))
    return order[rank < BEST]


def stage(carried: DataFrame, index: DataFrame, k: int, owner: Owner) -> DataFrame:
    """The bundle at owner ``k``: (block, entries, best), ``best`` being the ten best entries of each item in the block.

    At the last owner ``entries`` are no longer carried, and ``best`` has the ids of the documents.
    """
    last = k == len(OWNERS) - 1
    known = index.sparkSession.sparkContext.broadcast(owner)
    # The last owner needs the ids, the others only how many there are.
    own = index.select("block", F.col(f"owner_{k}").alias("postings"), F.size("ids").alias("n_docs"), *(["ids"] if last else []))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        entries = np.frombuffer(left.column("entries")[0].as_py(), dtype=ENTRY)
        held = np.frombuffer(right.column("postings")[0].as_py(), dtype=POSTING)
        entries = add(known.value, entries, held, right.column("n_docs")[0].as_py())
        ids = right.column("ids")[0].values if last else None
        # A null id comes after all others.
        order = None if ids is None else np.argsort(np.argsort(_sortable(ids), kind="stable"), kind="stable")
        best = entries[_leading(entries, order)]
        named = pa.nulls(len(best), pa.int64()) if ids is None else ids.take(pa.array(best["doc"]))
        listed = pa.ListArray.from_arrays(
            pa.array([0, len(best)], pa.int32()),
            pa.StructArray.from_arrays([pa.array(best["item"]), named, pa.array(best["score"])], ["item", "doc_id", "score"]),
        )
        return pa.table(
            [left.column("block"), pa.array([b"" if last else entries.tobytes()], pa.binary()), listed],
            ["block", "entries", "best"],
        )

    schema = "block long, entries binary, best array<struct<item: int, doc_id: long, score: long>>"
    return write_out(carried.groupBy("block").cogroup(own.groupBy("block")).applyInArrow(meet, schema))


def _sortable(ids: pa.Array) -> np.ndarray:
    """Ids as numbers of their order, equal ones in a row, nulls last."""
    values = ids.fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
    rank = np.unique(values, return_inverse=True)[1]
    missing = ids.is_null().to_numpy(zero_copy_only=False)
    return np.where(missing, len(values), rank)


def _ranked(reached: DataFrame, *order: Column) -> DataFrame:
    """The ten best rows (item, doc_id, score) of each item over all blocks."""
    rows = reached.select(F.inline("best"))
    # Ranks up to ten are cut on the map side too.
    rank = F.row_number().over(Over.partitionBy("item").orderBy(F.col("score").desc(), *order))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= BEST)


# -------------------------------------------------------------------- bundles


def bundles(items: DataFrame, size: int) -> tuple[DataFrame, int]:
    """(bundle, item_id, listed): the distinct terms of each item, and how many bundles there are."""
    listed = write_out(
        items.select(F.col("item_id"), F.array_distinct(terms("text")).alias("listed")).filter(F.size("listed") > 0)
    )
    # One number.
    pairs = listed.agg(F.sum(F.size("listed"))).first()[0] or 0
    count = -(-pairs // size)
    return listed.withColumn("bundle", F.pmod(F.xxhash64("item_id", "listed"), F.lit(max(count, 1)))), count


def _search_bundle(spark: SparkSession, held: list, index: DataFrame, hashes: np.ndarray, stats: Statistics, owner: np.ndarray, most: np.ndarray) -> DataFrame:
    listed = [term_hashes(row["listed"]) for row in held]
    item = np.repeat(np.arange(len(held)), [len(x) for x in listed])
    term = np.searchsorted(hashes, np.concatenate(listed))
    weights = stats.weights()
    useful = (stats.holders[term] > 0) & (weights[term] > 0)
    item, term = item[useful], term[useful]
    adds = np.zeros((len(OWNERS) + 1, len(held)), dtype=np.int64)
    for k in range(len(OWNERS)):
        own = owner[term] == k
        np.add.at(adds[k], item[own], (weights * most)[term[own]])
    ahead = np.cumsum(adds[::-1], axis=0)[::-1]

    tenth = np.ones(len(held), dtype=np.int64)
    reached = index.select("block", F.lit(b"").alias("entries"))
    for k in range(len(OWNERS)):
        own = np.flatnonzero(owner[term] == k)
        own = own[np.argsort(term[own], kind="stable")]
        present, first = np.unique(term[own], return_index=True)
        dealt = Owner(
            present, np.append(first, len(own)), item[own].astype(np.int64), weights[present], tenth.copy(), ahead[k], ahead[k + 1]
        )
        reached = stage(reached.select("block", "entries"), index, k, dealt)
        if k < len(OWNERS) - 1:
            # A number for each item of the bundle.
            for row in _ranked(reached).filter(F.col("rank") == BEST).select("item", "score").collect():
                tenth[row["item"]] = max(tenth[row["item"]], row["score"])
    names = spark.createDataFrame([(i, row["item_id"]) for i, row in enumerate(held)], f"item int, item_id {held[0]['kind']}")
    return (
        _ranked(reached, F.col("doc_id").asc_nulls_last())
        .join(F.broadcast(names), "item")
        .select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
    )


def search(docs: DataFrame, items: DataFrame, *, bundle_terms: int = BUNDLE_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ten best documents of each item, those with a score above 0."""
    spark = docs.sparkSession
    kind = items.schema["item_id"].dataType.simpleString()
    parted, count = bundles(items, bundle_terms)
    result = None
    for number in range(count):
        # About ``bundle_terms`` pairs of item and term.
        held = parted.filter(F.col("bundle") == number).select("item_id", "listed", F.lit(kind).alias("kind")).collect()
        if not held:
            continue
        hashes = np.unique(term_hashes(sorted({t for row in held for t in row["listed"]})))
        index = postings(docs, hashes)
        stats = statistics(index, len(hashes))
        if not stats.documents:
            continue
        order = np.argsort(stats.holders, kind="stable")
        share = np.cumsum(stats.holders[order]) / max(1, stats.holders.sum())
        owner = np.zeros(len(hashes), dtype=np.int8)
        owner[order] = np.minimum(np.searchsorted(OWNERS, share - 1e-12), len(OWNERS) - 1)
        dealt = owned(index, stats, owner)
        most = np.max([_summed(dealt, f"owner_{k}", _most, len(hashes)) for k in range(len(OWNERS))], axis=0)
        found = _search_bundle(spark, held, dealt, hashes, stats, owner, most)
        result = found if result is None else result.unionByName(found)
    if result is None:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    return result
