"""A Merkle manifest of a table with a witness for every row, by incremental witnesses.

Leaves of a source stand in order of id. They are appended one by one to a stream that keeps, per
level, the open run of at most ``FAN`` complete subtrees. A completed run becomes one node of the level above,
and the witness of every leaf below it grows by the siblings it has in that run; until then the
witness is partial. Streams run on aligned blocks of ``FAN ** LEVELS`` nodes, so a block is a whole subtree, blocks
are independent of each other, and a source of any size is many of them. Roots of blocks are
appends to the next, shorter stream, down to one root per source; the sources' roots are appended to the last stream. A
leaf's witness is its own in its block, followed by its block's in the stream above, and so on.

Defined results: a null field is hashed as ``-``, an empty one as ``0:``. A null source is a source of its own, before all others; null ids
come first in a source. Rows that share an id in a source are ordered by their leaf; rows alike in all fields are leaves of their own.
A lone leaf is its source's root, a lone source's root is the table's. A table without rows has an empty result. Long
texts are hashed where they are read; only digests are shuffled. Columns besides the five hashed ones are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as Over

from rondas.sources.shared import write_out

FAN = 3
#: Levels of a block: streams have at most FAN ** LEVELS nodes.
LEVELS = 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

WITNESS = "array<struct<before: binary, after: binary>>"
_PART_BITS = 33  # monotonically_increasing_id: partition number above, row number below


# ---------------------------------------------------------------------- leaves


def leaf(**fields: Column) -> Column:
    """Hex digest of the five fields, each as its length in bytes and its text."""
    parts = []
    for name in FIELDS:
        value = fields.get(name, F.col(name)).cast("string")
        parts.append(F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value), F.lit(":"), value)))
    return F.sha2(F.concat(*parts), 256)


def without_line_ends() -> Column:
    return F.replace(F.col("text"), F.lit("\n"), F.lit(""))


def leaves(docs: DataFrame, tampered: Column) -> DataFrame:
    """(doc_id, source, leaf, altered): digests of each row, and of the row with its text tampered with; null where it is not."""
    return docs.select(
        "doc_id",
        "source",
        F.unhex(leaf()).alias("leaf"),
        F.when(tampered, F.unhex(leaf(text=without_line_ends()))).alias("altered"),
    )


# ---------------------------------------------------------------------- places


def _ranked(rows: DataFrame, keys: list[str], order: list[str], parts: int) -> tuple[DataFrame, DataFrame | None]:
    """``rows`` with their place ``pos``, from 0, among those with equal ``keys``; and (keys, total, grp), grp counting keys from 0.

    Rows are sorted by range over all tasks, so neither a key with most of the rows nor many equal rows
    gather in one of them. Nulls come first.
    """
    # Equal rows are told apart by where they were read, so that they can be split.
    # ``rows`` are files by now: a lost task reads the same rows in the same order again.
    told = rows.withColumn("_row", F.monotonically_increasing_id())
    sort = [F.col(c).asc_nulls_first() for c in [*keys, *order, "_row"]]
    placed = write_out(
        told.repartitionByRange(parts, *sort)
        .sortWithinPartitions(*sort)
        .drop("_row")
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_at", _PART_BITS))
    )
    # At most (partitions + keys) stretches.
    stretches = placed.groupBy(*keys, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Over.partitionBy(*keys).orderBy("_part").rowsBetween(Over.unboundedPreceding, -1)
    marks = stretches.withColumn("_prev", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    if keys:
        sizes = write_out(stretches.groupBy(*keys).agg(F.sum("_n").alias("size")))
        ranked, _ = _ranked(sizes, [], keys, parts)
        totals = write_out(ranked.select(*keys, F.col("size").alias("total"), F.col("pos").alias("grp")))
        same = reduce(lambda a, b: a & b, [F.col(f"m.{c}").eqNullSafe(F.col(f"t.{c}")) for c in keys])
        marks = marks.alias("m").join(totals.alias("t"), same)
    else:
        totals = None
        total = stretches.agg(F.sum("_n")).first()[0] or 0  # a number
        marks = marks.withColumns({"total": F.lit(total).cast("long"), "grp": F.lit(0).cast("long")})
    marks = marks.select(
        *[F.col(f"m.{c}").alias(f"_{c}") for c in keys], F.col("_part").alias("_p"), "_first", "_prev", "total", "grp"
    )
    match = F.col("_part") == F.col("_p")
    for c in keys:
        match = match & F.col(c).eqNullSafe(F.col(f"_{c}"))
    columns = [c for c in placed.columns if c not in ("_at", "_part")]
    numbered = placed.join(marks, match).select(
        *columns, "grp", "total", (F.col("_at") - F.col("_first") + F.col("_prev")).alias("pos")
    )
    return numbered, totals


# ---------------------------------------------------------------------- streams


class Stream:
    """Appends of digests to a tree of ``FAN`` children, up to ``levels`` levels, and the witnesses of what was appended."""

    def __init__(self, levels: int):
        self.levels = levels
        #: Per level, complete subtrees that wait for their siblings: digest and the numbers of the leaves below.
        self.open: list[list[tuple[bytes, list[int]]]] = [[] for _ in range(levels + 1)]
        #: Per leaf, its siblings so far, level by level: those before and those after.
        self.witnesses: list[list[tuple[bytes, bytes]]] = []

    def append(self, digest: bytes) -> None:
        self.witnesses.append([])
        self._place(0, digest, [len(self.witnesses) - 1])

    def _place(self, level: int, digest: bytes, below: list[int]) -> None:
        run = self.open[level]
        run.append((digest, below))
        if len(run) == FAN and level < self.levels:
            self._complete(level)

    def _complete(self, level: int) -> None:
        """The run of a level becomes a node of the next one; every witness below grows by its siblings."""
        run, self.open[level] = self.open[level], []
        digests = [digest for digest, _ in run]
        for i, (_, below) in enumerate(run):
            siblings = (b"".join(digests[:i]), b"".join(digests[i + 1 :]))
            for leaf_ in below:
                self.witnesses[leaf_].append(siblings)
        parent = hashlib.sha256(b"".join(digests).hex().encode()).digest()
        self._place(level + 1, parent, [leaf_ for _, below in run for leaf_ in below])

    def close(self, whole: bool) -> bytes:
        """The root. A ``whole`` tree ends at the level that has one node; a block of a longer one goes up all its levels."""
        for level in range(self.levels):
            run = self.open[level]
            if whole and len(run) == 1 and not any(self.open[level + 1 :]):
                return run[0][0]
            if run:
                self._complete(level)
        return self.open[self.levels][0][0]


def _streamed(size: int, levels: int, names: list[str]) -> Callable[[pa.Table], pa.Table]:
    def block(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos").combine_chunks()
        stream = Stream(levels)
        for digest in table.column("digest").to_pylist():
            stream.append(digest)
        root = stream.close(whole=table.column("total")[0].as_py() <= size)
        offsets, before, after = [0], [], []
        for witness in stream.witnesses:
            for left, right in witness:
                before.append(left)
                after.append(right)
            offsets.append(len(before))
        siblings = pa.StructArray.from_arrays([pa.array(before, pa.binary()), pa.array(after, pa.binary())], ["before", "after"])
        witnesses = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), siblings)
        roots = pa.array([root] * len(table), pa.binary())
        return pa.table([*[table.column(c) for c in names], witnesses, roots], [*names, "witness", "root"])

    return block


def _rounds(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """Streams over (grp, pos, total, digest, ...): per round the nodes with ``block``, ``witness`` in their block and its ``root``."""
    size = FAN**levels
    rounds = []
    while True:
        nodes = nodes.withColumn("block", F.floor(F.col("pos") / size).cast("long"))
        names = nodes.columns
        schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema.fields])
        rounds.append(
            write_out(
                nodes.groupBy("grp", "block").applyInArrow(_streamed(size, levels, names), f"{schema}, witness {WITNESS}, root binary")
            )
        )
        # One number: how long the longest stream is.
        longest = rounds[-1].agg(F.max("total")).first()[0] or 0
        if longest <= size:
            return rounds
        nodes = rounds[-1].filter((F.col("pos") % size == 0) & (F.col("total") > size)).select(
            "grp", F.col("block").alias("pos"), F.ceil(F.col("total") / size).cast("long").alias("total"), F.col("root").alias("digest")
        )


def _extended(rounds: list[DataFrame], above: DataFrame | None, size: int) -> DataFrame:
    """The nodes of the first round with whole witnesses, and ``subroot``; ``above`` has the witnesses (grp, up) of the groups."""
    whole = None
    for nodes in reversed(rounds):
        parents = None if whole is None else whole.select("grp", F.col("pos").alias("block"), F.col("witness").alias("up"), "subroot")
        done = F.col("total") <= size
        # Groups of one block: its root is the group's.
        tops = nodes.filter(done & (F.col("pos") == 0)).select("grp", "block", F.col("root").alias("subroot"))
        if above is not None:
            tops = tops.join(above, "grp")
        else:
            tops = tops.withColumn("up", F.array().cast(WITNESS))
        tops = tops.select("grp", "block", "up", "subroot")
        parents = tops if parents is None else parents.unionByName(tops)
        columns = [c for c in nodes.columns if c not in ("witness", "root")]
        whole = nodes.join(parents, ["grp", "block"]).select(*columns, F.concat("witness", "up").alias("witness"), "subroot")
    return whole


# --------------------------------------------------------------------- manifest


def witnesses(docs: DataFrame, tampered: Column, *, levels: int = LEVELS) -> DataFrame:
    """(doc_id, source, leaf, altered, witness, subroot, root) of every row, digests as bytes.

    ``witness`` lists, from the leaf's run up to the root's, the siblings before and after.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = FAN**levels
    rows, sources = _ranked(write_out(leaves(docs, tampered)), ["source"], ["doc_id", "leaf"], parts)
    by_source = _rounds(rows.withColumnRenamed("leaf", "digest"), levels)
    roots = None
    for nodes in by_source:
        done = nodes.filter((F.col("total") <= size) & (F.col("pos") == 0)).select("grp", "root")
        roots = done if roots is None else roots.unionByName(done)
    # A number, and below the root of all: 32 bytes.
    n_sources = F.lit(sources.count()).cast("long")
    tops = roots.select(
        F.lit(0).cast("long").alias("grp"), F.col("grp").alias("pos"), n_sources.alias("total"), F.col("root").alias("digest")
    )
    last = write_out(_extended(_rounds(tops, levels), None, size).select(
        F.col("pos").alias("grp"), F.col("witness").alias("up"), F.col("subroot").alias("root")
    ))
    whole = _extended(by_source, last.select("grp", "up"), size)
    root = (last.select("root").first() or [None])[0]
    return whole.select(
        "doc_id", "source", F.col("digest").alias("leaf"), "altered", "witness", "subroot",
        F.lit(None if root is None else bytes(root)).cast("binary").alias("root"),
    )


def folded(digest: Column, witness: Column) -> Column:
    """Hex digest of the root that a leaf's hex digest and a witness lead to."""
    return F.aggregate(
        witness, digest, lambda acc, x: F.sha2(F.concat(_hex(x["before"]), acc, _hex(x["after"])), 256)
    )


def _hex(digest: Column | str) -> Column:
    return F.lower(F.hex(digest))


def manifest(docs: DataFrame, *, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row.

    Rows whose id has an even CRC32 are tampered with before they are folded: their texts lose line ends.
    """
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    rows = witnesses(docs, even, levels=levels)
    siblings = F.array_join(F.transform("witness", lambda x: F.concat(_hex(x["before"]), _hex(x["after"]))), "")
    fold = folded(_hex(F.coalesce("altered", "leaf")), F.col("witness"))
    return rows.select(
        "doc_id",
        _hex("leaf").alias("leaf"),
        _hex("subroot").alias("subroot"),
        _hex("root").alias("root"),
        F.sha2(siblings, 256).alias("proof_sha256"),
        fold.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
