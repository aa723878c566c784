"""Near-duplicate texts by an exact Jaccard join of word n-gram sets, with PartEnum signatures.

Sets are banded by size, so that similar ones fall in one band or in neighbours. In a
band, similar sets differ in at most k elements. The domain of elements is cut
into k // 2 + 1 groups (and a few spare ones), each group into three parts: in some group
two similar sets differ in at most one element, so they agree on two of its three
parts. Each set is signed by every two parts of every group; similar sets share a
signature. Two refinements keep signatures selective without losing a pair:

* A signature of two empty parts says nothing. A set leaves such ones out while no more of its groups
  have one than there are spare groups; a set with more also signs by the least elements of its prefix.
* Sets too small to cut into groups are signed by pairs of least elements.

Equal sets are one node from the start. Nodes that share a signature are tested in
rounds: against the node with most copies under the signature, then against random neighbours, and
at last against every node of another component that a 1,024-bit sketch cannot
rule out (a bit differs for at most each element that differs, so the sketch
never loses a pair). A test compares the whole sets. Pairs inside a component that
is already connected are never made.

Sets are equal if their sums of 64-bit element hashes and sizes are. Defined results:
an empty or null text, or one without words, has no set and stands alone; a text
with fewer words than n is one element; repeated rows share a component; a null
``doc_id`` is never a component's name unless all its members' are null; of equal candidates for a name the least id
stands; an empty table has no rows. A very long text is a block of its own, its set one row. Other columns may have any
name: ``one_of_each`` keeps them, ``near_duplicates`` leaves them out.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as Over
from pyspark.sql import functions as F

from rondas.llm import words as W
from rondas.llm.components import components
from rondas.llm.tables import identity, map_batches
from rondas.sources.shared import scratch, write_out

BAND_RATIO = 1.25
#: Documents looked up by a broadcast of their names, of 16 bytes and about 50 in memory each.
BROADCAST_KEYS = 1_000_000
SKETCH_LONGS = 16
#: Sets of at most so many elements are signed by pairs of least elements.
SMALL = 40
#: Distinct sets a task remembers as signed already.
REMEMBERED = 500_000
_SUBSETS = ((0, 1), (0, 2), (1, 2))


class Bands:
    """Size bands and what each needs, for a threshold in percent."""

    def __init__(self, percent: int):
        if not 50 <= percent <= 99:
            raise ValueError("a threshold is 50 to 99 percent")
        self.percent = percent
        ratio = max(BAND_RATIO, 100 / percent)
        self.edges = [1]
        while self.edges[-1] < 1 << 40:
            self.edges.append(max(self.edges[-1] + 1, int(self.edges[-1] * ratio)))
        tops = np.array(self.edges[1:], dtype=np.int64) - 1
        #: Most differing elements between a set of the band and a similar, not smaller one.
        self.differing = tops * (100 - percent) // percent
        #: Size of the largest set similar to one of the band.
        self.reach = tops * 100 // percent
        needed = self.differing // 2 + 1
        self.spare = needed // 12 + 1
        self.groups = needed + self.spare
        self.edges = np.array(self.edges, dtype=np.int64)

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edges, sizes, side="right") - 1

    def prefix(self, sizes: np.ndarray) -> np.ndarray:
        """Least elements of which similar sets share one."""
        return sizes - -(-self.percent * sizes // 100) + 1


class Sets:
    """Distinct n-grams of each text of a block, sorted by hash within a text."""

    def __init__(self, block: W.Block, n: int):
        words = W.split(block)
        prefix = W.prefix_hashes(W.word_hashes(W.lowered(block.data), words))
        texts = len(words.counts)
        at = W.gram_starts(words, n)
        short = np.flatnonzero((words.counts > 0) & (words.counts < n))
        owner = np.concatenate([words.owner()[at], short])
        hashes = np.concatenate(
            [
                W.mix(W.span_hashes(prefix, at, at + n)),
                W.mix(W.span_hashes(prefix, words.first[short], words.first[short + 1]) + words.counts[short].astype(np.uint64)),
            ]
        )
        order = np.lexsort((hashes, owner))
        owner, hashes = owner[order], hashes[order]
        new = np.append(True, (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1]))[: len(owner)]
        self.owner, self.hashes = owner[new], hashes[new]
        self.sizes = np.bincount(self.owner, minlength=texts)
        self.first = np.append(0, np.cumsum(self.sizes))
        total = np.append(np.uint64(0), np.cumsum(W.mix(self.hashes ^ np.uint64(0x5851F42D4C957F2D))))
        sums = total[self.first[1:]] - total[self.first[:-1]]
        #: Names of the sets; 0 where there is none.
        self.names = np.where(self.sizes > 0, W.mix(sums + self.sizes.astype(np.uint64)), np.uint64(0)).view(np.int64)

    def sketches(self) -> np.ndarray:
        """Per text, bits that tell which of 1,024 classes of elements hold an odd number."""
        bits = SKETCH_LONGS * 64
        odd = np.bincount(self.owner * bits + (self.hashes >> np.uint64(50)).astype(np.int64) % bits, minlength=len(self.sizes) * bits) & 1
        return np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(-1, SKETCH_LONGS)

    def signatures(self, bands: Bands, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Signatures of the sets of the texts ``wanted`` (a mask), and the text of each."""
        sizes = self.sizes
        # Smaller sets are similar only to equal ones: a larger one by one element is too different.
        wanted = wanted & (sizes * (100 - bands.percent) >= bands.percent)
        found = []
        small = wanted & (sizes <= SMALL * 100 // bands.percent)
        if small.any():
            length = np.where(small, np.minimum(bands.prefix(sizes) + 1, sizes), 0)
            for i, j in itertools.combinations(range(int(length.max())), 2):
                of = np.flatnonzero(length > j)
                a, b = self.hashes[self.first[of] + i], self.hashes[self.first[of] + j]
                found.append((W.mix(a * np.uint64(3) + W.mix(b)), of))
        band = bands.of(np.maximum(sizes, 1))
        for step in (0, 1):  # as the smaller or equal set, as the larger one of the band below
            at = band - step
            chosen = wanted & (sizes > SMALL) & (sizes <= bands.reach[np.maximum(at, 0)]) & (at >= 0)
            if step:
                chosen &= bands.edges[at + 1] - 1 > SMALL
            if chosen.any():
                found += self._grouped(bands, at, chosen)
        if not found:
            return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        signs, of = zip(*found, strict=True)
        return np.concatenate(signs), np.concatenate(of)

    def _grouped(self, bands: Bands, band: np.ndarray, chosen: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        texts = np.flatnonzero(chosen)
        groups = bands.groups[band[texts]]
        base = np.zeros(len(chosen), dtype=np.int64)
        base[texts] = np.cumsum(groups) - groups
        inside = chosen[self.owner]
        hashes, owner = self.hashes[inside], self.owner[inside]
        spread = W.mix(hashes ^ np.uint64(0x2545F4914F6CDD1D))
        group = ((spread >> np.uint64(34)).astype(np.int64)) % bands.groups[band[owner]]
        part = ((spread & np.uint64(0xFFFFFF)).astype(np.int64)) % 3
        cell = (base[owner] + group) * 3 + part
        total = int(groups.sum())
        held = np.zeros(total * 3, dtype=np.uint64)
        np.add.at(held, cell, spread)
        held = W.mix(held).reshape(total, 3)
        empty = (np.bincount(cell, minlength=total * 3) == 0).reshape(total, 3)
        text = np.repeat(texts, groups)
        number = np.arange(total) - base[text]
        salt = W.mix((band[text] * 1_000_003 + number).astype(np.uint64))
        found, weak = [], np.zeros(total, dtype=bool)
        for k, (i, j) in enumerate(_SUBSETS):
            nothing = empty[:, i] & empty[:, j]
            weak |= nothing
            signs = W.mix(held[:, i] * np.uint64(5) + held[:, j] * np.uint64(7) + salt + np.uint64(k))
            found.append((signs[~nothing], text[~nothing]))
        more = np.bincount(text[weak], minlength=len(chosen)) > np.where(chosen, bands.spare[band], 0)
        if more.any():
            of = np.flatnonzero(more)
            length = bands.prefix(self.sizes[of])
            step = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
            found.append((W.mix(self.hashes[np.repeat(self.first[of], length) + step]), np.repeat(of, length)))
        return found


def document_sets(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, rid, tag, n_shingles, node, s0, s1, ...): size, name and sketch of each document's set."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in W.blocks(batch.column(3)):
                sets = Sets(block, n)
                none = pa.array(sets.sizes == 0)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[c.slice(block.lo, block.hi - block.lo) for c in batch.columns[:3]],
                        pa.array(sets.sizes.astype(np.int64)),
                        pc.if_else(none, None, pa.array(sets.names)),
                        *[pa.array(np.ascontiguousarray(s)) for s in sets.sketches().T],
                    ],
                    names=["doc_id", "rid", "tag", "n_shingles", "node", *[f"s{i}" for i in range(SKETCH_LONGS)]],
                )

    schema = "doc_id bigint, rid bigint, tag bigint, n_shingles bigint, node bigint, " + ", ".join(
        f"s{i} bigint" for i in range(SKETCH_LONGS)
    )
    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), *identity(), "text"), summed, schema)


def signature_rows(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(sign, node): each distinct set's signatures, once for each task that meets it."""
    bands = Bands(percent)

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for block in W.blocks(batch.column(0)):
                sets = Sets(block, n)
                new = np.zeros(len(sets.sizes), dtype=bool)
                for i, name in enumerate(sets.names.tolist()):
                    if name not in seen:
                        seen.add(name)
                        new[i] = True
                if len(seen) > REMEMBERED:
                    seen.clear()
                signs, of = sets.signatures(bands, new)
                if len(signs):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(signs.view(np.int64)), pa.array(sets.names[of])], names=["sign", "node"]
                    )

    return map_batches(docs.select("text"), signed, "sign bigint, node bigint")


def element_lists(docs: DataFrame, n: int) -> DataFrame:
    """(node, elements): the hashed set of each document."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in W.blocks(batch.column(0)):
                sets = Sets(block, n)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(sets.names),
                        pa.ListArray.from_arrays(pa.array(sets.first.astype(np.int32)), pa.array(sets.hashes.view(np.int64))),
                    ],
                    names=["node", "elements"],
                )

    return map_batches(docs.select("text"), listed, "node bigint, elements array<bigint>")


def _similar(sizes_a: str, sizes_b: str, differing: str, percent: int) -> str:
    """A difference small enough: intersection = (a + b - d) / 2, union = (a + b + d) / 2."""
    return f"100 * ({sizes_a} + {sizes_b} - {differing}) >= {percent} * ({sizes_a} + {sizes_b} + {differing})"


def components_of_sets(docs: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """``document_sets``, written, and (node, least, component) for each distinct set: its least ``doc_id`` and its component.

    Two documents are linked when 100 * intersection >= percent * union of their sets.
    """
    sets = write_out(document_sets(docs, n))
    sketch = [f"s{i}" for i in range(SKETCH_LONGS)]
    nodes = (
        sets.filter("node IS NOT NULL")
        .groupBy("node")
        .agg(
            F.min("doc_id").alias("least"),
            F.count(F.lit(1)).alias("copies"),
            F.min(F.struct("rid", "tag")).alias("at"),
            F.first("n_shingles").alias("size"),
            *[F.first(s).alias(s) for s in sketch],
        )
    )
    nodes = write_out(nodes)
    with scratch(docs.sparkSession):  # all but the names of components goes
        names = write_out(components(_links(docs, nodes, n, percent)), keep=True)
    return sets, nodes.join(names, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component"))


def _links(docs: DataFrame, nodes: DataFrame, n: int, percent: int) -> DataFrame:
    """(a, b): links enough to connect what is connected."""
    sketch = [f"s{i}" for i in range(SKETCH_LONGS)]
    sign = Over.partitionBy("sign")
    shared = (
        signature_rows(docs, n, percent)
        .select("sign", "node", (F.min("node").over(sign) != F.max("node").over(sign)).alias("shared"))
        .filter("shared")
        .select("sign", "node")
        .distinct()
    )
    shared = write_out(shared)
    involved = nodes.join(shared.select("node").distinct(), "node", "left_semi")
    members = write_out(shared.join(involved.select("node", "copies", "size", *sketch), "node"))
    wanted = involved.select("at.rid", "at.tag").distinct()
    texts = docs.select(*identity(), "text").join(wanted, ["rid", "tag"], "left_semi")
    elements = write_out(element_lists(texts, n))

    differing = " + ".join(f"bit_count(a.{s} ^ b.{s})" for s in sketch)
    possible = _similar("a.size", "b.size", f"({differing})", percent)

    def verified(pairs: DataFrame) -> DataFrame:
        """Of distinct pairs (a, b), those that are similar."""
        common = "CAST(size(array_intersect(x, y)) AS BIGINT)"
        return write_out(
            pairs.join(elements.select(F.col("node").alias("a"), F.col("elements").alias("x")), "a")
            .join(elements.select(F.col("node").alias("b"), F.col("elements").alias("y")), "b")
            .filter(f"100 * {common} >= {percent} * (size(x) + size(y) - {common})")
            .select("a", "b")
            .distinct()
        )

    def paired(left: DataFrame, right: DataFrame, condition: str) -> DataFrame:
        joined = left.alias("a").join(right.alias("b"), F.expr(f"a.sign = b.sign AND {condition} AND {possible}"))
        return joined.select(
            F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b")
        ).distinct()

    # Against the node with most copies under each signature.
    hubs = (
        members.groupBy("sign")
        .agg(F.max(F.struct("copies", "node", "size", *sketch)).alias("hub"))
        .select("sign", "hub.*")
    )
    links = verified(paired(members, hubs, "a.node <> b.node"))

    def named(links: DataFrame) -> DataFrame:
        """Members whose signature still joins different components."""
        names = components(links)
        whole = members.join(names, "node", "left").withColumn("component", F.coalesce("component", "node"))
        mixed = F.min("component").over(sign) != F.max("component").over(sign)
        return whole.withColumn("mixed", mixed).filter("mixed").drop("mixed")

    # Against the next node in an order of its own for each signature.
    order = sign.orderBy(F.xxhash64("sign", "node"))
    chain = write_out(named(links).withColumn("next", F.lead("node").over(order)))
    following = chain.select(F.col("next").alias("from"), "sign").join(
        chain.withColumnRenamed("node", "from").drop("next"), ["from", "sign"]
    ).withColumnRenamed("from", "node")
    links = links.union(verified(paired(chain, following, "a.next = b.node AND a.component <> b.component")))

    # Against all that are left.
    rest = write_out(named(links))
    return links.union(verified(paired(rest, rest, "a.node < b.node AND a.component <> b.component")))


def bounded(keys: DataFrame) -> DataFrame:
    """Written (rid, tag), to be broadcast while they are few; beyond that Spark joins by shuffling."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def near_duplicates(docs: DataFrame, *, n: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document: the least ``doc_id`` reachable by links."""
    sets, names = components_of_sets(docs, n, percent)
    least = names.groupBy("component").agg(F.min("least").alias("component_id"))
    of_node = names.join(least, "component").select("node", "component_id")
    return sets.join(of_node, "node", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
    )


def one_of_each(docs: DataFrame, *, n: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without near duplicates: of each component the row of least ``doc_id`` (null ones last).

    Texts without words are linked with nothing and all stay.
    """
    columns = docs.columns
    sets, names = components_of_sets(docs, n, percent)
    worded = sets.filter("node IS NOT NULL")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid", "tag"))
    per_node = worded.groupBy("node").agg(first.alias("first"))
    chosen = (
        per_node.join(names, "node").groupBy("component").agg(F.min("first").alias("first")).select("first.rid", "first.tag")
    )
    # Most documents stay where they are: the few that go are looked up, and so are those whose row is repeated.
    rows_of = worded.groupBy("rid", "tag").agg(F.count(F.lit(1)).alias("n"))
    gone = write_out(rows_of.join(chosen, ["rid", "tag"], "left_anti").select("rid", "tag"))
    repeated = write_out(rows_of.filter("n > 1").select("rid", "tag").join(chosen, ["rid", "tag"], "left_semi"))
    number = [f"d{i}" for i in range(len(columns))]
    rows = docs.select(*identity(), *[F.col(f"`{c}`").alias(d) for c, d in zip(columns, number, strict=True)])
    text = number[columns.index("text")]
    same = Over.partitionBy("rid", "tag").orderBy(*[d for d in number if d != text])
    single = rows.join(bounded(gone.union(repeated)), ["rid", "tag"], "left_anti")
    first_rows = (
        rows.join(bounded(repeated), ["rid", "tag"], "left_semi").withColumn("row", F.row_number().over(same)).filter("row = 1")
    )
    both = single.select(*number).unionByName(first_rows.select(*number))
    return both.select(*[F.col(d).alias(c) for c, d in zip(columns, number, strict=True)])
