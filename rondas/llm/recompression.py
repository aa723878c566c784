"""Removal of word sequences that occur more than once, by recompression.

The words of every text are compressed in rounds: a run of equal symbols becomes
one symbol, then neighbours that a coin on their names calls left and right become
one. A symbol is named by a hash of the words under it, so all tasks give equal
sequences equal names without a dictionary. A round touches only symbols up to its
length limit; whether a symbol begins at a word then depends on no more than
``REACH`` words on either side. Two equal windows therefore have the same symbol
borders in their middle and, of those, the same one of least name: their landmark.

Spark groups the landmarks of all texts by the words around them. Only where such
a symbol context is shared are the windows around it compared, each by a further
hash of all its words. Covered words go in a last pass over the texts.

Sizes: about one row per 12 words is shuffled. A window that repeats inside a batch
of texts is settled there and sent once, so a passage in very many texts adds a
row per batch, not one per text. Groups are windows and sorts that spill, nothing
is collected but the marks of one text.

Equality is that of two independent hashes, 64 bits for the context of a landmark and
48 for the window. Defined results: null and empty texts have no words; texts shorter than
a window keep all; of repeated rows each is a copy of the other, so both lose what is
long enough; rows of null ``doc_id`` are told apart by their text. Other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as Over
from pyspark.sql import functions as F

from rondas.llm import words as W
from rondas.llm.tables import identity, map_batches

WINDOW = 35
#: Rounds in order: what is joined, and the longest symbol (in words) that takes part.
ROUNDS = (("run", 1), ("pair", 1), ("run", 2), ("pair", 2))
REACH = sum(limit for _, limit in ROUNDS)
HASH_BYTES = 6
MARK_BITS = 60
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def symbol_starts(names_of: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where symbols begin after all rounds. ``names_of``: prefix hashes of words; ``first``: where texts begin."""
    n = len(names_of) - 1
    starts = np.arange(n)
    text_start = np.zeros(n + 1, dtype=bool)
    text_start[first] = True
    for step, (kind, limit) in enumerate(ROUNDS):
        if not len(starts):
            break
        ends = np.append(starts[1:], n)
        lengths = ends - starts
        names = W.mix(W.span_hashes(names_of, starts, ends) + lengths.astype(np.uint64))
        if kind == "run":
            joined = names[:-1] == names[1:]
        else:
            left = (W.mix(names + np.uint64(step)) & np.uint64(1)).astype(bool)
            joined = left[:-1] & ~left[1:]
        active = lengths <= limit
        joined &= active[:-1] & active[1:] & ~text_start[starts[1:]]
        starts = starts[np.append(True, ~joined)]
    return starts


def landmarks(block: W.Block, window: int) -> tuple[np.ndarray, ...]:
    """Of every window of a block: text, place in it, landmark, the landmark's context hash, the window's hash."""
    words = W.split(block)
    hashes = W.prefix_hashes(W.word_hashes(block.data, words))
    n = len(words.starts)
    at = W.gram_starts(words, window)
    if not len(at):
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    inner = np.arange(REACH, n - REACH + 1)
    context = np.zeros(n + 1, dtype=np.uint64)
    context[inner] = W.mix(W.span_hashes(hashes, inner - REACH, inner + REACH))
    # Least name first, then leftmost; places without a border come last.
    border = np.full(n + 1, _NONE)
    places = symbol_starts(hashes, words.first)
    border[places] = (context[places] >> np.uint64(33) << np.uint64(32)) | places.astype(np.uint64)
    length, width = window - 2 * REACH + 1, 1
    while width < length:  # least over 2, 4, ... places, then over all
        step = min(width, length - width)
        border = np.append(np.minimum(border[:-step], border[step:]), np.full(step, _NONE))
        width += step
    best = border[at + REACH]
    mark = np.where(best == _NONE, at + REACH, (best & np.uint64(0xFFFFFFFF)).astype(np.int64))
    text = words.owner()[at]
    whole = W.mix(W.span_hashes(hashes, at, at + window))
    return text + block.lo, at - words.first[text], mark - words.first[text], context[mark], whole


def _groups(*breaks: np.ndarray) -> np.ndarray:
    """Starts of the stretches between breaks, and the end."""
    return np.append(np.flatnonzero(np.logical_or.reduce(breaks)), len(breaks[0]))


def window_rows(texts: pa.Array, window: int) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Rows to compare with other batches, and marks of windows that repeat within this one."""
    parts = [landmarks(block, window) for block in W.blocks(texts)]
    text, at, mark, context, whole = (
        (np.concatenate(p) for p in zip(*parts, strict=True)) if parts else (np.zeros(0, dtype=np.int64),) * 5
    )
    order = np.argsort(whole, kind="stable")
    same = whole[order[1:]] == whole[order[:-1]]
    again, twice = np.zeros(len(whole), dtype=bool), np.zeros(len(whole), dtype=bool)
    again[order[1:][same]] = True  # not the first of its kind
    twice[order[1:][same]] = twice[order[:-1][same]] = True

    def broken(kept: np.ndarray) -> np.ndarray:
        t, a = text[kept], at[kept]
        return np.append(True, (t[1:] != t[:-1]) | (a[1:] != a[:-1] + 1))[: len(t)]

    sent = np.flatnonzero(~again)
    m = mark[sent]
    edges = _groups(broken(sent), np.append(True, m[1:] != m[:-1])[: len(m)])
    head = sent[edges[:-1]]
    short = np.ascontiguousarray(whole[sent].view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES]).reshape(-1)
    rows = {"text": text[head], "key": context[head].view(np.int64), "start": at[head], "edges": edges, "bytes": short}

    found = np.flatnonzero(twice)
    edges = _groups(broken(found))
    starts, counts = at[found[edges[:-1]]], np.diff(edges)
    pieces = -(-counts // MARK_BITS)
    step = (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * MARK_BITS
    left = np.minimum(np.repeat(counts, pieces) - step, MARK_BITS)
    marks = {
        "text": np.repeat(text[found[edges[:-1]]], pieces),
        "start": np.repeat(starts, pieces) + step,
        "mask": (np.int64(1) << left) - 1,
    }
    return rows, marks


def _removed(texts: pa.Array, marks: pa.Array, window: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words and removed words of each text, and the kept words joined by a blank."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    counts, gone, data, ends = [], [], [], []
    for block in W.blocks(texts):
        words = W.split(block)
        own = marks.slice(block.lo, block.hi - block.lo)
        flat = own.flatten()
        of = np.repeat(np.arange(len(own)), pc.list_value_length(own).fill_null(0).to_numpy())
        start, mask = (flat.field(f).to_numpy(zero_copy_only=False) for f in ("start", "mask"))
        row, bit = np.nonzero((mask[:, None] >> np.arange(MARK_BITS)) & 1) if len(mask) else (np.zeros(0, int),) * 2
        removed = W.covered(len(words.starts), words.first[of[row]] + start[row] + bit, window)
        kept = np.flatnonzero(~removed)
        steps = np.zeros(len(block.data) + 1, dtype=np.int8)
        steps[words.starts[kept]] = 1
        # A word may begin right where the one before ended only at the start of a text.
        np.add.at(steps, words.ends[kept], -1)
        wanted = np.cumsum(steps[:-1], dtype=np.int8) > 0
        owner = words.owner()[kept]
        later = np.append(False, owner[1:] == owner[:-1])[: len(owner)]
        blanks = words.starts[kept[later]] - 1
        bytes_ = block.data.copy()
        bytes_[blanks] = 0x20
        wanted[blanks] = True
        counts.append(words.counts)
        gone.append(W.per_text(removed, words.first))
        data.append(bytes_[wanted])
        ends.append(W.per_text(wanted, block.offsets))
    offsets = np.append(0, np.cumsum(np.concatenate(ends))).astype(np.int64)
    kept_texts = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets), pa.py_buffer(np.concatenate(data)))
    return np.concatenate(counts), np.concatenate(gone), kept_texts.cast(pa.string())


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Marks (rid, tag, start, mask): the windows of text (rid, tag) from word ``start`` on whose bit is set repeat."""
    if window < 2 * REACH:
        raise ValueError(f"windows have at least {2 * REACH} words")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid, tag, texts = batch.columns
            sent, marks = window_rows(texts, window)
            names = ["key", "rid", "tag", "start", "hashes", "mask"]
            if len(sent["text"]):
                offsets = (sent["edges"] * HASH_BYTES).astype(np.int32)
                hashes = pa.Array.from_buffers(
                    pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(sent["bytes"])]
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(sent["key"]),
                        rid.take(pa.array(sent["text"])),
                        tag.take(pa.array(sent["text"])),
                        pa.array(sent["start"].astype(np.int32)),
                        hashes,
                        pa.nulls(len(offsets) - 1, pa.int64()),
                    ],
                    names=names,
                )
            n = len(marks["text"])
            if n:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.nulls(n, pa.int64()),
                        rid.take(pa.array(marks["text"])),
                        tag.take(pa.array(marks["text"])),
                        pa.array(marks["start"].astype(np.int32)),
                        pa.nulls(n, pa.binary()),
                        pa.array(marks["mask"]),
                    ],
                    names=names,
                )

    schema = "key bigint, rid bigint, tag bigint, start int, hashes binary, mask bigint"
    found = map_batches(docs.select(*identity(), "text"), rows, schema)
    # A null key (settled in its batch) passes through the same shuffle, spread by its text.
    spread = F.coalesce("key", F.xxhash64("rid", "start"))
    shared = F.count(F.lit(1)).over(Over.partitionBy("slot")) > 1
    rows_ = found.withColumn("slot", spread)
    near = rows_.withColumn("shared", shared).filter("shared OR mask IS NOT NULL")
    each = near.select(
        "slot", "rid", "tag", "start", "mask", F.posexplode_outer(
            F.expr(f"transform(sequence(0, length(hashes) div {HASH_BYTES} - 1), "
                   f"j -> substring(hashes, j * {HASH_BYTES} + 1, {HASH_BYTES}))")
        ).alias("bit", "hash"),
    )
    both = F.count(F.lit(1)).over(Over.partitionBy("slot", "hash")) > 1
    bit = F.coalesce("mask", F.expr("shiftleft(1L, bit)"))
    return (
        each.withColumn("both", both)
        .filter("both OR mask IS NOT NULL")
        .groupBy("slot", "rid", "tag", "start")
        .agg(F.bit_or(bit).alias("mask"))
        .drop("slot")
    )


def remove_repeats(
    docs: DataFrame, window: int = WINDOW, *, columns: list[str] | None = None, untouched: bool = False
) -> DataFrame:
    """``columns`` of ``docs`` (all but ``text``), then ``n_words``, ``n_removed``, ``kept_text`` (words, one blank between).

    With ``untouched``, a text that loses nothing keeps its white space.
    """
    columns = [c for c in docs.columns if c != "text"] if columns is None else columns
    marks = (
        repeated_windows(docs, window)
        .groupBy("rid", "tag")
        .agg(F.collect_list(F.struct("start", "mask")).alias("marks"))
    )
    source = docs.select(
        *identity(), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)], F.col("text").alias("t")
    )
    joined = source.join(marks, ["rid", "tag"], "left").drop("rid", "tag")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                texts = batch.column(len(columns))
                n_words, n_removed, kept = _removed(texts, batch.column(len(columns) + 1), window)
                if untouched:
                    kept = pc.if_else(pa.array(n_removed == 0), texts, kept)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:-2], pa.array(n_words), pa.array(n_removed), kept],
                    names=[*batch.schema.names[:-2], "n", "gone", "kept"],
                )

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema.fields[: len(columns)]]
    schema = ", ".join([*fields, "n bigint", "gone bigint", "kept string"])
    return map_batches(joined, cut, schema).select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)],
        F.col("n").alias("n_words"),
        F.col("gone").alias("n_removed"),
        F.col("kept").alias("kept_text"),
    )
