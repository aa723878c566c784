"""Quality rules by repetition coverage.

Every text is cut into words ``[^\\x20\\x09-\\x0D]+``. Rolling hashes of n-grams of
several lengths find the n-grams that occur more than once in the text; the share
of its word characters inside them, and inside repeated lines, is its coverage.

Defined results: a null or empty text has no words, all counts 0, and is rejected
(fewer than ``min_words``). Rows are judged one by one, so repeated rows and rows
with a null or repeated ``doc_id`` each get their own result. Other columns are
left out of the result of ``judge`` and kept by ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rondas.llm import words as W
from rondas.llm.tables import map_batches

#: Percent of word characters allowed inside repeated n-grams, by n.
GRAM_LIMITS = {5: 30, 7: 30, 10: 30}
#: Percent of word characters allowed in lines equal to an earlier line.
LINE_LIMIT = 30
MIN_WORDS = 20
WINDOW = 8
WINDOW_LIMIT = 30
SYMBOLS = W.separators(b"#*$%&|<>")

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "line_chars"]


def _lines(block: W.Block, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and owner of the lines, and a hash of each."""
    breaks = np.flatnonzero(block.data == 10)
    starts = np.union1d(breaks + 1, block.offsets[:-1])
    starts = starts[starts < len(block.data)]
    ends = np.append(starts[1:], len(block.data))[: len(starts)]
    # A line that ends in a break, not at its text's end, stops before it.
    ends = ends - (block.data[ends - 1] == 10)
    ends = np.maximum(ends, starts)
    owner = np.searchsorted(block.offsets, starts, side="right") - 1
    hashes = W.mix(W.span_hashes(prefix, starts, ends) + (ends - starts).astype(np.uint64))
    return starts, ends, owner, hashes


def measure(block: W.Block, gram_lengths: list[int], window: int = WINDOW) -> dict[str, np.ndarray]:
    """Counts of each text of a block; ``gram_<n>`` is the word characters inside repeated n-grams."""
    words = W.split(block)
    prefix = W.prefix_hashes(block.data.astype(np.uint64))
    hashes = W.mix(W.span_hashes(prefix, words.starts, words.ends) + (words.ends - words.starts).astype(np.uint64))
    points = np.zeros(len(block.data) + 1, dtype=np.int64)
    np.cumsum((block.data & 0xC0) != 0x80, out=points[1:])
    lengths = points[words.ends] - points[words.starts]
    salt = W.mix(np.arange(1, len(block.offsets), dtype=np.uint64))
    out = {
        "n_words": words.counts,
        "word_chars": W.per_text(lengths, words.first),
        "n_symbols": W.per_text(SYMBOLS[block.data], block.offsets),
    }

    starts, ends, owner, keys = _lines(block, prefix)
    blank = np.zeros(len(words.starts) + 1, dtype=np.int64)
    np.cumsum(lengths, out=blank[1:])
    chars = blank[np.searchsorted(words.starts, ends)] - blank[np.searchsorted(words.starts, starts)]
    full = chars > 0
    owner, chars = owner[full], chars[full]
    keys = keys[full] ^ salt[owner]
    order = np.argsort(keys, kind="stable")
    again = np.zeros(len(keys), dtype=bool)
    again[order[1:]] = keys[order[1:]] == keys[order[:-1]]
    texts = len(block.offsets) - 1
    out["n_dup_lines"] = np.bincount(owner[again], minlength=texts)
    out["line_chars"] = np.bincount(owner[again], weights=chars[again], minlength=texts).astype(np.int64)

    grams = W.prefix_hashes(hashes)
    text_of = words.owner()
    for n in sorted({*gram_lengths, window}):
        at = W.gram_starts(words, n)
        twice = at[W.repeated(W.mix(W.span_hashes(grams, at, at + n)) ^ salt[text_of[at]])]
        inside = W.covered(len(words.starts), twice, n)
        out[f"gram_{n}"] = W.per_text(lengths * inside, words.first)
        if n == window:
            out["n_repeat_words"] = W.per_text(inside, words.first)
    return out


def judge(
    docs: DataFrame,
    *,
    gram_limits: dict[int, int] | None = None,
    line_limit: int = LINE_LIMIT,
    min_words: int = MIN_WORDS,
    window_limit: int = WINDOW_LIMIT,
    keep_columns: list[str] | None = None,
) -> DataFrame:
    """Counts of every text, ``base_failed`` and ``kept``, after the ``keep_columns`` (``doc_id``)."""
    gram_limits = GRAM_LIMITS if gram_limits is None else gram_limits
    carried = ["doc_id"] if keep_columns is None else keep_columns
    grams = sorted(gram_limits)
    names = [*MEASURES, *[f"gram_{n}" for n in grams]]
    source = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carried)], F.col("text").alias("t"))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [measure(block, grams) for block in W.blocks(batch.column(batch.num_columns - 1))]
            arrays = [pa.array(np.concatenate([p[n] for p in parts]).astype(np.int64)) for n in names] if parts else []
            if parts:
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:-1], *arrays], names=[*batch.schema.names[:-1], *[f"m_{n}" for n in names]]
                )

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]]
    counted = map_batches(source, measured, ", ".join([*fields, *[f"m_{n} bigint" for n in names]]))
    failed = (F.col("m_n_words") < min_words) | (
        100 * F.col("m_n_repeat_words") > window_limit * F.col("m_n_words")
    )
    covered = 100 * F.col("m_line_chars") > line_limit * F.col("m_word_chars")
    for n, limit in gram_limits.items():
        covered = covered | (100 * F.col(f"m_gram_{n}") > limit * F.col("m_word_chars"))
    return counted.select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(carried)],
        *[F.col(f"m_{n}").alias(n) for n in names],
        failed.alias("base_failed"),
        (~failed & ~covered).alias("kept"),
    )


def keep(docs: DataFrame, **limits) -> DataFrame:
    """The rows of ``docs``, all their columns, whose text the rules keep."""
    columns = docs.columns
    judged = judge(
        docs.select(*[F.col(f"`{c}`").alias(f"d{i}") for i, c in enumerate(columns)], "text"),
        keep_columns=[f"d{i}" for i in range(len(columns))],
        **limits,
    )
    return judged.filter("kept").select(*[F.col(f"d{i}").alias(c) for i, c in enumerate(columns)])
