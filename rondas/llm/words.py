"""Words of whole texts as numpy arrays, a bounded block of texts at a time.

A block holds whole texts up to ``BLOCK_BYTES``; a longer text is a block of its
own. Hashes are polynomials modulo 2**64, so the hash of any span is a difference of
prefix sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 19
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))

BLANKS = bytes([0x20, *range(0x09, 0x0E)])
#: What separates words of letters and digits, as in ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``
#: after A-Z became a-z.
PUNCTUATION = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (one-to-one)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def separators(listed: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(listed)] = True
    return table


BLANK = separators(BLANKS)
PUNCTUATED = separators(PUNCTUATION)

_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n; grown as needed, as long as the longest block so far."""
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]))
        for k, base in enumerate((BASE, INVERSE)):
            grown = np.full(size, base, dtype=np.uint64)
            grown[0] = 1
            _powers[k] = np.multiply.accumulate(grown)
    return _powers[0][:n], _powers[1][:n]


def prefix_hashes(values: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``span_hashes`` reads the hash of any span of ``values``."""
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers(len(values))[0], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return (prefix[ends] - prefix[starts]) * powers(len(prefix))[1][starts]


@dataclass
class Block:
    """Texts ``lo`` to ``hi`` of a batch: their bytes and where each one starts (one more entry than texts)."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray


def blocks(texts: pa.Array | pa.ChunkedArray, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Whole texts in blocks of at most ``limit`` bytes or one text; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offset_buffer, data_buffer = texts.buffers()
    offsets = np.frombuffer(offset_buffer, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data_buffer, dtype=np.uint8) if data_buffer else np.zeros(0, dtype=np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        hi = min(hi, len(texts))
        yield Block(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


@dataclass
class Words:
    """Byte spans of the words of a block, and the first word of each text (one more entry than texts)."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """The text that each word stands in."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def split(block: Block, separator: np.ndarray = BLANK) -> Words:
    """Words between separators; a text's end also ends its last word."""
    inside = ~separator[block.data]
    edge = np.zeros(len(inside) + 1, dtype=bool)
    edge[block.offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    stops = inside
    stops[:-1] = inside[:-1] & (~inside[1:] | edge[1:-1])
    starts = np.flatnonzero(begins)
    return Words(starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, block.offsets))


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z as a-z."""
    return data + ((data - np.uint8(65)) < 26) * np.uint8(32)


def word_hashes(data: np.ndarray, words: Words) -> np.ndarray:
    """One 64-bit hash per word of ``data``, its length included."""
    hashes = span_hashes(prefix_hashes(data.astype(np.uint64)), words.starts, words.ends)
    return mix(hashes + (words.ends - words.starts).astype(np.uint64))


def gram_hashes(prefix: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every ``n`` consecutive values behind ``prefix``, whatever text they belong to."""
    at = np.arange(max(0, len(prefix) - n))
    return span_hashes(prefix, at, at + n)


def gram_starts(words: Words, n: int) -> np.ndarray:
    """Starts of the spans of ``n`` words that lie inside one text."""
    counts = np.maximum(words.counts - n + 1, 0)
    before = np.cumsum(counts) - counts
    return np.arange(counts.sum()) + np.repeat(words.first[:-1] - before, counts)


def repeated(keys: np.ndarray) -> np.ndarray:
    """True where a key occurs more than once."""
    ordered = np.sort(keys)
    same = ordered[1:] == ordered[:-1]
    out = np.zeros(len(keys), dtype=bool)
    if same.any():
        order = np.argsort(keys)
        out[order[1:][same]] = True
        out[order[:-1][same]] = True
    return out


def covered(n_words: int, starts: np.ndarray, length: int) -> np.ndarray:
    """True for words inside a span of ``length`` words that begins at one of ``starts``."""
    if not len(starts):
        return np.zeros(n_words, dtype=bool)
    steps = np.bincount(starts, minlength=n_words + 1) - np.bincount(starts + length, minlength=n_words + 1)
    return np.cumsum(steps[:-1]) > 0


def per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over each text's stretch."""
    sums = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]
