"""Byte-pair encoding by forced-boundary splitting, and decoding.

A merge joins two neighbours into a token of the vocabulary. A pair of
neighbouring bytes that stands inside no token can therefore never end up in one
token: between two such bytes there is a certain cut. Pieces of text are cut there,
the fragments are encoded on their own (each distinct one once per task while it
is remembered) and their ids are put together in order.

Defined results: a null text counts as empty and gives no tokens and an empty
decoded text. Rows are encoded one by one, so repeated rows and null or repeated
``doc_id`` need no care; columns of other names are kept. Texts may be of any length:
fragments are merged with a heap, in n log n steps.
"""

from __future__ import annotations

import functools
import heapq
import json
import unicodedata
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rondas.llm.tables import map_batches

#: Distinct chunks and pieces a worker remembers; forgotten all at once beyond that.
REMEMBERED = 200_000
#: Fragments up to so many bytes are merged side by side in arrays, longer ones alone with a heap.
SHORT = 64
#: Texts are encoded together up to so many characters, or one text.
TOGETHER = 1 << 20


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if printable, else the next unused one from U+0100."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class Encoder:
    """A tokenizer file of kind BPE with a pattern split and byte letters, as its library would apply it."""

    def __init__(self, definition: str):
        import regex
        from tokenizers import Regex, Tokenizer
        from tokenizers.pre_tokenizers import Split

        spec = json.loads(definition)
        model = spec["model"]
        first, *rest = spec["pre_tokenizer"]["pretokenizers"]
        if (
            model["type"] != "BPE"
            or model["dropout"]
            or model["continuing_subword_prefix"]
            or first["type"] != "Split"
            or (first["behavior"], first["invert"]) != ("Removed", True)
            or [(p["type"], p["add_prefix_space"], p["use_regex"]) for p in rest] != [("ByteLevel", False, False)]
            or spec["decoder"]
            or spec["post_processor"]
            or any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"])
        ):
            raise ValueError("not a BPE tokenizer of the kind that is supported")
        steps = [(n["type"], n.get("pattern"), n.get("content")) for n in spec["normalizer"]["normalizers"]]
        if steps != [("NFC", None, None), ("Replace", {"Regex": "\\s+"}, " "), ("Lowercase", None, None)]:
            raise ValueError("not a normalizer that is supported")
        whole = Tokenizer.from_str(definition)
        self.normalizer = whole.normalizer
        self.splitter = Split(Regex(first["pattern"]["Regex"]), "removed", invert=True)
        self.pattern = regex.compile(first["pattern"]["Regex"])
        self.letters = byte_letters()
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocabulary = model["vocab"]
        self.tokens = dict((i, t) for t, i in self.vocabulary.items())
        self.ranks = {}
        for rank, merge in enumerate(model["merges"]):
            self.ranks.setdefault(tuple(merge if isinstance(merge, list) else merge.split(" ")), rank)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens.update({i: t for t, i in self.special.items()})
        self.special_pattern = None
        if self.special:
            longest_first = sorted(self.special, key=len, reverse=True)
            self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")")
        self.certain_cut = self.certain_cuts()
        self.byte_ids = np.array([self.vocabulary[c] for c in self.letters])
        self.last_ids = np.array([self.vocabulary[c + self.suffix] for c in self.letters])
        size = len(self.tokens)
        keys = np.array([self.vocabulary[a] * size + self.vocabulary[b] for a, b in self.ranks])
        order = np.argsort(keys)
        self.pair_keys = keys[order]
        self.pair_ranks = np.array(list(self.ranks.values()))[order]
        self.by_rank = np.zeros(max(self.ranks.values(), default=0) + 1, dtype=np.int64)
        for (left, right), rank in self.ranks.items():
            self.by_rank[rank] = self.vocabulary[left + right]
        self.pieces: dict[str, tuple[bytes, str]] = {}
        self.chunks: dict[str, tuple[bytes, str]] = {}

    def certain_cuts(self) -> np.ndarray:
        """True at [a, b] where byte b never follows byte a inside a token."""
        number = {c: i for i, c in enumerate(self.letters)}
        cut = np.ones((256, 256), dtype=bool)
        for token in self.vocabulary:
            body = [number[c] for c in token.removesuffix(self.suffix)]
            cut[body[:-1], body[1:]] = False
        return cut

    def merged_ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in a row, and where each piece's begin (one more entry than pieces)."""
        encoded = [p.encode("utf-8") for p in pieces]
        data = np.frombuffer(b"".join(encoded), dtype=np.uint8)
        ends = np.cumsum([len(e) for e in encoded])
        piece = np.repeat(np.arange(len(pieces)), np.diff(ends, prepend=0))
        symbols = self.byte_ids[data]
        symbols[ends - 1] = self.last_ids[data[ends - 1]]
        begins = np.append(True, self.certain_cut[data[:-1], data[1:]] | (piece[1:] != piece[:-1]))
        starts = np.flatnonzero(begins)
        lengths = np.diff(np.append(starts, len(data)))
        fragment = np.repeat(np.arange(len(starts)), lengths)
        long = lengths > SHORT
        done = [np.flatnonzero(lengths == 1)]
        results = [(symbols[starts[done[0]]], piece[starts[done[0]]], starts[done[0]])]
        for f in np.flatnonzero(long).tolist():
            at = starts[f]
            ids = self.merge_long([self.tokens[i] for i in symbols[at : at + lengths[f]].tolist()])
            results.append((np.array(ids), np.full(len(ids), piece[at]), at + np.arange(len(ids))))
        results += self.merge_short(symbols, fragment, piece, ~long & (lengths > 1))
        ids, of, at = (np.concatenate(r) for r in zip(*results, strict=True))
        order = np.argsort(at, kind="stable")
        return ids[order], np.searchsorted(of[order], np.arange(len(pieces) + 1))

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left * len(self.tokens) + right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], len(self.by_rank))

    def merge_short(self, symbols, fragment, piece, chosen) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Merges in all chosen fragments at once: each round takes the pair of lowest rank, the leftmost of equals."""
        keep = np.flatnonzero(chosen[fragment])
        symbols, fragment, piece, place = symbols[keep], fragment[keep], piece[keep], keep
        none = len(self.by_rank)
        results = []
        # rank[i] is that of symbols i and i + 1.
        rank = np.full(len(symbols), none)
        if len(symbols):
            inner = np.flatnonzero(fragment[1:] == fragment[:-1])
            rank[inner] = self.pair_rank(symbols[inner], symbols[inner + 1])
        while len(symbols):
            new = np.append(True, fragment[1:] != fragment[:-1])
            starts = np.flatnonzero(new)
            lowest = np.minimum.reduceat(rank, starts)
            size = np.diff(np.append(starts, len(symbols)))
            over = np.repeat(lowest == none, size)
            if over.any():
                results.append((symbols[over], piece[over], place[over]))
                left = ~over
                symbols, fragment, piece, place, rank = symbols[left], fragment[left], piece[left], place[left], rank[left]
                if not len(symbols):
                    break
                size, lowest = size[lowest != none], lowest[lowest != none]
            at = np.flatnonzero(rank == np.repeat(lowest, size))
            at = at[np.append(True, fragment[at[1:]] != fragment[at[:-1]])]
            symbols[at] = self.by_rank[rank[at]]
            left = np.ones(len(symbols), dtype=bool)
            left[at + 1] = False
            moved = at - np.arange(len(at))
            symbols, fragment, piece, place, rank = symbols[left], fragment[left], piece[left], place[left], rank[left]
            for i in (moved, moved - 1):
                i = i[(i >= 0) & (i < len(symbols))]
                paired = np.zeros(len(i), dtype=bool)
                inside = i + 1 < len(symbols)
                paired[inside] = fragment[i[inside] + 1] == fragment[i[inside]]
                rank[i] = none
                rank[i[paired]] = self.pair_rank(symbols[i[paired]], symbols[i[paired] + 1])
        return results

    def merge_long(self, parts: list[str | None]) -> list[int]:
        n, ranks = len(parts), self.ranks
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(ranks[p], i, p) for i, p in enumerate(zip(parts, parts[1:])) if p in ranks]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if parts[i] != pair[0] or j < 0 or parts[j] != pair[1]:
                continue
            parts[i], parts[j] = pair[0] + pair[1], None
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if (p := (parts[i], parts[k])) in ranks:
                    heapq.heappush(heap, (ranks[p], i, p))
            if (h := before[i]) >= 0 and (p := (parts[h], parts[i])) in ranks:
                heapq.heappush(heap, (ranks[p], h, p))
        return [self.vocabulary[p] for p in parts if p is not None]

    def learn_pieces(self, pieces: set[str]) -> None:
        """Remember ids (little-endian, 32 bits each) and decoded text of pieces of the pattern."""
        new = list(pieces - self.pieces.keys())
        if new:
            ids, starts = self.merged_ids(new)
            flat, names = ids.astype("<u4").tobytes(), [self.tokens[i] for i in ids.tolist()]
            starts = starts.tolist()
            for piece, a, b in zip(new, starts, starts[1:]):
                self.pieces[piece] = flat[4 * a : 4 * b], " ".join(names[a:b])

    def learn_chunks(self, chunks: set[str]) -> None:
        """Remember the same of chunks: stretches without white space."""
        new = chunks - self.chunks.keys()
        split = {c: [c] if c.isalpha() else self.pattern.findall(c) for c in new}
        self.learn_pieces({p for pieces in split.values() for p in pieces})
        for chunk, pieces in split.items():
            found = [self.pieces[p] for p in pieces]
            self.chunks[chunk] = b"".join([ids for ids, _ in found]), " ".join([text for _, text in found])

    def stretch(self, text: str) -> tuple[list[str], bool]:
        """What a stretch of text without special tokens falls into, and whether that is chunks (else pieces).

        White space separates, so the chunks between it can be encoded alone.
        """
        text = text.replace("\n", " ")
        # In printable text the only white space is the blank, and only the sigma's small form depends on its place.
        if text.isprintable() and "\u03a3" not in text:
            return (text.lower() if text.isascii() else unicodedata.normalize("NFC", text).lower()).split(), True
        normal = self.normalizer.normalize_str(text)
        if any(unicodedata.category(c) == "Cn" for c in set(normal)):  # letters newer than the library's tables
            return [piece for piece, _ in self.splitter.pre_tokenize_str(normal)], False
        return self.pattern.findall(normal), False

    def encode(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """Ids and decoded text of each whole text."""
        if len(self.chunks) + len(self.pieces) > REMEMBERED:
            self.chunks.clear()
            self.pieces.clear()
        stretches = []
        for text in texts:
            parts = self.special_pattern.split(text) if self.special_pattern and "<" in text else [text]
            stretches.append([(p, None) if p in self.special else self.stretch(p) for p in parts])
        self.learn_chunks({c for parts in stretches for found, kind in parts if kind for c in found})
        self.learn_pieces({p for parts in stretches for found, kind in parts if kind is False for p in found})
        out = []
        for parts in stretches:
            found = []
            for items, kind in parts:
                if kind is None:
                    found.append((np.array([self.special[items]], dtype="<u4").tobytes(), items))
                else:
                    known = self.chunks if kind else self.pieces
                    found += [known[i] for i in items]
            out.append((b"".join([ids for ids, _ in found]), " ".join([text for ids, text in found if ids])))
        return out

    def decode(self, ids: bytes) -> str:
        return " ".join([self.tokens[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])


@functools.lru_cache(maxsize=2)
def encoder(definition: str) -> Encoder:
    """One encoder for all tasks of a worker process."""
    return Encoder(definition)


def definition(path: str) -> str:
    """A tokenizer file, read on the driver; tasks get its text (a few MB, fixed) with the query."""
    return Path(path).read_text(encoding="utf-8")


def together(texts: pa.Array) -> Iterator[list[str]]:
    """Texts in lists of bounded length; a null is an empty text."""
    some, size = [], 0
    for text in texts:
        some.append(text.as_py() or "")
        size += len(some[-1])
        if size >= TOGETHER:
            yield some
            some, size = [], 0
    if some:
        yield some


def encode(docs: DataFrame, tokenizer: str, *, columns: list[str] | None = None) -> DataFrame:
    """``columns`` of ``docs`` (all but ``text``), then ``n_tokens``, ``ids`` (32-bit little-endian) and ``decoded``."""
    columns = [c for c in docs.columns if c != "text"] if columns is None else columns
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)
    source = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)], F.col("text").alias("t"))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(shared.value)
        for batch in batches:
            found = [r for texts in together(batch.column(batch.num_columns - 1)) for r in own.encode(texts)]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:-1],
                    pa.array([len(ids) // 4 for ids, _ in found], pa.int64()),
                    pa.array([ids for ids, _ in found], pa.binary()),
                    pa.array([text for _, text in found], pa.string()),
                ],
                names=[*batch.schema.names[:-1], "m_n", "m_ids", "m_decoded"],
            )

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]]
    schema = ", ".join([*fields, "m_n bigint", "m_ids binary", "m_decoded string"])
    return map_batches(source, encoded, schema).select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)],
        F.col("m_n").alias("n_tokens"),
        F.col("m_ids").alias("ids"),
        F.col("m_decoded").alias("decoded"),
    )
