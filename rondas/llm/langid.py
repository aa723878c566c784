"""Language identification with a byte convolutional network.

A window is ``WINDOW`` bytes of a text. Filters of several widths slide over its bytes, each keeps its largest
response, and a softmax layer turns those into probabilities of the languages. A text's windows
cover it from start to end; its language has the greatest mean log probability.

The network is trained in numpy on the driver, on a bounded sample of labelled texts of every language: about
``PER_LANGUAGE`` texts of each, or as many as make ``SAMPLE_TEXTS`` in all where languages are many, but one at least;
``WINDOWS_EACH`` windows of each text, all chosen by hashes of id and text. Predictions use the text alone.

A filter over bytes is a sum of table entries, one per byte under it. For prediction, entries
of neighbouring bytes are added beforehand, so that a window needs two look-ups per byte.

Defined results: ``und`` with score 0 for a null text or one without a letter; ties
go to the language first in alphabetical order; repeated rows get the same result each; a null ``doc_id``
is neither held out nor learned from; an empty table, or one without labels, gives ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rondas.llm import words as W
from rondas.llm.tables import map_batches
from rondas.sources.shared import write_out

WINDOW = 64
WIDTHS = (2, 3, 4)
FILTERS = 12  # of each width
PER_LANGUAGE = 600
SAMPLE_TEXTS = 38_400
WINDOWS_EACH = 8
EPOCHS = 6
BATCH = 128
#: Probabilities held at once when predicting: windows times languages.
HELD = 1 << 20
RATE = 0.01
SEED = 11


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the documents that nothing is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


class Network:
    """Tables [filter, place, byte] per width, a bias per filter, and a softmax layer."""

    def __init__(self, languages: list[str], seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.filters = [rng.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        hidden = FILTERS * len(WIDTHS)
        self.bias = np.zeros(hidden, dtype=np.float32)
        self.layer = rng.normal(0, 0.2, (hidden, len(languages))).astype(np.float32)
        self.offset = np.zeros(len(languages), dtype=np.float32)

    def responses(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest response of each filter in each window, and where it is."""
        padded = np.pad(windows, ((0, 0), (0, max(WIDTHS) - 1))).astype(np.intp)
        best, where = [], []
        for width, table in zip(WIDTHS, self.filters, strict=True):
            sums = sum(table[k][padded[:, k : k + windows.shape[1]]] for k in range(width))
            at = sums.argmax(axis=1)
            best.append(np.take_along_axis(sums, at[:, None, :], axis=1)[:, 0])
            where.append(at)
        return np.concatenate(best, axis=1) + self.bias, np.concatenate(where, axis=1)

    def probabilities(self, hidden: np.ndarray) -> np.ndarray:
        scores = np.maximum(hidden, 0) @ self.layer + self.offset
        scores -= scores.max(axis=1, keepdims=True)
        scores = np.exp(scores)
        return scores / scores.sum(axis=1, keepdims=True)

    def train(self, windows: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> None:
        """Adam over shuffled batches; only the bytes under a filter's largest response learn."""
        rng = np.random.default_rng(seed)
        weights = [*self.filters, self.bias, self.layer, self.offset]
        means, squares = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for lo in range(0, len(order), BATCH):
                some = order[lo : lo + BATCH]
                hidden, where = self.responses(windows[some])
                wrong = self.probabilities(hidden)
                wrong[np.arange(len(some)), labels[some]] -= 1
                wrong /= len(some)
                active = np.maximum(hidden, 0)
                back = (wrong @ self.layer.T) * (hidden > 0)
                gradients = []
                padded = np.pad(windows[some], ((0, 0), (0, max(WIDTHS) - 1))).astype(np.intp)
                for i, width in enumerate(WIDTHS):
                    part = slice(i * FILTERS, (i + 1) * FILTERS)
                    gradient = np.zeros_like(self.filters[i])
                    for k in range(width):
                        under = np.take_along_axis(padded, where[:, part] + k, axis=1)
                        np.add.at(gradient[k], (under, np.arange(FILTERS)[None, :]), back[:, part])
                    gradients.append(gradient)
                gradients += [back.sum(axis=0), active.T @ wrong, wrong.sum(axis=0)]
                step += 1
                for w, g, m, s in zip(weights, gradients, means, squares, strict=True):
                    m += 0.1 * (g - m)
                    s += 0.001 * (g * g - s)
                    w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)

    def pair_tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Sums of entries for bytes (0, 1) and (2, 3) under each filter, by pair of bytes; width 2 needs the first alone."""
        first = np.concatenate([(t[0][:, None] + t[1][None]).reshape(65536, -1) for t in self.filters], axis=1)
        second = np.concatenate(
            [
                (t[2][:, None] + (t[3][None] if len(t) > 3 else np.zeros((1, 256, 1), np.float32))).reshape(65536, -1)
                for t in self.filters[1:]
            ],
            axis=1,
        )
        return np.ascontiguousarray(first), np.ascontiguousarray(second)


def text_windows(block: W.Block) -> tuple[np.ndarray, np.ndarray]:
    """All windows of the texts of a block, the last of each filled up with zeros, and the first window of each text."""
    lengths = np.diff(block.offsets)
    counts = -(-lengths // WINDOW)
    first = np.append(0, np.cumsum(counts))
    flat = np.zeros(first[-1] * WINDOW, dtype=np.uint8)
    flat[np.arange(len(block.data)) + np.repeat(first[:-1] * WINDOW - block.offsets[:-1], lengths)] = block.data
    return flat.reshape(-1, WINDOW), first


class Predictor:
    def __init__(self, network: Network):
        self.network = network
        self.first, self.second = network.pair_tables()

    def hidden(self, windows: np.ndarray) -> np.ndarray:
        """As ``Network.responses``, from the tables of pairs."""
        out = np.empty((len(windows), len(self.network.bias)), dtype=np.float32)
        size = windows.shape[1]
        for lo in range(0, len(windows), 128):
            some = windows[lo : lo + 128]
            padded = np.pad(some, ((0, 0), (0, 3))).astype(np.intp)
            pairs = padded[:, :-1] * 256 + padded[:, 1:]
            sums = self.first.take(pairs[:, :size].reshape(-1), axis=0)
            sums[:, FILTERS:] += self.second.take(pairs[:, 2 : size + 2].reshape(-1), axis=0)
            out[lo : lo + 128] = sums.reshape(len(some), size, -1).max(axis=1)
        return out + self.network.bias

    def predict(self, block: W.Block) -> tuple[np.ndarray, np.ndarray]:
        """Language number and mean probability of each text (-1 and 0 for an empty one)."""
        windows, first = text_windows(block)
        counts = np.diff(first)
        owner = np.repeat(np.arange(len(counts)), counts)
        best, score = np.full(len(counts), -1), np.zeros(len(counts))
        names = len(self.network.languages)
        step = max(1, HELD // max(names, 1))
        open_text, open_sums = -1, np.zeros((2, names))  # a text that goes on in the next windows
        for lo in range(0, len(windows), step):
            sure = self.network.probabilities(self.hidden(windows[lo : lo + step])).astype(np.float64)
            some = owner[lo : lo + step]
            starts = np.flatnonzero(np.append(True, some[1:] != some[:-1]))
            logs, sums = np.add.reduceat(np.log(np.maximum(sure, 1e-9)), starts, axis=0), np.add.reduceat(sure, starts, axis=0)
            held = some[starts]
            if held[0] == open_text:
                logs[0] += open_sums[0]
                sums[0] += open_sums[1]
            open_text, open_sums = held[-1], np.stack([logs[-1], sums[-1]])
            # A text that goes on is named again when its last window is in.
            best[held] = (logs / counts[held, None]).argmax(axis=1)
            score[held] = np.clip(sums[np.arange(len(held)), best[held]] / counts[held], 0, 1)
        return best, score


def labelled_windows(docs: DataFrame, per_language: int, sample_texts: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, windows and their labels from a bounded sample of the documents that are not held out."""
    known = docs.filter("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").filter(
        F.crc32(F.col("doc_id").cast("string")) % 5 != 0
    )
    place_in = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    # One row per language, read at the driver and joined.
    counts = write_out(known.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"), F.min(place_in).alias("least")))
    languages = sorted(r.lang for r in counts.select("lang").collect())
    if not languages:
        return [], np.zeros((0, WINDOW), np.uint8), np.zeros(0, int)
    each = max(1, min(per_language, sample_texts // len(languages)))
    # The text of least hash is always in, so that no language is without one.
    share = F.greatest(F.col("least") + 1, F.least(F.lit(1.0), 1.2 * each / F.col("rows")) * (1 << 30))
    limits = counts.select(F.col("lang").alias("of"), share.alias("share"))
    chosen = known.select("lang", "doc_id", "text").join(limits, F.col("lang") == F.col("of")).filter(place_in < F.col("share"))
    place = "1 + pmod(xxhash64(doc_id, i), greatest(octet_length(text) - {0}, 1))".format(WINDOW - 1)
    windows = F.expr(f"transform(sequence(1, {WINDOWS_EACH}), i -> substring(encode(text, 'UTF-8'), CAST({place} AS INT), {WINDOW}))")
    # Rows with the same id and text share a hash: one of them is enough.
    rows = chosen.select("lang", windows.alias("w")).distinct().collect()
    number = {lang: i for i, lang in enumerate(languages)}
    data = [(bytes(w), number[r.lang]) for r in rows for w in r.w if w]
    flat = np.frombuffer(b"".join(w.ljust(WINDOW, b"\0") for w, _ in data), dtype=np.uint8).reshape(-1, WINDOW)
    return languages, flat, np.array([label for _, label in data], dtype=int)


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, sample_texts: int = SAMPLE_TEXTS) -> Network:
    languages, windows, labels = labelled_windows(docs, per_language, sample_texts)
    network = Network(languages)
    if len(windows):
        # Rows arrive in no fixed order; training starts from one.
        order = np.lexsort((*windows.T[::-1], labels))
        network.train(windows[order], labels[order])
    return network


def predict(docs: DataFrame, network: Network) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(network)  # some 300 KB, and 150 bytes per language

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Predictor(shared.value)
        names = np.array([*own.network.languages, "und"], dtype=object)
        for batch in batches:
            for block in W.blocks(batch.column(2)):
                letters = batch.column(1).slice(block.lo, block.hi - block.lo).to_numpy(zero_copy_only=False).astype(bool)
                if own.network.languages:
                    best, score = own.predict(block)
                else:
                    best, score = np.full(len(letters), -1), np.zeros(len(letters))
                best, score = np.where(letters, best, -1), np.where(letters & (best >= 0), score, 0.0)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(block.lo, block.hi - block.lo),
                        pa.array(names[best], pa.string()),
                        pa.array(score, pa.float64()),
                    ],
                    names=["doc_id", "lang_pred", "score"],
                )

    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), letter.alias("letter"), "text")
    found = map_batches(source, named, "doc_id bigint, lang_pred string, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def identify(docs: DataFrame) -> DataFrame:
    return predict(docs, fit(docs))
