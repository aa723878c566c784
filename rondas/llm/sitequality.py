"""Quality classes by hierarchical empirical Bayes: a document's own evidence, its host's and its path's.

Evidence of a document is a classifier's: logistic regressions, one per label, over the distinct words that stand in
enough of the labelled sample and over a few shares (symbols, capitals, digits, repeated words). They
are trained in numpy on the driver on a bounded sample of labelled rows (``SAMPLE``), with a penalty
on absolute weights that leaves few words, and applied to the whole text of every document.

The scores of all documents are then summed per path and per host (whole millionths, so the order of summing does not
matter). Each level's mean is shrunk toward the level above: toward the global mean at a host, toward the host's posterior
mean at a path. How many documents the prior is worth is estimated from the spread of the means between sites. A document's posterior odds are its own
odds times those of its path against the global ones, to the power ``SITE_WEIGHT``.

Here a host is a document's source, a path its language within it; both are arguments. Sums go through
partial aggregation, so a host with a third of all rows is no more work than others.

Defined results: a null host or path is a site of its own; null and empty texts have no evidence but that of their shares;
repeated rows get the same result each; a null ``doc_id`` has no label; labels that disagree for a document are
each an example; null labels are none; without any label of a kind all of its scores are 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rondas.llm import words as W
from rondas.llm.tables import map_batches
from rondas.sources.shared import write_out

#: Labelled documents that are learned from, at most about so many.
SAMPLE = 8000
#: A word is a feature if it stands in so many of the sample's texts, and among the most frequent ``VOCABULARY``.
LEAST_TEXTS = 4
VOCABULARY = 50_000
PENALTY = 3e-5
STEPS = 400
RATE = 0.05
SITE_WEIGHT = 0.25
MILLION = 1_000_000
SHARES = 6


@dataclass
class Evidence:
    """Words as sorted hashes, a weight per label for each, weights of the shares and constants."""

    words: np.ndarray
    weights: np.ndarray
    share_weights: np.ndarray
    constants: np.ndarray


def text_features(block: W.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of the texts (text, hash), and the shares of each text."""
    lower = W.Block(block.lo, block.hi, W.lowered(block.data), block.offsets)
    words = W.split(lower, W.PUNCTUATED)
    hashes, owner = W.word_hashes(lower.data, words), words.owner()
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    new = np.append(True, (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1]))[: len(owner)]
    distinct = np.bincount(owner[new], minlength=len(words.counts))
    size = np.maximum(np.diff(block.offsets), 1)
    d = block.data

    def share(flags: np.ndarray) -> np.ndarray:
        return W.per_text(flags, block.offsets) / size

    marks = W.separators(b"#*$%&|<>!")[d]
    shares = np.column_stack(
        [
            np.minimum(10 * share(marks), 3),
            2 * share((d >= 65) & (d <= 90)),
            4 * share((d >= 48) & (d <= 57)),
            1 - distinct / np.maximum(words.counts, 1),
            (words.counts < 20).astype(float),
            np.minimum(size / np.maximum(words.counts, 1), 20) / 10,
        ]
    )
    return owner[new], hashes[new], shares


def learn(texts: list[str], labels: np.ndarray) -> Evidence:
    """Logistic regressions for the columns of ``labels`` (nan: unknown), by proximal gradient steps."""
    kinds = labels.shape[1]
    parts = [(block.lo, *text_features(block)) for block in W.blocks(pa.array(texts, pa.string()))]
    of = np.concatenate([lo + o for lo, o, _, _ in parts])
    hashes = np.concatenate([h for _, _, h, _ in parts])
    shares = np.concatenate([s for *_, s in parts])
    found, number, counts = np.unique(hashes, return_inverse=True, return_counts=True)
    frequent = np.flatnonzero(counts >= LEAST_TEXTS)
    frequent = np.sort(frequent[np.lexsort((found[frequent], -counts[frequent]))[:VOCABULARY]])
    place = np.full(len(found), -1)
    place[frequent] = np.arange(len(frequent))
    column = place[number]
    of, column = of[column >= 0], column[column >= 0]
    weights = np.zeros((len(frequent), kinds))
    share_weights, constants = np.zeros((SHARES, kinds)), np.zeros(kinds)
    for kind in range(kinds):
        known = ~np.isnan(labels[:, kind])
        if not known.any():
            continue
        wanted, here = np.where(known, labels[:, kind], 0), known[of]
        rows, columns = of[here], column[here]
        n = known.sum()
        # Adam on the smooth part, then the penalty as a step toward zero.
        w, b = np.zeros(len(frequent) + SHARES + 1), 0.0
        m, s = np.zeros_like(w), np.zeros_like(w)
        for step in range(1, STEPS + 1):
            odds = np.bincount(rows, weights=w[columns], minlength=len(texts)) + shares @ w[len(frequent) : -1] + w[-1]
            wrong = np.where(known, 1 / (1 + np.exp(-np.clip(odds, -30, 30))) - wanted, 0) / n
            g = np.concatenate(
                [np.bincount(columns, weights=wrong[rows], minlength=len(frequent)), shares.T @ wrong, [wrong.sum()]]
            )
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            rate = RATE / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)
            w -= rate * m / (1 - 0.9**step)
            words = w[: len(frequent)]
            w[: len(frequent)] = np.sign(words) * np.maximum(np.abs(words) - rate[: len(frequent)] * PENALTY, 0)
        weights[:, kind], share_weights[:, kind], constants[kind] = w[: len(frequent)], w[len(frequent) : -1], w[-1]
    used = np.abs(weights).max(axis=1, initial=0) > 0
    return Evidence(found[frequent][used], weights[used], share_weights, constants)


def block_odds(evidence: Evidence, block: W.Block) -> np.ndarray:
    """Log odds of each label for each text."""
    of, hashes, shares = text_features(block)
    texts = len(block.offsets) - 1
    odds = shares @ evidence.share_weights + evidence.constants
    if len(evidence.words):
        at = np.minimum(np.searchsorted(evidence.words, hashes), len(evidence.words) - 1)
        hit = evidence.words[at] == hashes
        for kind in range(odds.shape[1]):
            odds[:, kind] += np.bincount(of[hit], weights=evidence.weights[at[hit], kind], minlength=texts)
    return np.clip(odds, -30, 30)


def labelled_sample(docs: DataFrame, labels: DataFrame, kinds: list[str], size: int) -> tuple[list[str], np.ndarray]:
    """Texts and labels of about ``size`` labelled documents, chosen by a hash of the id."""
    total = labels.filter("doc_id IS NOT NULL").count()
    part = min(1.0, size / max(total, 1))
    chosen = labels.filter("doc_id IS NOT NULL").filter(
        F.pmod(F.xxhash64("doc_id", F.lit("label")), F.lit(1 << 30)) < F.lit(part * (1 << 30))
    )
    chosen = chosen.select("doc_id", *[F.col(k).cast("double").alias(f"y{i}") for i, k in enumerate(kinds)])
    texts = docs.filter("text IS NOT NULL").select("doc_id", "text")
    rows = chosen.join(texts, "doc_id").orderBy("doc_id", "text", *[f"y{i}" for i in range(len(kinds))]).limit(2 * size).collect()
    values = [[np.nan if r[f"y{i}"] is None else r[f"y{i}"] for i in range(len(kinds))] for r in rows]
    return [r.text for r in rows], np.array(values, dtype=float).reshape(len(rows), len(kinds))


def evidence_of(docs: DataFrame, evidence: Evidence, kinds: list[str], host: str, path: str) -> DataFrame:
    """(doc_id, host, path, <kind>...): each label's odds for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(evidence)  # VOCABULARY rows at most

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in W.blocks(batch.column(3)):
                odds = block_odds(shared.value, block)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[c.slice(block.lo, block.hi - block.lo) for c in batch.columns[:3]],
                        *[pa.array(np.ascontiguousarray(odds[:, i])) for i in range(len(kinds))],
                    ],
                    names=["doc_id", "host", "path", *[f"o{i}" for i in range(len(kinds))]],
                )

    source = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col(f"`{host}`").cast("string").alias("host"),
        F.col(f"`{path}`").cast("string").alias("path"),
        "text",
    )
    schema = "doc_id bigint, host string, path string, " + ", ".join(f"o{i} double" for i in range(len(kinds)))
    return map_batches(source, weighed, schema)


def worth(sites: DataFrame, total: str, n: str, parent: str) -> float:
    """How many documents a prior is worth, by the method of moments over sites: within-site over between-site variance.

    One row comes to the driver.
    """
    mean, size = f"({total} / {n} / {MILLION})", n
    inner = f"{parent} * (1 - {parent})"
    row = sites.agg(
        F.expr(f"sum({size} * pow({mean} - {parent}, 2))").alias("spread"),
        F.expr(f"sum({inner})").alias("noise"),
        F.expr(f"sum({size} * {inner})").alias("inner"),
        F.sum(size).alias("n"),
        F.count(F.lit(1)).alias("sites"),
    ).first()
    if not row.sites or not row.n:
        return 1.0
    between = max((row.spread - row.noise) / row.n, 1e-6)
    return min(max(row.inner / row.n / between, 1.0), 1e6)


def _logit(p: str) -> str:
    return f"ln(greatest({p}, 1e-6) / greatest(1 - {p}, 1e-6))"


def site_posteriors(scored: DataFrame, kinds: int) -> DataFrame:
    """(host, path, g<i>, p<i>): global mean and posterior mean of each label at every path."""
    sums = [F.sum(F.round(MILLION / (1 + F.exp(-F.col(f"o{i}")))).cast("long")).alias(f"t{i}") for i in range(kinds)]
    paths = write_out(scored.groupBy("host", "path").agg(*sums, F.count(F.lit(1)).alias("n")))
    hosts = paths.groupBy("host").agg(*[F.sum(f"t{i}").alias(f"ht{i}") for i in range(kinds)], F.sum("n").alias("hn"))
    hosts = write_out(hosts)
    hosts = hosts.withColumns(
        {f"g{i}": hosts.agg(F.sum(f"ht{i}") / F.sum("hn") / MILLION).scalar() for i in range(kinds)}
    )
    at_host = [worth(hosts, f"ht{i}", "hn", f"g{i}") for i in range(kinds)]
    hosts = hosts.selectExpr(
        "host", *[f"g{i}" for i in range(kinds)],
        *[f"(ht{i} / {MILLION} + {at_host[i]!r}D * g{i}) / (hn + {at_host[i]!r}D) AS h{i}" for i in range(kinds)],
    )
    paths = paths.join(hosts.withColumnRenamed("host", "_host"), F.col("host").eqNullSafe(F.col("_host")))
    at_path = [worth(paths, f"t{i}", "n", f"h{i}") for i in range(kinds)]
    return paths.selectExpr(
        "host", "path", *[f"g{i}" for i in range(kinds)],
        *[f"(t{i} / {MILLION} + {at_path[i]!r}D * h{i}) / (n + {at_path[i]!r}D) AS p{i}" for i in range(kinds)],
    )


def judge(
    docs: DataFrame, labels: DataFrame, *, good: str = "quality", bad: str = "toxic", host: str = "source", path: str = "lang",
    sample: int = SAMPLE,
) -> DataFrame:
    """(doc_id, <good>, <bad>, <good>_site, <bad>_site, kept) of every document: posteriors, and kept if good and not bad."""
    kinds = [good, bad]
    texts, known = labelled_sample(docs, labels, kinds, sample)
    evidence = learn(texts, known) if texts else Evidence(np.zeros(0, np.uint64), np.zeros((0, 2)), np.zeros((SHARES, 2)), np.zeros(2))
    scored = write_out(evidence_of(docs, evidence, kinds, host, path))
    sites = site_posteriors(scored, len(kinds)).withColumnsRenamed({"host": "_host", "path": "_path"})
    joined = scored.join(sites, F.col("host").eqNullSafe(F.col("_host")) & F.col("path").eqNullSafe(F.col("_path")))
    posterior = [f"1 / (1 + exp(-(o{i} + {SITE_WEIGHT} * ({_logit(f'p{i}')} - {_logit(f'g{i}')}))))" for i in range(2)]
    return joined.selectExpr(
        "doc_id", *[f"{posterior[i]} AS `{k}`" for i, k in enumerate(kinds)], *[f"p{i} AS `{k}_site`" for i, k in enumerate(kinds)]
    ).withColumn("kept", (F.col(good) >= 0.5) & (F.col(bad) < 0.5))
