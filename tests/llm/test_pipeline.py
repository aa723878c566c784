"""Every stage against plain Python, each on the input it gets."""

import random

import numpy as np
import pytest

import corpus_pipeline as C
import plain as P
from rondas.llm import poisson, repetition


def corpus(spark):
    rng = random.Random(8)
    vocabulary = [f"wort{i}" for i in range(700)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    texts = []
    for _ in range(80):
        ws = [rng.choice(vocabulary) for _ in range(rng.randrange(25, 150))]
        texts.append(" ".join(ws))
        if rng.random() < 0.3:
            texts.append(" ".join(ws))
        if rng.random() < 0.4:
            texts.append(" ".join(ws[:-1] + ["anders"]))
        if rng.random() < 0.3:
            texts.append(" ".join(ws[:30] + passage + ws[30:]))
    texts += ["zu kurz", "", None, "immer dasselbe Wort " * 40, "zeile eins zwei drei\n" * 12]
    return P.docs(spark, texts, sources=[rng.choice("aab") for _ in texts])


@pytest.fixture(scope="module")
def steps(spark):
    pytest.importorskip("public_tokenizers")
    docs, out = corpus(spark), []
    for _, stage in C.STAGES:
        result = stage(spark, docs, "").collect()
        out.append((docs.collect(), result))
        docs = spark.createDataFrame(result, docs.schema) if stage is not C.STAGES[-1][1] else None
    return out


def test_columns(steps):
    for docs, result in steps[:-1]:
        assert result[0].__fields__ == C.COLUMNS
    assert steps[-1][1][0].__fields__ == ["doc_id", "lang", "source", "n_tokens", "ids"]


def test_quality_rules(spark, steps):
    docs, result = steps[0]

    def kept(text):
        ws = P.words(text)
        chars = sum(map(len, ws))
        lines = [x for x in (text or "").split("\n") if P.words(x)]
        again = sum(len("".join(P.words(x))) for k, x in enumerate(lines) if x in lines[:k])
        bad = [100 * sum(len(ws[j]) for j in P.covered(ws, n)) > limit * chars for n, limit in repetition.GRAM_LIMITS.items()]
        return not (len(ws) < 20 or 100 * len(P.covered(ws, 8)) > 30 * len(ws) or 100 * again > 30 * chars or any(bad))

    assert sorted(map(tuple, result)) == sorted(tuple(d) for d in docs if kept(d.text))
    assert len(result) < len(docs)


def test_near_duplicates(steps):
    docs, result = steps[1]
    docs = sorted(docs, key=lambda d: d.doc_id)
    names = P.components([d.text for d in docs], 5, 80)
    assert sorted(map(tuple, result)) == [tuple(d) for i, d in enumerate(docs) if names[i] == i]
    assert len(result) < len(docs)


def test_repeated_passages(steps):
    docs, result = steps[2]
    got = {r.doc_id: r for r in result}
    changed = 0
    for d, kept in zip(docs, P.removed([d.text for d in docs], 35)):
        whole = len(kept) == len(P.words(d.text))
        changed += not whole
        expected = d.text if whole else " ".join(kept)
        assert (got[d.doc_id].text, got[d.doc_id].n_chars) == (expected, len(expected))
    assert changed and len(result) == len(docs)


def test_source_mix(steps):
    import hashlib
    import math

    docs, result = steps[3]
    size = {}
    for d in docs:
        size[d.source] = size.get(d.source, 0) + len(d.text)
    parts = sum(v**poisson.TEMPERATURE for v in size.values())
    expected = []
    for d in docs:
        rate = sum(size.values()) * size[d.source] ** poisson.TEMPERATURE / parts / size[d.source]
        digest = hashlib.md5(d.text.encode()).hexdigest()
        u = int(hashlib.md5(f"{poisson.SEED}|{d.doc_id}|{digest}|1".encode()).hexdigest()[:12], 16) / 2**48
        n, p = 0, math.exp(-rate)
        total = p
        while total <= u:
            n += 1
            p *= rate / n
            total += p
        expected += [tuple(d)] * n
    assert sorted(map(tuple, result)) == sorted(expected)


def test_tokens(steps):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs, result = steps[4]
    expected = [
        (d.doc_id, np.array(whole.encode(d.text, add_special_tokens=False).ids, dtype="<u4").tobytes()) for d in docs
    ]
    assert sorted((r.doc_id, bytes(r.ids)) for r in result) == sorted(expected)


def test_odd_rows_and_empty_tables_pass_through(spark):
    for docs in (P.odd(spark), P.odd(spark).limit(0)):
        for name, stage in C.STAGES:
            result = stage(spark, docs, "")
            assert result.count() >= 0, name
            if name != C.STAGES[-1][0]:
                assert result.columns == C.COLUMNS
    # Each stage alone on the odd rows: what has no words is linked with nothing and stays.
    kept = C.near_duplicates(spark, P.odd(spark), "").collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [1, 3, 4, 5, 6, 7, 8, 9]
    assert sum(r.doc_id is None for r in kept) == 2
