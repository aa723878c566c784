"""Search, decontamination and the manifest against plain Python."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import plain as P
from rondas.llm import decontamination, merkle, queries, search

BREAKS = "[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+"


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(BREAKS, text or "")]


def corpus(seed, n_docs=120, n_items=12):
    """Texts of a skewed vocabulary that hold passages of items, and the items."""
    rng = random.Random(seed)
    vocabulary = [f"W{i}ä" if i % 7 == 0 else f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    gaps = [" ", ", ", "\n", "--", "\x7f"]

    def prose(n):
        return rng.choices(vocabulary, weights, k=n)

    items = [prose(rng.choice([3, 9, 10, 11, 25, 40])) for _ in range(n_items)]
    items[1] = items[0] + prose(15)
    texts = []
    for _ in range(n_docs):
        ws = prose(rng.randrange(0, 90))
        if rng.random() < 0.4:
            part = rng.choice(items)
            at = rng.randrange(len(ws) + 1)
            ws[at:at] = part[rng.randrange(3) :]
        texts.append(rng.choice(["", " .", "¿"]) + "".join(w + rng.choice(gaps) for w in ws))
    texts += [texts[5], texts[5], None, "", "?!"]
    return texts, [" ".join(x) for x in items] + [None, "", " . "]


def benchmark(spark, items, ids=None):
    rows = list(zip(ids or range(100, 100 + len(items)), items, strict=True))
    return spark.createDataFrame(rows, "item_id long, text string")


# --------------------------------------------------------------------- search


def best(texts, ids, items, item_ids):
    held = [terms(t) for t in texts]
    n_docs, total = sum(bool(h) for h in held), sum(map(len, held))
    df = {}
    for h in held:
        for t in set(h):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, name in zip(items, item_ids, strict=True):
        rows = []
        for h, i in zip(held, ids, strict=True):
            score = 0
            for t in set(terms(item)) & set(h):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                tf, m = h.count(t), 100 - 90 + (90 * len(h) * n_docs) // total
                score += w * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
            if score > 0:
                rows.append((-score, i is None, i or 0, i))
        rows.sort()
        out += [(name, r + 1, i, -s) for r, (s, _, _, i) in enumerate(rows[:10])]
    return sorted(out, key=repr)


def test_search_equals_all_scores(spark):
    texts, items = corpus(1)
    ids = [None if i % 29 == 0 else i // 2 for i in range(len(texts))]
    names = list(range(len(items)))
    names[2] = names[3]
    asked = benchmark(spark, items, names)
    got = P.rows(search.search(P.docs(spark, texts, ids=ids), asked))
    assert got == best(texts, ids, items, names)


def test_search_in_several_bundles_and_small_blocks(spark, monkeypatch):
    texts, items = corpus(3, n_docs=60)
    monkeypatch.setattr(search, "BLOCK_DOCS", 7)
    monkeypatch.setattr(search, "CELLS", 20)
    asked = benchmark(spark, items)
    assert search.bundles(asked, 40)[1] > 2
    got = P.rows(search.search(P.docs(spark, texts), asked, bundle_terms=40))
    assert got == best(texts, range(len(texts)), items, range(100, 100 + len(items)))


def test_accumulators_are_dropped_by_exact_bounds():
    owner = search.Owner(
        terms=np.array([4]), first=np.array([0, 2]), items=np.array([0, 1]), weights=np.array([10]),
        tenth=np.array([100, 31]), ahead=np.array([40, 35]), after=np.array([10, 5]),
    )
    carried = np.array([(0, 0, 85), (0, 1, 70), (1, 2, 26)], dtype=search.ENTRY)
    held = np.array([(4, 0, 2), (4, 1, 1), (4, 3, 3), (9, 3, 7)], dtype=search.POSTING)
    got = search.add(owner, carried, held, 4).tolist()
    # Item 0 opens nothing new and loses what cannot reach 100; item 1 opens document 3; ties with the tenth stay.
    assert got == [(0, 0, 105), (1, 2, 26), (1, 3, 30)]


# -------------------------------------------------------------- decontamination


def contaminated(texts, ids, items, item_ids, n=10):
    grams = {}
    for item, name in zip(items, item_ids, strict=True):
        ws = terms(item)
        for i in range(max(1, len(ws) - n + 1) if ws else 0):
            grams.setdefault(tuple(ws[i : i + n]), set()).add(name)
    out, kept = [], []
    for text, i in zip(texts, ids, strict=True):
        ws = terms(text)
        hit, names = set(), set()
        for k in {len(g) for g in grams}:
            for at in range(len(ws) - k + 1):
                if tuple(ws[at : at + k]) in grams:
                    hit |= set(range(at, at + k))
                    names |= grams[tuple(ws[at : at + k])]
        listed = sorted(str(x) for x in names if x is not None)
        out.append((i, len(ws), len(hit), len(listed), P.sha(",".join(listed).encode()), bool(hit)))
        pieces = re.findall(f"{BREAKS}[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]*", text or "")
        lead = re.match("[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]*", text or "")[0]
        kept.append(text if not hit else lead + "".join(p for j, p in enumerate(pieces) if j not in hit))
    return sorted(out, key=repr), kept


@pytest.mark.parametrize("limit", [decontamination.BROADCAST_BYTES, 0])
def test_decontamination_equals_plain_python(spark, limit):
    texts, items = corpus(4)
    names = [None if i == 4 else i % 9 for i in range(len(items))]
    docs, asked = P.docs(spark, texts), benchmark(spark, items, names)
    expected, kept = contaminated(texts, range(len(texts)), items, names)
    assert sum(row[-1] for row in expected) > 20
    assert P.rows(decontamination.judge(docs, asked, broadcast_bytes=limit)) == expected
    cut = {r.doc_id: r.text for r in decontamination.remove_spans(docs, asked, broadcast_bytes=limit).collect()}
    assert cut == dict(enumerate(kept))
    clean = {r.doc_id for r in decontamination.remove_documents(docs, asked, broadcast_bytes=limit).collect()}
    assert clean == {row[0] for row in expected if not row[-1]}


def test_a_passage_of_all_items_is_named_once(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    asked = benchmark(spark, [passage] * 50 + [passage + " more"])
    grams, sets = decontamination.item_windows(asked)
    assert grams.select("owners").distinct().count() == 2 and sets.count() == 52


def test_texts_of_a_word_only_and_long_texts(spark):
    asked = benchmark(spark, ["one", "a b c d e f g h i j"])
    long = "one x " * 30_000 + "a b c d e f g h i j " * 20_000
    got = decontamination.judge(P.docs(spark, [long, "x", "One"]), asked).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_hit, r.n_items) for r in got] == [(260_000, 230_000, 2), (1, 0, 0), (1, 1, 1)]


def test_native_plan(spark):
    texts, items = corpus(5, n_docs=8)
    docs, asked = P.docs(spark, texts), benchmark(spark, items)
    for df in (decontamination.judge(docs, asked), decontamination.remove_spans(docs, asked), decontamination.remove_documents(docs, asked)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


# --------------------------------------------------------------------- manifest


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return digest(*["-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in merkle.FIELDS])


def climb(digests, at):
    """Root of a list, and the siblings of place ``at`` level by level, left and right."""
    path = []
    while len(digests) > 1:
        run = at // 3 * 3
        path.append((digests[run:at], digests[at + 1 : run + 3]))
        digests = [digest(*digests[i : i + 3]) for i in range(0, len(digests), 3)]
        at //= 3
    return digests[0], path


def plain_manifest(rows):
    first = lambda x: (x is not None, x if x is not None else 0)
    sources = sorted({r["source"] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: sorted((r for r in rows if r["source"] == s), key=lambda r: (first(r["doc_id"]), leaf(r))) for s in sources}
    subroots = [climb([leaf(r) for r in trees[s]], 0)[0] for s in sources]
    out = []
    for k, s in enumerate(sources):
        root, upper = climb(subroots, k)
        for at, r in enumerate(trees[s]):
            _, path = climb([leaf(x) for x in trees[s]], at)
            path = path + upper
            even = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0
            acc = leaf({**r, "text": r["text"] and r["text"].replace("\n", "")} if even else r)
            for left, right in path:
                acc = digest(*left, acc, *right)
            out.append(
                (r["doc_id"], leaf(r), subroots[k], root, digest(*[x for a, b in path for x in a + b]), acc, acc == root)
            )
    return sorted(out, key=repr)


@pytest.mark.parametrize(("n", "levels"), [(1, 6), (4, 1), (28, 2), (82, 1), (200, 6)])
def test_manifest_equals_plain_python(spark, n, levels):
    rng = random.Random(n)
    rows = [
        {
            "doc_id": rng.choice([None, i, i // 2]), "source": rng.choice(["hot"] * 6 + ["a", "B", "é", "", None]),
            "lang": rng.choice([None, "en"]), "n_chars": rng.choice([None, 3, -1]),
            "text": rng.choice([None, "", "one\ntwo", "três", "x"]),
        }
        for i in range(n)
    ]
    rows += [rows[0], rows[0]]
    docs = spark.createDataFrame([tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in rows], P.DOCS)
    got = merkle.manifest(docs.repartition(3), levels=levels)
    assert P.rows(got) == plain_manifest(rows)


def test_stream_extends_witnesses_as_siblings_complete():
    stream = merkle.Stream(2)
    names = [hashlib.sha256(bytes([i])).digest() for i in range(4)]
    for name in names[:2]:
        stream.append(name)
    assert stream.witnesses == [[], []]  # the run is open
    stream.append(names[2])
    assert stream.witnesses[0] == [(b"", names[1] + names[2])]  # its own run is complete, the one above is not
    stream.append(names[3])
    root = stream.close(whole=True)
    assert [len(w) for w in stream.witnesses] == [2, 2, 2, 2] and stream.witnesses[3][0] == (b"", b"")
    assert root.hex() == climb([x.hex() for x in names], 0)[0]


# --------------------------------------------------------------------- odd tables


def every(spark, df):
    asked = benchmark(spark, ["one and the same text of a few words that stands in the table", "word1 word2", None, ""])
    asked = asked.withColumns({c: F.lit(1) for c in P.CLASHING})
    return {
        "search": search.search(df, asked),
        "judge": decontamination.judge(df, asked),
        "spans": decontamination.remove_spans(df, asked),
        "documents": decontamination.remove_documents(df, asked),
        "manifest": merkle.manifest(df),
    }


def test_odd_rows(spark):
    df = P.odd(spark)
    found = {name: result.collect() for name, result in every(spark, df).items()}
    for name in ("judge", "spans", "manifest"):
        assert len(found[name]) == df.count(), name
    assert {r.doc_id for r in found["judge"] if r.contaminated} == {1, 2, None, 6}
    assert len(found["documents"]) == df.count() - 5
    assert {r.item_id for r in found["search"]} == {100, 101}
    assert all(r.verified for r in found["manifest"] if r.doc_id is None)
    assert [c for c in P.CLASHING if c not in decontamination.remove_spans(df, benchmark(spark, ["x"])).columns] == []


def test_empty_tables(spark):
    for name, result in every(spark, P.odd(spark).limit(0)).items():
        assert result.count() == 0, name
    docs, nothing = P.docs(spark, ["a b", None]), benchmark(spark, ["x"]).limit(0)
    assert search.search(docs, nothing).count() == 0
    assert {r.contaminated for r in decontamination.judge(docs, nothing).collect()} == {False}


def test_registered():
    assert {"op11_pipelined_search", "op12_decontamination", "op13_merkle_manifest"} <= set(queries.ORACLES)
