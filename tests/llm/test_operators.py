import hashlib
import itertools
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import plain as P
from compare import compare, connect
from rondas.llm import bpe, hosttrust, langid, licences, partenum, pivots, poisson, queries, recompression, repetition, sitequality
from rondas.llm import words as W
from rondas.llm.components import components
from rondas.llm.tables import identity


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    assert compare(queries.QUERIES[name](spark, sf_dir), connect(sf_dir), queries.ORACLES[name]) == ""


def test_powers_and_blocks_of_any_size():
    texts = ["ab cd", None, "", "x" * 50, " lead", "trail "]
    for limit in (1, 7, 1000):
        found = []
        for block in W.blocks(pa.array(texts), limit):
            split = W.split(block)
            assert len(W.powers(len(block.data))[0]) == len(block.data)
            found += [
                [bytes(block.data[s:e]).decode() for s, e in zip(split.starts[a:b], split.ends[a:b])]
                for a, b in zip(split.first, split.first[1:])
            ]
        assert found == [P.words(t) for t in texts]


def noisy(rng, vocabulary, length):
    return [rng.choice(vocabulary) for _ in range(length)]


# ---------------------------------------------------------------- repetition


def test_repetition_counts(spark):
    rng = random.Random(1)
    texts = [None, "", "a b", "  \n "]
    for _ in range(60):
        ws = noisy(rng, ["the", "of", "añb", "c#", "x|y", "end."], rng.randrange(1, 80))
        texts.append("".join(w + rng.choice([" ", "  ", "\n", "\t"]) for w in ws))
    got = {r.doc_id: r for r in repetition.judge(P.docs(spark, texts)).collect()}
    for i, text in enumerate(texts):
        ws, r = P.words(text), got[i]
        lines = [line for line in (text or "").split("\n") if P.words(line)]
        again = [line for k, line in enumerate(lines) if line in lines[:k]]
        assert (r.n_words, r.word_chars) == (len(ws), sum(map(len, ws)))
        assert r.n_symbols == sum((text or "").count(c) for c in "#*$%&|<>")
        assert (r.n_dup_lines, r.line_chars) == (len(again), sum(len("".join(P.words(x))) for x in again))
        assert r.n_repeat_words == len(P.covered(ws, 8))
        for n in repetition.GRAM_LIMITS:
            assert r[f"gram_{n}"] == sum(len(ws[j]) for j in P.covered(ws, n))
        assert r.base_failed == (len(ws) < 20 or 100 * r.n_repeat_words > 30 * len(ws))
        assert not (r.kept and r.base_failed)


# ------------------------------------------------------------- recompression


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_repeats_equal_brute_force(spark, seed):
    """Small vocabularies, runs, periods, copies inside a text and between texts, in several batches."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(rng.choice([2, 5, 60]))]
    passages = [noisy(rng, vocabulary, rng.randrange(30, 90)) for _ in range(5)]
    texts = [None, "", "single", " ".join(["run"] * 200), " ".join(["a", "b", "c"] * 40)]
    for _ in range(60):
        ws = noisy(rng, vocabulary, rng.randrange(0, 60))
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(ws) + 1)
            ws[at:at] = rng.choice(passages)[rng.randrange(10) :]
        texts.append(rng.choice([" ", "\n"]).join(ws))
    df = P.docs(spark, texts).repartition(5)
    got = {r.doc_id: r for r in recompression.remove_repeats(df, columns=["doc_id"]).collect()}
    for i, (text, kept) in enumerate(zip(texts, P.removed(texts, 35))):
        n = len(P.words(text))
        assert (got[i].n_words, got[i].n_removed, got[i].kept_text) == (n, n - len(kept), " ".join(kept))


def test_untouched_texts_keep_their_white_space(spark):
    texts = ["one\n two  three", " ".join(f"w{i}" for i in range(40)), " ".join(f"w{i}" for i in range(40)), None]
    got = {r.doc_id: r.kept_text for r in recompression.remove_repeats(P.docs(spark, texts), untouched=True).collect()}
    assert got == {0: texts[0], 1: "", 2: "", 3: None}


def test_symbol_borders_depend_on_near_words_only():
    rng = np.random.default_rng(5)
    middle = rng.integers(0, 3, 60)
    for _ in range(30):
        a = np.concatenate([rng.integers(0, 3, rng.integers(0, 30)), middle, rng.integers(0, 3, 20)]).astype(np.uint64)
        b = np.concatenate([rng.integers(0, 3, rng.integers(0, 30)), middle, rng.integers(0, 3, 5)]).astype(np.uint64)
        inside = []
        for x, tail in ((a, 20), (b, 5)):
            at = len(x) - tail - 60
            starts = recompression.symbol_starts(W.prefix_hashes(W.mix(x + np.uint64(1))), np.array([0, len(x)]))
            near = starts[(starts >= at + recompression.REACH) & (starts <= at + 60 - recompression.REACH)]
            inside.append((near - at).tolist())
        assert inside[0] == inside[1]


# ------------------------------------------------------------------ partenum


@pytest.mark.parametrize("n, percent", [(3, 90), (5, 80), (2, 60)])
def test_join_equals_brute_force(spark, n, percent):
    rng = random.Random(n)
    texts = [None, "", "One two", "one TWO", "one", " \n"]
    vocabulary = [f"w{i}" for i in range(400)]
    for size in (4, 9, 12, 20, 45, 60, 150, 400):
        for _ in range(3):
            base = noisy(rng, vocabulary, size)
            texts.append(" ".join(base))
            for _ in range(7):
                ws = list(base)
                for _ in range(rng.randrange(0, max(2, size // 12))):
                    at = rng.randrange(len(ws))
                    ws[at : at + 1] = rng.choice([[], [rng.choice(vocabulary)], [ws[at], rng.choice(vocabulary)]])
                texts.append(" ".join(ws))
    # A passage that many share, and a large group of which a few are far from the others.
    shared = noisy(rng, vocabulary, 50)
    texts += [" ".join(shared + noisy(rng, vocabulary, rng.randrange(3, 12))) for _ in range(40)]
    got = {r.doc_id: r for r in partenum.near_duplicates(P.docs(spark, texts).repartition(4), n=n, percent=percent).collect()}
    assert [got[i].n_shingles for i in range(len(texts))] == [len(P.shingles(t, n)) for t in texts]
    assert [got[i].component_id for i in range(len(texts))] == P.components(texts, n, percent)


def test_similar_sets_share_a_signature():
    """Whatever the sizes and wherever the differences are, at the threshold itself."""
    rng = random.Random(4)
    for percent in (80, 90):
        bands = partenum.Bands(percent)
        for _ in range(400):
            both = rng.randrange(1, 300)
            differing = (both * 100 // percent) - both
            left = rng.randrange(differing + 1)
            names = [f"e{rng.random()}" for _ in range(both + differing)]
            a, b = names[: both + left], names[:both] + names[both + left :]
            signs = []
            for words in (a, b):
                (block,) = W.blocks(pa.array([" ".join(words)]), 1 << 30)
                sets = partenum.Sets(block, 1)
                signs.append((sets.names[0], set(sets.signatures(bands, np.ones(1, dtype=bool))[0].tolist())))
            assert signs[0][0] == signs[1][0] or signs[0][1] & signs[1][1], (percent, both, left, differing)


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(60)]
    star = [(100, 101 + i) for i in range(40)]
    links = spark.createDataFrame([*chain, *[(b, a) for a, b in star], (7, 7)], "a long, b long")
    got = dict(P.rows(components(links)))
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 141)}
    assert components(links.limit(0)).count() == 0


# ----------------------------------------------------------------- licences


def test_phrases_and_labels(spark):
    notice = dict(licences.TEMPLATES[4:])["mit"]
    texts = [
        "Released under the MIT-License. mit license",
        "Licensed under CC BY-NC 4.0.",
        "some words first, then " + notice.replace("merge,", "merge and also") + " and more",
        "the apache of the license",
        None,
        "General Public\nLicense apache license",
    ]
    got = {r.doc_id: r for r in licences.scan(P.docs(spark, texts)).collect()}
    assert (got[0].n_words, got[0].n_base, got[0].first_word, got[0].last_word) == (7, 2, 3, 5)
    assert (got[0].base_labels, got[0].labels, got[0].score) == ("mit", "mit", 1.0)
    assert (got[1].base_labels, got[1].labels, got[1].score) == ("", "cc-by-nc", 1.0)
    assert got[2].base_labels == "" and got[2].labels == "mit" and got[2].score >= 0.7
    assert (got[3].labels, got[3].n_base, got[3].first_word) == ("", 0, None)
    assert (got[4].n_words, got[4].labels, got[4].score) == (0, "", 0.0)
    assert (got[5].base_labels, got[5].labels) == ("apache,gpl", "apache,gpl")


def test_diagonals_merge_and_far_pieces_do_not(spark):
    words = [f"t{i}" for i in range(30)]
    texts = [" ".join(words), " ".join(words[:15] + ["new"] + words[15:]), " ".join(words[:15] + ["x"] * 40 + words[15:])]
    spans = licences.license_spans(P.docs(spark, texts), [("own", " ".join(words))]).collect()
    by_tag = {}
    for s in spans:
        by_tag.setdefault(s.rid, []).append(s)
    assert [len(by_tag[i]) for i in range(3)] == [1, 1, 2]
    assert [by_tag[i][0].verified for i in range(2)] == [True, True] and not any(s.verified for s in by_tag[2])


# ------------------------------------------------------------------- pivots


def test_search_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(pivots, "BLOCK_ROWS", 64)
    monkeypatch.setattr(pivots, "CHUNK_QUERIES", 16)
    rng = np.random.default_rng(3)
    vectors = [[float(x) for x in rng.normal(size=8).round(2)] for _ in range(600)]
    rows = [(i, v) for i, v in enumerate(vectors)]
    rows += [(600 + i, vectors[50]) for i in range(300)]  # ties: a third of all rows are copies
    rows += [(2000, None), (2001, [None] * 8), (2002, [float("nan")] * 8), (None, vectors[0]), (50, vectors[50]), (2003, []), (2010, [1.0])]
    rows += [(2004, [float("inf")] + [0.0] * 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS cell", "2 AS gap", "3 AS vector")
    got = P.rows(pivots.largest_products(df, F.col("vec_id") % 50 == 0))
    whole = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            whole.append((i, np.array([int(np.floor(256 * float(np.float32(x)))) for x in v] + [0] * (8 - len(v)))))
    expected = []
    # Every row is a candidate, the repeated one of id 50 twice; it asks once.
    for q, asking in {i: v for i, v in whole if i % 50 == 0}.items():
        best = sorted((-int(asking @ v), i) for i, v in whole if i != q)[:5]
        expected += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(expected, key=repr)
    few = spark.createDataFrame([(0, [1.0]), (1, [0.5])], "vec_id long, embedding array<float>")
    assert P.rows(pivots.largest_products(few, F.col("vec_id") % 50 == 0)) == [(0, 1, 1, 256 * 128)]


def test_repeated_ids_equal_sql(spark, monkeypatch):
    """Ids that stand several times with different vectors, among rows and queries, against the query's own SQL."""
    monkeypatch.setattr(pivots, "BLOCK_ROWS", 64)
    monkeypatch.setattr(pivots, "CHUNK_QUERIES", 16)
    rng = np.random.default_rng(8)
    ids = [*range(300), *[7] * 40, *[50] * 30, 100, 100, *range(200, 260)]
    vectors = [rng.normal(size=8).astype(np.float32).tolist() for _ in ids]
    # Rows alike in id and vector: long ones that many queries find.
    ids += [9] * 4 + [11] * 9
    vectors += [[4.0] * 8] * 4 + [[-4.0] * 8] * 9
    given = pa.table({"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float32()))})
    sql = duckdb.connect()
    sql.register("embeddings", given)
    df = spark.createDataFrame(list(zip(ids, vectors)), "vec_id long, embedding array<float>")
    found = pivots.largest_products(df, F.col("vec_id") % 50 == 0)
    assert compare(found, sql, queries.ORACLES["op7_pivot_search"]) == ""


# ------------------------------------------------------------------- poisson


def test_counts_follow_the_rate(spark):
    texts = [f"text {i}" for i in range(3000)]
    df = P.docs(spark, texts, sources=["a" if i % 3 else "b" for i in range(3000)])
    rates = spark.createDataFrame([("a", 0.4), ("b", 40.0)], "source string, rate double")
    got = poisson.replicate(df, rates).groupBy("source", "doc_id").count().collect()
    a, b = ([r["count"] for r in got if r.source == s] for s in "ab")
    assert abs(sum(a) / 2000 - 0.4) < 0.06 and abs(sum(b) / 1000 - 40) < 1
    assert abs(np.var(b) - 40) < 8 and abs((2000 - len(a)) / 2000 - np.exp(-0.4)) < 0.04
    assert P.rows(poisson.replicate(df, rates)) == P.rows(poisson.replicate(df.repartition(3), rates))


def test_target_shares(spark):
    df = P.docs(spark, ["x" * 10] * 3000, sources=["a"] * 2400 + ["b"] * 600, ids=list(range(3000)))
    weights = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "source string, weight double")
    assert dict(P.rows(poisson.weight_rates(df, weights))) == {"a": 0.625, "b": 2.5}
    equal = dict(P.rows(poisson.temperature_rates(df, 0.0)))
    assert equal == {"a": 0.625, "b": 2.5}
    got = dict(P.rows(poisson.replicate(df, poisson.weight_rates(df, weights)).groupBy("source").count()))
    assert abs(got["a"] - 1500) < 120 and abs(got["b"] - 1500) < 120


# ---------------------------------------------------------------- host trust


def test_rules_and_parts(spark):
    urls = [
        "http://A.Example.COM/en/1?x#y", "https://www.example.com/en/", "http://example.com", "http://example.com/En/", "x.net/es/",
        "ftp://n.net/es/a://b", None, "http://h?q/es/", "http://net/fr/",
    ]
    df = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in hosttrust.judge_urls(df, queries.URL_RULES).collect()}
    assert got[0] == ("a.example.com", "/en/1", "example.com/en/", "block")
    assert got[1] == ("www.example.com", "/en/", "www.example.com/en/", "allow")
    assert got[2][:3] == ("example.com", "", None)
    assert got[3] == ("example.com", "/En/", "com/", "allow")
    assert got[4] == ("", "", None, "allow") and got[6] == ("", "", None, "allow")
    assert got[5] == ("n.net", "/es/a://b", "net/es/", "block")
    assert got[7][:3] == ("h", "", None) and got[8] == ("net", "/fr/", "net/fr/", "block")


def test_distrust_runs_back_over_links(spark):
    """Hosts that link to a blocked one are blocked, hosts that a trusted one links to are not."""
    link = '<a href="{}">'.format
    pages = [("http://bad.net/es/1", ""), ("http://good.com/a", link("http://fine.org/x"))]
    pages += [(f"http://farm.org/{i}", link("//BAD.net/es/1")) for i in range(3)] + [("http://fine.org/p", ""), ("http://far.org/p", "")]
    pages += [(f"http://other{i}.org/", "") for i in range(8)]
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string")
    got = {r.host: r for r in hosttrust.judge_urls(df, queries.URL_RULES).collect()}
    assert got["farm.org"].verdict == "block" and got["farm.org"].distrust > got["farm.org"].trust
    assert got["fine.org"].verdict == "allow" and got["fine.org"].trust > 0
    assert got["far.org"].verdict == "allow"


def test_trust_passes_a_domain_with_more_subdomains_than_units(spark):
    """300,000 other pages leave one seed 3,333 billionths; 2,000 subdomains get less than one each, and pass it on."""
    subs, others = 2000, 300_000
    rows = [("http://seed.com/", '<a href="//hot.org/">')] + [(f"http://s{i}.hot.org/", '<a href="//target.net/">') for i in range(subs)]
    few = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string")
    many = spark.range(others).selectExpr("id + 10000 AS page_id", "'http://big.com/' AS url", "CAST(NULL AS STRING) AS html")
    pages = few.unionByName(many)
    seeds = {"seed.com": 1 / (others + 1)}
    out = {"seed.com": {"hot.org": 1}, "hot.org": dict.fromkeys([f"s{i}.hot.org" for i in range(subs)], 1)}
    out |= {f"s{i}.hot.org": {"hot.org": 1, "target.net": 1} for i in range(subs)}
    rank = dict(seeds)
    for _ in range(hosttrust.ROUNDS):
        flow = {h: 0.15 * m for h, m in seeds.items()}
        for src, mass in rank.items():
            for dst, weight in out.get(src, {}).items():
                flow[dst] = flow.get(dst, 0) + 0.85 * mass * weight / sum(out[src].values())
        rank = flow
    target = spark.createDataFrame([(-1, "http://target.net/", None)], "page_id long, url string, html string")
    got = {r.host: r for r in hosttrust.judge_urls(pages.unionByName(target), queries.URL_RULES).filter("page_id < 10000").collect()}
    assert got["target.net"].trust == int(rank["target.net"] * 1e9) > 100
    assert got["seed.com"].trust == int(rank["seed.com"] * 1e9)


# --------------------------------------------------------------- language ID


def test_prediction_tables_equal_the_network():
    network = langid.Network(["a", "b"])
    windows = np.random.default_rng(1).integers(0, 256, (9, langid.WINDOW)).astype(np.uint8)
    assert np.allclose(langid.Predictor(network).hidden(windows), network.responses(windows)[0], atol=1e-5)


def test_held_out_accuracy(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.identify(df).join(df.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(found) > 100 and sum(r.lang == r.lang_pred for r in found) / len(found) >= 0.97
    assert all(0 <= r.score <= 1 for r in found)
    assert {r.held_out for r in langid.identify(df.filter("doc_id = 6")).collect()} == {True}


def test_every_language_is_learned(spark):
    """Seventy languages of an alphabet of their own each; the 65th and rarer ones are found as well."""
    letters = [[chr(0x4E00 + 64 * n + i) for i in range(8)] for n in range(70)]
    rng = random.Random(4)
    rows = [
        (d, "".join(rng.choice(letters[n]) for _ in range(200)), f"l{n:02}")
        for d, n in enumerate(n for n in range(70) for _ in range(40 if n < 64 else 24))
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = langid.identify(df).join(df.select("doc_id", "lang"), "doc_id").collect()
    assert {r.lang_pred for r in found} == {f"l{n:02}" for n in range(70)}
    rare = [r for r in found if r.lang >= "l64" and r.held_out]
    assert len(rare) > 10 and sum(r.lang == r.lang_pred for r in rare) / len(rare) >= 0.9


def test_sample_has_a_text_of_each_language(spark):
    rows = [(d, f"text {d} of it", f"l{d % 50}" if d < 2000 else f"rare{d}") for d in range(2030)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").cache()
    wanted = {r.lang for r in df.filter("crc32(CAST(doc_id AS STRING)) % 5 <> 0").select("lang").distinct().collect()}
    languages, windows, labels = langid.labelled_windows(df, 600, 160)
    assert set(languages) == wanted and set(labels) == set(range(len(languages)))
    assert len(windows) <= 2 * 160 * langid.WINDOWS_EACH


def test_prediction_in_parts(monkeypatch):
    network = langid.Network(["a", "b", "c"])
    block = next(iter(W.blocks(pa.array(["x" * 300, "", "yz" * 500, "w", None, "ab" * 64]))))
    whole = langid.Predictor(network).predict(block)
    monkeypatch.setattr(langid, "HELD", 6)
    parts = langid.Predictor(network).predict(block)
    assert list(whole[0]) == list(parts[0]) and np.allclose(whole[1], parts[1])


# -------------------------------------------------------------- site quality


def test_labels_are_recovered(spark):
    folder = "/root/testdata/sf0.1"
    df, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    known = labels.filter("doc_id % 4 <> 0")
    asked = labels.filter("doc_id % 4 = 0").withColumnsRenamed({"quality": "q", "toxic": "x"})
    got = sitequality.judge(df, known).join(asked, "doc_id").collect()
    assert sum((r.quality >= 0.5) == (r.q == 1) for r in got) / len(got) > 0.97
    assert sum(r.toxic >= 0.5 for r in got if r.x) / sum(r.x for r in got) > 0.8
    assert sum(r.toxic >= 0.5 for r in got if not r.x) <= 0.01 * len(got)
    assert all(r.kept == (r.quality >= 0.5 and r.toxic < 0.5) for r in got)


def test_sparse_sites_shrink(spark):
    """Posterior means equal (sum + prior * mean above) / (n + prior), and a small site stays near its host."""
    rows = [("h", f"p{p}", 2.0 if p % 2 else -2.0) for p in range(10) for _ in range(200)] + [("h", "tiny", 8.0), (None, None, 0.0)]
    scored = spark.createDataFrame(rows, "host string, path string, o0 double")
    got = {(r.host, r.path): r for r in sitequality.site_posteriors(scored, 1).collect()}
    assert len(got) == 12
    assert abs(got["h", "p1"].p0 - 0.88) < 0.03 and abs(got["h", "p2"].p0 - 0.12) < 0.03
    assert 0.5 <= got["h", "tiny"].p0 < 0.95


# ------------------------------------------------------------------------ BPE


@pytest.fixture(scope="module")
def tokenizer():
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    whole.no_truncation()
    whole.no_padding()

    def expected(text):
        ids = whole.encode(text, add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes(), whole.decode(ids, skip_special_tokens=False)

    return bpe.definition(path), expected


def test_encoding_equals_the_library(spark, tokenizer, sf_dir):
    definition, expected = tokenizer
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    texts += ["", "<|endoftext|>a<|startoftext|><|endoftext|>", "a<|endoftext|", "Don't I'LL we'Re", "İx ΑΣ ﬁ e\u0301 é", "a" * 3000,
              "ab" * 2000 + "é", "\0\x01\x1f\x85x\u2028y\u3000z", "123 ½ ² Ⅷ", "日本語テキスト 😀😀", "\u1e9e \ua7dd", "é" * 700]
    for lo in range(0, 0x30000, 32):
        texts.append(" ".join("a" + chr(c) + "b1" + chr(c) for c in range(lo, lo + 32) if not 0xD800 <= c < 0xE000))
    own = bpe.Encoder(definition)
    got = [r for some in bpe.together(pa.array(texts)) for r in own.encode(some)]
    bad = [t[:40] for t, g in zip(texts, got) if g != expected(t)]
    assert not bad
    assert all(own.decode(ids) == text for ids, text in got)
    assert own.certain_cut.any() and not own.certain_cut[ord("t"), ord("h")]


def test_encoded_rows(spark, tokenizer):
    definition, expected = tokenizer
    got = {r.doc_id: r for r in bpe.encode(P.docs(spark, ["Hello, world", None, ""]), definition).collect()}
    ids, text = expected("Hello, world")
    assert (bytes(got[0].ids), got[0].decoded, got[0].n_tokens) == (ids, text, len(ids) // 4)
    assert [(bytes(got[i].ids), got[i].decoded, got[i].n_tokens) for i in (1, 2)] == [(b"", "", 0)] * 2


# ------------------------------------------------------------------- odd rows


def every(spark, df):
    """Each operator over a table of documents."""
    pytest.importorskip("public_tokenizers")
    import public_tokenizers

    labels = df.selectExpr("doc_id", "CAST(doc_id % 2 AS INT) AS quality", "CAST(NULL AS INT) AS toxic", "1 AS text")
    pages = df.selectExpr("doc_id AS page_id", "source AS url", "text AS html", "1 AS host", "2 AS rule", "3 AS trust")
    vectors = df.selectExpr(
        "doc_id AS vec_id", "CASE WHEN lang = 'en' THEN array(1.0f, n_chars) WHEN lang = 'de' THEN array(CAST(NULL AS FLOAT)) END AS embedding", "1 AS cell"
    )
    return {
        "host trust": hosttrust.judge_urls(pages, queries.URL_RULES),
        "language": langid.identify(df),
        "repetition": repetition.judge(df),
        "site quality": sitequality.judge(df, labels),
        "near duplicates": partenum.near_duplicates(df),
        "licences": licences.scan(df),
        "pivots": pivots.largest_products(vectors, F.col("vec_id") % 2 == 0),
        "mix": poisson.replicate(df, poisson.temperature_rates(df)),
        "repeats": recompression.remove_repeats(df, columns=["doc_id"]),
        "tokens": bpe.encode(df, bpe.definition(public_tokenizers.path("word_bpe_49k.json")), columns=["doc_id"]),
    }


def test_texts_of_one_id_and_checksum_stay_apart(spark):
    """Two texts of one id with the same 32-bit checksum: neither stands for the other."""
    seen = {}
    for i in itertools.count():
        ws = " ".join(hashlib.md5(f"{i} {j}".encode()).hexdigest() for j in range(3))
        other = seen.setdefault(zlib.crc32(ws.encode()), ws)
        if other != ws:
            break
    assert zlib.crc32(ws.encode()) == zlib.crc32(other.encode())
    df = P.docs(spark, [ws, other], ids=[1, 1])
    assert {r.text for r in partenum.one_of_each(df, n=1).collect()} == {ws, other}
    tags = df.select(*identity()).collect()
    assert len(set(tags)) == 2 and len({r.rid for r in tags}) == 1


PER_ROW = ["host trust", "language", "repetition", "site quality", "near duplicates", "licences", "repeats", "tokens"]


def test_odd_rows(spark):
    df = P.odd(spark)
    found = {name: result.collect() for name, result in every(spark, df).items()}
    assert {name: len(found[name]) for name in PER_ROW} == dict.fromkeys(PER_ROW, df.count())
    near = {(r.doc_id, r.n_shingles, r.component_id) for r in found["near duplicates"]}
    # The repeated text has one component, its least id; what has no words stands alone.
    assert {c for d, n, c in near if d in (1, 2)} == {1} and (3, 0, 3) in near and (None, 0, None) in near
    assert sum(r.component_id == 1 for r in found["near duplicates"]) == 4
    lost = [r.n_removed for r in found["repeats"] if r.n_words == 51]
    assert lost == [51] * 4
    languages = {r.doc_id: r.lang_pred for r in found["language"]}
    assert languages[3] == languages[4] == languages[5] == languages[8] == "und" and languages[1] != "und"
    assert sum(r.doc_id == 1 for r in found["mix"]) % 2 == 0  # the repeated row is drawn twice alike


def test_empty_tables(spark):
    for name, result in every(spark, P.odd(spark).limit(0)).items():
        assert result.count() == 0, name
