"""The operators in plain Python, for small tables, and tables with odd rows."""

import hashlib
import re

BLANKS = "[^\x20\x09-\x0d]+"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text, lower=False):
    text = text or ""
    if lower:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return re.findall(BLANKS, text)


def docs(spark, texts, langs=None, sources=None, ids=None):
    n = len(texts)
    rows = zip(ids or range(n), texts, langs or ["en"] * n, sources or ["s"] * n, [len(t or "") for t in texts])
    return spark.createDataFrame(list(rows), DOCS)


#: Names that operators use inside.
CLASHING = ["rid", "tag", "node", "n_words", "kept", "ids", "copy", "parts", "sums", "name", "place", "c0", "d0", "t", "mask",
            "start", "key", "host", "path", "rule", "least", "row", "first", "source_", "marks", "sign", "copies"]


def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and columns with clashing names."""
    long = " ".join(f"word{i % 9973}" for i in range(60_000))
    same = "one and the same text of a few words that stands in the table more than once " * 3
    rows = [
        (1, same, "en", "a", 9), (1, same, "en", "a", 9), (2, same, "en", None, 9), (None, same, None, "a", None),
        (3, None, "en", "a", 0), (None, None, None, None, None), (4, "", "en", "b", 0), (5, " \n\t ", "en", "b", 4),
        (6, long, "de", "b", len(long)), (7, "x" * 300_000, "de", "b", 300_000), (8, "123 !? 456", None, "c", 10),
        (None, "", None, None, None), (9, "\u0000 \u00e9\u0301 \U0001f600 \u65e5\u672c\u8a9e", "fr", "c", 8),
    ]
    df = spark.createDataFrame(rows, DOCS)
    for i, name in enumerate(CLASHING):
        df = df.selectExpr("*", f"{i} AS `{name}`")
    return df


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns or df.columns).collect()), key=repr)


# ------------------------------------------------------------------ operators


def covered(ws, n):
    at = {}
    for i in range(len(ws) - n + 1):
        at.setdefault(tuple(ws[i : i + n]), []).append(i)
    return {j for places in at.values() if len(places) > 1 for i in places for j in range(i, i + n)}


def removed(texts, window):
    """Kept words of each text."""
    split = [words(t) for t in texts]
    count = {}
    for ws in split:
        for i in range(len(ws) - window + 1):
            key = tuple(ws[i : i + window])
            count[key] = count.get(key, 0) + 1
    out = []
    for ws in split:
        gone = {
            j for i in range(len(ws) - window + 1) if count[tuple(ws[i : i + window])] > 1 for j in range(i, i + window)
        }
        out.append([w for j, w in enumerate(ws) if j not in gone])
    return out


def shingles(text, n):
    ws = words(text, lower=True)
    if len(ws) < n:
        return frozenset([tuple(ws)]) if ws else frozenset()
    return frozenset(tuple(ws[i : i + n]) for i in range(len(ws) - n + 1))


def components(texts, n, percent):
    """Least number of the texts reachable by links."""
    sets = [shingles(t, n) for t in texts]
    name = list(range(len(texts)))

    def root(i):
        while name[i] != i:
            i = name[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((root(i), root(j)))
                name[y] = x
    return [root(i) for i in range(len(texts))]


def sha(data):
    return hashlib.sha256(data).hexdigest()
