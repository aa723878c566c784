"""Training texts that hold passages of a benchmark, by a broadcast hash set of the benchmark's word windows.

A window is ``n`` consecutive words of an item, or the whole item where it has fewer. The hash of every
window of every text is looked up in the set of the benchmark's hashes, and the words of a window
that is found are compared with the item's before it counts. DataFrame functions only.

The set is broadcast up to ``BROADCAST_BYTES``, which is measured first. Beyond that, hashes of windows and of
the benchmark are joined through a shuffle, and the words are compared after a join back with the texts.

Windows that the same items hold carry one name for that set of items, so a passage that stands in a
thousand items is not paired with each of them window by window.

Defined results: a null text has no words, like an empty one; it is never contaminated. Items without words
have no windows. An item without an id marks words, but is neither counted nor listed. Items that share an id count once.
Repeated rows of ``docs`` each get their row; rows with one id and different texts are told apart by their texts.
An empty benchmark leaves all texts clean, an empty table of texts gives an empty result. Very long texts are one array of words in
one task. Columns of ``docs`` other than ``doc_id`` and ``text`` may have any name: only ``remove_spans`` and
``remove_documents`` return them, as they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as Over

from rondas.llm.tables import identity
from rondas.sources.shared import write_out

WINDOW = 10
#: The hash set is broadcast while its words and names take at most so many bytes.
BROADCAST_BYTES = 64 << 20
#: What a window takes besides its words: hash, length, name of its items, table entry.
ROW_BYTES = 96

#: Fixed values.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words, whether or not A-Z became a-z.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"

TEXT = ["rid", "tag"]


def split(text: Column) -> Column:
    """Words as they are; null has none."""
    # Splitting is one pass, where extracting all matches copies the text for each of them.
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN + "+"), "")


def words(text: str) -> Column:
    return split(F.translate(text, UPPER, LOWER))


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` runs over it in a lambda.

    A plain column of an earlier select would be merged into the lambda and computed for every element.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _hashes(ws: Column) -> Column:
    return F.transform(ws, lambda w: F.xxhash64(w))


def _rolled(h: Column, n: int) -> Column:
    """Hashes of every ``n`` consecutive hashes of words."""
    return F.transform(_starts(F.size(h), n), lambda i: F.xxhash64(*[F.get(h, i + (j - 1)) for j in range(n)]))


def _starts(size: Column, n: int) -> Column:
    """Starts, from 1, of the windows of ``n`` words among ``size``."""
    return F.when(size >= n, F.sequence(F.lit(1), size - (n - 1))).otherwise(F.array().cast("array<int>"))


def item_windows(items: DataFrame, n: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(hash, n, gram, owners): every window of the benchmark once; (owners, item_id): the items of each set of owners."""
    ws = items.select("item_id", words("text").alias("ws")).withColumn("size", F.least(F.size("ws"), F.lit(n)))
    grams = _let(
        F.col("ws"),
        lambda w: F.transform(
            F.sequence(F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(1))),
            lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "),
        ),
    )
    held = (
        ws.select("item_id", "size", F.explode(F.when(F.col("size") > 0, grams)).alias("gram"))
        .groupBy("gram", "size")
        .agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
        .withColumn("owners", F.md5(F.array_join("items", ",")))
    )
    held = write_out(held)
    hashed = held.select(
        _let(_hashes(F.split("gram", " ")), lambda h: F.coalesce(*[F.get(_rolled(h, k), F.lit(0)) for k in range(n, 0, -1)])).alias("hash"),
        F.col("size").alias("n"),
        "gram",
        "owners",
    )
    sets = held.select("owners", F.explode("items").alias("item_id")).distinct()
    return hashed, sets


def hits(docs: DataFrame, items: DataFrame, n: int = WINDOW, *, broadcast_bytes: int = BROADCAST_BYTES) -> tuple[DataFrame, DataFrame]:
    """(rid, tag, start, n, owners): windows of the benchmark in each text, words from 1; and the items of the owners."""
    grams, sets = item_windows(items, n)
    # Two numbers: the bytes of the set, and which of the ``n`` possible lengths occur.
    found = grams.agg(
        F.sum(F.octet_length("gram") + ROW_BYTES).alias("bytes"), F.array_sort(F.collect_set("n")).alias("lengths")
    ).first()
    lengths = found["lengths"] or [n]

    def rolled(h: Column) -> Column:
        """Hashes of the windows of each length, one length after the other."""
        return F.concat(*[_rolled(h, k) for k in lengths])

    texts = docs.select(*identity(), words("text").alias("ws"))
    # Only numbers go with a window: all that needs the words is computed before the hashes are exploded.
    hashed = texts.select(*TEXT, F.size("ws").alias("size"), _let(_hashes(F.col("ws")), rolled).alias("hashes"))
    placed = hashed.select(*TEXT, "size", F.posexplode("hashes").alias("at", "hash"))
    # The windows of each length stand behind those of the lengths before it.
    start = reduce(
        lambda rest, k: F.when(
            F.col("n") == k,
            F.col("at") + 1 - sum((F.greatest(F.col("size") - (j - 1), F.lit(0)) for j in lengths if j < k), F.lit(0)),
        ).otherwise(rest),
        lengths,
        F.lit(None).cast("int"),
    )
    fits = (found["bytes"] or 0) <= broadcast_bytes
    small = F.broadcast if fits else (lambda df: df)
    candidates = write_out(
        placed.join(small(grams.select("hash", "n")), "hash")
        .withColumn("start", start)
        .filter(F.col("start").between(1, F.col("size") - F.col("n") + 1))
        .select(*TEXT, "start", "n", "hash")
        .distinct()
    )
    by_text = candidates.groupBy(*TEXT).agg(F.collect_list(F.struct("start", "n", "hash")).alias("candidates"))
    if candidates.count() * ROW_BYTES <= broadcast_bytes:
        by_text = F.broadcast(by_text)

    def read(ws: Column) -> Column:
        """The candidates with their words."""
        return F.transform(
            F.col("candidates"),
            lambda c: F.struct(
                c["start"].alias("start"), c["hash"].alias("hash"),
                F.array_join(F.slice(ws, c["start"], c["n"]), " ").alias("gram"),
            ),
        )

    seen = texts.join(by_text, TEXT).select(*TEXT, F.inline(_let(F.col("ws"), read)))
    verified = seen.join(small(grams), ["hash", "gram"]).select(*TEXT, "start", "n", "owners").distinct()
    return write_out(verified), sets


def spans(found: DataFrame) -> DataFrame:
    """(rid, tag, first, last): the hit words of each text as stretches that do not touch."""
    longest = found.groupBy(*TEXT, "start").agg(F.max("n").alias("n"))
    by_start = Over.partitionBy(*TEXT).orderBy("start")
    ends = longest.withColumn("last", F.col("start") + F.col("n") - 1)
    reached = F.max("last").over(by_start.rowsBetween(Over.unboundedPreceding, -1))
    opens = F.when(F.col("start") <= F.col("reached") + 1, 0).otherwise(1)
    return (
        ends.withColumn("reached", reached)
        .withColumn("stretch", F.sum(opens).over(by_start))
        .groupBy(*TEXT, "stretch")
        .agg(F.min("start").alias("first"), F.max("last").alias("last"))
        .drop("stretch")
    )


def judge(docs: DataFrame, items: DataFrame, n: int = WINDOW, **limits: int) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated, a row for each row of ``docs``."""
    found, sets = hits(docs, items, n, **limits)
    hit = spans(found).groupBy(*TEXT).agg(F.sum(F.col("last") - F.col("first") + 1).cast("long").alias("n_hit"))
    listed = (
        found.select(*TEXT, "owners").distinct().join(sets, "owners").groupBy(*TEXT)
        .agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    )
    digest = F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256)
    rows = docs.select("doc_id", *identity(), F.size(split(F.col("text"))).alias("n_words"))
    return (
        rows.join(hit, TEXT, "left")
        .join(listed, TEXT, "left")
        .select(
            "doc_id",
            F.col("n_words").cast("long").alias("n_words"),
            F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
            F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
            digest.alias("items_sha256"),
            F.col("n_hit").isNotNull().alias("contaminated"),
        )
    )


def _beside(docs: DataFrame, marks: DataFrame, how: str) -> DataFrame:
    """``docs`` as a struct ``doc``, so that its names cannot clash, joined with ``marks`` of its texts."""
    rows = docs.select(*identity(), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    return rows.join(marks, TEXT, how)


def remove_documents(docs: DataFrame, items: DataFrame, n: int = WINDOW, **limits: int) -> DataFrame:
    """``docs`` without those that hold a window."""
    found, _ = hits(docs, items, n, **limits)
    return _beside(docs, found.select(*TEXT).distinct(), "left_anti").select("doc.*")


def remove_spans(docs: DataFrame, items: DataFrame, n: int = WINDOW, **limits: int) -> DataFrame:
    """``docs`` without the words of windows and what follows each of them up to the next word; other texts stay as they are."""
    found, _ = hits(docs, items, n, **limits)
    cut = spans(found).groupBy(*TEXT).agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("cut"))
    rows = _beside(docs, cut, "left")
    text = F.col("doc.text")

    def kept(pieces: Column) -> Column:
        """What stands before the first word, and the words between one stretch and the next with what follows them."""
        lead = F.get(pieces, F.lit(0)).rlike(f"^{BETWEEN}").cast("int")
        parts = F.slice(pieces, lead + 1, F.size(pieces))

        def between(i: Column) -> Column:
            before = F.coalesce(F.get("cut", i - 1)["last"], F.lit(0))
            return F.slice(parts, before + 1, F.coalesce(F.get("cut", i)["first"] - 1, F.size(pieces) - lead) - before)

        return F.concat(F.slice(pieces, 1, lead), F.flatten(F.transform(F.sequence(F.lit(0), F.size("cut")), between)))

    # Only texts that lose words are split, before each word.
    pieces = F.split(text, f"(?<={BETWEEN})(?!{BETWEEN})")
    new = F.when(F.col("cut").isNotNull(), F.array_join(_let(pieces, kept), "")).otherwise(text)
    return rows.select(
        *[new.alias("text") if c == "text" else F.col(f"doc.`{c}`").alias(c) for c in docs.columns]
    )
