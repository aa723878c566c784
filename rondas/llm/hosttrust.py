"""URL filters: listed rules, and for the rest trust and distrust spread over the links between hosts.

Host edges come from the links of the pages (``href`` with a host of its own) and
from the tree of domains (a host and the domain above it, both ways). Trust starts
at hosts whose pages the rules allow and follows edges; distrust starts at hosts whose
pages they block and follows edges backwards. Both are personalised PageRank, in
whole numbers, so that the order of summing cannot change a score. A host is blocked
when its distrust exceeds its trust and is ``BLOCK_FACTOR`` times the mean of all hosts or more.

Each step rounds down, so the whole is as many units as the graph needs: ``SCALE`` where that is ``SPARE`` times the
pages at seeds times the links, ``FINE_SCALE`` in every larger graph. Scores are compared in these units; the columns
``trust`` and ``distrust`` give them in whole billionths, rounded down.

DataFrame functions only. Edges are counted per pair of hosts before they are joined,
contributions are summed before they are shuffled, and ranks are written to the
shared folder every few rounds.

Defined results: a null url, or one without ``://``, has empty host and path, fits no rule and
is allowed. Each row is judged on its own, repeated or not, ``page_id`` null or not. A null ``html``
has no links. Empty tables give no rows; other columns are left out.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rondas.sources.shared import write_out

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"^(?s:.*?)://([^/?#]*)([^?#]*)"
LINK = r"""(?i)href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""

#: Whole-number scale of the scores of small graphs, and of those in the result; they add up to at most this.
SCALE = 1_000_000_000
#: Scale for all other graphs; a score times 100 fits DECIMAL(38, 0), and no product of two scores is made.
FINE_SCALE = 10**30
SPARE = 1000
WHOLE = "decimal(38, 0)"
DAMPING = 85
ROUNDS = 10
WRITE_EVERY = 5
BLOCK_FACTOR = 2

Rule = tuple[str, str]


def small_letters(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host in small letters, and path; both empty where there is no ``://``."""
    url = F.coalesce(url, F.lit(""))
    return small_letters(F.regexp_extract(url, URL, 1)), F.regexp_extract(url, URL, 2)


def fitting_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls where none does. ``rules``: (host and path, verdict)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, action in sorted(rules, key=lambda r: len(r[0])):
        name, slash, start = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, action).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """(src, dst, weight): links between different hosts, and the domain tree above ``hosts``."""
    links = (
        pages.select(url_parts(F.col("url"))[0].alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), 1)).alias("dst"))
        .select("src", small_letters(F.col("dst")).alias("dst"))
        .filter("src <> '' AND src <> dst")
    )
    labels = F.split("host", r"\.")
    chain = hosts.filter("host <> ''").select(labels.alias("labels")).select(
        # From the whole host up to the domain of two labels.
        F.explode(
            F.expr("transform(sequence(1, greatest(size(labels) - 1, 1)), i -> array_join(slice(labels, i, size(labels)), '.'))")
        ).alias("src")
    )
    upward = (
        chain.distinct()
        .select("src", F.expr("substring(src, instr(src, '.') + 1)").alias("dst"))
        .filter("src <> dst AND instr(dst, '.') > 0")
    )
    downward = upward.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    every = reduce(DataFrame.unionByName, [links, upward, downward])
    return every.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))


def fitting_scale(edges: DataFrame, seeds: DataFrame) -> int:
    """Units that the whole trust is dealt in, so that rounding down takes nothing that counts."""
    links = edges.agg(F.sum("weight")).first()[0] or 0
    pages = max(seeds.agg(F.sum("trusted"), F.sum("blocked")).first(), key=lambda n: n or 0) or 0
    return SCALE if SPARE * pages * links <= SCALE else FINE_SCALE


def floored(number: Column, by: Column) -> Column:
    """``number`` divided by ``by``, rounded down; ``div`` has room for a bigint alone."""
    return ((number - number % by) / by).cast(WHOLE)


def portion(number: Column, part: Column, every: Column) -> Column:
    """``number * part / every`` rounded down, without the product, which may not fit."""
    number, part, every = (c.cast(WHOLE) for c in (number, part, every))
    return (part * floored(number, every) + floored(part * (number % every), every)).cast(WHOLE)


def spread(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """(host, trust, distrust) in units of 1 / ``scale``, from edges (src, dst, weight) and seeds (host, trusted, blocked), all weights whole."""
    forward = edges.select(F.lit("trust").alias("kind"), "src", "dst", "weight")
    backward = edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    both = forward.unionByName(backward)
    out = both.groupBy("kind", "src").agg(F.sum("weight").alias("total"))
    both = write_out(both.join(out, ["kind", "src"]))
    starts = seeds.select(
        "host", F.explode(F.expr("map('trust', trusted, 'distrust', blocked)")).alias("kind", "mass")
    ).filter("mass > 0")
    # Two rows: the mass of each kind.
    totals = starts.groupBy("kind").agg(F.sum("mass").alias("all"))
    start = write_out(
        starts.join(totals, "kind").select("kind", "host", portion(F.lit(Decimal(scale)), F.col("mass"), F.col("all")).alias("rank"))
    )
    rank = start
    for step in range(1, rounds + 1):
        flow = (
            rank.withColumnRenamed("host", "src")
            .join(both, ["kind", "src"])
            .select("kind", F.col("dst").alias("host"), portion(F.col("rank"), F.col("weight"), F.col("total")).alias("rank"))
        )
        rank = (
            flow.select("kind", "host", F.lit(0).cast(WHOLE).alias("seed"), "rank")
            .unionByName(start.select("kind", "host", F.col("rank").alias("seed"), F.lit(0).cast(WHOLE).alias("rank")))
            .groupBy("kind", "host")
            .agg(F.expr(f"CAST((100 - {DAMPING}) * sum(seed) + {DAMPING} * sum(rank) AS {WHOLE})").alias("rank"))
            .select("kind", "host", floored(F.col("rank"), F.lit(100).cast(WHOLE)).alias("rank"))
        )
        if step % WRITE_EVERY == 0:
            rank = write_out(rank)
    return rank.groupBy("host").agg(
        *[F.sum(F.when(F.col("kind") == k, F.col("rank")).otherwise(0)).cast(WHOLE).alias(k) for k in ("trust", "distrust")]
    )


def judge_urls(pages: DataFrame, rules: list[Rule], *, rounds: int = ROUNDS, factor: int = BLOCK_FACTOR) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) of every page; the rule's verdict, else the host's."""
    host, path = url_parts(F.col("url"))
    placed = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    ruled = placed.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("listed"))
    seeds = write_out(
        ruled.filter("host <> ''")
        .groupBy("host")
        .agg(
            F.count(F.when(F.col("listed") == "allow", 1)).alias("trusted"),
            F.count(F.when(F.col("listed") == "block", 1)).alias("blocked"),
        )
    )
    edges = write_out(host_edges(pages, seeds.select("host")))
    scale = fitting_scale(edges, seeds)
    scores = write_out(spread(edges, seeds, rounds, scale))
    # The least score that ``hosts`` times is ``factor`` times the sum or more: the product itself may not fit.
    hosts = seeds.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).cast(WHOLE)).scalar()
    total = scores.agg((F.sum("distrust") * factor).cast(WHOLE)).scalar()
    least = floored((total + hosts - 1).cast(WHOLE), hosts)
    bad = (F.col("distrust") > F.col("trust")) & (F.col("distrust") >= least)
    unit = F.lit(Decimal(scale // SCALE)).cast(WHOLE)
    judged = scores.select(
        "host", *[floored(F.col(k), unit).cast("long").alias(k) for k in ("trust", "distrust")], bad.alias("bad")
    )
    return ruled.join(judged, "host", "left").select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("listed", F.when(F.col("bad"), "block").otherwise("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0).cast("long")).alias("trust"),
        F.coalesce("distrust", F.lit(0).cast("long")).alias("distrust"),
    )
