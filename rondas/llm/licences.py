"""License scans by diagonal voting against template texts.

Every text is cut into words of small letters and digits. The hashes of all its rolling
k-word grams are joined in Spark with the grams of the templates. A match of text place i and
template place j votes for the diagonal i - j: an undisturbed copy of the template puts all its votes on one
diagonal, a copy with words put in or left out on neighbouring ones. Diagonals no further apart than
``DRIFT`` whose stretches follow each other are merged, and a merged stretch is verified: it must cover
``COVERAGE`` percent of the template's words, in a stretch not much longer than the template.

The templates are a fixed table of a few hundred grams, and the only thing that is broadcast. Votes are
summed before they are shuffled, and a shuffle key is one text and one template; a text that repeats a license
very often makes as many rows as it has places, no more.

Fixed phrases (``PHRASES``) are counted besides, at all their places. Defined results: null and empty texts
have no words, no labels and score 0; repeated rows get the same result each; null ``doc_id`` is told apart by text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as Over
from pyspark.sql import functions as F

from rondas.llm import words as W
from rondas.llm.tables import identity, map_batches

GRAM = 3
DRIFT = 4
COVERAGE = 70

#: Phrases and the label of each.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Notices of common licenses, and the label of each.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("cc-by-nc", "licensed under cc by nc 4.0"),
    ("apache", "licensed under the apache license version 2.0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        " documentation files, to deal in the Software without restriction, including without limitation the rights to"
        " use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    (
        "apache",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at"
        " http://www.apache.org/licenses/LICENSE-2.0",
    ),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General"
        " Public License as published by the Free Software Foundation",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that"
        " the following conditions are met",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby"
        " granted, provided that the above copyright notice and this permission notice appear in all copies",
    ),
    (
        "mpl",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was"
        " not distributed with this file, You can obtain one at",
    ),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution ShareAlike 4.0 International License"),
]


def hashed_words(block: W.Block) -> tuple[W.Words, np.ndarray]:
    lower = W.Block(block.lo, block.hi, W.lowered(block.data), block.offsets)
    words = W.split(lower, W.PUNCTUATED)
    return words, W.word_hashes(lower.data, words)


def text_hashes(text: str) -> np.ndarray:
    (block,) = W.blocks(pa.array([text]))
    return hashed_words(block)[1]


def gram_keys(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    return W.mix(W.span_hashes(W.prefix_hashes(hashes), at, at + GRAM)).view(np.int64)


def template_grams(spark, templates: list[tuple[str, str]]) -> DataFrame:
    """(key, template, place): the grams of the templates, as many as they have words at most."""
    rows = []
    for t, (_, text) in enumerate(templates):
        hashes = text_hashes(text)
        at = np.arange(len(hashes) - GRAM + 1)
        rows += [(int(key), t, int(j)) for key, j in zip(gram_keys(hashes, at), at, strict=True)]
    return spark.createDataFrame(rows, "key bigint, template int, place int")


def gram_rows(docs: DataFrame) -> DataFrame:
    """(rid, tag, start, key): all rolling grams of all texts."""

    def rolled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in W.blocks(batch.column(2)):
                words, hashes = hashed_words(block)
                at = W.gram_starts(words, GRAM)
                of = words.owner()[at]
                rows = pa.array(of + block.lo)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(rows),
                        batch.column(1).take(rows),
                        pa.array((at - words.first[of]).astype(np.int32)),
                        pa.array(gram_keys(hashes, at)),
                    ],
                    names=["rid", "tag", "start", "key"],
                )

    return map_batches(docs.select(*identity(), "text"), rolled, "rid bigint, tag bigint, start int, key bigint")


def phrase_places(docs: DataFrame, phrases: dict[str, str]) -> DataFrame:
    """(doc_id, rid, tag, n_words, n_base, first_word, last_word, base): words and fixed phrases of each text."""
    wanted = [(text_hashes(p), label) for p, label in phrases.items()]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in W.blocks(batch.column(3)):
                words, hashes = hashed_words(block)
                texts, owner = block.hi - block.lo, words.owner()
                count = np.zeros(texts, dtype=np.int64)
                first, last = np.full(texts, np.iinfo(np.int64).max), np.full(texts, -1)
                labels: list[set[str]] = [set() for _ in range(texts)]
                for phrase, label in wanted:
                    at = W.gram_starts(words, len(phrase))
                    for k, word in enumerate(phrase):
                        at = at[hashes[at + k] == word]
                    of = owner[at]
                    place = at - words.first[of]
                    np.add.at(count, of, 1)
                    np.minimum.at(first, of, place)
                    np.maximum.at(last, of, place)
                    for t in of.tolist():
                        labels[t].add(label)
                none = count == 0
                yield pa.RecordBatch.from_arrays(
                    [
                        *[c.slice(block.lo, texts) for c in batch.columns[:3]],
                        pa.array(words.counts.astype(np.int64)),
                        pa.array(count),
                        pa.array(first, mask=none),
                        pa.array(last, mask=none),
                        pa.array([sorted(x) for x in labels], pa.list_(pa.string())),
                    ],
                    names=["doc_id", "rid", "tag", "n_words", "n_base", "first_word", "last_word", "base"],
                )

    schema = (
        "doc_id bigint, rid bigint, tag bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base array<string>"
    )
    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), *identity(), "text"), counted, schema)


def license_spans(docs: DataFrame, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """(rid, tag, template, label, first, last, covered, coverage, verified): merged stretches of each template in each text."""
    templates = TEMPLATES if templates is None else templates
    spark = docs.sparkSession
    grams = template_grams(spark, templates)
    sizes = spark.createDataFrame(
        [(t, label, len(text_hashes(text))) for t, (label, text) in enumerate(templates)], "template int, label string, size int"
    )
    # A row again for a repeated document would vote twice.
    votes = gram_rows(docs).join(F.broadcast(grams), "key").select("rid", "tag", "template", "start", "place").distinct()
    diagonals = votes.withColumn("diagonal", F.col("start") - F.col("place"))
    key = ["rid", "tag", "template"]
    # Stretches of one diagonal; a template that stands several times in a text is on several diagonals.
    lines = diagonals.groupBy(*key, "diagonal").agg(
        F.min("start").alias("first"), F.max("start").alias("last"), F.collect_set("place").alias("places")
    )
    by_place = Over.partitionBy(*key).orderBy("first", "diagonal")
    joined = (
        (F.abs(F.col("diagonal") - F.lag("diagonal").over(by_place)) <= DRIFT)
        & (F.col("first") <= F.lag("last").over(by_place) + GRAM + DRIFT)
    )
    merged = (
        lines.withColumn("new", F.when(joined, 0).otherwise(1))
        .withColumn("stretch", F.sum("new").over(by_place.rowsBetween(Over.unboundedPreceding, 0)))
        .groupBy(*key, "stretch")
        .agg(
            F.min("first").alias("first"),
            (F.max("last") + GRAM).alias("last"),
            F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"),
        )
    )
    words = F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + GRAM - 1))))
    return (
        merged.join(F.broadcast(sizes), "template")
        .withColumn("covered", F.size(words))
        .select(
            *key,
            "label",
            "first",
            "last",
            "covered",
            (F.col("covered") / F.col("size")).alias("coverage"),
            (
                (100 * F.col("covered") >= COVERAGE * F.col("size"))
                & (100 * (F.col("last") - F.col("first")) <= (200 - COVERAGE) * F.col("size") + 100 * DRIFT)
            ).alias("verified"),
        )
    )


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every document.

    ``score`` is 1 where a fixed phrase stands, else the greatest share of a template that one stretch covers.
    """
    spans = (
        license_spans(docs, templates)
        .groupBy("rid", "tag")
        .agg(F.collect_set(F.when(F.col("verified"), F.col("label"))).alias("found"), F.max("coverage").alias("coverage"))
    )
    base = phrase_places(docs, PHRASES if phrases is None else phrases)
    every = F.array_sort(F.array_union("base", F.coalesce("found", F.array().cast("array<string>"))))
    return base.join(spans, ["rid", "tag"], "left").select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("coverage", F.lit(0.0))).alias("score"),
    )
