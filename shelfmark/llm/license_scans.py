"""License scans: an exact set-similarity join of text blocks with license notices.

A block is a sentence or line. It matches a template if it holds at least a given share of the template's
distinct words (containment). Words are put in one order for all, the rarest in the whole corpus first.
Any block that matches must then hold one of a template's first ``size - needed + 1`` words (prefix filter),
have enough words (length filter), and have enough words left after the first common one in both orders
(positional filter). What passes is counted in full, so the join finds every match and no other.

Notices are often wrapped, so lines are also read together, up to a sentence end or a blank line. There a
block is as many words in a row as the template has, over a line end: a whole passage would hold the words
of a short notice by chance. Such a block, too, holds a prefix word, and only windows around one are counted.

Only blocks with a prefix word leave the task that reads them. The templates are a parameter, and their
words are a table that all tasks hold; its size is checked. Documents are keyed by rows of a table written
once, so repeated ids stay apart. A null text counts as an empty one without words or labels. Columns other
than doc_id and text are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.session import scratch_path

THRESHOLD = 0.8
#: Templates are for notices; more words than this are refused, as all tasks hold them.
MAX_TEMPLATE_WORDS = 200_000

# Phrases that name a license outright.
PHRASES = (
    ("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"),
)
# Notices by which licenses are given.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files, to deal in the Software without restriction",
    ),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "you may not use this file except in compliance with the License"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation",
    ),
    (
        "lgpl",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU "
        "Lesser General Public License",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted "
        "provided that the following conditions are met",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
        "is hereby granted",
    ),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
)

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_BLOCK_END = re.compile(rb"\n|[.!?][ \t\r\n\x0b\x0c]+")
_PASSAGE_END = re.compile(rb"\n[ \t\r\x0b\x0c]*\n|[.!?][ \t\r\n\x0b\x0c]+")
_IN_WORD = np.zeros(256, np.bool_)
_IN_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def _lower(text: str | None) -> bytes:
    """UTF-8 with A to Z in lower case; other letters stay."""
    return (text or "").encode("utf-8", "replace").lower()


def words(text: str) -> list[bytes]:
    return _WORD.findall(_lower(text))


def _count_words(data: bytes) -> int:
    inside = _IN_WORD[np.frombuffer(data, np.uint8)]
    return int(inside[:1].sum() + np.count_nonzero(inside[1:] & ~inside[:-1]))


def _places(found: list[bytes], phrases: list[tuple[tuple[bytes, ...], str]]) -> list[tuple[int, str]]:
    firsts = {p[0] for p, _ in phrases}
    return [
        (i, label)
        for i, w in enumerate(found)
        if w in firsts
        for p, label in phrases
        if tuple(found[i : i + len(p)]) == p
    ]


def _templates(templates) -> list[tuple[str, frozenset[bytes]]]:
    sets = [(label, frozenset(words(text))) for label, text in templates]
    if sum(len(s) for _, s in sets) > MAX_TEMPLATE_WORDS:
        raise ValueError(f"templates hold more than {MAX_TEMPLATE_WORDS} words")
    return [(label, s) for label, s in sets if s]


def _best_window(found: list[bytes], starts: range, size: int, tokens: frozenset[bytes]) -> int:
    """The most distinct ``tokens`` in any ``size`` words from one of ``starts`` on."""
    held: Counter[bytes] = Counter(w for w in found[starts.start : starts.start + size - 1] if w in tokens)
    best = 0
    for i in starts:
        if i + size <= len(found) and (w := found[i + size - 1]) in tokens:
            held[w] += 1
        best = max(best, len(held))
        if (w := found[i]) in held:
            held[w] -= 1
            if not held[w]:
                del held[w]
    return best


Wrapped = list[tuple[str, int, frozenset[bytes], int, frozenset[bytes]]]


def wrapped(data: bytes, templates: Wrapped) -> dict[str, float]:
    """The largest containment by label of notices that go over a line end.

    ``templates`` are label, number of words, distinct words, words needed and prefix words of each.
    """
    out: dict[str, float] = {}
    for passage in _PASSAGE_END.split(data):
        if b"\n" not in passage:
            continue
        found = _WORD.findall(passage)
        all_words = set(found)
        for label, size, tokens, need, first in templates:
            if all_words.isdisjoint(first) or len(tokens & all_words) < need:
                continue
            done = 0
            for i, w in enumerate(found):
                if w in first:  # windows that hold this word and weren't looked at
                    starts = range(max(done, i - size + 1), i + 1)
                    best = _best_window(found, starts, size, tokens)
                    done = i + 1
                    if best >= need:
                        out[label] = max(out.get(label, 0.0), best / len(tokens))
    return out


def _frequencies(docs: DataFrame, vocabulary: frozenset[bytes]) -> dict[bytes, int]:
    """How often each template word occurs in all texts; a task sends one row per word at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column(0):
                tally.update(_WORD.findall(_lower(text.as_py())))
            if len(tally) > 200_000:  # words of no template don't pile up
                tally = Counter({w: tally[w] for w in vocabulary if w in tally})
        kept = [(w, tally[w]) for w in vocabulary if w in tally]
        yield pa.RecordBatch.from_arrays(
            [pa.array([w for w, _ in kept], pa.binary()), pa.array([n for _, n in kept], pa.int64())],
            names=["word", "n"],
        )

    counts = docs.select(F.col("text").cast("string")).mapInArrow(count, "word binary, n long")
    return {bytes(r["word"]): r["n"] for r in counts.groupBy("word").agg(F.sum("n").alias("n")).collect()}


def needed(size: int, threshold: float) -> int:
    return max(1, math.ceil(threshold * size - 1e-9))


_FACTS = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, "
    "blocks array<struct<n_words:int,ranks:array<int>>>, wrapped array<struct<label:string,containment:double>>"
)


def _facts(
    docs: DataFrame, rank: dict[bytes, int], prefix: frozenset[bytes], phrases, templates: Wrapped
) -> DataFrame:
    """Per row: word count, places of phrases, the blocks that hold a prefix word, each as its number
    of distinct words and the ranks of those that templates know, rarest first, and the wrapped notices."""
    plain = [(tuple(words(p)), label) for p, label in phrases]
    sure = {max(p, key=len) for p, _ in plain}
    kinds = pa.schema(
        [
            ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()),
            ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.list_(pa.string())),
            ("blocks", pa.list_(pa.struct([("n_words", pa.int32()), ("ranks", pa.list_(pa.int32()))]))),
            ("wrapped", pa.list_(pa.struct([("label", pa.string()), ("containment", pa.float64())]))),
        ]
    )

    def block(data: bytes) -> dict | None:
        found = set(_WORD.findall(data))
        if found.isdisjoint(prefix):
            return None
        return {"n_words": len(found), "ranks": sorted(rank[w] for w in found if w in rank)}

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                data = _lower(text.as_py())
                places = _places(_WORD.findall(data), plain) if any(w in data for w in sure) else []
                blocks, over = [], {}
                if any(w in data for w in prefix):
                    over = wrapped(data, templates)
                    blocks = [b for b in map(block, _BLOCK_END.split(data)) if b]
                rows.append(
                    {
                        "doc_id": doc_id.as_py(), "n_words": _count_words(data), "n_base": len(places),
                        "first_word": min((i for i, _ in places), default=None),
                        "last_word": max((i for i, _ in places), default=None),
                        "base_labels": sorted({label for _, label in places}), "blocks": blocks,
                        "wrapped": [{"label": k, "containment": v} for k, v in over.items()],
                    }
                )
            yield pa.RecordBatch.from_pylist(rows, kinds)

    spark = docs.sparkSession
    path = scratch_path(spark, "license_blocks")
    facts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        look, _FACTS
    )
    facts.withColumn("row", F.monotonically_increasing_id()).write.parquet(path)
    return spark.read.parquet(path)


def _joined(facts: DataFrame, sets, rank: dict[bytes, int], threshold: float) -> DataFrame:
    """``row, label, containment`` of every matching block."""
    spark = facts.sparkSession
    rows = []
    for t, (label, tokens) in enumerate(sets):
        ranks, need = sorted(rank[w] for w in tokens), needed(len(tokens), threshold)
        for p, r in enumerate(ranks[: len(ranks) - need + 1]):
            rows.append((r, t, label, p, need, ranks))
    postings = spark.createDataFrame(
        rows, "token int, template int, label string, p int, need int, template_ranks array<int>"
    )
    blocks = facts.select("row", F.posexplode("blocks").alias("block", "b")).select(
        "row", "block", F.col("b.n_words").alias("n_words"), F.col("b.ranks").alias("ranks")
    )
    tokens = blocks.select("*", F.posexplode("ranks").alias("q", "token"))
    left_in_template = F.size("template_ranks") - F.col("p")
    left_in_block = F.size("ranks") - F.col("q")
    pairs = tokens.join(F.broadcast(postings), "token").filter(
        (F.col("n_words") >= F.col("need"))  # length
        & (F.least(left_in_template, left_in_block) >= F.col("need"))  # position
    )
    common = F.size(F.array_intersect("ranks", "template_ranks"))
    return (
        pairs.filter(common >= F.col("need"))
        .select("row", "label", (common / F.size("template_ranks")).alias("containment"))
    )


def scan(
    docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, threshold: float = THRESHOLD
) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` of each row.

    ``labels`` are those of phrases and of matching templates, sorted; ``score`` is the largest
    containment, 1 where a phrase stands. Runs a job for the word counts and one for the blocks.
    """
    sets = _templates(templates)
    vocabulary = frozenset().union(*(s for _, s in sets)) if sets else frozenset()
    counts = _frequencies(docs, vocabulary)
    order = sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    prefix = frozenset(
        w for _, s in sets for w in sorted(s, key=rank.get)[: len(s) - needed(len(s), threshold) + 1]
    )
    lengths = [n for n in (len(words(text)) for _, text in templates) if n]
    notices = []
    for (label, s), n in zip(sets, lengths):
        need = needed(len(s), threshold)
        notices.append((label, n, s, need, frozenset(sorted(s, key=rank.get)[: len(s) - need + 1])))
    facts = _facts(docs, rank, prefix, phrases, notices)
    over = facts.select("row", F.explode("wrapped").alias("w")).select("row", "w.label", "w.containment")
    found = (
        _joined(facts, sets, rank, threshold)
        .unionByName(over)
        .groupBy("row")
        .agg(F.collect_set("label").alias("found"), F.max("containment").alias("containment"))
    )
    empty = F.array().cast("array<string>")
    labels = F.array_sort(F.array_union("base_labels", F.coalesce("found", empty)))
    certain = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("containment", F.lit(0.0)))
    return facts.drop("blocks", "wrapped").join(found, "row", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        certain.alias("score"),
    )
