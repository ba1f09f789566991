"""Licence scan: an exact set-similarity join of text blocks with licence templates.

A block is a line, a template the set of its distinct words; a block matches where it holds at
least CONTAINED of a template's words. Words are ranked by how many blocks have them, rare first,
over all blocks. A match shares a word among the template's first |T| - t + 1 words (t: the least
intersection) and among the block's first |B| - t + 1, so only those are joined; pairs whose
lengths or places leave fewer than t words to share go before intersections are counted. Words that
no template has cannot be shared and are left out of the blocks. The index has one row per
template word and is broadcast: it is a fixed list. No block is missed and none is cut short.

Besides, places where set phrases stand are counted per document. Null texts count as empty: no
words, no places, no labels, score 0. Rows alike in id and text share their result; both are
returned. Everything runs on built-in functions.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.tables import col, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CONTAINED = Fraction(4, 5)

# Phrases with their labels, and notices of public licences.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
TEMPLATES = {
    "text:apache": "licensed under the apache license version 2 0",
    "text:apache-notice": "you may not use this file except in compliance with the license you may obtain a copy of the license at",
    "text:bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that "
    "the following conditions are met",
    "text:cc-by-nc": "licensed under cc by nc 4 0",
    "text:gpl": "this work is licensed under the gnu general public license version 3",
    "text:gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu "
    "general public license as published by the free software foundation",
    "text:isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "text:mit": "released under the mit license",
    "text:mit-notice": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
    "documentation files the software to deal in the software without restriction",
    "text:mpl": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "text:reserved": "all rights reserved",
    "text:unlicense": "this is free and unencumbered software released into the public domain",
}


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]  # in the global order

    @property
    def least(self) -> int:
        return ceil(len(self.words) * CONTAINED)


def lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def words(low: Column) -> Column:
    return F.array_remove(F.split(low, BETWEEN), "")


def places(found: Column, phrase: str) -> Column:
    """Starts, from 0, of a phrase in an array of words."""
    parts = phrase.split(" ")

    def start(word: Column, at: Column) -> Column:
        same = word == parts[-1]
        for back, part in enumerate(reversed(parts[:-1]), 1):
            same = same & (at >= back) & (F.get(found, at - back) == part)
        return F.when(same, at - (len(parts) - 1))

    return F.filter(F.transform(found, start), lambda at: at.isNotNull())


def _names(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    """128 bits that name a row by id and text."""
    text = F.coalesce(col(text_col), F.lit(""))
    return [F.xxhash64(col(id_col), text).alias("name1"), F.xxhash64(text, F.lit(1), col(id_col)).alias("name2")]


def counted(docs: DataFrame, phrases: dict[str, str], id_col: str, text_col: str) -> DataFrame:
    """Per document: its name, n_words, n_base, first_word, last_word, base (labels)."""
    low = docs.select(col(id_col).alias(id_col), *_names(docs, id_col, text_col), lowered(col(text_col)).alias("low"))
    low = low.withColumn("found", words(F.col("low")))
    none = F.expr("cast(array() as array<int>)")
    starts = {label: F.when(F.contains("low", F.lit(p.split(" ")[-1])), places(F.col("found"), p)).otherwise(none) for p, label in phrases.items()}
    per_phrase = low.select(
        id_col, "name1", "name2", F.size("found").cast("bigint").alias("n_words"),
        *[starts[label].alias(f"p{n}") for n, label in enumerate(phrases.values())],
    )
    columns = [F.col(f"p{n}") for n in range(len(phrases))]
    every = F.concat(*columns)
    labels = F.array(*[F.when(F.size(c) > 0, F.lit(label)) for c, label in zip(columns, phrases.values())])
    return per_phrase.select(
        id_col, "name1", "name2", "n_words",
        F.size(every).cast("bigint").alias("n_base"),
        F.array_min(every).cast("bigint").alias("first_word"),
        F.array_max(every).cast("bigint").alias("last_word"),
        F.array_compact(labels).alias("base"),
    )


def blocks(docs: DataFrame, vocabulary: list[str], id_col: str, text_col: str) -> DataFrame:
    """(name1, name2, tokens) per line that has a word of the vocabulary."""
    lines = docs.select(*_names(docs, id_col, text_col), F.explode(F.split(lowered(col(text_col)), "\n")).alias("line"))
    tokens = F.array_intersect(words(F.col("line")), F.array(*[F.lit(w) for w in vocabulary]))
    return lines.select("name1", "name2", tokens.alias("tokens")).where(F.size("tokens") > 0)


def matches(docs: DataFrame, templates: dict[str, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(name1, name2, label, contained): best containment of each template that a document matches."""
    spark = docs.sparkSession
    vocabulary = sorted({word for text in templates.values() for word in text.split()})
    lines = blocks(docs, vocabulary, id_col, text_col)
    # one count per template word: the fixed list bounds what comes back
    df = dict(lines.select(F.explode("tokens").alias("token")).groupBy("token").count().collect())
    ranked = sorted(vocabulary, key=lambda word: (df.get(word, 0), word))
    rank = {word: n for n, word in enumerate(ranked)}
    known = [Template(label, tuple(sorted(set(text.split()), key=rank.get))) for label, text in templates.items()]
    index = spark.createDataFrame(
        [
            (rank[word], place, t.label, len(t.words), t.least, [rank[w] for w in t.words])
            for t in known
            for place, word in enumerate(t.words[: len(t.words) - t.least + 1])
        ],
        "rank int, place int, label string, t_size int, least int, t_ranks array<int>",
    )
    prefix = F.array(*[F.lit(n) for n in sorted({rank[w] for t in known for w in t.words[: len(t.words) - t.least + 1]})])
    shortest = min(t.least for t in known)
    numbers = F.create_map(*[F.lit(x) for word in ranked for x in (word, rank[word])])
    ordered = lines.where(F.size("tokens") >= shortest).select(
        "name1", "name2", F.sort_array(F.transform("tokens", lambda w: F.element_at(numbers, w))).alias("ranks")
    )
    ordered = ordered.where(F.arrays_overlap("ranks", prefix))
    opened = ordered.select("name1", "name2", "ranks", F.posexplode("ranks").alias("at", "rank"))
    size = F.size("ranks")
    pairs = opened.join(F.broadcast(index), "rank").where(
        (size >= F.col("least"))  # length
        & (F.col("at") <= size - F.col("least"))  # the block's own prefix
        # places: if this is the first word shared, enough must be left on either side
        & (F.least(F.col("t_size") - F.col("place"), size - F.col("at")) >= F.col("least"))
    )
    shared = F.size(F.array_intersect("ranks", "t_ranks"))
    return (
        pairs.where(shared >= F.col("least"))
        .groupBy("name1", "name2", "label")
        .agg(F.max(shared / F.col("t_size")).alias("contained"))
    )


def scan(
    docs: DataFrame,
    phrases: dict[str, str] = PHRASES,
    templates: dict[str, str] = TEMPLATES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: id, n_words, n_base, first_word, last_word, base, matched (label, contained)."""
    hits = (
        matches(docs, templates, id_col, text_col)
        .groupBy("name1", "name2")
        .agg(F.collect_list(F.struct("label", "contained")).alias("matched"))  # one per template at most
    )
    own = counted(docs, phrases, id_col, text_col)
    return own.join(written(hits, "license-hits"), ["name1", "name2"], "left").drop("name1", "name2")
