"""Licence scans: an exact set-similarity join of text blocks with licence templates.

Built-in functions only. A block is a window of words over line ends, twice as long as the
longest template and half over the next one, so a notice lies whole in one of them however it is wrapped. It
matches a template if it contains ``threshold`` of the template's distinct words or
more. Template words are ordered by how many texts of the whole corpus hold
them, rarest first. With t = ceil(threshold * size) words needed, a matching
block must hold one of the first size - t + 1 template words: only blocks with such a word
leave their text, as the template words they hold in that order, and an equi-join on the words themselves
pairs them with templates (prefix filter). A pair needs t words in the block (length filter), and
from the first shared word on enough words must be left on both sides (positional filter). What passes is
verified by intersection. Texts are not shuffled; what was found meets its row by a number.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardwright.llm.common import stored

# Phrases that name a licence, and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Notices by which works declare a licence, and their labels.
TEMPLATES = {
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": "You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License.",
    "mit-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "bsd-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
}

THRESHOLD = 0.8
#: Template words of prefixes whose table is broadcast (some MB).
BROADCAST_ROWS = 20_000
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower_ascii(text: Column) -> Column:
    """Lower case, where only A-Z may yield a-z: the Kelvin sign, which ``lower`` maps to k, goes first."""
    return F.lower(F.replace(text, F.lit("K"), F.lit("ĸ")))


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, NON_WORD), "")


def template_words(templates: dict[str, str]) -> dict[str, list[str]]:
    return {label: sorted(set(re.findall("[a-z0-9]+", text.lower()))) for label, text in templates.items()}


def half_window(templates: dict[str, str]) -> int:
    """Words of the longest template: windows of twice as many begin at its multiples."""
    return max((len(re.findall("[a-z0-9]+", text.lower())) for text in templates.values()), default=1) or 1


def _strings(values: list[str]) -> Column:
    return F.array(*(F.lit(v) for v in values)) if values else F.array().cast("array<string>")


def needed(size: int, threshold: float) -> int:
    return max(1, math.ceil(threshold * size - 1e-9))


def word_frequencies(texts: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """How many texts hold each word of the templates; ``texts`` has _text."""
    held = texts.select(F.explode(F.array_intersect(_strings(vocabulary), words(F.col("_text")))).alias("word"))
    found = {r["word"]: r["n"] for r in held.groupBy("word").agg(F.count("*").alias("n")).collect()}
    return {w: found.get(w, 0) for w in vocabulary}


def found_templates(blocks: DataFrame, templates: dict[str, list[str]], order: list[str], threshold: float) -> DataFrame:
    """(row, word, label, score) of every template that a block contains; ``blocks`` has row, word (the block's first) and held, its template words in order."""
    spark, rank = blocks.sparkSession, {w: i for i, w in enumerate(order)}
    rows = []
    for label, tokens in templates.items():
        tokens = sorted(tokens, key=rank.get)
        need = needed(len(tokens), threshold)
        rows += [(token, place, label, need, tokens) for place, token in enumerate(tokens[: len(tokens) - need + 1])]
    table = spark.createDataFrame(rows, "token string, place int, label string, need int, tokens array<string>")
    table = F.broadcast(table) if len(rows) <= BROADCAST_ROWS else table
    asked = blocks.select("row", "word", "held", F.posexplode("held").alias("at", "token"))
    pairs = asked.join(table, "token").where(F.size("held") >= F.col("need"))  # the prefix and length filters
    pairs = pairs.where(F.element_at(F.array_intersect("tokens", "held"), 1) == F.col("token"))  # once for each pair, at its first shared word
    left = F.least(F.size("held") - F.col("at"), F.size("tokens") - F.col("place"))
    shared = F.size(F.array_intersect("tokens", "held"))
    return pairs.where((left >= F.col("need")) & (shared >= F.col("need"))).select("row", "word", "label", (shared / F.size("tokens").cast("double")).alias("score"))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: id_col, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks.

    score: 1 where a phrase stands, else the best containment of a template that
    was found, else 0. blocks: (first word from 0, label, score) of every template
    found in a window. Null text counts as empty: no words, empty label strings, null
    positions. Repeated rows stay; other columns are not read. Templates without words match nothing.
    """
    wanted = {label: tokens for label, tokens in template_words(templates).items() if tokens}
    vocabulary = sorted({w for tokens in wanted.values() for w in tokens})
    half = half_window(templates)
    base = docs.select(F.col(id_col).alias("_id"), lower_ascii(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("_text"))
    frequency = word_frequencies(base, vocabulary)
    order = sorted(vocabulary, key=lambda w: (frequency[w], w))
    rank = {w: i for i, w in enumerate(order)}
    prefix = sorted({w for tokens in wanted.values() for w in sorted(tokens, key=rank.get)[: len(tokens) - needed(len(tokens), threshold) + 1]})

    split = base.select("_id", words(F.col("_text")).alias("_words"))
    # Windows that hold a word of some prefix: each word is in the one that begins at its multiple of ``half``, and in the one before.
    last = F.greatest(F.lit(0), F.ceil(F.size("_words") / half).cast("int") - 2)
    places = F.filter(F.transform("_words", lambda w, i: F.when(w.isin(prefix), F.floor(i / half).cast("int"))), lambda x: x.isNotNull())
    found = split.select("_id", "_words", F.concat(F.lit(" "), F.array_join("_words", " "), F.lit(" ")).alias("_joined"), last.alias("_last"), F.array_distinct(places).alias("_places"))
    windows = F.array_distinct(F.flatten(F.transform("_places", lambda k: F.array(F.greatest(k - 1, F.lit(0)), k))))
    windows = F.filter(windows, lambda k: k <= F.col("_last"))
    held = F.transform(windows, lambda k: F.struct((k * half).alias("word"), F.array_intersect(_strings(order), F.slice("_words", k * half + 1, F.lit(2 * half))).alias("held")))
    lined = found.select("_id", "_joined", held.alias("_held"))

    j = F.col("_joined")
    spaces = lambda s: F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))
    firsts, lasts, counts, labels = [], [], [], []
    for phrase, label in phrases.items():
        mark = f" {phrase} "
        at = F.instr(j, mark)
        firsts.append(F.when(at > 0, spaces(F.substring(j, F.lit(1), at)) - 1))
        tail = F.length(j) - F.length(F.substring_index(j, mark, -1)) - len(mark) + 1
        lasts.append(F.when(at > 0, spaces(F.substring(j, F.lit(1), tail)) - 1))
        counts.append(F.when(at > 0, F.regexp_count(j, F.lit(f" {phrase}(?= )"))).otherwise(0))
        labels.append(F.when(at > 0, F.lit(label)))
    base_labels = F.array_sort(F.array_distinct(F.filter(F.array(*labels), lambda x: x.isNotNull())))
    narrow = lined.select(
        F.monotonically_increasing_id().alias("row"),
        "_id",
        F.when(j == "  ", 0).otherwise(spaces(j) - 1).cast("long").alias("n_words"),
        sum(counts[1:], counts[0]).cast("long").alias("n_base"),
        F.least(*firsts).cast("long").alias("first_word"),
        F.greatest(*lasts).cast("long").alias("last_word"),
        base_labels.alias("_base"),
        "_held",
    )
    narrow = stored(narrow, "licences")
    blocks = narrow.select("row", F.explode("_held").alias("b")).select("row", "b.word", "b.held")
    own = found_templates(blocks, wanted, order, threshold)
    own = own.groupBy("row").agg(F.collect_set("label").alias("_own"), F.max("score").alias("_best"), F.array_sort(F.collect_list(F.struct("word", "label", "score"))).alias("blocks"))  # of one text
    none = F.array().cast("array<string>")
    return narrow.join(own, "row", "left").select(
        F.col("_id").alias(id_col), "n_words", "n_base", "first_word", "last_word",
        F.array_join("_base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("_base", F.coalesce("_own", none))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("_best", F.lit(0.0))).alias("score"),
        F.coalesce("blocks", F.array().cast("array<struct<word:int,label:string,score:double>>")).alias("blocks"),
    )


def license_sql(phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The digest columns in DuckDB, by brute force over all windows and templates."""
    wanted, half = template_words(templates), half_window(templates)
    rows = ", ".join(f"('{label}', [{', '.join(f"'{w}'" for w in tokens)}], {math.ceil(threshold * len(tokens) - 1e-9)})" for label, tokens in wanted.items())
    named = ", ".join(f"('{p}', '{label}')" for p, label in phrases.items())
    split = lambda s: f"list_filter(string_split_regex({s}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
    return f"""
WITH low AS (SELECT doc_id, row_number() OVER () AS rid, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT doc_id, rid, t, {split('t')} AS ws FROM low),
phrases(phrase, label) AS (VALUES {named}),
places AS (
  SELECT rid, label, i FROM (SELECT rid, ws, phrase, label, len(string_split(phrase, ' ')) AS n, unnest(range(0, len(ws))) AS i FROM w, phrases WHERE contains(array_to_string(ws, ' '), phrase))
  WHERE array_to_string(ws[i + 1 : i + n], ' ') = phrase),
base AS (SELECT rid, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS labels FROM places GROUP BY rid),
templates(label, tokens, need) AS (VALUES {rows}),
blocks AS (SELECT rid, list_distinct(ws[k * {half} + 1 : k * {half} + {2 * half}]) AS ws FROM (SELECT rid, ws, unnest(range(0, CAST(greatest(0, ceil(len(ws) / CAST({half} AS DOUBLE)) - 2) AS BIGINT) + 1)) AS k FROM w)),
found AS (SELECT rid, label, len(list_intersect(tokens, ws)) / CAST(len(tokens) AS DOUBLE) AS score FROM blocks, templates WHERE len(list_intersect(tokens, ws)) >= need),
own AS (SELECT rid, max(score) AS score, list(DISTINCT label) AS labels FROM found GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(own.labels, [])))), ','), '') AS labels,
  CASE WHEN n_base > 0 THEN CAST(1 AS DOUBLE) ELSE coalesce(own.score, CAST(0 AS DOUBLE)) END AS score
FROM w LEFT JOIN base USING (rid) LEFT JOIN own USING (rid)"""
