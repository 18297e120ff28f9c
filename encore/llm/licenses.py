"""License scans as an exact set-similarity join, in DataFrame and SQL functions only.

Text blocks and license templates are sets of words. A block matches a template when it holds at least ``threshold`` of
the template's words, all words that set the template apart from its neighbours (a version number, ``lesser``, ``nc``)
and none that belong to a neighbour. The blocks of a template are the windows of a text that begin with one of its words,
line breaks ignored, as long as the template's words over the threshold: a notice wrapped at any width is found, and words
that lie further apart are none.

Words are ordered by their frequency over all documents, rare ones first. With ``need`` the smallest overlap that meets
the threshold, a matching pair shares a word among the first ``size - need + 1`` words of both sides (prefix filter), the
block has ``need`` template words or more (length filter), and what can follow the shared word on either side still
reaches ``need`` (positional filter). Only texts that have a prefix word of some template, as a word, are split, and only
the windows around such words are blocks. What passes is verified; no matching block is lost.

Words that no template has cannot take part in an overlap. They count as rarer than all others and leave the blocks' sets
before the filters.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from encore.llm import common

THRESHOLD = 0.8
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


class Template(NamedTuple):
    """A notice; ``must`` words set it apart from its neighbours, ``never`` words belong to one of them."""

    label: str
    text: str
    must: tuple[str, ...] = ()
    never: tuple[str, ...] = ()


# Phrases of the base scan, and customary one-line notices of public licenses.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
_CC = ("noncommercial", "sharealike", "noderivatives", "nc", "sa", "nd")
TEMPLATES = (
    Template("agpl-3.0", "Licensed under the GNU Affero General Public License, version 3", ("affero", "3"), ("lesser",)),
    Template("all-rights-reserved", "All rights reserved"),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache", "2")),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    Template("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License",
             ("creative", "commons", "attribution", "4"), _CC),
    Template("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ("cc", "by", "nc", "4"), ("sa", "nd")),
    Template("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", ("cc", "by", "sa", "4"), ("nc", "nd")),
    Template("gpl-2.0", "This work is licensed under the GNU General Public License, version 2", ("gnu", "2"), ("lesser", "affero", "library")),
    Template("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", ("gnu", "3"), ("lesser", "affero", "library")),
    Template("lgpl-3.0", "Licensed under the GNU Lesser General Public License, version 3", ("lesser", "3"), ("affero",)),
    Template("mit", "Released under the MIT License", ("mit",)),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla", "2")),
    Template("public-domain", "This work is released into the public domain", ("public", "domain")),
)


def _words(text: str) -> list[str]:
    return [w for w in re.split(SEPARATORS, "".join(c.lower() if c in UPPER else c for c in text)) if w]


def _quoted(values: Sequence[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def need(size: int, threshold: float) -> int:
    """The smallest overlap with a template of ``size`` words that meets the threshold."""
    return max(1, math.ceil(threshold * size - 1e-9))


def block_length(words: int, threshold: float) -> int:
    """Words of a block of a template of ``words`` words: as many as the template may be diluted to."""
    return max(words, math.floor(words / threshold + 1e-9))


def _phrase_places(words: str) -> str:
    """SQL: ``struct<at, label>`` for every place in the array ``words`` where a phrase starts."""
    found = []
    for phrase, label in PHRASES:
        first, *rest = phrase.split(" ")
        then = " AND ".join(f"coalesce(get({words}, i + {k}) = '{w}', false)" for k, w in enumerate(rest, 1))
        found.append(f"transform(filter(sequence(0, size({words}) - 1), i -> {words}[i] = '{first}' AND {then}), "
                     f"i -> named_struct('at', cast(i as bigint), 'label', '{label}'))")
    return f"concat({', '.join(found)})"


def base_scan(docs: DataFrame, vocabulary: Sequence[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``row_id, text_key, n_words``, the phrase places, and which words of the vocabulary the text has."""
    text = docs.select(F.col(id_col).alias("row_id"), common.text_or_empty(text_col).alias("text"))
    words = f"array_remove(split({{}}, '{SEPARATORS.replace(chr(92), chr(92) * 2)}', -1), '')"
    # Only counts and frequencies use lower(), which folds more than A-Z but splits no word differently.
    whole = (f"transform(array({words.format('lower(text)')}), w -> named_struct('n_words', cast(size(w) as bigint), "
             f"'present', array_intersect(array({_quoted(vocabulary)}), w)))[0]")
    gap = "[^0-9a-z" + "\\x{80}-\\x{10FFFF}]+"
    maybe = "(?i)" + "|".join(phrase.replace(" ", gap) for phrase, _ in PHRASES)
    exact = words.format(f"translate(text, '{UPPER}', '{UPPER.lower()}')")
    places = (f"CASE WHEN text RLIKE '{maybe.replace(chr(92), chr(92) * 2)}' "
              f"THEN transform(array({exact}), w -> {_phrase_places('w')})[0] "
              "ELSE cast(array() as array<struct<at:bigint,label:string>>) END")
    return text.select("row_id", F.xxhash64("text").alias("text_key"), F.expr(whole).alias("whole"), F.expr(places).alias("places")).select(
        "row_id", "text_key", "whole.n_words", "whole.present", "places")


def word_order(scanned: DataFrame, vocabulary: Sequence[str]) -> list[str]:
    """The template words by the number of documents that have them, rare ones first (at most the vocabulary's size)."""
    n = {r["word"]: r["n"] for r in scanned.select(F.explode("present").alias("word")).groupBy("word").agg(
        F.count(F.lit(1)).alias("n")).collect()}
    return sorted(vocabulary, key=lambda w: (n.get(w, 0), w))


def containment_join(docs: DataFrame, order: Sequence[str], templates: Sequence[Template] = TEMPLATES,
                     threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every (block, template) pair that matches: ``row_id, text_key, first_word, label, containment``.

    A block that several shared words lead to comes once for each of them.
    """
    spark = docs.sparkSession
    rank = {w: i for i, w in enumerate(order)}
    sets = []
    for t in templates:
        own = _words(t.text)
        if own:
            ranked = sorted(set(own), key=rank.__getitem__)
            sets.append((t, ranked, need(len(ranked), threshold), block_length(len(own), threshold)))
    longest = max((length for *_, length in sets), default=1)
    prefix = sorted({w for _, words, least, _ in sets for w in words[:len(words) - least + 1]}, key=rank.__getitem__)
    strings = lambda values: f"cast(array({_quoted(values)}) as array<string>)"
    # one row per template and prefix word: bounded by the templates
    index = [f"named_struct('word', '{w}', 'place', {i}, 'need', {least}, 'size', {len(words)}, 'label', '{t.label}', 'length', {length}, "
             f"'words', {strings(words)}, 'must', {strings(t.must)}, 'never', {strings(t.never)})"
             for t, words, least, length in sets for i, w in enumerate(words[:len(words) - least + 1], 1)]
    shape = "word:string,place:int,need:int,size:int,label:string,length:int,words:array<string>,must:array<string>,never:array<string>"
    entries = spark.range(1).select(F.inline(F.expr(f"array({', '.join(index)})" if index else f"cast(array() as array<struct<{shape}>>)")))
    letter = "[0-9A-Za-z\\x{80}-\\x{10FFFF}]"
    some = f"(?<!{letter})(?i:{'|'.join(prefix) if prefix else '(?!)'})(?!{letter})"
    texts = docs.select(F.col(id_col).alias("row_id"), common.text_or_empty(text_col).alias("text")).where(F.col("text").rlike(some))
    split = F.array_remove(F.split(F.translate("text", UPPER, UPPER.lower()), SEPARATORS, -1), "")
    # the places of prefix words, each with the words that a block around it can have
    around = lambda w, i: F.struct(
        w[i].alias("word"), F.greatest(i - longest + 1, F.lit(0)).alias("from"),
        F.slice(w, F.greatest(i - longest + 1, F.lit(0)) + 1, F.lit(2 * longest - 1)).alias("region"), i.alias("i"))
    hits = F.transform(F.array(split), lambda w: F.transform(
        F.filter(F.sequence(F.lit(0), F.greatest(F.size(w) - 1, F.lit(0))), lambda i: F.get(w, i).isin(prefix)), lambda i: around(w, i)))[0]
    found = texts.select("row_id", F.xxhash64("text").alias("text_key"), F.inline(hits))
    pairs = found.join(F.broadcast(entries), "word").where(F.size(F.array_intersect("region", "words")) >= F.col("need"))
    # the blocks of the template that hold the place: they begin with a template word
    at = F.col("i") - F.col("from")
    starts = F.filter(F.sequence(F.greatest(at - F.col("length") + 1, F.lit(0)), at), lambda k: F.array_contains("words", F.get("region", k)))
    blocks = pairs.withColumn("start", F.explode(starts)).withColumn("block", F.slice("region", F.col("start") + 1, F.col("length")))
    known = F.array_intersect(F.array(*[F.lit(w) for w in order]), "block")  # in word order
    placed = blocks.withColumn("known", known).withColumn("at", F.array_position("known", "word").cast("int"))
    size = F.size("known")
    kept = placed.where(
        (size >= F.col("need"))  # length
        & (F.col("at") <= size - F.col("need") + 1)  # prefix, of the block; the index has the template's
        & (1 + F.least(size - F.col("at"), F.col("size") - F.col("place")) >= F.col("need")))  # positional
    shared = F.size(F.array_intersect("known", "words"))
    met = kept.withColumn("shared", shared).where(
        (F.col("shared") >= F.col("need")) & (F.size(F.array_except("must", "block")) == 0) & ~F.arrays_overlap("never", "block"))
    return met.select("row_id", "text_key", (F.col("from") + F.col("start")).alias("first_word"), "label",
                      (F.col("shared").cast("double") / F.col("size")).alias("containment"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: Sequence[Template] = TEMPLATES,
         threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: the id, word count, phrase places, base labels, all labels and the score.

    * The score is 1 where a phrase stands, else the best containment that meets the threshold, else 0.
    * A null or empty text has no words and no labels. Rows that repeat come back as often; a null id is an id.
    * Only the id and the text are read, whatever other columns there are; an empty table gives an empty result.
    """
    vocabulary = sorted({w for t in templates for w in _words(t.text)})
    scanned = common.written(base_scan(docs, vocabulary, id_col, text_col), "license-base")
    hits = containment_join(docs, word_order(scanned, vocabulary), templates, threshold, id_col, text_col)
    per_text = hits.groupBy("row_id", "text_key").agg(F.collect_set("label").alias("found"), F.max("containment").alias("best")).select(
        F.col("row_id").alias("hit_id"), F.col("text_key").alias("hit_key"), "found", "best")
    joined = scanned.join(per_text, F.col("row_id").eqNullSafe(F.col("hit_id")) & (F.col("text_key") == F.col("hit_key")), "left")
    at: Column = F.transform("places", lambda p: p["at"])
    base = F.array_distinct(F.transform("places", lambda p: p["label"]))
    none = F.array().cast("array<string>")
    return joined.select(
        F.col("row_id").alias(id_col), "n_words", F.size("places").cast("bigint").alias("n_base"),
        F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.coalesce("found", none))), ",").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"))


def op9_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents"))


def _oracle() -> str:
    """Every block of every template, and every word place against every phrase."""
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    listed = lambda values: f"CAST([{_quoted(values)}] AS VARCHAR[])"
    values = ", ".join(
        f"({i}, '{t.label}', {listed(sorted(set(_words(t.text))))}, {need(len(set(_words(t.text))), THRESHOLD)}, "
        f"{block_length(len(_words(t.text)), THRESHOLD)}, {listed(t.must)}, {listed(t.never)})" for i, t in enumerate(TEMPLATES))
    phrases = ", ".join(f"('{label}', [{_quoted(p.split(' '))}])" for p, label in PHRASES)
    return f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}') AS text FROM documents),
w AS MATERIALIZED (SELECT id, doc_id, regexp_extract_all(text, '{word}') AS w FROM d),
t(t, label, words, need, length, must, never) AS (VALUES {values}),
p(label, words) AS (VALUES {phrases}),
places AS (
  SELECT id, label, unnest(list_filter(range(0, len(w)), lambda i: w[i + 1:i + len(words)] = words)) AS place FROM w, p),
base AS (SELECT id, count(*) AS n, min(place) AS a, max(place) AS b, list(DISTINCT label) AS ls FROM places GROUP BY id),
pairs AS (SELECT id, w, t.* FROM w, t WHERE len(list_intersect(list_distinct(w), words)) >= need),
starts AS (SELECT id, w, t, unnest(list_filter(range(0, len(w)), lambda i: list_contains(words, w[i + 1]))) AS i FROM pairs),
blocks AS (SELECT id, label, words, need, must, never, w[i + 1:i + length] AS b FROM starts JOIN t USING (t)),
hits AS (
  SELECT id, label, len(list_intersect(list_distinct(b), words))::DOUBLE / len(words) AS c FROM blocks
  WHERE len(list_intersect(list_distinct(b), words)) >= need AND list_has_all(b, must) AND NOT list_has_any(b, never)),
best AS (SELECT id, list(DISTINCT label) AS ls, max(c) AS c FROM hits GROUP BY id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(base.n, 0)::BIGINT AS n_base, base.a AS first_word, base.b AS last_word,
       array_to_string(list_sort(coalesce(base.ls, [])), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(base.ls, []), coalesce(best.ls, [])))), ',') AS labels,
       CASE WHEN base.n > 0 THEN 1.0::DOUBLE ELSE coalesce(best.c, 0.0) END AS score
FROM w LEFT JOIN base USING (id) LEFT JOIN best USING (id)
"""


ORACLE_SQL = _oracle()
