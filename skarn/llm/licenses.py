"""License scans by an exact set-similarity join, in DataFrame functions only.

Text blocks and license templates are sets of words.  A block is found for a
template when it contains at least ``THRESHOLD`` of the template's words.  Blocks
are lines and, with ``wrapped``, overlapping windows over the words of all lines
as well, so that a notice wrapped over lines is found: every run of as many words
as the longest template has lies within one window of twice as many.
The words of the templates are ordered by their frequency in all blocks, rarest
first.  The join then uses

* the prefix filter: with an overlap of at least o, block and template share a
  word among their first ``size - o + 1`` words in this order,
* the length filter: the block has at least o words of the templates,
* the positional filter: what is left after the first shared word must do,

and confirms each candidate on the full sets.  The templates are a parameter, so
their words, the one thing broadcast, do not grow with the corpus.

Beside it, given phrases are looked up as consecutive words.

Defined cases: null and empty texts have no words, places or labels and score 0;
repeated rows are judged alike; extra columns are ignored; an empty table gives
no rows; a text of any length is one array of words, read whole.
"""

from __future__ import annotations

import re
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import own, row_key, table

THRESHOLD = 0.9
WORD = "[0-9A-Za-z\\x{80}-\\x{10FFFF}]+"

#: Phrases and their labels.  Fixed values.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: License notices by label; public texts.
TEMPLATES = {
    "apache-2.0": ["Licensed under the Apache License, Version 2.0."],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0."],
    "cc-by-sa-4.0": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "gpl-3.0": ["This work is licensed under the GNU General Public License, version 3."],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
}


def template_words(templates: dict[str, list[str]]) -> list[tuple[str, frozenset[str]]]:
    words = lambda t: frozenset(re.findall(r"[0-9a-z\x80-\U0010FFFF]+", t.lower()))
    return [(label, words(t)) for label, texts in sorted(templates.items()) for t in texts]


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _literal(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def _block_sets(rows: DataFrame, text: Column, vocabulary: list[str], least: int) -> DataFrame:
    """Distinct words of the vocabulary in each line, in the vocabulary's order."""
    lines = rows.select(own("a"), own("b"), F.posexplode(F.split(text, "\n")).alias(own("line"), own("text")))
    held = F.array_intersect(_literal(vocabulary), _words(F.lower(own("text"))))
    sets = lines.filter(F.length(own("text")) >= 2 * least - 1).select(own("a"), own("b"), own("line"), held.alias(own("held")))
    return sets.filter(F.size(own("held")) >= least)


def _window_sets(rows: DataFrame, text: Column, vocabulary: list[str], least: int, span: int, some: list[str]) -> DataFrame:
    """As _block_sets, line -1, of windows of 2 * ``span`` words, one each ``span`` words.

    Only of texts of several lines that have one of the words ``some``.
    """
    several = rows.filter(F.contains(text, F.lit("\n")) & F.lower(text).rlike("|".join(some)))
    words = several.select(own("a"), own("b"), _words(F.lower(text)).alias(own("w")))
    starts = F.sequence(F.lit(0), F.greatest(F.size(own("w")) - 1 - span, F.lit(0)), F.lit(span))
    windows = words.select(own("a"), own("b"), F.explode(F.transform(starts, lambda i: F.slice(own("w"), i + 1, F.lit(2 * span)))).alias(own("w")))
    held = F.array_intersect(_literal(vocabulary), own("w"))
    sets = windows.select(own("a"), own("b"), F.lit(-1).alias(own("line")), held.alias(own("held")))
    return sets.filter(F.size(own("held")) >= least)


def frequency_order(rows: DataFrame, text: Column, vocabulary: list[str]) -> list[str]:
    """The templates' words by their number of blocks, rarest first."""
    counts = _block_sets(rows, text, vocabulary, 1).select(F.explode(own("held")).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    found = {r["w"]: r["n"] for r in counts.collect()}  # one row a template word at most
    return sorted(vocabulary, key=lambda w: (found.get(w, 0), w))


def find_templates(rows: DataFrame, text: Column, templates: dict[str, list[str]], threshold: float, wrapped: bool = False) -> DataFrame:
    """(a, b, line, label, containment) of every block that meets the threshold; line -1 is a window."""
    spark = rows.sparkSession
    known = template_words(templates)
    vocabulary = sorted(set().union(*[w for _, w in known]))
    needed = [ceil(threshold * len(w) - 1e-9) for _, w in known]
    order = frequency_order(rows, text, vocabulary)
    rank = {w: i for i, w in enumerate(order)}
    index, whole = [], []
    for (label, words), o in zip(known, needed, strict=True):
        in_order = sorted(words, key=rank.__getitem__)
        whole.append((len(whole), label, in_order, o))
        index += [(w, i, len(whole) - 1, o, len(words)) for i, w in enumerate(in_order[: len(words) - o + 1])]
    prefix = spark.createDataFrame(index, "w string, i int, template int, o int, size int")
    texts = spark.createDataFrame(whole, "template int, label string, words array<string>, o int").drop("o")
    least = min(needed)
    blocks = _block_sets(rows, text, order, least)
    some = sorted({w for w, *_ in index})
    if wrapped:
        span = max(len(re.findall(r"[0-9a-z\x80-\U0010FFFF]+", t.lower())) for texts_ in templates.values() for t in texts_)
        blocks = blocks.unionByName(_window_sets(rows, text, order, least, span, some))
    prefixes = _literal(some)
    # The block's prefix for the smallest overlap holds that of every larger one.
    firsts = F.slice(F.col(own("held")), F.lit(1), F.size(own("held")) - least + 1)
    near = blocks.filter(F.arrays_overlap(F.col(own("held")), prefixes))
    probes = near.select("*", F.posexplode(firsts).alias("j", "w"))
    held = F.size(own("held"))
    left = F.least(F.col("size") - F.col("i"), held - F.col("j"))
    pairs = probes.join(F.broadcast(prefix), "w").filter((held >= F.col("o")) & (F.col("j") <= held - F.col("o")) & (left >= F.col("o")))
    checked = pairs.join(F.broadcast(texts), "template")
    both = F.size(F.array_intersect(own("held"), "words"))
    found = checked.filter(both >= F.col("o"))
    return found.select(own("a"), own("b"), own("line"), "label", (both / F.col("size")).alias("containment")).distinct()


def base_places(words: Column, phrases: dict[str, str]) -> Column:
    """Places (word index, label) where a phrase stands."""
    n = F.size(words)

    def stands(parts: list[str]):
        def test(i: Column) -> Column:
            same = F.get(words, i) == parts[0]
            for k, w in enumerate(parts[1:], 1):
                same = same & (F.get(words, i + k) == w)
            return same

        return test

    def labelled(label: str):
        return lambda i: F.struct(i.alias("at"), F.lit(label).alias("label"))

    found = []
    for phrase, label in phrases.items():
        parts = phrase.split()
        starts = F.when(n >= len(parts), F.sequence(F.lit(0), n - len(parts))).otherwise(F.array().cast("array<int>"))
        found.append(F.transform(F.filter(starts, stands(parts)), labelled(label)))
    return F.concat(*found)


def scan_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    templates: dict[str, list[str]] | None = None,
    phrases: dict[str, str] | None = None,
    threshold: float = THRESHOLD,
    wrapped: bool = False,
) -> DataFrame:
    """One row a document: id, n_words, places (word, label), found (line, label, containment).

    ``wrapped``: notices that run over several lines are found too, as line -1.
    """
    templates, phrases = templates or TEMPLATES, phrases or PHRASES
    a, b = row_key(id_col, text_col)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col), text.alias(own("t")), a.alias(own("a")), b.alias(own("b")))
    found = find_templates(rows, F.col(own("t")), templates, threshold, wrapped)
    per_doc = found.groupBy(own("a"), own("b")).agg(F.sort_array(F.collect_set(F.struct(F.col(own("line")).alias("line"), "label", "containment"))).alias("found"))
    # A cheap test on the raw text: only what has a phrase's first words in a row is split for places.
    maybe = "(?i)" + "|".join("[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+".join(p.split()) for p in phrases)
    nothing = F.array().cast("array<struct<at:int,label:string>>")
    lowered = F.translate(F.when(F.col(own("t")).rlike(maybe), F.col(own("t"))).otherwise(""), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    base = rows.select(id_col, own("a"), own("b"), F.size(_words(F.col(own("t")))).cast("long").alias("n_words"), _words(lowered).alias(own("w")))
    places = F.when(F.size(own("w")) == 0, nothing).otherwise(base_places(F.col(own("w")), phrases))
    judged = base.select(id_col, own("a"), own("b"), "n_words", places.alias("places"))
    out = judged.join(per_doc, [own("a"), own("b")], "left")
    return out.select(id_col, "n_words", "places", F.coalesce("found", F.array().cast("array<struct<line:int,label:string,containment:double>>")).alias("found"))


def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"), wrapped=True)
    base = F.transform("places", lambda p: p["label"])
    mine = F.transform("found", lambda p: p["label"])
    at = F.transform("places", lambda p: p["at"].cast("long"))
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    best = F.coalesce(F.array_max(F.transform("found", lambda p: p["containment"])), F.lit(0.0))
    return scanned.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(at).alias("first_word"),
        F.array_max(at).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, mine)).alias("labels"),
        F.round(F.greatest(best, F.when(F.size("places") > 0, 1.0).otherwise(0.0)), 6).alias("score"),
    )


def _op8_sql() -> str:
    quote = lambda w: "'" + w + "'"
    rows = ", ".join(
        f"({i}, {quote(label)}, [{', '.join(map(quote, sorted(words)))}], {ceil(THRESHOLD * len(words) - 1e-9)})"
        for i, (label, words) in enumerate(template_words(TEMPLATES))
    )
    phrases = ", ".join(f"([{', '.join(map(quote, p.split()))}], {quote(label)})" for p, label in PHRASES.items())
    sep = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    lower = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    return rf"""
WITH docs AS (
    SELECT doc_id, coalesce(text, '') AS text,
           list_filter(regexp_split_to_array(translate(coalesce(text, ''), {lower}), '{sep}'), lambda w: w <> '') AS w
    FROM documents
), phrases(p, label) AS (VALUES {phrases}),
templates(t, label, words, o) AS (VALUES {rows}),
spots AS (SELECT doc_id, w, unnest(range(0, CAST(len(w) AS BIGINT))) AS i FROM docs),
places AS (
    SELECT doc_id, i, label FROM spots, phrases WHERE w[i + 1] = p[1] AND w[i + 1:i + len(p)] = p
), blocks AS (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs
), sets AS (
    SELECT doc_id, list_distinct(regexp_split_to_array(lower(line), '{sep}')) AS w FROM blocks
), found AS (
    SELECT doc_id, label, len(list_intersect(words, w)) / len(words) AS c
    FROM sets, templates WHERE len(list_intersect(words, w)) >= o
), labels AS (
    SELECT doc_id, label FROM places UNION SELECT doc_id, label FROM found
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words,
       (SELECT count(*) FROM places p WHERE p.doc_id = d.doc_id) AS n_base,
       (SELECT min(i) FROM places p WHERE p.doc_id = d.doc_id) AS first_word,
       (SELECT max(i) FROM places p WHERE p.doc_id = d.doc_id) AS last_word,
       coalesce((SELECT string_agg(DISTINCT label, ',' ORDER BY label) FROM places p WHERE p.doc_id = d.doc_id), '') AS base_labels,
       coalesce((SELECT string_agg(DISTINCT label, ',' ORDER BY label) FROM labels p WHERE p.doc_id = d.doc_id), '') AS labels,
       round(CAST(greatest(coalesce((SELECT max(c) FROM found f WHERE f.doc_id = d.doc_id), 0),
                CASE WHEN EXISTS (SELECT 1 FROM places p WHERE p.doc_id = d.doc_id) THEN 1 ELSE 0 END) AS DOUBLE), 6) AS score
FROM docs d
"""


OP8_SQL = _op8_sql()
