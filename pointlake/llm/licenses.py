"""License scans: phrases in place, and an exact set-similarity join of text blocks with license templates.

A block is a window of a document's words; windows overlap by half, and have twice the words of
the templates that they are compared with, so every passage as long as a template lies whole in
one. A template is found in a block that holds at least `threshold` of the template's distinct
words. Tokens are put in a global order, rarest in the corpus first; then

- prefix: a block that holds `need` of a template's `size` words holds one of the template's
  `size - need + 1` rarest, and one of them is among the block's own rarest, as many as it has
  beyond `need - 1`;
- length: a block with fewer than `need` template words can't hold enough;
- position: what is left behind the first common token on either side has to be enough.

What is left is counted. All is DataFrame functions, and no passage is lost to the filters.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointlake.llm.common import materialise

CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: The phrases and their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Public license notices. Longer forms of the phrases' licenses, and licenses that no phrase names.
TEMPLATES = (
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-nc", "This work is licensed under the Creative Commons Attribution NonCommercial 4.0 International License"),
    ("cc-by-sa", "This work is licensed under the Creative Commons Attribution ShareAlike 4.0 International License"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file"),
)


def lower_words(text: Column) -> Column:
    """The words of a text, with A to Z in lower case; null is empty."""
    lowered = F.translate(F.coalesce(text, F.lit("")), CAPITALS, SMALL)
    return F.filter(F.split(lowered, WORD_BREAK), lambda w: w != "")


@dataclass(frozen=True)
class Template:
    label: str
    tokens: frozenset[str]
    words: int  # with repeats

    @staticmethod
    def of(label: str, text: str) -> Template:
        words = "".join(c if c.isascii() and c.isalnum() or ord(c) > 0x7F else " " for c in text.translate(str.maketrans(CAPITALS, SMALL))).split()
        if not words:
            raise ValueError("a template without words")
        return Template(label, frozenset(words), len(words))


def token_order(words: DataFrame, tokens: list[str]) -> list[str]:
    """The tokens, those in fewest documents first. words: `words`, an array. The result is as long as the templates' vocabulary."""
    wanted = F.array(*[F.lit(t) for t in tokens])
    held = words.select(F.explode(F.array_intersect(wanted, "words")).alias("token")).groupBy("token").count()
    counts = {r["token"]: r["count"] for r in held.collect()}  # one row a token of the templates
    return sorted(tokens, key=lambda t: (counts.get(t, 0), t))


def scan_licenses(
    docs: DataFrame,
    phrases: tuple[tuple[str, str], ...] = PHRASES,
    templates: tuple[tuple[str, str], ...] = TEMPLATES,
    threshold: float = 0.8,
) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score.

    docs: doc_id and text; other columns aren't looked at. n_base counts the places where a
    phrase's words stand one after another, first_word and last_word are the smallest and largest
    of their starts (null without one). base_labels are the phrases' labels, labels those and the
    templates', each distinct, sorted and joined by commas (empty without one). score is 1 with a
    phrase, else the largest share of a template's words that a block holds, 0 below the threshold.

    Null and empty texts have no words and no labels. Repeated rows and doc_ids, null ones too,
    have a row each. phrases and templates (not empty, and short of some hundred thousand words)
    are parameters, and all that is broadcast is made of them.
    """
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = text.select("doc_id", F.coalesce("doc_id", F.lit(0).cast("long")).alias("id"), F.xxhash64("text").alias("key"), lower_words(F.col("text")).alias("words"))
    known = [Template.of(*t) for t in templates]
    order = token_order(rows, sorted({t for x in known for t in x.tokens}))
    rank = {t: i for i, t in enumerate(order)}

    index = []  # the templates' prefixes: at most a row a template word
    for number, t in enumerate(known):
        need = max(1, ceil(threshold * len(t.tokens) - 1e-9))
        tokens = sorted(t.tokens, key=rank.__getitem__)
        index += [(tokens[i], number, 2 * t.words, t.label, tokens, need, i) for i in range(len(tokens) - need + 1)]
    schema = "token string, template int, width int, label string, template_tokens array<string>, need int, template_at int"
    prefixes = F.broadcast(docs.sparkSession.createDataFrame(index, schema))

    def blocks(width: int) -> Column:
        """Blocks of a width as the template words they hold, rarest first. A text without a prefix token has none."""
        mine = [i for i in index if i[2] == width]
        used = {t for i in mine for t in i[4]}
        rare, least = _strings(sorted({i[0] for i in mine})), min(i[5] for i in mine)
        starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.size("words") / (width // 2)).cast("int") - 2, F.lit(0)))
        held = F.transform(starts, lambda b: F.array_intersect(_strings([t for t in order if t in used]), F.slice("words", b * (width // 2) + 1, width)))
        some = F.transform(F.filter(held, lambda h: F.size(h) >= least), lambda h: F.struct(F.lit(width).alias("width"), h.alias("tokens")))
        return F.when(F.arrays_overlap("words", rare), some).otherwise(F.array().cast("array<struct<width:int,tokens:array<string>>>"))

    widths = sorted({i[2] for i in index})
    places = F.concat(*[_places(phrase.split(), label) for phrase, label in phrases])
    scanned = rows.select(
        "doc_id", "id", "key", F.size("words").cast("long").alias("n_words"), places.alias("places"), F.flatten(F.array(*map(blocks, widths))).alias("blocks")
    )
    scanned = materialise(scanned, "license-blocks")  # texts are split once; blocks are few

    tokens = scanned.select("id", "key", F.explode("blocks").alias("b")).select("id", "key", "b.width", "b.tokens", F.posexplode("b.tokens").alias("block_at", "token"))
    size, behind = F.size("tokens"), F.least(F.size("tokens") - F.col("block_at"), F.size("template_tokens") - F.col("template_at"))
    near = (size >= F.col("need")) & (F.col("block_at") <= size - F.col("need")) & (behind >= F.col("need"))
    met = tokens.join(prefixes, ["width", "token"]).where(near)
    held = met.withColumn("held", F.size(F.array_intersect("tokens", "template_tokens"))).where("held >= need")
    found = held.groupBy("id", "key").agg(F.collect_set("label").alias("found"), F.max(F.col("held") / F.size("template_tokens")).alias("share"))

    at = F.transform("places", lambda p: p["at"].cast("long"))
    base = F.array_distinct(F.transform("places", lambda p: p["label"]))
    labels = F.array_union(base, F.coalesce("found", F.array().cast("array<string>")))
    joined = lambda names: F.array_join(F.array_sort(names), ",")
    return scanned.join(found, ["id", "key"], "left").select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"),
        joined(base).alias("base_labels"), joined(labels).alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _places(phrase: list[str], label: str) -> Column:
    """Where the words of a phrase stand in `words`: at (from 0) and label."""
    none = F.array().cast("array<struct<at:int,label:string>>")
    all_there = F.size("words") >= len(phrase)
    for w in sorted(set(phrase), key=len, reverse=True):
        all_there = all_there & F.array_contains("words", w)

    def here(i: Column) -> Column:
        same = F.get("words", i) == phrase[0]
        for j, w in enumerate(phrase[1:], 1):
            same = same & (F.get("words", i + j) == w)
        return same

    starts = F.filter(F.sequence(F.lit(0), F.size("words") - len(phrase)), here)
    return F.when(all_there, F.transform(starts, lambda i: F.struct(i.alias("at"), F.lit(label).alias("label")))).otherwise(none)


def scan_sql(phrases: tuple[tuple[str, str], ...] = PHRASES, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = 0.8) -> str:
    """DuckDB SQL of `scan_licenses` over documents: every block against every template, without filters."""
    known = [Template.of(*t) for t in templates]
    words = lambda w: "[" + ", ".join("'" + x + "'" for x in w) + "]"
    phrase_rows = ", ".join(f"({words(p.split())}, '{label}')" for p, label in phrases)
    template_rows = ", ".join(f"({words(sorted(t.tokens))}, '{t.label}', {t.words}, {max(1, ceil(threshold * len(t.tokens) - 1e-9))})" for t in known)
    return rf"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{CAPITALS}', '{SMALL}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), phrases AS (
  SELECT * FROM (VALUES {phrase_rows}) AS p(phrase, label)
), templates AS (
  SELECT * FROM (VALUES {template_rows}) AS t(tokens, label, step, need)
), places AS (
  SELECT rid, place, label FROM (SELECT rid, w, unnest(range(len(w))) AS place FROM docs) AS d, phrases
  WHERE w[place + 1] = phrase[1] AND list_slice(w, place + 1, place + len(phrase)) = phrase
), base AS (
  SELECT rid, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list(DISTINCT label) AS base_labels FROM places GROUP BY rid
), blocks AS (
  SELECT rid, label, tokens, need, list_slice(w, b * step + 1, b * step + 2 * step) AS part
  FROM (SELECT rid, w, label, tokens, step, need, unnest(range(greatest(CAST(ceil(len(w) / step) AS BIGINT) - 1, 1))) AS b FROM docs, templates) AS x
), held AS (
  SELECT rid, label, need, len(list_intersect(tokens, part)) AS held, len(tokens) AS size FROM blocks
), found AS (
  SELECT rid, list(DISTINCT label) AS found, max(held / size) AS share FROM held WHERE held >= need GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
  CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  array_to_string(list_sort(coalesce(base_labels, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base_labels, []), coalesce(found, [])))), ',') AS labels,
  CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0.0) END AS score
FROM docs LEFT JOIN base USING (rid) LEFT JOIN found USING (rid)
"""
