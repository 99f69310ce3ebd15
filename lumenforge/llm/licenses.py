"""Operator 7, licence scans: Dice coefficient over word bigrams against licence templates, native expressions only.

Units are the lines of a text, the text as a whole, and runs of words that stand as a template would: at every template
bigram with an anchor word begins, or began so many words before, a run of as many words as the template has, so notices
wrapped over lines or inside longer lines are found. Text is lower-cased and everything but letters and digits is
white space. A unit is compared with the templates whose number of bigrams is within the bounds that the threshold
sets (Dice >= t needs |A| >= t / (2 - t) |B| and the reverse); before that, a unit must hold one of the anchor words,
which are chosen so that no unit without one can reach the threshold. All of it is row-local: no shuffle, no Python.

Defined cases: a null or empty text has no match; ties go to the earlier licence by name, then the earlier line; the
whole text has line -1, a run of words, of which only the best for each template counts, line -2 and comes last; equal texts
have equal results; texts of any length are scanned whole, and only the number of distinct bigrams bounds a unit; an empty
table gives an empty result; only doc_id and the columns made here are returned, so no column can clash.
"""

from __future__ import annotations

import re
from math import floor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, whole_text, with_schema

THRESHOLD = 0.75
#: Stands for the line of a run of words while matches are ordered.
LAST = 2**31

# fixed values: licence notices and texts
TEMPLATES: list[tuple[str, str]] = [
    ("all-rights-reserved", "All rights reserved."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("bsd-2-clause", "Released under the BSD 2-Clause License."),
    ("bsd-3-clause", "Released under the BSD 3-Clause License."),
    ("bsd-3-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("bsd-3-clause", 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("lgpl-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("mit", "Released under the MIT License."),
    ("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("mit", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
]
#: Words too common to be anchors, unless nothing else is left.
COMMON = frozenset("the a of to in and or is are be by with without this that it as at on for not all any you can was may an no if from".split())


def words(text: str) -> list[str]:
    return re.sub(r"[\W_]+", " ", text.lower()).split()


def sequence(text: str) -> list[str]:
    w = words(text)
    return [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]


def bigrams(text: str) -> list[str]:
    return list(dict.fromkeys(sequence(text)))


def anchored(text: str, chosen: list[str]) -> list[str]:
    """The bigrams in order, those without an anchor word replaced by an empty string."""
    return ["" if set(chosen).isdisjoint(g.split()) else g for g in sequence(text)]


def anchors(templates: list[tuple[str, str]], threshold: float) -> list[str]:
    """Words of which every unit that reaches the threshold with some template holds one: the words chosen for a
    template stand in so many of its bigrams that those left are fewer than the threshold asks for."""
    chosen: dict[str, None] = {}
    for _, text in templates:
        left = bigrams(text)
        most = len(left) * (1 - threshold / (2 - threshold))
        need = floor(most) + 1
        covered = sum(1 for g in left if not chosen.keys().isdisjoint(g.split()))
        rank = sorted(set(words(text)), key=lambda w: (w in COMMON, -sum(w in g.split() for g in left), w))
        for w in rank:
            if covered >= need:
                break
            if w not in chosen and any(w in g.split() for g in left):
                chosen[w] = None
                covered = sum(1 for g in left if not chosen.keys().isdisjoint(g.split()))
    return list(chosen)


def scan(df: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_matches, and of the best match license, dice and line (null without a match)."""
    templates = TEMPLATES if templates is None else templates
    chosen = anchors(templates, threshold)
    rows = sorted((name, bigrams(text), anchored(text, chosen)) for name, text in templates)
    listed = lambda g: "array(" + ", ".join(repr(x) for x in g) + ")"
    known = "array(" + ", ".join(f"named_struct('license', '{n}', 'n', {len(g)}, 'g', {listed(g)}, 'f', {listed(f)})" for n, g, f in rows) + ")"
    ratio = threshold / (2 - threshold)
    least = min(len(g) for _, g, _ in rows) * ratio
    pattern = r"(?<![a-z0-9])(?:" + "|".join(chosen) + r")(?![a-z0-9])"
    pairs = "transform(slice({0}, 2, greatest(size({0}) - 1, 0)), (x, i) -> concat({0}[i], ' ', x))"
    fits = f"size({{0}}) >= {ratio!r}D * k.n - 1e-9D AND k.n >= {ratio!r}D * size({{0}}) - 1e-9D"
    score = "-2.0D * size(array_intersect({0}, k.g)) / (size({0}) + k.n)"
    text = with_schema(df, ("doc_id", "long"), ("text", "string")).select("doc_id", F.regexp_replace(F.lower(whole_text()), r"[^\p{L}\p{N}\n]+", " ").alias("t"))
    # a text without an anchor is done after one pass of the pattern
    text = text.select("doc_id", F.when(F.col("t").rlike(pattern), F.col("t")).alias("t"))
    units = text.select("doc_id", "t", F.array_append(F.transform(F.split("t", "\n"), lambda x, i: F.struct(i.cast("long").alias("line"), F.trim(x).alias("t"))), F.struct(F.lit(-1).cast("long").alias("line"), F.trim(F.translate("t", "\n", " ")).alias("t"))).alias("u"))
    # words by counting blanks; then the anchor test of each unit
    within = F.filter("u", lambda u: (F.length(u["t"]) - F.length(F.replace(u["t"], F.lit(" "), F.lit(""))) >= floor(least)) & u["t"].rlike(pattern))
    split = units.select("doc_id", F.transform(within, lambda u: F.struct(u["line"].alias("line"), F.split(u["t"], " +").alias("w"))).alias("u"), F.split(F.trim(F.translate("t", "\n", " ")), " +").alias("w"))
    grams = split.select("doc_id", F.expr(f"transform(u, u -> named_struct('line', u.line, 'g', array_distinct({pairs.format('u.w')})))").alias("u"), F.expr(pairs.format("w")).alias("b"))
    starts = "array_distinct(transform(filter(transform(b, (g, p) -> named_struct('p', p, 'q', array_position(k.f, g))), x -> x.q > 0), x -> greatest(0L, x.p + 1L - x.q)))"
    runs = f"transform(filter(transform({starts}, s -> array_distinct(slice(b, cast(s + 1 AS int), size(k.f)))), r -> {fits.format('r')}), r -> {score.format('r')})"
    found = grams.select(
        "doc_id",
        F.expr(f"flatten(transform(u, u -> transform(filter({known}, k -> {fits.format('u.g')}), k -> named_struct('score', {score.format('u.g')}, 'license', k.license, 'line', u.line))))").alias("m"),
        F.expr(f"transform({known}, k -> named_struct('score', array_min({runs}), 'license', k.license, 'line', {LAST}L))").alias("r"),
    ).select("doc_id", F.filter(F.concat("m", F.when(F.col("m").isNotNull(), F.col("r"))), lambda m: m["score"] <= F.lit(-threshold)).alias("m"))
    best = F.array_min("m")
    line = F.when(best["line"] == LAST, F.lit(-2)).otherwise(best["line"])
    return found.select("doc_id", F.coalesce(F.size("m"), F.lit(0)).cast("long").alias("n_matches"), best["license"].alias("license"), F.round(-best["score"], 6).alias("dice"), line.cast("long").alias("line"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def oracle() -> str:
    """The same by unnesting every line, and every run of words, against every template, without pruning of units."""
    chosen = anchors(TEMPLATES, THRESHOLD)
    listed = lambda g: "[" + ", ".join(repr(x) for x in g) + "]"
    values = ", ".join(f"('{n}', {i}, {listed(bigrams(t))}, {listed(anchored(t, chosen))})" for i, (n, t) in enumerate(TEMPLATES))
    return f"""
WITH k(license, i, g, f) AS (VALUES {values}),
d AS (SELECT doc_id, regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g') AS t FROM documents),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS s, generate_subscripts(string_split(t, chr(10)), 1) - 1 AS line FROM d
      UNION ALL SELECT doc_id, replace(t, chr(10), ' '), -1 FROM d),
w AS (SELECT doc_id, line, list_filter(string_split_regex(trim(s), ' +'), lambda x: x <> '') AS w FROM l),
a AS (SELECT doc_id, line, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS b FROM w WHERE len(w) >= 2),
u AS (SELECT doc_id, line, list_distinct(b) AS g FROM a),
p AS (SELECT doc_id, unnest(b) AS g, generate_subscripts(b, 1) AS p FROM a WHERE line = -1),
q AS (SELECT i, unnest(list_distinct(list_filter(f, lambda x: x <> ''))) AS g, f FROM k),
s AS (SELECT DISTINCT p.doc_id, q.i, greatest(0, p.p - list_position(q.f, q.g)) AS s FROM p JOIN q ON p.g = q.g),
r AS (SELECT s.doc_id, k.license, k.g AS kg, k.i, list_distinct(list_slice(a.b, s.s + 1, s.s + len(k.f))) AS g FROM s JOIN k ON s.i = k.i JOIN a ON a.doc_id = s.doc_id AND a.line = -1),
m AS (SELECT doc_id, line, license, 2.0 * len(list_intersect(u.g, k.g)) / (len(u.g) + len(k.g)) AS dice FROM u JOIN k ON len(u.g) * 5 >= len(k.g) * 3 AND len(k.g) * 5 >= len(u.g) * 3
      UNION ALL SELECT doc_id, {LAST}, license, max(2.0 * len(list_intersect(g, kg)) / (len(g) + len(kg))) FROM r WHERE len(g) * 5 >= len(kg) * 3 AND len(kg) * 5 >= len(g) * 3 GROUP BY doc_id, license, i),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, license, line) AS rn, count(*) OVER (PARTITION BY doc_id) AS n FROM m WHERE dice >= {THRESHOLD})
SELECT d.doc_id, CAST(coalesce(o.n, 0) AS BIGINT) AS n_matches, o.license, round(o.dice, 6) AS dice, CAST(CASE WHEN o.line = {LAST} THEN -2 ELSE o.line END AS BIGINT) AS line FROM d LEFT JOIN o ON d.doc_id = o.doc_id AND o.rn = 1
"""
