"""License scans: exact set-similarity join of text blocks with license templates; DataFrame and SQL functions only.

A text is split into words once, so line feeds, comment signs and punctuation inside a notice do not matter. Its blocks for
templates of up to L words (L: a power of two) are the windows of 2 L words that begin at every L-th word: each run of up
to L words lies in one of them. A template is in a block when the block holds the share ``CONTAINMENT`` of its distinct words.

Words of the templates are ordered by the number of documents that hold them, rarest first. With need = ceil(share * n) of a
template's n words wanted, the block must hold one of the template's first n - need + 1 words (prefix filter), must hold
need words of templates at all (length filter), and, when the word met is the i-th of the template and the j-th of the block's b,
min(i, j) + 1 + min(n - i, b - j) - 1 (places from 0) must reach need (positional filter). What is left is verified on full
sets. Fixed phrases are counted beside that as the base labels.

Defined cases: null text is empty; empty text has no words, null places, no labels and score 0; repeated rows are rows of
their own; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CONTAINMENT = 0.8
#: Words of the shortest length class of templates; the others double.
SHORTEST = 8

#: Phrases whose words stand consecutively, and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Notices and paragraphs of public licenses, lower-cased and without punctuation, and their labels.
TEMPLATES = [
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("this work is licensed under the gnu general public license version 2", "gpl-2"),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
        "gpl",
    ),
    (
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a "
        "particular purpose see the gnu general public license for more details",
        "gpl",
    ),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at "
        "http www apache org licenses license 2 0",
        "apache-2.0",
    ),
    (
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions "
        "of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
        "apache-2.0",
    ),
    ("released under the mit license", "mit"),
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software "
        "without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
        "persons to whom the software is furnished to do so subject to the following conditions",
        "mit",
    ),
    (
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular "
        "purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort "
        "or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
        "mit",
    ),
    (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this "
        "permission notice appear in all copies",
        "isc",
    ),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    (
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other "
        "materials provided with the distribution",
        "bsd",
    ),
    (
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific "
        "prior written permission",
        "bsd-3",
    ),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("licensed under cc by 4 0", "cc-by-4.0"),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by-4.0"),
    ("this work is licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa-4.0"),
]


def lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """Words of a lower-cased text in order."""
    return F.array_remove(F.split(text, GAP), "")


def phrase_places(words: str, phrase: str) -> Column:
    """Word places where the phrase starts. ``words`` names a column: an expression would be evaluated anew for each place."""
    want = phrase.split()
    at = lambda i: reduce(lambda a, b: a & b, [F.get(words, i + k) == w for k, w in enumerate(want)])
    starts = F.when(F.size(words) >= len(want), F.sequence(F.lit(0), F.size(words) - len(want)))
    return F.filter(starts, at)


def length_class(template: str) -> int:
    """The L of a template: the least power of two, SHORTEST at least, that its words do not exceed."""
    return max(SHORTEST, 1 << (len(template.split()) - 1).bit_length())


def need_of(n: int, threshold: float) -> int:
    return math.ceil(threshold * n - 1e-9)


def token_order(docs: DataFrame, vocabulary: list[str]) -> list[str]:
    """The vocabulary by the number of rows that hold each word, rarest first. One pass over all rows with map-side sums; only
    counts of the templates' own words come to the driver."""
    each = docs.select(F.explode(F.array_intersect("words", F.lit(vocabulary))).alias("token"))
    counts = {r[0]: r[1] for r in each.groupBy("token").count().collect()}
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def similarity_join(docs: DataFrame, key: list[str], templates: list[tuple[str, str]], threshold: float = CONTAINMENT) -> DataFrame:
    """key columns, label, score: every (row, template) pair whose containment in some block meets the threshold. ``docs`` has
    the key columns and ``words``."""
    spark = docs.sparkSession
    order = token_order(docs, sorted({w for t, _ in templates for w in t.split()}))
    rank = {w: i for i, w in enumerate(order)}
    index = []
    for i, (t, label) in enumerate(templates):
        ranked = sorted(set(t.split()), key=rank.__getitem__)
        need = need_of(len(ranked), threshold)
        index += [(length_class(t), w, i, label, p, need, ranked) for p, w in enumerate(ranked[: len(ranked) - need + 1])]
    prefixes = {size: F.lit(sorted({r[1] for r in index if r[0] == size})) for size in sorted({r[0] for r in index})}

    def blocks(size: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - size), F.lit(size))
        cut = F.transform(starts, lambda s: F.struct(F.lit(size).alias("size"), F.slice("words", s, F.lit(2 * size)).alias("block")))
        return F.when(F.arrays_overlap("words", prefixes[size]), F.filter(cut, lambda x: F.arrays_overlap(x["block"], prefixes[size])))

    none = F.array().cast("array<struct<size:int,block:array<string>>>")
    held = (
        docs.where(F.arrays_overlap("words", F.lit(sorted({r[1] for r in index}))))
        .select(*key, F.explode(F.concat(*[F.coalesce(blocks(size), none) for size in prefixes])).alias("_at"))
        # the literal comes first, so a block's words stand in the global order
        .select(*key, "_at.size", F.array_intersect(F.lit(order), F.col("_at.block")).alias("block"))
        .where(F.size("block") >= min(r[5] for r in index))
        .select(*key, "size", "block", F.posexplode("block").alias("j", "token"))
    )
    of = spark.createDataFrame(index, "size int, token string, template int, label string, i int, need int, ranked array<string>")
    i, j, n, b = F.col("i"), F.col("j"), F.size("ranked"), F.size("block")
    reach = F.least(i, j) + 1 + F.least(n - i - 1, b - j - 1)
    pairs = held.join(F.broadcast(of), ["size", "token"]).where((b >= F.col("need")) & (reach >= F.col("need")))  # the templates' prefixes: a few rows
    shared = F.size(F.array_intersect("block", "ranked"))
    return pairs.withColumn("shared", shared).where("shared >= need").groupBy(*key, "label").agg(F.max(F.col("shared") / n).alias("score"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id with word counts, base places and labels, and all labels and the best containment."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text).alias("key"), lower(text).alias("low")).withColumn("words", words_of(F.col("low")))
    phrases = sorted(BASE.items(), key=lambda x: x[1])
    # a text without one of a phrase's words is not looked through
    may = [reduce(lambda a, b: a & b, [F.contains("low", F.lit(w)) for w in sorted(p.split(), key=len, reverse=True)]) for p, _ in phrases]
    at = [F.col(f"at_{i}") for i in range(len(phrases))]
    no_places, no_labels = F.array().cast("array<int>"), F.array().cast("array<string>")
    found = rows.select(
        "doc_id", "key", F.size("words").cast("long").alias("n_words"), *(F.coalesce(F.when(m, phrase_places("words", p)), no_places).alias(f"at_{i}") for i, (m, (p, _)) in enumerate(zip(may, phrases, strict=True)))
    )
    base = found.select(
        "doc_id",
        "key",
        "n_words",
        F.concat(*at).alias("places"),
        F.array_compact(F.array(*[F.when(F.size(c) > 0, F.lit(label)) for c, (_, label) in zip(at, phrases, strict=True)])).alias("base"),
    )
    matched = (
        similarity_join(rows.select("doc_id", "key", "words"), ["doc_id", "key"], TEMPLATES)
        .groupBy("doc_id", "key")
        .agg(F.collect_set("label").alias("more"), F.max("score").alias("best"))
        .select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "more", "best")
    )
    both = base.join(matched, base["doc_id"].eqNullSafe(matched["_id"]) & (base["key"] == matched["_key"]), "left")
    line = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return both.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"),
        line(F.col("base")).alias("base_labels"),
        line(F.concat("base", F.coalesce("more", no_labels))).alias("labels"),
        F.coalesce("best", F.lit(0.0)).alias("score"),
    )


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    """The same result without filters: every block of every text against every template of its class."""
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    templates = ",\n  ".join(f"({length_class(t)}, '{label}', {quoted(sorted(set(t.split())))}, {need_of(len(set(t.split())), CONTAINMENT)})" for t, label in TEMPLATES)
    phrases = ", ".join(f"('{label}', {quoted(p.split())})" for p, label in BASE.items())
    return rf"""
WITH w AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(COALESCE(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
p(label, phrase) AS (VALUES {phrases}),
b AS (SELECT r, label, i FROM (SELECT r, words, label, phrase, unnest(range(1, len(words) + 1)) AS i FROM w JOIN p ON list_has_all(words, phrase)) x
  WHERE words[i:i + len(phrase) - 1] = phrase),
base AS (SELECT r, COUNT(*) AS n_base, MIN(i) - 1 AS first_word, MAX(i) - 1 AS last_word, list(DISTINCT label) AS labels FROM b GROUP BY r),
t(size, label, words, need) AS (VALUES
  {templates}),
s AS (SELECT DISTINCT size FROM t),
k AS (SELECT r, size, words[i:i + 2 * size - 1] AS block FROM (SELECT r, words, size, unnest(range(1, greatest(1, len(words) - size) + 1, size)) AS i FROM w, s) x),
m AS (SELECT r, label, CAST(len(list_intersect(t.words, k.block)) AS DOUBLE) / len(t.words) AS score, need, len(t.words) AS n FROM k JOIN t ON k.size = t.size AND list_has_any(k.block, t.words)),
f AS (SELECT r, list(DISTINCT label) AS labels, MAX(score) AS score FROM m WHERE score * n >= need - 1e-9 GROUP BY r)
SELECT doc_id, CAST(len(w.words) AS BIGINT) AS n_words, COALESCE(n_base, 0) AS n_base, first_word, last_word,
  COALESCE(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(COALESCE(base.labels, []), COALESCE(f.labels, [])))), ',') AS labels, COALESCE(score, 0) AS score
FROM w LEFT JOIN base ON w.r = base.r LEFT JOIN f ON w.r = f.r
"""


SQL = _sql()
