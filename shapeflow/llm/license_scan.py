"""License scans: an exact set-similarity join of text blocks with license templates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shapeflow.llm.common import documents, lower_ascii, store

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: (words, label, base). The base phrases, then notices and bodies of public licenses.
TEMPLATES = (
    ("gnu general public license", "gpl", True),
    ("apache license", "apache", True),
    ("cc by", "cc-by", True),
    ("mit license", "mit", True),
    ("licensed under the apache license version 2 0", "apache-2.0", False),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0", False),
    ("released under the mit license", "mit-notice", False),
    ("this work is licensed under the gnu general public license version 3", "gpl-3", False),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by-4.0", False),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit-text", False),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd-text", False),
    ("this source code form is subject to the terms of the mozilla public license", "mpl-text", False),
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software"
        " to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense"
        " and or sell copies of the software", "mit-body", False,
    ),
    (
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability"
        " fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages"
        " or other liability", "mit-warranty", False,
    ),
    (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above"
        " copyright notice and this permission notice appear in all copies", "isc-text", False,
    ),
    (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
        " redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "bsd-body", False,
    ),
    (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain"
        " a copy of the license at http www apache org licenses license 2 0", "apache-header", False,
    ),
    (
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without"
        " warranties or conditions of any kind either express or implied", "apache-warranty", False,
    ),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by"
        " the free software foundation either version 3 of the license or at your option any later version", "gpl-header", False,
    ),
    (
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file"
        " you can obtain one at", "mpl-body", False,
    ),
    (
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute"
        " this software", "unlicense", False,
    ),
)
#: Least share of a template's distinct words that a block must hold. Base phrases, and templates of fewer than
#: SHORT distinct words, need all: one word less would no longer name the license.
THRESHOLD, SHORT = 0.8, 10
#: Words from one block's start to the next one's.
STRIDE = 128


def words_needed(size: int, base: bool, threshold: float = THRESHOLD) -> int:
    return size if base or size < SHORT else math.ceil(threshold * size - 1e-9)


def _array(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def blocks_of(docs: DataFrame, vocabulary: list[str], phrases: list[list[str]], least: int, overlap: int) -> DataFrame:
    """(doc_id, row, n_words, start, held, words): the blocks that may meet a template, and each row's first one.

    A text's words are cut every STRIDE words, each block with the ``overlap`` that follows, so
    that a place of up to ``overlap`` + 1 words lies whole in the block it starts in; a text
    without words is one empty block. ``held`` are the block's distinct words of the
    vocabulary; blocks with fewer than ``least`` of them meet no template (length filter).
    ``words`` are kept where all words of one of the ``phrases`` are held. Texts are split
    here and nowhere else: the result is written once and read by all that follows, which
    also makes ``row`` the same for all of it.
    """
    text = lower_ascii(F.coalesce(F.col("text"), F.lit("")))
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("all"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("all") - 1, F.lit(0)), F.lit(STRIDE))
    blocks = rows.select("doc_id", "row", F.size("all").cast("long").alias("n_words"), "all", F.explode(starts).alias("at"))
    blocks = blocks.withColumn("words", F.slice("all", F.col("at") + 1, STRIDE + overlap)).withColumn("held", F.array_intersect("words", _array(vocabulary)))
    whole = F.lit(False)
    for phrase in phrases:
        whole = whole | (F.size(F.array_intersect("held", _array(phrase))) == len(set(phrase)))
    out = blocks.filter((F.col("at") == 0) | (F.size("held") >= least))
    return store(out.select("doc_id", "row", "n_words", F.col("at").cast("long").alias("start"), "held", F.when(whole, F.col("words")).alias("words")), "license-blocks")


def license_matches(docs: DataFrame, templates: tuple = TEMPLATES, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Blocks, and (row, start, label, base, containment, places) of every block that meets a template.

    Tokens are ordered by the number of blocks that hold them, rarest first, over the whole
    corpus. A block with ``need`` of a template's ``size`` words holds one of its first
    size - need + 1 (prefix filter), and at least ``need`` words that some template has
    (length filter); if its first common word stands at i in the template, size - i words
    must suffice (positional filter). What is left is counted exactly. The index holds the
    templates' prefixes, whose number is fixed by the templates, and is broadcast.
    """
    split = [(t.split(), label, base) for t, label, base in templates]
    overlap = max(len(w) for w, _, _ in split) - 1
    vocabulary = sorted({w for words, _, _ in split for w in words})
    least = min(words_needed(len(set(w)), base, threshold) for w, _, base in split)
    blocks = blocks_of(docs, vocabulary, [w for w, _, base in split if base], least, overlap)
    frequency = {r["token"]: r["count"] for r in blocks.select(F.explode("held").alias("token")).groupBy("token").count().collect()}  # one row for each template word at most
    order = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w)))}
    index = []
    for k, (words, label, base) in enumerate(split):
        tokens = sorted(set(words), key=order.__getitem__)
        need = words_needed(len(tokens), base, threshold)
        index += [(tokens[i], i, k, label, base, len(tokens), need, tokens, words) for i in range(len(tokens) - need + 1)]
    prefix = docs.sparkSession.createDataFrame(index, "token string, at int, template int, label string, base boolean, size int, need int, tokens array<string>, phrase array<string>")
    probes = F.array_intersect("held", _array(sorted({x[0] for x in index})))
    candidates = (
        blocks.select("row", "start", "words", "held", F.explode(probes).alias("token"))
        .join(F.broadcast(prefix), "token")
        .filter((F.size("held") >= F.col("need")) & (F.col("size") - F.col("at") >= F.col("need")))
        .withColumn("common", F.array_intersect("tokens", "held"))
        # a block meets a template once for each prefix word: the first common one stands for all
        .filter((F.size("common") >= F.col("need")) & (F.element_at("common", 1) == F.col("token")))
    )
    inside = F.least(F.lit(STRIDE), F.size("words"))
    places = F.filter(F.sequence(F.lit(1), inside), lambda i: F.slice(F.col("words"), i, F.size("phrase")) == F.col("phrase"))
    found = candidates.select("row", "start", "label", "base", (F.size("common") / F.col("size")).alias("containment"), F.when(F.col("base"), places).alias("places"))
    return blocks, found.filter(~F.col("base") | (F.size("places") > 0))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: one row for each input row.

    Base columns count the places where a base phrase's words stand one behind another;
    labels also has those of templates of which some block holds enough words; score is the
    largest containment met, 0 where none is. Null text counts as empty: no words, no labels.
    Rows are told apart by a number of their own, so ids may be null or repeat and repeated
    rows give repeated results. Extra columns are ignored; an empty table gives an empty result.
    """
    blocks, found = license_matches(docs)
    hits = found.groupBy("row").agg(
        F.sum(F.when(F.col("base"), F.size("places")).otherwise(0)).alias("n_base"),
        F.min(F.when(F.col("base"), F.col("start") + F.element_at("places", 1) - 1)).alias("first_word"),
        F.max(F.when(F.col("base"), F.col("start") + F.element_at("places", -1) - 1)).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("containment").alias("score"),
    )
    rows = blocks.filter("start = 0").select("doc_id", "row", "n_words")
    return rows.join(hits, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))


def _template_rows() -> str:
    def words(t: str) -> str:
        return "[" + ", ".join(f"'{w}'" for w in t.split()) + "]"

    return ", ".join(f"({words(t)}, list_distinct({words(t)}), '{label}', {str(base).lower()}, {words_needed(len(set(t.split())), base)})" for t, label, base in TEMPLATES)


_OVERLAP = max(len(t.split()) for t, _, _ in TEMPLATES) - 1
OP1_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
t(phrase, tokens, label, base, need) AS (VALUES {_template_rows()}),
b AS (SELECT doc_id, s AS start, w[s + 1 : s + {STRIDE + _OVERLAP}] AS words FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w), 1), {STRIDE})) AS s FROM d)),
m AS (SELECT doc_id, start, label, base, len(list_intersect(tokens, words)) / len(tokens) AS containment,
    CASE WHEN base THEN list_filter(range(1, least({STRIDE}, len(words)) + 1), lambda i : words[i : i + len(phrase) - 1] = phrase) END AS places
  FROM b, t WHERE len(list_intersect(tokens, words)) >= need),
h AS (SELECT doc_id, CAST(sum(CASE WHEN base THEN len(places) ELSE 0 END) AS BIGINT) AS n_base,
    min(CASE WHEN base THEN start + places[1] - 1 END) AS first_word, max(CASE WHEN base THEN start + places[-1] - 1 END) AS last_word,
    string_agg(DISTINCT CASE WHEN base THEN label END, ',' ORDER BY CASE WHEN base THEN label END) AS base_labels,
    string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(containment) AS score
  FROM m WHERE NOT base OR len(places) > 0 GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN h USING (doc_id)
"""
