r"""Operator 12: license scans by an exact set-similarity join; DataFrame functions only.

A text's words are the maximal runs of letters, digits and characters beyond
ASCII, with A-Z lowered.  Templates and phrases are configuration.  A template
is found in a block of words that holds at least ``threshold`` of its distinct
words, in any order; a phrase where its words stand consecutively.

Blocks: a template of m words is sought in blocks of 2h words, one from each
h-th word on, h being a power of two of at least m, so that any stretch of h
words lies whole in some block.  Only words that some template has are kept of a
text (with their places), as no others can be shared.

The join of blocks and templates orders words by the number of texts that hold
them, rarest first, over the whole table.  If a block and a template share the
``need`` words that the threshold asks for, then their prefixes, all but their
last ``need`` - 1 words in that order, share one, so

* only texts with a word of some template's prefix give blocks at all;
* a block's prefix words fetch the templates that have them in their prefixes;
* length filter: a block has at least ``need`` distinct words;
* positional filter: at the first word shared, what follows in either set must
  be enough for ``need``;

and what is left is verified by the sets' intersection, or, for phrases, by the
places where all their words follow one another; a place belongs to the block in
whose first half it starts, so each counts once.

Null texts count as empty; empty texts have no words, no labels and score 0.
Repeated rows are judged each.  Columns named like the new ones, in any case, are
replaced.  An empty table gives no rows.  A text of any length is cut into blocks
and these are dealt out, so none is worked on whole beyond splitting its words.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import has, staged, text_of

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases whose words must stand consecutively, and texts of public licenses.
PHRASES = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))
TEMPLATES = (
    ("apache-2", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-sa", "creative commons attribution sharealike 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl", "licensed under the gnu general public license version"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
#: Template tables up to this many rows are broadcast; beyond, Spark chooses the join.
SMALL = 50_000


class Template:
    """A template (or phrase) and what its place in the order of words decides."""

    def __init__(self, label: str, text: str, threshold: float, phrase: bool):
        self.label, self.phrase = label, phrase
        self.words = re.findall(WORD, text.lower() if text.isascii() else text.translate(str.maketrans(UPPER, LOWER)))
        self.tokens = sorted(set(self.words))
        self.half = max(8, 1 << (len(self.words) - 1).bit_length())
        self.need = len(self.tokens) if phrase else max(1, math.ceil(threshold * len(self.tokens) - 1e-9))

    def order(self, rank: dict[str, int]) -> list[str]:
        return sorted(self.tokens, key=rank.__getitem__)

    def prefix(self, rank: dict[str, int]) -> list[str]:
        return self.order(rank)[: len(self.tokens) - self.need + 1]


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), 0)


def _table(docs: DataFrame, rows: list[tuple], form: str) -> DataFrame:
    table = docs.sparkSession.createDataFrame(rows, form)
    return F.broadcast(table) if len(rows) <= SMALL else table


def held_words(docs: DataFrame, text: str, keep: Sequence[str], vocabulary: list[str]) -> DataFrame:
    """(row, at, n_words, held): a row's kept columns, a number of its own, and the places of words of the vocabulary."""
    row = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.struct(F.lit(None).cast("int").alias("none"))
    split = docs.select(row.alias("row"), F.monotonically_increasing_id().alias("at"), words_of(text_of(f"`{text}`")).alias("words"))
    place = F.transform("words", lambda w, i: F.when(w.isin(vocabulary), F.struct(i.alias("place"), w.alias("word"))))
    return split.select("row", "at", F.size("words").cast("long").alias("n_words"), F.filter(place, lambda x: x.isNotNull()).alias("held"))


def found_blocks(held: DataFrame, templates: list[Template]) -> DataFrame:
    """(at, block, half, template, label, phrase, containment, places) of all blocks that meet their template.

    ``held`` is a written table of ``held_words``; ``places`` are where a phrase starts.
    """
    vocabulary = sorted({w for t in templates for w in t.tokens})
    # how many texts hold each word: no more rows than the templates have words
    seen = held.select(F.explode(F.array_distinct(F.transform("held", lambda x: x["word"]))).alias("word")).groupBy("word").count().collect()
    counts = {r["word"]: r["count"] for r in seen}
    rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}

    index, least = [], {}
    for number, t in enumerate(templates):
        least[t.half] = min(least.get(t.half, t.need), t.need)
        ordered = [rank[w] for w in t.order(rank)]
        for i, w in enumerate(t.prefix(rank)):
            index.append((t.half, rank[w], number, i, t.need, ordered, [rank[w] for w in t.words], t.label, t.phrase))
    uses = [(w, rank[w], t_half, least[t_half]) for t_half in sorted(least) for w in sorted({w for t in templates if t.half == t_half for w in t.tokens})]
    templates_of = _table(held, index, "half int, word int, template int, i int, need int, tokens array<int>, words array<int>, label string, phrase boolean")
    halves_of = _table(held, uses, "word string, rank int, half int, least int")
    first = sorted({w for t in templates for w in t.prefix(rank)})

    words = held.where(F.exists("held", lambda x: x["word"].isin(first))).select("at", F.explode("held").alias("x")).select("at", "x.place", "x.word").join(halves_of, "word")
    block = F.floor(F.col("place") / F.col("half")).cast("int")
    dealt = words.select("at", "half", "least", F.explode(F.when(block > 0, F.array(block - 1, block)).otherwise(F.array(block))).alias("block"), F.struct("place", "rank").alias("x"))
    # at most 2 * half words a block
    blocks = dealt.groupBy("at", "half", "block").agg(F.array_sort(F.collect_list("x")).alias("x"), F.first("least").alias("least"))
    blocks = blocks.withColumn("own", F.array_sort(F.array_distinct("x.rank"))).withColumn("size", F.size("own")).where("size >= least")
    probes = blocks.select("*", F.posexplode(F.slice("own", 1, F.col("size") - F.col("least") + 1)).alias("j", "word"))
    met = probes.join(templates_of, ["half", "word"])
    rest = F.least(F.col("size") - F.col("j"), F.size("tokens") - F.col("i"))
    met = met.where((F.col("size") >= F.col("need")) & (F.col("j") <= F.col("size") - F.col("need")) & (rest >= F.col("need")))
    # a pair counts at its first shared word only
    met = met.where(~F.arrays_overlap(F.slice("own", 1, F.col("j")), "tokens")).withColumn("shared", F.size(F.array_intersect("own", "tokens"))).where("shared >= need")

    n, m = F.size("x"), F.size("words")
    starts = F.filter(F.sequence(F.lit(0), F.greatest(n - m, F.lit(0))), lambda k: (F.slice("x.rank", k + 1, m) == F.col("words")) & (F.get("x.place", k + m - 1) - F.get("x.place", k) == m - 1))
    mine = F.filter(F.transform(starts, lambda k: F.get("x.place", k)), lambda p: F.floor(p / F.col("half")) == F.col("block"))
    met = met.withColumn("places", F.when(F.col("phrase"), mine)).where(~F.col("phrase") | (F.size("places") > 0))
    return met.select("at", "block", "half", "template", "label", "phrase", (F.col("shared") / F.size("tokens")).alias("containment"), "places")


def _templates(phrases: Sequence[tuple[str, str]], templates: Sequence[tuple[str, str]], threshold: float) -> list[Template]:
    if not 0 < threshold <= 1:
        raise ValueError("threshold is above 0 and at most 1")
    made = [Template(*p, 1.0, True) for p in phrases] + [Template(*t, threshold, False) for t in templates]
    if any(not t.words for t in made):
        raise ValueError("a phrase or template has no words")
    return made


def license_blocks(docs: DataFrame, keep: Sequence[str], text: str = "text", phrases: Sequence[tuple[str, str]] = PHRASES, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = 0.9) -> DataFrame:
    """``keep`` columns of ``docs`` as ``row``, and first_word, block_words, label, template, containment, places: a row a block and template met."""
    has(docs, text, *keep)
    made = _templates(phrases, templates, threshold)
    held = staged(held_words(docs, text, keep, sorted({w for t in made for w in t.tokens})), "held")
    found = found_blocks(held, made)
    names = _table(docs, [(i, " ".join(t.words)) for i, t in enumerate(made)], "template int, name string")
    block = found.join(names, "template").join(held.select("at", "row"), "at")
    return block.select("row", (F.col("block") * F.col("half")).cast("long").alias("first_word"), (2 * F.col("half")).alias("block_words"), "label", F.col("name").alias("template"), "containment", "places")


def scan(docs: DataFrame, keep: Sequence[str] | None = None, text: str = "text", phrases: Sequence[tuple[str, str]] = PHRASES, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = 0.9) -> DataFrame:
    """``keep`` columns of ``docs`` with n_words, n_base, first_word, last_word, base_labels, labels and score.

    n_base counts the places of phrases, first_word and last_word are the first
    and last of them (else null); labels are distinct, sorted and joined by
    commas, base_labels those of phrases alone; score is the largest containment
    found, 0 if none is.
    """
    new = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in new]
    has(docs, text, *keep)
    made = _templates(phrases, templates, threshold)
    held = staged(held_words(docs, text, keep, sorted({w for t in made for w in t.tokens})), "held")
    label = F.col("label")
    per_row = found_blocks(held, made).groupBy("at").agg(
        F.sum(F.when(F.col("phrase"), F.size("places"))).alias("n_base"),
        F.min(F.array_min("places")).alias("first_word"),
        F.max(F.array_max("places")).alias("last_word"),
        F.collect_set(F.when(F.col("phrase"), label)).alias("base"),
        F.collect_set(label).alias("all"),
        F.max("containment").alias("score"),
    )
    joined = lambda c: F.coalesce(F.array_join(F.array_sort(c), ","), F.lit(""))
    return held.select("row", "at", "n_words").join(per_row, "at", "left").select(
        *([F.col("row")[c].alias(c) for c in keep]),
        "n_words",
        F.coalesce(F.col("n_base"), F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"),
        F.col("last_word").cast("long").alias("last_word"),
        joined("base").alias("base_labels"),
        joined("all").alias("labels"),
        F.coalesce(F.col("score"), F.lit(0.0)).alias("score"),
    )


def oracle_sql(phrases: Sequence[tuple[str, str]] = PHRASES, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = 0.9) -> str:
    """The same rows from DuckDB: every phrase at every word, every template against every block."""
    made = _templates(phrases, templates, threshold)
    listed = lambda x: "[" + ", ".join(f"'{w}'" for w in x) + "]"
    bases = ", ".join(f"('{t.label}', {listed(t.words)})" for t in made if t.phrase)
    others = ", ".join(f"('{t.label}', {listed(t.tokens)}, {t.half}, {t.need})" for t in made if not t.phrase)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS words FROM documents),
p(label, phrase) AS (VALUES {bases}),
t(label, tokens, half, need) AS (VALUES {others}),
base AS (SELECT r, label, unnest(list_filter(range(len(words) - len(phrase) + 1), lambda i: words[i + 1 : i + len(phrase)] = phrase)) AS place FROM d, p),
blocks AS (SELECT r, half, list_distinct(words[b * half + 1 : b * half + 2 * half]) AS own FROM (SELECT r, words, half, unnest(range(greatest(1, (len(words) + half - 1) // half))) AS b FROM d, (SELECT DISTINCT half FROM t))),
met AS (SELECT r, label, len(list_intersect(own, tokens)) / len(tokens) AS containment FROM blocks JOIN t USING (half) WHERE len(list_intersect(own, tokens)) >= need),
both_ AS (SELECT r, label, place, 1.0::DOUBLE AS containment FROM base UNION ALL SELECT r, label, NULL, containment FROM met),
g AS (SELECT r, count(place) AS n_base, min(place) AS first_word, max(place) AS last_word, array_to_string(list_sort(list_distinct(list(CASE WHEN place IS NOT NULL THEN label END))), ',') AS base_labels, array_to_string(list_sort(list_distinct(list(label))), ',') AS labels, max(containment) AS score FROM both_ GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score FROM d LEFT JOIN g USING (r)
"""
