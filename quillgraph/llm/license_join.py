"""License scans as an exact set-similarity join, in DataFrame functions only.

A block is a window of a document's words, as long as a template's text, wherever it starts and whatever line ends and
marks stand between the words. A template is a set of words; a block meets it if it holds at least ``THRESHOLD`` percent
of them (containment).

Template words are put in one global order, the rarest in all documents first. A block that shares enough words with a
template shares one among the template's rarest (its prefix), so only words of prefixes are joined to their templates,
each with the words around it that a block with it can have. Documents or surroundings with too few template words
(length filter) and prefix words that too few others can follow in the order (positional filter) are dropped; the rest is
counted exactly, block by block.

Each text is read once; what is kept of a document is its base columns, its distinct template words, and all words only
if enough of a template's stand anywhere in it. The template table is a constant of this module, so its broadcast has a
fixed size, and so has its word order, the only thing that comes to the driver.

Base: places where a phrase's words stand side by side anywhere in the text, line ends or marks between them or not.

Defined cases: null and empty text have no words, places and labels, and score 0; a text with a base place scores 1,
others the largest containment found; a block at the end of a text may be shorter; repeated rows each give a row; an empty
table gives an empty one; columns other than doc_id and text are not taken, so their names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored
from .common import LOWER, UPPER, table

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
THRESHOLD = 80
#: Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Notices that license authors ask for, and their labels.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
]


def words_of(text: Column) -> Column:
    """Words of the text, A-Z in lower case."""
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0))


def with_row(docs: DataFrame) -> DataFrame:
    """A key that rows of one doc_id and text share."""
    return docs.withColumn("row", F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.xxhash64("text").cast("string")))


def base(docs: DataFrame) -> DataFrame:
    """n_words, n_base, first_word, last_word, base_labels (array) and words for each row."""
    spaced = F.concat(F.lit(" "), F.array_join("words", "  "), F.lit(" "))  # each word between blanks of its own
    out = docs.withColumn("words", F.coalesce(words_of(F.col("text")), F.array().cast("array<string>"))).withColumn("n_words", F.size("words").cast("long"))
    out = out.withColumn("spaced", F.when(F.array_contains("words", "license"), spaced).otherwise(F.lit(""))).drop("text")
    word_count = lambda s: F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))  # noqa: E731  twice the words
    places, firsts, lasts, labels = F.lit(0), [], [], []
    for phrase, label in PHRASES.items():
        own = phrase.split()
        pattern = "".join(f" {w} " for w in own)
        n = ((F.length("spaced") - F.length(F.replace("spaced", F.lit(pattern), F.lit("")))) / len(pattern)).cast("long")
        places = places + n
        before, after = F.substring_index("spaced", pattern, 1), F.substring_index("spaced", pattern, -1)
        firsts.append(F.when(n > 0, word_count(before) / 2).cast("long"))
        lasts.append(F.when(n > 0, F.col("n_words") - len(own) - word_count(after) / 2).cast("long"))
        labels.append(F.when(n > 0, F.lit(label)))
    out = out.withColumns({"n_base": places.cast("long"), "first_word": F.least(*firsts), "last_word": F.greatest(*lasts), "base_labels": F.array_sort(F.array_compact(F.array(*labels)))})
    return out.drop("spaced")


def needed(size: int) -> int:
    """Least number of shared words that meets the threshold."""
    return -(-THRESHOLD * size // 100)


def _array(values) -> Column:
    return F.array(*map(F.lit, values))


def prepared(docs: DataFrame, templates: list[tuple[str, str]]) -> DataFrame:
    """The base columns, template words (tokens) and, where a template can be met, all words of each row; written once."""
    out = base(docs).withColumn("tokens", F.array_intersect("words", _array(sorted({w for _, t in templates for w in t.split()}))))
    may = F.lit(False)
    for _, text in templates:
        own = set(text.split())
        may = may | (F.size(F.array_intersect("tokens", _array(sorted(own)))) >= needed(len(own)))
    shortest = min(needed(len(set(t.split()))) for _, t in templates)
    return stored(out.withColumn("words", F.when((F.size("tokens") >= shortest) & may, F.col("words"))))


def global_order(found: DataFrame, templates: list[tuple[str, str]]) -> list[str]:
    """Template words, the ones in fewest documents first, equals by name."""
    counted = found.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    n = {r.token: r.n for r in counted.collect()}  # as many rows as template words at most
    return sorted({w for _, t in templates for w in t.split()}, key=lambda w: (n.get(w, 0), w))


def matches(found: DataFrame, templates: list[tuple[str, str]]) -> DataFrame:
    """(row, label, containment): the best of each prefix word's blocks that meet a template; found as from prepared()."""
    rank = {w: i for i, w in enumerate(global_order(found, templates))}
    prefixes, words, reach = [], set(), max(len(t.split()) for _, t in templates)
    for label, text in templates:
        own = sorted(set(text.split()), key=rank.get)
        least = needed(len(own))
        words.update(own[: len(own) - least + 1])
        for at, word in enumerate(own[: len(own) - least + 1]):
            prefixes.append(F.struct(F.lit(word).alias("token"), F.lit(label).alias("label"), F.lit(at).alias("at"), _array(own).alias("own"), F.lit(least).alias("least"), F.lit(len(text.split())).alias("span")))
    index = found.sparkSession.range(1, numPartitions=1).select(F.inline(F.array(*prefixes)))
    # prefix words with the words around them, cut out within the row, so that no text is repeated for each of them
    start = lambda i: F.greatest(i - reach + 1, F.lit(0))
    spot = lambda w, i: F.when(w.isin(sorted(words)), F.struct(w.alias("token"), (i - start(i)).alias("place"), F.slice("words", start(i) + 1, i + reach - start(i)).alias("around")))
    spots = found.where(F.col("words").isNotNull()).select("row", "tokens", F.explode(F.array_compact(F.transform("words", spot))).alias("s")).select("row", "tokens", "s.*")
    joined = spots.join(F.broadcast(index), "token")  # a constant table
    met = joined.where(F.size(F.array_intersect("tokens", "own")) >= F.col("least"))  # length filter, document
    low = F.greatest(F.col("place") - F.col("span") + 1, F.lit(0))
    met = met.select("row", "label", "at", "own", "least", "span", F.slice("around", low + 1, F.col("place") + F.col("span") - low).alias("around"))
    # length and positional filter, surroundings: a block counts for the rarest word in it, so only words from its place in the order on
    behind = F.slice("own", F.col("at") + 1, F.size("own"))
    met = met.where(F.size(F.array_intersect(behind, F.col("around"))) >= F.col("least")).distinct()
    sizes = F.transform(F.sequence(F.lit(1), F.size("around")), lambda i: F.size(F.array_intersect(F.col("own"), F.slice("around", i, F.col("span")))))
    met = met.withColumn("shared", F.array_max(sizes)).where(F.col("shared") >= F.col("least"))
    return met.select("row", "label", (F.col("shared") / F.size("own")).alias("containment"))


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """doc_id, words, base places and labels for each row of docs (doc_id, text)."""
    known = prepared(with_row(docs.select("doc_id", "text")), templates or TEMPLATES)
    found = matches(known, templates or TEMPLATES).groupBy("row").agg(F.collect_set("label").alias("found"), F.max("containment").alias("best"))
    out = known.drop("words", "tokens").join(found, "row", "left")
    every = F.array_sort(F.array_union("base_labels", F.coalesce("found", F.array().cast("array<string>"))))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0)))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), score.alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: one row per document."""
    return scan(table(spark, sf_dir, "documents", "doc_id", "text"))


def _oracle() -> str:
    """Every block against every template, and phrases by their places in the word list."""
    values = ", ".join(f"('{label}', {len(text.split())}, list_distinct(string_split('{text}', ' ')))" for label, text in TEMPLATES)
    parts, labels = [], []
    for phrase, label in PHRASES.items():
        own = phrase.split()
        test = " and ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(own, 1))
        parts.append(f"list_filter(range(len(w)), lambda i: {test})")
        labels.append(f"case when {' or '.join([f'len({parts[-1]}) > 0'])} then '{label}' end")
    places = f"list_concat(list_concat({parts[0]}, {parts[1]}), {parts[2]})"
    return f"""
with templates(label, span, own) as (values {values}),
docs as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
words as (select r, doc_id, text, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}') as w from docs),
based as (select r, doc_id, len(w) as n_words, {places} as p, list_sort(list_filter([{', '.join(labels)}], lambda x: x is not null)) as b from words),
near as (select r, label, span, own, w from words, templates where 100 * len(list_intersect(own, list_distinct(w))) >= {THRESHOLD} * len(own)),
blocks as (select r, label, own, span, unnest(list_transform(range(1, len(w) + 1), lambda i: w[i : i + span - 1])) as t from near),
met as (select r, label, len(list_intersect(own, list_distinct(t))) / len(own) as c from blocks where 100 * len(list_intersect(own, list_distinct(t))) >= {THRESHOLD} * len(own)),
found as (select r, list(distinct label) as f, max(c) as best from met group by r)
select doc_id, n_words::bigint as n_words, len(p)::bigint as n_base, list_min(p)::bigint as first_word, list_max(p)::bigint as last_word,
  array_to_string(b, ',') as base_labels, array_to_string(list_sort(list_distinct(list_concat(b, coalesce(f, [])))), ',') as labels,
  case when len(p) > 0 then 1.0::double else coalesce(best, 0)::double end as score
from based left join found using (r)
"""


ORACLE_SQL = _oracle()
