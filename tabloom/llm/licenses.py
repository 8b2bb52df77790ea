"""Licence scan: a positional index of rare words, then whole phrases.

Each template is a label and the words of a mandatory key phrase: short ones, and
the passages by which licence headers and licence texts are known.  A word's weight
is its inverse document frequency over all documents, counted in one pass for the
longest words of each template.  A file is looked up by the words of the highest weight of the
templates that it may hold, two of each: a place of a word in the file proposes the
start that its place in the template implies, the starts that the two words propose
are intersected, and where they agree all other words of the phrase are verified.  So
a template is found wherever its words stand consecutively.

All of it is DataFrame functions.  Null and empty texts have no words, no labels
and score 0; very long texts need memory for one text's words.  Overlapping places
all count, also those of several templates with one label.  Repeated rows stay
repeated; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii

#: Fixed values of the contract: label and phrase.
BASE = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))
#: Further labels.
MORE = (
    ("gpl", "gnu general public license"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license"),
    ("bsd", "redistributions of source code must retain the above copyright notice"),
    ("bsd", "bsd 3 clause license"),
    ("bsd", "bsd 2 clause license"),
    ("mpl", "mozilla public license"),
    ("epl", "eclipse public license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("apache-2", "licensed under the apache license"),
    ("cc-by-sa", "cc by sa"),
    ("cc-by-nd", "cc by nd"),
    ("cc-by", "creative commons attribution"),
    ("cc0", "cc0 1 0 universal"),
    ("unlicense", "released into the public domain"),
    ("reserved", "all rights reserved"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsl", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
#: The words of a text whose letters may still be capitals.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def split_words(text):
    return F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))


def word_frequencies(docs: DataFrame, vocabulary: list[str], text_col: str = "text") -> tuple[int, dict[str, int]]:
    """The number of documents, and how many hold each word of the vocabulary, be it within a longer one (a bounded table)."""
    low = docs.select(F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("low"))
    held = F.filter(F.array(*map(F.lit, vocabulary)), lambda w: F.contains(F.col("low"), w))
    counted = low.select(F.explode(F.concat(held, F.array(F.lit("")))).alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()
    found = {r["word"]: r["n"] for r in counted}
    return found.pop("", 0), found


def likely(phrase: str, n: int = 5) -> list[str]:
    """The n longest words of a phrase: those whose weight is counted."""
    return sorted(set(phrase.split(" ")), key=lambda w: (-len(w), w))[:n]


def anchors(templates, frequencies: dict[str, int], n: int = 2) -> list[tuple[str, list[str], list[int]]]:
    """(label, words, places of the n different words with the highest inverse document frequency)."""
    out = []
    for label, phrase in templates:
        words = phrase.split(" ")
        first = {w: words.index(w) for w in likely(phrase)}
        out.append((label, words, sorted(first.values(), key=lambda i: (frequencies.get(words[i], 0), i))[:n]))
    return out


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base=BASE, more=MORE) -> DataFrame:
    """id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_places, hits (array of label, start, words)."""
    templates = [*base, *more]
    vocabulary = sorted({w for _, p in templates for w in likely(p)})
    _, frequencies = word_frequencies(docs, vocabulary, text_col)
    index = anchors(templates, frequencies)
    rare = sorted({words[i] for _, words, at in index for i in at})
    text = F.coalesce(F.col(text_col), F.lit(""))
    # a document that lacks a word of every template is never cut into words
    holds = lambda words: reduce(lambda a, b: a & b, [F.col("__low").contains(w) for w in sorted(set(words), key=lambda w: (frequencies.get(w, 1 << 62 if w not in vocabulary else 0), -len(w)))])
    some = reduce(lambda a, b: a | b, [holds(words) for _, words, _ in index])
    none = F.array().cast("array<string>")
    rows = docs.select(F.col(id_col), text.alias("__text"), F.lower(text).alias("__low"))
    rows = rows.select(id_col, F.regexp_count("__text", F.lit(WORD)).cast("long").alias("n_words"), F.when(some, split_words("__text")).otherwise(none).alias("__words"))
    # lower() also folds letters beyond ASCII, so what it finds is tested again by lower_ascii()
    places = F.filter(F.transform("__words", lambda w, i: F.struct(F.lower(w).alias("low"), w.alias("w"), i.alias("i"))), lambda x: x["low"].isin(rare))
    places = F.transform(places, lambda x: F.struct(lower_ascii(x["w"]).alias("w"), x["i"].alias("i")))
    rows = rows.withColumn("__places", F.when(F.size("__words") > 0, places).otherwise(F.array().cast("array<struct<w:string,i:int>>")))

    def proposed(word: str, at: int):
        return F.transform(F.filter("__places", lambda x: x["w"] == word), lambda x: x["i"] - at)

    def found(label: str, words: list[str], at: list[int], is_base: bool):
        starts = [proposed(words[i], i) for i in at]
        fits = lambda s: reduce(lambda a, b: a & b, [s >= 0, *(F.coalesce(lower_ascii(F.get("__words", s + k)) == w, F.lit(False)) for k, w in enumerate(words) if k not in at)])
        return F.transform(F.filter(reduce(F.array_intersect, starts), fits), lambda s: F.struct(F.lit(label).alias("label"), s.cast("long").alias("start"), F.lit(len(words)).alias("words"), F.lit(is_base).alias("base")))

    hits = F.concat(*(found(*x, n < len(base)) for n, x in enumerate(index)))
    empty = F.array().cast("array<struct<label:string,start:bigint,words:int,base:boolean>>")
    rows = rows.withColumn("hits", F.when(F.size("__places") > 0, hits).otherwise(empty))
    own = F.filter("hits", lambda h: h["base"])
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(F.transform(x, lambda h: h["label"]))), ",")
    starts = F.transform(own, lambda h: h["start"])
    n = F.size("hits")
    return rows.select(
        id_col,
        "n_words",
        F.size(own).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(own).alias("base_labels"),
        joined("hits").alias("labels"),
        (1 - F.pow(F.lit(0.5), F.least(n, F.lit(50)))).alias("score"),
        n.cast("long").alias("n_places"),
        "hits",
    )


def op2_license_scan(spark, sf_dir):
    from .common import table

    return scan_licenses(table(spark, sf_dir, "documents")).drop("hits")


def _sql() -> str:
    def places(phrase: str) -> str:
        tests = " AND ".join(f"words[i + {k + 1}] = '{w}'" for k, w in enumerate(phrase.split(" ")))
        return f"list_filter(range(len(words)), lambda i: {tests})"

    cols = ", ".join(f"{places(p)} AS t{n}" for n, (_, p) in enumerate((*BASE, *MORE)))
    names = lambda ts: f"array_to_string(list_sort(list_distinct(list_filter([{', '.join(f'CASE WHEN len(t{n}) > 0 THEN {chr(39)}{label}{chr(39)} END' for n, (label, _) in ts)}], lambda x: x IS NOT NULL))), ',')"
    base = list(enumerate(BASE))
    every = list(enumerate((*BASE, *MORE)))
    starts = f"list_concat({places_of(base)})"
    total = " + ".join(f"len(t{n})" for n, _ in every)
    return rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
t AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, {cols} FROM w),
u AS (SELECT *, {starts} AS starts, CAST({total} AS BIGINT) AS n_places FROM t)
SELECT doc_id, n_words, CAST(len(starts) AS BIGINT) AS n_base, CAST(list_min(starts) AS BIGINT) AS first_word, CAST(list_max(starts) AS BIGINT) AS last_word,
  {names(base)} AS base_labels, {names(every)} AS labels, 1 - pow(0.5, least(n_places, 50)) AS score, n_places FROM u"""


def places_of(templates) -> str:
    return ", ".join(f"t{n}" for n, _ in templates)


OP2_SQL = _sql()
