"""Licence scan over a positional index of rare template words, in DataFrame expressions only.

Each licence template is indexed by its few words of highest inverse document frequency, with their places in the
template. A file looks up all of these words that it has; hits of one template that agree on where the template would begin
are intersected, and an alignment counts only if the template's mandatory key phrase stands there word for word. Document
frequencies are counted over all documents. Besides, three base phrases are located wherever their words stand in a row.

The index is a small fixed table of some dozens of rows, whatever the input, so it is broadcast.

Defined results: null or empty text has no words, no labels, null word places and score 0; repeated rows and rows with a
null id get a result each; other columns of the input are not read.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide.llm.rows import KEY, keyed

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
INDEXED_WORDS = 3


class Template(NamedTuple):
    label: str
    text: str
    key: str


#: public licence notices in common use; fixed values
TEMPLATES = [
    Template("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2"),
    Template("mit", "released under the mit license", "mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software",
             "permission is hereby granted free of charge"),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    Template("gpl-2.0", "this work is licensed under the gnu general public license version 2", "gnu general public license version 2"),
    Template("lgpl", "licensed under the gnu lesser general public license", "lesser general public license"),
    Template("agpl", "licensed under the gnu affero general public license", "affero general public license"),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    Template("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
             "redistribution and use in source and binary forms"),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software"),
    Template("all-rights-reserved", "all rights reserved", "all rights reserved"),
]


def with_words(docs: DataFrame) -> DataFrame:
    """Lower-cased words of each whole text. Non-ASCII letters are word characters in either case, and no other letter
    becomes an ASCII letter of a phrase here, so lowering them too changes no word boundary and no phrase."""
    return keyed(docs).select("doc_id", *KEY, F.array_remove(F.split(F.lower("text"), NOT_WORD), "").alias("words"))


def vocabulary() -> list[str]:
    return sorted({w for t in TEMPLATES for w in t.text.split()})


def document_frequencies(words: DataFrame) -> tuple[dict[str, int], int]:
    """In how many documents each licence word stands, and the number of documents; at most one row per licence word."""
    total = F.lit("")
    known = F.array(*map(F.lit, vocabulary()))
    found = words.select(F.explode(F.concat(F.array(total), F.array_intersect("words", known))).alias("word"))
    counts = {r["word"]: r["n"] for r in found.groupBy("word").agg(F.count("*").alias("n")).collect()}
    return counts, counts.pop("", 0)


def index_rows(idf: dict[str, float]) -> list[tuple]:
    """Postings of the templates' rarest words: word, template, place, words, weights, key phrase's first and last place."""
    rows = []
    for number, t in enumerate(TEMPLATES):
        words, key = t.text.split(), t.key.split()
        first = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
        rare = sorted(set(key), key=lambda w: (-idf[w], w))[:INDEXED_WORDS]
        weights = [idf[w] for w in words]
        rows += [(w, number, i, t.label, words, weights, first, first + len(key) - 1, len(rare)) for w in rare for i, x in enumerate(words) if x == w]
    return rows


INDEX = ("word string, template int, place int, label string, template_words array<string>, weights array<double>, "
         "key_first int, key_last int, n_rare int")


def template_labels(words: DataFrame) -> DataFrame:
    """Key columns, labels and score of documents in which a template's key phrase is verified."""
    spark = words.sparkSession
    counts, total = document_frequencies(words)
    idf = {w: math.log((1 + total) / (1 + counts.get(w, 0))) + 1 for w in vocabulary()}
    postings = index_rows(idf)
    indexed = F.array(*map(F.lit, sorted({r[0] for r in postings})))
    reach = max(len(t.text.split()) for t in TEMPLATES)
    rarest = words.withColumn("rare", F.array_intersect(indexed, "words")).filter(F.size("rare") > 0)
    places = F.filter(F.transform("words", lambda w, i: F.when(F.array_contains("rare", w), i)), lambda i: i.isNotNull())
    hits = rarest.select(*KEY, "words", F.explode(places).alias("at")).select(
        *KEY, F.element_at("words", F.col("at") + 1).alias("word"), "at", F.greatest(F.col("at") - reach, F.lit(0)).alias("from"),
        F.slice("words", F.greatest(F.col("at") - reach, F.lit(0)) + 1, 2 * reach).alias("around"),
    )
    index = spark.createDataFrame(postings, INDEX)
    aligned = hits.join(F.broadcast(index), "word").withColumn("begin", F.col("at") - F.col("place"))
    agreed = aligned.groupBy(*KEY, "template", "begin").agg(
        F.count_distinct("word").alias("n_hits"),
        *[F.first(c).alias(c) for c in ("from", "around", "label", "template_words", "weights", "key_first", "key_last", "n_rare")],
    ).filter(F.col("n_hits") >= F.least(F.lit(2), F.col("n_rare")))
    same = F.transform("template_words", lambda w, i: F.coalesce(
        F.try_element_at("around", F.when(F.col("begin") + i >= F.col("from"), F.col("begin") + i - F.col("from") + 1)) == w, F.lit(False)))
    verified = agreed.withColumn("same", same).filter(
        F.forall(F.slice("same", F.col("key_first") + 1, F.col("key_last") - F.col("key_first") + 1), lambda x: x))
    add = lambda a, x: a + x
    weight = F.aggregate(F.zip_with("same", "weights", lambda s, w: F.when(s, w).otherwise(0.0)), F.lit(0.0), add)
    return verified.withColumn("score", weight / F.aggregate("weights", F.lit(0.0), add)).groupBy(*KEY).agg(
        F.collect_set("label").alias("found"), F.max("score").alias("template_score"))


def base_places(phrase: str) -> Column:
    """Starts of the phrase in ``words``; the lambda runs only where the rarest words occur."""
    parts = phrase.split()
    last = F.size("words") - len(parts)
    here = lambda i: F.element_at("words", i + 1) == parts[0]

    def stands(i: Column) -> Column:
        match = here(i)
        for j, p in enumerate(parts[1:], 2):
            match = match & (F.element_at("words", i + j) == p)
        return match

    present = F.array_contains("words", parts[0])
    for p in parts[1:]:
        present = present & F.array_contains("words", p)
    return F.coalesce(F.when(present & (last >= 0), F.filter(F.sequence(F.lit(0), last), stands)), F.array().cast("array<int>"))


def scan(docs: DataFrame) -> DataFrame:
    words = with_words(docs)
    found = words.select("doc_id", *KEY, F.size("words").cast("long").alias("n_words"),
                         *[base_places(p).alias(f"at{i}") for i, p in enumerate(BASE_PHRASES)])
    all_places = F.concat(*[F.col(f"at{i}") for i in range(len(BASE_PHRASES))])
    labels = F.array_compact(F.array(*[F.when(F.size(f"at{i}") > 0, F.lit(v)) for i, v in enumerate(BASE_PHRASES.values())]))
    base = found.select("doc_id", *KEY, "n_words", F.size(all_places).cast("long").alias("n_base"), F.array_min(all_places).cast("long").alias("first_word"),
                        F.array_max(all_places).cast("long").alias("last_word"), labels.alias("base"))
    joined = base.join(template_labels(words).withColumnRenamed("found", "more"), KEY, "left")
    text = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    none = F.array().cast("array<string>")
    return joined.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", text(F.col("base")).alias("base_labels"),
        text(F.concat("base", F.coalesce("more", none))).alias("labels"),
        F.greatest(F.coalesce("template_score", F.lit(0.0)), F.when(F.col("n_base") > 0, F.lit(0.5)).otherwise(0.0)).alias("score"),
    )
