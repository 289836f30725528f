"""License texts in documents, by diagonal voting and DataFrame functions alone.

The hash of each pair of neighbouring words joins the places where templates have it (a table of fixed size, broadcast). Each
hit votes for the diagonal document position - template position. Full diagonals of the short base phrases are their places.
For longer templates, neighbouring diagonals of a document merge where words were inserted or lost. Spans are verified on words:
every hit carries its words, which are compared with the template's, and a merged span counts when the verified words cover
enough of its template. Texts are read once; only the places of hits go on from there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from frameloom.llm._common import LOWER, UPPER, checkpointed, table, whole

#: Words of a text, and the base phrases with their labels.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What stands between words once A-Z are small letters.
BETWEEN = "".join(map(chr, [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Sentences of public license notices, with their labels.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction": "mit",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit",
    "you may not use this file except in compliance with the license you may obtain a copy of the license at": "apache",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind": "apache",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl",
    "you should have received a copy of the gnu general public license along with this program": "gpl",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license": "lgpl",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
    "this work is licensed under a creative commons attribution sharealike": "cc-by-sa",
    "this is free and unencumbered software released into the public domain": "unlicense",
}
#: Words in a hashed gram, diagonals that may lie between merged ones, and the share of a notice that a span must cover.
GRAM, NEIGHBOURS, COVER = 2, 3, 0.7


def template_grams(spark: SparkSession, phrases: dict[str, str], notices: dict[str, str]) -> DataFrame:
    """(template, label, base, n_grams, at, gram, gram_words) for each place of each template; a few thousand rows at most."""
    rows = []
    for i, (text, label) in enumerate([*phrases.items(), *notices.items()]):
        words = text.split()
        if len(words) < GRAM:
            raise ValueError(f"a template needs {GRAM} words: {text!r}")
        n = len(words) - GRAM + 1
        rows += [(i, label, i < len(phrases), n, at, words[at : at + GRAM]) for at in range(n)]
    if len(rows) > 100_000:
        raise ValueError("templates are too large to broadcast")
    made = spark.createDataFrame(rows, "template int, label string, base boolean, n_grams int, at int, gram_words array<string>")
    return made.withColumn("gram", F.xxhash64(*[F.col("gram_words")[i] for i in range(GRAM)]))


def words_of(text: Column) -> Column:
    """The words of a text (WORD), without a regular expression: a translation and a split at blanks, both linear."""
    return F.filter(F.split(F.translate(text, UPPER + BETWEEN, LOWER + " " * len(BETWEEN)), " "), lambda w: w != "")


def gram_places(docs: DataFrame, templates: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, h, n_words, hits) of each row: hits are the places, hashes and words of grams that some template has.

    The rolling hashes are taken and sifted within the row; whole texts are not copied. The templates' hashes are a literal set of
    as many values as there are template places.
    """
    known = sorted({r["gram"] for r in templates.select("gram").collect()})
    rows = docs.select("doc_id", F.xxhash64(whole(text)).alias("h"), F.explode(F.array(words_of(whole(text)))).alias("w"))  # words are made once
    gram = lambda i: F.xxhash64(*[F.get("w", i + k) for k in range(GRAM)])
    places = F.when(F.size("w") >= GRAM, F.filter(F.sequence(F.lit(0), F.size("w") - GRAM), lambda i: gram(i).isin(known))).otherwise(F.array().cast("array<int>"))
    hits = F.transform(places, lambda i: F.struct(i.alias("place"), gram(i).alias("gram"), F.slice("w", i + 1, GRAM).alias("words")))
    return rows.select("doc_id", "h", F.size("w").cast("bigint").alias("n_words"), hits.alias("hits"))


def template_hits(places: DataFrame, templates: DataFrame) -> DataFrame:
    """(doc_id, h, template, label, base, n_grams, at, place, diagonal) of every gram whose hash and words a template has."""
    found = places.select("doc_id", "h", F.inline("hits"))
    hits = found.join(F.broadcast(templates), "gram").where(F.col("words") == F.col("gram_words"))
    return hits.select("doc_id", "h", "template", "label", "base", "n_grams", "at", "place", (F.col("place") - F.col("at")).alias("diagonal"))


def verified_spans(hits: DataFrame, neighbours: int = NEIGHBOURS, cover: float = COVER) -> DataFrame:
    """(doc_id, h, template, label, base, first_word, last_word, score).

    Diagonals of a template that are at most `neighbours` apart, and whose places follow on, are one span; its score is the
    share of the template's words that its verified grams cover. Base phrases count on a full diagonal only.
    """
    key = ["doc_id", "h", "template", "label", "base", "n_grams"]
    lines = hits.groupBy(*key, "diagonal").agg(F.count_distinct("at").alias("votes"), F.min("place").alias("first"), F.max("place").alias("last"), F.collect_set("at").alias("ats"))
    full = lines.where(F.col("base") & (F.col("votes") == F.col("n_grams"))).select(*key[:5], F.col("first").alias("first_word"), (F.col("last") + GRAM - 1).alias("last_word"), F.lit(1.0).alias("score"))
    order = Window.partitionBy(*key).orderBy("diagonal")
    apart = (F.col("diagonal") - F.lag("diagonal").over(order) > neighbours) | (F.col("first") - F.lag("last").over(order) > F.col("n_grams"))
    grouped = lines.where("not base").withColumn("new", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("span", F.sum("new").over(order))
    merged = grouped.groupBy(*key, "span").agg(F.min("first").alias("first_word"), F.max("last").alias("last"), F.flatten(F.collect_list("ats")).alias("ats"))
    covered = F.array_distinct(F.flatten(F.transform("ats", lambda at: F.sequence(at, at + GRAM - 1))))
    wide = merged.withColumn("score", F.size(covered) / (F.col("n_grams") + GRAM - 1)).where((F.col("score") >= cover) & (F.col("last") - F.col("first_word") < 2 * F.col("n_grams")))
    return full.unionByName(wide.select(*key[:5], "first_word", (F.col("last") + GRAM - 1).alias("last_word"), "score"))


def scan_licenses(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES, text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score is the largest share of a template that a verified span covers, 0 without one. Null and empty texts have no words;
    without a base phrase first_word and last_word are null and base_labels is empty. Long texts count whole: time is linear in
    their length, and only hits leave their row. Rows that repeat an id and a text each get the same result; ids that repeat with
    other texts, and null ids, have rows of their own. Other columns, whatever their names, are not read. An empty table gives no
    rows.
    """
    templates = template_grams(docs.sparkSession, phrases, notices)
    places = checkpointed(gram_places(docs, templates, text))
    spans = verified_spans(checkpointed(template_hits(places, templates)))  # read twice there
    labels = lambda on: F.array_join(F.array_sort(F.collect_set(F.when(on, F.col("label")))), ",")
    found = spans.groupBy("doc_id", "h").agg(
        F.count_if("base").alias("n_base"), F.min(F.when(F.col("base"), F.col("first_word"))).alias("first_word"), F.max(F.when(F.col("base"), F.col("first_word"))).alias("last_word"),
        labels(F.col("base")).alias("base_labels"), labels(F.lit(True)).alias("labels"), F.max("score").alias("score"),
    )
    joined = places.select("doc_id", "h", "n_words").alias("d").join(found.alias("f"), F.expr("d.doc_id <=> f.doc_id and d.h = f.h"), "left")
    return joined.select(
        "d.doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("bigint").alias("n_base"), F.col("first_word").cast("bigint").alias("first_word"), F.col("last_word").cast("bigint").alias("last_word"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
