"""License scan by diagonal voting, in DataFrame operations only.

All rolling GRAM-word hashes of every text are joined to the positions of the same hashes in the license
templates. A hit votes for its diagonal (word position less template position); votes are summed per
document, template and diagonal, diagonals at most BAND apart are merged into one span, and a span counts if it
covers enough of the template and its words, compared exactly, hold enough of the template's words.
Short phrases that name a license are found in every text besides (base labels).

The templates are fixed: notices in this module, of which the short ones count only as a whole, and whole license
texts beside it, in parts of PART words. So their table is of fixed size and is broadcast.

Edge cases: null or empty text has 0 words and no label. Texts are told apart by doc_id (null too) and a hash, so rows
that share an id, or have none, are labelled by their own text each. Repeated places are all counted. Extra columns are ignored.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

GRAM = 4
BAND = 3
COVERAGE = 0.5  # of a template's grams; of a short notice's all
WORDS_SHARED = 0.7  # of a template's distinct words

SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Public license wordings.
PHRASES = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}
TEMPLATES = {
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files, to deal in the Software without restriction",
        "Released under the terms of the MIT License",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met",
    ],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
}


# Whole texts (files LABEL-VERSION.txt), in parts; a part that mostly stands in a text listed earlier keeps that one's label.
TEXTS = ["mit-1", "isc-1", "bsd-3", "apache-2.0", "gpl-3", "gpl-2", "gpl-1", "lgpl-3", "lgpl-2.1", "lgpl-2", "mpl-2.0", "mpl-1.1", "cc0-1.0"]
PART = 50  # words
# Short notices, which differ by a word; they count only as a whole.
NOTICES = {
    "lgpl": [f"under the terms of the GNU {kind} General Public License" for kind in ("Lesser", "Library")],
    "agpl": ["under the terms of the GNU Affero General Public License", "licensed under the GNU Affero General Public License"],
    "isc": ["Licensed under the ISC License", "Released under the ISC License"],
    "bsd": [f"{verb} under the {kind}BSD License" for verb in ("Licensed", "Released") for kind in ("", "2-Clause ", "3-Clause ", "New ", "Simplified ")],
}
CC = {"by": "Attribution", "nc": "NonCommercial", "sa": "ShareAlike", "nd": "NoDerivatives"}
for _kind in ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd"):
    _name = "-".join(CC[k] for k in _kind.split("-"))
    NOTICES[f"cc-{_kind}"] = [
        notice
        for version in ("1.0", "2.0", "2.5", "3.0", "4.0")
        for notice in (f"under CC {_kind} {version}", f"under a CC {_kind} {version}", f"Creative Commons {_name} {version}")
    ] + [f"creativecommons.org/licenses/{_kind}/{version}" for version in ("1.0", "2.0", "2.5", "3.0", "4.0")]


def template_words(text: str) -> list[str]:
    return [w for w in re.split(SEPARATOR, text.lower()) if w]


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATOR, -1), lambda w: w != "")


def grams(own: Column, gram: int = GRAM) -> Column:
    """Hashes of all runs of `gram` words; an empty array if there are fewer."""
    at = F.when(F.size(own) >= gram, F.sequence(F.lit(0), F.size(own) - gram)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*[F.get(own, i + j) for j in range(gram)]))


def listed() -> list[tuple[str, str, float, list[str]]]:
    """template, label, needed coverage, words."""
    rows = [(label, COVERAGE, template_words(text)) for label, texts in TEMPLATES.items() for text in texts]
    rows += [(label, 1.0, template_words(text)) for label, texts in NOTICES.items() for text in texts]
    seen: dict[tuple, str] = {}
    for name in TEXTS:
        label = name.rsplit("-", 1)[0]
        whole = template_words((Path(__file__).parent / "licenses" / f"{name}.txt").read_text())
        starts = range(0, max(1, len(whole) - PART // 2), PART)
        for start in starts:
            part = whole[start:] if start == starts[-1] else whole[start : start + PART]
            runs = [tuple(part[i : i + GRAM]) for i in range(len(part) - GRAM + 1)]
            if sum(run in seen for run in runs) < COVERAGE * len(runs):
                rows.append((label, COVERAGE, part))
        for i in range(len(whole) - GRAM + 1):
            seen.setdefault(tuple(whole[i : i + GRAM]), label)
    return [(f"{label}-{nth}", label, need, part) for nth, (label, need, part) in enumerate(rows)]


def templates(spark: SparkSession) -> DataFrame:
    """template, label, need, whole (its words), h, at: a row per gram position."""
    known = spark.createDataFrame(listed(), "template string, label string, need double, whole array<string>")
    return known.select("template", "label", "need", "whole", F.posexplode(grams(F.col("whole"))).alias("at", "h"))


def spans(docs: DataFrame) -> DataFrame:
    """doc, th (hash of the text), label, template, first, end (words), score of every verified span."""
    known = templates(docs.sparkSession)
    sizes = known.groupBy("template", "need").agg(F.count("*").alias("n_grams"))
    texts = docs.select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("th"), words(F.col("text")).alias("own"))
    rolled = texts.select("doc", "th", F.posexplode(grams(F.col("own"))).alias("pos", "h"))
    hits = rolled.join(F.broadcast(known.select("template", "h", "at")), "h")
    votes = hits.groupBy("doc", "th", "template", (F.col("pos") - F.col("at")).alias("diagonal")).agg(
        F.min("pos").alias("first"), F.max("pos").alias("last"), F.collect_set("at").alias("ats")
    )
    by_diagonal = Window.partitionBy("doc", "th", "template").orderBy("diagonal")
    opens = F.when(F.col("diagonal") - F.lag("diagonal").over(by_diagonal) <= BAND, 0).otherwise(1)
    merged = (
        votes.withColumn("opens", opens)
        .withColumn("span", F.sum("opens").over(by_diagonal))
        .groupBy("doc", "th", "template", "span")
        .agg(
            F.min("first").alias("first"),
            (F.max("last") + GRAM).alias("end"),
            F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("covered"),
        )
        .join(F.broadcast(sizes), "template")
        .filter(F.col("covered") >= F.col("need") * F.col("n_grams"))
    )
    wholes = known.select("template", "label", F.array_distinct("whole").alias("whole")).distinct()
    found = common.stored(merged, "spans")
    hit = found.withColumnsRenamed({"doc": "hit", "th": "hit_th"})
    same = F.col("doc").eqNullSafe(F.col("hit")) & (F.col("th") == F.col("hit_th"))
    mine = texts.join(hit.select("hit", "hit_th").distinct(), same, "left_semi").dropDuplicates(["doc", "th"])
    verified = (
        hit.join(mine, same)
        .join(F.broadcast(wholes), "template")
        .withColumn("inside", F.slice("own", F.col("first") + 1, F.col("end") - F.col("first")))
        .withColumn("score", F.size(F.array_intersect("whole", "inside")) / F.size("whole"))
        .filter(F.col("score") >= WORDS_SHARED)
    )
    return verified.select("doc", "th", "label", "template", "first", "end", "score")


def phrase_places(own: Column, phrase: str) -> Column:
    """Word positions at which the words of phrase stand consecutively."""
    parts = phrase.split()
    last = F.size(own) - len(parts)

    def stands(i):
        same = F.get(own, i) == parts[0]
        for j, part in enumerate(parts[1:], 1):
            same = same & (F.get(own, i + j) == part)
        return same

    at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.filter(at, stands)


def base(docs: DataFrame) -> DataFrame:
    """doc_id, th, n_words, places (array per phrase) of every row; places are looked for where the text has the word
    `license` at all."""
    own = words(F.col("text"))
    maybe = F.lower(F.col("text")).contains("license")
    split = docs.select("doc_id", F.xxhash64("text").alias("th"), own.alias("own"), F.coalesce(maybe, F.lit(False)).alias("maybe"))
    none = F.array().cast("array<int>")
    return split.select(
        "doc_id",
        "th",
        F.size("own").cast("long").alias("n_words"),
        *[F.when(F.col("maybe"), phrase_places(F.col("own"), p)).otherwise(none).alias(f"llm_{label}") for label, p in PHRASES.items()],
    )


def scan(docs: DataFrame) -> DataFrame:
    """The columns of the query for every row of docs."""
    found = spans(docs).groupBy("doc", F.col("th").alias("doc_th")).agg(F.collect_set("label").alias("extra"), F.max("score").alias("best"))
    rows = base(docs)
    columns = [F.col(f"llm_{label}") for label in PHRASES]
    places = F.concat(*columns)
    named = F.filter(
        F.array(*[F.when(F.size(c) > 0, F.lit(label)) for label, c in zip(PHRASES, columns)]), lambda x: x.isNotNull()
    )
    rows = rows.select("doc_id", "th", "n_words", places.alias("places"), named.alias("named"))
    joined = rows.join(found, F.col("doc_id").eqNullSafe(F.col("doc")) & (F.col("th") == F.col("doc_th")), "left")
    return joined.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"),
        F.array_join(F.array_sort("named"), ",").alias("base_labels"),
        F.array_join(
            F.array_sort(F.array_union("named", F.coalesce("extra", F.array().cast("array<string>")))), ","
        ).alias("labels"),
        F.greatest(F.coalesce("best", F.lit(0.0)), F.when(F.size("places") > 0, 0.5).otherwise(0.0)).alias("score"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op6: words, base places and labels of every document."""
    return scan(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
