"""License scans by diagonal voting.

Every run of ``GRAM_WORDS`` words of every text is joined by its hash to the places where the license
templates hold the same run.  Word place less template place is the diagonal of a hit: the words of
one occurrence of a template lie on one diagonal, or on neighbouring ones where words were put in or
left out.  Hits are tallied per text, template and diagonal; neighbouring diagonals are merged to
spans; a span is verified by the words that it shares with its template in the template's order.

Hits are found per text content (its SHA-256) and folded before the shuffle, so a group of copies
counts as one text; what is found goes back to every row with that content.  Texts are not moved.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from signalbook.llm.common import ascii_lower, staged, text_of

WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GRAM_WORDS = 3
#: Diagonals that lie at most so many words apart belong to one occurrence.
MAX_SHIFT = 3
#: Share of a template's words that a span must hold in order.
COVERAGE = 0.8
#: Words of a span per word of its template, at most.
STRETCH = 1.5
#: All templates together; their runs are broadcast.
MAX_TEMPLATE_WORDS = 200_000


class Template(NamedTuple):
    label: str
    text: str
    #: Found only where all words stand consecutively.
    exact: bool = False


# The phrases that are found exactly, and the notices by which licenses are announced.
PHRASES = (
    Template("mit", "under the mit license", True),
    Template("apache-2", "apache license version 2", True),
    Template("cc-by-nc", "cc by nc", True),
)
NOTICES = (
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so"),
    Template("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("gpl-3", "licensed under the gnu general public license version 3"),
    Template("gpl-2", "licensed under the gnu general public license version 2"),
    Template("gpl", "it under the terms of the gnu general public license as published by the free software foundation either version"),
    Template("lgpl", "it under the terms of the gnu lesser general public license as published by the free software foundation either version"),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
    Template("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    Template("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    Template("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    Template("cc-by", "licensed under a creative commons attribution 4 0 international license"),
)
TEMPLATES = PHRASES + NOTICES

SPANS = "array<struct<start:bigint,label:string,end:bigint,exact:boolean,score:double>>"


def template_words(text: str) -> list[str]:
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return [word for word in re.split(WORD_GAP, lowered) if word]


def template_grams(spark: SparkSession, templates: Sequence[Template], gram_words: int = GRAM_WORDS) -> DataFrame:
    """One row per run of words of a template: gram_hash, gram, template, label, exact, size, place."""
    rows, total = [], 0
    for number, template in enumerate(templates):
        held = template_words(template.text)
        if len(held) < gram_words:
            raise ValueError(f"a template needs {gram_words} words: {template.text!r}")
        total += len(held)
        for place in range(len(held) - gram_words + 1):
            gram = " ".join(held[place : place + gram_words])
            rows.append((gram, number, template.label, template.exact, len(held), place))
    if total > MAX_TEMPLATE_WORDS:
        raise ValueError(f"templates have {total} words, more than {MAX_TEMPLATE_WORDS}")
    schema = "gram string, template int, label string, exact boolean, size int, place int"
    return spark.createDataFrame(rows, schema).withColumn("gram_hash", F.xxhash64("gram"))


def license_words(text: Column) -> Column:
    """Lower-cased words of letters, digits and characters beyond ASCII."""
    return F.array_remove(F.split(ascii_lower(text), WORD_GAP), "")


def _grams(held: Column, gram_words: int) -> Column:
    """All runs of words, in order."""
    runs = lambda w: F.transform(
        F.slice(w, F.lit(1), F.greatest(F.size(w) - (gram_words - 1), F.lit(0))),
        lambda word, i: F.concat_ws(" ", word, *[F.get(w, i + k) for k in range(1, gram_words)]),
    )
    # Bound to a variable, so that the words are not split again for every run.
    return F.transform(F.array(held), runs)[0]


def votes(docs: DataFrame, templates: Sequence[Template], gram_words: int = GRAM_WORDS, text_col: str = "text") -> DataFrame:
    """content, template, label, exact, size, diagonal and the template places hit on it, in order."""
    text = text_of(F.col(f"`{text_col}`"))
    runs = docs.select(F.sha2(text, 256).alias("content"), F.posexplode(_grams(license_words(text), gram_words)).alias("at", "gram"))
    # Bounded by MAX_TEMPLATE_WORDS, so this side may be broadcast.
    known = F.broadcast(template_grams(docs.sparkSession, templates, gram_words))
    hits = runs.withColumn("gram_hash", F.xxhash64("gram")).join(known, ["gram_hash", "gram"])
    return (
        hits.groupBy("content", "template", "label", "exact", "size", (F.col("at") - F.col("place")).alias("diagonal"))
        .agg(F.collect_set("place").alias("places"))
        .withColumn("places", F.array_sort("places"))
    )


def _shared_words(hits: Column, gram_words: int) -> Column:
    """Template words covered by hits (at, place) that go on in the template, each counted once."""
    start = F.struct(F.lit(-gram_words).alias("last"), F.lit(0).alias("words"))
    step = lambda acc, hit: F.when(
        hit["place"] > acc["last"],
        F.struct(hit["place"].alias("last"), (acc["words"] + F.least(F.lit(gram_words), hit["place"] - acc["last"])).alias("words")),
    ).otherwise(acc)
    return F.aggregate(hits, start, step, lambda acc: acc["words"])


def spans(
    voted: DataFrame, gram_words: int = GRAM_WORDS, max_shift: int = MAX_SHIFT, coverage: float = COVERAGE, stretch: float = STRETCH
) -> DataFrame:
    """content and its verified spans, in order: start, label, end (exclusive), exact, score."""
    whole = voted.where("exact").where(F.size("places") == F.col("size") - (gram_words - 1))
    phrases = whole.select(
        "content", "template", "label", "exact", F.col("diagonal").alias("start"),
        (F.col("diagonal") + F.col("size")).alias("end"), F.lit(1.0).alias("score"),
    )
    order = Window.partitionBy("content", "template").orderBy("diagonal")
    begins = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(order) > max_shift).cast("int"), F.lit(1))
    cluster = F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0))
    hit = F.transform("places", lambda p: F.struct((F.col("diagonal") + p).alias("at"), p.alias("place")))
    merged = (
        voted.where(~F.col("exact"))
        .withColumn("begins", begins)
        .withColumn("cluster", cluster)
        .groupBy("content", "template", "label", "exact", "size", "cluster")
        .agg(F.array_sort(F.flatten(F.collect_list(hit))).alias("hits"))
    )
    notices = (
        merged.select(
            "content", "template", "label", "exact", "size",
            F.array_min("hits")["at"].alias("start"),
            (F.array_max("hits")["at"] + gram_words).alias("end"),
            (_shared_words(F.col("hits"), gram_words) / F.col("size")).alias("score"),
        )
        .where((F.col("score") >= coverage) & (F.col("end") - F.col("start") <= stretch * F.col("size")))
        .drop("size")
    )
    one = F.struct(F.col("start").cast("long").alias("start"), "label", F.col("end").cast("long").alias("end"), "exact", "score")
    return phrases.unionByName(notices).groupBy("content").agg(F.array_sort(F.collect_list(one)).alias("spans"))


def scan(
    docs: DataFrame,
    templates: Sequence[Template] = TEMPLATES,
    gram_words: int = GRAM_WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    **limits,
) -> DataFrame:
    """doc_id, n_words and spans: one row per row of ``docs``.

    Spans are counted in words from 0, end exclusive; an exact template scores 1, another the share
    of its words that stand in the span in order.  A null or empty text has no words and no spans;
    repeated rows have the same; other columns are ignored; an empty table gives no rows.
    """
    text = text_of(F.col(f"`{text_col}`"))
    # Written once: phrases and notices both read the tallies, and the texts are searched once.
    voted = staged(votes(docs, templates, gram_words, text_col), "license-votes")
    found = spans(voted, gram_words, **limits)
    rows = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), F.sha2(text, 256).alias("content"), F.size(license_words(text)).cast("long").alias("n_words")
    )
    return rows.join(found, "content", "left").select(
        "doc_id", "n_words", F.coalesce("spans", F.array().cast(SPANS)).alias("spans")
    )
