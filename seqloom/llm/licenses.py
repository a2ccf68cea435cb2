"""License notices (operator 3), with DataFrame functions alone.

Method: exact set-similarity join of blocks of words with templates. The tokens of all templates are put in one global order, rarest in the corpus
first. A block that holds a share `CONTAINED` of a template's tokens holds one of its first tokens in that order, so only
texts with such a token are cut into blocks, and blocks meet templates on these tokens alone (prefix filter). Blocks that are
too small (length filter), or whose tokens from the met one on are too few (positional filter), are dropped before the
overlap is counted.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from seqloom.session import cut_lineage

CONTAINED = 0.8
BLOCK, STEP = 32, 16  # words of a block, and from one block to the next; templates of up to STEP + 1 words lie within one

# Phrases whose places are counted, and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Well-known sentences of licenses, in lower case and without punctuation.
TEMPLATES = {
    "text:apache-2.0": ["licensed under the apache license version 2 0"],
    "text:bsd": ["redistribution and use in source and binary forms with or without modification are permitted"],
    "text:cc-by-4.0": ["this work is licensed under a creative commons attribution 4 0 international license"],
    "text:cc-by-nc-4.0": ["licensed under cc by nc 4 0"],
    "text:epl": ["this program and the accompanying materials are made available under the terms of the eclipse public license"],
    "text:gpl": [
        "this work is licensed under the gnu general public license version",
        "this program is free software you can redistribute it and or modify it under the terms",
    ],
    "text:isc": ["permission to use copy modify and or distribute this software for any purpose with or without fee"],
    "text:mit": [
        "released under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software",
    ],
    "text:mpl": ["this source code form is subject to the terms of the mozilla public license"],
    "text:no-warranty": ["the software is provided as is without warranty of any kind express or implied"],
    "text:public-domain": ["this is free and unencumbered software released into the public domain"],
    "text:reserved": ["all rights reserved"],
}

_IN = r"0-9A-Za-z\x{80}-\x{10FFFF}"  # what words are made of
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str) -> Column:
    return F.filter(F.split(F.translate(text, _UPPER, _LOWER), f"[^{_IN}]+"), lambda w: w != "")


def _holds(text: str, words: list[str], gap: str = f"[^{_IN}]+") -> Column:
    """Whether one of `words` (phrases with blanks) stands in the text, without cutting it up; case of A-Z is ignored."""
    every = "|".join(gap.join(w.split()) for w in sorted(words))
    return F.col(text).rlike(f"(?i)(?<![{_IN}])(?:{every})(?![{_IN}])")


def _places_of(words: Column, phrase: str, label: str) -> Column:
    parts = phrase.split()

    def begins(word, i):
        here = word == parts[0]
        for k, part in enumerate(parts[1:], 1):
            here = here & (F.get(words, i + k) == part)
        return F.when(here, i)

    places = F.filter(F.transform(words, begins), lambda i: i.isNotNull())
    return F.transform(places, lambda i: F.struct(i.alias("at"), F.lit(label).alias("label")))


def _places(words: Column) -> Column:
    """(number of the first word, label) of every place of a phrase, in order."""
    return F.array_sort(F.concat(*[_places_of(words, phrase, label) for phrase, label in PHRASES.items()]))


def _ranked_templates(texts: DataFrame, templates: dict[str, list[str]], contained: float):
    """Token -> rank, rarest in the corpus first, and (label, ranks ascending, tokens that must be shared) per template."""
    vocabulary = sorted({t for texts in templates.values() for s in texts for t in s.split()})
    # The vocabulary of the templates bounds what is returned; the counts are of all words of all texts.
    words = texts.select(F.explode(F.split(F.translate("text", _UPPER, _LOWER), f"[^{_IN}]+")).alias("word"))
    seen = dict(words.where(F.col("word").isin(vocabulary)).groupBy("word").count().collect())
    rank = {t: i for i, t in enumerate(sorted(vocabulary, key=lambda t: (seen.get(t, 0), t)))}
    rows = []
    for label, sentences in templates.items():
        for sentence in sentences:
            ranks = sorted({rank[t] for t in sentence.split()})
            rows.append((label, ranks, math.ceil(contained * len(ranks) - 1e-9)))
    return rank, rows


def find_licenses(documents: DataFrame, templates: dict[str, list[str]] | None = None, contained: float = CONTAINED) -> DataFrame:
    """License phrases and templates in whole texts.

    `documents` needs `doc_id` and `text`; other columns are ignored. Null text is empty and has no words. A block that holds `contained`
    of a template's different tokens gives the template's label; phrases give theirs at every place. Equal texts get equal results,
    every row gives a row, an empty table gives none.

    Returns doc_id, n_words, n_base, first_word, last_word (null without a place), base_labels, labels, score (the largest share of
    a template in a block, 1 where a phrase stands, else 0).
    """
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rank, rows = _ranked_templates(texts, TEMPLATES if templates is None else templates, contained)
    key = F.md5("text")
    spark = documents.sparkSession

    base = texts.withColumn("places", F.when(_holds("text", list(PHRASES)), _places(_words("text")))).select(
        "doc_id", key.alias("key"), F.regexp_count("text", F.lit(f"[{_IN}]+")).cast("long").alias("n_words"), "places")

    first = {}  # tokens that a template's block must hold one of, with where they stand in it
    for number, (_, ranks, need) in enumerate(rows):
        for i, r in enumerate(ranks[: len(ranks) - need + 1]):
            first.setdefault(r, []).append((number, i))
    prefixes = spark.createDataFrame([(r, n, i) for r, of in first.items() for n, i in of], "token int, template int, place int")
    table = spark.createDataFrame([(n, label, ranks, need) for n, (label, ranks, need) in enumerate(rows)], "template int, label string, ranks array<int>, need int")
    table = prefixes.join(table, "template")
    token = {r: t for t, r in rank.items()}

    ranks = F.create_map(*[F.lit(x) for t, r in rank.items() for x in (t, r)])
    words = F.col("words")
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(words) / STEP) - 2, F.lit(0)))
    blocks = texts.where(_holds("text", [token[r] for r in first])).select(key.alias("key"), _words("text").alias("words"))
    blocks = blocks.select("key", F.explode(F.transform(starts, lambda b: F.slice(words, (b * STEP + 1).cast("int"), F.lit(BLOCK)))).alias("block"))
    numbered = F.array_sort(F.array_distinct(F.filter(F.transform("block", lambda w: ranks[w]), lambda r: r.isNotNull())))
    blocks = blocks.select("key", numbered.alias("tokens")).where(F.size("tokens") > 0)
    met = blocks.select("key", "tokens", F.posexplode("tokens").alias("at", "token")).join(table, "token")
    # what may be shared: as much as stands before on both sides, the token itself, and what follows
    most = F.least("at", "place") + 1 + F.least(F.size("tokens") - F.col("at") - 1, F.size("ranks") - F.col("place") - 1)
    met = met.where((F.size("tokens") >= F.col("need")) & (most >= F.col("need")))
    shared = F.size(F.array_intersect("tokens", "ranks"))
    found = met.where(shared >= F.col("need")).groupBy("key").agg(
        F.collect_set("label").alias("found"), F.max(shared / F.size("ranks")).alias("share"))
    found = cut_lineage(found)  # then both sides of the join are plain, and a text with very many copies can be split

    joined = base.join(found, "key", "left")
    own = F.array_sort(F.array_distinct(F.transform(F.coalesce("places", F.array().cast("array<struct<at:int,label:string>>")), lambda p: p["label"])))
    n = F.coalesce(F.size("places"), F.lit(0)).cast("long")
    n = F.when(F.col("places").isNull(), F.lit(0).cast("long")).otherwise(n)
    return joined.select(
        "doc_id", "n_words", n.alias("n_base"),
        F.when(n > 0, F.get("places", F.lit(0))["at"]).cast("long").alias("first_word"),
        F.when(n > 0, F.get("places", F.size("places") - 1)["at"]).cast("long").alias("last_word"),
        F.array_join(own, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(own, F.coalesce("found", F.array().cast("array<string>")))), ",").alias("labels"),
        F.greatest(F.coalesce("share", F.lit(0.0)), F.when(n > 0, F.lit(1.0)).otherwise(F.lit(0.0))).alias("score"),
    )
