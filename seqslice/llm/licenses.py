"""Operator 9, licence scans by a positional rare-token index. DataFrame functions only.

The template texts' words and their positions form a small constant index. Document frequencies of its words are counted
over all documents. In each file a template's highest-IDF words are looked up, as many as every offset that may score
enough must agree with; their places minus the template's places are offsets, and a template's score is the largest IDF
share of its words that agrees on one offset. A label is given when that share is large enough and the template's
mandatory key phrases stand in the text. Every template is scored with all of its words, however frequent they are and
whatever other notices the file holds: IDF orders the look-up and weighs words, and drops none.
Base phrases are found word by word beside that and always labelled.

Nulls: a null text is an empty one; empty texts get no labels, score 0 and null places. Ties between templates give both
labels. Repeated rows get equal results; an empty table gives an empty result; extra columns do not matter.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import count_plain, plain_words, stage, table

# Base phrases and their labels.
BASE = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]

# Label, text of the notice as published by the licence's steward, key phrases that must stand in a file.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license", ["apache license version 2 0"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license version 2 0"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted free of charge"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("bsd", "licensed under the bsd 3 clause license", ["bsd 3 clause"]),
    ("bsd", "licensed under the bsd 2 clause license", ["bsd 2 clause"]),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", ["gnu general public license", "version 2"]),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ["gnu general public license", "version 3"]),
    ("lgpl", "gnu lesser general public license", ["lesser general public license"]),
    ("agpl", "gnu affero general public license", ["affero general public license"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee is hereby granted"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software released into the public domain"]),
    ("cc0", "licensed under creative commons zero cc0 1 0 universal public domain dedication", ["cc0 1 0"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by-nd", "licensed under cc by nd 4 0", ["cc by nd"]),
    ("cc-by", "creative commons attribution 4 0 international license", ["creative commons attribution"]),
]
NONE = "CAST(array() AS array<int>)"


def _places(t: Column, w: Column, phrase: str) -> Column:
    """Word positions where the phrase's words stand consecutively; words are only walked in texts that hold it."""
    ws = phrase.split(" ")
    at = F.filter(F.sequence(F.lit(0), F.size(w) - len(ws)), lambda i: reduce(lambda a, b: a & b, [F.get(w, i + k) == x for k, x in enumerate(ws)]))
    return F.when(F.contains(F.concat(F.lit(" "), t, F.lit(" ")), F.lit(f" {phrase} ")), at).otherwise(F.expr(NONE))


def _has(t: Column, phrase: str) -> Column:
    return F.contains(F.concat(F.lit(" "), t, F.lit(" ")), F.lit(f" {phrase} "))


def scan(docs: DataFrame, templates=TEMPLATES, least: float = 0.6) -> DataFrame:
    """Per row of docs: doc_id, n_words, places (of base phrases), base (labels), found (labels of templates), score."""
    d = docs.select("doc_id", plain_words(F.col("text")).alias("t"))
    vocab = sorted({w for _, text, _ in templates for w in text.split(" ")})
    lit = F.array(*[F.lit(w) for w in vocab])
    seen = d.select(F.explode_outer(F.array_intersect(F.split("t", " "), lit)).alias("w"))
    df = {r["w"]: r["n"] for r in seen.groupBy("w").agg(F.count("*").alias("n")).collect()}  # a row per template word
    n = max(1, docs.count())
    idf = {w: math.log((n + 1) / (df.get(w, 0) + 0.5)) for w in vocab}
    order = sorted(vocab, key=lambda w: (-idf[w], w))
    d = d.withColumn("n_words", count_plain(F.col("t"))).withColumn("_w", F.split("t", " "))
    for k, (phrase, _) in enumerate(BASE):
        d = d.withColumn(f"_b{k}", _places(F.col("t"), F.col("_w"), phrase))
    words = F.col("_w")
    shares = []
    for label, text, keys in templates:
        post: dict[str, list[int]] = {}
        for p, w in enumerate(text.split(" ")):
            post.setdefault(w, []).append(p)
        total = left = sum(idf[w] for w in post)
        # an offset that scores enough agrees in one of these words, as the others together weigh too little
        anchors = []
        for w in (w for w in order if w in post):
            if left < (least - 1e-9) * total:
                break
            anchors.append(w)
            left -= idf[w]

        def offsets(w: str, ps: list[int]) -> Column:
            at = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(words, i) == w)
            return F.flatten(F.transform(at, lambda i: F.array(*[i - p for p in ps])))

        def share(o: Column) -> Column:
            agrees = lambda w, ps: reduce(lambda a, b: a | b, [F.coalesce(F.get(words, o + p) == w, F.lit(False)) for p in ps])
            return reduce(lambda a, b: a + b, [F.when(agrees(w, ps), F.lit(idf[w] / total)).otherwise(F.lit(0.0)) for w, ps in post.items()])

        places = F.array_distinct(F.flatten(F.array(*[offsets(w, post[w]) for w in anchors])))
        best = F.aggregate(places, F.lit(0.0), lambda a, o: F.greatest(a, share(o)))
        sure = reduce(lambda a, b: a & b, [_has(F.col("t"), k) for k in keys])
        shares.append(F.when(sure, F.struct(F.lit(label).alias("l"), best.alias("v"))))
    found = F.filter(F.array(*shares), lambda x: x.isNotNull() & (x["v"] >= least))
    d = d.withColumn("_found", found)
    base = F.array_compact(F.array(*[F.when(F.size(f"_b{k}") > 0, F.lit(x)) for k, (_, x) in enumerate(BASE)]))
    places = F.concat(*[F.col(f"_b{k}") for k in range(len(BASE))])
    top = F.aggregate("_found", F.lit(0.0), lambda a, x: F.greatest(a, x["v"]))
    score = F.when(F.size(base) > 0, F.lit(1.0)).otherwise(F.least(top, F.lit(1.0)))
    return d.select("doc_id", "n_words", places.alias("places"), F.array_sort(base).alias("base"), F.array_sort(F.array_distinct(F.transform("_found", lambda x: x["l"]))).alias("found"), score.alias("score"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = scan(table(spark, sf_dir, "documents"))
    n = F.size("places")
    labels = F.array_sort(F.array_distinct(F.concat("base", "found")))
    return d.select("doc_id", "n_words", n.cast("long").alias("n_base"), F.array_min("places").cast("long").alias("first_word"), F.array_max("places").cast("long").alias("last_word"), F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), "score")
