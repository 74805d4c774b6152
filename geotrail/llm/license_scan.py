"""License scans by diagonal voting: word pairs joined to template positions, votes per offset diagonal, verified spans."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import emit_arrow, texts
from .substring_dedup import mix, word_hashes

#: Phrases whose places count one by one, with their labels.
PHRASES = (("mit", "MIT License"), ("apache", "Apache License"), ("gpl", "General Public License"))
#: Wording of public licences that is looked for as a whole, with small changes, but for words with a star.
NOTICES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0-notice", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("bsd-conditions", "Redistribution and use in source and binary forms, with or without modification, *are *permitted provided that the following conditions are met"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("apache-1.1", "Licensed under the Apache License, Version 1.1"),
    ("bsd-names", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License"),
    ("gpl-2.0", "licensed under the *GNU *General Public License, version 2"),
    ("gpl-3.0", "licensed under the *GNU *General Public License, version 3"),
    ("lgpl-2.1", "licensed under the GNU *Lesser General Public License, version 2.1"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the *GNU *General Public License as published by the Free Software Foundation"),
    ("mit-grant", "Released under the MIT License"),
    ("mit-permission", "Permission is hereby *granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
)
#: Words of a gram, the step between neighbouring diagonals, and the share of a template's grams that verifies a span.
GRAM, NEIGHBOUR, SHARE = 2, 2, 0.8
#: Template positions up to which the join may broadcast them.
BROADCAST_ROWS = 100_000

#: Stands before a number that a point joins to the one before it: 2.0 is 2 and JOINED 0.
JOINED = b"\x02"
_POINT = re.compile(rb"(?<=[0-9])\.(?=[0-9])")
_CUT = bytes(b if b == JOINED[0] or 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
#: The same words as a pattern over the text as it is: lowering A-Z moves no border.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: str | None) -> list[bytes]:
    """Runs of digits, letters a-z (A-Z lowered) and all other than ASCII; parts of one number are marked as joined."""
    return _POINT.sub(b" " + JOINED, text.encode().lower().replace(JOINED, b" ")).translate(_CUT).split() if text else []


def numbers_go_on(words: list[bytes]) -> list[bool]:
    """For each gram whether the word behind it is joined to it: version 2 of 2.1 is not version 2."""
    after = [w[:1] == JOINED for w in words[GRAM:]]
    return [*after, False] if len(words) >= GRAM else []


def gram_hashes(words: list[bytes]) -> np.ndarray:
    """Signed hashes of all rolling GRAM-word grams."""
    if len(words) < GRAM:
        return np.zeros(0, np.int64)
    h = word_hashes(words)
    n = len(h) - GRAM + 1
    out = np.zeros(n, np.uint64)
    for k in range(GRAM):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    return out.view(np.int64)


def template_rows(phrases: tuple = PHRASES, notices: tuple = NOTICES) -> list[tuple]:
    """(hash, template, label, is_base, grams, needs, place, needed) of every gram of every template; grams with a number
    or a word with a star are needed."""
    rows = []
    for t, (label, wording, base) in enumerate([*((a, b, True) for a, b in phrases), *((a, b, False) for a, b in notices)]):
        words, fixed = [], []
        for part in wording.split():
            own = words_of(part)
            words += own
            fixed += [part[0] == "*" or w.lstrip(JOINED)[:1].isdigit() for w in own]
        grams = gram_hashes(words).tolist()
        needed = [any(fixed[k : k + GRAM]) for k in range(len(grams))]
        if not grams:
            raise ValueError(f"{wording!r} has fewer than {GRAM} words")
        rows += [(h, t, label, base, len(grams), sum(needed), k, needed[k]) for k, h in enumerate(grams)]
    return rows


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", phrases: tuple = PHRASES, notices: tuple = NOTICES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score): one row per input row.

    Base: a diagonal with the votes of all grams of a phrase is a place of it. Notices: neighbouring diagonals, as
    insertions and deletions make them, count together; a span is verified by the share of the template's grams found
    in it, among which must be all that hold a number or a word with a star (else the share counts as a half at most); a
    number at a notice's end must end there in the text, too. ``score``: the largest share of any template, 1 for a phrase or a whole notice, 0 without a shared gram. Null
    and empty texts have no word, no label, null places and score 0. Texts are known by 128 bits of hash: copies are
    scanned but voted on once, and repeated rows stay. Templates are a parameter, broadcast only below BROADCAST_ROWS.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"))
    spark = docs.sparkSession
    rows = template_rows(phrases, notices)
    templates = spark.createDataFrame(rows, "h long, template int, label string, base boolean, grams int, needs int, place int, needed boolean")
    templates = F.broadcast(templates) if len(rows) <= BROADCAST_ROWS else templates

    def kernel(batch: pa.RecordBatch) -> list:
        words = [words_of(t) for t in texts(batch, "text")]
        going = [[k for k, on in enumerate(numbers_go_on(w)) if on] for w in words]
        return [batch.column("k1"), batch.column("k2"), [gram_hashes(w) for w in words], going]

    grams = emit_arrow(own.select("text", "k1", "k2"), kernel, "k1 long, k2 long, grams array<long>, going array<int>")
    grams = grams.select("k1", "k2", "going", F.posexplode("grams").alias("pos", "h"))
    key = ["k1", "k2", "template", "label", "base", "grams", "needs"]
    hits = grams.join(templates, "h").withColumn("diagonal", F.col("pos") - F.col("place"))
    hits = hits.where(~(F.col("needed") & (F.col("place") == F.col("grams") - 1) & F.array_contains("going", F.col("pos"))))
    votes = hits.groupBy(*key, "diagonal").agg(F.collect_set("place").alias("places"), F.collect_set(F.when(F.col("needed"), F.col("place"))).alias("numbers"))  # at most the grams of a template
    votes = votes.withColumn("n", F.size("places"))
    places = votes.where("base and n = grams").groupBy("k1", "k2").agg(
        F.count("*").alias("n_base"), F.min("diagonal").cast("long").alias("first_word"), F.max("diagonal").cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set("label")), ",").alias("base_labels"), F.collect_set("label").alias("found"))
    order = Window.partitionBy(*key).orderBy("diagonal")
    fresh = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > NEIGHBOUR, F.lit(True))
    spans = votes.where("not base").withColumn("fresh", fresh.cast("int")).withColumn("span", F.sum("fresh").over(order))
    united = lambda c: F.size(F.array_distinct(F.flatten(F.collect_list(c))))
    spans = spans.groupBy(*key, "span").agg(united("places").alias("n"), united("numbers").alias("n_numbers"))
    # a span that lacks a needed gram is of another licence or version, whatever else it has
    share = F.col("n") / F.col("grams")
    spans = spans.withColumn("share", F.when(F.col("n_numbers") == F.col("needs"), share).otherwise(F.least(share, F.lit(0.5))))
    noted = spans.groupBy("k1", "k2").agg(F.collect_set(F.when(F.col("share") >= SHARE, F.col("label"))).alias("noted"), F.max("share").alias("share"))
    none = F.array().cast("array<string>")
    both = places.join(noted, ["k1", "k2"], "full").select(
        "k1", "k2", "n_base", "first_word", "last_word", "base_labels",
        F.array_join(F.sort_array(F.array_union(F.coalesce("found", none), F.coalesce("noted", none))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"))
    counted = own.select("doc_id", "k1", "k2", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_words"))
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return counted.join(both, ["k1", "k2"], "left").select("doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word", blank("base_labels"), blank("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))
