"""Operator 10: license notices found by min-hash bands over overlapping windows and checked by exact containment. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions.core import let
from tidewire.llm.common import BROADCAST_ROWS

#: Notices looked for unless others are given.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "mit": "Released under the MIT License.",
    "mit-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "spdx-mit": "SPDX-License-Identifier: MIT",
}
#: Bands, of one min-hash each. A window holds at least a fifth of a template's shingles at CONTAINED, so that it shares a band with a chance of 1 - 0.8 ** 32 = 0.9992 at least.
BANDS, CONTAINED = 32, 0.8
#: Needed words up to which a text is searched for each of them; beyond, its words are met with their list.
SEARCHED = 100


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits of the whole text."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), "")


def _pairs(words: str | Column, make) -> Column:
    """``make`` of each word and the one after it; nothing for fewer than two words."""
    words = F.col(words) if isinstance(words, str) else words
    n = F.size(words) - 1
    return F.when(n >= 1, F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), make))


def _size_class(n_words: Column) -> Column:
    """The power of two that holds the words, 4 at least."""
    return F.greatest(F.lit(4), F.pow(F.lit(2.0), F.ceil(F.log2(n_words.cast("double")))).cast("int"))


def _bands(hashes: str) -> Column:
    """The smallest hash of each of BANDS families over the shingles."""
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, b))))


def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """(template, width, pairs, shingles, hashes, bands): distinct word pairs of each notice; those under two words are left out."""
    df = spark.createDataFrame(sorted(templates.items()) or [("", "")], "template string, _text string").withColumn("_words", words_of(F.col("_text"))).where("size(_words) >= 2")
    pairs = F.array_distinct(_pairs("_words", lambda a, b: F.struct(a.alias("a"), b.alias("b"))))
    df = df.select("template", _size_class(F.size("_words")).alias("width"), pairs.alias("pairs"))
    df = df.withColumn("shingles", F.transform("pairs", lambda p: F.concat_ws(" ", p["a"], p["b"]))).withColumn("hashes", F.transform("pairs", lambda p: F.xxhash64(p["a"], p["b"])))
    return df.withColumn("bands", _bands("hashes"))


def needed(pairs: list[tuple[str, str]], contained: float) -> tuple[set[int], set[str]]:
    """Numbers of some pairs, and words that are in all of those, such that whoever holds the share ``contained`` of all pairs holds one of them: one more than may be missing.

    Long words are taken first, and among those the words of most pairs, so that few other texts hold one.
    """
    least = int((1 - contained) * len(pairs) + 1e-9) + 1
    of: dict[str, set[int]] = {}
    for k, pair in enumerate(pairs):
        for w in pair:
            of.setdefault(w, set()).add(k)
    held: set[int] = set()
    words: set[str] = set()
    for w in sorted(of, key=lambda w: (-min(len(w), 8), -len(of[w]), w)):
        if len(held) >= least:
            break
        if of[w] - held:
            held |= of[w]
            words.add(w)
    return held, words


def scan(docs: DataFrame, templates: dict[str, str] | None = None, contained: float = CONTAINED, text: str = "text") -> DataFrame:
    """(doc_id, template, containment, first_word, n_windows): the notices that a window of the whole text contains, a row for each document and notice.

    Windows are of twice the words of a template's size class and begin at every multiple of it, so that a notice lies whole in one. A window is compared with the templates with which it
    shares a band; the share of the template's word pairs in it must be ``contained``. Whoever holds that share holds one of the template's needed pairs: only windows around those are cut,
    and only in texts that hold a word of them, which loses none. Templates may be of any length and number.
    Null, empty and one-word texts give no row. Very long texts are scanned whole. Rows with the same id, repeated ones too, are one document; a null id is an id. An empty table, or no
    template, gives no row. Other columns, whatever their names, are not read.
    """
    spark = docs.sparkSession
    templates = TEMPLATES if templates is None else templates
    known = template_table(spark, templates)
    widths_of: dict[int, set[int]] = {}
    words: set[str] = set()
    for r in known.select("width", "pairs", "hashes").collect():  # what the caller has given
        held, own = needed([tuple(p) for p in r["pairs"]], contained)
        words |= own
        for k in held:
            widths_of.setdefault(r["hashes"][k], set()).add(r["width"])
    low = F.lower(F.coalesce(F.col(text).cast("string"), F.lit("")))
    if not words:
        may_hold = F.lit(False)
    elif len(words) <= SEARCHED:
        may_hold = F.coalesce(let(low, lambda t: F.exists(F.lit(sorted(words)), lambda w: F.contains(t, w))), F.lit(False))
    else:
        may_hold = F.arrays_overlap(words_of(F.col(text).cast("string")), F.lit(sorted(words)))
    cut = docs.where(may_hold).select(F.col("doc_id").cast("long").alias("doc_id"), words_of(F.col(text).cast("string")).alias("words")).withColumn("hashes", _pairs("words", lambda a, b: F.xxhash64(a, b)))
    w = cut.select("doc_id", "words", "hashes", F.explode(_windows_around(widths_of)).alias("at")).select(
        "doc_id", "at.width", "at.start", F.slice("words", F.col("at.start") + 1, 2 * F.col("at.width")).alias("words"), F.slice("hashes", F.col("at.start") + 1, 2 * F.col("at.width") - 1).alias("hashes")
    )
    met = w.select("doc_id", "width", "start", "words", F.posexplode(_bands("hashes")).alias("band", "v"))
    keys = known.select("template", F.col("width").alias("_width"), "shingles", F.posexplode("bands").alias("_band", "_v"))
    keys = F.broadcast(keys) if sum(map(len, templates.values())) <= BROADCAST_ROWS else keys  # by the letters of all templates
    pairs = met.join(keys, (F.col("width") == F.col("_width")) & (F.col("band") == F.col("_band")) & (F.col("v") == F.col("_v")))
    share = F.size(F.array_intersect("shingles", _pairs("words", lambda a, b: F.concat_ws(" ", a, b)))) / F.size("shingles")
    once = pairs.groupBy("doc_id", "template", "start").agg(F.max(share).alias("containment"))
    return once.where(F.col("containment") >= contained - 1e-9).groupBy("doc_id", "template").agg(F.max("containment").alias("containment"), F.min("start").cast("long").alias("first_word"), F.count("*").alias("n_windows"))


def _windows_around(widths_of: dict[int, set[int]]) -> Column:
    """Distinct (width, start) of the windows that hold a needed pair, for the widths of the templates that need it."""
    if not widths_of:
        return F.expr("cast(array() as array<struct<width:int,start:int>>)")
    by_width: dict[int, list[int]] = {}
    for h, widths in sorted(widths_of.items()):
        for width in widths:
            by_width.setdefault(width, []).append(h)

    def around(width: int, needed_hashes: list[int]) -> Column:
        places = F.filter(F.transform("hashes", lambda h, i: F.when(h.isin(needed_hashes), i)), lambda i: i.isNotNull())
        here = lambda i: F.floor(i / width).cast("int") * width
        starts = F.flatten(F.transform(places, lambda i: F.array(here(i), F.when(i - here(i) < width - 1, here(i) - width))))
        return F.transform(F.array_distinct(F.filter(starts, lambda s: s >= 0)), lambda s: F.struct(F.lit(width).alias("width"), s.alias("start")))

    return F.flatten(F.array(*[around(width, hashes) for width, hashes in sorted(by_width.items())]))
