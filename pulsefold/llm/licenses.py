"""License scans: a positional index over licence templates, weighted by the rareness of words, and phrases that always count."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import held, text_of, written

#: Words of the query, in texts of either case.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Phrases that count wherever their words stand consecutively, and their labels.
PHRASES = (
    (("mit", "license"), "mit"),
    (("apache", "license"), "apache"),
    (("general", "public", "license"), "gpl"),
)
#: Label, opening words of the licence or of its notice, phrase that must stand in the file, and a word of that phrase by which files are looked up.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "permission is hereby granted free of charge", "hereby"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "in compliance with the license", "compliance"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "redistribute it and or modify it", "redistribute"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms", "redistribution"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "for any purpose with or without fee", "fee"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license", "mozilla"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software", "unencumbered"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc", "cc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa", "cc"),
    ("cc-by", "licensed under cc by 4 0", "cc by 4 0", "cc"),
    ("proprietary", "all rights reserved no part of this work may be reproduced", "all rights reserved", "reserved"),
)
#: Whole licences (fixed texts, without their copyright lines): label, text, the phrases that must all stand in the file, and the word by which files are looked up.
WHOLE = (
    (
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
        in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
        copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
        FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
        LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
        ("permission is hereby granted free of charge", "this permission notice shall be included in all copies", "without warranty of any kind"),
        "hereby",
    ),
    (
        "bsd-3-clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
        and/or other materials provided with the distribution.
        3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software
        without specific prior written permission.""",
        ("redistributions of source code must retain", "redistributions in binary form must reproduce", "to endorse or promote products derived from this software"),
        "redistribution",
    ),
    (
        "isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above
        copyright notice and this permission notice appear in all copies.
        THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
        AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
        LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
        PERFORMANCE OF THIS SOFTWARE.""",
        ("for any purpose with or without fee is hereby granted", "appear in all copies", "the author disclaims all warranties"),
        "fee",
    ),
    (
        "zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from
        the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and
        redistribute it freely, subject to the following restrictions:
        1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product,
        an acknowledgment in the product documentation would be appreciated but is not required.
        2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
        3. This notice may not be removed or altered from any source distribution.""",
        ("the origin of this software must not be misrepresented", "altered source versions must be plainly marked as such"),
        "misrepresented",
    ),
    (
        "unlicense",
        """This is free and unencumbered software released into the public domain.
        Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
        purpose, commercial or non-commercial, and by any means.
        In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the
        public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication
        to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.""",
        ("free and unencumbered software", "to the detriment of our heirs and successors"),
        "unencumbered",
    ),
)
#: The share of a template's weight that must agree in position.
ALIGNED = 0.5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """The words of a text with A-Z lower-cased."""
    return F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(WORD), F.lit(0))


def _split(text: str) -> list[str]:
    return re.findall(WORD, text.translate(str.maketrans(_UPPER, _LOWER)))


def _phrases(template) -> list[tuple[str, ...]]:
    """The mandatory phrases of a template, which has one or a tuple of them."""
    return [tuple(_split(p)) for p in ((template[2],) if isinstance(template[2], str) else template[2])]


def _anchors(templates) -> list[str]:
    return sorted({x[3] for x in templates} | {words[-1] for words, _ in PHRASES})


def _hits(words: Column, templates) -> Column:
    """array<struct<at, word>>: the words that stand in a template or phrase, with their places."""
    placed = F.transform(words, lambda w, i: F.struct(i.alias("at"), w.alias("word")))
    return F.filter(placed, lambda h: h["word"].isin(*vocabulary(templates)))


def _stands(hits: Column, phrase: tuple[str, ...]) -> Column:
    """The places in the text where the words of the phrase stand consecutively; `hits` are in order."""
    # the index of a lambda counts the hits, of which consecutive words are neighbours
    here = F.transform(hits, lambda h, i: F.when(_all([F.get(hits, i + k)["word"] == w for k, w in enumerate(phrase)] + [F.get(hits, i + len(phrase) - 1)["at"] == h["at"] + len(phrase) - 1]), h["at"]))
    return F.array_compact(here)


def _places(hits: Column) -> Column:
    """array<struct<at, label>>: where the words of a phrase stand consecutively."""
    of = lambda label: lambda at: F.struct(at.cast("long").alias("at"), F.lit(label).alias("label"))
    return F.concat(*[F.transform(_stands(hits, phrase), of(label)) for phrase, label in PHRASES])


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return F.coalesce(out, F.lit(False))


def postings(spark: SparkSession, templates=TEMPLATES + WHOLE) -> DataFrame:
    """(word, template, position): as many rows as the templates have words; template is the number of one."""
    return spark.createDataFrame([(w, n, i) for n, t in enumerate(templates) for i, w in enumerate(_split(t[1]))], "word string, template int, position int")


def vocabulary(templates=TEMPLATES + WHOLE) -> list[str]:
    return sorted({w for t in templates for w in _split(t[1])} | {w for t in templates for p in _phrases(t) for w in p} | {w for phrase, _ in PHRASES for w in phrase})


def weights(files: DataFrame, n_files: int, templates=TEMPLATES + WHOLE, share: float = ALIGNED) -> DataFrame:
    """`postings` with weight, rare, whole and need; files (known array<string>) has the licence words of each of the `n_files` texts, copies included.

    weight is the inverse document frequency, 0.01 at least, and whole its sum over the template. The words of a template are rare, from the highest
    weight down, until those that are left weigh less than half of `share` of it: at an offset where a file reaches the share, the weights of
    the rare words in their places add up to `need`, about the other half, at least.
    """
    counts = files.select(F.explode("known").alias("word")).groupBy("word").agg(F.count("*").alias("files"))
    index = postings(files.sparkSession, templates).join(counts, "word", "left")
    idf = F.greatest(F.log((F.lit(n_files) + 1) / (F.coalesce("files", F.lit(0)) + 1)), F.lit(0.01))
    # these windows run over the words of one template
    own = Window.partitionBy("template")
    falling = own.orderBy(F.col("weight").desc(), "position").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("weight").over(falling), F.lit(0.0))
    marked = index.withColumn("weight", idf).withColumn("whole", F.sum("weight").over(own)).withColumn("rare", before <= (1 - share / 2) * F.col("whole") + 1e-9)
    need = share * F.col("whole") - F.sum(F.when(~F.col("rare"), F.col("weight")).otherwise(0.0)).over(own) - 1e-9
    return held(marked.select("word", "template", "position", "weight", "rare", "whole", need.alias("need")))


def aligned(files: DataFrame, weighted: DataFrame, share: float = ALIGNED) -> DataFrame:
    """(key, found array<struct<template, score>>) for files (key, hits), one row per key.

    The rare words of a file are looked up in the postings. An offset at which those of a template weigh enough nominates it; only for these
    offsets all words of the template are compared with the words in their places. A file of many licences is scored for each as if it stood alone.
    """
    placed = files.select("key", F.explode("hits").alias("h")).select("key", "h.at", "h.word")
    # broadcast: these have one row per word of the fixed templates
    rare = placed.join(F.broadcast(weighted.filter("rare")), "word")
    votes = rare.groupBy("key", "template", (F.col("at") - F.col("position")).alias("offset")).agg(F.sum("weight").alias("agreed"), F.first("need").alias("need"))
    nominated = written(votes.filter("agreed >= need").select("key", "template", "offset"))
    wanted = nominated.join(F.broadcast(weighted), "template").select("key", "template", "offset", "word", "weight", "whole", (F.col("offset") + F.col("position")).alias("at"))
    there = placed.join(nominated.select("key").distinct(), "key", "left_semi")
    agreed = wanted.join(there, ["key", "at", "word"]).groupBy("key", "template", "offset").agg(F.least(F.sum("weight") / F.first("whole"), F.lit(1.0)).alias("score"))
    scored = agreed.groupBy("key", "template").agg(F.max("score").alias("score")).filter(F.col("score") >= share)
    # as many entries as there are templates
    return scored.groupBy("key").agg(F.collect_list(F.struct("template", "score")).alias("found"))


def scan(df: DataFrame, text_column: str = "text", templates=TEMPLATES + WHOLE, keep: list[str] | None = None) -> DataFrame:
    """`df` (or its columns `keep`) with n_words, places array<struct<at, label>>, labels (sorted array<string>) and score.

    Texts are cut into words once; what is kept of each are the words that stand in templates, and, of the files
    with a word that every label needs, their places. Only these files go to the index; the others have no label.
    A template counts for a file if enough of its weight agrees in position and all its mandatory phrases stand in the file.
    Files with equal words in equal places are looked up once. score: 1 if a phrase stands in the file, else the highest
    share of a template that counts, else 0.

    A null text counts as empty: no words, no labels. Texts are scanned whole. An empty table gives an empty
    one. Input columns with the names of the new ones are replaced.
    """
    new = ("n_words", "places", "labels", "score")
    df = df.drop(*[c for c in df.columns if c in new and c != text_column])
    keep = [c for c in df.columns if c in keep] if keep else list(df.columns)
    cut = df.withColumn("__words", words_of(text_of(text_column))).withColumn("__hits", _hits(F.col("__words"), templates))
    known = F.array_distinct(F.col("__hits.word"))
    could = F.arrays_overlap("__known", F.array(*map(F.lit, _anchors(templates))))
    base = cut.select(*keep, F.size("__words").cast("long").alias("__n"), known.alias("__known"), "__hits").withColumn("__hits", F.when(could, F.col("__hits")))
    base = written(base.withColumn("__key", F.when(F.col("__hits").isNotNull(), F.sha2(F.to_json("__hits"), 256))))
    files = base.filter("__hits IS NOT NULL").groupBy(F.col("__key").alias("key")).agg(F.first("__hits").alias("hits"))
    found = aligned(files, weights(base.select(F.col("__known").alias("known")), base.count(), templates))
    # the others stay out of the join, where their empty keys would meet in one task
    joined = base.filter("__key IS NOT NULL").join(found.withColumnRenamed("key", "__of"), F.col("__key") == F.col("__of"), "left")
    sure = F.filter(
        F.coalesce("found", F.array().cast("array<struct<template:int,score:double>>")),
        lambda x: _any((x["template"] == n) & _all(F.size(_stands(F.col("__hits"), p)) > 0 for p in _phrases(t)) for n, t in enumerate(templates)),
    )
    labels = F.array(*[F.lit(t[0]) for t in templates])
    some = joined.withColumn("__places", _places(F.col("__hits"))).withColumn("__sure", sure)
    labelled = {
        "n_words": F.col("__n"),
        "places": F.col("__places"),
        "labels": F.array_sort(F.array_distinct(F.concat(F.col("__places.label"), F.transform("__sure", lambda x: F.get(labels, x["template"]))))),
        "score": F.when(F.size("__places") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.col("__sure.score")), F.lit(0.0))),
    }
    nothing = {"n_words": F.col("__n"), "places": F.array().cast("array<struct<at:bigint,label:string>>"), "labels": F.array().cast("array<string>"), "score": F.lit(0.0)}
    columns = [c for c in keep if c not in new]
    named = lambda rows, made: rows.select(*columns, *[x.alias(c) for c, x in made.items()])
    return named(some, labelled).unionByName(named(base.filter("__key IS NULL"), nothing))


def _any(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out
