"""Licence scans: TF-IDF cosine to templates, then inheritance from the nearest directory above."""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType, _parse_datatype_string

from .common import cut, slices

#: Least cosine of a passage that counts as a licence's.
LEAST = 0.75
#: A file is a licence file if named so, or if passages of licences make this share of its words.
MOSTLY = 0.5
#: Different words that a task counts before it sends them.
COUNTED = 200_000

# Notices by which licences are named or granted, under their SPDX names.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "SPDX-License-Identifier: MIT",
    ),
    "BSD-3-Clause": (
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "LGPL-3.0": ("Licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0-or-later"),
    "AGPL-3.0": ("Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-or-later"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0-1.0": ("Dedicated to the public domain under CC0 1.0 Universal.",),
    "Proprietary": ("All rights reserved.", "Copyright. All rights reserved. Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential."),
}

#: Whole licences, verbatim, under their SPDX names.
TEXTS = Path(__file__).parent / "license_texts"
#: Paragraphs of whole licences that are templates of their own have so many words.
PARAGRAPH = 12

#: Names of licence files.
NAMED = r"(?i)^(?:licen[cs]e|copying|unlicense|notice)(?:[-._].*)?$"

_words = re.compile(r"[^\W_]+(?:\.[0-9]+)*").findall


def words(text: str) -> list[str]:
    return _words(text.lower())


def paragraphs(lines: list[list[str]]) -> list[list[list[str]]]:
    """Lines with words, by the paragraphs that lines without any part."""
    out: list[list[list[str]]] = [[]]
    for line in lines:
        if line:
            out[-1].append(line)
        elif out[-1]:
            out.append([])
    return out if out[-1] else out[:-1]


@cache
def templates() -> list[tuple[str, list[str]]]:
    """Names and words of all templates: the notices, each whole licence, and its paragraphs and title."""
    out = [(name, words(t)) for name, notices in TEMPLATES.items() for t in notices]
    for path in sorted(TEXTS.glob("*.txt")):
        text = path.read_text(encoding="utf-8")
        out.append((path.stem, words(text)))
        for k, lines in enumerate(paragraphs([words(line) for line in text.split("\n")])):
            joined = [w for line in lines for w in line]
            if k == 0 or len(joined) >= PARAGRAPH:
                out.append((path.stem, joined))
    return out


@cache
def vocabulary() -> frozenset:
    """The words of all templates."""
    return frozenset(w for _, t in templates() for w in t)


class Index:
    """The templates' TF-IDF vectors, and what a passage needs to reach the least cosine at all."""

    def __init__(self, n: int, df: dict[str, int], least: float = LEAST):
        self.least = least
        known = vocabulary()
        self.idf = {w: idf(n, df.get(w, 0)) for w in known}
        self.names, vectors = [], []
        for name, t in templates():
            v = {w: k * self.idf[w] for w, k in Counter(t).items()}
            norm = math.sqrt(sum(x * x for x in v.values()))
            self.names.append(name)
            vectors.append({w: x / norm for w, x in v.items()})
        self.by_word: dict[str, list[tuple[int, float]]] = {}
        for k, v in enumerate(vectors):
            for w, x in v.items():
                self.by_word.setdefault(w, []).append((k, x))
        # The commonest words, as many as cannot reach the least cosine of any template by themselves (Cauchy-Schwarz).
        common, left = set(), [least * least - 1e-9] * len(vectors)
        for w in sorted(known, key=lambda w: (self.idf[w], w)):
            if all(left[k] > x * x for k, x in self.by_word[w]):
                common.add(w)
                for k, x in self.by_word[w]:
                    left[k] -= x * x
        self.telling = known - common

    def candidate(self, passage: list[str]):
        """(names, dot, squares, others) of a passage that could reach the least cosine, or None.

        names are those of the best templates and dot their product with the passage; its
        length has squares from words of templates, and from others, each at least its count.
        """
        inside, others, dots = 0.0, [], {}
        for w, k in Counter(passage).items():
            if w not in self.idf:
                others.append((w, k))
                continue
            x = k * self.idf[w]
            inside += x * x
            for t, y in self.by_word[w]:
                dots[t] = dots.get(t, 0.0) + x * y
        if not dots:
            return None
        dot = max(dots.values())
        if dot < self.least * math.sqrt(inside + sum(k * k for _, k in others)) - 1e-9:
            return None
        return sorted({self.names[t] for t, x in dots.items() if x > dot * (1 - 1e-9)}), dot, inside, others

    def candidates(self, text: str, whole: bool = False) -> tuple[int, list[tuple]]:
        """How many words a text has, and its passages that could be a licence's, as (paragraph, kind, size, *candidate).

        Passages are the lines (kind 0), the paragraphs of several lines (1) and, of a licence file, the whole (2).
        """
        split = [words(line) for line in text.split("\n")]
        total = sum(map(len, split))
        found: list[tuple] = []
        if self.telling.isdisjoint(w for line in split for w in line):
            return total, found

        def judge(at: int, kind: int, passage: list[str]) -> None:
            if not self.telling.isdisjoint(passage) and (c := self.candidate(passage)):
                found.append((at, kind, len(passage), *c))

        for at, lines in enumerate(paragraphs(split)):
            for line in lines:
                judge(at, 0, line)
            if len(lines) > 1:
                judge(at, 1, [w for line in lines for w in line])
        if whole:
            judge(-1, 2, [w for line in split for w in line])
        return total, found


def idf(n: int, df: int) -> float:
    return math.log((1 + n) / (1 + df)) + 1


def document_frequencies(files: DataFrame) -> DataFrame:
    """word and n, how many texts hold it, over all words and texts; the word '' stands for the texts themselves."""

    def run(batches):
        df: Counter = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(df), pa.string()), pa.array(list(df.values()), pa.int64())], names=["word", "n"])
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                df.update(set(words(text or "")))
                df[""] += 1
            if len(df) > COUNTED:
                yield out()
                df.clear()
        yield out()

    return files.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


CANDIDATE = "array<struct<at:int,kind:int,size:int,names:array<string>,dot:double,inside:double,others:array<struct<word:string,k:int>>>>"


def scan(files: DataFrame, frequencies: DataFrame) -> DataFrame:
    """The other columns of files with own_license, score, share and is_license, from each whole text.

    A passage counts if its cosine to a template, over all its words with the frequencies of
    all texts, reaches LEAST; its words go to the best template's licence, a paragraph's
    instead of its lines'. The licence with the most words is the text's, then the one of
    the best cosine, then the first name.
    """
    kept = files.drop("own_license", "score", "share", "is_license")
    names = [c for c in kept.columns if c != "text"]
    spark = files.sparkSession
    shared = spark.createDataFrame([(w,) for w in sorted(vocabulary())] + [("",)], "word string")
    df = {r.word: r.n for r in frequencies.join(F.broadcast(shared), "word").collect()}  # at most one row per word of the templates
    n = df.pop("", 0)
    index = spark.sparkContext.broadcast(Index(n, df))

    def run(batches):
        named = re.compile(NAMED)
        kind = pa.list_(pa.struct([("at", pa.int32()), ("kind", pa.int32()), ("size", pa.int32()), ("names", pa.list_(pa.string())), ("dot", pa.float64()), ("inside", pa.float64()), ("others", pa.list_(pa.struct([("word", pa.string()), ("k", pa.int32())])))]))
        keys = [f.name for f in kind.value_type]
        for batch in slices(batches):
            base = [bool(named.match((p or "").rpartition("/")[2])) for p in batch.column("path").to_pylist()]
            found = [index.value.candidates(t or "", b) for t, b in zip(batch.column("text").to_pylist(), base)]
            told = [[dict(zip(keys, (*c[:6], [{"word": w, "k": k} for w, k in c[6]]))) for c in cs] for _, cs in found]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array([f[0] for f in found], pa.int64()), pa.array(told, kind)], names=[*names, "__total", "__found"])

    schema = StructType([*(kept.schema[c] for c in names), StructField("__total", LongType()), StructField("__found", _parse_datatype_string(CANDIDATE))])
    rows = cut(kept.mapInArrow(run, schema)).withColumn("__row", F.monotonically_increasing_id())
    each = rows.select("__row", "__total", F.posexplode("__found").alias("pos", "c")).select("__row", "__total", "pos", "c.*")
    squares = F.pow(F.col("k") * (F.log((1.0 + n) / (1 + F.col("n"))) + 1), 2)
    others = each.select("__row", "pos", F.explode("others").alias("o")).select("__row", "pos", "o.word", "o.k")
    outside = others.join(frequencies, "word").groupBy("__row", "pos").agg(F.sum(squares).alias("outside"))
    cosine = F.round(F.col("dot") / F.sqrt(F.col("inside") + F.coalesce("outside", F.lit(0.0))), 9)
    hits = cut(each.drop("others").join(outside, ["__row", "pos"], "left").withColumn("score", cosine).where(F.col("score") >= LEAST).drop("dot", "inside", "outside"))
    # A paragraph's words instead of its lines', and the whole's instead of all.
    widest = hits.groupBy("__row", "at").agg(F.max("kind").alias("__kind"))
    counted = hits.join(widest, ["__row", "at"]).where("kind = __kind")
    best = hits.groupBy("__row").agg(F.max("kind").alias("__top"), F.max("score").alias("score"))
    sizes = counted.join(best.select("__row", "__top"), "__row").where("__top < 2 OR kind = 2")
    share = sizes.groupBy("__row").agg((F.sum("size") / F.first("__total")).alias("share"))
    votes = sizes.select("__row", "size", "score", F.explode("names").alias("name")).groupBy("__row", "name").agg(F.sum("size").alias("size"), F.max("score").alias("top"))
    own = votes.groupBy("__row").agg(F.min_by("name", F.struct(-F.col("size"), -F.col("top"), "name")).alias("own_license"))
    told = cut(own.join(share, "__row").join(best.select("__row", "score"), "__row").withColumnRenamed("__row", "__of"))
    base = F.element_at(F.split(F.coalesce("path", F.lit("")), "/"), -1)
    zero = F.lit(0.0)
    return (
        rows.join(told, F.col("__row") == F.col("__of"), "left")
        .select(*names, "own_license", F.coalesce("score", zero).alias("score"), F.coalesce("share", zero).alias("share"))
        .withColumn("is_license", F.col("own_license").isNotNull() & (base.rlike(NAMED) | (F.col("share") >= MOSTLY)))
    )


def license_scan(files: DataFrame) -> DataFrame:
    """The licence of every file: its own, or that of the licence file in the nearest directory at or above its own.

    files has path and text. A null path lies in the root directory; a null or empty text
    has no licence of its own. Of several licence files in a directory the one with the
    best cosine counts, then the first name. Repeated rows come back each; other columns
    but those named below are kept; without rows the result is empty.
    Returns the columns but text, with own_license, score, share, is_license, license and
    license_from: the directory it is inherited from, null for a file's own.
    """
    frequencies = cut(document_frequencies(files))
    drop = ("license", "license_from", "__dir", "__up", "__depth")
    scanned = scan(files.drop(*drop), frequencies).withColumn("__dir", F.regexp_replace(F.concat(F.lit("/"), F.coalesce("path", F.lit(""))), r"/[^/]*$", ""))
    rows = cut(scanned)
    rank = F.struct(-F.col("score"), F.col("own_license"))
    granting = cut(rows.where("is_license").groupBy("__dir").agg(F.min_by("own_license", rank).alias("license")))
    # Each directory once, however many files it has, asks for all directories above it.
    parts = F.split("__dir", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    asking = rows.select("__dir").distinct().select("__dir", F.posexplode(above).alias("__depth", "__up"))
    met = asking.join(granting.withColumnRenamed("__dir", "__up"), "__up")
    nearest = cut(met.groupBy("__dir").agg(F.max(F.struct("__depth", "license", "__up")).alias("__near")))
    own = F.col("own_license").isNotNull()
    return (
        rows.join(nearest, "__dir", "left")
        .withColumn("license", F.when(own, F.col("own_license")).otherwise(F.col("__near.license")))
        .withColumn("license_from", F.when(~own & F.col("__near").isNotNull(), F.concat(F.col("__near.__up"), F.lit("/"))))
        .drop("__dir", "__near")
    )
