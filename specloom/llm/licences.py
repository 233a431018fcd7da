"""Operator 7, licence scans: a trained paragraph classifier. DataFrame and SQL functions only on the scanning path.

Paragraphs stand between blank lines. Of one with an anchor, its lines and its lines joined (wrapped notices) are compared; long ones
by sentence and by windows of WINDOWS words, a quarter of that apart, so that each statement lies whole in one of its own size. Word n-grams (1 to 3) are hashed to DIM features; a multinomial logistic
regression over them, fitted on the statements below, variants of them and a bounded sample of other paragraphs of the corpus, gives
each family a probability. Its temperature and the threshold below which a paragraph is ``unknown`` are calibrated on variants and
paragraphs that it was not fitted on. A prediction is confirmed by comparison: the paragraph must hold most word pairs of one of the
family's statements. Every statement holds a word of ANCHORS, and a confirmed paragraph must too, so texts without any are done with.

Weights and statements are literals in the plan; a scan is one pass without a shuffle.

Defined results: null and empty texts and texts without an anchor have licence ``none`` and score 0; texts with candidates but
no confirmed one ``unknown``, with the best probability; of several families the most probable comes first, ties by name.
"""

from __future__ import annotations


import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

DIM = 1 << 12
LONG = 40  # words of a line beyond which its sentences and windows are compared
WINDOWS = (8, 16, 32, 48)  # words
NEGATIVES = 400  # other paragraphs that are collected to fit at most
FALSE_SHARE = 0.01  # of other paragraphs that may pass the threshold
HELD = 0.6  # of a statement's word pairs that a paragraph must hold
ANCHORS = r"(?i)licen[cs]|copyright|warrant|rights reserved|public domain|redistribut|permission|\b[al]?gpl(?:v?-?[0-9]|\b)|\bcc[ -]by\b"
ANCHOR_WORDS = r"(?i)licen[cs]|copyright|warrant|rights|public|redistribut|permission|gpl|^cc"  # a word of each of them
#: Short names of licences by family, as in SPDX tags and package files.
SHORT = {
    "apache-2.0": ["Apache-2.0"],
    "bsd": ["BSD-2-Clause", "BSD-3-Clause"],
    "cc-by": ["CC-BY-4.0", "CC-BY-3.0"],
    "cc-by-nc": ["CC-BY-NC-4.0"],
    "cc-by-sa": ["CC-BY-SA-4.0", "CC-BY-SA-3.0"],
    "gpl": ["GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "GPL-2.0", "GPL-3.0", "GPLv2", "GPLv3"],
    "lgpl": ["LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-or-later", "LGPL-2.1", "LGPL-3.0", "LGPLv3"],
    "mit": ["MIT"],
    "mpl": ["MPL-2.0"],
    "public-domain": ["CC0-1.0", "Unlicense"],
}

#: Usual statements of each licence family.
STATEMENTS: dict[str, list[str]] = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License",
        "This project is released under the Apache License 2.0",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
        "Released under the BSD License",
        "Licensed under the 3-Clause BSD License",
    ],
    "cc-by": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
        "Licensed under CC BY 4.0",
        "Content is available under the Creative Commons Attribution License",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
        "Available under the CC BY-NC license for non-commercial use",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
        "Text is available under the Creative Commons Attribution-ShareAlike License",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "Released under the GNU General Public License version 2 or later",
        "You should have received a copy of the GNU General Public License along with this program",
        "Distributed under the terms of the GNU General Public License version 3",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1",
        "You should have received a copy of the GNU Lesser General Public License along with this library",
        "Distributed under the terms of the GNU Lesser General Public License version 3",
    ],
    "mit": [
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "Licensed under the MIT License",
        "This software is distributed under the terms of the MIT license",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "Licensed under the Mozilla Public License 2.0",
    ],
    "proprietary": [
        "All rights reserved",
        "Copyright, all rights reserved, no part of this publication may be reproduced without prior written permission",
        "This document is confidential and proprietary, unauthorized copying is prohibited, all rights reserved",
    ],
    "public-domain": [
        "This work is dedicated to the public domain",
        "This is free and unencumbered software released into the public domain",
        "To the extent possible under law, the author has waived all copyright and related rights to this work, public domain",
    ],
}

for _family, _names in SHORT.items():
    STATEMENTS[_family] += [f"{before} {x}" for x in _names for before in ("SPDX-License-Identifier:", "license =", "Licensed under", "Released under the")]

#: Statements with an anchor that name no licence.
OTHERS = [
    "The driver lost a licence after the accident",
    "A fishing license costs ten dollars a year",
    "The warranty covers parts for two years",
    "She asked for permission to leave early",
    "The copyright debate went on for years",
    "Officers may redistribute the load between the pumps",
    "He was licensed to practise medicine in two states",
    "There is no warrant for such a claim",
]
NONE = "unknown"


def grams(words: Column, n: int) -> Column:
    """The n-grams of an array of words, each joined by a space."""
    last = F.size(words) - n
    return F.when(last < 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.array_join(F.slice(words, i + 1, F.lit(n)), " ")))


def words_of(paragraph: Column) -> Column:
    """Lower-cased runs of letters, digits, dots and hyphens inside them."""
    return F.regexp_extract_all(F.lower(paragraph), F.lit(r"([\p{L}\p{N}]+(?:[.\-][\p{L}\p{N}]+)*)"), F.lit(1))


def features(words: Column) -> Column:
    """Sorted distinct feature numbers."""
    every = F.concat(words, grams(words, 2), grams(words, 3))
    return F.array_sort(F.array_distinct(F.transform(every, lambda g: F.pmod(F.xxhash64(g), F.lit(DIM)).cast("int"))))


def variants() -> list[tuple[str, str]]:
    """(statement, family) with usual surroundings and losses."""
    out = []
    for family, statements in STATEMENTS.items():
        for s in statements:
            w = s.split()
            forms = [s, f"{s}.", s.upper(), f"Copyright 2019 The authors. {s}.", f"NOTE: {s} and its terms.", f"(c) 2021. {s}."]
            if len(w) > 6:
                forms += [" ".join(w[1:]), " ".join(w[:-1]), " ".join(w[: len(w) * 3 // 4])]
            out += [(x, family) for x in forms]
    return out


class Classifier:
    """weights (family, feature), bias, temperature and threshold."""

    def __init__(self, families: list[str], rows: list[tuple[list[int], str]], held: list[tuple[list[int], str]], steps: int = 300):
        self.families = families
        x = self.matrix([f for f, _ in rows])
        y = np.array([families.index(k) for _, k in rows])
        one = np.eye(len(families))[y]
        balance = 1 / np.maximum(1, one.sum(0))[y]
        balance = (balance / balance.mean())[:, None]
        self.weights, self.bias = np.zeros((len(families), DIM)), np.zeros(len(families))
        mw, vw, mb, vb = np.zeros_like(self.weights), np.zeros_like(self.weights), np.zeros_like(self.bias), np.zeros_like(self.bias)
        for t in range(1, steps + 1):  # full-batch Adam: the rows are a few hundred
            p = self.softmax(x @ self.weights.T + self.bias)
            g = (p - one) * balance / len(rows)
            gw, gb = g.T @ x + 1e-4 * self.weights, g.sum(0)
            mw, mb = 0.9 * mw + 0.1 * gw, 0.9 * mb + 0.1 * gb
            vw, vb = 0.999 * vw + 0.001 * gw**2, 0.999 * vb + 0.001 * gb**2
            a, b = 1 - 0.9**t, 1 - 0.999**t
            self.weights -= 0.05 * (mw / a) / (np.sqrt(vw / b) + 1e-8)
            self.bias -= 0.05 * (mb / a) / (np.sqrt(vb / b) + 1e-8)
        self.weights, self.bias = np.round(self.weights, 4), np.round(self.bias, 4)
        self.temperature, self.threshold = 1.0, 0.5
        if held:
            z = self.matrix([f for f, _ in held]) @ self.weights.T + self.bias
            y = np.array([families.index(k) for _, k in held])
            grid = np.geomspace(0.25, 4, 17)
            loss = [-np.log(self.softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean() for t in grid]
            self.temperature = float(grid[int(np.argmin(loss))])
            other = y == families.index(NONE)
            if other.any():
                p = np.delete(self.softmax(z[other] / self.temperature), families.index(NONE), axis=1).max(1)
                self.threshold = float(min(0.95, max(0.5, np.quantile(p, 1 - FALSE_SHARE))))

    @staticmethod
    def matrix(rows: list[list[int]]) -> np.ndarray:
        x = np.zeros((len(rows), DIM))
        for i, f in enumerate(rows):
            x[i, f] = 1
        return x

    @staticmethod
    def softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def paragraphs(text: Column) -> Column:
    """What is compared of the paragraphs with an anchor: lines and joined lines with one; of long ones sentences and windows with one."""
    anchored = lambda x: x.rlike(ANCHORS)

    def windows(x: Column) -> Column:
        def of(words: Column) -> Column:
            places = F.filter(F.transform(words, lambda w, i: F.when(w.rlike(ANCHOR_WORDS), i)), lambda i: i.isNotNull())

            def sized(n: int) -> Column:
                step = n // 4  # a place lies in four windows
                first = F.array_distinct(F.flatten(F.transform(places, lambda i: F.array(*[F.greatest(F.lit(0), ((i / step).cast("int") - k) * step) for k in range(4)]))))
                return F.transform(first, lambda i: F.array_join(F.slice(words, i + 1, F.lit(n)), " "))

            return F.concat(*[sized(n) for n in WINDOWS])

        return F.get(F.transform(F.array(F.split(x, r"\s+")), of), F.lit(0))

    def parts(x: Column) -> Column:
        return F.when(F.size(F.split(x, " ")) > LONG, F.filter(F.concat(F.split(x, r"(?<=[.!?])\s+"), windows(x)), anchored)).otherwise(F.array(x))

    found = F.filter(F.split(text, r"\n[\x20\t\r]*\n"), anchored)
    pieces = F.flatten(F.transform(found, lambda x: F.concat(F.filter(F.split(x, "\n"), anchored), F.when(x.contains("\n"), F.array(F.regexp_replace(x, r"[\x20\t\r]*\n[\x20\t\r#*/;%-]*", " "))).otherwise(F.array().cast("array<string>")))))
    return F.array_distinct(F.flatten(F.transform(pieces, parts)))


def train(spark: SparkSession, docs: DataFrame, negatives: int = NEGATIVES) -> Classifier:
    """A classifier of the statements above and bounded samples of other paragraphs of docs (text): without an anchor, and with one but
    little of any statement."""
    positive = variants()
    rows = spark.createDataFrame([(i, t, k) for i, (t, k) in enumerate([*positive, *[(x, NONE) for x in OTHERS]])], "i int, text string, family string")
    n = docs.count()
    # drawn row by row, so that copies of a text are not in or out together
    some = common.written(docs.select("text").sample(min(1.0, 4.0 * negatives / max(1, n)), 5), "sample")
    long = (F.length("text") > 20) & (F.length("text") < 2000)
    plain = some.select(F.explode(F.split("text", "\n")).alias("text")).filter(long & ~F.col("text").rlike(ANCHORS))
    # and what the scan meets: paragraphs with an anchor that hold little of any statement
    every = F.array(*[F.array(*[F.lit(g) for g in pairs(s)]) for family in STATEMENTS for s in STATEMENTS[family]])
    like = F.exists(every, lambda s: F.size(F.array_intersect(s, grams(words_of(F.col("text")), 2))) * 2 >= F.size(s) * HELD)
    odd = some.filter(F.col("text").rlike(ANCHORS))
    odd = odd.select(F.explode(paragraphs(F.col("text"))).alias("text")).filter(long).distinct().filter(~like)

    def few(x: DataFrame, number) -> DataFrame:
        x = x.distinct().orderBy(F.xxhash64("text"), "text").limit(negatives)
        return x.select((10_000 + number).cast("int").alias("i"), "text", F.lit(NONE).alias("family"))

    # these may be parts of licences that no statement has, so they calibrate (i % 4 = 3) and are not fitted
    hashed = F.pmod(F.xxhash64("text"), F.lit(10_000))
    lines = few(plain, hashed).union(few(odd, 4 * hashed + 3))
    found = rows.union(lines).select("i", "family", features(words_of(F.col("text"))).alias("f")).orderBy("i", "f").collect()
    held = [(r["f"], r["family"]) for r in found if r["i"] % 4 == 3]
    return Classifier([*STATEMENTS, NONE], [(r["f"], r["family"]) for r in found if r["i"] % 4 != 3], held)


def literal(values, kind: str) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def scan(docs: DataFrame, model: Classifier) -> DataFrame:
    """docs without text, with licence, licences (all confirmed families), score, n_paragraphs (candidates)."""
    families = model.families
    score = [literal(model.weights[k].tolist(), "double") for k in range(len(families))]
    statements = F.array(*[F.array(*[F.array(*[F.lit(g) for g in pairs(s)]) for s in STATEMENTS[k]]) for k in families if k != NONE])
    names = F.array(*[F.lit(k) for k in families])

    def let(value: Column, body) -> Column:
        return F.get(F.transform(F.array(value), body), F.lit(0))

    def weighed(f: Column, k: int) -> Column:
        return F.aggregate(f, F.lit(float(model.bias[k])), lambda s, i: s + F.get(score[k], i)) / model.temperature

    def judged(paragraph: Column) -> Column:
        def of(words: Column) -> Column:
            def by(f: Column) -> Column:
                z = F.array(*[weighed(f, k) for k in range(len(families))])

                def chosen(z: Column) -> Column:
                    top = F.array_max(z)
                    total = F.aggregate(z, F.lit(0.0), lambda s, x: s + F.exp(x - top))
                    k = (F.array_position(z, top) - 1).cast("int")
                    name, p = F.get(names, k), F.lit(1.0) / total
                    likes = F.exists(F.coalesce(F.get(statements, k), F.array().cast("array<array<string>>")), lambda s: F.size(F.array_intersect(s, grams(words, 2))) >= F.size(s) * HELD)
                    return F.struct(p.alias("p"), name.alias("family"), ((name != NONE) & (p >= model.threshold) & likes).alias("confirmed"))

                return let(z, chosen)

            return let(features(words), by)

        return let(words_of(paragraph), of)

    rest = [c for c in docs.columns if c not in ("text", "licence", "licences", "score", "n_paragraphs")]
    found = docs.select(*rest, F.when(F.col("text").rlike(ANCHORS), F.transform(paragraphs(F.col("text")), judged)).alias("found"))
    sure = F.filter("found", lambda x: x["confirmed"])
    best = F.array_sort(F.transform(sure, lambda x: F.struct((-x["p"]).alias("p"), x["family"].alias("family"))))
    none = F.col("found").isNull()
    return found.select(
        *rest,
        F.when(none, F.lit("none")).otherwise(F.coalesce(F.get(best, F.lit(0))["family"], F.lit(NONE))).alias("licence"),
        F.when(none, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(best, lambda x: x["family"]))).alias("licences"),
        F.when(none, F.lit(0.0)).otherwise(F.round(F.coalesce(-F.get(best, F.lit(0))["p"], F.array_max(F.transform("found", lambda x: x["p"])), F.lit(0.0)), 6)).alias("score"),
        F.coalesce(F.size("found"), F.lit(0)).cast("long").alias("n_paragraphs"),
    )


def pairs(statement: str) -> list[str]:
    """The word pairs of a statement, as words_of() and grams() make them."""
    import re

    w = re.findall(r"[^\W_]+(?:[.\-][^\W_]+)*", statement.lower())
    return sorted({" ".join(x) for x in zip(w, w[1:], strict=False)})


def op7_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence families that every text of documents names."""
    docs = common.only(common.table(spark, sf_dir, "documents"), "doc_id", "text")
    return scan(docs, train(spark, docs.select("text")))


