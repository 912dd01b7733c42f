"""License scans: a trained paragraph classifier over word n-grams, confirmed by comparison with templates.

A sparse logistic regression over the presence of one- and two-word n-grams names the licence family of a paragraph, or
none. It is trained here, on the templates below, on parts of them and on sentences that only sound alike; its unknown
class is calibrated on the part of these that it isn't trained on. A paragraph is a run of lines with letters or digits; a
notice is some lines in a row of one, however they are wrapped. Notices are scored by DataFrame functions: the weights are
a table of a few thousand rows, joined to the n-grams of each distinct notice.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.shared import kept

#: Notices by which texts state their licence, by family. Fixed values.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.", "Licensed under the MIT license.", "SPDX-License-Identifier: MIT",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0", "Released under the Apache License 2.0.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-or-later", "SPDX-License-Identifier: GPL-3.0-only",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
        "Released under the GPL v3 license.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-or-later", "SPDX-License-Identifier: GPL-2.0-only",
        "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License",
        "Released under the GPL v2 license.",
    ],
    "LGPL": [
        "This library is licensed under the GNU Lesser General Public License.", "Released under the GNU Lesser General Public License.", "SPDX-License-Identifier: LGPL-2.1-or-later", "SPDX-License-Identifier: LGPL-3.0-only",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
    ],
    "AGPL": [
        "This work is licensed under the GNU Affero General Public License, version 3.", "Released under the GNU Affero General Public License.", "SPDX-License-Identifier: AGPL-3.0-only",
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License",
    ],
    "BSD": [
        "Licensed under the BSD 3-Clause License.", "Released under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-3-Clause", "SPDX-License-Identifier: BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0",
        "Licensed under the Mozilla Public License, version 2.0.",
    ],
    "ISC": [
        "Licensed under the ISC License.", "SPDX-License-Identifier: ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.", "SPDX-License-Identifier: CC-BY-4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.", "SPDX-License-Identifier: CC-BY-SA-4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: CC-BY-NC-4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC-BY-ND": [
        "Licensed under CC BY-ND 4.0.", "SPDX-License-Identifier: CC-BY-ND-4.0",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    ],
    "CC0": [
        "Licensed under CC0 1.0 Universal.", "SPDX-License-Identifier: CC0-1.0", "Released under the CC0 1.0 Universal Public Domain Dedication.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense", "Released into the public domain under the Unlicense.",
    ],
    "Proprietary": [
        "All rights reserved.", "Copyright by the authors. All rights reserved.", "Proprietary and confidential license.",
        "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential.",
    ],
}
#: Sentences that share words with notices and state no licence. Fixed values.
LOOKALIKES = [
    "He lost his driving license on the way to work.", "The license plate was unreadable.", "A fishing licence is sold at the town hall.",
    "She asked for permission to use the software at work.", "The general public was invited to the free concert.", "The version of the work is free.",
    "Version 3 was released under pressure.", "The apache helicopter landed.", "Rights of the public were reserved for debate.",
    "The foundation published a free program for the library.", "This work is free.", "You may obtain a copy at the desk.", "The terms of the contract were modified.",
    "All seats are reserved.", "The creative commons room is open to the public.", "Redistribution of wealth was the subject.", "The public domain is a square in town.",
    "Copyright law is taught in the second year.", "No license is needed to read this.", "The permission slip is confidential.", "This file is free of errors.",
    "Software of the library can be found in the source.", "Use of the file is governed by the office.",
]
#: Words that most notices have. What is looked at doesn't depend on them, but on ``signs``.
ANCHORS = r"licen[cs]|copyright|rights reserved|permission|redistribut|public domain|proprietary|creative commons|\bcc0?\b|\bgnu\b"
WORD = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
#: What begins a line of a comment and is no part of the notice.
LEADER = r"^\s*(?:(?:[/*#;%!>|\-]+|(?i:rem|dnl)\b)\s*)*"
UNKNOWN = "unknown"


def words_of(text: str) -> list[str]:
    return re.findall(WORD, text.lower(), re.ASCII)


def ngrams_of(words: list[str]) -> set[str]:
    return {*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))}


@dataclass
class Model:
    """weights: n-gram x family, the first of which is unknown; a family needs ``threshold`` to be named."""

    families: list[str]
    vocabulary: list[str]
    weights: np.ndarray
    base: np.ndarray
    threshold: float


def _examples(rng: np.random.Generator) -> list[tuple[str, list[str]]]:
    """(family, words): templates, templates with words lost or cut, lookalikes and stray words of templates."""
    out = [(UNKNOWN, words_of(s)) for s in LOOKALIKES]
    loose = [words_of(t) for templates in TEMPLATES.values() for t in templates]
    for family, templates in TEMPLATES.items():
        for words in map(words_of, templates):
            out += [(family, words)] * 3
            for _ in range(8):
                kept_words = [w for w in words if rng.random() > 0.12] or words
                out.append((family, kept_words))
    for sentence in (words_of(s) for s in LOOKALIKES):
        for _ in range(3):
            out.append((UNKNOWN, [w for w in sentence if rng.random() > 0.2]))
    for _ in range(400):
        pool = [w for k in rng.choice(len(loose), 3) for w in loose[k]]
        out.append((UNKNOWN, list(rng.choice(pool, min(len(pool), int(rng.integers(1, 9)))))))
    return out


@lru_cache(maxsize=1)
def trained(seed: int = 3, rounds: int = 500, penalty: float = 2e-4) -> Model:
    """Fit the regression; three of four examples train it, the fourth calibrates when a family is named."""
    rng = np.random.default_rng(seed)
    examples = _examples(rng)
    families = [UNKNOWN, *TEMPLATES]
    vocabulary = sorted(set().union(*(ngrams_of(words_of(t)) for ts in TEMPLATES.values() for t in ts)))
    place = {g: k for k, g in enumerate(vocabulary)}
    x = np.zeros((len(examples), len(vocabulary)), np.float64)
    for row, (_, words) in enumerate(examples):
        x[row, [place[g] for g in ngrams_of(words) if g in place]] = 1
    y = np.eye(len(families))[[families.index(f) for f, _ in examples]]
    held = np.arange(len(examples)) % 4 == 3
    weights, base = np.zeros((len(vocabulary), len(families))), np.zeros(len(families))

    def probabilities(rows):
        z = rows @ weights + base
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    speed_w, speed_b = np.zeros_like(weights), np.zeros_like(base)
    for _ in range(rounds):
        slope = (probabilities(x[~held]) - y[~held]) / (~held).sum()
        speed_w = 0.9 * speed_w - 0.5 * (x[~held].T @ slope + penalty * weights)
        speed_b = 0.9 * speed_b - 0.5 * slope.sum(axis=0)
        weights, base = weights + speed_w, base + speed_b
    p = probabilities(x[held])[:, 1:].max(axis=1)
    unknown = y[held][:, 0] == 1
    threshold = float(np.clip((np.quantile(p[unknown], 0.99) + np.quantile(p[~unknown], 0.05)) / 2, 0.3, 0.9))
    return Model(families, vocabulary, weights, base, threshold)


def _weights(spark: SparkSession, model: Model) -> DataFrame:
    """Weights by n-gram; their number is that of the model."""
    return spark.createDataFrame([(g, [float(v) for v in w]) for g, w in zip(model.vocabulary, model.weights)], "gram string, w array<double>")


@lru_cache(maxsize=1)
def template_grams() -> list[tuple[str, list[str]]]:
    """(family, its distinct two-word n-grams) of every template."""
    out = []
    for family, templates in TEMPLATES.items():
        for words in map(words_of, templates):
            out.append((family, sorted({f"{a} {b}" for a, b in zip(words, words[1:])} or set(words))))
    return out


def signs(similarity: float) -> list[str]:
    """Words of which a text has one if it has ``similarity`` of the n-grams of a template: the n-grams without them are fewer."""
    found: set[str] = set()
    for _, grams in template_grams():
        words = sorted({w for g in grams for w in g.split()}, key=lambda w: (w not in found, -len(w), w))
        for word in words:
            left = sum(not found & set(g.split()) for g in grams)
            if left == 0 or left / len(grams) < similarity:
                break
            found.add(word)
    return sorted(found)


def _signed(text, similarity: float):
    return F.lower(text).rlike("(?<![a-z0-9])(?:" + "|".join(map(re.escape, signs(similarity))) + ")")


def _words(line):
    return F.regexp_extract_all(F.lower(F.regexp_replace(line, LEADER, "")), F.lit(WORD), F.lit(0))


def _pairs(words):
    """Two-word n-grams; of a single word the word."""
    pairs = F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat_ws(" ", a, b))
    return F.when(F.size(words) > 1, pairs).otherwise(words)


def _templates():
    return F.array(*[F.struct(F.lit(f).alias("family"), F.array(*map(F.lit, g)).alias("grams")) for f, g in template_grams()])


def _all_grams():
    return F.array(*map(F.lit, sorted({g for _, grams in template_grams() for g in grams})))


def _hits(pairs):
    """The n-grams of templates among ``pairs``."""
    return F.array_intersect(pairs, _all_grams())


def _parts(hits):
    """The part of the n-grams of each template that ``hits`` has."""
    return F.transform(_templates(), lambda t: F.size(F.array_intersect(hits, t["grams"])) / F.size(t["grams"]))


def _once(df: DataFrame, **columns) -> DataFrame:
    """``df`` with columns that are computed once a row, also where lambdas use them: a generator keeps projections apart."""
    for name, column in columns.items():
        df = df.select("*", F.explode(F.array(column)).alias(name))
    return df


def paragraphs(docs: DataFrame, similarity: float = 0.6) -> DataFrame:
    """(doc_id, paragraph, lines): the runs of lines with a letter or digit that have ``similarity`` of the n-grams of a template.

    ``paragraph`` is the number of the first line, from 0. A line ends at a line feed.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(_signed("text", similarity))
    rows = _once(rows, all=F.split("text", "\n")).select("doc_id", "all")
    rows = _once(rows, inked=F.transform("all", lambda line: line.rlike(r"[\p{L}\p{N}]")))
    edge = lambda other: F.filter(F.transform("inked", lambda x, i: F.when(x & ~F.coalesce(F.get("inked", i + other), F.lit(False)), i)), lambda i: i.isNotNull())
    rows = rows.select("doc_id", "all", F.explode(F.arrays_zip(edge(-1).alias("first"), edge(1).alias("last"))).alias("run"))
    rows = rows.select("doc_id", F.col("run.first").alias("paragraph"), F.slice("all", F.col("run.first") + 1, F.col("run.last") - F.col("run.first") + 1).alias("lines"))
    rows = rows.where(_signed(F.array_join("lines", " "), similarity))
    rows = _once(rows, words=F.flatten(F.transform("lines", _words)))
    rows = _once(rows, pairs=_pairs(F.col("words")))
    rows = _once(rows.select("doc_id", "paragraph", "lines", "pairs"), hits=_hits(F.col("pairs"))).where(F.size("hits") > 0)
    return rows.where(F.exists(_parts(F.col("hits")), lambda p: p >= similarity)).select("doc_id", "paragraph", "lines")


def notices(runs: DataFrame, similarity: float) -> DataFrame:
    """(lines, at, size, line, families, parts): lines in a row of distinct ``lines`` that can be a notice.

    They have ``similarity`` of the n-grams of a template of each of ``families``, and fewer without the first or the last
    line. A template has at most as many lines as words, so longer ones needn't be looked at. ``parts`` by template.
    """
    longest = max(len(words_of(t)) for ts in TEMPLATES.values() for t in ts)
    rows = _once(runs, split=F.transform("lines", _words))
    # a first line has, with the word after it, an n-gram of a template; a last line with the word before it
    after = lambda k: F.slice(F.flatten(F.slice("split", k + 2, longest)), 1, 1)
    opens = F.transform("split", lambda words, k: F.when(F.arrays_overlap(_pairs(F.concat(words, after(k))), _all_grams()), k))
    rows = rows.select("lines", "split", F.explode(F.filter(opens, lambda k: k.isNotNull())).alias("at"))
    rows = rows.select("lines", "at", F.slice("lines", F.col("at") + 1, longest).alias("near"), F.slice("split", F.col("at") + 1, longest).alias("split"))
    rows = _once(rows.where(_signed(F.array_join("near", " "), similarity)), reach=_hits(_pairs(F.flatten("split"))))
    rows = rows.where(F.array_max(_parts(F.col("reach"))) >= similarity).drop("reach")
    rows = rows.select("lines", "at", "near", "split", F.explode(F.sequence(F.lit(1), F.size("near"))).alias("size"))
    before = F.slice(F.flatten(F.slice("split", F.lit(1), F.col("size") - 1)), F.lit(-1), F.lit(1))
    before = F.when(F.size(F.flatten(F.slice("split", F.lit(1), F.col("size") - 1))) > 0, before).otherwise(F.array().cast("array<string>"))
    rows = rows.where(F.arrays_overlap(_pairs(F.concat(before, F.element_at("split", F.col("size")))), _all_grams()))
    rows = _once(rows, hits=_hits(_pairs(F.flatten(F.slice("split", F.lit(1), F.col("size"))))))
    rows = _once(rows, parts=_parts(F.col("hits"))).where(F.array_max("parts") >= similarity)
    rows = _once(rows, fewer=_hits(_pairs(F.flatten(F.slice("split", F.lit(2), F.col("size") - 1)))), shorter=_hits(_pairs(F.flatten(F.slice("split", F.lit(1), F.col("size") - 1)))))
    rows = _once(rows, later=_parts(F.col("fewer")), sooner=_parts(F.col("shorter")))
    whole = F.transform(_templates(), lambda t, k: F.when((F.get("parts", k) >= similarity) & (F.get("parts", k) > F.get("later", k)) & (F.get("parts", k) > F.get("sooner", k)), t["family"]))
    rows = rows.withColumn("families", F.array_distinct(F.filter(whole, lambda f: f.isNotNull()))).where(F.size("families") > 0)
    chosen = F.slice("near", F.lit(1), F.col("size"))
    line = F.when(F.col("size") == 1, F.get("near", F.lit(0))).otherwise(F.array_join(F.transform(chosen, lambda x: F.trim(F.regexp_replace(x, LEADER, ""))), " "))
    return rows.select("lines", "at", "size", line.alias("line"), "families", "parts")


def classified(lines: DataFrame, model: Model) -> DataFrame:
    """(line, family, probability) of distinct lines whose family is known."""
    weights = _weights(lines.sparkSession, model)
    words = F.regexp_extract_all(F.lower("line"), F.lit(WORD), F.lit(0))
    rows = lines.select("line", words.alias("words"))
    pairs = F.when(F.size("words") > 1, F.zip_with(F.slice("words", 1, F.size("words") - 1), F.slice("words", 2, F.size("words") - 1), lambda a, b: F.concat_ws(" ", a, b)))
    grams = F.array_distinct(F.concat("words", F.coalesce(pairs, F.array().cast("array<string>"))))
    rows = rows.select("line", F.explode(grams).alias("gram"))
    count = len(model.families)
    # the weights are bounded by the templates
    sums = rows.join(F.broadcast(weights), "gram").groupBy("line").agg(*[F.sum(F.col("w")[k]).alias(f"z{k}") for k in range(count)])
    z = sums.select("line", F.array(*[F.col(f"z{k}") + F.lit(float(model.base[k])) for k in range(count)]).alias("z"))
    powers = z.select("line", F.transform("z", lambda v: F.exp(v - F.array_max("z"))).alias("e"))
    total = F.aggregate("e", F.lit(0.0), lambda a, v: a + v)
    each = powers.select("line", F.transform("e", lambda v: v / total).alias("p"))
    families = F.array(*map(F.lit, model.families[1:]))
    best = F.array_max(F.zip_with(F.slice("p", 2, count - 1), families, lambda p, f: F.struct(p.alias("probability"), f.alias("family"))))
    named = each.select("line", best.alias("best"), F.col("p")[0].alias("unknown"))
    named = named.where((F.col("best.probability") >= model.threshold) & (F.col("best.probability") > F.col("unknown")))
    return named.select("line", "best.family", "best.probability")


def licenses(docs: DataFrame, similarity: float = 0.6) -> DataFrame:
    """doc_id, paragraph, family, probability, similarity, line: every notice in ``docs`` that states a known licence.

    A notice is one line or some lines in a row, without a line that has no letter or digit between them, and without
    the signs of a comment before each; ``paragraph`` is the number of its first line, from 0, and ``line`` the line, or
    its lines joined by a space. A prediction is confirmed when the notice has at least ``similarity`` (above 0) of the
    two-word n-grams of a template of that family; ``similarity`` in the result is the largest such part. Of notices of one
    family that share lines the one with the largest part stays, then the shortest, then the first; one that lies in a
    longer one with a larger part is a piece of that.

    Null and empty texts state none; an empty table gives no rows. A null doc_id stays null, repeated rows are rows of
    their own. Of families with equal probability the last by name is taken. Other columns are ignored. Each distinct
    paragraph is cut and each distinct notice scored once, so what many documents share is one row of the model's join.
    """
    model = trained()
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = kept(paragraphs(docs, similarity), "license-paragraphs", 4)
    found = kept(notices(runs.select("lines").repartition(tasks, "lines").distinct(), similarity), "license-notices")
    rows = found.join(classified(found.select("line").distinct(), model), "line").where(F.array_contains("families", F.col("family")))
    part = F.array_max(F.transform(_templates(), lambda t, k: F.when(t["family"] == F.col("family"), F.get("parts", k))))
    rows = rows.select("lines", F.struct((-part).alias("less"), "size", "at", "family", "probability", "line").alias("notice"))
    rows = _once(rows.groupBy("lines").agg(F.sort_array(F.collect_list("notice")).alias("all")).select("lines", "all"), none=F.filter("all", lambda x: F.lit(False)))
    shared = lambda a, b: (a["at"] < b["at"] + b["size"]) & (b["at"] < a["at"] + a["size"])
    inside = lambda a, b: (a["at"] >= b["at"]) & (a["at"] + a["size"] <= b["at"] + b["size"]) & (a["size"] < b["size"]) & (a["less"] > b["less"])
    beaten = lambda a, b: (a["family"] == b["family"]) & shared(a, b) | inside(a, b)
    best = F.aggregate("all", F.col("none"), lambda out, x: F.when(F.exists(out, lambda y: beaten(x, y)), out).otherwise(F.concat(out, F.array(x))))
    rows = kept(rows.select("lines", F.explode(best).alias("notice")), "license-matches", 8)
    place = (F.col("paragraph") + F.col("notice.at")).cast("long")
    return runs.join(rows, "lines").select("doc_id", place.alias("paragraph"), "notice.family", F.round("notice.probability", 6).alias("probability"), F.round(-F.col("notice.less"), 6).alias("similarity"), "notice.line")
