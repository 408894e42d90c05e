"""License scans: a trained paragraph classifier over sparse word n-grams, confirmed against templates.

Paragraphs end at blank lines (or such with comment marks alone) and at a line that ends a sentence; other lines are taken as
wrapped and are joined with the next, so that no n-gram is lost at the break. The classifier is multinomial logistic regression over word pairs and triples, trained
here on licence notices (templates, also with words of prose around them and with words lost, and the names of each licence in
common forms of notices) against prose about the same words and in the same forms. The n-grams are those of the notices and the
prose themselves, not of the words around them. Every paragraph is read: its n-grams are joined with the weights, after a
pattern has taken the runs of words that occur in weighted n-grams, which loses none of them. One without a weighted n-gram is
"unknown", the class of the intercepts.
Probabilities are calibrated by a temperature, and the unknown class by the least probability that a prediction needs (a wrong name
costs as much as two right ones bring), both fitted on notices in forms that the training set doesn't have. A prediction counts as confirmed if one template of its family has most of its
word pairs in the paragraph.

The weights and templates are a few thousand rows, whatever the corpus, and are broadcast. All work on the corpus is done in
DataFrame functions.

Defined cases: a null or empty text has one empty paragraph, which is unknown. Ties between families go to the first by name.
Repeated rows are scanned each; a null doc_id is carried along.
"""

from __future__ import annotations

import math
import random
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import KEY, keyed

UNKNOWN = "unknown"
WORD = r"[a-z0-9]+(?:\.[0-9]+)*"
#: Where a paragraph ends. The class in the first part holds blanks and comment marks.
BREAK = r"\n(?:[\s#*/;|>-]*\n|(?<=[.!?][\"')\]]{0,3}[ \t\r]{0,8}\n))"
#: Not used as filler in the training examples.
LICENCE_WORDS = r"licen|copyright|copyleft|warrant|redistribut|permission|public domain|creative commons"

# Short notices by which common licences are named.
TEMPLATES = {
    "agpl": (
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "Released under the AGPL-3.0 License.",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "This project is released under the Apache License 2.0.",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted.",
        "Released under the BSD License.",
        "Licensed under the 3-Clause BSD License.",
    ),
    "boost": (
        "Distributed under the Boost Software License, Version 1.0.",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "cc0": (
        "Released under CC0 1.0 Universal.",
        "The person who associated a work with this deed has dedicated the work to the public domain.",
    ),
    "epl": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and modify it under the terms of the GNU General Public License.",
        "Released under the GNU General Public License version 2.",
    ),
    "isc": (
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    ),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "Released under the LGPL version 3.",
    ),
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Released under the Unlicense.",
    ),
    "zlib": (
        "Released under the zlib License.",
    ),
}
# Names by which notices call the licences, identifiers first.
NAMES = {
    "agpl": ("AGPL-3.0", "AGPLv3", "GNU AGPL", "GNU Affero General Public License"),
    "apache": ("Apache-2.0", "Apache 2", "Apache License 2.0", "Apache License, Version 2.0", "Apache Software License"),
    "bsd": ("BSD-3-Clause", "BSD-2-Clause", "3-Clause BSD License", "BSD License", "New BSD License"),
    "boost": ("BSL-1.0", "Boost Software License", "Boost Software License 1.0"),
    "cc-by": ("CC-BY-4.0", "CC BY 3.0", "Creative Commons Attribution 4.0", "Creative Commons Attribution 4.0 International License"),
    "cc-by-nc": ("CC-BY-NC-4.0", "CC BY-NC 3.0", "CC BY-NC", "Creative Commons Attribution-NonCommercial 4.0"),
    "cc-by-sa": ("CC-BY-SA-4.0", "CC BY-SA 3.0", "CC BY-SA", "Creative Commons Attribution-ShareAlike 4.0"),
    "cc0": ("CC0-1.0", "CC0 1.0 Universal", "Creative Commons Zero"),
    "epl": ("EPL-2.0", "EPL-1.0", "Eclipse Public License", "Eclipse Public License 2.0"),
    "gpl": ("GPL-3.0", "GPL-2.0", "GPLv3", "GPLv2", "GNU GPL", "GNU General Public License", "GNU General Public License version 2"),
    "isc": ("ISC License", "ISC licence"),
    "lgpl": ("LGPL-3.0", "LGPL-2.1", "LGPLv3", "GNU LGPL", "GNU Lesser General Public License"),
    "mit": ("MIT", "MIT License", "Expat License"),
    "mpl": ("MPL-2.0", "MPL 2.0", "Mozilla Public License", "Mozilla Public License 2.0"),
    "unlicense": ("Unlicense", "the Unlicense"),
    "zlib": ("Zlib License", "zlib/libpng License"),
}
#: Forms of notices around a name: to train on, to calibrate on, and to test on. No form is in two of them.
FORMS = (
    "{}",
    "Released under {}.",
    "Licensed under the {}.",
    "Distributed under {} or any later version.",
    "The code is available under the {} license.",
    "This project is provided under the terms of the {}.",
    "This software is covered by the {}.",
    "SPDX-License-Identifier: {}",
    "License: {}",
    "{}, see LICENSE.",
    "{} (see the file for details)",
    "Free software under the {}, see COPYING.",
    "{} or later",
)
CALIBRATION_FORMS = (
    "This package is distributed under the {}.",
    "Made available under {} license, all other rights reserved.",
    "Licence of this work: {}.",
    "You may use it under {} or later versions.",
)
TEST_FORMS = (
    "Published under the terms of the {}, without exception.",
    "This is free software under the terms of the {}.",
    "The module is under {}, see file.",
    "Source released under the {} license by its authors.",
)
#: What else is said in such forms.
OTHER_NAMES = ("great pressure", "old treaty", "new name", "direction of the council", "lease", "guidance of a teacher", "cover of night", "contract with the city", "bridge", "care of the nurse")
PROSE = (
    "The minister said the licence fee would rise again next year and viewers were not asked.",
    "He lost his driving licence after the accident and had to walk to work.",
    "Copyright law was debated in the old parliament for many years.",
    "She asked for permission to leave the room before the end of the lesson.",
    "The search warrant was signed by a judge in the early morning.",
    "The house came into the public domain of the town when the family died out.",
    "Licensed plumbers are hard to find in this part of the country.",
    "All rights of the fishermen are licensed under an older treaty.",
    "The work is released under great pressure from the valve.",
    "There is no warranty on the used car, the seller told them.",
    "The public library was opened by the general in version two of the story.",
    "He asked them to come at seven or later, see the notes for details.",
    "They play for the general public in the open air.",
    "The general public of the town heard of it much too late.",
    "It must be done now or later in the year.",
    "Sooner or later the water will reach the general store.",
    "An Apache rode by, and 2 of them waited.",
    "The creative commons of the village was used by all, without fee.",
    "The terms of the lease were made available to the tenants.",
    "She will use, copy and modify the pattern for any purpose.",
)


def grams(words: list[str]) -> set[str]:
    """Pairs and triples."""
    return {" ".join(words[i : i + n]) for n in (2, 3) for i in range(len(words) - n + 1)}


def words_in(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def _notices(forms: tuple[str, ...]) -> list[tuple[list[str], str]]:
    named = [(name, family) for family, own in sorted(NAMES.items()) for name in own] + [(name, UNKNOWN) for name in OTHER_NAMES]
    return [(words_in(form.format(name)), family) for form in forms for name, family in named]


def _plain() -> list[tuple[list[str], str]]:
    """The templates and the prose."""
    return [(words_in(p), UNKNOWN) for p in PROSE] + [(words_in(t), family) for family, own in sorted(TEMPLATES.items()) for t in own]


def _examples(seed: int, forms: tuple[str, ...] = FORMS) -> list[tuple[list[str], str]]:
    rng = random.Random(seed)
    filler = sorted({w for p in PROSE for w in words_in(p) if not re.search(LICENCE_WORDS, w)})
    out = [(words_in(p), UNKNOWN) for p in PROSE]
    for words, family in _plain():
        for _ in range(12):
            own = [w for w in words if rng.random() > 0.05] if family != UNKNOWN and rng.random() < 0.4 else words
            out.append((rng.choices(filler, k=rng.randrange(8)) + own + rng.choices(filler, k=rng.randrange(8)), family))
    for words, family in _notices(forms):
        out.append((words, family))
        out.append((rng.choices(filler, k=rng.randrange(8)) + words + rng.choices(filler, k=rng.randrange(8)), family))
    return out


class Classifier:
    """names of the classes, weights by n-gram, intercepts, temperature and the least probability of a known family.

    The n-grams are those of the templates, the prose and the notices of FORMS. Their weights are fitted with a rate for each
    weight, by its past gradients; the intercepts are fixed.
    """

    def __init__(self, rounds: int = 300, rate: float = 0.5, l2: float = 1e-3):
        self.names = [*sorted(TEMPLATES), UNKNOWN]
        self.vocabulary = {g: k for k, g in enumerate(sorted({g for words, _ in _plain() + _notices(FORMS) for g in grams(words)}))}
        train, held = _examples(1), _examples(2, CALIBRATION_FORMS)
        at, bounds, y = self._sparse(train)
        b = np.zeros(len(self.names))
        b[-1] = 2.0  # a paragraph without features leans to unknown
        w = np.zeros((len(self.vocabulary), len(self.names)))
        target, past = np.eye(len(self.names))[y], np.zeros_like(w)
        # the examples of each n-gram, which all have
        of = np.repeat(np.arange(len(y)), np.diff(bounds))
        order = np.argsort(at, kind="stable")
        some, first = np.unique(at[order], return_index=True)
        for _ in range(rounds):
            off = self._softmax(self._logits(w, at, bounds) + b) - target
            g = l2 * w
            g[some] += np.add.reduceat(off[of[order]], first)
            past += g * g
            w -= rate * g / np.sqrt(past + 1e-9)
        self.weights, self.bias = np.round(w, 6), b
        at, bounds, truth = self._sparse(held)
        logits = self._logits(self.weights, at, bounds) + b
        self.temperature = min((0.5, 0.7, 1.0, 1.4, 2.0, 3.0), key=lambda t: -np.log(self._softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean())
        p = self._softmax(logits / self.temperature)
        best, sure, none = p.argmax(axis=1), p.max(axis=1), len(self.names) - 1

        def gain(least: float) -> int:
            """A family that is named rightly counts one, a wrong name costs two."""
            named = (best != none) & (sure > least)
            return int((named & (best == truth)).sum() - 2 * (named & (best != truth)).sum())

        self.least = max((0.5, 0.55, 0.6, 0.7, 0.8, 0.9), key=gain)

    def _sparse(self, examples) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the n-grams, bounds of each example among them, and classes."""
        rows = [sorted(self.vocabulary[g] for g in grams(words) if g in self.vocabulary) for words, _ in examples]
        bounds = np.cumsum([0, *map(len, rows)])
        return np.array([k for r in rows for k in r], np.int64), bounds, np.array([self.names.index(c) for _, c in examples])

    @staticmethod
    def _logits(weights: np.ndarray, at: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        sums = np.concatenate([np.zeros((1, weights.shape[1])), np.cumsum(weights[at], axis=0)])
        return sums[bounds[1:]] - sums[bounds[:-1]]

    def _matrix(self, examples) -> np.ndarray:
        x = np.zeros((len(examples), len(self.vocabulary)))
        for k, (words, _) in enumerate(examples):
            x[k, [self.vocabulary[g] for g in grams(words) if g in self.vocabulary]] = 1
        return x

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


_trained: list[Classifier] = []


def classifier() -> Classifier:
    if not _trained:
        _trained.append(Classifier())
    return _trained[0]


def paragraphs_of(text: Column) -> Column:
    return F.split(text, BREAK)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def grams_of(words: Column, n: int) -> Column:
    many = F.size(words) - (n - 1)
    return F.when(many > 0, F.transform(F.sequence(F.lit(1), many), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def runs_of(vocabulary) -> str:
    """A pattern of the runs of two and more words of weighted n-grams, in words joined by a blank. All such n-grams lie in a run."""
    tails: dict[str, list[str]] = {}
    for word in sorted({w for gram in vocabulary for w in gram.split(" ")}):
        tails.setdefault(word[0], []).append(re.escape(word[1:]))
    word = "(?:" + "|".join(f"{re.escape(c)}(?:{'|'.join(t)})" for c, t in tails.items()) + ")(?![^ ])"
    return f"(?<![^ ]){word}(?: {word})++"


def license_paragraphs(rows: DataFrame) -> DataFrame:
    """KEY, paragraph, family, probability and confirmed of the paragraphs of keyed rows that name a licence."""
    spark, model = rows.sparkSession, classifier()
    # fewer rows than the templates have n-grams: bounded by this file
    weights = spark.createDataFrame([(g, [float(v) for v in model.weights[k]]) for g, k in model.vocabulary.items()], "gram string, w array<double>")
    pairs = [(f, sorted({" ".join(w[i : i + 2]) for i in range(len(w) - 1)})) for w, f in _plain() if f != UNKNOWN]
    templates = spark.createDataFrame(pairs, "family string, template array<string>")

    # outer, since the others are given filters for which all is computed twice; a null n-gram meets no weight
    lines = rows.select(*KEY, F.posexplode_outer(paragraphs_of(F.col("text"))).alias("paragraph", "line")).withColumn("line", F.array_join(words_of(F.col("line")), " "))
    lines = lines.withColumn("runs", F.regexp_extract_all("line", F.lit(runs_of(model.vocabulary)), F.lit(0)))
    lines = lines.withColumn("runs", F.transform("runs", lambda r: F.split(r, " ")))
    grams = F.array_distinct(F.flatten(F.transform("runs", lambda w: F.concat(grams_of(w, 2), grams_of(w, 3)))))
    found = lines.select(*KEY, "paragraph", F.explode_outer(grams).alias("gram")).join(F.broadcast(weights), "gram")
    sums = [F.sum(F.col("w")[k]).alias(f"s{k}") for k in range(len(model.names))]
    # templates are training examples, so their pairs are among the weighted n-grams
    scored = found.groupBy(*KEY, "paragraph").agg(*sums, F.collect_set("gram").alias("grams"))
    logits = F.array(*((F.col(f"s{k}") + float(model.bias[k])) / model.temperature for k in range(len(model.names))))
    top = F.array_max("logits")
    scored = scored.select(*KEY, "paragraph", "grams", logits.alias("logits")).select(
        *KEY, "paragraph", "grams", F.element_at(F.array(*map(F.lit, model.names)), F.array_position("logits", top).cast("int")).alias("family"),
        (1 / F.aggregate(F.transform("logits", lambda z: F.exp(z - top)), F.lit(0.0), lambda a, b: a + b)).alias("probability"),
    )
    named = scored.where((F.col("family") != UNKNOWN) & (F.col("probability") > model.least))
    checked = named.join(F.broadcast(templates), "family")
    covers = F.size(F.array_intersect("grams", "template")) >= 0.8 * F.size("template")
    return checked.groupBy(*KEY, "paragraph", "family", "probability").agg(F.max(covers).alias("confirmed"))


def license_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_paragraphs, n_licence_paragraphs, families, family, probability and confirmed of every row.

    family is that of the most probable paragraph, "unknown" where there is none.
    """
    rows = keyed(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *KEY)
    own = license_paragraphs(rows).groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n_licence_paragraphs"), F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"),
        F.max(F.struct(F.round("probability", 6).alias("probability"), (-F.col("paragraph")).alias("back"), F.col("family"), F.col("confirmed"))).alias("top"),
    )
    every = rows.select(*KEY, "doc_id", F.size(paragraphs_of(F.col("text"))).alias("n_paragraphs"))
    return every.join(own, KEY, "left").select(
        "doc_id", "n_paragraphs", F.coalesce("n_licence_paragraphs", F.lit(0)).alias("n_licence_paragraphs"), F.coalesce("families", F.lit("")).alias("families"),
        F.coalesce("top.family", F.lit(UNKNOWN)).alias("family"), F.coalesce("top.probability", F.lit(0.0)).alias("probability"), F.coalesce("top.confirmed", F.lit(False)).alias("confirmed"),
    )
