"""License scans: a trained paragraph classifier, a calibrated unknown class, and confirmation against templates.

A paragraph is a line of a text with its comment marks taken off, joined with the line after it where it is wrapped
(WRAPPED: long enough, and without the end of a sentence), so a notice broken at any column is met whole. Paragraphs
with an anchor word are classified by multinomial logistic regression over the presence of word unigrams and bigrams.

The model is fitted on the driver: on the notices below, on the licences' names in every frame of FRAMES, on perturbed
copies of both, and on anchor-bearing sentences that license nothing, which are the class `unknown`. Whole notices,
frames and sentences are held out in turn (FOLDS), and the temperature that calibrates the probabilities is fitted on
what the folds' models say about them. A family is predicted only at probability MIN_PROBABILITY or more. A prediction
is confirmed if the paragraph and one of the family's templates (its notices and names) share at least half of the
lesser one's bigrams.

Everything that touches the corpus is DataFrame functions. Documents are read once: a row of each, with its paragraphs,
is a narrow table in the shared folder. Paragraphs are scored where they stand: their n-grams meet the weights, a
table of fixed size, and are summed in the task before one row a paragraph is shuffled, so no text is a key.

Defined cases: a null, empty or anchorless text has no licence paragraphs, families '' and best 'none'; repeated rows and
null doc_ids each keep their row; ties of probability go to the later family name; very long lines are scored whole; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache, reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import cut, only

# Notices as their publishers word them.
NOTICES = {
    "agpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Licensed under the GNU Affero General Public License, version 3.",
        "Released under AGPL-3.0.",
    ],
    "apache": [
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
        "Licensed under the Apache License, Version 2.0.",
        "Apache License Version 2.0, January 2004",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Released under the BSD 3-Clause License.",
        "Distributed under the 2-clause BSD license.",
    ],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."],
    "cc-by-nc": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0.", "Licensed under CC BY-NC-SA 4.0."],
    "cc-by-nd": ["This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "Licensed under CC BY-ND 4.0."],
    "cc-by-sa": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.", "Licensed under CC BY-SA 4.0."],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "Released under CC0 1.0 Universal.", "This work is dedicated to the public domain under the CC0 Public Domain Dedication."],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
        "This work is licensed under the GNU General Public License, version 3.",
        "Released under the GPL, version 2 or later.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Released under the ISC License."],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "Licensed under the GNU Lesser General Public License, version 3.",
        "Released under LGPL-2.1.",
    ],
    "mit": [
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "Released under the MIT License.",
        "The MIT License (MIT)",
        "Licensed under the MIT license.",
        "SPDX-License-Identifier: MIT",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "Released under MPL-2.0.",
    ],
    "proprietary": [
        "All rights reserved. No part of this publication may be reproduced, distributed or transmitted in any form without the prior written permission of the publisher.",
        "Copyright 2024 Example Corporation. All rights reserved.",
        "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential.",
    ],
    "unlicense": ["This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
}
# Sentences with anchor words that license nothing.
OTHER = [
    "The officer asked to see the driver's license and registration.",
    "A license to operate the station was granted by the commission in May.",
    "Her fishing licence expired last year.",
    "The band released a new album under the name of its singer.",
    "Copyright law changed twice in the last century.",
    "He asked for permission to leave the table.",
    "The company reported higher licensing revenue for the quarter.",
    "The warranty covers parts and labour for two years.",
    "Researchers at MIT published a study of urban traffic.",
    "Apache helicopters flew over the valley at dawn.",
    "The museum is open to the public on Sundays.",
    "Redistribution of income remained the main question of the debate.",
    "The rights of the workers were reserved for a later meeting.",
    "Creative work in the commons was shown at the village fair.",
    "The license plate was found near the river.",
    "Water rights in the valley are licensed by the state.",
    "The public domain of the crown was sold in parts.",
    "All rights and duties pass to the heirs.",
    "Mozilla announced a new version of its browser.",
    "The novel is protected by copyright, the court said.",
    "Er ging mit dem Hund in den Park und kam mit ihm zurück.",
    "MIT DEM ZUG FUHR SIE IN DIE STADT UND MIT DEM BUS NACH HAUSE.",
    "The permission was given and the work is done under the terms of the contract.",
    "This is the software that the state may use, in any form, for the work of the court.",
    "Le permis de pêche est valable pour une année et pour une personne.",
    "La licencia de obras fue concedida por el ayuntamiento en mayo.",
]
# The licences' names.
NAMES = {
    "agpl": ["GNU Affero General Public License", "GNU AGPL", "AGPL-3.0-or-later", "AGPL-3.0-only"],
    "apache": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0"],
    "bsd": ["BSD License", "BSD 3-Clause License", "BSD 2-Clause License", "3-clause BSD license", "BSD-3-Clause", "BSD-2-Clause"],
    "cc-by": ["Creative Commons Attribution 4.0 International License", "Creative Commons Attribution License", "CC BY 4.0", "CC-BY-4.0"],
    "cc-by-nc": ["Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial License", "CC BY-NC 4.0", "CC-BY-NC-4.0"],
    "cc-by-nd": ["Creative Commons Attribution-NoDerivatives 4.0 International License", "Creative Commons Attribution-NoDerivatives License", "CC BY-ND 4.0", "CC-BY-ND-4.0"],
    "cc-by-sa": ["Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike License", "CC BY-SA 4.0", "CC-BY-SA-4.0"],
    "cc0": ["CC0 1.0 Universal", "CC0 Public Domain Dedication", "CC0 1.0 license", "CC0-1.0"],
    "gpl": ["GNU General Public License", "GNU GPL, version 3", "GPL version 2", "GPL-3.0-or-later", "GPL-2.0-only"],
    "isc": ["ISC License", "ISC license"],
    "lgpl": ["GNU Lesser General Public License", "GNU LGPL, version 3", "LGPL version 2.1", "LGPL-2.1-or-later", "LGPL-3.0-only"],
    "mit": ["MIT License", "MIT license", "Expat (MIT) License"],
    "mpl": ["Mozilla Public License", "Mozilla Public License 2.0", "Mozilla Public License, version 2.0", "MPL 2.0", "MPL-2.0"],
    "unlicense": ["Unlicense", "The Unlicense"],
}
# How projects name their licence.
FRAMES = [
    "Licensed under the {}.",
    "Released under the {}.",
    "This project is licensed under the terms of the {}.",
    "Distributed under the {}. See the LICENSE file for details.",
    "This software is made available to you under the {}.",
    "License: {}",
    "The source code of this package is published under {}; see COPYING.",
    "SPDX-License-Identifier: {}",
    "This work is licensed under a {}.",
]
UNKNOWN = "unknown"
ANCHORS = r"(?i:licen[cs]|copyright|permission|redistribut|rights reserved|public domain|\bwarrant|spdx|\bl?gpl|\bagpl|\bmpl|\bcc0|\bcc[ -]by|creative commons|unauthorized copying|free to copy)|\b(?:Apache|MIT|BSD|ISC)\b"
#: what a text with an anchor holds, in lower case or as it stands: cheap tests before any pattern
STEMS = ["licen", "copyright", "permission", "redistribut", "reserved", "domain", "warrant", "spdx", "gpl", "mpl", "cc0", "cc by", "cc-by", "commons", "copying", "to copy"]
PROPER = ["Apache", "MIT", "BSD", "ISC"]
COMMENT = r"(?m)^[ \t]*(?://+|/\*+|\*+/?|#+|--+|;+|%+|<!--+)[ \t]*"
WRAPPED = r"(?m)^([^\n]{40,120}[^\s.!?:;])[ \t]*\n[ \t]*(?=\S)"
WORD = r"[a-z0-9]+(?:[.+-][a-z0-9]+)*"
MIN_PROBABILITY = 0.6
MIN_SHARE, MIN_SHARED = 0.5, 2
COPIES, STEPS, RATE, RIDGE = 3, 120, 3.0, 1e-4
FOLDS = 4
SEED = 5


def words_of(paragraph: str) -> list[str]:
    return re.findall(WORD, paragraph.lower())


def grams_of(words: list[str]) -> set[str]:
    return {*words, *map(" ".join, zip(words, words[1:], strict=False))}


def _copies(words: list[str], rng: np.random.Generator, n: int) -> list[list[str]]:
    """The words, and copies with words left out and others set before or after."""
    out = [words]
    for _ in range(n):
        kept = [w for w in words if rng.random() > 0.12] or words
        noise = [f"w{rng.integers(1000)}" for _ in range(rng.integers(0, 6))]
        at = int(rng.integers(0, len(noise) + 1))
        out.append(noise[:at] + kept + noise[at:])
    return out


def _is_noise(gram: str) -> bool:
    return any(re.fullmatch(r"w\d+", w) for w in gram.split())


@lru_cache(maxsize=1)
def examples() -> tuple[list[str], np.ndarray, list[list[str]], np.ndarray]:
    """Classes; of each training row its class, its words, and its group: the notice, frame or sentence that it comes from."""
    rng = np.random.default_rng(SEED)
    classes = sorted([*NOTICES, UNKNOWN])
    rows = []
    sources = [(c, t, f"{c} {i}") for c, own in sorted([*NOTICES.items(), (UNKNOWN, OTHER)]) for i, t in enumerate(own)]
    sources += [(c, frame.format(name), frame) for c, names in sorted(NAMES.items()) for name in names for frame in FRAMES]
    groups = {g: i for i, g in enumerate(dict.fromkeys(g for _, _, g in sources))}
    for c, t, group in sources:
        rows += [(classes.index(c), words, groups[group]) for words in _copies(words_of(t), rng, COPIES * (4 if group not in FRAMES else 1))]
    return classes, np.array([c for c, _, _ in rows]), [w for _, w, _ in rows], np.array([g for _, _, g in rows])


@lru_cache(maxsize=1)
def features() -> tuple[dict[str, int], np.ndarray]:
    """Place of each n-gram that occurs often enough, and which of them each row has."""
    _, _, rows, _ = examples()
    own = [grams_of(words) for words in rows]
    counts: dict[str, int] = {}
    for found in own:
        for g in found:
            counts[g] = counts.get(g, 0) + 1
    at = {g: i for i, g in enumerate(sorted(g for g, n in counts.items() if n >= COPIES and not _is_noise(g)))}
    x = np.zeros((len(own), len(at)), np.float32)
    for i, found in enumerate(own):
        x[i, [at[g] for g in found if g in at]] = 1
    return at, x


def fit(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases from the marked rows; classes count alike."""
    classes, labels, _, _ = examples()
    x, labels = features()[1][rows], labels[rows]
    y = np.eye(len(classes), dtype=np.float32)[labels]
    share = 1 / np.maximum(y.sum(axis=0), 1)[labels]
    share *= len(share) / share.sum()
    w, b = np.zeros((x.shape[1], len(classes)), np.float32), np.zeros(len(classes), np.float32)
    b[classes.index(UNKNOWN)] = 1.0
    for _ in range(STEPS):
        z = x @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        error = (p - y) * (share[:, None] / len(share)).astype(np.float32)
        w -= RATE * (x.T @ error + RIDGE * w)
        b -= RATE * 0.1 * error.sum(axis=0)
    return w, b


@lru_cache(maxsize=1)
def held_out() -> np.ndarray:
    """Logits of each row by a model that met nothing of its group."""
    classes, _, _, groups = examples()
    x, out = features()[1], np.zeros((len(groups), len(classes)))
    for k in range(FOLDS):
        mine = groups % FOLDS == k
        w, b = fit(~mine)
        out[mine] = x[mine] @ w + b
    return out


def probabilities(z: np.ndarray, temperature: float) -> np.ndarray:
    p = np.exp((z - z.max(axis=1, keepdims=True)) / temperature)
    return p / p.sum(axis=1, keepdims=True)


@lru_cache(maxsize=1)
def model() -> tuple[list[str], dict[str, list[float]], list[float], float]:
    """Classes, weights of each n-gram, biases, temperature."""
    classes, labels, _, _ = examples()
    z = held_out()

    def loss(t: float) -> float:
        return -float(np.log(np.maximum(probabilities(z, t)[np.arange(len(labels)), labels], 1e-12)).mean())

    temperature = min(np.geomspace(0.2, 5, 60).tolist(), key=loss)
    w, b = fit(np.ones(len(labels), bool))
    return classes, {g: np.round(w[i].astype(float), 6).tolist() for g, i in features()[0].items()}, np.round(b.astype(float), 6).tolist(), float(temperature)


def templates() -> list[tuple[str, list[str]]]:
    """Family and bigrams of each notice and each name of two words or more."""
    return [(c, own) for source in (NOTICES, NAMES) for c, texts in source.items() for t in texts if (own := _bigrams(words_of(t)))]


def _bigrams(words: list[str]) -> list[str]:
    return sorted(set(map(" ".join, zip(words, words[1:], strict=False))))


def grams(words: Column) -> Column:
    """Distinct unigrams and bigrams of an array of words."""
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.concat(words, pairs))


def _constant(spark, value, ddl: str) -> DataFrame:
    """A small table that travels inside the plan."""
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(value)), f"array<struct<{ddl}>>")).alias("r")).select("r.*")


def hopeful(text: Column) -> Column:
    """Whether a text may hold an anchor, by plain substrings."""
    low = F.lower(text)
    tests = [F.contains(low, F.lit(s)) for s in STEMS] + [F.contains(text, F.lit(p)) for p in PROPER]
    return reduce(Column.__or__, tests)


def paragraphs(text: Column) -> Column:
    """The paragraphs of a text that hold an anchor; null for texts that can't."""
    joined = F.regexp_replace(F.regexp_replace(text, COMMENT, ""), WRAPPED, "$1 ")
    return F.when(hopeful(text), F.filter(F.split(joined, "\n"), lambda p: p.rlike(ANCHORS)))


def classify(found: DataFrame) -> DataFrame:
    """found(rid, number, paragraph) -> rid, number, family, probability, confirmed of each row."""
    spark = found.sparkSession
    classes, weights, biases, temperature = model()
    table = _constant(spark, [{"gram": g, "w": w} for g, w in weights.items()], "gram string, w array<double>")
    words = found.select("rid", "number", F.regexp_extract_all(F.lower("paragraph"), F.lit(WORD), 0).alias("words"))
    met = words.select("rid", "number", F.explode_outer(grams(F.col("words"))).alias("gram")).join(F.broadcast(table), "gram", "left")
    sums = met.groupBy("rid", "number").agg(*[F.coalesce(F.sum(F.round(F.col("w")[i] * 1e6).cast("long")), F.lit(0)).alias(f"s{i}") for i in range(len(classes))])
    logit = [(F.col(f"s{i}") / 1e6 + b) / temperature for i, b in enumerate(biases)]
    top = F.greatest(*logit)
    scored = sums.select("rid", "number", F.array(*[F.exp(x - top) for x in logit]).alias("e"))
    total = F.aggregate("e", F.lit(0.0), lambda a, b: a + b)
    told = F.array_max(F.arrays_zip((F.transform("e", lambda v: v / total)).alias("p"), F.array(*map(F.lit, classes)).alias("f")))
    best = scored.select("rid", "number", told.alias("t"))
    family = F.when(F.col("t")["p"] >= MIN_PROBABILITY, F.col("t")["f"]).otherwise(UNKNOWN)
    named = best.select("rid", "number", family.alias("family"), F.round(F.col("t")["p"], 6).alias("probability"))
    return _confirmed(named, words)


def _confirmed(named: DataFrame, words: DataFrame) -> DataFrame:
    own_templates: dict[str, list[list[str]]] = {}
    for family, own in templates():
        own_templates.setdefault(family, []).append(own)
    table = _constant(named.sparkSession, [{"family": c, "templates": t} for c, t in own_templates.items()], "family string, templates array<array<string>>")
    n = F.greatest(F.size("words") - 1, F.lit(0))
    own = F.array_distinct(F.zip_with(F.slice("words", 1, n), F.slice("words", 2, n), lambda a, b: F.concat_ws(" ", a, b)))
    met = named.join(words.select("rid", "number", own.alias("own")), ["rid", "number"]).join(F.broadcast(table), "family", "left")

    def agrees(template: Column) -> Column:
        shared = F.size(F.array_intersect(F.col("own"), template))
        return (shared >= F.least(F.lit(MIN_SHARED), F.size(template))) & (shared >= MIN_SHARE * F.least(F.size("own"), F.size(template)))

    return met.select("rid", "number", "family", "probability", F.coalesce(F.exists("templates", agrees), F.lit(False)).alias("confirmed"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_paragraphs (with an anchor), n_unknown, n_confirmed, families (confirmed, sorted, comma-joined), best, probability of every row."""
    rows = cut(only(docs, "doc_id", "text").select("doc_id", F.monotonically_increasing_id().alias("rid"), paragraphs(F.col("text")).alias("found")), "paragraphs")
    met = classify(rows.select("rid", F.posexplode("found").alias("number", "paragraph")))
    named = F.col("family") != UNKNOWN
    per = met.groupBy("rid").agg(
        F.count("*").alias("n_paragraphs"),
        F.count_if(~named).alias("n_unknown"),
        F.count_if("confirmed").alias("n_confirmed"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("confirmed"), F.col("family")))), ",").alias("families"),
        F.max(F.when(F.col("confirmed"), F.struct("probability", "family"))).alias("top"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    told = rows.select("rid", "doc_id").join(per, "rid", "left")
    return told.select("doc_id", zero("n_paragraphs"), zero("n_unknown"), zero("n_confirmed"), F.coalesce("families", F.lit("")).alias("families"), F.coalesce(F.col("top.family"), F.lit("none")).alias("best"), F.coalesce(F.col("top.probability"), F.lit(0.0)).alias("probability"))
