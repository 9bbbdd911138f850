"""Licence scan: a trained paragraph classifier over sparse word n-grams, confirmed by template comparison.

A softmax regression over words and word pairs is trained on the driver from licence notices, perturbed in many ways,
notices of licences that it does not name, and ordinary paragraphs of a bounded sample. Its temperature and the probability
below which a paragraph is `unknown` are calibrated on forms of notice, unnamed licences and paragraphs that are held out
whole. Scoring is DataFrame work only: paragraphs that hold an n-gram without which the model can't leave class `none` are
exploded, their n-grams meet the broadcast model table (at most FEATURES rows), and weights are summed.
"""

from __future__ import annotations

import json
import random
import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Notices of each family: short references as found in documents, and the first sentences of the licence or its header.
TEMPLATES: dict[str, list[str]] = {
    "mit": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
        "SPDX-License-Identifier: MIT",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Released under the Apache 2.0 license.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Released under the GNU GPL v3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "lgpl-3.0": [
        "Licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: LGPL-3.0-only",
    ],
    "agpl-3.0": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "bsd-3-clause": [
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "cc-by-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "cc-by-sa-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "cc-by-nc-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "cc0-1.0": [
        "Dedicated to the public domain under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0 Universal.",
    ],
    "proprietary": [
        "Copyright of the authors. All rights reserved.",
        "All rights reserved. No part of this publication may be reproduced or distributed in any form without prior written permission.",
        "This document is confidential and proprietary; unauthorized copying or use is prohibited.",
    ],
}
#: Names by which notices refer to a family.
NAMES: dict[str, list[str]] = {
    "mit": ["MIT License", "MIT licence", "MIT/Expat license", "mit license"],
    "apache-2.0": ["Apache License, Version 2.0", "Apache 2.0 license", "Apache License 2.0"],
    "gpl-3.0": ["GNU General Public License, version 3", "GNU GPL v3", "GPLv3", "GNU General Public License v3.0"],
    "lgpl-3.0": ["GNU Lesser General Public License, version 3", "GNU LGPL v3", "LGPLv3"],
    "agpl-3.0": ["GNU Affero General Public License, version 3", "GNU AGPL v3", "AGPLv3"],
    "bsd-3-clause": ["BSD 3-Clause License", "three-clause BSD license", "new BSD license"],
    "mpl-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL 2.0"],
    "cc-by-4.0": ["Creative Commons Attribution 4.0 International License", "CC BY 4.0", "Creative Commons Attribution 4.0"],
    "cc-by-sa-4.0": ["Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0"],
    "cc-by-nc-4.0": ["Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0"],
    "cc0-1.0": ["CC0 1.0", "CC0 1.0 Universal dedication", "Creative Commons Zero 1.0"],
    "proprietary": [],
}
#: Licences without a class of their own: the unknown class. The second list is held out.
OTHERS = [
    ["Eclipse Public License 2.0", "Artistic License 2.0", "zlib license", "SIL Open Font License, version 1.1", "European Union Public Licence", "vendor's end user agreement", "terms given in the accompanying file", "license chosen by the authors", "public domain"],
    ["Boost Software License 1.0", "ISC license", "Open Database License", "Common Development and Distribution License", "provider's terms of service"],
]
#: Forms of notice around a name. The second list is held out.
FORMS = [
    ["Released under the {}.", "Licensed under the {}.", "This work is licensed under the {}.", "This project is licensed under the terms of the {}.", "Distributed under the {}; see the license file for details.", "The source code is available under the {}.", "You may use this file under the terms of the {}.", "{}"],
    ["Published under {}.", "Use of this software is governed by the {}.", "It may be copied and changed as the {} allows.", "The contents are covered by the {}, a copy of which comes with them."],
]
#: Licence-like prose that names no licence: the unknown class, too. The second list is held out.
UNKNOWN = [
    ["See the license agreement for details of permitted use.", "This software is licensed to you by the vendor under an end user agreement.", "You may copy this work for private study only.", "Released under a permissive license chosen by the authors.", "Permission to use it is given by the owner of the copyright."],
    ["Use of this data is subject to the provider's terms of service.", "The license terms are found in the file of that name."],
]
#: Ordinary prose that shares words with notices: the none class, with the sample's paragraphs. The second list is held out.
NONE = [
    ["She renewed her driving license at the public office in May.", "Students at MIT released a study of the Apache people.", "The general public was free to modify the version shown in the source.", "The work of the foundation is published in three volumes.", "The copy of the file is in the library.", "The terms of the treaty were released in version after version.", "All seats are reserved and the rights of guests are shown at the door.", "The board gave permission for the concert.", "The city will license the drivers under the new law.", "He is free to copy the notes of the others.", "The public may use the hall in any year."],
    ["A licensed physician may prescribe it under the law of the state.", "The software was distributed to schools without charge.", "The Mozilla browser and the GNU tools were installed in the common room."],
]
#: A word keeps its case if it is all capitals in a paragraph that is not: MIT is no German "mit".
WORD = r"[A-Za-z0-9]+(?:[.-][A-Za-z0-9]+)*"
#: Bounds: model rows, sampled paragraphs and the characters of the longest of them, training variants of a text and of a form with a name.
FEATURES, SAMPLE, SAMPLE_CHARS, VARIANTS, FEW = 4096, 2000, 4000, 30, 4
#: A paragraph ends at an empty line, or at a line break after a sentence's end; other line breaks are wraps.
BREAK = r"(?<=[.!?:;])[ \t\r]*\n\s*|\n[ \t\r]*\n\s*"
#: Share of a template's n-grams in a paragraph that confirms its family.
LEAST = 0.5
CLASSES = [*TEMPLATES, "unknown", "none"]
SEED = 42


def words_of(text: str) -> list[str]:
    words = re.findall(WORD, text)
    loud = 2 * sum(w == w.upper() and w != w.lower() for w in words) > len(words) > 3
    return [w if w == w.upper() and not loud else w.lower() for w in words]



def grams_of(words: list[str]) -> set[tuple[str, str | None]]:
    return {(w, None) for w in words} | set(zip(words, words[1:], strict=False))


def _variants(text: str, filler: list[str], rng: random.Random, n: int) -> list[list[str]]:
    """Word lists made of a notice: words dropped, a stretch taken, other words before and after."""
    words, out = words_of(text), [words_of(text)]
    for _ in range(n):
        own = list(words)
        if len(own) > 25 and rng.random() < 0.5:
            a = rng.randrange(0, len(own) - 20)
            own = own[a : a + rng.randrange(20, 40)]
        own = [w for w in own if rng.random() > 0.06]
        before, after = (rng.choices(filler, k=rng.randrange(0, 25)) if filler and rng.random() < 0.5 else [] for _ in range(2))
        out.append([*before, *own, *after])
    return out


class Model:
    """Weights by n-gram, biases, temperature, the thresholds of a named family and of any licence at all, and the share of held-out examples read right."""

    def __init__(self, grams, weights: np.ndarray, bias: np.ndarray, temperature: float, threshold: float, least: float, held_out: float) -> None:
        self.grams, self.weights, self.bias, self.temperature, self.threshold, self.least, self.held_out = grams, weights, bias, temperature, threshold, least, held_out


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _examples(held: int, filler: list[str], rng: random.Random) -> list[tuple[set, int]]:
    """(n-grams, class) of the lists that are fitted on (held 0) or held out (held 1), in many variants."""
    texts: list[tuple[str, int, int]] = []
    for label, name in enumerate(CLASSES[:-2]):
        texts += [(form.format(n), label, FEW) for form in FORMS[held] for n in NAMES[name]]
        texts += [] if held else [(t, label, VARIANTS) for t in TEMPLATES[name]]
    unknown, none = len(CLASSES) - 2, len(CLASSES) - 1
    texts += [(form.format(n), unknown, FEW) for form in FORMS[held] for n in OTHERS[held]]
    texts += [(t, unknown, VARIANTS) for t in UNKNOWN[held]] + [(t, none, VARIANTS) for t in NONE[held]]
    return [(grams_of(w), label) for t, label, n in texts for w in _variants(t, filler, rng, n)]


def _matrix(examples: list[tuple[set, int]], place: dict) -> tuple[np.ndarray, np.ndarray]:
    x = np.zeros((len(examples), len(place)), dtype=np.float32)
    for row, (found, _) in enumerate(examples):
        for g in found:
            if g in place:
                x[row, place[g]] = 1
    return x, np.array([label for _, label in examples])


def train(paragraphs: list[str], steps: int = 250, rate: float = 10.0, decay: float = 1e-4) -> Model:
    """Fit on variants of the notices and the sampled paragraphs; calibrate on held-out forms, licences and paragraphs (every fourth).

    A sampled paragraph that looks like a template is no example of class none. An empty sample is allowed.
    """
    rng = random.Random(SEED)
    templates = [grams_of(words_of(t)) for ts in TEMPLATES.values() for t in ts]
    plain = [p for p in (words_of(x) for x in paragraphs) if p]
    plain = [p for p in plain if not any(len(g & t) >= LEAST * len(t) for g in [grams_of(p)] for t in templates)]
    filler = [w for p in plain[:500] for w in p]
    fitted, held = (_examples(k, filler, rng) for k in (0, 1))
    none = len(CLASSES) - 1
    fitted += [(grams_of(p), none) for k, p in enumerate(plain) if k % 4 < 3]
    held += [(grams_of(p), none) for k, p in enumerate(plain) if k % 4 == 3]
    counts: dict = {}
    for t in [*(t for ts in TEMPLATES.values() for t in ts), *UNKNOWN[0], *NONE[0], *(f.format(n) for ns in [*NAMES.values(), OTHERS[0]] for n in ns for f in FORMS[0])]:
        for g in grams_of(words_of(t)):
            counts[g] = counts.get(g, 0) + 1
    grams = sorted(counts, key=lambda g: (-counts[g], g[0], g[1] or ""))[:FEATURES]
    place = {g: i for i, g in enumerate(grams)}
    (x, label), (hx, truth) = _matrix(fitted, place), _matrix(held, place)
    y = np.eye(len(CLASSES), dtype=np.float32)[label]
    balance = (1 / np.maximum(y.sum(axis=0), 1)) @ y.T
    balance = (balance / balance.sum()).astype(np.float32)[:, None]
    weights, bias = np.zeros((len(grams), len(CLASSES)), dtype=np.float32), np.zeros(len(CLASSES), dtype=np.float32)
    bias[none] = 2.0  # a paragraph without a known n-gram
    for _ in range(steps):
        gap = (_softmax(x @ weights + bias) - y) * balance
        weights -= rate * (x.T @ gap + decay * weights)
        bias[:-1] -= rate * np.minimum(gap.sum(axis=0)[:-1], 0.1)
        bias[:-1] = np.minimum(bias[:-1], 0.0)
    z = hx @ weights + bias
    right = np.arange(len(truth)), truth
    temperature = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 3.0), key=lambda t: -np.log(_softmax(z / t)[right] + 1e-9).mean())
    p = _softmax(z / temperature)
    guess, sure = p.argmax(axis=1), p.max(axis=1)
    named = guess < len(TEMPLATES)
    threshold = next((t for t in np.arange(0.3, 0.96, 0.05) if (guess == truth)[named & (sure >= t)].mean() >= 0.98), 0.95)
    licence = np.where(guess == none, 0, 1 - p[:, none])
    least = next((t for t in np.arange(0.5, 0.96, 0.05) if (truth != none)[licence >= t].mean() >= 0.98), 0.95)
    return Model(grams, weights, bias, float(temperature), float(threshold), float(least), float((guess == truth).mean()))


def _hash(a: str, b: str | None) -> int:
    """xxhash64(a, b) as Spark computes it, unsigned."""
    h = xxhash.xxh64_intdigest(a.encode(), SEED)
    return h if b is None else xxhash.xxh64_intdigest(b.encode(), h)


def needed(model: Model) -> list[int]:
    """Hashes of n-grams of which a paragraph must hold one for a class other than none: all the others together don't outweigh its bias."""
    weights = np.round(model.weights.astype(float), 5)
    most = np.maximum((weights[:, :-1] - weights[:, -1:]).max(axis=1, initial=0), 0)
    order = np.argsort(most, kind="stable")
    idle = np.cumsum(most[order]) < float(model.bias[-1] - model.bias[:-1].max()) - 1e-6
    return [_hash(*model.grams[i]) - (1 << 64) * (_hash(*model.grams[i]) >> 63) for i in order[~idle].tolist()]


def _table(spark, rows: list, schema: str) -> DataFrame:
    """A small table from a literal."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def paragraphs_of(text_col: str):
    return F.split(F.col(text_col).cast("string"), BREAK)


def fit(docs: DataFrame, text_col: str = "text") -> Model:
    """Train with at most SAMPLE distinct paragraphs of docs of at most SAMPLE_CHARS characters, those with the least hashes, as ordinary prose."""
    lines = docs.select(F.explode(paragraphs_of(text_col)).alias("line")).where(F.length("line") <= SAMPLE_CHARS)
    n = lines.count()
    share = F.lit(min(1.0, 1.5 * SAMPLE / max(n, 1)) * (1 << 30)).cast("long")
    drawn = lines.withColumn("h", F.xxhash64("line")).where(F.pmod("h", F.lit(1 << 30)) <= share).distinct()
    return train([r.line for r in drawn.orderBy("h").limit(SAMPLE).select("line").collect()])


def scan(docs: DataFrame, model: Model | None = None, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, paragraph, family, probability, template_likeness, confirmed) for each paragraph that reads like a licence.

    Whole texts are read. A paragraph ends at an empty line, or at a line break that follows a sentence's end; its number
    counts from 0. `family` is a licence family, or `unknown` where the classifier sees a licence but no family at
    its calibrated probability. A family is confirmed if some template of it has at least `least` of its n-grams in the
    paragraph. Paragraphs of class none, null and empty texts give no rows; a repeated row gives its own rows; a null id
    stays null; extra columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    model = model or fit(docs, text_col)
    names = [f"w{i}" for i in range(len(CLASSES))]
    templates = [(label, words_of(t)) for label, name in enumerate(TEMPLATES) for t in TEMPLATES[name]]
    held = [{g for g in grams_of(w) if g in set(model.grams)} for _, w in templates]
    rows = [{"a": a, "b": b, **{n: round(float(w), 5) for n, w in zip(names, model.weights[i], strict=True)}, "t": [k for k, g in enumerate(held) if (a, b) in g]} for i, (a, b) in enumerate(model.grams)]
    features = _table(spark, rows, "a string, b string, " + ", ".join(f"{n} double" for n in names) + ", t array<int>").withColumn("g", F.xxhash64("a", "b")).drop("a", "b")
    lines = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("_row"), F.posexplode(paragraphs_of(text_col)).alias("paragraph", "line"))
    # let(e, w, f): f of w = e, e computed once; a column would be put into the lambda and computed for each word
    let = lambda e, w, f: f"transform(array({e}), {w} -> {f})[0]"
    loud = "2 * size(filter(w, y -> y = upper(y) and y <> lower(y))) > size(w) and size(w) > 3"
    cased = let(f"regexp_extract_all(line, '{WORD}', 0)", "w", let(loud, "l", "transform(w, x -> if(x = upper(x) and not l, x, lower(x)))"))
    pairs = "if(size(w) > 1, transform(sequence(0, size(w) - 2), i -> xxhash64(get(w, i), get(w, i + 1))), cast(array() as array<bigint>))"
    held_grams = lines.select("doc_id", "_row", "paragraph", F.expr(let(cased, "w", f"concat(transform(w, x -> xxhash64(x)), {pairs})")).alias("gs"))
    some = held_grams.where(F.exists("gs", lambda x: x.isin(needed(model))))
    grams = some.select("doc_id", "_row", "paragraph", F.explode(F.array_distinct("gs")).alias("g"))
    met = grams.join(F.broadcast(features), "g")  # FEATURES rows at most
    per = [F.expr(f"count_if(array_contains(t, {k}))").alias(f"t{k}") for k in range(len(templates))]
    summed = met.groupBy("doc_id", "_row", "paragraph").agg(*[F.sum(n).alias(n) for n in names], *per)
    score = [(F.col(n) + float(b)) / model.temperature for n, b in zip(names, model.bias, strict=True)]
    scored = summed.select("*", F.array(*score).alias("z")).withColumn("top", F.array_max("z"))
    total = F.aggregate(F.transform("z", lambda v: F.exp(v - F.col("top"))), F.lit(0.0), lambda a, v: a + v)
    scored = scored.withColumn("probability", 1 / total).withColumn("label", F.array_position("z", F.col("top")) - 1)
    scored = scored.withColumn("licence", 1 - F.exp(F.element_at("z", -1) - F.col("top")) / total)
    likeness = F.lit(0.0)
    for k, ((label, _), g) in enumerate(zip(templates, held, strict=True)):
        likeness = F.greatest(likeness, F.when(F.col("label") == label, F.col(f"t{k}") / max(len(g), 1)).otherwise(0.0))
    found = scored.where((F.col("label") < len(CLASSES) - 1) & (F.col("licence") >= model.least)).withColumn("template_likeness", likeness)
    named = (F.col("label") < len(TEMPLATES)) & (F.col("probability") >= model.threshold)
    family = F.when(named, F.element_at(F.array(*[F.lit(c) for c in CLASSES]), (F.col("label") + 1).cast("int"))).otherwise(F.lit("unknown"))
    return found.select("doc_id", "paragraph", family.alias("family"), F.round("probability", 6).alias("probability"), F.round("template_likeness", 6).alias("template_likeness"), (named & (F.col("template_likeness") >= least)).alias("confirmed"))


def op8_licenses(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
