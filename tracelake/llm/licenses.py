"""Licence scan by paragraphs: sparse n-gram logistic regression, a calibrated unknown class, and templates that confirm.

Distinct words and pairs of neighbouring words of a paragraph are hashed into buckets. A multinomial logistic regression over them,
made sparse by an L1 penalty, is trained in numpy on notices, fragments of them, other legal wording and paragraphs without
any. On the documents everything is column expressions: the weights are array literals that a bucket's number indexes.
A paragraph is first held against the greatest lead that any licence could have over "none", so nearly all paragraphs cost
one sum.
"""

from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 12
WORD = r"[\p{L}\p{N}]+"
NONE, OTHER = "none", "other"

# Short notices that the licences themselves or their stewards publish for marking works.
NOTICES = {
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "bsd": (
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ),
    "cc0": (
        "Released under CC0 1.0 Universal, dedicated to the public domain.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "SPDX-License-Identifier: CC0-1.0",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "lgpl": (
        "Licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
    ),
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
}
# Wording of licences and rights that belong to no family above.
OTHERS = (
    "All rights reserved. No part of this publication may be reproduced without prior written permission.",
    "Licensed under the terms of the Example Public Agreement, version 7.",
    "Released under the Sample Community License.",
    "This software is proprietary and confidential; unauthorized copying is strictly prohibited.",
    "By using this service you agree to the terms of use and the end user license agreement.",
    "This work is licensed under a custom license; contact the author for permission.",
    "SPDX-License-Identifier: LicenseRef-Custom",
    "Use is subject to license terms.",
    "Copyright holders grant no rights beyond personal use.",
)


def _buckets(words: list[str]) -> list[int]:
    """Buckets of words and of pairs, as ``xxhash64`` on the documents gives them."""
    one = [xxhash.xxh64_intdigest(word.encode(), seed=42) for word in words]
    two = [xxhash.xxh64_intdigest(b.encode(), seed=a) for a, b in zip(one, words[1:], strict=False)]
    return [value & (1 << BITS) - 1 for value in [*one, *two]]


def split_words(paragraph: str) -> list[str]:
    """Lower-cased runs of letters and digits, as ``WORD`` finds them."""
    import regex

    return regex.findall(WORD, paragraph.lower())


def _vector(words: list[str]) -> np.ndarray:
    found = sorted(set(_buckets(words)))
    return np.bincount(found, minlength=1 << BITS) / np.sqrt(max(1, len(found)))


@dataclass
class LicenseModel:
    """Weights by bucket and class, biases, the temperature, and what a family needs to be believed."""

    classes: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    least_score: float = 0.6
    least_alike: float = 0.7

    def classify(self, words: list[str]) -> tuple[str, float]:
        """The likeliest class of a paragraph and its calibrated probability: what the column expressions compute."""
        logits = (_vector(words) @ self.weights + self.bias) / self.temperature
        share = np.exp(logits - logits.max())
        share /= share.sum()
        return self.classes[int(share.argmax())], float(share.max())


def _samples(background: list[str], random: np.random.Generator, copies: int) -> list[tuple[str, list[str]]]:
    """Notices, worn notices and fragments, with words of the background around some; other wording; the background."""
    plain = [split_words(paragraph) for paragraph in background]
    plain = [words for words in plain if words]
    loose = [word for words in plain for word in words][:20_000] or ["text"]

    def worn(words: list[str]) -> list[str]:
        kept = [word for word in words if random.random() > 0.06] or words
        if len(kept) > 8 and random.random() < 0.4:
            start = int(random.integers(0, len(kept) // 2))
            kept = kept[start : start + max(6, int(len(kept) * random.uniform(0.5, 0.9)))]
        if random.random() < 0.3:
            extra = [loose[int(i)] for i in random.integers(0, len(loose), int(random.integers(1, 5)))]
            kept = [*extra, *kept] if random.random() < 0.5 else [*kept, *extra]
        return kept

    found = []
    for family, notices in [*NOTICES.items(), (OTHER, OTHERS)]:
        for notice in notices:
            words = split_words(notice)
            found.append((family, words))
            found.extend((family, worn(words)) for _ in range(copies))
    found.extend((NONE, words) for words in plain)
    found.extend((NONE, [w]) for w in ("the", "license", "software", "version", "work", "under", "permission"))
    return found


def train(background: list[str], copies: int = 12, rounds: int = 300, penalty: float = 2e-4, seed: int = 5) -> LicenseModel:
    """Fit by proximal gradient steps; every sixth sample is kept for the temperature."""
    random = np.random.Generator(np.random.PCG64(seed))
    classes = [NONE, OTHER, *sorted(NOTICES)]
    sample = _samples(background, random, copies)
    x = np.array([_vector(words) for _, words in sample], dtype=np.float32)
    y = np.array([classes.index(label) for label, _ in sample])
    held = np.arange(len(y)) % 6 == 5
    counts = np.bincount(y, minlength=len(classes))
    weight = (1 / np.sqrt(np.maximum(counts, 1)))[y]
    weight = (weight / weight[~held].sum())[:, None]
    target = np.eye(len(classes), dtype=np.float32)[y]
    weights = np.zeros((1 << BITS, len(classes)), dtype=np.float32)
    bias = np.zeros(len(classes), dtype=np.float32)
    moving_w, moving_b, rate = np.zeros_like(weights), np.zeros_like(bias), 4.0
    for _ in range(rounds):
        logits = x[~held] @ weights + bias
        share = np.exp(logits - logits.max(axis=1, keepdims=True))
        share /= share.sum(axis=1, keepdims=True)
        error = (share - target[~held]) * weight[~held]
        moving_w = 0.9 * moving_w + x[~held].T @ error
        moving_b = 0.9 * moving_b + error.sum(axis=0)
        weights = weights - rate * moving_w
        weights = np.sign(weights) * np.maximum(np.abs(weights) - rate * penalty, 0)
        bias = bias - 0.1 * rate * moving_b
    model = LicenseModel(classes, weights.astype(np.float64).round(6), bias.astype(np.float64).round(6))
    logits = x[held] @ model.weights + model.bias

    def loss(temperature: float) -> float:
        scaled = logits / temperature
        scaled = scaled - scaled.max(axis=1, keepdims=True)
        return float((np.log(np.exp(scaled).sum(axis=1)) - scaled[np.arange(held.sum()), y[held]]).sum())

    model.temperature = float(min(np.geomspace(0.25, 4, 33), key=loss))
    return model


def fit_license_model(documents: DataFrame, text: str = "text", key: str = "doc_id", paragraphs: int = 1500) -> LicenseModel:
    """Fit with at most ``paragraphs`` paragraphs of the documents as examples of "none".

    The documents with the smallest hashes of their keys give at most five paragraphs each, none of which speaks of licences,
    rights or permission. Hashes are even: a bound worked out from the number of documents leaves a thousand more than twice as
    many as are wanted, so that no more are compared, however many partitions there are.
    """
    lines = F.split(F.col(text), "\n")
    plain = F.filter(lines, lambda p: (F.length(p) > 0) & (F.length(p) < 2000) & ~F.lower(p).rlike(_LEGAL))
    hashed = F.xxhash64(F.col(key), F.lit("licence"))
    share = min(1.0, (2 * (paragraphs // 5) + 1000) / max(1, documents.count()))
    rows = (
        documents.where(F.col(text).isNotNull() & ((hashed.cast("double") + 2.0**63) / 2.0**64 <= share))
        .select(hashed.alias("h"), F.slice(plain, 1, 5).alias("p"))
        .orderBy("h", "p")
        .limit(paragraphs // 5)
        .collect()
    )
    return train([paragraph for row in rows for paragraph in row["p"]])


_LEGAL = "licen[cs]|copyright|rights|permi[st]|spdx|warrant|redistribut|creative commons|public domain"


def _alike(words: Column, family: str) -> Column:
    """The greatest share of the paragraph's words in a notice, or of a notice's words in the paragraph."""
    own = F.array_distinct(words)
    shares = []
    for notice in NOTICES[family]:
        known = sorted(set(split_words(notice)))
        met = F.size(F.array_intersect(own, F.array(*map(F.lit, known)))).cast("double")
        shares += [met / F.greatest(F.size(own), F.lit(4)), met / max(4, len(known))]
    return F.greatest(*shares)


def scan_paragraphs(model: LicenseModel, text: Column) -> Column:
    """The paragraphs of a whole text that speak of a licence: an array of (place, paragraph, family, score, alike).

    Paragraphs are the non-blank lines, numbered from 0 over all lines. family: the likeliest one if its probability is
    ``least_score`` or more and one of its notices is alike by ``least_alike`` or more, else "unknown". A null or empty
    text, and one without such a paragraph, gives an empty array.
    """
    size = 1 << BITS
    families = model.classes[2:]
    low = F.lit(size).cast("bigint")

    def buckets(words: Column) -> Column:
        one = F.transform(words, lambda w: F.xxhash64(w))
        two = F.transform(
            F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))),
            lambda w, i: F.pmod(F.call_function("xxhash64", F.get(words, i), w), low),
        )
        return F.array_distinct(F.concat(F.transform(one, lambda h: F.pmod(h, low)), two))

    def total(weights: np.ndarray, found: Column) -> Column:
        table = F.lit(weights.tolist())
        add = F.aggregate(found, F.lit(0.0), lambda acc, b: acc + F.get(table, b.cast("int")))
        return add / F.sqrt(F.size(found).cast("double"))

    lead = (model.weights[:, 1:] - model.weights[:, :1]).max(axis=1)
    head = float((model.bias[1:] - model.bias[0]).max())

    lines = F.transform(
        F.split(F.coalesce(text, F.lit("")), "\n"),
        lambda p, i: F.struct(
            i.alias("place"), p.alias("paragraph"), F.regexp_extract_all(F.lower(p), F.lit(f"({WORD})")).alias("words")
        ),
    )
    lines = F.filter(lines, lambda p: F.size(p["words"]) > 0)
    hashed = F.transform(
        lines, lambda p: F.struct(p["place"], p["paragraph"], p["words"], buckets(p["words"]).alias("buckets"))
    )
    able = F.filter(hashed, lambda p: total(lead, p["buckets"]) + head > 0)

    def scored(p: Column) -> Column:
        logits = [
            (total(model.weights[:, i], p["buckets"]) + float(model.bias[i])) / model.temperature
            for i in range(len(model.classes))
        ]
        pairs = [F.struct(logit.alias("logit"), F.lit(name).alias("name")) for logit, name in zip(logits, model.classes, strict=True)]
        return F.struct(p["place"], p["paragraph"], p["words"], F.array(*pairs).alias("logits"))

    def judged(p: Column) -> Column:
        best = F.array_max(p["logits"])
        share = 1.0 / F.aggregate(p["logits"], F.lit(0.0), lambda acc, x: acc + F.exp(x["logit"] - best["logit"]))
        return F.struct(p["place"], p["paragraph"], p["words"], best["name"].alias("name"), share.alias("score"))

    def confirmed(p: Column) -> Column:
        alike = F.lit(0.0)
        for family in families:
            alike = F.when(p["name"] == family, _alike(p["words"], family)).otherwise(alike)
        return F.struct(p["place"], p["paragraph"], p["name"], p["score"], alike.alias("alike"))

    def settled(p: Column) -> Column:
        sure = (p["score"] >= model.least_score) & (p["alike"] >= model.least_alike)
        family = F.when(sure, p["name"]).otherwise(F.lit("unknown"))
        return F.struct(p["place"], p["paragraph"], family.alias("family"), p["score"], p["alike"])

    found = F.filter(F.transform(F.transform(able, scored), judged), lambda p: p["name"] != NONE)
    return F.transform(F.transform(found, confirmed), settled)


def summary(scanned: DataFrame, found: str = "found") -> list[Column]:
    """license (the family of the first paragraph that names one; else unknown or none), licenses (all families, in order of
    their names), n_license_paragraphs and score (of the paragraph that decides; 0 without one)."""
    paragraphs = F.col(found)
    sure = F.filter(paragraphs, lambda p: p["family"] != "unknown")
    first = F.get(F.when(F.size(sure) > 0, sure).otherwise(paragraphs), F.lit(0))
    return [
        F.coalesce(first["family"], F.lit(NONE)).alias("license"),
        F.concat_ws(" ", F.array_sort(F.array_distinct(F.transform(sure, lambda p: p["family"])))).alias("licenses"),
        F.size(paragraphs).cast("bigint").alias("n_license_paragraphs"),
        F.coalesce(first["score"], F.lit(0.0)).alias("score"),
    ]
