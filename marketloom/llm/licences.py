"""Operator 4: licence families of paragraphs by sparse word n-gram logistic regression.

Paragraphs are the lines of a text. Their words and word pairs are hashed features of a softmax model over licence
families and "unknown". It is trained on the template sentences below, whole and cut, and on ordinary paragraphs of the
corpus (at most ``SAMPLE``, the first in the order of a hash) with the licence words of templates strewn in singly. The
probability that counts as known is set on held-out cuts and paragraphs. A prediction is confirmed when enough of the
paragraph's word pairs stand in one template of that family.

Defined results: null and empty texts have no paragraphs; paragraphs without words are none; repeated rows are scanned
each; a null doc_id keeps its row; other columns are dropped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import mix, steps, text_bytes, texts_of, word_hashes

# Sentences by which the families are known.
TEMPLATES = {
    "all-rights-reserved": (
        "All rights reserved.",
        "Copyright. All rights reserved. No part of this work may be reproduced without permission of the publisher.",
        "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential.",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "SPDX-License-Identifier: Apache-2.0",
        "Released under the Apache License 2.0.",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Released under the BSD License.",
    ),
    "creative-commons": (
        "Licensed under CC BY 4.0.",
        "Licensed under CC BY-SA 4.0.",
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "This work is licensed under the Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
        "SPDX-License-Identifier: MIT",
    ),
    "mozilla": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "public-domain": (
        "This work has been dedicated to the public domain.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0.",
        "This is free and unencumbered software released into the public domain.",
    ),
}
FAMILIES = (*sorted(TEMPLATES), "unknown")
FEATURES = 1 << 15
#: Ordinary paragraphs that are read for learning.
SAMPLE = 4000
#: Share of held-out ordinary paragraphs that may pass as known before confirmation.
FALSE_KNOWN = 0.001
#: Share of a paragraph's word pairs that one template must hold, or of a template's that the paragraph must.
CONFIRMED = 0.6


class Paragraphs:
    """Lines with words of a batch of texts, and their features."""

    def __init__(self, column: pa.Array) -> None:
        data, offsets = text_bytes(column)
        words, text, first, _ = word_hashes(data, offsets)
        breaks = np.flatnonzero(data == 10)
        line = np.searchsorted(breaks, first) + text  # rises at every line end and text end
        new = np.append(True, line[1:] != line[:-1]) if len(line) else np.zeros(0, bool)
        self.start = np.flatnonzero(new)
        self.text = text[self.start]
        before = np.searchsorted(breaks, offsets[:-1])
        self.line = np.searchsorted(breaks, first[self.start]) - before[self.text]
        self.size = np.diff(np.append(self.start, len(words)))
        with np.errstate(over="ignore"):
            pair = mix(words * np.uint64(3) + np.append(words[1:], np.uint64(0)))
        last = np.append(line[1:] != line[:-1], True) if len(line) else new
        self.word, self.pair, self.has_pair = words, pair, ~last

    def feature_slots(self) -> tuple[np.ndarray, np.ndarray]:
        size = np.uint64(FEATURES - 1)
        return (self.word % size).astype(np.int64), np.where(self.has_pair, (self.pair % size).astype(np.int64), FEATURES - 1)

    def logits(self, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
        """Rows of paragraphs; the last feature slot (no pair) weighs nothing."""
        if not len(self.start):
            return np.zeros((0, len(bias)))
        word, pair = self.feature_slots()
        total = np.add.reduceat(weights[word] + weights[pair], self.start, axis=0)
        return total / np.sqrt(2.0 * self.size)[:, None] + bias

    def pairs(self, i: int) -> np.ndarray:
        """Word pairs of a paragraph (the word itself, if it has one only)."""
        a, n = self.start[i], self.size[i]
        return self.pair[a : a + n - 1] if n > 1 else self.word[a : a + 1]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _cuts(sentence: str, rng: np.random.Generator, n: int) -> list[str]:
    """The sentence, and runs of at least two thirds of its words with a word of noise at times."""
    words, out = sentence.split(), [sentence] * max(1, n // 4)
    while len(out) < n:
        size = int(rng.integers(max(1, (2 * len(words) + 2) // 3), len(words) + 1))
        at = int(rng.integers(0, len(words) - size + 1))
        part = words[at : at + size]
        if size > 3 and rng.random() < 0.3:
            part[int(rng.integers(0, size))] = "x" + str(int(rng.integers(0, 99)))
        out.append(" ".join(part))
    return out


def train(ordinary: list[str], seed: int = 7, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """(weights, bias, least probability that counts as known)."""
    rng = np.random.default_rng(seed)
    texts, y = [], []
    for f, name in enumerate(FAMILIES[:-1]):
        for sentence in TEMPLATES[name]:
            texts += (own := _cuts(sentence, rng, 40))
            y += [f] * len(own)
    single = sorted({w for s in TEMPLATES.values() for t in s for w in t.split()})
    noisy = [" ".join([*p.split(" ")[:40], *rng.choice(single, 3)]) for p in ordinary[: len(ordinary) // 2]]
    plain = [*ordinary, *noisy, *single]
    texts += plain
    y = np.array(y + [len(FAMILIES) - 1] * len(plain))
    rows = Paragraphs(pa.array([t.replace("\n", " ") for t in texts]))
    y = y[rows.text]
    fold = rng.random(len(y)) < 0.8
    weights, bias = np.zeros((FEATURES, len(FAMILIES))), np.zeros(len(FAMILIES))
    word, pair = rows.feature_slots()
    owner = np.repeat(np.arange(len(rows.start)), rows.size)
    scale = 1 / np.sqrt(2.0 * rows.size)
    goal = np.eye(len(FAMILIES))[y]
    count = np.bincount(y[fold], minlength=len(FAMILIES)) + 1
    importance = np.where(fold, len(y) / len(FAMILIES) / count[y], 0.0)
    memory = np.full_like(weights, 1e-8)
    for _ in range(rounds):
        error = (softmax(rows.logits(weights, bias)) - goal) * importance[:, None] / len(y)
        part = (error * scale[:, None])[owner]
        grad = np.stack([np.bincount(word, part[:, k], FEATURES) + np.bincount(pair, part[:, k], FEATURES) for k in range(len(FAMILIES))], axis=1)
        grad += 1e-6 * weights
        memory += grad**2
        weights -= 0.5 * grad / np.sqrt(memory)
        weights[FEATURES - 1] = 0
        bias -= 0.5 * error.sum(axis=0)
    known = 1 - softmax(rows.logits(weights, bias))[:, -1]
    out = known[~fold & (y == len(FAMILIES) - 1)]
    least = float(np.quantile(out, 1 - FALSE_KNOWN)) if len(out) else 0.5
    return weights.astype(np.float32), bias, min(max(least, 0.5), 0.95)


def template_pairs() -> list[list[np.ndarray]]:
    out = []
    for name in FAMILIES[:-1]:
        rows = Paragraphs(pa.array(list(TEMPLATES[name])))
        out.append([np.unique(rows.pairs(i)) for i in range(len(rows.start))])
    return out


def confirmed(pairs: np.ndarray, templates: list[np.ndarray]) -> bool:
    own = np.unique(pairs)
    for t in templates:
        shared = len(np.intersect1d(own, t, assume_unique=True))
        if shared >= CONFIRMED * len(own) or shared >= CONFIRMED * len(t) and shared > 1:
            return True
    return False


def ordinary_paragraphs(docs: DataFrame, size: int = SAMPLE) -> list[str]:
    """Lines of the corpus in the order of a hash; those that look like a template are left out."""
    lines = texts_of(docs).select(F.explode(F.split("text", "\n")).alias("line")).where(F.length("line").between(20, 2000))
    rows = lines.orderBy(F.xxhash64("line"), "line").limit(size).collect()
    templates = [t for own in template_pairs() for t in own]
    found = [r.line for r in rows]
    parts = Paragraphs(pa.array(found, pa.string()))
    bad = {int(parts.text[i]) for i in range(len(parts.start)) if confirmed(parts.pairs(i), templates)}
    return [t for i, t in enumerate(found) if i not in bad]


def scan(docs: DataFrame, size: int = SAMPLE) -> DataFrame:
    """One row per document: paragraphs, predicted and confirmed licence paragraphs, families, and family:line of each."""
    weights, bias, least = train(ordinary_paragraphs(docs, size))

    def find(batches):
        templates = template_pairs()
        for whole in batches:
            for batch in steps(whole):
                n = batch.num_rows
                rows = Paragraphs(batch.column("text"))
                p = softmax(rows.logits(weights, bias))
                best, known = p[:, :-1].argmax(axis=1), np.flatnonzero(1 - p[:, -1] >= least)
                predicted, places = np.zeros(n, np.int64), [[] for _ in range(n)]
                for i in known.tolist():
                    predicted[rows.text[i]] += 1
                    if confirmed(rows.pairs(i), templates[best[i]]):
                        places[rows.text[i]].append((FAMILIES[best[i]], int(rows.line[i])))
                yield pa.record_batch(
                    [batch.column("doc_id"), pa.array(np.bincount(rows.text, minlength=n)), pa.array(predicted),
                     pa.array([len(x) for x in places], pa.int64()), pa.array([",".join(sorted({f for f, _ in x})) for x in places]),
                     pa.array([",".join(f"{f}:{a}" for f, a in x) for x in places])],
                    names=["doc_id", "n_paragraphs", "n_predicted", "n_licences", "families", "places"],
                )

    named = texts_of(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id")
    return named.mapInArrow(find, "doc_id long, n_paragraphs long, n_predicted long, n_licences long, families string, places string")


def op4_licences(spark, folder: str) -> DataFrame:
    return scan(spark.read.parquet(f"{folder}/documents.parquet"))
