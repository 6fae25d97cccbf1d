"""License scans: a trained paragraph classifier, confirmed by comparison with templates.

A paragraph (up to a blank line, cut into overlapping windows of ``SPAN`` words) is a sparse vector of
hashed word 1- and 2-grams.  A multinomial logistic regression over the licence families and one class
``unknown`` scores it.  It is trained here: positives are the templates below with words dropped and with
words of the corpus around them, unknown ones are paragraphs of the corpus.  A temperature, fitted on
examples that training did not see, calibrates the probabilities, the unknown class among them.

A window is a finding if its family is at least as probable as ``CERTAIN`` and the window holds at least
``LEAST_SHARE`` of the word pairs of one of that family's templates; without that it counts as
unconfirmed.

Training reads at most ``FIT_ROWS`` documents; scanning reads every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fablake.llm import textscan as ts
from fablake.llm.common import table

FIT_ROWS = 2_000
SPAN, STEP = 40, 20
BUCKETS = 1 << 16
CERTAIN, LEAST_SHARE = 0.5, 0.6
UNKNOWN = "unknown"

# fixed values: notices and opening words of well-known licences, by family
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "mit": [
        "Released under the MIT License.",
        "This project is licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "lgpl": [
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "agpl": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "cc0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Released under CC0 1.0 Universal.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "Licensed under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "SPDX-License-Identifier: Unlicense",
    ],
    "proprietary": [
        "All rights reserved. Unauthorized copying of this file, via any medium, is strictly prohibited.",
        "Proprietary and confidential. Do not distribute without written permission.",
    ],
}
FAMILIES = [UNKNOWN, *TEMPLATES]

_U64 = np.uint64
_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[128:] = True
for _a, _b in (("0", "9"), ("A", "Z"), ("a", "z")):
    _WORD_BYTE[ord(_a): ord(_b) + 1] = True
_PAIR = ts.stream(21, 2)


def _words(scan: ts.Scan) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, begins, ends, first word of each text plus the total): letters and digits, A-Z folded."""
    begin, end = scan._spans(_WORD_BYTE[scan.data])
    return scan.hashes(begin, end, lower=True), begin, end, np.searchsorted(begin, scan.bounds)


def _hash_text(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return _words(ts.Scan(0, data, np.array([0, len(data)])))[0]


def _pairs(words: np.ndarray) -> np.ndarray:
    return ts.mix(words[:-1] * _PAIR[0] + words[1:] * _PAIR[1])


def _buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes & _U64(BUCKETS - 1)).astype(np.int64)


def _template_buckets() -> np.ndarray:
    """Which buckets a 1- or 2-gram of the templates falls into; the others carry no weight."""
    out = np.zeros(BUCKETS, bool)
    for words in (_hash_text(t) for texts in TEMPLATES.values() for t in texts):
        out[_buckets(words)] = out[_buckets(_pairs(words))] = True
    return out


def _features(words: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, float]:
    """Buckets of the 1- and 2-grams that carry weight, and the norm of all of them, which divides their sum."""
    found = np.concatenate([_buckets(words), _buckets(_pairs(words))]) if len(words) else np.zeros(0, np.int64)
    return found[use[found]], float(np.sqrt(max(len(found), 1)))


class Classifier:
    def __init__(self, weights: np.ndarray, bias: np.ndarray, temperature: float):
        self.weights, self.bias, self.temperature = weights, bias, temperature


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _examples(corpus: list[np.ndarray], rng: np.random.Generator, each: int) -> tuple[list[np.ndarray], list[int]]:
    """Windows of corpus words as unknown; templates with words dropped and corpus words around them."""
    pool = np.concatenate(corpus) if corpus else np.zeros(0, _U64)
    marks = np.unique(np.concatenate([_pairs(_hash_text(t)) for texts in TEMPLATES.values() for t in texts]))
    marked = np.concatenate([[0], np.cumsum(np.isin(_pairs(pool), marks) if len(pool) > 1 else pool[:0])])

    def around(n: int) -> np.ndarray:
        """n corpus words in a row without a notice among them."""
        at = int(rng.integers(0, max(1, len(pool) - n)))
        notice = len(pool) > at + n and marked[max(at, at + n - 1)] - marked[at] > 1
        return pool[:0] if notice else pool[at: at + n]

    x, y = [], []
    for k, texts in enumerate(TEMPLATES.values(), 1):
        for text in texts:
            words = _hash_text(text)
            for _ in range(each):
                own = words[rng.random(len(words)) > 0.08] if rng.random() < 0.5 else words
                if not len(own):
                    continue
                room = max(0, SPAN - len(own))
                left = int(rng.integers(0, room + 1)) if rng.random() < 0.7 else 0
                right = int(rng.integers(0, room - left + 1)) if rng.random() < 0.7 else 0
                x.append(np.concatenate([around(left), own, around(right)]))
                y.append(k)
    # common licence words outside a notice are unknown, too
    loose = np.unique(np.concatenate([_hash_text(t) for texts in TEMPLATES.values() for t in texts]))
    for _ in range(8 * each * len(TEMPLATES)):
        piece = around(int(rng.integers(1, SPAN + 1)))
        if rng.random() < 0.3:
            extra = rng.choice(loose, int(rng.integers(1, 4)))
            piece = np.concatenate([piece[: len(piece) // 2], extra, piece[len(piece) // 2:]])
        if len(piece):
            x.append(piece)
            y.append(0)
    return x, y


def train(corpus: list[np.ndarray], seed: int = 5, each: int = 24, rounds: int = 20) -> Classifier:
    """Multinomial logistic regression by Adagrad over sparse rows, then one temperature on held-out rows."""
    rng = np.random.default_rng(seed)
    x, y = _examples(corpus, rng, each)
    use_bucket = _template_buckets()
    rows = [_features(w, use_bucket) for w in x]
    y = np.asarray(y)
    held = rng.random(len(y)) < 0.2
    k = len(FAMILIES)
    w, b = np.zeros((BUCKETS, k)), np.zeros(k)
    gw, gb = np.full((BUCKETS, k), 1e-2), np.full(k, 1e-2)
    use = np.flatnonzero(~held)
    for _ in range(rounds):
        for part in np.array_split(rng.permutation(use), max(1, len(use) // 256)):
            at = np.concatenate([rows[i][0] for i in part])
            row = np.repeat(np.arange(len(part)), [len(rows[i][0]) for i in part])
            scale = 1.0 / np.array([rows[i][1] for i in part])
            z = np.zeros((len(part), k))
            np.add.at(z, row, w[at])
            p = _softmax(z * scale[:, None] + b)
            p[np.arange(len(part)), y[part]] -= 1
            g = (p * scale[:, None])[row]
            touched, inverse = np.unique(at, return_inverse=True)
            grad = np.zeros((len(touched), k))
            np.add.at(grad, inverse, g)
            grad += 1e-3 * w[touched]
            gw[touched] += grad ** 2
            w[touched] -= 0.5 * grad / np.sqrt(gw[touched])
            gb += p.sum(axis=0) ** 2
            b -= 0.5 * p.sum(axis=0) / np.sqrt(gb)
    z = np.stack([w[rows[i][0]].sum(axis=0) / rows[i][1] + b for i in np.flatnonzero(held)])
    true = y[held]
    loss = lambda t: -np.log(np.maximum(_softmax(z / t)[np.arange(len(true)), true], 1e-12)).mean()
    temperature = min((0.25 * 1.15 ** i for i in range(24)), key=loss)
    return Classifier(w.astype(np.float32), b, float(temperature))


def _windows(begin: np.ndarray, end: np.ndarray, words_at: np.ndarray, scan: ts.Scan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, word after the last, text) of each window; a blank line or a text's end closes a paragraph."""
    n = len(begin)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    feeds = np.zeros(len(scan.data) + 1, np.int64)
    np.cumsum(scan.data == 0x0A, out=feeds[1:])
    opens = np.ones(n, bool)
    opens[1:] = feeds[begin[1:]] - feeds[end[:-1]] >= 2
    opens[words_at[:-1][np.diff(words_at) > 0]] = True
    first = np.flatnonzero(opens)
    size = np.diff(np.append(first, n))
    each = np.maximum(1, -(-(size - (SPAN - STEP)) // STEP))
    paragraph = np.repeat(np.arange(len(first)), each)
    nth = np.arange(len(paragraph)) - np.repeat(np.cumsum(each) - each, each)
    lo = first[paragraph] + nth * STEP
    hi = np.minimum(lo + SPAN, first[paragraph] + size[paragraph])
    return lo, hi, np.searchsorted(words_at, lo, "right") - 1


SCHEMA = "doc_id long, families array<string>, license string, confidence double, n_windows long, n_found long, n_unconfirmed long"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("families", pa.list_(pa.string())), ("license", pa.string()), ("confidence", pa.float64()),
                     ("n_windows", pa.int64()), ("n_found", pa.int64()), ("n_unconfirmed", pa.int64())])


def _scan(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Classifier = model.value
        marks = [[]] + [[np.unique(_pairs(_hash_text(t))) for t in texts] for texts in TEMPLATES.values()]
        k = len(FAMILIES)
        for batch in batches:
            ids = batch.column(0).cast(pa.int64())
            for scan in ts.scans(batch):
                words, begin, end, words_at = _words(scan)
                lo, hi, text = _windows(begin, end, words_at, scan)
                n_windows = np.bincount(text, minlength=scan.rows)
                best: list[dict[int, float]] = [{} for _ in range(scan.rows)]
                found, loose = np.zeros(scan.rows, np.int64), np.zeros(scan.rows, np.int64)
                if len(lo):
                    single = np.zeros((len(words) + 1, k))
                    np.cumsum(own.weights[_buckets(words)], axis=0, dtype=np.float64, out=single[1:])
                    double = np.zeros((len(words) + 1, k))
                    pairs = _pairs(words)
                    np.cumsum(own.weights[_buckets(pairs)], axis=0, dtype=np.float64, out=double[1: len(pairs) + 1])
                    score = single[hi] - single[lo] + double[hi - 1] - double[lo]
                    score = score / np.sqrt(2 * (hi - lo) - 1)[:, None] + own.bias
                    p = _softmax(score / own.temperature)
                    family = p.argmax(axis=1)
                    for i in np.flatnonzero((family > 0) & (p.max(axis=1) >= CERTAIN)):
                        f, t = int(family[i]), int(text[i])
                        has = pairs[lo[i]: hi[i] - 1]
                        if max(np.isin(m, has).mean() for m in marks[f]) >= LEAST_SHARE:
                            found[t] += 1
                            best[t][f] = max(best[t].get(f, 0.0), float(p[i, f]))
                        else:
                            loose[t] += 1
                first = [max(b, key=lambda f: (b[f], -f)) if b else None for b in best]
                yield pa.RecordBatch.from_arrays([
                    ids.slice(scan.first, scan.rows), pa.array([sorted(FAMILIES[f] for f in b) for b in best], pa.list_(pa.string())),
                    pa.array([FAMILIES[f] if f else UNKNOWN for f in first]),
                    pa.array([round(b[f], 6) if f else None for b, f in zip(best, first)], pa.float64()),
                    pa.array(n_windows.astype(np.int64)), pa.array(found), pa.array(loose)], schema=_SCHEMA)

    return run


def corpus_words(documents: DataFrame, fit_rows: int = FIT_ROWS) -> list[np.ndarray]:
    """Word hashes of at most ``fit_rows`` documents, those of smallest id hash, 400 words from each one's middle."""
    ids = documents.filter("text is not null").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    rows = documents.join(F.broadcast(ids.distinct().withColumnRenamed("doc_id", "_id")), F.col("doc_id") == F.col("_id"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).cast(pa.int64())
            for scan in ts.scans(batch):
                words, _, _, at = _words(scan)
                middle = [words[a + max(0, b - a - 400) // 2: b][:400].view(np.int64).tolist() for a, b in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays([own.slice(scan.first, scan.rows), pa.array(middle, pa.list_(pa.int64()))], names=["doc_id", "words"])

    got = rows.select("doc_id", "text").mapInArrow(hashed, "doc_id long, words array<long>").toPandas()
    got = got.drop_duplicates("doc_id").sort_values("doc_id")
    return [np.asarray(w, np.int64).view(_U64) for w in got["words"]]


def scan_licenses(documents: DataFrame, model: Classifier) -> DataFrame:
    """One row for each row of ``documents`` (doc_id, text): families (confirmed, in alphabetical order), license
    (the most probable of them, ``unknown`` if none; ties: first in the list of families), confidence (its
    probability, null if none), n_windows, n_found, n_unconfirmed.  A null, empty or wordless text has no window.
    Other columns are ignored."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scan(shared), SCHEMA)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan_licenses(documents, train(corpus_words(documents)))
