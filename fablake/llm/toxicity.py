"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence's score is ``sigmoid(bias + sum of its words' evidence)``; a document's
is the noisy-or of its sentences, ``1 - prod(1 - s)``, so one toxic sentence is enough and document labels train the
sentence scores.  The scores then say which sentences made a document toxic (``locate``).

Evidence is kept for whole words (letters and everything beyond ASCII, A-Z lower-cased) and for their first 3 to 8 bytes,
which stand for word stems.  It is never negative: clean words cannot hide a toxic one, and a sentence without evidence scores
``sigmoid(bias)``.  Keys are 64-bit hashes looked up whole, not folded into buckets, so a larger corpus brings no collisions
into the model.

Fitting reads a bounded sample: the ``FIT_ROWS`` labelled doc_ids with the smallest hash, texts up to ``FIT_BYTES``; it
keeps at most ``MAX_KEYS`` keys, those that most set toxic documents apart.  Scoring reads every whole text.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fablake.llm import textscan as ts
from fablake.llm.common import kept, table

FIT_ROWS, FIT_BYTES, MAX_KEYS = 20_000, 200_000, 20_000
#: A key needs so many toxic documents, and its share among them so many times that among the others.
LEAST_DOCUMENTS, LEAST_RATIO = 3, 4.0
STEMS = (3, 4, 5, 6, 8)
ROUNDS, STEP, DECAY = 400, 0.3, 2e-4
FOLDS, HELD_OUT = 5, 0
#: A sentence of more words counts as several.
SENTENCE_WORDS = 64

U64 = np.uint64
_KIND = ts.stream(13, len(STEMS) + 1)
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0x80:] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?\n")] = True
_FILTER_BITS = 20


@dataclass
class Model:
    """Sorted 64-bit keys, their evidence, and the bias."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float


class Sentences:
    """Words, keys and sentences of a scan.

    ``word_at``: first word of each sentence plus the total; ``text``: each sentence's text; ``begin``, ``end``: its bytes,
    first word's begin to last word's end.  Sentences end at ``.``, ``!``, ``?`` or a line feed and have at least one word.
    """

    def __init__(self, scan: ts.Scan):
        self.begin, self.end = scan._spans(_LETTER[scan.data])
        n = len(self.begin)
        stops = np.zeros(len(scan.data) + 1, np.int64)
        np.cumsum(_STOP[scan.data], out=stops[1:])
        text = np.searchsorted(scan.bounds, self.begin, "right") - 1
        new = np.ones(n, bool)
        new[1:] = (stops[self.begin[1:]] > stops[self.end[:-1]]) | (text[1:] != text[:-1])
        at = np.flatnonzero(new)
        inside = np.arange(n) - np.repeat(at, np.diff(np.append(at, n)))
        new |= (inside > 0) & (inside % SENTENCE_WORDS == 0)
        first = np.flatnonzero(new)
        self.word_at = np.append(first, n)
        self.text = text[first]
        self.sentence = np.cumsum(new) - 1  # of each word
        self.scan = scan

    def keys(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(words, their keys), for whole words and each length of stem; a word as short as the stem has none."""
        yield np.arange(len(self.begin)), ts.mix(self.scan.hashes(self.begin, self.end, lower=True) ^ _KIND[0])
        for k, length in enumerate(STEMS):
            of = np.flatnonzero(self.end - self.begin > length)
            yield of, ts.mix(self.scan.hashes(self.begin[of], self.begin[of] + length, lower=True) ^ _KIND[k + 1])


def _member(keys: np.ndarray) -> Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """hits(values): (positions of the values that are in the sorted ``keys``, their index there)."""
    maybe = np.zeros(1 << _FILTER_BITS, bool)
    maybe[(keys & U64((1 << _FILTER_BITS) - 1)).astype(np.int64)] = True

    def hits(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(maybe[(values & U64((1 << _FILTER_BITS) - 1)).astype(np.int64)])
        if not len(at) or not len(keys):
            return at[:0], at[:0]
        index = np.minimum(np.searchsorted(keys, values[at]), len(keys) - 1)
        same = keys[index] == values[at]
        return at[same], index[same]

    return hits


# ---- fitting

_COUNTS = pa.schema([("key", pa.int64()), ("toxic", pa.int64()), ("clean", pa.int64())])


def _key_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, text) -> for each key, the number of toxic and of clean texts that have it, run of texts by run of texts."""
    for batch in batches:
        toxic = batch.column(0).to_numpy(zero_copy_only=False).astype(bool)
        for scan in ts.scans(batch):
            s = Sentences(scan)
            text = s.text[s.sentence]
            found = [(keys, text[of]) for of, keys in s.keys()]
            keys, of = np.concatenate([k for k, _ in found]), np.concatenate([t for _, t in found])
            order = np.lexsort((of, keys))
            keys, of = keys[order], of[order]
            new_key = np.ones(len(keys), bool)
            new_key[1:] = keys[1:] != keys[:-1]
            first = new_key.copy()
            first[1:] |= of[1:] != of[:-1]
            at = np.flatnonzero(new_key)
            if not len(at):
                continue
            mark = toxic[scan.first + of]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[at].view(np.int64)), pa.array(np.add.reduceat((first & mark).astype(np.int64), at)),
                 pa.array(np.add.reduceat((first & ~mark).astype(np.int64), at))], schema=_COUNTS)


_BAGS = pa.schema([("toxic", pa.bool_()), ("sentences", pa.int64()), ("sentence", pa.binary()), ("index", pa.binary())])


def _bags(keys: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(toxic, text) -> number of sentences, and (sentence, index of a key) for each known key, as little-endian 32-bit."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = _member(keys)
        for batch in batches:
            for scan in ts.scans(batch):
                s = Sentences(scan)
                found = [(s.sentence[of[at]], index) for of, values in s.keys() for at, index in [hits(values)]]
                sentence, index = np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])
                order = np.argsort(sentence, kind="stable")
                sentence, index = sentence[order], index[order]
                heads = np.searchsorted(s.text, np.arange(scan.rows + 1))
                cut = np.searchsorted(sentence, heads)
                toxic = batch.column(0).slice(scan.first, scan.rows)
                yield pa.RecordBatch.from_arrays(
                    [toxic, pa.array(np.diff(heads)),
                     pa.array([(sentence[a:b] - h).astype("<u4").tobytes() for a, b, h in zip(cut, cut[1:], heads)], pa.binary()),
                     pa.array([index[a:b].astype("<u4").tobytes() for a, b in zip(cut, cut[1:])], pa.binary())], schema=_BAGS)

    return run


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def learn(toxic: np.ndarray, sentences: np.ndarray, bag: np.ndarray, sentence: np.ndarray, index: np.ndarray,
          start: np.ndarray) -> tuple[np.ndarray, float]:
    """(evidence, bias) that make the documents' labels likeliest under noisy-or, by projected adaptive gradient steps.

    ``bag``, ``sentence``, ``index``: one entry for each known key; sentences without an entry score sigmoid(bias).
    Toxic and clean documents weigh the same in total."""
    n = len(toxic)
    ident = bag.astype(np.int64) * (int(sentence.max(initial=0)) + 1) + sentence
    told, of = np.unique(ident, return_inverse=True)
    bag_of = np.zeros(len(told), np.int64)
    bag_of[of] = bag
    plain = sentences - np.bincount(bag_of, minlength=n)
    share = np.where(toxic, 0.5 / max(toxic.sum(), 1), 0.5 / max((~toxic).sum(), 1)) * n
    w, b = start.astype(float).copy(), -6.0
    square_w, square_b = np.full(len(w), 1e-8), 1e-8
    for _ in range(ROUNDS):
        z = b + np.bincount(of, w[index], minlength=len(told))
        clear = np.bincount(bag_of, _softplus(z), minlength=n) + plain * _softplus(b)  # -log of the chance of no toxic sentence
        pull = np.where(toxic, 1.0 / np.expm1(np.clip(clear, 1e-9, 500)), -1.0) * share  # of s in each sentence
        by_sentence = pull[bag_of] / (1 + np.exp(-z))
        grad_b = by_sentence.sum() + (pull * plain).sum() / (1 + np.exp(-b))
        grad_w = np.bincount(index, by_sentence[of], minlength=len(w)) - DECAY * n * w
        square_w += grad_w ** 2
        square_b += grad_b ** 2
        w = np.maximum(w + STEP * grad_w / np.sqrt(square_w), 0.0)
        b = min(b + STEP * grad_b / np.sqrt(square_b), -2.0)
    return w, float(b)


def usable_labels(labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, toxic boolean) of at most ``fit_rows`` labelled ids outside the held-out fold.  Null and contradicting
    labels are not used."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    marks = marks.filter("doc_id is not null and toxic is not null").filter(
        F.crc32(F.col("doc_id").cast("string")) % FOLDS != HELD_OUT)
    marks = marks.groupBy("doc_id").agg(F.min("toxic").alias("least"), F.max("toxic").alias("most")).filter("least = most")
    return marks.select("doc_id", (F.col("least") == 1).alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)


def fit(documents: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """The model; without toxic or without clean examples, one without evidence."""
    marks = kept(usable_labels(labels, fit_rows), "toxic-labels")
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    texts = texts.filter(F.octet_length("text") <= FIT_BYTES).join(F.broadcast(marks), "doc_id")  # fit_rows bounds it
    sample = kept(texts.select("toxic", "text"), "toxic-sample")
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n_toxic, n_clean = sizes.get(True, 0), sizes.get(False, 0)
    if not n_toxic or not n_clean:
        return Model(np.zeros(0, U64), np.zeros(0), -12.0)
    counts = sample.mapInArrow(_key_counts, "key long, toxic long, clean long").groupBy("key").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    ratio = (F.col("toxic") + 0.1) / (n_toxic + 0.1) / ((F.col("clean") + 0.1) / (n_clean + 0.1))
    best = counts.filter(F.col("toxic") >= LEAST_DOCUMENTS).withColumn("odds", F.log(ratio)).filter(
        F.col("odds") >= float(np.log(LEAST_RATIO))).orderBy((F.col("toxic") * F.col("odds")).desc(), "key").limit(MAX_KEYS).toPandas()
    best["key"] = best["key"].to_numpy(np.int64).view(U64)
    best = best.sort_values("key")
    keys, odds = best["key"].to_numpy(U64), best["odds"].to_numpy(float)
    bags = sample.mapInArrow(_bags(keys), "toxic boolean, sentences long, sentence binary, index binary").toPandas()
    # a fixed order, so that the same rows give the same sums
    bags = bags.sort_values(["toxic", "sentences", "sentence", "index"]).reset_index(drop=True)
    entries = [np.frombuffer(x, "<u4") for x in bags["index"]]
    weights, bias = learn(
        bags["toxic"].to_numpy(bool), bags["sentences"].to_numpy(np.int64), np.repeat(np.arange(len(bags)), [len(x) for x in entries]),
        np.concatenate([np.frombuffer(x, "<u4") for x in bags["sentence"]]).astype(np.int64),
        np.concatenate(entries).astype(np.int64), np.clip(odds / 2, 0, 4))
    used = weights > 1e-6
    return Model(keys[used], weights[used], bias)


# ---- scoring

SCORES = ("doc_id long, score double, n_sentences long, n_toxic_sentences long, worst_start long, worst_length long, worst_score double")
_SCORES = pa.schema([(c.split()[0], pa.float64() if c.endswith("double") else pa.int64()) for c in SCORES.split(", ")])
_FOUND = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("score", pa.float64()),
                    ("sentence", pa.large_string())])


def _sentence_scores(s: Sentences, hits: Callable, model: Model) -> np.ndarray:
    z = np.full(len(s.word_at) - 1, model.bias)
    for of, values in s.keys():
        at, index = hits(values)
        z += np.bincount(s.sentence[of[at]], model.weights[index], minlength=len(z))
    return z


def _score(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = _member(model.keys)
        for batch in batches:
            ids = batch.column(0).cast(pa.int64())
            for scan in ts.scans(batch):
                s = Sentences(scan)
                z = _sentence_scores(s, hits, model)
                heads = np.searchsorted(s.text, np.arange(scan.rows + 1))
                clear = np.zeros(len(z) + 1)
                np.cumsum(_softplus(z), out=clear[1:])
                score = -np.expm1(clear[heads[:-1]] - clear[heads[1:]])
                some = np.diff(heads) > 0
                worst = np.zeros(scan.rows, np.int64)
                if len(z):  # the first of the highest, text by text
                    order = np.lexsort((np.arange(len(z)), -z, s.text))
                    worst[some] = order[heads[:-1][some]]
                chars = np.zeros(len(scan.data) + 1, np.int64)
                np.cumsum((scan.data & 0xC0) != 0x80, out=chars[1:])
                begin, end = _extent(s, worst) if len(z) else (np.zeros(scan.rows, np.int64),) * 2
                where = lambda x: pa.array(np.where(some, x, 0), mask=~some)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(scan.first, scan.rows), pa.array(np.clip(score, 0.0, 1.0)), pa.array(np.diff(heads)),
                     pa.array(np.bincount(s.text[z >= 0], minlength=scan.rows)), where(chars[begin] - chars[scan.bounds[:-1]]),
                     where(chars[end] - chars[begin]), where(1 / (1 + np.exp(-z[worst])) if len(z) else 0.0)], schema=_SCORES)

    return run


def _extent(s: Sentences, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begin, end) of these sentences in bytes: first word's begin, last word's end."""
    return s.begin[s.word_at[which]], s.end[s.word_at[which + 1] - 1]


def score(documents: DataFrame, model: Model) -> DataFrame:
    """One row for each row of ``documents`` (doc_id, text): doc_id, score (0 to 1; 0 without a word), n_sentences,
    n_toxic_sentences (score 0.5 or more), and start, length (code points, from the text's first) and score of the worst sentence,
    the first of equals; null without a word.

    Rows that repeat a doc_id, or have none, are scored each by itself; null, empty and blank texts score 0; a text
    is read whole, however long.  Other columns are ignored, so lang, source and labels cannot enter a score.
    """
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(_score(model), SCORES)


def _locate(model: Model, least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    bound = float(np.log(least) - np.log1p(-least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = _member(model.keys)
        for batch in batches:
            ids = batch.column(0).cast(pa.int64())
            for scan in ts.scans(batch):
                s = Sentences(scan)
                z = _sentence_scores(s, hits, model)
                which = np.flatnonzero(z >= bound)
                if not len(which):
                    continue
                chars = np.zeros(len(scan.data) + 1, np.int64)
                np.cumsum((scan.data & 0xC0) != 0x80, out=chars[1:])
                text, (begin, end) = s.text[which], _extent(s, which)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(scan.first + text)), pa.array(text.astype(np.int64)), pa.array(chars[begin] - chars[scan.bounds[text]]),
                     pa.array(chars[end] - chars[begin]), pa.array(1 / (1 + np.exp(-z[which]))),
                     pa.array([scan.data[a:b].tobytes().decode() for a, b in zip(begin, end)], pa.large_string())], schema=_FOUND)

    return run


def locate(documents: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """(doc_id, start, length, score, sentence) of every sentence that scores ``least`` or more (between 0 and 1)."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return docs.mapInArrow(_locate(model, least), "doc_id long, row long, start long, length long, score double, sentence string").drop("row")


def held_out(doc_id: int | None) -> bool:
    """Whether labels of this document are kept from fitting; as ``op13_toxicity`` computes it."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == HELD_OUT


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = fit(documents, table(spark, sf_dir, "labels"))
    return score(documents, model).select(
        "doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD_OUT, F.lit(False)).alias("held_out"),
        "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
        "n_sentences", "n_toxic_sentences", "worst_start", "worst_length", "worst_score")
