import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fablake.llm import textscan as ts
from fablake.llm import toxicity as tx

from .conftest import CLASHES, prose

BAD = ["grolmish", "vextroon", "plaguth", "zwerk"]


def document(seed, toxic):
    r = random.Random(seed)
    sentences = [prose(seed * 50 + k, r.randint(4, 12)).replace(".", "") for k in range(r.randint(1, 12))]
    if toxic:
        for k in r.sample(range(len(sentences)), min(len(sentences), r.randint(1, 2))):
            words = sentences[k].split(" ")
            for _ in range(2):
                words.insert(r.randrange(len(words)), r.choice(BAD) + r.choice(["", "ed", "Ing"]))
            sentences[k] = " ".join(words)
    return ". ".join(sentences) + ".", toxic


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, *document(i, i % 4 == 0)) for i in range(1200)]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t, _ in rows], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, 1, int(y)) for i, _, y in rows], "doc_id long, quality int, toxic int")
    return rows, docs, labels


@pytest.fixture(scope="module")
def model(corpus):
    return tx.fit(corpus[1], corpus[2])


def test_held_out_documents(corpus, model):
    rows, docs, _ = corpus
    score = {r.doc_id: r.score for r in tx.score(docs, model).collect()}
    held = [(i, y) for i, _, y in rows if tx.held_out(i)]
    assert len(held) > 150
    assert np.mean([score[i] >= 0.5 for i, y in held if y]) > 0.97
    assert np.mean([score[i] >= 0.5 for i, y in held if not y]) < 0.02


def test_sentences_are_located(corpus, model):
    rows, docs, _ = corpus
    text = {i: t for i, t, _ in rows}
    found = tx.locate(docs, model).collect()
    assert all(text[r.doc_id][r.start: r.start + r.length] == r.sentence for r in found)
    assert np.mean([any(b in r.sentence for b in BAD) for r in found]) > 0.97
    assert {r.doc_id for r in found} >= {i for i, _, y in rows if y and i % 5 == 1}
    worst = tx.score(docs, model).filter("score >= 0.5").collect()
    assert np.mean([any(b in text[r.doc_id][r.worst_start: r.worst_start + r.worst_length] for b in BAD) for r in worst]) > 0.97


def brute_score(text, model):
    """Word by word; the library's hash of single words stands for the keys."""
    weights = dict(zip(model.keys.tolist(), model.weights))
    letter = lambda b: 65 <= b <= 90 or 97 <= b <= 122 or b >= 128
    data = (text or "").encode()
    sentences, words, word, stopped = [], [], b"", False
    for b in data + b" ":
        if letter(b):
            if not word and stopped and words:
                sentences.append(words)
                words = []
            stopped = stopped and bool(word)
            word += bytes([b])
        else:
            if word:
                words.append(word)
                stopped = False
            word = b""
            stopped = stopped or b in b".!?\n"
    if words:
        sentences.append(words)
    clear = 1.0
    count = 0
    for words in sentences:
        for k in range(0, len(words), tx.SENTENCE_WORDS):
            z = model.bias
            for w in words[k: k + tx.SENTENCE_WORDS]:
                scan = ts.Scan(0, np.frombuffer(w, np.uint8), np.array([0, len(w)]))
                pieces = [(0, len(w)), *((j + 1, n) for j, n in enumerate(tx.STEMS) if len(w) > n)]
                for kind, n in pieces:
                    key = ts.mix(scan.hashes(np.array([0]), np.array([n]), lower=True) ^ tx._KIND[kind])[0]
                    z += weights.get(int(key), 0.0)
            count += 1
            clear *= 1 / (1 + np.exp(z))
    return 1 - clear, count


def test_scores_equal_brute_force(spark, odd, odd_rows, model, corpus):
    some = corpus[0][:60]
    docs = spark.createDataFrame([(i, t) for i, t, _ in some], "doc_id long, text string")
    for df, rows in ((docs, [(i, t) for i, t, _ in some]), (odd, [(r[0], r[1]) for r in odd_rows if len(r[1] or "") < 20000])):
        got = sorted((r.doc_id is None, r.doc_id or 0, r.n_sentences, round(r.score, 9)) for r in tx.score(df, model).collect())
        want = sorted((i is None, i or 0, n, round(float(s), 9)) for i, t in rows for s, n in [brute_score(t, model)])
        assert [g for g in got if g in want] == want and (len(got) == len(want) or df is odd)


def test_odd_rows_and_empty_tables(spark, odd, odd_rows, empty, model, corpus):
    out = tx.score(odd, model).collect()
    assert len(out) == len(odd_rows) and all(0 <= r.score <= 1 for r in out)
    assert all(r.score == 0 and r.worst_start is None for r in out if r.doc_id in (7, 8, 9))
    assert tx.score(empty, model).collect() == [] and tx.locate(empty, model).collect() == []
    labels = spark.createDataFrame([(1, 1, None), (2, 1, 1), (2, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for none in (tx.fit(odd, labels), tx.fit(empty, corpus[2]), tx.fit(odd, corpus[2].limit(0))):
        assert len(none.keys) == 0 and all(r.score < 0.5 for r in tx.score(odd, none).collect())


def test_only_texts_and_usable_labels_matter(spark, corpus, model):
    rows, docs, labels = corpus
    more = docs.withColumns({c: F.lit("x") for c in CLASHES}).withColumns({c: F.lit("toxic") for c in ("lang", "source", "toxic", "score")})
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = tx.fit(more, flipped.repartition(5))
    assert (again.keys == model.keys).all() and np.allclose(again.weights, model.weights) and again.bias == pytest.approx(model.bias)
    assert tx.held_out(10) == (zlib.crc32(b"10") % 5 == 0) and not tx.held_out(None)


def test_query_columns(spark, corpus, tmp_path):
    rows, docs, labels = corpus
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    out = tx.op13_toxicity(spark, str(tmp_path))
    assert out.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    got = out.collect()
    assert len(got) == len(rows) and all(r.held_out == tx.held_out(r.doc_id) and r.predicted == int(r.score >= 0.5) for r in got)
