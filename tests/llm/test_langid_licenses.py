import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fablake.llm import langid as li
from fablake.llm import licenses as lc

from .conftest import prose

BASE = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{BASE}/documents.parquet")


@pytest.fixture(scope="module")
def model(documents):
    return li.fit(documents.filter("doc_id % 2 = 0"), 4000)


def test_text_model_on_held_out_documents(documents, model):
    out = li.identify(li.document_rows(documents.filter("doc_id % 2 = 1").withColumn("lang", F.lit(None).cast("string"))), model)
    truth = documents.select("doc_id", F.col("lang").alias("truth"))
    got = out.join(truth, "doc_id").filter("text_lang is not null").select("text_lang", "lang", "truth").toPandas()
    assert (got.text_lang == got.truth).mean() > 0.98 and (got.lang == got.truth).mean() > 0.98


def test_pages(spark, model):
    pages = spark.read.parquet(f"{BASE}/pages.parquet")
    out = li.identify(li.page_rows(pages), model).toPandas()
    assert len(out) == pages.count() and (out.lang == out.declared).mean() > 0.97 and out.probability.between(0, 1).all()


def brute_fuse(rows, model):
    """The same sums over plain lists."""
    langs, k = model.languages, len(model.languages)

    def text_scores(text):
        data = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode()
        code = [((((a << 16) | (b << 8) | c) * 2654435761) & 0xFFFFFFFF) >> 16 for a, b, c in zip(data, data[1:], data[2:])]
        total = sum((model.table[x] for x in code), np.zeros(k)) / math.sqrt(max(len(code), 1))
        return total - total.max(), int(total.argmax()) if len(code) >= li.LEAST_TRIGRAMS else None

    scored = [(r, *text_scores(r["text"])) for r in rows]
    count = lambda keep: np.array([sum(b == j for r, _, b in scored if keep(r)) for j in range(k)], float)
    everything = count(lambda r: True)
    levels = lambda h: [h.split(".")[-1], ".".join(h.split(".")[-2:]), h]
    out = []
    for r, s, b in scored:
        p = (everything + 1) / (everything.sum() + k)
        if r["host"] is not None:
            mine = levels(r["host"])
            for d in range(3):
                n = count(lambda q: q["host"] is not None and levels(q["host"])[: d + 1] == mine[: d + 1])
                p = (n + li.SMOOTH * p) / (n.sum() + li.SMOOTH)
        z = s + np.log(p)
        for c in ("declared", "address"):
            if r[c] is not None:
                same = [q for q in rows if q[c] == r[c]]
                share = (len(same) + 1) / (len(rows) + 1)
                z = z + np.log((count(lambda q: q[c] == r[c]) + li.SMOOTH * share) / (everything + li.SMOOTH))
        e = np.exp(z - z.max())
        out.append((r["doc_id"], r["page_id"], None if b is None else langs[b], langs[int(z.argmax())], round(float(e.max() / e.sum()), 6)))
    return Counter(out)


def test_fusion_against_brute_force(spark, documents, model):
    texts = [r.text[:300] for r in documents.filter("length(text) > 100").orderBy("doc_id").limit(40).collect()]
    hosts = ["a.example.com", "b.example.com", "example.org", "x", None, ""]
    rows = [{"doc_id": i, "page_id": None, "declared": [None, "en", "de", "zz"][i % 4], "host": hosts[i % 6], "address": [None, "com/", "org/fr"][i % 3],
             "text": t} for i, t in enumerate(texts)]
    rows += [{"doc_id": 100 + i, "page_id": 7, "declared": "fr" if i else None, "host": h, "address": None, "text": t}
             for i, (h, t) in enumerate([(None, None), ("a.example.com", ""), ("x", "ab"), ("x", "\U0001F600" * 40)])]
    rows += [dict(rows[3]), dict(rows[3])]
    # hosts, declared values and addresses that only short texts have
    rows += [{"doc_id": 200 + i, "page_id": None, "declared": d, "host": h, "address": a, "text": "ab"}
             for i, (d, h, a) in enumerate([("qq", "short.net", None), ("qq", "y.short.net", "net/q"), ("en", "short.net", "net/q"), (None, "alone", None)])]
    out = li.identify(spark.createDataFrame(rows, li.ROW), model).collect()
    got = Counter((r.doc_id, r.page_id, r.text_lang, r.lang, round(r.probability, 6)) for r in out)
    assert got == brute_fuse(rows, model)


def test_odd_rows_and_empty_tables(spark, odd, odd_rows, empty, model):
    out = li.identify(li.document_rows(odd), model).collect()
    assert Counter(r.doc_id for r in out) == Counter(r[0] for r in odd_rows) and all(r.lang for r in out)
    pages = spark.createDataFrame([(1, None, None), (None, "http://h.de", "<html lang=de>"), (2, "x", "")], "page_id long, url string, html string")
    rows = li.page_rows(pages).collect()
    assert [(r.declared, r.host, r.address) for r in rows] == [(None, None, None), ("de", "h.de", "de/"), (None, None, None)]
    assert len(li.identify(li.page_rows(pages), model).collect()) == 3
    assert li.identify(li.document_rows(empty), model).collect() == []
    nothing = li.fit(empty)
    assert nothing.languages == [] and {r.lang for r in li.identify(li.document_rows(odd), nothing).collect()} == {None}


def test_html_text_loses_scripts_and_comments(spark):
    html = '<HTML class="x" lang="fr"><script>var t="</p>";</script><style>p{}</style><!-- <p>no</p> --><p>oui &amp; <b>non</b></p>'
    row = li.page_rows(spark.createDataFrame([(1, "https://w.x.fr:80/fr/a", html)], "page_id long, url string, html string")).first()
    assert row.text.split() == ["oui", "&amp;", "non"] and (row.declared, row.host, row.address) == ("fr", "w.x.fr", "fr/fr")


@pytest.fixture(scope="module")
def classifier(documents):
    return lc.train(lc.corpus_words(documents))


PLANTED = {"Apache License, Version 2.0": "apache-2.0", "Released under the MIT License": "mit", "GNU General Public License, version 3": "gpl", "CC BY-NC 4.0": "cc-by-nc"}


def test_notices_in_documents(documents, classifier):
    rows = documents.filter("text is not null").select("doc_id", "text")
    got = {r.doc_id: set(r.families) for r in lc.scan_licenses(rows, classifier).collect()}
    truth = defaultdict(set)
    for r in rows.collect():
        truth[r.doc_id] = {f for s, f in PLANTED.items() if s in r.text}
    some = [i for i, t in truth.items() if t]
    assert some and sum(got[i] == truth[i] for i in some) / len(some) > 0.98
    assert sum(bool(got[i]) for i, t in truth.items() if not t) / len(truth) < 0.001


def test_templates_inside_prose_and_near_misses(spark, classifier):
    rows, want = [], {}
    for k, (family, texts) in enumerate(lc.TEMPLATES.items()):
        for j, t in enumerate(texts):
            i = 100 * k + j
            rows.append((i, prose(i, 90) + "\n\n" + t.replace(" ", "\n", 1) + "\n\n" + prose(i + 50, 30)))
            want[i] = family
    rows += [(9000, "The version of the work was released under pressure, and the license plate was free of charge to use."), (9001, prose(3, 500)),
             (9002, "Licensed premises under the hill by the sea"), (9003, None)]
    got = {r.doc_id: r for r in lc.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), classifier).collect()}
    assert sum(got[i].license == f for i, f in want.items()) / len(want) > 0.9
    assert all(got[i].license == "unknown" and got[i].confidence is None and got[i].families == [] for i in (9000, 9001, 9002, 9003))


def test_windows_cover_every_word():
    from fablake.llm import textscan as ts

    for text in ("", "a", "a b\n\nc", " ".join(f"w{i}" for i in range(61)), " ".join(f"w{i}" for i in range(100)) + "\n \n" + "x " * 45):
        data = np.frombuffer(text.encode(), np.uint8)
        scan = ts.Scan(0, data, np.array([0, len(data)]))
        _, begin, end, at = lc._words(scan)
        lo, hi, doc = lc._windows(begin, end, at, scan)
        assert set(range(len(begin))) == {i for a, b in zip(lo, hi) for i in range(a, b)} and all(hi - lo <= lc.SPAN) and not doc.any()


def test_license_odd_rows(odd, odd_rows, empty, classifier):
    out = lc.scan_licenses(odd, classifier).collect()
    assert Counter(r.doc_id for r in out) == Counter(r[0] for r in odd_rows) and {r.license for r in out} == {"unknown"}
    assert [r.n_windows for r in out if r.doc_id in (7, 8, 9)] == [0, 0, 0]
    assert lc.scan_licenses(empty, classifier).collect() == []
    assert lc.corpus_words(empty) == [] and isinstance(lc.train([], each=5, rounds=3), lc.Classifier)
