"""run() against the stages' brute-force versions on small tables."""

from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as cp
from fablake.llm import linededup as ld
from fablake.llm import packing as pk
from fablake.llm import quality as q

from .conftest import brute_components, prose
from .test_linededup_quality import brute_counts, brute_cut, brute_deleted
from .test_packing import plain

ITEM = prose(71, 30)


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("tables"))
    a, b, c = prose(31, 150), prose(32, 90), prose(33, 140)
    near = c.split(" ")
    near[70] = "other"
    docs = [
        (1, a), (2, a), (3, b + "\n" + prose(34, 60)), (4, prose(35, 70) + "\n" + b), (5, c), (6, " ".join(near)), (7, "short text"), (8, None), (9, ""),
        (10, "word " * 200), (11, prose(36, 80) + " " + ITEM), (12, prose(37, 80) + "\n" + ITEM.upper()), (None, prose(38, 70)), (13, prose(39, 4000)),
        (14, "\n".join(prose(40 + i, 20) for i in range(20))),
    ]
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x") for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long, kept string") \
        .write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (None, None, 0), (10, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    return base, docs


def brute(docs):
    """Too few labels for a rule: the base rules decide; then the definitions of each stage."""
    def base_ok(t):
        n, _, _, _, repeat = brute_counts(t)
        return n >= 50 and 100 * repeat <= 50 * n
    docs = [(i, t) for i, t in docs if base_ok(t)]
    order = sorted(docs, key=lambda d: (d[0] is None, d[0] or 0))
    gone = brute_deleted([(k, t) for k, (_, t) in enumerate(order)], ld.MIN_WORDS)
    cut = []
    for k, (i, t) in enumerate(order):
        left = brute_cut(t, gone[k]) if k in gone else t
        if k not in gone or len(left.split()) >= ld.MIN_WORDS:
            cut.append((i, left))
    top = brute_components(cut)
    cut = [(i, t) for i, t in cut if i is None or top[i] == i]
    flat = lambda t: " ".join(t.lower().replace(".", " ").split())
    return [(i, t) for i, t in cut if flat(ITEM) not in flat(t)]


def test_run(spark, sf_dir):
    base, docs = sf_dir
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(pk.tokenizer_path())
    want = brute(docs)
    assert {i for i, _ in want} == {1, 3, 4, 5, 13, 14, None}
    rows = cp.run(spark, base).collect()
    tokens = {i: np.asarray(plain(tokenizer, t) + [1]) for i, t in want}
    assert Counter({i: sum(r.length for r in rows if r.doc_id == i) for i in {r.doc_id for r in rows}}) == Counter({i: len(x) for i, x in tokens.items()})
    assert sum(r.length for r in rows) == sum(map(len, tokens.values()))
    assert {r.sequence_id for r in rows} == set(range(-(-sum(map(len, tokens.values())) // pk.LENGTH)))


def test_stages_keep_columns_and_handle_odd_tables(spark, sf_dir, odd, empty):
    base, _ = sf_dir
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, odd, base)
        assert out.columns == odd.columns and out.dtypes == odd.dtypes, name
        assert 0 < out.count() <= odd.count()
        assert stage(spark, empty, base).collect() == [], name
    assert cp.STAGES[-1][1](spark, odd, base).count() >= odd.count()
    assert cp.STAGES[-1][1](spark, empty, base).collect() == []


def test_clean_documents_stay(spark):
    base = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{base}/documents.parquet")
    left = {r.doc_id for r in cp.quality_stage(spark, docs, base).select("doc_id").collect()}
    labels = spark.read.parquet(f"{base}/labels.parquet").toPandas()
    ok = {r.doc_id for r in q.judge(docs, []).filter("kept").collect()}
    clean = set(labels[labels.quality == 1].doc_id) & ok
    assert len(clean & left) / len(clean) > 0.99
