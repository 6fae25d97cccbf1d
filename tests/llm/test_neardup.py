import random

import numpy as np
import pyarrow as pa
import pytest

from fablake.llm import neardup as nd
from fablake.llm import textscan as ts
from fablake.llm.components import components

from .conftest import brute_components, prose, shingles, words


def scan_of(texts):
    return list(ts.scans(pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])))


def test_scan_words_and_lines_match_python():
    texts = ["", None, "a b", " a\nb \n\n c", "é ü\tß\x0bx", "\n", "x" * 10, "a b\x1cc"]
    (scan,) = scan_of(texts)
    begin, end, at = scan.words()
    raw = bytes(scan.data)
    for k, t in enumerate(texts):
        assert [raw[begin[i]: end[i]].decode() for i in range(at[k], at[k + 1])] == words(t)
    begin, end, at = scan.lines()
    for k, t in enumerate(texts):
        assert [raw[begin[i]: end[i]].decode() for i in range(at[k], at[k + 1])] == (t or "").split("\n")


def test_equal_words_hash_equal_wherever_they_stand():
    texts = [prose(s, 50) for s in range(40)]
    hashes = {}
    for scan in scan_of(texts):
        begin, end, _ = scan.words()
        for b, e, h in zip(begin, end, scan.hashes(begin, end)):
            assert hashes.setdefault(bytes(scan.data[b:e]), h) == h
    assert len(set(hashes.values())) == len(hashes)


def test_sets_match_brute_force(odd_rows):
    texts = [r[1] for r in odd_rows]
    sizes = []
    for scan in scan_of(texts):
        _, at = nd.shingle_sets(scan)
        sizes += list(np.diff(at))
    assert sizes == [len(shingles(t)) for t in texts]


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(0)
    for n in (1, 3, 40, 700):
        base = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        other = base.copy()
        other[: n // 4] = rng.integers(0, 1 << 63, n // 4, dtype=np.uint64)
        s = nd.sketches(np.concatenate([base, other]), np.array([0, n, 2 * n]))
        assert (s != np.iinfo(np.uint64).max).all()
        true = len(set(base.tolist()) & set(other.tolist())) / len(set(base.tolist()) | set(other.tolist()))
        assert abs((s[0] == s[1]).mean() - true) < 0.2


def result(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()), key=str)


def expected(rows):
    top = brute_components(rows)
    return sorted(((i, len(shingles(t)), None if i is None else top[i], i is None or top[i] == i) for i, t in rows), key=str)


def test_odd_rows(odd, odd_rows):
    assert result(nd.near_duplicates(odd)) == expected([r[:2] for r in odd_rows])


def test_empty_table(empty):
    assert nd.near_duplicates(empty).collect() == []


def test_chains_and_crowded_buckets(spark):
    """A chain whose ends are unlike, a group of near copies, and texts that share much but too little."""
    rng = random.Random(4)
    base = prose(9, 150).split(" ")
    rows, text = [], list(base)
    for i in range(40):
        text = list(text)
        text[(7 * i) % 150] = f"w{i}"
        rows.append((100 - i, " ".join(text)))
    hub = prose(10, 200).split(" ")
    for i in range(60):
        own = list(hub)
        for _ in range(rng.randint(1, 5)):
            own[rng.randrange(200)] = f"x{i}"
        rows.append((200 + i, " ".join(own)))
    half = prose(11, 100)
    rows += [(300 + i, half + " " + prose(50 + i, 60)) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(nd.near_duplicates(df)) == expected(rows)


@pytest.mark.parametrize("links, top", [
    ([], {}),
    ([(5, 5), (None, 3)], {}),
    ([(i, i + 1) for i in range(1, 60)], {i: 1 for i in range(1, 61)}),
    ([(100, i) for i in range(2, 50)] + [(200, 201), (201, 200)], {**{i: 2 for i in [100, *range(2, 50)]}, 200: 200, 201: 200}),
])
def test_components(spark, links, top):
    out = components(spark.createDataFrame(links, "u long, v long"))
    assert {r.node: r.component for r in out.collect()} == top
