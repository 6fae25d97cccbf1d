import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fablake.llm import codebooks as cb

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error string, vector string, label_error string"


def brute(rows, entries=256, rounds=4):
    """{row position: (code, error)}, codebooks: plain loops over whole numbers."""
    kept = [(k, r) for k, r in enumerate(rows) if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    width = max([len(r[1]) for _, r in kept], default=0)
    width = max(4, -(-width // 4) * 4)
    cells = {k: [math.floor(1024 * x) for x in r[1]] + [0] * (width - len(r[1])) for k, r in kept}
    first = sorted(kept, key=lambda x: (x[1][0] is None, x[1][0] or 0, x[1][1]))[:entries]
    size = width // 4
    cut = lambda k, part: cells[k][part * size: (part + 1) * size]
    books = [[cut(k, part) for k, _ in first] for part in range(4)]
    far = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y))
    best = lambda k, part: min((far(cut(k, part), e), n) for n, e in enumerate(books[part]))
    for _ in range(rounds):
        for part in range(4):
            groups = {}
            for k, _ in kept:
                groups.setdefault(best(k, part)[1], []).append(cut(k, part))
            books[part] = [[sum(c) // len(groups[n]) for c in zip(*groups[n])] if n in groups else e for n, e in enumerate(books[part])]
    out = {k: [best(k, part) for part in range(4)] for k, _ in kept}
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return {k: ("".join(f"{n:02x}" for _, n in v), sum(d for d, _ in v)) for k, v in out.items()}, digest


def run(spark, rows, monkeypatch=None):
    df = spark.createDataFrame([(*r, *["x"] * 4) for r in rows], SCHEMA).repartition(3)
    codes, books = cb.compress(df)
    return sorted((r.vec_id is None, r.vec_id or 0, r.label is None, r.label or 0, r.code, int(r.error)) for r in codes.collect()), cb.digest(books)


def want(rows):
    found, digest = brute([(i, None if v is None else [x if x is None else float(np.float32(x)) for x in v], y) for i, v, y in rows])
    return sorted((rows[k][0] is None, rows[k][0] or 0, rows[k][2] is None, rows[k][2] or 0, c, e) for k, (c, e) in found.items()), digest


def vectors(n, width, seed, centres=12, spread=0.05):
    r = np.random.default_rng(seed)
    c = r.normal(size=(centres, width))
    return [(int(i), [float(np.float32(x)) for x in c[i % centres] + r.normal(scale=spread, size=width)], int(i % 5)) for i in range(n)]


def test_equals_plain_rounds(spark):
    rows = vectors(700, 16, 1)
    assert run(spark, rows) == want(rows)


def test_without_clusters_and_with_many_ties(spark):
    r = np.random.default_rng(2)
    rows = [(i, [float(x) for x in r.integers(-2, 3, 8) / 1024], i % 3) for i in range(900)]
    assert run(spark, rows) == want(rows)


def test_odd_rows(spark):
    rows = vectors(40, 8, 3)
    rows += [(100, None, 1), (101, [1.0, None] + [0.0] * 6, 1), (102, [float("nan")] * 8, 2), (103, [float("inf")] + [0.0] * 7, 2),
             (104, [], 2), (105, [0.5, -0.25, 3.0], None), (106, [-0.0005] * 8, None), (None, [0.1] * 8, None), (None, [0.1] * 8, None),
             (3, [2.0] * 8, 1), (3, [2.0] * 8, 1), (107, [0.25] * 7, 4)]
    assert run(spark, rows) == want(rows)


def test_very_large_components(spark):
    rows = [(i, [float(np.float32(x * 10 ** (i % 12))) for x in (0.3 + i, -1.7, 2.2, -0.1 * i)], 1) for i in range(60)]
    assert run(spark, rows) == want(rows)


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    codes, books = cb.compress(df)
    assert codes.collect() == [] and all(len(b) == 0 for b in books)
    codes, _ = cb.compress(spark.createDataFrame([(1, None, 2, *["x"] * 4)], SCHEMA))
    assert codes.collect() == []


def test_small_blocks_and_deep_trees(spark, monkeypatch):
    rows = vectors(500, 8, 4, centres=40, spread=0.01)
    whole, _ = cb.assign(cb.Tree(cb.whole_numbers(np.array([r[1][:2] for r in rows])), 4), cb.whole_numbers(np.array([r[1][:2] for r in rows[:40]])))
    assert whole  # clustered parts are assigned by node
    assert run(spark, rows) == want(rows)


def test_dual_tree_finds_the_nearest():
    r = np.random.default_rng(5)
    for n, width, entries in ((1, 1, 1), (7, 3, 5), (400, 2, 31), (1000, 4, 64), (300, 16, 200)):
        x, book = r.integers(-300, 300, (n, width)), r.integers(-300, 300, (entries, width))
        book[: entries // 3] = x[r.integers(0, n, entries // 3)]
        book[-1] = book[0]
        tree = cb.Tree(x, 8)
        to = np.full(n, -1)
        whole, leaves = cb.assign(tree, book)
        for a, b, e in whole:
            to[a:b] = e
        for a, b, c in leaves:
            to[a:b] = cb.nearest(tree.x[a:b], book, c)
        far = ((tree.x[:, None, :] - book[None]) ** 2).sum(axis=2)
        assert (to == far.argmin(axis=1)).all()


def test_label_errors_are_summed_with_nulls_together(spark, tmp_path):
    rows = [(i, [float(np.float32(x)) for x in np.random.default_rng(i).normal(size=4)], None if i % 3 == 0 else i % 2) for i in range(300)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    out = cb.op11_vector_codes(spark, str(tmp_path)).collect()
    found, digest = brute(rows)
    label = {r[0]: r[2] for r in rows}
    total = {}
    for k, (_, e) in found.items():
        total[label[k]] = total.get(label[k], 0) + e
    assert len(out) == 300 and {r.codebooks_sha256 for r in out} == {digest}
    assert all((r.code, r.error) == found[r.vec_id] and r.label_error == total[label[r.vec_id]] for r in out)


@pytest.mark.parametrize("n", [255, 256, 257])
def test_number_of_entries(spark, n):
    rows = [(i, [float(i % 7), float(i % 11), 1.0, float(i)], 0) for i in range(n)]
    assert run(spark, rows) == want(rows)
    assert spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").agg(F.max("vec_id")).first()[0] == n - 1
