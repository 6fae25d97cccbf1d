import re
from collections import Counter, defaultdict

import numpy as np

from fablake.llm import divergence as dv

from .conftest import lower

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows):
    """Sorted result rows for (text, lang, source) rows."""
    rows = [(t or "", l or "", s or "") for t, l, s in rows]
    groups, docs, counts = defaultdict(set), defaultdict(Counter), defaultdict(Counter)
    for t, l, s in rows:
        groups[l].add(s)
        terms = TERM.findall(lower(t))
        docs[l].update(set(terms))
        counts[l, s].update(terms)
    out = []
    for l, sources in groups.items():
        kept = {t for t, n in docs[l].items() if n >= 3}
        v = len(kept)
        share = lambda c, n: {t: 1 + 10 ** 9 * (c[t] + 1) // (n + v) for t in kept}  # noqa: E731, B023
        total = lambda c: sum(c[t] for t in kept)  # noqa: E731, B023
        p = {s: share(counts[l, s], total(counts[l, s])) for s in sources}
        every = sum((counts[l, s] for s in sources), Counter())
        q = share(every, total(every))
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if counts[l, s][t] and p[s][t] > q[t]]
            for part, found, top in (("pair", pairs, None), ("term", terms, 200)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:top]
                out += [(l, s, part, item, value, k + 1) for k, (value, item) in enumerate(ranked)]
    return sorted(out)


def run(df):
    return sorted(tuple(r) for r in dv.audit(df).select("lang", "source", "part", "item", "value", "rank").collect())


def test_odd_rows_and_empty_tables(spark, odd, odd_rows, empty):
    assert run(odd) == brute([(r[1], r[2], r[3]) for r in odd_rows])
    assert run(empty) == []


def corpus(n, sources, vocabulary, seed, langs=("en", "de")):
    r = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        s = int(r.integers(sources)) if k % 3 else 0  # one source has a third of the rows
        own = (np.minimum(r.zipf(1.2, 60), vocabulary) * (1 + s % 3) + 7 * s) % vocabulary
        rows.append((" ".join("w" + "abcdefghij"[w % 10] * (w // 97 % 4 + 1) + chr(97 + w % 26) + chr(97 + w // 26 % 26) for w in own)
                     + (". ÄÖ äö Straße 日本 naïve" if k % 5 == 0 else ""), langs[k % len(langs)], f"s{s:03d}"))
    return rows


def test_many_sources_and_blocks(spark, monkeypatch):
    # more sources than a tile and more terms than a block
    monkeypatch.setattr(dv, "BLOCK_TERMS", 64)
    rows = corpus(700, 150, 900, 1)
    rows += [("", "en", "zz"), (None, "xx", "a"), ("only twice", "xx", "b"), ("only twice", "xx", "a"), (None, None, None)]
    rows += [("one two", "yy", f"t{k}") for k in range(2)]
    found = run(spark.createDataFrame(rows, "text string, lang string, source string"))
    assert len({r[1] for r in found if r[0] == "en"}) > 64
    assert found == brute(rows)


def test_prices_are_those_of_all_cells():
    r = np.random.default_rng(3)
    for share in (0.0, 0.01, 0.2, 1.0):
        a, b = (np.where(r.random((64, 96)) < share, r.integers(1, 10 ** 9, (64, 96)), 0) for _ in range(2))
        a0, b0 = (r.integers(1, 1000, 64) for _ in range(2))
        there, back = dv.price(a, b, a0, b0, True)
        p, q = (np.where(m == 0, z[:, None], m) for m, z in ((a, a0), (b, b0)))
        far = (p[:, None, :] - q[None]) ** 2
        assert (there == (far // q[None]).sum(axis=2)).all() and (back == (far // p[:, None, :]).sum(axis=2)).all()


def test_quadtree_leaves_out_zero_quadrants():
    matrix = np.zeros((64, 64), np.int64)
    matrix[5, 40] = 7
    tree = dv.Quadtree(matrix)
    assert [len(b) for b in tree.bits] == [4] * dv.LEVELS and len(tree.leaves) == 1 and not dv.Quadtree(0 * matrix).some
