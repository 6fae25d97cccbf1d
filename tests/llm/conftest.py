"""Small inputs that hold every odd case, and brute-force helpers."""

import random
import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FIRST = 'abcdefghijklmnopqrstuvwxyz'
CLASHES = ("kept rule base_failed n_words deleted n_lines text_hash band rep hub label component_id n_shingles u v part local start "
           "shard slot size row item words try tries matched language best scores license families sequence_id ids n").split()


def prose(seed: int, n: int, names: bool = False) -> str:
    r = random.Random(seed)
    words = ["".join(r.choice(FIRST) for _ in range(r.randint(2, 9))) for _ in range(n)]
    return " ".join(w + ("." if i % 9 == 8 else "") for i, w in enumerate(words))


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text, lang, source): nulls, empty, blank, short, long, ties, repeated rows, several texts for one id."""
    a, b, c = prose(1, 120), prose(2, 200), prose(3, 80)
    near = a.split(" ")
    near[60] = "changed"
    long = "\n".join(prose(100 + i, 60) for i in range(800))
    return [
        (1, a, "en", "s1"), (2, a, "en", "s1"), (2, a, "en", "s1"), (3, " ".join(near), "en", "s2"), (4, a.upper(), None, "s1"),
        (5, b + "\n" + c, "de", "s2"), (6, c + "\n" + b, "de", None), (7, None, None, None), (8, "", "fr", "s1"),
        (9, " \n\t \n", "fr", "s1"), (10, "one two", "en", "s1"), (11, "one  two", "en", "s1"), (12, "one two three", "en", "s3"),
        (None, a, "en", "s1"), (None, None, "en", "s1"), (None, c, "en", "s1"), (13, long, "en", "s1"), (14, long + "\n" + c, "en", "s1"),
        (15, "wörd ünïcode ß éé \U0001F600  x " * 30, "de", "s1"), (16, b, "de", "s4"), (16, c + " more", "de", "s4"),
        (17, "same " * 300, "en", "s1"), (18, "\n".join(["the same line again and again " * 3] * 40), "en", "s1"),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)
    return spark.createDataFrame([(*r, len(r[1] or ""), *["x"] * len(CLASHES)) for r in odd_rows], schema)


@pytest.fixture(scope="session")
def empty(spark, odd):
    return spark.createDataFrame([], odd.schema)


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", FIRST))


def shingles(text):
    w = words(lower(text or ""))
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < 5 else frozenset(tuple(w[i: i + 5]) for i in range(len(w) - 4))


def brute_components(rows):
    """doc_id -> smallest doc_id reachable, by comparing all pairs; rows without doc_id or words left out."""
    sets = {}
    for i, text in rows:
        if i is not None:
            sets.setdefault(i, set()).add(shingles(text))
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if any(a and b and 100 * len(a & b) >= 75 * len(a | b) for a in sets[i] for b in sets[j]):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: root(i) for i in ids}
