import random
import re

import numpy as np

from fablake.llm import linededup as ld
from fablake.llm import quality as q

from .conftest import prose, words


def brute_deleted(docs, least):
    """docs: [(place, text)], in order of place. place -> words that lie in a window of ``least`` words which also
    stands at an earlier place that it does not overlap; the first place of a window counts."""
    first, gone = {}, {}
    for place, text in docs:
        w = words(text)
        for i in range(len(w) - least + 1):
            at = first.setdefault(tuple(w[i: i + least]), (place, i))
            if at[0] != place or i >= at[1] + least:
                gone.setdefault(place, set()).update(range(i, i + least))
    return {p: sorted(g) for p, g in gone.items()}


def brute_cut(text, gone):
    """The text without those words; a run takes the space after its words along, but leaves the line break of
    a line that it did not begin."""
    tokens = re.findall(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", text)
    out, gone = [re.match(r"[\x20\x09-\x0D]*", text).group()], set(gone)
    for i, token in enumerate(tokens):
        if i not in gone:
            out.append(token)
        elif i - 1 not in gone:
            end = i
            while end in gone:
                end += 1
            if i and "\n" not in tokens[i - 1] and "\n" in "".join(tokens[i:end]):
                out.append("\n")
    return "".join(out)


def positions(row):
    return [i for r in row.deleted for i in range(r.s, r.e)]


def check(spark, rows):
    out = ld.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    gone = brute_deleted(rows, ld.MIN_WORDS)
    assert {r.doc_id: positions(r) for r in out} == {i: gone.get(i, []) for i, _ in rows}
    assert {r.doc_id: r.text for r in out} == {i: brute_cut(t, gone[i]) if i in gone else t for i, t in rows}
    assert {r.doc_id: r.n_words for r in out} == {i: len(words(t)) for i, t in rows}
    return gone


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(3)
    pool = [prose(500 + i, rng.choice([3, 8, 20, 30, 70])) for i in range(14)] + [""]
    assert check(spark, [(i, rng.choice(["", " ", "\n\n"]) + "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 12)))) for i in range(60)])


def test_line_dedup_passages_inside_lines(spark):
    """Passages that begin and end inside lines, wrapped in other ways, of just as many words as count, or one fewer."""
    rng = random.Random(4)
    passages = [prose(600 + i, n).split() for i, n in enumerate([49, 50, 51, 64, 120])]
    rows = []
    for i in range(80):
        w = prose(700 + i, rng.randint(0, 40)).split() + rng.choice(passages) + prose(800 + i, rng.randint(0, 40)).split()
        w += rng.choice(passages)[: rng.randint(30, 120)]
        rows.append((i, "".join(x + rng.choice([" ", " ", "  ", "\t", "\n", " \n"]) for x in w)))
    gone = check(spark, rows)
    assert len(gone) > 40 and any(len(g) == 50 for g in gone.values())


def test_line_dedup_few_words_and_periods(spark):
    """Texts that repeat themselves with every period, and texts of two words, where all fingerprints are hot."""
    rng = random.Random(5)
    rows = [(i, "\n".join(["a b c d e f g h i j k l m n o p q r s t u v w x y z".split()[k % p] for k in range(n)]))
            for i, (p, n) in enumerate([(1, 300), (1, 120), (3, 49), (3, 50), (3, 99), (3, 100), (20, 400), (26, 260), (7, 149)])]
    rows += [(100 + i, " ".join(rng.choice(["x", "x", "x", "x", "x", "y"]) for _ in range(rng.randint(0, 200)))) for i in range(40)]
    assert check(spark, rows)


def test_line_dedup_odd_rows(odd, odd_rows):
    out = ld.drop_repeated_lines(odd)
    assert [c for c in out.columns if c not in ("n_words", "deleted", "text")] == [
        c for c in odd.columns if c not in ("n_words", "deleted", "text")]
    rows = out.collect()
    assert len(rows) == len(odd_rows)
    assert sorted((str(r.doc_id), r.n_words) for r in rows) == sorted((str(i), len(words(t))) for i, t, _, _ in odd_rows)
    by_id = {r.doc_id: r for r in rows if r.doc_id not in (None, 2, 16)}
    assert not by_id[1].deleted and not by_id[13].deleted
    assert by_id[14].text == "" and by_id[7].text is None and by_id[9].text == " \n\t \n"
    assert positions(by_id[17]) == list(range(50, 300))
    twice = [r for r in rows if r.doc_id == 2]
    assert [r.text for r in twice] == ["", ""]  # a copy of 1; repeated rows fare alike
    assert [r.text for r in rows if r.doc_id == 16 and r.text.endswith("more")] == ["more"]


def test_line_dedup_empty_table(empty):
    assert ld.drop_repeated_lines(empty).collect() == []


def brute_counts(text):
    w = words(text)
    seen = {}
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i: i + 3]), []).append(i)
    cover = {i + j for at in seen.values() if len(at) > 1 for i in at for j in range(3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return (len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover))


def test_measure_against_brute_force(odd, odd_rows):
    got = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in q.measure(odd).collect())
    assert got == sorted((str(i), *brute_counts(t)) for i, t, _, _ in odd_rows)


def test_measure_random_texts(spark):
    rng = random.Random(8)
    rows = [(i, "".join(rng.choice(["a", "b", "é", " ", " ", "\n", "#", "|", "\t", "A", "7", "!"]) for _ in range(rng.randint(0, 400)))) for i in range(200)]
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
           for r in q.measure(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: brute_counts(t) for i, t in rows}


def test_learned_list_separates_and_is_a_conditional_expression(spark):
    rng = np.random.default_rng(1)
    n = 1500
    x = {"a": rng.random(n), "b": rng.random(n), "c": rng.random(n)}
    bad = ((x["a"] > 0.8) & (x["b"] <= 0.5)) | (x["c"] > 0.95)
    rules = q.learn(x, bad)
    caught = np.zeros(n, bool)
    for r in rules:
        caught |= q._covers(r, x, n)
    assert rules and (caught == bad).mean() > 0.97
    df = spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in zip(*(x[k] for k in "abc"))], "a double, b double, c double")
    picked = [r[0] for r in df.select(q.verdict(rules)).collect()]
    assert [p > 0 for p in picked] == caught.tolist()


def test_no_rule_without_examples(spark, odd, empty):
    assert q.learn({"a": np.zeros(0)}, np.zeros(0, bool)) == []
    assert q.learn({"a": np.ones(9)}, np.zeros(9, bool)) == []
    labels = spark.createDataFrame([(1, None), (None, 0)], "doc_id long, quality int")
    assert q.fit(odd, labels) == []
    rows = q.judge(odd, []).collect()
    assert all(r.kept == (not r.base_failed) and r.rule == 0 for r in rows)
    assert q.judge(empty, []).collect() == []


def test_held_out_accuracy(spark):
    """Rules from half of the labels, judged on the other half."""
    base = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    rules = q.fit(docs, labels.filter("doc_id % 2 = 0"))
    test = q.judge(docs, rules).join(labels.filter("doc_id % 2 = 1"), "doc_id").filter("not base_failed").select("kept", "quality").toPandas()
    clean, junk = test[test.quality == 1], test[test.quality == 0]
    assert clean.kept.mean() > 0.99 and (not len(junk) or (~junk.kept).mean() > 0.9)
