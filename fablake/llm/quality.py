"""Quality rules as a learned decision list.

Every text is measured in one vectorised scan (``measure``).  Rules are learned from the labelled
documents by sequential covering (RIPPER's scheme): a conjunction of thresholds is grown condition
by condition for the largest information gain on two thirds of the examples, pruned on the last
third, and kept while it is precise there; the examples it covers are set aside and the next rule is
grown.  ``verdict`` writes the list as one ordered Spark conditional expression, so that applying it
is a projection.

Learning reads at most ``FIT_ROWS`` labelled documents (those with the smallest hash of their id);
measuring and judging read every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fablake.llm import textscan as ts
from fablake.llm.common import table

FIT_ROWS = 20_000
MAX_RULES, MAX_CONDITIONS, CUTS = 24, 4, 64
LEAST_PRECISION, LEAST_COVER = 0.9, 3
WINDOW = 3

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words",
          "n_upper", "n_digits", "n_punctuation", "n_lone_marks", "longest_word"]
#: What rules may test: shares, so that they do not depend on a text's length.
FEATURES = {
    "mean_word": "word_chars / n_words",
    "symbol_share": "n_symbols / n_words",
    "dup_line_share": "n_dup_lines / n_lines",
    "repeat_share": "n_repeat_words / n_words",
    "distinct_share": "n_distinct_words / n_words",
    "upper_share": "n_upper / word_chars",
    "digit_share": "n_digits / word_chars",
    "punctuation_share": "n_punctuation / word_chars",
    "lone_mark_share": "n_lone_marks / n_words",
    "words_a_line": "n_words / n_lines",
    "longest_share": "longest_word / word_chars",
}
# fixed values: the characters that the base statistics count as symbols
SYMBOLS = b"#*$%&|<>"

_U64 = np.uint64
_flag = lambda chars: np.isin(np.arange(256), list(chars))
_SYMBOL, _UPPER, _DIGIT = _flag(SYMBOLS), _flag(range(65, 91)), _flag(range(48, 58))
_PUNCTUATION = _flag(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
_WINDOW = ts.stream(11, WINDOW)
SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)
_SCHEMA = pa.schema([(c, pa.int64()) for c in ["doc_id", *COUNTS]])


def _repeats(keys: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For keys grouped by text: whether the key stands in its text twice or more, and whether it stood earlier."""
    order = ts.order_by_text(keys, text)
    k, t = keys[order], text[order]
    as_before = np.zeros(len(k), bool)
    as_before[1:] = (k[1:] == k[:-1]) & (t[1:] == t[:-1])
    twice = as_before.copy()
    twice[:-1] |= as_before[1:]
    out = np.zeros((2, len(k)), bool)
    out[0, order], out[1, order] = twice, as_before  # stable order: the first of equals is not "before"
    return out[0], out[1]


def _scan_counts(scan: ts.Scan) -> list[np.ndarray]:
    data = scan.data
    begin, end, words_at = scan.words()
    text, n = ts.text_index(words_at), len(begin)
    n_words = np.diff(words_at)
    word = scan.hashes(begin, end)
    inside = ~ts.SPACE[data]
    starts_char = (data & 0xC0) != 0x80
    chars = np.zeros(len(data) + 1, np.int64)
    np.cumsum(inside & starts_char, out=chars[1:])
    length = chars[end] - chars[begin]

    window = np.zeros(n, _U64)
    for j in range(WINDOW):
        if n > j:
            window[: n - j] += word[j:] * _WINDOW[j]
    whole = np.arange(n) - words_at[text] + WINDOW <= n_words[text]
    at = np.flatnonzero(whole)
    twice, _ = _repeats(ts.mix(window[at]), text[at])
    cover = np.zeros(n, bool)
    for j in range(WINDOW):
        cover[at[twice] + j] = True

    line_begin, line_end, lines_at = scan.lines()
    marks = np.zeros(len(data) + 1, np.int64)
    np.cumsum(inside, out=marks[1:])
    worded = marks[line_end] > marks[line_begin]
    line_text = ts.text_index(lines_at)
    some = np.flatnonzero(worded)
    _, copy = _repeats(scan.hashes(line_begin[some], line_end[some]), line_text[some])
    per_line_text = lambda x: np.bincount(line_text[some][x], minlength=scan.rows)

    _, seen = _repeats(word, text)
    plain = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~_PUNCTUATION[data] & inside, out=plain[1:])
    lone = plain[end] == plain[begin]
    longest = np.zeros(scan.rows, np.int64)
    np.maximum.at(longest, text, length)
    return [n_words, scan.per_text(inside & starts_char), scan.per_text(_SYMBOL[data]), per_line_text(copy),
            ts.sums(cover, words_at), per_line_text(np.ones(len(some), bool)), ts.sums(~seen, words_at),
            scan.per_text(_UPPER[data]), scan.per_text(_DIGIT[data]), scan.per_text(_PUNCTUATION[data]),
            ts.sums(lone, words_at), longest]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).cast(pa.int64())
        for scan in ts.scans(batch):
            yield pa.RecordBatch.from_arrays(
                [ids.slice(scan.first, scan.rows), *(pa.array(c.astype(np.int64)) for c in _scan_counts(scan))], schema=_SCHEMA)


def measure(documents: DataFrame) -> DataFrame:
    """doc_id and the counts of every whole text, one row for each row; a null text counts as empty.

    n_words: words ``[^\\x20\\x09-\\x0D]+``; word_chars: code points in them; n_symbols; n_dup_lines: ``\\n``-split
    lines with a word, equal to an earlier line of the text; n_repeat_words: words in 3-word windows
    that the text has twice or more, the first included; n_lines: lines with a word.
    """
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_measure, SCHEMA)


def features(measured: DataFrame) -> DataFrame:
    """The counts with the shares of ``FEATURES``; a share of nothing is 0."""
    return measured.withColumns({k: F.coalesce(F.try_divide(*map(F.col, v.split(" / "))), F.lit(0.0)).cast("double")
                                 for k, v in FEATURES.items()})


Rule = list[tuple[str, str, float]]


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def verdict(rules: list[Rule]) -> Column:
    """The ordered list as a conditional expression: 0 if no rule rejects the text, or else the rule's number."""
    out = F
    for k, rule in enumerate(rules):
        test = F.lit(True)
        for name, side, cut in rule:
            test = test & ((F.col(name) <= cut) if side == "<=" else (F.col(name) > cut))
        out = out.when(test, F.lit(k + 1))
    return F.lit(0) if out is F else out.otherwise(F.lit(0))


def _covers(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for name, side, cut in rule:
        out &= x[name] <= cut if side == "<=" else x[name] > cut
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, cuts: dict[str, np.ndarray]) -> Rule:
    """Adds the condition of the largest gain until the rule covers bad examples only."""
    rule: Rule = []
    on = np.ones(len(bad), bool)
    while len(rule) < MAX_CONDITIONS:
        p0, n0 = (bad & on).sum(), (~bad & on).sum()
        if not p0 or not n0:
            break
        prior, best = np.log2(p0 / (p0 + n0)), (1e-9, None)
        for name in sorted(x):
            at = np.searchsorted(cuts[name], x[name][on], "left")  # value <= cut k exactly if at <= k
            p_le = np.cumsum(np.bincount(at[bad[on]], minlength=len(cuts[name]) + 1))[:-1]
            n_le = np.cumsum(np.bincount(at[~bad[on]], minlength=len(cuts[name]) + 1))[:-1]
            for side, p, n in (("<=", p_le, n_le), (">", p0 - p_le, n0 - n_le)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / (p + n)) - prior), 0.0)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], (name, side, float(cuts[name][k])))
        if best[1] is None:
            break
        rule.append(best[1])
        on &= _covers(rule[-1:], x, len(bad))
    return rule


def _worth(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> tuple[float, int, int]:
    on = _covers(rule, x, len(bad))
    p, n = int((bad & on).sum()), int((~bad & on).sum())
    return ((p - n) / (p + n) if p + n else -1.0), p, n


def learn(x: dict[str, np.ndarray], bad: np.ndarray, seed: int = 7) -> list[Rule]:
    """Sequential covering on the examples; deterministic for the same examples in the same order."""
    if not len(bad) or not bad.any() or bad.all():
        return []
    spot = np.random.default_rng(seed).permutation(len(bad)) % 3
    cuts = {}
    for name, v in x.items():
        values = np.unique(np.quantile(v, np.linspace(0, 1, CUTS + 1)))
        rare = np.unique(np.quantile(v[bad], np.linspace(0, 1, CUTS + 1)))
        values = np.unique(np.concatenate([values, rare]))
        cuts[name] = (values[:-1] + values[1:]) / 2 if len(values) > 1 else values
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    while len(rules) < MAX_RULES:
        grow, prune = left & (spot < 2), left & (spot == 2)
        if not (bad & grow).any():
            break
        part = lambda mask: ({k: v[mask] for k, v in x.items()}, bad[mask])
        rule = _grow(*part(grow), cuts)
        if not rule:
            break
        on_prune = part(prune)
        rule = max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda r: (_worth(r, *on_prune)[0], -len(r)))
        _, p, n = _worth(rule, *on_prune)
        _, p_all, n_all = _worth(rule, *part(left))
        if p < LEAST_COVER or p < LEAST_PRECISION * (p + n) or p_all < LEAST_PRECISION * (p_all + n_all):
            break
        rules.append(rule)
        left &= ~_covers(rule, x, len(bad))
    return rules


def fit(documents: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> list[Rule]:
    """Rules against quality 0, from at most ``fit_rows`` labelled documents.  Labels that are null or
    contradict each other are not used; documents that the base rules reject are no examples."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").filter(
        "doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("bad"), F.max("quality").alias("good"))
    marks = marks.filter("bad = good").orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = texts.join(F.broadcast(marks), "doc_id").filter("text is not null")  # fit_rows bounds it
    rows = features(measure(texts.select("doc_id", "text"))).filter(~base_failed()).join(
        F.broadcast(marks), "doc_id").select("doc_id", "bad", *FEATURES).toPandas()
    rows = rows.drop_duplicates("doc_id").sort_values("doc_id")
    return learn({k: rows[k].to_numpy() for k in FEATURES}, rows["bad"].to_numpy() == 0)


def judge(documents: DataFrame, rules: list[Rule]) -> DataFrame:
    """Counts, base_failed, rule (number of the first rule that rejects the text, 0 if none) and kept."""
    return features(measure(documents)).withColumn("base_failed", base_failed()).withColumn(
        "rule", verdict(rules)).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    rules = fit(documents, table(spark, sf_dir, "labels"))
    return judge(documents, rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.col("rule").cast("long").alias("rule"))
