import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from fablake.llm import packing as pk

from .conftest import prose

PATH = pk.tokenizer_path()


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def plain(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


TEXTS = [
    "", " ", "\n", "Hello  World\n\nit's they'll", "é É é ́x  y　z  q \x85w", "a\x1cb a\x0bb \tc\r\nd", "1234 5 ½ ²", "😀😀 ok", "<|endoftext|> x<|startoftext|>y",
    "日本語 テキスト 한국어", "x" * 5000, "don't 'S 's' 'RE", "İstanbul ǅ ß ŉ", "- -- --- !!! $%^", "﻿ a", "a‍b c­b", "ﬁ ﬀ",
]


def test_word_cache_equals_whole_text(tokenizer, spark):
    rng = random.Random(1)
    chars = "ab cd\n é́  'st1!😀\tZ̀İΣσ"
    texts = TEXTS + ["".join(rng.choice(chars) for _ in range(rng.randint(0, 120))) for _ in range(400)]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    coder = pk.WordIds(PATH)
    for t in texts:
        assert np.frombuffer(coder.ids(t or ""), "<u4").tolist() == plain(tokenizer, t), t[:80]


def test_tables_stay_bounded(tokenizer, monkeypatch):
    monkeypatch.setattr(pk, "CACHE_WORDS", 5)
    monkeypatch.setattr(pk, "CACHE_PARTS", 4)
    coder = pk.WordIds(PATH)
    for t in [prose(s, 30) for s in range(20)] + ["a b", "a b c", "x" * 300]:
        assert np.frombuffer(coder.ids(t), "<u4").tolist() == plain(tokenizer, t)
        assert len(coder._words.new) <= 5 and len(coder._words.old) <= 5 and len(coder._parts.new) + len(coder._parts.old) <= 8


def test_a_word_is_held_and_coded_once(tokenizer):
    """op8: a plain word is kept in one table only, and a part that is written like a word met before is not coded again."""
    coder = pk.WordIds(PATH)
    text = "stem stone stem. Stone stone5"
    assert np.frombuffer(coder.ids(text), "<u4").tolist() == plain(tokenizer, text)
    assert set(coder._parts.new) == {".", "5"} and set(coder._words.new) == set(text.split(" "))


def coded_texts(coder, texts):
    """Ids of each text without the end id, coded in chunks."""
    out = []
    for chunk in pk._chunks(pa.array(texts, pa.large_string())):
        ids, ends = coder.ids_of(chunk)
        out += [part.tolist() for part in np.split(ids, ends[:-1])]
    assert all(x[-1] == pk.END for x in out)
    return [x[:-1] for x in out]


def test_chunks_equal_whole_text(tokenizer, monkeypatch):
    """op8: texts coded together, their words cut and numbered by Arrow, have the ids of the whole tokenizer."""
    rng = random.Random(2)
    texts = [*TEXTS, None, "a, b.", "a,. b", "5, 6.5 7. .a ,b , . x", "it's, 's. '. _, A.", "<|endoftext|>, x."]
    for chars in ("ab cd\n é́  'st1!😀\tZ̀İΣσ,.", "abÉé1,. \n", "abÉé1,. !'_<|-s\n"):
        texts += ["".join(rng.choice(chars) for _ in range(rng.randint(0, 80))) for _ in range(700)]
    want = [plain(tokenizer, t) for t in texts]
    for size, words in ((pk.CHUNK_BYTES, pk.CACHE_WORDS), (200, 7)):
        monkeypatch.setattr(pk, "CHUNK_BYTES", size)
        monkeypatch.setattr(pk, "CACHE_WORDS", words)
        coder = pk.WordIds(PATH)
        assert coded_texts(coder, texts) == want
        assert len(coder._words.new) + len(coder._words.old) <= words


def test_a_word_is_one_however_it_is_written(tokenizer):
    """op8: capitals and the mark behind a word make no other word of it."""
    coder = pk.WordIds(PATH)
    texts = ["Stem, stem. STEM", "Élan. élan,"]
    assert coded_texts(coder, texts) == [plain(tokenizer, t) for t in texts]
    assert set(coder._words.new) == {"stem", "élan", ",", ".", ""}


def test_pieces_are_cut_by_expressions_and_texts_come_in_small_batches(spark, odd, monkeypatch):
    """pipeline, op8: one pass of Python, a bounded number of texts at a time, and the session's setting is as it was."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, seen, write = spark.conf.get(key), [], pk.kept
    monkeypatch.setattr(pk, "kept", lambda df, name: (seen.append(int(spark.conf.get(key))), write(df, name))[1])
    assert "mapinarrow" not in pk.packed(odd)._jdf.queryExecution().toString().lower()
    assert seen == [pk.READ_ROWS] and spark.conf.get(key) == before


def test_a_long_document_is_cut(spark, tokenizer):
    text = "\n".join(prose(900 + i, 50) for i in range(400))
    check_pieces(pk.pieces(spark.createDataFrame([(1, text), (2, None), (None, "x")], "doc_id long, text string"), 16).collect(),
                 [(1, text), (2, None), (None, "x")], tokenizer, 16)


def test_every_letter_of_the_plain_range(tokenizer):
    coder = pk.WordIds(PATH)
    for c in map(chr, range(1, 0x250)):
        for t in (c, f"a{c}b", f"{c}'s", f"_{c}_1", f"A{c}{c}9.", f"<|{c}|>"):
            assert np.frombuffer(coder.ids(t), "<u4").tolist() == plain(tokenizer, t), (t, c)


def check_pieces(rows, docs, tokenizer, length):
    """Exact round trip: every id of every document lies in one piece; sequences have no gap."""
    ids = [np.asarray(plain(tokenizer, t) + [1], "<u4") for _, t in docs]
    want = Counter((i, x.tobytes()) for (i, _), x in zip(docs, ids))
    total = sum(map(len, ids))
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append(r)
        assert 1 <= r.length <= length and zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
    assert sorted(by_sequence) == list(range(-(-total // length)))
    for s, own in by_sequence.items():
        own.sort(key=lambda r: r.offset)
        at = 0
        for r in own:
            assert r.offset == at
            at += r.length
        assert at == (length if s < max(by_sequence) else total - s * length)
    got, run = Counter(), b""
    for s in sorted(by_sequence):
        for r in by_sequence[s]:
            assert r.start == len(run) // 4
            run += bytes(r.ids)
            if len(run) == 4 * r.doc_tokens:
                got[(r.doc_id, run)] += 1
                run = b""
    assert got == want and not run


@pytest.mark.parametrize("length", [7, 64, 2048])
def test_round_trip(odd, odd_rows, tokenizer, length, monkeypatch):
    docs = [r[:2] for r in odd_rows]
    check_pieces(pk.pieces(odd.repartition(5), length).collect(), docs, tokenizer, length)


def test_exact_multiple_and_empty(spark, tokenizer, empty):
    docs = [(i, "") for i in range(64)]
    rows = pk.pieces(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), 16).collect()
    check_pieces(rows, docs, tokenizer, 16)
    assert len({r.sequence_id for r in rows}) == 4
    assert pk.pieces(empty).collect() == []


def test_whole_table(spark, tokenizer):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check_pieces(pk.pieces(docs.repartition(6)).collect(), [(r.doc_id, r.text) for r in docs.collect()], tokenizer, 2048)
