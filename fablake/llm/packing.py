"""Packing by concatenate and cut.

Pass one tokenizes every whole text and writes the ids with their running total inside the partition.
The partitions' totals give each document its offset in the one long run of tokens; pass two, column
expressions only, cuts that run at every multiple of ``LENGTH``.  A document that crosses a boundary gives
one piece on each side; its boundary records (``pieces``) say where each piece lies in the document and in
the sequence.  Only the last sequence can be short.

Ids are those of ``tokenizers`` for the whole text.  The tokenizer drops white space and no token spans
it, so texts are cut at spaces and line feeds; a text of plain letters, digits and marks is lower-cased
and cut before its commas and full stops, too, so that a word is the same however it is written and whatever
follows it.  Arrow cuts the texts and numbers their words, ``CHUNK_BYTES`` at a time, so a word is looked up
once a chunk.  New words of small letters are coded together by the tokenizer's model.  Any other new word of
plain letters, digits and marks is cut into parts as the tokenizer cuts it, and the model codes parts that were
not met before; all else goes through the whole tokenizer.  Both tables are bounded (``CACHE_WORDS``,
``CACHE_PARTS``; nothing longer than ``LONG_WORD`` is kept).
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fablake.llm import worker
from fablake.llm.common import kept, table
from fablake.llm.prefix import with_offsets

LENGTH = 2048
END = 1
TOKENIZER = "word_bpe_49k.json"
CACHE_WORDS, CACHE_PARTS, LONG_WORD, JOINED = 500_000, 50_000, 100, 500
_PACK = [struct.Struct(f"<{n}I").pack for n in range(32)]
#: Texts got from Spark at a time, and bytes of texts (or one longer text) coded and given to it at a time.
READ_ROWS, CHUNK_BYTES = 1_500, 6 << 20
IDS = "doc_id long, part int, local long, n long, ids binary"
_IDS = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("local", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])


# fixed values: how the tokenizer cuts words, for text whose lower case and normal form are plain: ASCII, and
# Latin letters with one lower case each
_PLAIN = re.compile("[\x21-\x7e\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u0148\u014a-\u017e]+")
_SMALL = re.compile("[" + "".join(c for c in map(chr, range(0x17f)) if _PLAIN.match(c) and c.isalpha() and c.lower() == c) + "]+")
#: A plain text, and marks that go together with a comma or full stop behind them (RE2).
_PLAIN_TEXT, _MARKS = "\\A[" + _PLAIN.pattern[1:-2] + " ]*\\z", r"[!-/:-@\[-`{-~][,.] |<\|"
_CUT_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[0-9]|(?:[^\w]|_)+")


def _byte_letters() -> list[str]:
    """The letter that byte-level tokenizers write for each byte: itself where it prints, else one above 255."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in prints]
    return [chr(b) if b in prints else chr(256 + rest.index(b)) for b in range(256)]


_LETTERS = _byte_letters()
_LETTER_OF = {b: c for b, c in enumerate(_LETTERS) if b != 0x20}


class _Recent(dict):
    """Ids of words met lately, coded on first use, ``size`` at most.  When half of them are new, they become ``old``
    and what was old goes, but for words that are met again: those count as new."""

    def __init__(self, size: int, code: Callable[[str], bytes]):
        super().__init__()
        self.half, self.code, self.old = max(1, size // 2), code, {}

    @property
    def new(self) -> dict[str, bytes]:
        return self

    def __missing__(self, word: str) -> bytes:
        return self.keep(word, self.old.get(word) or self.code(word))

    def keep(self, word: str, found: bytes) -> bytes:
        if len(word) <= LONG_WORD:
            if len(self) >= self.half:
                self.old = dict(self)
                self.clear()
            self[word] = found
        return found


class WordIds:
    """ids(text): the text's ids as little-endian unsigned 32-bit bytes, without the end id."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task on every core
        self._tokenizer = Tokenizer.from_file(path)
        self._model = self._tokenizer.model
        self._bare = Tokenizer(self._model)
        self._bare.pre_tokenizer = WhitespaceSplit()
        vocabulary, suffix = self._tokenizer.get_vocab(), self._model.end_of_word_suffix
        self._ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self._ends[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True
        self._words, self._parts = _Recent(CACHE_WORDS, self._word), _Recent(CACHE_PARTS, self._code)

    def _code(self, part: str) -> bytes:
        letters = part if part.isascii() else "".join([_LETTERS[b] for b in part.encode()])
        ids = [t.id for t in self._model.tokenize(letters)]
        return _PACK[len(ids)](*ids) if len(ids) < len(_PACK) else struct.pack(f"<{len(ids)}I", *ids)

    def _part(self, part: str) -> bytes:
        """A part has the ids of the word that is written like it."""
        return self._words.get(part) or self._parts[part]

    def _word(self, word: str) -> bytes:
        if not _PLAIN.fullmatch(word) or "<|" in word:  # special tokens, control characters, other scripts, nothing at all
            return np.asarray(self._tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        lower = word.lower()
        if lower.isalpha():
            return self._code(word) if lower == word else self._part(lower)
        if lower[:-1].isalpha():  # letters, then one mark or digit
            return self._part(lower[:-1]) + self._part(lower[-1])
        return b"".join([self._part(p) for p in _CUT_WORD.findall(lower)])

    def ids(self, text: str) -> bytes:
        return b"".join(map(self._words.__getitem__, text.replace("\n", " ").split(" ")))

    def _code_all(self, words: list[str]) -> Iterator[bytes]:
        """Ids of each word of small letters, by the model alone."""
        for lo in range(0, len(words), JOINED):
            some = words[lo: lo + JOINED]
            coded = self._bare.encode_batch_fast([" ".join(some).encode().decode("latin-1").translate(_LETTER_OF)], add_special_tokens=False)[0]
            ids = np.asarray(coded.ids, "<u4")
            ends = (4 * np.flatnonzero(self._ends[ids]) + 4).tolist()
            if len(ends) == len(some):
                yield from map(ids.tobytes().__getitem__, map(slice, [0, *ends[:-1]], ends))
            else:  # a model that does not mark the ends of words
                yield from map(self._code, some)

    def _all(self, words: list[str]) -> list[bytes]:
        """Ids of each word; the words are distinct."""
        found, old = [*map(self._words.get, words)], self._words.old
        fresh = [k for k, ids in enumerate(found) if ids is None]
        small = [w for w in (words[k] for k in fresh) if w not in old and _SMALL.fullmatch(w)]
        coded = dict(zip(small, self._code_all(small)))
        for k in fresh:
            word = words[k]
            found[k] = self._words.keep(word, old.get(word) or coded.get(word) or self._word(word))
        return found

    def ids_of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of large_string texts one after the other, each text's with the end id, and where each text's end."""
        texts = pc.replace_substring(pc.fill_null(texts, ""), "\n", " ")
        ended = pc.binary_join_element_wise(texts, pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string()))
        simple = pc.and_not(pc.match_substring_regex(texts, _PLAIN_TEXT), pc.match_substring_regex(ended, _MARKS))
        lower = pc.utf8_lower(ended)
        for mark in ",.":
            lower = pc.replace_substring(lower, f"{mark} ", f" {mark} ")
        lists = pc.split_pattern(pc.if_else(simple, lower, texts), " ")
        words = pc.dictionary_encode(lists.flatten())
        found = [*self._all(words.dictionary.to_numpy(zero_copy_only=False).tolist()), _PACK[1](END)]
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        at = np.cumsum(size) - size
        ends = lists.offsets.to_numpy()[1:] - lists.offsets[0].as_py()
        spoken = np.insert(words.indices.to_numpy(), ends, len(found) - 1)
        sizes = size[spoken]
        upto = np.cumsum(sizes)
        flat = np.frombuffer(b"".join(found), "<u4")[np.arange(upto[-1]) + np.repeat(at[spoken] - upto + sizes, sizes)]
        return flat, upto[ends + np.arange(len(ends))]


def _chunks(texts: pa.Array) -> Iterator[pa.Array]:
    """Rows in a row of about ``CHUNK_BYTES``, a longer text for itself."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy())
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + CHUNK_BYTES, "right")))
        yield texts[lo:hi]
        lo = hi


def _tokenize(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        coder, total = worker.table(("word ids", path), lambda: WordIds(path)), 0
        for batch in batches:
            lo = 0
            for texts in _chunks(batch.column(1).cast(pa.large_string())):
                ids, ends = coder.ids_of(texts)
                rows = len(texts)
                begins = np.concatenate([ends[:1] * 0, ends[:-1]])
                cells = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), rows, [None, pa.py_buffer(4 * np.concatenate([begins[:1], ends])), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[lo: lo + rows], pa.array(np.full(rows, part, np.int32)), pa.array(total + begins),
                     pa.array(ends - begins), cells.cast(pa.binary())], schema=_IDS)
                total += int(ends[-1])
                lo += rows

    return run


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What runs inside gets its texts ``READ_ROWS`` at a time: Spark's 10,000 are tens of MB for each task, in the JVM and in Python."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(READ_ROWS))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def pieces(documents: DataFrame, length: int = LENGTH, path: str | None = None) -> DataFrame:
    """Boundary records: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (little-endian
    unsigned 32-bit), one for each part of a document that lies in one sequence.

    Every row of ``documents`` (doc_id, text) is packed, repeated rows and null doc_ids too; a null or
    empty text is the end id alone.  Documents follow one another in the order of the written
    partitions.  Sequences are numbered from 0, all but the last are full.  Other columns are ignored.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with small_batches(documents.sparkSession):
        tokens = kept(docs.mapInArrow(_tokenize(path or tokenizer_path()), IDS), "tokens")
    placed = with_offsets(tokens, "n").select("doc_id", F.col("start").alias("at"), "n", "ids")
    first, last = F.expr(f"at div {length}"), F.expr(f"(at + n - 1) div {length}")
    cut = placed.select("*", F.explode(F.sequence(first, last)).alias("sequence_id"))
    cut = cut.withColumn("start", F.greatest(F.lit(0), F.col("sequence_id") * length - F.col("at")))
    cut = cut.withColumn("offset", F.col("at") + F.col("start") - F.col("sequence_id") * length)
    cut = cut.withColumn("length", F.least(F.col("n") - F.col("start"), length - F.col("offset")))
    cut = cut.withColumn("ids", F.substring("ids", (4 * F.col("start") + 1).cast("int"), (4 * F.col("length")).cast("int")))
    return cut.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), F.col("n").alias("doc_tokens"),
                      "sequence_id", "offset", "ids")


def packed(documents: DataFrame, length: int = LENGTH, path: str | None = None) -> DataFrame:
    """``pieces`` without the ids, which a digest column stands for."""
    return pieces(documents, length, path).drop("ids")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
