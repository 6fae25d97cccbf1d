"""Vector code compression by dual-tree Lloyd rounds.

Vectors are cut into ``PARTS`` consecutive parts; each part position has a codebook of ``ENTRIES`` entries, refined by
``ROUNDS`` rounds of assigning and averaging, all in whole numbers (``floor(1024 * component)``).

*Trees over parts.*  Rows are held in blocks (``BLOCK_CELLS`` components), written once to the shared folder.  A block has one
balanced tree for each part position: nodes split at the median of their widest component and keep their box, count and
component sums.  *Tree over entries*: the same, over the codebook, built anew each round (it is small).

*Dual-tree assignment.*  Pairs (node of parts, node of entries) descend together, level by level.  From the boxes, no part of the
node is further than ``most`` from some entry, and none nearer than ``least`` to any entry of the pair; pairs whose ``least`` is
above the node's smallest ``most`` go.  Where the other side is a single entry, the bound is sharpened: an entry goes if the
whole box is strictly nearer to the best one (the difference of two squared distances is linear over the box).  A node left with
one entry is assigned whole, by its cached count and sums.  Leaves left with several compare whole-number distances.  Only strict
differences prune, so ties reach the leaves and fall to the lower index.

Each round is one job over the blocks: a task adds up what it assigned, the sums of all tasks are added by (part, entry), and the
driver gets ``PARTS * ENTRIES`` entries, whatever the number of vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fablake.llm.common import kept, table

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
BLOCK_CELLS, LEAF = 1 << 19, 32
#: Components are whole numbers of at most so many bits; beyond it, distances are taken with unbounded integers.
PLAIN_BITS, MOST_BITS = 24, 62
_LONG = (1 << 63) - 1


# ---- trees

class Tree:
    """A balanced tree over the rows of ``x``, in heap order (children of k: 2k + 1, 2k + 2), levels full.

    ``order``: rows in tree order; ``first``: for each node of each level, where its rows begin there, plus the total;
    ``low``, ``high``: boxes by level; an empty node has no rows and is never visited."""

    def __init__(self, x: np.ndarray, leaf: int):
        n = len(x)
        depth = max(0, int(np.ceil(np.log2(max(n, 1) / leaf)))) if n > leaf else 0
        order = np.arange(n)
        first = np.array([0, n])
        self.first = [first]
        for _ in range(depth):
            cuts = [0]
            for a, b in zip(first[:-1], first[1:]):
                mid = (a + b) // 2
                if b - a > 1:
                    own = x[order[a:b]]
                    v = own[:, int(np.argmax(own.max(axis=0) - own.min(axis=0)))]
                    order[a:b] = order[a:b][np.argsort(v, kind="stable")]
                cuts += [mid, b]
            first = np.array(cuts)
            self.first.append(first)
        self.order, self.x = order, x[order]
        self.low, self.high = [], []
        for first in self.first:
            some = np.flatnonzero(np.diff(first) > 0)
            low = np.zeros((len(first) - 1, x.shape[1]), x.dtype)
            high = low.copy()
            if len(some):
                low[some] = np.minimum.reduceat(self.x, first[:-1][some], axis=0)
                high[some] = np.maximum.reduceat(self.x, first[:-1][some], axis=0)
            self.low.append(low)
            self.high.append(high)


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * b).sum(axis=1)


def _pruned(p: np.ndarray, ub: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Which pairs stay; ``p``: node of parts of each pair, ascending."""
    heads = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
    best = np.minimum.reduceat(ub, heads)
    return lb <= np.repeat(best, np.diff(np.append(heads, len(p))))


def assign(parts: Tree, book: np.ndarray) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, np.ndarray]]]:
    """Dual-tree assignment: (begin, end, entry) of runs of ``parts.order`` that were assigned whole, and
    (begin, end, candidate entries) of the leaves that need distances."""
    if not len(parts.order):
        return [], []
    entries = Tree(book, 1)
    name = entries.order
    e_bottom, p_bottom = len(entries.first) - 1, len(parts.first) - 1
    p, e, pl, el = np.zeros(1, np.int64), np.zeros(1, np.int64), 0, 0
    whole: list[tuple[int, int, int]] = []
    while True:
        lo, hi = parts.low[pl][p], parts.high[pl][p]
        e_lo, e_hi = entries.low[el][e], entries.high[el][e]
        gap = np.maximum(np.maximum(lo - e_hi, e_lo - hi), 0)
        span = np.maximum(hi - e_lo, e_hi - lo)
        most = _dots(span, span)
        stay = _pruned(p, most, _dots(gap, gap))
        if el == e_bottom:  # single entries: against the one of the smallest ``most`` in the node, over the whole box
            heads = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
            sizes = np.diff(np.append(heads, len(p)))
            by = np.lexsort((np.arange(len(p)), most, p))
            best = np.repeat(by[heads], sizes)
            apart = e_lo - e_lo[best]
            nearest = _dots(e_lo, e_lo) - _dots(e_lo[best], e_lo[best]) - 2 * _dots(np.where(apart > 0, hi, lo), apart)
            stay &= nearest <= 0  # of the difference of the two squared distances
            stay |= np.arange(len(p)) == best
        p, e = p[stay], e[stay]
        if el == e_bottom:
            heads = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
            alone = np.diff(np.append(heads, len(p))) == 1
            first = parts.first[pl]
            for k in heads[alone]:
                whole.append((int(first[p[k]]), int(first[p[k] + 1]), int(name[entries.first[el][e[k]]])))
            rest = np.repeat(~alone, np.diff(np.append(heads, len(p))))
            p, e = p[rest], e[rest]
            if pl == p_bottom or not len(p):
                break
        down_p, down_e = pl < p_bottom, el < e_bottom
        if down_p:
            p, e = np.concatenate([2 * p, 2 * p + 1]), np.tile(e, 2)
            pl += 1
        if down_e:
            p, e = np.tile(p, 2), np.concatenate([2 * e, 2 * e + 1])
            el += 1
        some = (parts.first[pl][p + 1] > parts.first[pl][p]) & (entries.first[el][e + 1] > entries.first[el][e])
        p, e = p[some], e[some]
        order = np.argsort(p, kind="stable")
        p, e = p[order], e[order]
    open_leaves = []
    if len(p):
        first, heads = parts.first[pl], np.flatnonzero(np.append(True, p[1:] != p[:-1]))
        found = name[entries.first[el][e]]
        for a, b in zip(heads, np.append(heads[1:], len(p))):
            open_leaves.append((int(first[p[a]]), int(first[p[a] + 1]), np.sort(found[a:b])))
    return whole, open_leaves


def nearest(x: np.ndarray, book: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """The candidate of the smallest squared distance for each row; ``candidates`` ascending, the first of equals wins."""
    own = book[candidates]
    return candidates[np.argmin(_dots(own, own)[None, :] - 2 * (x @ own.T), axis=1)]


# ---- blocks

def whole_numbers(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * x), within 62 bits."""
    bound = float(1 << MOST_BITS)
    return np.clip(np.floor(values.astype(np.float64) * SCALE), -bound, bound).astype(np.int64)


_BLOCK = pa.schema([("vec_ids", pa.binary()), ("null_ids", pa.binary()), ("labels", pa.binary()), ("null_labels", pa.binary()),
                    ("cells", pa.binary()), ("wide", pa.bool_()), *[(f"tree_{k}", pa.binary()) for k in range(PARTS)]])
BLOCK = "vec_ids binary, null_ids binary, labels binary, null_labels binary, cells binary, wide boolean, " + ", ".join(
    f"tree_{k} binary" for k in range(PARTS))


def _to_blocks(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(vec_id, label, vector) -> blocks with the order of a tree for each part."""
    rows_a_block = max(1, BLOCK_CELLS // width)

    def block(ids: list, labels: list, cells: np.ndarray) -> pa.RecordBatch:
        longs = lambda v: np.array([0 if x is None else x for x in v], "<i8").tobytes()
        nulls = lambda v: np.array([x is None for x in v], np.uint8).tobytes()
        wide = bool(len(cells)) and bool((np.abs(cells) >= 1 << 31).any())
        size = width // PARTS
        orders = [Tree(_plain(cells[:, k * size: (k + 1) * size]), LEAF).order.astype("<u4").tobytes() for k in range(PARTS)]
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(
            [longs(ids), nulls(ids), longs(labels), nulls(labels), cells.astype("<i8" if wide else "<i4").tobytes(), wide, *orders],
            _BLOCK.types)], schema=_BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, held = [], [], []
        for batch in batches:
            for lo in range(0, batch.num_rows, rows_a_block):
                piece = batch.slice(lo, rows_a_block)
                vectors = piece.column(2)
                lengths = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                values = vectors.flatten().to_numpy(zero_copy_only=False)
                cells = np.zeros((piece.num_rows, width), np.int64)
                row = np.repeat(np.arange(piece.num_rows), lengths)
                cells[row, np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = whole_numbers(values)
                ids += piece.column(0).to_pylist()
                labels += piece.column(1).to_pylist()
                held.append(cells)
                while len(ids) >= rows_a_block:
                    every = np.concatenate(held)
                    yield block(ids[:rows_a_block], labels[:rows_a_block], every[:rows_a_block])
                    ids, labels, held = ids[rows_a_block:], labels[rows_a_block:], [every[rows_a_block:]]
        if ids:
            yield block(ids, labels, np.concatenate(held))

    return run


def _plain(x: np.ndarray) -> np.ndarray:
    """As it is where squared distances fit 64 bits, else as unbounded integers."""
    return x.astype(object) if len(x) and np.abs(x).max() >= 1 << PLAIN_BITS else x


class _Kept(Tree):
    """A tree from the order it had when the block was written."""

    def __init__(self, x: np.ndarray, order: np.ndarray):
        n = len(x)
        depth = max(0, int(np.ceil(np.log2(n / LEAF)))) if n > LEAF else 0
        self.order, self.x = order, x[order]
        first = np.array([0, n])
        self.first, self.low, self.high = [first], [], []
        for _ in range(depth):
            first = np.append(np.stack([first[:-1], (first[:-1] + first[1:]) // 2], axis=1).reshape(-1), n)
            self.first.append(first)
        for first in self.first[::-1]:
            some = np.flatnonzero(np.diff(first) > 0)
            low = np.zeros((len(first) - 1, x.shape[1]), x.dtype)
            high = low.copy()
            low[some] = np.minimum.reduceat(self.x, first[:-1][some], axis=0)
            high[some] = np.maximum.reduceat(self.x, first[:-1][some], axis=0)
            self.low.insert(0, low)
            self.high.insert(0, high)
        # sums of all rows before each, so that any run's sums are one difference
        self.before = np.concatenate([np.zeros((1, x.shape[1]), x.dtype), np.cumsum(self.x, axis=0, dtype=x.dtype)])


def _trees(row: dict, width: int, books: list[np.ndarray]) -> Iterator[tuple[int, _Kept, np.ndarray]]:
    """(part, its tree, its codebook) of a block; unbounded integers where either needs them."""
    cells = np.frombuffer(row["cells"], "<i8" if row["wide"] else "<i4").astype(np.int64).reshape(-1, width)
    size = width // PARTS
    for k in range(PARTS):
        x = _plain(np.ascontiguousarray(cells[:, k * size: (k + 1) * size]))
        book = books[k]
        if x.dtype != book.dtype:
            x, book = x.astype(object), book.astype(object)
        yield k, _Kept(x, np.frombuffer(row[f"tree_{k}"], "<u4").astype(np.int64)), book


def _sums(width: int, books: list[np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks -> (part, entry, position, sum as text, count), added up over the task."""
    size = width // PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], list] = {}
        for batch in batches:
            for row in batch.to_pylist():
                for k, tree, book in _trees(row, width, books):
                    whole, open_leaves = assign(tree, book)

                    def add(entry: int, sums: np.ndarray, count: int) -> None:
                        own = total.setdefault((k, entry), [0, np.zeros(size, object)])
                        own[0] += count
                        own[1] = own[1] + sums.astype(object)

                    for a, b, entry in whole:
                        add(entry, tree.before[b] - tree.before[a], b - a)
                    if open_leaves:
                        sums, counts = np.zeros((len(book), size), book.dtype), np.zeros(len(book), np.int64)
                        for a, b, candidates in open_leaves:
                            to = nearest(tree.x[a:b], book, candidates)
                            np.add.at(sums, to, tree.x[a:b])
                            counts += np.bincount(to, minlength=len(book))
                        for entry in np.flatnonzero(counts):
                            add(int(entry), sums[entry], int(counts[entry]))
        if total:
            yield pa.RecordBatch.from_pandas(pd.DataFrame(
                [(k, entry, j, str(s), n) for (k, entry), (n, sums) in sorted(total.items()) for j, s in enumerate(sums)],
                columns=["part", "entry", "at", "total", "n"]), schema=_SUMS, preserve_index=False)

    return run


SUMS = "part int, entry int, at int, total string, n long"
_SUMS = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("at", pa.int32()), ("total", pa.string()), ("n", pa.int64())])
CODES = "vec_id long, label long, code string, error decimal(38,0)"
_CODES = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("code", pa.string()), ("error", pa.decimal128(38, 0))])


def _codes(width: int, books: list[np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, labels = (np.frombuffer(row[c], "<i8") for c in ("vec_ids", "labels"))
                no_id, no_label = (np.frombuffer(row[c], np.uint8).astype(bool) for c in ("null_ids", "null_labels"))
                code, error = np.zeros((len(ids), PARTS), np.int64), np.zeros(len(ids), object)
                for k, tree, book in _trees(row, width, books):
                    whole, open_leaves = assign(tree, book)
                    to = np.zeros(len(ids), np.int64)
                    for a, b, entry in whole:
                        to[a:b] = entry
                    for a, b, candidates in open_leaves:
                        to[a:b] = nearest(tree.x[a:b], book, candidates)
                    apart = tree.x - book[to]
                    code[tree.order, k] = to
                    error[tree.order] += _dots(apart, apart).astype(object)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, mask=no_id), pa.array(labels, mask=no_label), pa.array([bytes(c).hex() for c in code.astype(np.uint8)]),
                     pa.array([Decimal(int(e)) for e in error], pa.decimal128(38, 0))], schema=_CODES)

    return run


def _first_entries(vectors: DataFrame, width: int) -> list[np.ndarray]:
    """Codebooks of the parts of the ENTRIES smallest vec_ids (repeated ones by their vectors, null ids last)."""
    ids = [r[0] for r in vectors.select("vec_id").orderBy(F.col("vec_id").asc_nulls_last()).limit(ENTRIES).collect()]
    near = vectors if len(ids) < ENTRIES or None in ids else vectors.filter(F.col("vec_id") <= max(ids))
    rows = near.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(ENTRIES).select("vector").collect()
    cells = np.zeros((len(rows), width), np.int64)
    for k, r in enumerate(rows):
        cells[k, : len(r["vector"])] = whole_numbers(np.array(r["vector"], np.float64))
    size = width // PARTS
    return [_plain(np.ascontiguousarray(cells[:, k * size: (k + 1) * size])) for k in range(PARTS)]


def train(blocks: DataFrame, width: int, books: list[np.ndarray], rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebooks after ``rounds`` rounds; an entry without parts stays."""
    for _ in range(rounds):
        found = blocks.mapInArrow(_sums(width, books), SUMS).groupBy("part", "entry", "at").agg(
            F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect()
        books = [b.astype(object) for b in books]
        for r in found:  # PARTS * ENTRIES * (width / PARTS) rows at most
            books[r["part"]][r["entry"], r["at"]] = int(r["total"]) // r["n"]
        books = [b if len(b) and max(map(abs, b.reshape(-1))) >= 1 << PLAIN_BITS else b.astype(np.int64) for b in books]
    return books


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(v)) for b in books for v in b.reshape(-1)).encode()).hexdigest()


def compress(embeddings: DataFrame) -> tuple[DataFrame, list[np.ndarray]]:
    """((vec_id, label, code, error), final codebooks) of ``embeddings`` (vec_id, embedding, label).

    A row whose vector is null or holds a null, NaN or infinite component is dropped; every other row is coded, rows that
    repeat a vec_id or have none too.  Vectors shorter than the longest, or of a length that PARTS does not divide, count as
    padded with zeros (an empty vector is all zeros).  Fewer than ENTRIES rows give as many entries; no rows, no codes.
    Components of 2^52 or more in size count as 2^52.  Other columns are ignored.
    """
    vector = F.col("embedding").cast("array<double>")
    vectors = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), vector.alias("vector"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    vectors = vectors.filter(F.col("vector").isNotNull() & F.forall("vector", finite))
    longest = vectors.agg(F.max(F.size("vector")).alias("n")).first()["n"] or 0
    width = max(PARTS, -(-longest // PARTS) * PARTS)
    blocks = kept(vectors.mapInArrow(_to_blocks(width), BLOCK), "vector-blocks")
    books = train(blocks, width, _first_entries(vectors, width))
    return blocks.mapInArrow(_codes(width, books), CODES), books


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = compress(table(spark, sf_dir, "embeddings"))
    codes = kept(codes, "vector-codes")
    by_label = codes.groupBy("label").agg(F.sum("error").alias("label_error"))
    own = by_label.select(F.col("label").alias("_label"), "label_error")
    long = lambda c: F.least(F.col(c), F.lit(_LONG).cast("decimal(38,0)")).cast("long").alias(c)
    return codes.join(own, F.col("label").eqNullSafe(F.col("_label"))).select(
        "vec_id", "code", long("error"), long("label_error"), F.lit(digest(books)).alias("codebooks_sha256"))


def _oracle() -> str:
    """Plain Lloyd rounds, one block of common tables a round; a product of parts and entries stands for the trees."""
    text = f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS c FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (
  SELECT vec_id, label, k.k, c[1 + k.k * (len(c) // {PARTS}): (1 + k.k) * (len(c) // {PARTS})] AS x FROM v, range({PARTS}) k(k)),
b0 AS MATERIALIZED (
  SELECT k, row_number() OVER (PARTITION BY k ORDER BY vec_id) - 1 AS e, x AS y FROM p
  WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT {ENTRIES}))"""
    squared = "list_sum(list_transform(list_zip(p.x, b.y), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    for r in range(ROUNDS + 1):
        text += f""",
a{r} AS MATERIALIZED (
  SELECT vec_id, label, k, any_value(x) AS x, min([d, e]) AS best FROM (
    SELECT p.vec_id, p.label, p.k, p.x, b.e, CAST({squared} AS BIGINT) AS d FROM p JOIN b{r} b ON b.k = p.k) GROUP BY vec_id, label, k)"""
        if r < ROUNDS:
            text += f""",
s{r} AS (
  SELECT k, e, j, sum(val) AS s, count(*) AS n FROM (
    SELECT k, best[2] AS e, unnest(range(len(x))) AS j, unnest(x) AS val FROM a{r}) GROUP BY k, e, j),
m{r} AS (
  SELECT k, e, list(CAST((s - (((s % n) + n) % n)) // n AS BIGINT) ORDER BY j) AS y FROM s{r} GROUP BY k, e),
b{r + 1} AS MATERIALIZED (
  SELECT b.k, b.e, coalesce(m.y, b.y) AS y FROM b{r} b LEFT JOIN m{r} m ON m.k = b.k AND m.e = b.e)"""
    return text + f""",
f AS (
  SELECT vec_id, label, string_agg(printf('%02x', best[2]), '' ORDER BY k) AS code, CAST(sum(best[1]) AS BIGINT) AS error
  FROM a{ROUNDS} GROUP BY vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY k, e)) FROM b{ROUNDS}) AS codebooks_sha256
FROM f"""


#: For tables without repeated vec_ids and with vectors of one length.
ORACLE = _oracle()
