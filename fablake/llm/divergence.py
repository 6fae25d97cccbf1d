"""How far the sources of a language differ in their words, by a k-squared quadtree over group-term counts.

The counts of a language are a matrix: a row for each group (language, source), a column for each kept term.  A cell's smoothed
share is ``p = 1 + floor(10^9 * (count + 1) / (N + V))``; an empty cell's depends on its group alone.  For two groups, the value is
the sum over all V terms of ``floor((p - q)^2 / q)``.

*Quadtree.*  Columns are dealt into blocks of about ``BLOCK_TERMS``, groups into tiles of ``TILE``; a task gets the cells of one
block and two tiles.  Each tile's part of the block is a k-squared tree: bits by level, four children for every quadrant that is not
all zero, a child found by the number of set bits before it.  Columns that the same groups hold stand side by side, so that
zeros come in large quadrants.

*Joint traversal.*  Both trees go down together over all pairs of row ranges.  Where both quadrants are zero, every column there
has the same value for a pair of groups: it is counted, not visited, and priced as columns times that value.  Where one or both have
cells, the traversal goes on to leaves, whose cells are priced one by one.  Columns that neither tile has are priced the same way at
the end.  All arithmetic is in whole numbers; shares are computed in decimals, so counts may grow past 64 bits of product.

Words are counted in the tasks that read the texts, once for each run of texts and group, and added up by (language, source, term).
Terms of a language are told apart by their text; inside a block by a 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fablake.llm import textscan as ts
from fablake.llm.common import kept, table

LEAST_DOCUMENTS, TOP_TERMS, UNIT = 3, 200, 1_000_000_000
BLOCK_TERMS, TILE = 2048, 64
#: Halvings of a tile's rows and of a block's columns; leaves have TILE / 2^LEVELS rows.
LEVELS = 5
#: Cells of leaves that are priced at a time.
LEAF_CELLS = 1 << 20
U64 = np.uint64
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0x80:] = True

# ---- counts

COUNTS = "lang string, source string, term string, count long, docs long"
_COUNTS = pa.schema([("lang", pa.large_string()), ("source", pa.large_string()), ("term", pa.large_string()),
                     ("count", pa.int64()), ("docs", pa.int64())])


def _pieces(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """The spans as an Arrow string column."""
    offsets = np.zeros(len(begin) + 1, np.int64)
    np.cumsum(end - begin, out=offsets[1:])
    at = np.arange(offsets[-1]) + np.repeat(begin - offsets[:-1], end - begin)
    return pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[at])))


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) -> occurrences and texts of each term of each group, run of texts by run of texts."""
    for batch in batches:
        lang, source = (batch.column(k).dictionary_encode() for k in (0, 1))
        group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
        for scan in ts.scans(batch):
            begin, end = scan._spans(_LETTER[scan.data])
            if not len(begin):
                continue
            text = np.searchsorted(scan.bounds, begin, "right") - 1
            of = group[scan.first + text]
            key = ts.mix(scan.hashes(begin, end, lower=True) + ts.mix(of.astype(U64) + U64(1)))
            order = np.argsort(key, kind="stable")
            key, text = key[order], text[order]
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            at = np.flatnonzero(new)
            new[1:] |= text[1:] != text[:-1]
            first = order[at]
            which = of[first]
            yield pa.RecordBatch.from_arrays(
                [lang.dictionary.cast(pa.large_string()).take(pa.array(which // len(source.dictionary))),
                 source.dictionary.cast(pa.large_string()).take(pa.array(which % len(source.dictionary))),
                 _pieces(ts.LOWER[scan.data], begin[first], end[first]), pa.array(np.diff(np.append(at, len(key)))),
                 pa.array(np.add.reduceat(new.astype(np.int64), at))], schema=_COUNTS)


def term_cells(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cells, groups): cells (lang, source, term, count, lang_count, leads) of the kept terms, one row for each group that has the
    term, ``leads`` on one row of each term; groups (lang, source), all that occur."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    docs = documents.select(empty("lang"), empty("source"), empty("text"))
    counts = docs.mapInArrow(_term_counts, COUNTS).groupBy("lang", "source", "term").agg(
        F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    cells = counts.withColumns({"in_docs": F.sum("docs").over(term), "lang_count": F.sum("count").over(term),
                                "leads": F.col("source") == F.min("source").over(term)})
    cells = cells.filter(F.col("in_docs") >= LEAST_DOCUMENTS).drop("docs", "in_docs")
    return kept(cells, "term-cells"), docs.select("lang", "source").distinct()


# ---- shares

def _share(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(UNIT * (count + 1) / (n + v)), by way of decimals."""
    top = F.lit(UNIT).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)")
    return F.lit(1) + F.call_function("div", top, (n + v).cast("decimal(20,0)")).cast("long")


def _distance(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q)."""
    return F.call_function("div", (p - q) * (p - q), q)


def group_stats(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, gi, n, lang_n, v, blocks): n, lang_n occurrences of kept terms in the group and its language, v kept terms,
    gi the group's row in its language's matrix (larger groups first)."""
    n = cells.groupBy("lang", "source").agg(F.sum("count").alias("n"), F.count_if("leads").alias("own"))
    stats = groups.join(n, ["lang", "source"], "left").fillna(0, ["n", "own"])
    lang = Window.partitionBy("lang")
    stats = stats.withColumns({"lang_n": F.sum("n").over(lang), "v": F.sum("own").over(lang),
                               "gi": F.row_number().over(lang.orderBy(F.col("n").desc(), "source")) - 1,
                               "tiles": F.ceil(F.count("*").over(lang) / TILE).cast("int")})
    stats = stats.withColumn("blocks", F.ceil(F.col("v") / BLOCK_TERMS).cast("int")).withColumn(
        "p0", F.when(F.col("v") > 0, _share(F.lit(0), F.col("n"), F.col("v"))))
    return kept(stats.drop("own"), "group-stats")


def shares(cells: DataFrame, stats: DataFrame) -> DataFrame:
    """cells with the group's row, and p and q, the shares of the group and of its language."""
    about = stats.select("lang", "source", "gi", "n", "lang_n", "v", "tiles", "blocks")
    return cells.join(about, ["lang", "source"]).withColumns({
        "p": _share(F.col("count"), F.col("n"), F.col("v")), "q": _share(F.col("lang_count"), F.col("lang_n"), F.col("v"))})


# ---- quadtree

class Quadtree:
    """A k-squared tree (k = 2) over a matrix; ``bits[l]`` are the children of the set quadrants of level l - 1, four for each in the order
    (upper left, upper right, lower left, lower right); the last level's set bits own a tile of ``leaves``."""

    def __init__(self, matrix: np.ndarray):
        rows, columns = matrix.shape
        r, c = rows >> LEVELS, columns >> LEVELS
        level = (matrix != 0).reshape(1 << LEVELS, r, 1 << LEVELS, c).any(axis=(1, 3))
        pyramid = [level]
        for _ in range(LEVELS):
            side = len(pyramid[-1]) // 2
            pyramid.append(pyramid[-1].reshape(side, 2, side, 2).any(axis=(1, 3)))
        pyramid.reverse()
        self.some = bool(pyramid[0][0, 0])
        self.bits, self.before = [], []
        row, column = (np.zeros(int(self.some), np.int64) for _ in range(2))
        for grid in pyramid[1:]:
            row = (2 * row[:, None] + np.array([0, 0, 1, 1])).reshape(-1)
            column = (2 * column[:, None] + np.array([0, 1, 0, 1])).reshape(-1)
            bits = grid[row, column]
            self.bits.append(bits)
            self.before.append(np.cumsum(bits) - bits)
            row, column = row[bits], column[bits]
        tiles = matrix.reshape(1 << LEVELS, r, 1 << LEVELS, c)
        self.leaves = np.ascontiguousarray(tiles[row, :, column, :]) if len(row) else np.zeros((0, r, c), matrix.dtype)

    def child(self, level: int, node: np.ndarray, quadrant: np.ndarray) -> np.ndarray:
        """Number of the child among the set quadrants of its level, -1 where it is all zero; node -1 stands for a zero quadrant."""
        out = np.full(len(node), -1, np.int64)
        there = np.flatnonzero(node >= 0)
        at = 4 * node[there] + quadrant[there]
        out[there] = np.where(self.bits[level][at], self.before[level][at], -1) if len(there) else -1
        return out


def price(a: np.ndarray, b: np.ndarray, a0: np.ndarray, b0: np.ndarray, back: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """(sum over the columns of floor((p - q)^2 / q) for p of a row of ``a`` and q of a row of ``b``; with ``back``, the same the other
    way).  0 in a matrix stands for the row's share of an empty cell, ``a0``, ``b0``."""
    rows, columns = a.shape
    trees = Quadtree(a), Quadtree(b)
    out = [np.zeros((rows, len(b)), np.int64) for _ in range(1 + back)]
    empty = np.zeros((rows, len(b)), np.int64)  # columns of quadrants that are zero in both

    def zero(level: int, at_a: np.ndarray, at_b: np.ndarray) -> None:
        counts = np.zeros((1 << level, 1 << level), np.int64)
        np.add.at(counts, (at_a, at_b), columns >> level)
        size = rows >> level
        empty[:] += np.repeat(np.repeat(counts, size, axis=0), size, axis=1)

    na, nb = (np.array([0 if t.some else -1]) for t in trees)
    at_a = at_b = np.zeros(1, np.int64)
    # children: row half of a, row half of b, column half
    ra, rb, rc = (x.reshape(-1) for x in np.meshgrid([0, 1], [0, 1], [0, 1], indexing="ij"))
    for level in range(LEVELS + 1):
        both = (na < 0) & (nb < 0)
        if both.any():
            zero(level, at_a[both], at_b[both])
            na, nb, at_a, at_b = (x[~both] for x in (na, nb, at_a, at_b))
        if level == LEVELS or not len(na):
            break
        n = len(na)
        wide = lambda x: np.repeat(x, 8)
        many = lambda x: np.tile(x, n)
        at_a, at_b, next_a, next_b = 2 * wide(at_a) + many(ra), 2 * wide(at_b) + many(rb), wide(na), wide(nb)
        na = trees[0].child(level, next_a, many(2 * ra + rc))
        nb = trees[1].child(level, next_b, many(2 * rb + rc))
    size, width = rows >> LEVELS, columns >> LEVELS
    step = max(1, LEAF_CELLS // (size * size * width))
    tile_a0, tile_b0 = a0.reshape(-1, size), b0.reshape(-1, size)
    blank = np.zeros((1, size, width), a.dtype)
    leaves = [np.concatenate([t.leaves, blank]) for t in trees]  # -1 takes the blank one
    views = [o.reshape(1 << LEVELS, size, 1 << LEVELS, size) for o in out]
    for lo in range(0, len(na), step):
        s = slice(lo, lo + step)
        p = leaves[0][na[s]]
        q = leaves[1][nb[s]]
        p = np.where(p == 0, tile_a0[at_a[s]][:, :, None], p)[:, :, None, :]
        q = np.where(q == 0, tile_b0[at_b[s]][:, :, None], q)[:, None, :, :]
        square = (p - q) ** 2
        for view, by in zip(views, (q, p)):
            np.add.at(view, (at_a[s], slice(None), at_b[s], slice(None)), (square // by).sum(axis=3))
    first = (a0[:, None] - b0[None, :]) ** 2
    out[0] += empty * (first // b0[None, :])
    if back:
        out[1] += empty * (first // a0[:, None])
    return out[0], out[1] if back else None


_PAIRS = pa.schema([("lang", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("value", pa.int64()), ("columns", pa.int64())])


def _block_pairs(key: tuple, rows: pa.Table) -> pa.Table:
    """The cells of one block and two tiles (term null: a group's share of an empty cell) -> the pairs' sums over the block's columns
    that either tile has."""
    lang, i, j = (k.as_py() for k in key[:3])
    gi, term, p = (rows.column(c).to_numpy() for c in ("gi", "h", "p"))
    blank = rows.column("empty").to_numpy().astype(bool)
    sides = []
    terms, column = np.unique(term[~blank], return_inverse=True)
    width = max(1, -(-len(terms) // (1 << LEVELS))) << LEVELS
    tile = gi // TILE
    # columns that the same groups hold stand side by side
    holders = np.bincount(column, minlength=len(terms))
    least = np.full(len(terms), np.iinfo(np.int64).max)
    np.minimum.at(least, column, gi[~blank])
    place = np.zeros(len(terms), np.int64)
    place[np.lexsort((least, -holders))] = np.arange(len(terms))
    for t in (i, j):
        matrix, base = np.zeros((TILE, width), np.int64), np.ones(TILE, np.int64)
        own = tile[~blank] == t
        matrix[gi[~blank][own] - t * TILE, place[column[own]]] = p[~blank][own]
        mine = blank & (tile == t)
        base[gi[mine] - t * TILE] = p[mine]
        sides.append((matrix, base, np.sort(gi[mine])))
    (a, a0, in_a), (b, b0, in_b) = sides
    there, back = price(a, b, a0, b0, i != j)
    # the tree is wider than the block: those columns are empty and were priced as such
    extra = width - len(terms)
    first = (a0[:, None] - b0[None, :]) ** 2
    there -= extra * (first // b0[None, :])
    if back is not None:
        back -= extra * (first // a0[:, None])
    x, y = np.repeat(in_a, len(in_b)), np.tile(in_b, len(in_a))
    values = there[x - i * TILE, y - j * TILE]
    if back is not None:
        values = np.concatenate([values, back[x - i * TILE, y - j * TILE]])
        x, y = np.concatenate([x, y]), np.concatenate([y, x])
    other = x != y
    n = int(other.sum())
    return pa.Table.from_arrays([pa.array([lang] * n, pa.string()), pa.array(x[other], pa.int32()), pa.array(y[other], pa.int32()),
                                 pa.array(values[other]), pa.array(np.full(n, len(terms)))], schema=_PAIRS)


def pair_values(cells: DataFrame, stats: DataFrame) -> DataFrame:
    """(lang, source, item, value) for all ordered pairs of two sources of a language; ``cells`` as ``shares`` gives them."""
    term = F.xxhash64("term")
    filled = cells.select("lang", F.pmod(term, "blocks").cast("int").alias("block"), "tiles", F.col("gi").cast("int").alias("gi"),
                          F.xxhash64("term", F.lit(1)).alias("h"), "p", F.lit(False).alias("empty"))
    blank = stats.filter("v > 0").select("lang", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "tiles",
                                         F.col("gi").cast("int").alias("gi"), F.lit(0).cast("long").alias("h"), F.col("p0").alias("p"),
                                         F.lit(True).alias("empty"))
    own = F.floor(F.col("gi") / TILE).cast("int")
    rows = filled.unionByName(blank).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.select("lang", F.least(own, "other").alias("i"), F.greatest(own, "other").alias("j"), "block", "gi", "h", "p", "empty")
    sums = rows.groupBy("lang", "i", "j", "block").applyInArrow(_block_pairs, "lang string, a int, b int, value long, columns long")
    sums = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("columns").alias("columns"))
    left = stats.select("lang", "source", F.col("gi").alias("a"), F.col("p0").alias("pa"), "v")
    right = stats.select("lang", F.col("source").alias("item"), F.col("gi").alias("b"), F.col("p0").alias("pb"))
    pairs = left.join(right, "lang").filter(F.col("a") != F.col("b")).join(sums, ["lang", "a", "b"], "left")
    rest = F.when(F.col("v") > 0, (F.col("v") - F.coalesce("columns", F.lit(0))) * _distance(F.col("pa"), F.col("pb"))).otherwise(0)
    return pairs.select("lang", "source", "item", (F.coalesce("value", F.lit(0)) + rest).alias("value"))


def audit(documents: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank) of ``documents`` (text, lang, source).

    Null text, lang and source count as empty.  Part ``pair``: all other sources of the language; a language of one source has no such
    row, and without a kept term every value is 0.  Part ``term``: the terms that the group uses more than its language,
    the first ``TOP_TERMS``.  Ranks are from 1 by value descending, then item ascending (UTF-8).  Every row counts, repeated
    rows too; an empty table gives no rows.  Other columns are ignored.
    """
    cells, groups = term_cells(documents)
    stats = group_stats(cells, groups)
    cells = shares(cells, stats)
    terms = cells.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                                         _distance(F.col("p"), F.col("q")).alias("value"))
    pairs = pair_values(cells, stats).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    terms = terms.withColumn("rank", rank).filter(F.col("rank") <= TOP_TERMS)
    return pairs.withColumn("rank", rank).unionByName(terms)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


#: A product of all pairs of groups with all terms of their language.
ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  row_number() OVER () AS r FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
o AS (SELECT lang, source, r, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                        '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS lc FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= {LEAST_DOCUMENTS}),
c AS (SELECT o.lang, source, o.term, count(*) AS c FROM o JOIN k ON k.lang = o.lang AND k.term = o.term GROUP BY o.lang, source, o.term),
v AS (SELECT lang, count(*) AS v, CAST(sum(lc) AS BIGINT) AS n FROM k GROUP BY lang),
n AS (SELECT g.lang, g.source, CAST(coalesce(sum(c.c), 0) AS BIGINT) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY g.lang, g.source),
p AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c,
          CAST(1 + (CAST({UNIT} AS HUGEINT) * (coalesce(c.c, 0) + 1)) // (n.n + v.v) AS BIGINT) AS p,
          CAST(1 + (CAST({UNIT} AS HUGEINT) * (k.lc + 1)) // (v.n + v.v) AS BIGINT) AS q
        FROM g JOIN k ON k.lang = g.lang JOIN v ON v.lang = g.lang JOIN n ON n.lang = g.lang AND n.source = g.source
        LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pair AS (SELECT a.lang, a.source, b.source AS item, CAST(coalesce(sum((x.p - y.p) * (x.p - y.p) // y.p), 0) AS BIGINT) AS value
         FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
         LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source
         LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY a.lang, a.source, b.source),
term AS (SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM p WHERE c > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pair
UNION ALL SELECT * FROM (SELECT lang, source, 'term' AS part, item, value,
  CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM term) WHERE rank <= {TOP_TERMS}
"""
