"""Near duplicates by fast similarity sketching, banding and exact verification.

*Sketch* (Dahlgaard, Knudsen, Thorup, "Fast Similarity Sketching", FOCS 2017).  A document's set
of 5-word shingles fills ``COORDINATES`` bins.  In round r < t every shingle is hashed to a bin and
a value in [r, r+1); in round t <= r < 2t all shingles go to bin r - t.  A bin keeps its smallest
value, and rounds end once every bin is filled: every coordinate is always filled, a small set
needs about t ln t hash values instead of t for each shingle, and two sketches agree in a share
of coordinates that concentrates around the Jaccard similarity.

*Banding.*  ``BANDS`` bands of ``ROWS`` coordinates.  Two sets of similarity 0.75 share no band with
a chance of (1 - 0.75^5)^51, about one in a million; at 0.8 it is one in a thousand million.

*Verification* is exact, on the full sets of both texts (64-bit shingle hashes).

Groups of copies never meet pair by pair.  Texts with equal sets are one class first.  In a bucket,
each class is compared with two hubs, and linked classes form components.  A bucket that then holds one
component is done: its other pairs cannot change the result.  Classes of the other buckets (most share
a frequent passage and little else) are joined exactly, by prefix filtering: shingles are ordered by how
many of these classes have them, and two sets of similarity 0.75 must share one of the rarest
n - ceil(0.75 n) + 1 of each.  A passage that many hold is at the end of that order and proposes nothing,
also where it reaches into those: what can stand behind it is too little (positional filter).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fablake.llm import textscan as ts
from fablake.llm.common import kept, table
from fablake.llm.components import components

SHINGLE = 5
PERCENT = 75
COORDINATES, BANDS, ROWS = 256, 51, 5
#: Two bits of each coordinate make a digest. At similarity 0.75 two digests differ in 48 of 256
#: places on average, standard deviation 6.2; 80 is 5.2 deviations more. It only saves comparisons.
DIGEST_LONGS, PLACES_APART = 8, 80
#: Up to so many ids (8 bytes each) are broadcast to pick texts out of the documents.
BROADCAST_IDS = 500_000
#: Ratio of neighbouring size bands in the join of prefixes; holders of a shingle that one salt stands for.
BAND_RATIO, SALT_ROWS = 1.1, 2_000
U64 = np.uint64
_WORD = ts.stream(2, SHINGLE)
_ROUND = ts.stream(3, 2 * COORDINATES)
_ROW = ts.stream(4, BANDS * ROWS).reshape(BANDS, ROWS)
_SET = ts.stream(5, 2)


def shingle_sets(scan: ts.Scan) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes grouped by text and sorted, first of each text plus the total)."""
    begin, end, words_at = scan.words()
    word = scan.hashes(begin, end, lower=True)
    count = np.diff(words_at)
    text = ts.text_index(words_at)
    n = len(word)
    total = np.zeros(n, U64)
    for j in range(SHINGLE):
        total[: n - j] += word[j:] * _WORD[j] if n > j else U64(0)
    position = np.arange(n) - words_at[text]
    whole = position + SHINGLE <= count[text]
    few = np.flatnonzero((count < SHINGLE) & (count > 0))
    for i in few:  # fewer words than a shingle: the sequence is the shingle; its length marks it
        a, b = words_at[i], words_at[i + 1]
        with np.errstate(over="ignore"):
            total[a] = (word[a:b] * _WORD[: b - a]).sum(dtype=U64) + U64(b - a)
        whole[a] = True
    hashes, text = ts.mix(total[whole]), text[whole]
    order = ts.order_by_text(hashes, text)
    hashes, text = hashes[order], text[order]
    first = np.ones(len(hashes), bool)
    first[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    hashes, text = hashes[first], text[first]
    return hashes, np.searchsorted(text, np.arange(scan.rows + 1))


def sketches(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The sketch of each set, one row each; rows of empty sets are undefined."""
    t, rows, free = COORDINATES, len(at) - 1, np.iinfo(U64).max
    text = ts.text_index(at)
    out = np.full((rows, t), free, U64)
    flat = out.reshape(-1)
    open_sets = np.flatnonzero(np.diff(at) > 0)
    for r in range(2 * t):
        if not len(hashes):
            break
        g = ts.mix(hashes ^ _ROUND[r])
        bins = (g & U64(t - 1)).astype(np.int64) if r < t else np.full(len(g), r - t)
        np.minimum.at(flat, text * t + bins, (g >> U64(9)) | U64(r << 55))
        still = (out[open_sets] == free).any(axis=1)
        if not still.all():
            open_sets = open_sets[still]
            go_on = np.zeros(rows, bool)
            go_on[open_sets] = True
            go_on = go_on[text]
            hashes, text = hashes[go_on], text[go_on]
    return out


SIGNATURE = ("doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, digest array<long>")
_SIGNATURE = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()),
                        ("bands", pa.list_(pa.int64())), ("digest", pa.list_(pa.int64()))])


def _lists(values: np.ndarray) -> pa.ListArray:
    rows, width = values.shape
    return pa.ListArray.from_arrays(np.arange(rows + 1, dtype=np.int32) * width,
                                    pa.array(np.ascontiguousarray(values).reshape(-1).view(np.int64)))


def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) -> set size, 128-bit identity of the set, band keys and digest."""
    for batch in batches:
        ids = batch.column(0).cast(pa.int64())
        for scan in ts.scans(batch):
            hashes, at = shingle_sets(scan)
            sketch = sketches(hashes, at)
            bands = np.stack([ts.mix((sketch[:, b * ROWS: (b + 1) * ROWS] * _ROW[b]).sum(axis=1, dtype=U64) + U64(b))
                              for b in range(BANDS)], axis=1)
            two_bits = (sketch & U64(3)).reshape(scan.rows, DIGEST_LONGS, 32)
            digest = (two_bits << (np.arange(32, dtype=U64) * U64(2))).sum(axis=2, dtype=U64)
            identity = [ts.sums(ts.mix(hashes ^ s), at).view(np.int64) for s in _SET]
            yield pa.RecordBatch.from_arrays(
                [ids.slice(scan.first, scan.rows), pa.array(np.diff(at).astype(np.int64)),
                 pa.array(identity[0]), pa.array(identity[1]), _lists(bands), _lists(digest)], schema=_SIGNATURE)


_SETS = pa.schema([("doc_id", pa.int64()), ("shingles", pa.list_(pa.int64()))])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) -> the whole set, sorted, one row for each text that has words."""
    for batch in batches:
        ids = batch.column(0)
        for scan in ts.scans(batch):
            hashes, at = shingle_sets(scan)
            lists = pa.ListArray.from_arrays(at.astype(np.int32), pa.array(hashes.view(np.int64)))
            yield pa.RecordBatch.from_arrays([ids.slice(scan.first, scan.rows), lists], schema=_SETS).filter(pa.array(np.diff(at) > 0))


def _apart(a: str, b: str) -> Column:
    """Number of places in which two digests differ."""
    def places(i: int) -> Column:
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))

    return sum((places(i) for i in range(DIGEST_LONGS)), F.lit(0))


def _texts(docs: DataFrame, ids: DataFrame, count: int) -> DataFrame:
    """The texts of these documents, by document, repeated rows once.  ``count`` bounds the number of ids."""
    found = docs.join(F.broadcast(ids) if count <= BROADCAST_IDS else ids, "doc_id", "left_semi")
    return found.withColumn("_hash", F.xxhash64("text")).repartition("doc_id").dropDuplicates(["doc_id", "_hash"]).drop("_hash")


def _linked(pairs: DataFrame, about: DataFrame, docs: DataFrame, by_digest: bool) -> DataFrame:
    """Those of the distinct pairs (u, v) that are linked.  Sizes apart by more than the threshold exclude a link for certain,
    before a set is fetched; so do, ``by_digest``, digests far apart, but for one pair of similarity 0.75 in ten million.
    The rest is decided on the full sets, row by row."""
    left = about.select(F.col("rep").alias("u"), F.col("n_shingles").alias("u_n"), F.col("digest").alias("u_d"))
    right = about.select(F.col("rep").alias("v"), F.col("n_shingles").alias("v_n"), F.col("digest").alias("v_d"))
    near = pairs.join(left, "u").join(right, "v").filter(_sizes("u_n", "v_n"))
    if by_digest:
        near = near.filter(_apart("u_d", "v_d") <= PLACES_APART)
    near = kept(near.select("u", "v"), "pairs")
    ids = near.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct()
    sets = kept(_texts(docs, ids, 2 * near.count()).select("doc_id", "text").mapInArrow(_sets, "doc_id long, shingles array<long>"), "sets")
    with_u = near.join(sets.select(F.col("doc_id").alias("u"), F.col("shingles").alias("u_set")), "u")
    with_both = with_u.join(sets.select(F.col("doc_id").alias("v"), F.col("shingles").alias("v_set")), "v")
    common = F.size(F.array_intersect("u_set", "v_set"))
    return with_both.filter((100 + PERCENT) * common >= PERCENT * (F.size("u_set") + F.size("v_set"))).select("u", "v")


def _sizes(a: str, b: str) -> Column:
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


def _ordered(pairs: DataFrame) -> DataFrame:
    a, b = pairs.columns
    return pairs.filter(F.col(a) != F.col(b)).select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct()


_SHINGLES = pa.schema([("rep", pa.int64()), ("set_a", pa.int64()), ("n", pa.int64()), ("shingle", pa.int64())])


def _each_shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_numpy()
        for scan in ts.scans(batch):
            hashes, at = shingle_sets(scan)
            n, text = np.diff(at), ts.text_index(at)
            set_a = ts.sums(ts.mix(hashes ^ _SET[0]), at).view(np.int64)
            own = ids[scan.first: scan.first + scan.rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array(own[text]), pa.array(set_a[text]), pa.array(n[text].astype(np.int64)), pa.array(hashes.view(np.int64))],
                schema=_SHINGLES)


def _prefix_pairs(labels: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs of classes (rep, label) in two components that share a shingle of both their prefixes: every pair
    of similarity 0.75 or more among them."""
    texts = _texts(docs, labels.select(F.col("rep").alias("doc_id")), labels.count())
    shingles = kept(texts.select("doc_id", "text").mapInArrow(_each_shingle, "rep long, set_a long, n long, shingle long"), "shingles")
    holders = shingles.groupBy("shingle").agg(F.count("*").alias("holders")).filter("holders > 1")
    own = Window.partitionBy("rep", "set_a")
    ranked = shingles.join(holders, "shingle").withColumns({
        "rank": F.row_number().over(own.orderBy("holders", "shingle")), "shared": F.count("*").over(own)})
    # shingles that one class alone has come first in its order
    ranked = ranked.withColumn("place", F.col("rank") + F.col("n") - F.col("shared"))
    prefix = ranked.filter(F.expr(f"place <= n - (({PERCENT} * n + 99) div 100) + 1")).select("rep", "n", "shingle", "place")
    prefix = kept(prefix.join(labels, "rep"), "prefixes")
    parts = prefix.groupBy("shingle", "label").agg(F.count("*").alias("size"))
    mixed = parts.groupBy("shingle").agg(F.count("*").alias("labels"), F.max_by("label", F.struct("size", "label")).alias("major"),
                                         F.ceil(F.sum("size") / SALT_ROWS).cast("int").alias("salts"))
    every = prefix.join(mixed.filter("labels > 1").select("shingle", "major", "salts"), "shingle")
    # at their first common shingle, two sets can have no more in common than what stands behind it in either order; so
    # a row admits partners up to a size only, and pairs of other sizes never meet
    most_partner = F.expr(f"cast({100 + PERCENT} * (1 + n - place) div {PERCENT} - n as long)")
    least_partner = F.expr(f"({PERCENT} * n + 99) div 100")
    band = lambda n: F.floor(F.log(n) / float(np.log(BAND_RATIO))).cast("int")
    # one of two classes in different components is outside the largest part, so only those rows meet the rest
    minor = every.filter("label <> major").withColumns({"least": least_partner, "most": most_partner}).filter("least <= most").select(
        "shingle", "rep", "n", "label", "least", "most", "salts", F.explode(F.sequence(band(F.col("least")), band(F.col("most")))).alias("band"))
    minor = minor.select("*", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")).drop("salts")
    other = every.select("shingle", F.col("rep").alias("other"), F.col("n").alias("other_n"), most_partner.alias("other_most"),
                         F.col("label").alias("other_label"), "major", band(F.col("n")).alias("band"),
                         F.pmod(F.xxhash64("rep"), "salts").cast("int").alias("salt"))
    pairs = minor.join(other, ["shingle", "band", "salt"]).filter(
        F.expr("label <> other_label and (other_label = major or rep < other) and other_n between least and most and n <= other_most"))
    return _ordered(pairs.select("rep", "other"))


def near_duplicates(documents: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of ``documents`` (doc_id, text).

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text with A-Z lower-cased; a set holds the distinct
    5-word shingles, or the whole sequence where there are fewer words.  A null, empty or blank text
    has an empty set and is linked with nothing.  Rows that share a doc_id are one document: they share a
    component, and what one of them is linked with, all are.  A row whose doc_id is null takes part in
    no link (component_id null, kept true).  Other columns are ignored.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = kept(docs.mapInArrow(signatures, SIGNATURE), "signatures")
    key = ["set_a", "set_b", "n_shingles"]
    named = rows.filter("n_shingles > 0 and doc_id is not null")
    classes = kept(named.groupBy(*key).agg(
        F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("digest").alias("digest")), "classes")
    about = classes.select("rep", "n_shingles", "digest")

    member = classes.select("rep", F.explode("bands").alias("band"))
    crowded = member.groupBy("band").agg(
        F.count("*").alias("n"), F.min("rep").alias("hub"), F.min(F.struct(F.xxhash64("rep"), "rep"))["rep"].alias("hub_2")).filter("n > 1")
    member = kept(member.join(crowded, "band"), "buckets")
    pairs = _ordered(member.select("rep", F.explode(F.array("hub", "hub_2")).alias("hub")))
    links = _linked(pairs, about, docs, by_digest=True)

    # one doc_id with several texts is one document of several classes: they are linked through it
    identity = F.struct(*key)
    several = named.groupBy("doc_id").agg(F.min(identity).alias("a"), F.max(identity).alias("b")).filter("a <> b").select("doc_id")
    if several.count():
        through = named.select("doc_id", *key).join(several, "doc_id").distinct().join(classes.select(*key, "rep"), key)
        links = links.unionByName(through.select(F.col("doc_id").alias("u"), F.col("rep").alias("v")))
    stars = components(links)

    state = member.filter("n > 2").select("band", "rep").join(stars, F.col("rep") == stars["node"], "left").select(
        "band", "rep", F.coalesce("component", "rep").alias("label"))
    mixed = state.groupBy("band").agg(F.min("label").alias("least"), F.max("label").alias("most")).filter("least <> most")
    labels = kept(state.join(mixed.select("band"), "band", "left_semi").select("rep", "label").distinct(), "open")
    if labels.count():
        more = _linked(_prefix_pairs(labels, docs), about, docs, by_digest=False)
        stars = components(stars.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more))

    label = classes.select(*key, "rep").join(stars, classes["rep"] == stars["node"], "left").select(
        *key, F.coalesce("component", "rep").alias("component_id"))
    alone = rows.filter("n_shingles = 0 or doc_id is null").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    joined = named.join(label, key).select("doc_id", "n_shingles", "component_id")
    return joined.unionByName(alone).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


#: Exact brute force: every pair that shares a shingle is counted, then links are closed.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) END)) AS g
  FROM w WHERE ws IS NOT NULL),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r AS (SELECT u AS node, u AS reach FROM e UNION SELECT e.v, r.reach FROM r JOIN e ON e.u = r.node),
k AS (SELECT node, min(reach) AS m FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(k.m, d.doc_id) AS component_id,
       coalesce(k.m, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN k ON k.node = d.doc_id
"""
