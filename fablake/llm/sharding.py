"""Sharding by a hierarchical weighted hash tree.

A document descends from the root over regions and racks to a shard.  At each node every child draws
``-ln(u) / weight`` from a hash of the document's id and the child's name, and the smallest draw wins
(Weil et al., "CRUSH", 2006, straw buckets): a child gets its share of the weights, and a
child's draw depends on nothing but itself, so a changed weight moves documents into or out of that
child's subtree alone.

The base topology is fixed; each shard that is added later is a region of its own.  No other weight
changes, so one more shard takes documents only into itself.

Slots number the documents of a shard.  Rows are dealt out by range over (shard, id), so a shard spreads
over as many tasks as it needs, and the tasks' counts of each shard give global slots.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fablake.llm import textscan as ts
from fablake.llm.common import kept, table
from fablake.llm.prefix import with_offsets

REGIONS, RACKS, SHARDS = 2, 2, 4
BASE = REGIONS * RACKS * SHARDS
_SPAN = float(1 << 53)
U64 = np.uint64
_SALT = ts.stream(31, 2)

#: name -> (weight, children or shard number)
Tree = dict[str, tuple[float, "Tree | int"]]


def tree(shards: int = BASE, weights: dict[int, float] | None = None) -> Tree:
    """The topology of so many shards (``BASE`` or more); ``weights`` by shard, 1 where absent."""
    if shards < BASE:
        raise ValueError(f"the base topology has {BASE} shards")
    weight = lambda s: float((weights or {}).get(s, 1.0))
    out: Tree = {}
    for r in range(REGIONS):
        racks: Tree = {}
        for k in range(RACKS):
            first = (r * RACKS + k) * SHARDS
            leaves: Tree = {f"shard{s}": (weight(s), s) for s in range(first, first + SHARDS)}
            racks[f"rack{r}.{k}"] = (sum(w for w, _ in leaves.values()), leaves)
        out[f"region{r}"] = (sum(w for w, _ in racks.values()), racks)
    for s in range(BASE, shards):
        out[f"region-of-{s}"] = (weight(s), {f"rack-of-{s}": (weight(s), {f"shard{s}": (weight(s), s)})})
    return out


def keys(ids: pa.Array) -> np.ndarray:
    """A hash of each id; null has one of its own."""
    known = ts.mix(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(U64) ^ _SALT[0])
    return np.where(ids.is_null().to_numpy(zero_copy_only=False), _SALT[1], known)


def _draw(key: np.ndarray, name: str, weight: float) -> np.ndarray:
    child = U64(int.from_bytes(md5(name.encode()).digest()[:8], "little"))
    u = ((ts.mix(key ^ child) >> U64(11)).astype(np.float64) + 0.5) / _SPAN
    return -np.log(u) / weight


def descend(key: np.ndarray, node: Tree) -> np.ndarray:
    """The shard that each key reaches; a child of weight 0 is never chosen."""
    children = [(name, w, below) for name, (w, below) in node.items() if w > 0]
    won = np.argmin([_draw(key, name, w) for name, w, _ in children], axis=0)
    out = np.zeros(len(key), np.int32)
    for k, (_, _, below) in enumerate(children):
        at = np.flatnonzero(won == k)
        out[at] = below if isinstance(below, int) else descend(key[at], below)
    return out


def _place(trees: tuple[Tree, Tree]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = keys(batch.column(0))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(descend(key, t)) for t in trees)],
                                             names=[*batch.schema.names, "shard", "grown_shard"])

    return run


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the partition's number and, for each row, how many earlier rows of it had its shard."""
    from pyspark import TaskContext

    part, seen = TaskContext.get().partitionId(), {}
    for batch in batches:
        shard = batch.column(batch.schema.get_field_index("shard")).to_numpy()
        local = np.zeros(len(shard), np.int64)
        for s in np.unique(shard):
            at = np.flatnonzero(shard == s)
            local[at] = seen.get(s, 0) + np.arange(len(at))
            seen[s] = seen.get(s, 0) + len(at)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(len(shard), part, np.int32)), pa.array(local)],
            names=[*batch.schema.names, "part", "local"])


def assign(documents: DataFrame, shards: int = BASE, weights: dict[int, float] | None = None) -> DataFrame:
    """One row for each row of ``documents`` (doc_id, text): doc_id, size (UTF-8 bytes and 1; null text: 1),
    text_crc32 (null: as empty), shard, slot (from 0 in each shard, by doc_id), grown_shard (with one shard
    more of weight 1).

    The id alone decides, so rows that share a doc_id, or have none, share a shard; their slots differ.
    """
    text = F.coalesce("text", F.lit(""))
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.monotonically_increasing_id().alias("row"))
    rows = rows.mapInArrow(_place((tree(shards, weights), tree(shards + 1, weights))),
                           "doc_id long, size long, text_crc32 long, row long, shard int, grown_shard int")
    order = ["shard", "doc_id", "text_crc32", "row"]
    dealt = kept(rows, "shards").repartitionByRange(*order).sortWithinPartitions(*order)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.schema) + ", part int, local long"
    numbered = kept(dealt.mapInArrow(_number, schema).withColumn("one", F.lit(1)), "numbered")
    placed = with_offsets(numbered, "one", ["shard"])
    return placed.select("doc_id", "size", "text_crc32", "shard", F.col("start").alias("slot"), "grown_shard")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assign(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
