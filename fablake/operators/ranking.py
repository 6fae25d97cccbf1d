"""Distributed positional rank (W-1..W-3) without a one-task window.

``ROW_NUMBER() OVER (PARTITION BY source ORDER BY created_at, id)`` sorts a
whole source in one task, and the lot table ranks under a *constant*
partition, i.e. everything in one task. At scale one source may hold a third
of all rows, so the rank is computed the way a global sort is:

1. range-partition on (partition keys, order keys) -- Spark samples the key
   distribution, so a hot source is split over many tasks;
2. sort within each range partition; ``monotonically_increasing_id`` then
   numbers rows in that order inside the task;
3. per (range partition, partition key): first id and row count. Because the
   data is range-sorted, this table has at most ``#range partitions +
   #distinct partition keys`` rows -- bounded by configuration, not data --
   so it is broadcast back after a running sum gives each block its offset.

The order keys must make the order total (end them with a unique id).
The range bounds come from a seeded sample whose seed depends on the RDD, so
the sorted data is written once to the shared folder, and both the block table
and the final numbering read that one copy: numbers survive executor loss and
nothing stays cached. The number of ranges is the session's, which grows with
the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fablake.session import scratch_path

# the block table is broadcast up to this many rows (counted), and joined by shuffle beyond
MAX_BLOCK_ROWS = 1_000_000


def distributed_row_number(
    df: DataFrame,
    partition_by: list[str],
    order_by: list[str],
    out: str = "rn",
) -> DataFrame:
    """Add ``out`` = 1-based row number within ``partition_by`` by ``order_by``."""
    spark = df.sparkSession
    keys = [*partition_by, *order_by]
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    numbered = ranged.withColumn("_blk", F.spark_partition_id()).withColumn("_pos", F.monotonically_increasing_id())
    path = scratch_path(spark, "ranked")
    numbered.write.parquet(path)
    tagged = spark.read.schema(numbered.schema).parquet(path)
    blocks = tagged.groupBy("_blk", *partition_by).agg(
        F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_cnt")
    )
    running = Window.partitionBy(*partition_by).orderBy("_blk").rowsBetween(
        Window.unboundedPreceding, -1
    ) if partition_by else Window.orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_offset", F.coalesce(F.sum("_cnt").over(running), F.lit(0))).drop("_cnt")
    small = blocks.count() <= MAX_BLOCK_ROWS
    joined = tagged.join(F.broadcast(blocks) if small else blocks, ["_blk", *partition_by], "inner")
    return joined.withColumn(
        out, (F.col("_pos") - F.col("_first") + F.col("_offset") + F.lit(1)).cast("bigint")
    ).drop("_blk", "_pos", "_first", "_offset")


def latest_per_key(df: DataFrame, keys: list[str], order_desc: list[str]) -> DataFrame:
    """W-4 newest row per key as an aggregate (partial agg before the shuffle).

    ``max_by(struct(all), struct(order..))`` keeps one row per key with no sort
    of the group, so a hot key costs one running maximum, not one big task.
    """
    others = [c for c in df.columns]
    packed = df.select(*keys, F.struct(*[F.col(c) for c in order_desc]).alias("_ord"), F.struct(*others).alias("_row"))
    best = packed.groupBy(*keys).agg(F.max_by("_row", "_ord").alias("_row"))
    return best.select("_row.*")
