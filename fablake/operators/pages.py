"""Deep pages of a table in a fixed order (L-1), without sorting ``offset`` rows for each.

``OFFSET`` alone sends ``offset + limit`` rows through one task. Here a table is stored once
in blocks of its order (range partitions, so a hot time is split by the tie-breaking id) next
to a table with the first position and the rows of each block. A page looks up the blocks that
it covers, reads only their partitions, and sorts those rows.

The table of blocks has one row for each ``rows_per_block`` rows; its running sum is taken once,
when it is written. A page brings the blocks it covers to the driver, as many as ``limit`` at
most plus those of equal position. Within a block the order of rows is not relied on.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fablake.operators.repository import newest_first

ROWS_PER_BLOCK = 1_000_000


def store(df: DataFrame, path: str, rows_per_block: int = ROWS_PER_BLOCK,
          created: str = "created_at", tie: str = "id") -> PagedTable:
    """Write ``df`` in blocks of newest-first order below ``path``; rows whose ``created`` is null come last.

    ``tie`` should be unique: rows that agree in both columns have no fixed order among themselves.
    """
    order = newest_first(created, tie)
    blocks = max(1, -(-df.count() // rows_per_block))
    ranged = df.repartitionByRange(blocks, *order).withColumn("_block", F.spark_partition_id())
    ranged.write.partitionBy("_block").parquet(f"{path}/rows")
    rows = df.sparkSession.read.schema(ranged.schema).parquet(f"{path}/rows")
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    rows.groupBy("_block").agg(F.count(F.lit(1)).alias("n_rows")).select(
        "_block", "n_rows", F.coalesce(F.sum("n_rows").over(before), F.lit(0)).alias("first")).write.parquet(f"{path}/blocks")
    return PagedTable(df.sparkSession, path, ranged.schema, created, tie)


@dataclass(frozen=True)
class PagedTable:
    """A table that ``store`` wrote."""

    spark: SparkSession
    path: str
    schema: object
    created: str = "created_at"
    tie: str = "id"

    @property
    def blocks(self) -> DataFrame:
        return self.spark.read.schema("_block int, n_rows long, first long").parquet(f"{self.path}/blocks")

    def count(self) -> int:
        return self.blocks.agg(F.sum("n_rows")).first()[0] or 0

    def page(self, limit: int = 100, offset: int = 0) -> DataFrame:
        """The rows at positions ``offset`` to ``offset + limit - 1``, fewer or none past the end."""
        covered = self.blocks.filter((F.col("first") < offset + limit) & (F.col("first") + F.col("n_rows") > offset)).collect()
        rows = self.spark.read.schema(self.schema).parquet(f"{self.path}/rows")
        rows = rows.filter(F.col("_block").isin([b["_block"] for b in covered]))
        skipped = offset - min((b["first"] for b in covered), default=offset)
        return rows.orderBy(*newest_first(self.created, self.tie)).offset(skipped).limit(limit).drop("_block")
