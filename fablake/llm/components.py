"""Connected components of a link table, as alternating large-star and small-star joins
(Kiveris et al., "Connected Components in MapReduce and Beyond", 2014).

Links stay distributed.  Each round is two group-bys with partial minima and two joins on a
node; a node with very many links is one side of an equi-join with a single row on the other,
so a skewed join can split it.  Each round's links are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fablake.llm.common import kept


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.filter("u <> v").unionByName(least.withColumnRenamed("m", "v")).distinct()


def _are_stars(links: DataFrame) -> bool:
    """Whether no node is the greater end of one link and the smaller end of another."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("end")).unionByName(links.select(F.col("v").alias("node"), F.lit(2).alias("end")))
    both = ends.groupBy("node").agg(F.bit_or("end").alias("ends"), F.count_if(F.col("end") == 1).alias("above"))
    # a greater end with two smaller ones is no star either
    return both.filter("ends = 3 or above > 1").limit(1).count() == 0


def components(links: DataFrame) -> DataFrame:
    """``links`` (u, v), any order, repeated links and loops allowed -> (node, component), the
    component being the smallest node reachable.  Nodes without a link are not returned.
    Null ends are ignored."""
    links = links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    links = kept(links, "links")
    while not _are_stars(links):
        links = kept(_small_star(_large_star(links)), "links")
    stars = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component")).distinct()
