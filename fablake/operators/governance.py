"""Access policy, asset catalog, traceability and heartbeats as set operations.

G-2: the access check is an exact (asset_class, subject, operation) match
with default deny -- a semi join against the policy table. Policies are a
governance table whose size the plan does not assume: Spark picks the join by statistics.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fablake.operators.ranking import latest_per_key

KEYS = ["asset_class", "subject", "operation"]


def _grants(policies: DataFrame) -> DataFrame:
    return policies.select(*KEYS).distinct()


def access_decision(requests: DataFrame, policies: DataFrame) -> DataFrame:
    """Every request with ``allowed`` (default deny). Classification is carried, not evaluated."""
    g = _grants(policies).withColumn("_grant", F.lit(True))
    return requests.join(g, KEYS, "left").withColumn("allowed", F.coalesce("_grant", F.lit(False))).drop("_grant")


def denied_requests(requests: DataFrame, policies: DataFrame) -> DataFrame:
    return requests.join(_grants(policies), KEYS, "left_anti")


def readable_rows(data: DataFrame, policies: DataFrame, subject: str, operation: str = "read",
                  class_col: str = "source") -> DataFrame:
    """G-2 as a row filter: rows whose asset class the subject may access."""
    classes = (
        policies.filter((F.col("subject") == subject) & (F.col("operation") == operation))
        .select(F.col("asset_class").alias(class_col)).distinct()
    )
    return data.join(classes, class_col, "left_semi")


def register_assets(written: DataFrame, bucket: str, path_col: str = "s3_key",
                    class_col: str = "source") -> DataFrame:
    """C-1: one catalog row per written object."""
    return written.select(
        F.col(class_col).alias("asset_class"),
        F.concat(F.lit(f"s3://{bucket}/"), F.col(path_col)).alias("s3_path"),
        F.col(class_col).alias("source_name"),
        F.lit(True).alias("registered"),
    )


def list_assets(assets: DataFrame, asset_class: str | None = None) -> DataFrame:
    """C-2: all assets or those of one class (filter pushed to the scan)."""
    return assets if asset_class is None else assets.filter(F.col("asset_class") == asset_class)


def lineage_of_lots(trace: DataFrame, lots: DataFrame) -> DataFrame:
    """T-2 for many lots at once: semi join instead of one filter per lot."""
    return trace.join(lots.select("lot_id").distinct(), "lot_id", "left_semi")


def latest_heartbeat(heartbeats: DataFrame) -> DataFrame:
    """H-1: newest status per agent (partial aggregation, no per-agent sort); of equal times the
    greatest event id counts."""
    return latest_per_key(heartbeats, ["agent_id"], ["created_at", "event_id"]).drop("event_id")
