"""Request -> curated-row lineage (T-3 positional view, T-4 key-based view).

Positional view: the n-th successful audit row of a source pairs with the
n-th curated row of that source (lot table for ``mes``, raw events for every
other source), both ordered by (created_at, id). The two curated sides are
stacked first so a single equi-join on (source, rn) replaces the two left
joins of the view; the sides are disjoint by source so results are equal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fablake.operators.ranking import distributed_row_number

LOT_TABLE = "mdm.lot_master"
RAW_TABLE = "metadata.raw_events"

LINEAGE_COLUMNS = [
    "ingestion_log_id",
    "request_id",
    "source",
    "stream",
    "status",
    "duration_ms",
    "error_message",
    "ingested_at",
    "curated_table",
    "curated_record_id",
    "curated_event_type",
    "curated_created_at",
    "curated_s3_key",
]


def _successful_logs(log: DataFrame) -> DataFrame:
    return log.filter(F.col("status") == "SUCCESS").select(
        F.col("id").alias("ingestion_log_id"),
        "request_id",
        "source",
        "stream",
        "status",
        "duration_ms",
        "error_message",
        F.col("created_at").alias("ingested_at"),
        F.col("created_at").alias("_ord_ts"),
        F.col("id").alias("_ord_id"),
    )


def _curated_side(lots: DataFrame, raws: DataFrame) -> DataFrame:
    lot_side = lots.select(
        F.lit("mes").alias("source"),
        F.col("id").alias("curated_record_id"),
        F.col("event_type").alias("curated_event_type"),
        F.col("created_at").alias("curated_created_at"),
        F.lit(None).cast("string").alias("curated_s3_key"),
        F.col("created_at").alias("_ord_ts"),
        F.col("id").alias("_ord_id"),
    )
    raw_side = raws.filter(F.col("source") != "mes").select(
        "source",
        F.col("id").alias("curated_record_id"),
        F.col("event_type").alias("curated_event_type"),
        F.col("created_at").alias("curated_created_at"),
        F.col("s3_key").alias("curated_s3_key"),
        F.col("created_at").alias("_ord_ts"),
        F.col("id").alias("_ord_id"),
    )
    return lot_side.unionByName(raw_side)


def positional_lineage(log: DataFrame, lots: DataFrame, raws: DataFrame) -> DataFrame:
    """The lineage view (13 columns), positional pairing."""
    logs = distributed_row_number(
        _successful_logs(log), ["source"], ["_ord_ts", "_ord_id"]
    ).drop("_ord_ts", "_ord_id")
    cur = distributed_row_number(
        _curated_side(lots, raws), ["source"], ["_ord_ts", "_ord_id"]
    ).drop("_ord_ts", "_ord_id")
    joined = logs.join(cur, ["source", "rn"], "left")
    return joined.select(
        "ingestion_log_id",
        "request_id",
        "source",
        "stream",
        "status",
        "duration_ms",
        "error_message",
        "ingested_at",
        F.when(F.col("source") == "mes", F.lit(LOT_TABLE)).otherwise(F.lit(RAW_TABLE)).alias("curated_table"),
        "curated_record_id",
        "curated_event_type",
        "curated_created_at",
        "curated_s3_key",
    )


def request_id_from_key() -> "F.Column":
    """T-4: request id = file name of ``s3_key`` without ``{source}-`` and ``.json``."""
    return F.expr("substring(regexp_extract(s3_key, '([^/]+)\\\\.json$', 1), char_length(source) + 2)")


def key_lineage(log: DataFrame, lots: DataFrame, raws: DataFrame) -> DataFrame:
    """T-4: exact pairing by request id (lots carry it; raw events hold it in s3_key)."""
    lot_side = lots.select(
        "request_id",
        F.lit("mes").alias("_csource"),
        F.col("id").alias("curated_record_id"),
        F.col("event_type").alias("curated_event_type"),
        F.col("created_at").alias("curated_created_at"),
        F.lit(None).cast("string").alias("curated_s3_key"),
    )
    raw_side = raws.filter(F.col("source") != "mes").select(
        request_id_from_key().alias("request_id"),
        F.col("source").alias("_csource"),
        F.col("id").alias("curated_record_id"),
        F.col("event_type").alias("curated_event_type"),
        F.col("created_at").alias("curated_created_at"),
        F.col("s3_key").alias("curated_s3_key"),
    )
    cur = lot_side.unionByName(raw_side)
    logs = _successful_logs(log).drop("_ord_ts", "_ord_id")
    joined = logs.join(
        cur, (logs["request_id"] == cur["request_id"]) & (logs["source"] == cur["_csource"]), "left"
    ).drop(cur["request_id"])
    return joined.select(
        "ingestion_log_id",
        "request_id",
        "source",
        "stream",
        "status",
        "duration_ms",
        "error_message",
        "ingested_at",
        F.when(F.col("source") == "mes", F.lit(LOT_TABLE)).otherwise(F.lit(RAW_TABLE)).alias("curated_table"),
        "curated_record_id",
        "curated_event_type",
        "curated_created_at",
        "curated_s3_key",
    )


def lineage_drift(positional: DataFrame, by_key: DataFrame) -> DataFrame:
    """Rows where positional and key pairing disagree (B18 report)."""
    p = positional.select(
        "ingestion_log_id", "source", F.col("curated_record_id").alias("positional_record_id")
    )
    k = by_key.select("ingestion_log_id", F.col("curated_record_id").alias("key_record_id"))
    j = p.join(k, "ingestion_log_id", "inner")
    return j.filter(~F.col("positional_record_id").eqNullSafe(F.col("key_record_id")))
