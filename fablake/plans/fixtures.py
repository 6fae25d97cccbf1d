"""Reference-shaped relations derived from the driver tables (deterministic).

The ingestion platform keeps an audit log, a dedicated lot table and a generic
raw-event table. Here they are derived from ``events`` so that every query's
work grows with the input:

* ``src(event_type)``: click->mes, view->equipment, purchase->erp,
  signup->plm, error->telemetry
* ``ingestion_log``: one row per event; every tenth event FAILED
* ``lot_master``: successful mes events
* ``raw_events``: the other successful events
* drift variant: curated rows with ``event_id % 97 = 0`` are missing
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fablake.functions.ids import case_lookup
from fablake.registry import Registry, load_registry
from fablake.sources.tables import read_table

# FIXED VALUES (fixture design): event type -> source
EVENT_SOURCE = {
    "click": "mes",
    "view": "equipment",
    "purchase": "erp",
    "signup": "plm",
    "error": "telemetry",
}
FAILED_EVERY = 10
DRIFT_EVERY = 97
FAILED_MESSAGE = "Payload failed schema validation"


def source_of(event_type: Column) -> Column:
    return case_lookup(EVENT_SOURCE, event_type)


def physical_stream_of(source: Column, reg: Registry | None = None) -> Column:
    reg = reg or load_registry()
    mapping = {name: reg.physical_stream(s.stream) for name, s in reg.sources.items()}
    return case_lookup(mapping, source)


def raw_prefix_of(source: Column, reg: Registry | None = None) -> Column:
    reg = reg or load_registry()
    return case_lookup({name: s.raw_prefix for name, s in reg.sources.items()}, source)


def object_key(prefix: Column, source: Column, request_id: Column, ts: Column) -> Column:
    """K-1 key layout: {prefix}/{YYYY/MM/DD}/{source}-{request_id}.json."""
    return F.format_string(
        "%s/%s/%s-%s.json", prefix, F.date_format(ts, "yyyy/MM/dd"), source, request_id
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events")


def ingestion_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir).select("event_id", "ts", "event_type", "value")
    src = source_of(F.col("event_type"))
    failed = (F.col("event_id") % FAILED_EVERY) == 0
    return ev.select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("req-"), F.col("event_id").cast("string")).alias("request_id"),
        src.alias("source"),
        F.when(failed, F.lit(None).cast("string")).otherwise(physical_stream_of(src)).alias("stream"),
        F.when(failed, F.lit("FAILED")).otherwise(F.lit("SUCCESS")).alias("status"),
        F.col("value").alias("duration_ms"),
        F.when(failed, F.lit(FAILED_MESSAGE)).alias("error_message"),
        F.col("ts").alias("created_at"),
    )


def _successful_events(spark: SparkSession, sf_dir: str, drift: bool) -> DataFrame:
    ev = events(spark, sf_dir)
    cond = (F.col("event_id") % FAILED_EVERY) != 0
    if drift:
        cond = cond & ((F.col("event_id") % DRIFT_EVERY) != 0)
    return ev.filter(cond)


def lot_master(spark: SparkSession, sf_dir: str, drift: bool = False) -> DataFrame:
    ev = _successful_events(spark, sf_dir, drift).filter(F.col("event_type") == "click")
    eid = F.col("event_id")
    return ev.select(
        eid.alias("id"),
        F.concat(F.lit("LOT"), F.col("user_id").cast("string")).alias("lot_id"),
        F.concat(F.lit("REC"), (eid % 50).cast("string")).alias("recipe_id"),
        F.concat(F.lit("ETCH"), (eid % 20).cast("string")).alias("equipment_id"),
        (F.lit(1) + eid % 25).cast("int").alias("wafer_count"),
        F.col("value").alias("temperature"),
        F.lit("LOT_COMPLETED").alias("event_type"),
        F.col("ts").alias("event_timestamp"),
        F.col("ts").alias("created_at"),
        F.concat(F.lit("req-"), eid.cast("string")).alias("request_id"),
    )


def raw_events(spark: SparkSession, sf_dir: str, drift: bool = False) -> DataFrame:
    ev = _successful_events(spark, sf_dir, drift).filter(F.col("event_type") != "click")
    src = source_of(F.col("event_type"))
    req = F.concat(F.lit("req-"), F.col("event_id").cast("string"))
    return ev.select(
        F.col("event_id").alias("id"),
        src.alias("source"),
        F.col("event_type"),
        F.col("props").alias("payload"),
        object_key(raw_prefix_of(src), src, req, F.col("ts")).alias("s3_key"),
        F.col("ts").alias("created_at"),
    )


def policies(spark: SparkSession) -> DataFrame:
    """G-1 policy table (inline, registry-sized)."""
    rows = [
        (1, "telemetry", "analyst", "read", "internal"),
        (2, "telemetry", "engineer", "read", "internal"),
        (3, "telemetry", "engineer", "write", "internal"),
        (4, "mes", "engineer", "read", "confidential"),
        (5, "mes", "admin", "write", "confidential"),
        (6, "erp", "analyst", "read", "internal"),
        (7, "erp", "admin", "delete", "restricted"),
        (8, "plm", "engineer", "read", "restricted"),
        (9, "equipment", "analyst", "read", "internal"),
        (10, "equipment", "engineer", "write", "internal"),
        (11, "mes", "engineer", "read", "confidential"),  # duplicate grant
    ]
    return spark.createDataFrame(
        rows, "id bigint, asset_class string, subject string, operation string, classification string"
    )


# FIXED VALUES (fixture design): requester role by user_id % 4, operation by event_id % 3
ROLES = ["analyst", "engineer", "admin", "viewer"]
OPERATIONS = ["read", "write", "delete"]


def access_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir).select("event_id", "user_id", "event_type")
    role = F.element_at(F.array(*[F.lit(r) for r in ROLES]), (F.col("user_id") % 4 + 1).cast("int"))
    op = F.element_at(F.array(*[F.lit(o) for o in OPERATIONS]), (F.col("event_id") % 3 + 1).cast("int"))
    return ev.select(
        F.col("event_id").alias("request_no"),
        role.alias("subject"),
        source_of(F.col("event_type")).alias("asset_class"),
        op.alias("operation"),
    )
