"""The ingest job: requests -> route -> parse -> validate -> split -> five outputs.

Input: a DataFrame of requests ``(request_key, source, content_type, body BINARY)``.
One pass computes, per request, its source definition (broadcast join with
the registry), its parsed payload, its rule errors and its outcome; the
outputs are projections of that one relation:

* ``bronze``     K-1 raw JSON, partitioned by source/year/month/day, with its object key
* ``records``    K-3 (topic, key, value) for the stream sink
* ``lots``       P-1 mapped curation into the lot table (sources with a curator + mapping)
* ``raws``       P-2 generic raw-event rows for every other source
* ``audit``      K-6 one row per request, SUCCESS or FAILED, also for parse failures (B3)
* ``accepted``   P-6 acceptance record; ``quarantine`` K-10 rejected rows with reasons

Ids are content hashes (``request_id = H(source, request_key)``), the batch
time is one literal, so a re-run produces identical rows. The writers append by batch and
commit it in a manifest, last of all; a replay adds nothing (``operators/commits.py``).
"""

from __future__ import annotations

import datetime as dt
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import cached_property

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fablake.functions.jsondoc import strict_parse_json

from fablake.functions.ids import content_id
from fablake.operators import commits
from fablake.operators import validate as val
from fablake.registry import Registry, load_registry, sources_frame, streams_frame
from fablake.registry.tables import columns_of
from fablake.session import scratch_path, shuffles_freed, unsorted_writes
from fablake.sources.formats import resolve_format

# FIXED VALUE: length of the audit table's error_message; quarantine keeps the whole text
MAX_ERROR_TEXT = 2048
# a column that is not deterministic keeps a filter on it above the select that makes it, where ``accepted`` is a
# column: pushed below, the filter would evaluate every rule a second time
BARRIER = "_barrier"
# what the sinks read of a dealt batch; values that all rows of a source share stand first and side by side, where a compressed
# block of rows holds them best.  Of the object key only the folder is kept, its name is the request's id
DEALT = ("source", "schema_name", "physical_stream", "curated_table", "reason", "http_status", "ingested_at", "accepted", "event_ts",
         "error_message", "errors", "request_id", "request_key")
FOLDER = "_folder"
OBJECT_NAME = 36 + len(".json")
# FIXED VALUES: outcome class -> status code
STATUS_CODES = {"validation": 400, "unknown_source": 404, "configuration": 500, "storage": 502}


def _ts_literal(batch_time: dt.datetime) -> Column:
    return F.lit(batch_time.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")


def parse_iso_timestamp(s: Column) -> Column:
    """P-4: ISO 8601 text (T or space, Z or offset, optional fraction) -> UTC timestamp;
    NULL when not parsable. The built-in cast handles the extended form, guarded by a full date:
    alone it would read a time as today's, and a year as its first day. Only the compact basic
    form needs a pattern. Week dates (2024-W01-1) are not read and count as not parsable."""
    cast = F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}(?:$|[T ])"), s.try_cast("timestamp"))
    compact = F.try_to_timestamp(F.regexp_replace(s, "Z$", "+00:00"), F.lit("yyyyMMdd'T'HHmmss[XXX]"))
    return F.coalesce(cast, F.when(s.rlike(r"^\d{8}T"), compact)).cast("timestamp_ntz")


def _route(requests: DataFrame, reg: Registry) -> DataFrame:
    """P-5 / J-4 / F-4: source and stream metadata by broadcast joins (registry-sized)."""
    spark = requests.sparkSession
    src = sources_frame(spark, reg).select(
        "source", "enabled", "input_format", "target_table", "raw_bucket", "raw_prefix", F.col("schema").alias("schema_name"),
        F.col("stream").alias("logical_stream"), F.lit(True).alias("_known"),
    )
    streams = streams_frame(spark, reg).select("logical_stream", "physical_stream")
    return requests.join(F.broadcast(src), "source", "left").join(F.broadcast(streams), "logical_stream", "left")


def _curated_table(reg: Registry) -> Column:
    dedicated = [s for s in reg.sources if reg.curated_table(s) != "raw_events"]
    return F.when(F.col("source").isin(*dedicated), F.col("target_table")).otherwise(F.lit("raw_events")) \
        if dedicated else F.lit("raw_events")


def check(requests: DataFrame, batch_time: dt.datetime, reg: Registry | None = None) -> DataFrame:
    """Route + parse + validate + classify: one row per request."""
    reg = reg or load_registry()
    routed = _route(requests, reg)
    fmt = resolve_format(F.col("content_type"), F.when(F.col("input_format") != "AUTO", F.col("input_format")))
    text = F.try_validate_utf8(F.col("body").cast("string"))
    parsed = routed.withColumn("format", fmt).withColumn("payload", strict_parse_json(text)).drop("body")
    # validation: every rule in one pass, each row checked by its own source's rule
    allrows = val.validate_by_source(parsed, list(reg.sources), "payload", "source", reg)

    curated_table = _curated_table(reg)
    # only valid rows bound for a dedicated table need their timestamp parsed (P-4), from the field that their
    # own source maps to it
    event_text = F.lit(None).cast("string")
    for s in reg.sources:
        field = next((f for f, c in reg.mapped_fields(s).items() if c == "event_timestamp"), None)
        if field and reg.curated_table(s) != "raw_events":
            own = (F.col("source") == s) & F.col("is_valid")
            event_text = F.when(own, F.try_variant_get("payload", f"$.{field}", "string")).otherwise(event_text)
    # columns of their own: the outcome, the message and the curated row read them
    allrows = allrows.withColumn("_event_text", event_text).withColumn("event_ts", parse_iso_timestamp(F.col("_event_text")))
    event_ts = F.col("event_ts")

    reason = (
        F.when(F.col("_known").isNull(), F.lit("unknown_source"))
        .when(~F.col("enabled"), F.lit("configuration"))
        .when(F.col("physical_stream").isNull(), F.lit("configuration"))
        .when(F.col("payload").isNull(), F.lit("validation"))
        .when(~F.col("is_valid"), F.lit("validation"))
        # B7: a curated timestamp that does not parse is rejected before any write
        .when((curated_table != "raw_events") & event_ts.isNull(), F.lit("validation"))
    )
    message = (
        F.when(F.col("_known").isNull(), F.concat(F.lit("Unknown source: "), F.col("source")))
        .when(~F.col("enabled"), F.concat(F.lit("Source '"), F.col("source"), F.lit("' is disabled")))
        .when(F.col("physical_stream").isNull(), F.lit("Unknown logical stream"))
        .when(F.col("payload").isNull(), F.lit("Request body is not valid JSON"))
        .when(~F.col("is_valid"), F.concat(F.lit("Payload failed schema validation: "), F.array_join("errors", ";")))
        .when((curated_table != "raw_events") & event_ts.isNull(), F.lit("Curated timestamp is not ISO 8601"))
    )
    request_id = content_id("source", "request_key")
    day = _ts_literal(batch_time)
    prefix = F.coalesce(F.col("raw_prefix"), F.col("source"))
    parts = (prefix, F.lit("/"), F.date_format(day, "yyyy/MM/dd"), F.lit("/"), F.col("source"), F.lit("-"), request_id, F.lit(".json"))
    s3_key = F.concat(*(F.coalesce(p, F.lit("null")) for p in parts))
    code = F.element_at(
        F.create_map(*[x for k, v in STATUS_CODES.items() for x in (F.lit(k), F.lit(v))]), reason
    )
    return allrows.select(
        "request_key", "source", "content_type", "format", "payload", "errors",
        request_id.alias("request_id"),
        F.coalesce(reason.isNull(), F.lit(False)).alias("accepted"),
        reason.alias("reason"),
        F.when(reason.isNull(), 202).otherwise(code).cast("int").alias("http_status"),
        message.alias("error_message"), F.col("schema_name"),
        "physical_stream", "raw_bucket", s3_key.alias("s3_key"), curated_table.alias("curated_table"),
        "event_ts", day.alias("ingested_at"),
        F.monotonically_increasing_id().alias(BARRIER),
    )


class IngestResult:
    """Outputs of one ingest batch; each is built only when asked for (plan analysis
    of a wide validated relation is not free)."""

    def __init__(self, checked: DataFrame, reg: Registry, requests: DataFrame | None = None):
        self.checked = checked
        self._reg = reg
        # the keys of the batch, from the requests themselves where they are at hand
        self.keys = checked if requests is None else requests.select("source", content_id("source", "request_key").alias("request_id"))

    @property
    def _ok(self) -> DataFrame:
        return self.checked.filter(F.col("accepted") & self._made)

    @property
    def _made(self) -> Column:
        return F.col(BARRIER) >= 0 if BARRIER in self.checked.columns else F.lit(True)

    @staticmethod
    def _record_id() -> Column:
        return content_id("request_id", F.lit("curated"))

    @cached_property
    def lots(self) -> DataFrame:
        """P-1: each source's own mapping, with the column types of the table definition; a column that
        the source does not map is NULL."""
        return self.table("lot_master")

    def table(self, name: str) -> DataFrame:
        """Rows curated into one dedicated table by the sources whose mapping names it."""
        own = [s for s in self._reg.sources if self._reg.curated_table(s) == name]
        cols = []
        for column, kind in columns_of(name).items():
            if column in ("id", "created_at"):
                continue
            value = F.lit(None).cast(kind)
            for s in own:
                field = next((f for f, c in self._reg.mapped_fields(s).items() if c == column), None)
                if field is not None:
                    own_value = F.col("event_ts") if column == "event_timestamp" else F.try_variant_get("payload", f"$.{field}", kind)
                    value = F.when(F.col("source") == s, own_value).otherwise(value)
            cols.append(value.alias(column))
        return self._ok.filter(F.col("curated_table") == name).select(
            self._record_id().alias("id"), *cols, F.col("ingested_at").alias("created_at"), "request_id"
        )

    @cached_property
    def raws(self) -> DataFrame:
        """P-2: generic rows, event_type taken from the payload."""
        return self._ok.filter(F.col("curated_table") == "raw_events").select(
            self._record_id().alias("id"), "source",
            F.try_variant_get("payload", "$.eventType", "string").alias("event_type"),
            F.to_json("payload").alias("payload"), "s3_key", F.col("ingested_at").alias("created_at"),
            "request_id",
        )

    @cached_property
    def bronze(self) -> DataFrame:
        return self._ok.select(
            "source", "s3_key", "request_id", F.to_json("payload").alias("body"),
            F.year("ingested_at").alias("year"), F.format_string("%02d", F.month("ingested_at")).alias("month"),
            F.format_string("%02d", F.dayofmonth("ingested_at")).alias("day"),
        )

    @cached_property
    def records(self) -> DataFrame:
        return self._ok.select(
            F.col("physical_stream").alias("topic"), F.col("request_id").alias("key"),
            F.to_json("payload").alias("value"), "source",
        )

    @cached_property
    def accepted(self) -> DataFrame:
        return self._ok.select(
            "request_id", "source", F.lit("ACCEPTED").alias("status"), "s3_key",
            F.col("physical_stream").alias("stream"), self._record_id().alias("curated_record_id"), "curated_table",
        )

    @cached_property
    def audit(self) -> DataFrame:
        return self.checked.select(
            content_id("request_id", F.lit("audit")).alias("id"), "request_id", "request_key", "source",
            F.when(F.col("accepted"), F.col("physical_stream")).alias("stream"),
            F.when(F.col("accepted"), "SUCCESS").otherwise("FAILED").alias("status"),
            F.lit(None).cast("double").alias("duration_ms"),
            F.substring("error_message", 1, MAX_ERROR_TEXT).alias("error_message"), "http_status", F.col("ingested_at").alias("created_at"),
        )

    @cached_property
    def quarantine(self) -> DataFrame:
        return self.checked.filter(~F.col("accepted") & self._made).select(
            "request_id", "request_key", "source", "reason", "http_status", "schema_name", "error_message", "errors",
            F.col("ingested_at").alias("created_at"),
        )


def run(requests: DataFrame, batch_time: dt.datetime, reg: Registry | None = None,
        persist: bool = True) -> IngestResult:
    reg = reg or load_registry()
    checked = check(requests, batch_time, reg)
    if persist:
        # five sinks read this relation: compute parse + validation once; a query of one
        # output does without. A lost cached block is recomputed from the same deterministic plan.
        checked = checked.persist(StorageLevel.MEMORY_AND_DISK)
    return IngestResult(checked, reg, requests)


SINKS_AT_ONCE = 4
# FIXED VALUE: files a task of a sink has open at a time; a sink has one partition for each source at most
OPEN_FILES = 32
SINKS = ("bronze", "topics", "lot_master", "raw_events", "ingestion_log", "quarantine", "left_out")
#: Index of the requests that committed batches have, in slots: by source, then by the first digit of the id.
KNOWN, OTHER_SOURCE = "known", "other"


def _slot(reg: Registry) -> Column:
    """A request's slot of the index; sources that the registry does not have share theirs, so the number of slots is bounded."""
    known = F.when(F.col("source").isin(*reg.sources), F.col("source")).otherwise(F.lit(OTHER_SOURCE))
    return F.concat_ws("-", known, F.substring("request_id", 1, 1))


def _error_mark() -> Column:
    return F.xxhash64(F.substring("error_message", 1, MAX_ERROR_TEXT))


def known_requests(spark: SparkSession, base: str, slots: list[str]) -> DataFrame:
    """(request_id, done, error) that committed batches have in these slots: partitions of the index, narrow columns, not the log."""
    return commits.read(spark, base, KNOWN).filter(F.col("slot").isin(*slots)).select("request_id", "done", "error")


def dealt_deliveries(result: IngestResult, base: str) -> DataFrame:
    """What the sinks read of each delivery, with its hashes (``commits.row_hashes``) and ``counts``: false where it is left out of
    the sinks.  A rejected delivery goes without its payload and object key, which no sink has.

    A request is known by its id.  Of several deliveries in one batch an accepted one counts before a rejected
    one, then the one with the smallest payload hash.  Left out are the others, requests that a committed batch
    has with SUCCESS, and rejected ones that one has with the same error: a corrected delivery of a request that
    was rejected counts."""
    spark, reg = result.checked.sparkSession, result._reg
    taken = lambda c: F.when(F.col("accepted"), c)
    folder = F.col("s3_key").substr(F.lit(1), F.length("s3_key") - OBJECT_NAME)
    slim = result.checked.withColumn("_text", F.to_json("payload")).select(
        *DEALT, taken(folder).alias(FOLDER), F.xxhash64("_text", "error_message").alias("_order"),
        *commits.row_hashes("request_id", "_text", "error_message"), taken(F.col("payload")).alias("payload"))
    dealt = slim.withColumn("turn", F.row_number().over(Window.partitionBy("request_id").orderBy(~F.col("accepted"), "_order")))
    known = F.lit(False)
    if commits.exists(spark, f"{base.rstrip('/')}/{KNOWN}"):
        # 16 for each source at most; no rule is evaluated for them
        slots = [r[0] for r in result.keys.select(_slot(reg).alias("slot")).distinct().collect()]
        # one row for a request, and no key but its id: the deliveries are shuffled by it already
        index = known_requests(spark, base, slots).groupBy("request_id").agg(
            F.bool_or("done").alias("_done"), F.collect_set(F.when(~F.col("done"), F.col("error"))).alias("_failed"))
        dealt = dealt.join(index, "request_id", "left")
        known = F.coalesce("_done", F.lit(False)) | F.coalesce(~F.col("accepted") & F.array_contains("_failed", _error_mark()), F.lit(False))
    return dealt.select(*DEALT, FOLDER, "payload", *commits.HASHES, ((F.col("turn") == 1) & ~known).alias("counts"))


@dataclass
class Staged:
    """A batch whose rows are in the sinks, but not in the manifest."""

    base: str
    content: str
    attempt: str
    n_rows: int


def stage(result: IngestResult, base: str) -> Staged | None:
    """Writes the batch's rows under an attempt of their own; None where its content is committed already, or it has no rows.
    Deliveries that are left out get an audit row in a sink of their own."""
    spark = result.checked.sparkSession
    # written, not cached: the digest and eight sinks read it, the rules run once, and a lost executor costs no second evaluation.
    # Only the sinks stay on disk: shuffled rows go as soon as they are read, the dealt batch when the sinks have it
    path = scratch_path(spark, "dealt")
    try:
        with shuffles_freed(spark):
            dealt_deliveries(result, base).write.option("compression", commits.CODEC).parquet(path)
            return _stage_dealt(spark.read.parquet(path), result._reg, base)
    finally:
        commits.drop(spark, path)


def _stage_dealt(dealt: DataFrame, reg: Registry, base: str) -> Staged | None:
    spark = dealt.sparkSession
    content, n_rows = commits.content_digest(dealt)
    if not n_rows or commits.is_listed(spark, base, content):
        return None
    attempt = commits.new_attempt(content)
    dealt = dealt.withColumn("s3_key", F.concat(FOLDER, "request_id", F.lit(".json")))
    new = IngestResult(dealt.filter("counts"), reg)
    rest = IngestResult(dealt.filter("NOT counts"), reg)

    def put(df: DataFrame, name: str, *parts: str) -> None:
        rows = df.withColumn("batch", F.lit(attempt)).write.mode("append").option("compression", commits.CODEC)
        rows.partitionBy(*parts, "batch").parquet(f"{base.rstrip('/')}/{name}")

    day = F.to_date("created_at")
    index = new.checked.select(_slot(reg).alias("slot"), "request_id", F.col("accepted").alias("done"), F.when(~F.col("accepted"), _error_mark()).alias("error"))
    # the index first and alone: it is shuffled, and sorted by its many slots; the log last: it is the largest
    put(index.repartition("slot").sortWithinPartitions("slot", "request_id"), KNOWN, "slot")
    sinks = [
        (new.bronze, "bronze", "source", "year", "month", "day"),
        (new.records, "topics", "topic"),
        (new.lots.withColumn("_day", day), "lot_master", "_day"),
        (new.raws.withColumn("_day", day), "raw_events", "source", "_day"),
        (new.quarantine.withColumn("_day", day), "quarantine", "_day"),
        (rest.audit.withColumns({"status": F.lit("LEFT_OUT"), "_day": day}), "left_out", "_day"),
        (new.audit.withColumn("_day", day), "ingestion_log", "_day"),
    ]
    # side by side: a sink alone leaves cores idle while its last tasks run and its files are committed
    with unsorted_writes(spark, OPEN_FILES), ThreadPoolExecutor(SINKS_AT_ONCE) as pool:
        for done in [pool.submit(inheritable_thread_target(spark)(put), *sink) for sink in sinks]:
            done.result()
    return Staged(base, content, attempt, n_rows)


def write(result: IngestResult, base: str) -> dict[str, str]:
    """Appends the batch to the sinks: its rows first, then its line in the manifest, which makes them visible all at once.
    Read the sinks with ``commits.read``."""
    staged = stage(result, base)
    if staged:
        commits.commit(result.checked.sparkSession, base, staged.content, staged.attempt, staged.n_rows)
    return {name: f"{base.rstrip('/')}/{name}" for name in SINKS}


def requests_from_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixture requests: mes payloads (lineitem), erp/equipment/plm/telemetry payloads
    (events; every 17th body truncated), and 'scada' requests for an unknown source
    (every click event)."""
    from fablake.plans import payloads as pl
    from fablake.sources.tables import read_table

    mes = pl.mes_payloads(spark, sf_dir).select(
        F.concat_ws("-", F.lit("li"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                    F.col("l_quantity").cast("int"), F.date_format("l_shipdate", "yyyyMMdd")).alias("request_key"),
        "source", F.lit("application/json").alias("content_type"), F.encode("payload_text", "UTF-8").alias("body"),
    )
    ev = pl.event_payloads(spark, sf_dir)
    text = F.when(F.col("event_id") % 17 == 0, F.substring("payload_text", 1, 20)).otherwise(F.col("payload_text"))
    others = ev.select(
        F.concat(F.lit("ev-"), F.col("event_id").cast("string")).alias("request_key"), "source",
        F.lit("application/json").alias("content_type"), F.encode(text, "UTF-8").alias("body"),
    )
    clicks = read_table(spark, sf_dir, "events").filter(F.col("event_type") == "click")
    unknown = clicks.select(
        F.concat(F.lit("ev-"), F.col("event_id").cast("string")).alias("request_key"), F.lit("scada").alias("source"),
        F.lit("application/json").alias("content_type"),
        F.encode(F.to_json(F.struct("event_id", "user_id")), "UTF-8").alias("body"),
    )
    return mes.unionByName(others).unionByName(unknown)


BATCH_TIME = dt.datetime(2024, 2, 1, 6, 0, 0)
