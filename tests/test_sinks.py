"""Sinks append by batch: nothing is lost, nothing comes twice."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from fablake.operators import commits
from fablake.plans import ingest as ing
from fablake.streaming import ingest_stream as strm
from test_jobs import _custom_registry

COLUMNS = "request_key string, source string, content_type string, body binary"


def _erp(key, **extra):
    body = {"eventType": "WO", "workOrderId": key, "timestamp": "2024-01-01T00:00:00Z", **extra}
    return key, "erp", "application/json", json.dumps(body).encode()


def _keys(spark, base, sink, column="request_id"):
    return sorted(r[0] for r in commits.read(spark, base, sink).select(column).collect())


def test_two_batches_of_a_day_and_a_replay(spark, tmp_dir):
    base = os.path.join(tmp_dir, "lake")
    batches = [[_erp("a"), _erp("b"), _erp("c")], [_erp("d"), _erp("b", plant="again"), ("x", "erp", "application/json", b"{")]]
    for rows in [*batches, batches[0]]:
        r = ing.run(spark.createDataFrame(rows, COLUMNS), ing.BATCH_TIME)
        ing.write(r, base)
        r.checked.unpersist()
    log = commits.read(spark, base, "ingestion_log")
    assert sorted(r.request_key for r in log.collect()) == ["a", "b", "c", "d", "x"]
    assert len(_keys(spark, base, "bronze")) == len(_keys(spark, base, "topics", "key")) == len(_keys(spark, base, "raw_events")) == 4
    assert log.filter("status = 'FAILED'").count() == commits.read(spark, base, "quarantine").count() == 1


def test_late_and_repeated_rows_over_micro_batches(spark, tmp_dir):
    landing, out = os.path.join(tmp_dir, "landing"), os.path.join(tmp_dir, "out")
    arrivals = [("18:00:00", [_erp("a"), _erp("b")]), ("09:00:00", [_erp("late")]), ("20:00:00", [_erp("a"), _erp("c")]), ("23:00:00", [_erp("b"), _erp("b")])]
    for n, (at, rows) in enumerate(arrivals):
        spark.createDataFrame(rows, COLUMNS).withColumn("received_at", F.lit(f"2024-02-01 {at}").cast("timestamp")).coalesce(1) \
            .write.parquet(f"{landing}/{n}")
    strm.run_stream(spark, landing, out, os.path.join(tmp_dir, "ckpt"), max_files_per_trigger=1)
    strm.run_stream(spark, landing, out, os.path.join(tmp_dir, "ckpt-new"))
    for sink in ("ingestion_log", "bronze", "raw_events"):
        assert len(_keys(spark, out, sink)) == 4
    assert sorted(r.request_key for r in commits.read(spark, out, "ingestion_log").collect()) == ["a", "b", "c", "late"]


def test_each_source_is_curated_by_its_own_mapping(spark):
    import dataclasses

    reg = _custom_registry(line={"endpoint": "/line", "schema": "rules/equipment_event.json", "target_table": "lot_master", "stream": "mes", "raw_bucket": "b"})
    reg = dataclasses.replace(reg, mappings={**reg.mappings, "line": {"target_table": "lot_master", "fields": {
        "batchNo": "lot_id", "equipmentId": "equipment_id", "eventType": "event_type", "pieces": "wafer_count", "timestamp": "event_timestamp"}}})
    body = {"eventType": "DONE", "equipmentId": "E1", "timestamp": "2024-03-01T10:00:00+02:00", "batchNo": "B7", "pieces": 12}
    rows = [("k", "line", "application/json", json.dumps(body).encode())]
    got = ing.run(spark.createDataFrame(rows, COLUMNS), ing.BATCH_TIME, reg).lots.first()
    assert (got.lot_id, got.equipment_id, got.wafer_count, got.event_type, got.recipe_id) == ("B7", "E1", 12, "DONE", None)
    assert str(got.event_timestamp) == "2024-03-01 08:00:00"


@pytest.mark.parametrize("text, ok", [
    ("2024-01-02T03:04:05Z", True), ("2024-01-02 03:04:05.5+01:00", True), ("2024-01-02", True), ("20240102T030405Z", True),
    ("12:30:00", False), ("2024", False), ("2024-01", False), ("nonsense", False), ("", False)])
def test_timestamps_need_a_full_date(spark, text, ok):
    row = spark.range(1).select(ing.parse_iso_timestamp(F.lit(text)).alias("t")).first()
    assert (row.t is not None) == ok


def test_repeated_json_keys_keep_the_last_value(spark):
    from fablake.functions.jsondoc import strict_parse_json

    row = spark.range(1).select(F.to_json(strict_parse_json(F.lit('{"a":1,"a":2}'))).alias("j")).first()
    assert json.loads(row.j) == {"a": 2}


def test_upsert_ties_do_not_depend_on_row_order(spark):
    from fablake.operators.repository import upsert

    base = spark.createDataFrame([(1, "old"), (2, "stay")], "id long, v string")
    changes = [(1, "x", 1), (1, "y", 1), (3, "new", 1), (1, "z", 0)]
    seen = {tuple(sorted((r.id, r.v) for r in upsert(base, spark.createDataFrame(c, "id long, v string, n int"), "id", "n").collect()))
            for c in (changes, changes[::-1])}
    assert len(seen) == 1 and dict(seen.pop())[1] in "xy"


def test_a_corrected_delivery_counts_and_left_out_ones_are_audited(spark, tmp_dir):
    base = os.path.join(tmp_dir, "corrected")
    bad = [(k, "erp", "application/json", b"{") for k in ("x", "y", "z")]
    batches = [[bad[0], bad[2], _erp("a")], [_erp("x"), bad[1], _erp("y"), bad[2], _erp("a", plant="again")]]
    for rows in [*batches, batches[0]]:
        r = ing.run(spark.createDataFrame(rows, COLUMNS), ing.BATCH_TIME)
        ing.write(r, base)
        r.checked.unpersist()
    rows = lambda sink: sorted((r.request_key, r.status) for r in commits.read(spark, base, sink).collect())
    assert rows("ingestion_log") == [("a", "SUCCESS"), ("x", "FAILED"), ("x", "SUCCESS"), ("y", "SUCCESS"), ("z", "FAILED")]
    assert rows("left_out") == [(k, "LEFT_OUT") for k in "ayz"]
    assert len(_keys(spark, base, "bronze")) == len(_keys(spark, base, "raw_events")) == 3
    assert _keys(spark, base, "quarantine", "request_key") == ["x", "z"]


def _batch(spark, base, rows, step=ing.write):
    result = ing.run(spark.createDataFrame(rows, COLUMNS), ing.BATCH_TIME)
    out = step(result, base)
    result.checked.unpersist()
    return out


def test_batches_of_duplicates_do_not_share_a_digest(spark):
    def digest(*keys):
        return commits.content_digest(spark.createDataFrame([(k,) for k in keys], "k string"), "k")[0]

    assert len({digest(*k) for k in ("aa", "cc", "aab", "ccb", "ab", "a", "", "aabb")}) == 8
    assert digest(*"abca") == digest(*"caab")


def test_a_batch_of_duplicates_keeps_another_one(spark, tmp_dir):
    base = os.path.join(tmp_dir, "twice")
    _batch(spark, base, [_erp("a"), _erp("a")])
    _batch(spark, base, [_erp("c"), _erp("c")])
    for sink in ("bronze", "raw_events", "ingestion_log"):
        assert len(_keys(spark, base, sink)) == 2
    assert commits.read(spark, base, "left_out").count() == 2


def test_what_a_dead_batch_wrote_is_never_seen(spark, tmp_dir):
    base = os.path.join(tmp_dir, "dead")
    _batch(spark, base, [_erp("a")])
    dead = _batch(spark, base, [_erp("b"), _erp("c"), ("x", "erp", "application/json", b"{")], ing.stage)
    assert len(_keys(spark, base, "bronze")) == 1 and spark.read.parquet(f"{base}/bronze").count() == 3
    # the next run cuts otherwise, and the dead batch itself comes again
    _batch(spark, base, [_erp("c"), _erp("d")])
    _batch(spark, base, [_erp("b"), _erp("c"), ("x", "erp", "application/json", b"{")])
    assert _batch(spark, base, [_erp("b"), _erp("c"), ("x", "erp", "application/json", b"{")], ing.stage) is None
    log = commits.read(spark, base, "ingestion_log").collect()
    assert sorted(r.request_key for r in log) == ["a", "b", "c", "d", "x"]
    assert dead.attempt not in {r.batch for r in log} and commits.listed(spark, base).count() == 3
    topics = strm.read_back_topics(spark, base, os.path.join(tmp_dir, "topics-ckpt"))
    assert topics.count() == topics.select("key").distinct().count() == 4
    assert _batch(spark, base, []) and commits.listed(spark, base).count() == 3


def test_batches_read_their_own_slots_of_the_index(spark, tmp_dir):
    base = os.path.join(tmp_dir, "slots")
    body = json.dumps({"eventType": "E", "equipmentId": "q", "timestamp": "2024-01-01T00:00:00Z"}).encode()
    for n in range(3):
        _batch(spark, base, [_erp(f"k{k}") for k in range(5 * n, 5 * n + 8)] + [(f"q{n}", "equipment", "application/json", body)])
    assert len(_keys(spark, base, "ingestion_log")) == len(set(_keys(spark, base, "ingestion_log"))) == 21
    plan = ing.known_requests(spark, base, ["equipment-0", "equipment-1"])._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters"):]
    assert "IN (equipment-0,equipment-1)" in filters[:filters.index("]")] and "error_message" not in plan


def test_writers_keep_no_checked_batch(spark, tmp_dir, monkeypatch):
    """F3 to F5: a batch is dealt and written once; nothing is cached, and its digest reads what was written."""
    seen = []
    digest = commits.content_digest

    def watched(df, *columns):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        seen.append(("InMemoryRelation" in plan, "parse_json" in plan.lower() or "parseJson" in plan))
        return digest(df, *columns)

    monkeypatch.setattr(commits, "content_digest", watched)
    out = os.path.join(tmp_dir, "kept-not")
    strm._sink_batch(out, ing.BATCH_TIME)(spark.createDataFrame([_erp("a"), _erp("b"), _erp("a")], COLUMNS), 0)
    assert seen == [(False, False)]
    assert len(_keys(spark, out, "bronze")) == 2 and commits.read(spark, out, "left_out").count() == 1


def _lake_files(root):
    return [f for _, _, files in os.walk(root) for f in files if f.endswith(".parquet")]


def _shuffle_blocks(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(",")
    return {b.rsplit("/", 1)[-1] for b in blocks.split(",") if "shuffle_" in b and b.endswith(".data")}


def test_a_batch_leaves_only_its_sinks_on_disk(spark, tmp_dir):
    """neither the dealt batch nor its shuffles stay, and the lake is compressed."""
    base, tables = os.path.join(tmp_dir, "lean"), os.path.join(spark.conf.get("spark.checkpoint.dir"), "tables")
    listed = lambda: {t for t in os.listdir(tables) if t.startswith("dealt-")} if os.path.isdir(tables) else set()
    kept, blocks = listed(), _shuffle_blocks(spark)
    rows = [[_erp("a"), _erp("b"), ("x", "erp", "application/json", b"{")], [_erp("a"), _erp("c")]]
    for batch in [*rows, rows[0]]:
        ing.write(ing.run(spark.createDataFrame(batch, COLUMNS).repartition(3), ing.BATCH_TIME, persist=False), base)
    assert listed() == kept
    sinks = [f for s in ing.SINKS for f in _lake_files(os.path.join(base, s))]
    assert sinks and all(".zstd." in f for f in sinks)
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    until = time.time() + 20
    while time.time() < until and len(_shuffle_blocks(spark) - blocks) > 6:
        time.sleep(0.2)
    # what is left belongs to the small digests and slot lists, one file a task at most
    assert len(_shuffle_blocks(spark) - blocks) <= 6


def test_rejected_deliveries_carry_no_payload(spark, tmp_dir):
    """a dealt batch holds what the sinks read, and its hashes give the digest of the whole rows."""
    rows = [_erp("a"), _erp("b", plant="P"), ("x", "erp", "application/json", b"{"), _erp("y", workOrderId=7)]
    result = ing.run(spark.createDataFrame(rows, COLUMNS), ing.BATCH_TIME, persist=False)
    dealt = ing.dealt_deliveries(result, os.path.join(tmp_dir, "none"))
    assert not {"content_type", "raw_bucket", "s3_key", "_text"} & set(dealt.columns)
    assert sorted((r.request_key, r.payload is not None) for r in dealt.select("request_key", "payload").collect()) == [
        ("a", True), ("b", True), ("x", False), ("y", False)]
    whole = result.checked.select("request_id", F.to_json("payload").alias("t"), "error_message")
    assert commits.content_digest(dealt) == commits.content_digest(whole, "request_id", "t", "error_message")


def test_object_keys_and_bodies_in_the_lake_are_those_of_the_batch(spark, tmp_dir):
    base = os.path.join(tmp_dir, "keys")
    result = ing.run(spark.createDataFrame([_erp("a"), _erp("b", n=1e3)], COLUMNS), ing.BATCH_TIME, persist=False)
    ing.write(result, base)
    of = lambda df: sorted(tuple(r) for r in df.select("s3_key", "request_id", "body").collect())
    assert of(commits.read(spark, base, "bronze")) == of(result.bronze)


def test_known_requests_join_shuffles_deliveries_once(spark, tmp_dir):
    """the index has one row for a request, so the deliveries are not shuffled again for its errors."""
    base = os.path.join(tmp_dir, "once")
    bad = lambda body: ("x", "erp", "application/json", body)
    other = json.dumps({"eventType": "WO", "workOrderId": 7, "timestamp": "2024-01-01T00:00:00Z"}).encode()
    for rows in ([bad(b"{"), _erp("a")], [bad(other)], [bad(b"{"), _erp("b")], [bad(other), _erp("c")]):
        result = ing.run(spark.createDataFrame(rows, COLUMNS), ing.BATCH_TIME, persist=False)
        ing.write(result, base)
    log = sorted((r.request_key, r.status) for r in commits.read(spark, base, "ingestion_log").collect())
    assert log == [("a", "SUCCESS"), ("b", "SUCCESS"), ("c", "SUCCESS"), ("x", "FAILED"), ("x", "FAILED")]
    assert commits.read(spark, base, "left_out").count() == 2
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = ing.dealt_deliveries(result, base)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum("Exchange hashpartitioning(request_id" in line for line in plan.splitlines()) == 2


def test_a_replayed_arrival_is_one_file(spark, tmp_dir):
    """a trigger counts files, so their number must not grow with the tasks that wrote the requests."""
    landing, out = os.path.join(tmp_dir, "arrivals"), os.path.join(tmp_dir, "arrivals-out")
    requests = spark.createDataFrame([_erp(f"k{i}") for i in range(60)], COLUMNS).repartition(12)
    strm.land_requests(requests, landing)
    assert len(_lake_files(os.path.join(landing, "arrivals"))) == 4 and len(_lake_files(os.path.join(landing, "redelivered"))) == 1
    keys = lambda rows: sorted(r.request_key for r in rows.collect())
    landed = spark.read.parquet(f"{landing}/arrivals")
    assert keys(landed) == keys(requests) and keys(spark.read.parquet(f"{landing}/redelivered")) == keys(landed.filter("arrival = 0"))
    strm.run_stream(spark, landing, out, os.path.join(tmp_dir, "arrivals-ckpt"), max_files_per_trigger=3)
    assert commits.listed(spark, out).count() == 2
    assert _keys(spark, out, "ingestion_log", "request_key") == keys(requests)


def test_landing_is_compressed_and_sorted_by_source(spark, tmp_dir):
    """each source's rule reads its own pages of a landing file."""
    landing = os.path.join(tmp_dir, "sorted")
    body = json.dumps({"eventType": "E", "equipmentId": "q", "timestamp": "2024-01-01T00:00:00Z"}).encode()
    rows = [r for i in range(20) for r in (_erp(f"e{i}"), (f"q{i}", "equipment", "application/json", body))]
    strm.land_requests(spark.createDataFrame(rows, COLUMNS).coalesce(1), landing, duplicate_file=False)
    files = _lake_files(landing)
    assert len(files) == 4 and all(".zstd." in f for f in files)
    for n in range(4):
        sources = [r.source for r in spark.read.parquet(f"{landing}/arrivals/arrival={n}").collect()]
        assert sources == sorted(sources)


def test_topics_read_back_and_promoted_are_compressed(spark, tmp_dir):
    """the records that the streams copy are compressed as the lake is."""
    base = os.path.join(tmp_dir, "copies")
    _batch(spark, base, [_erp("a"), _erp("b")])
    back = os.path.join(tmp_dir, "copies-ckpt")
    assert strm.read_back_topics(spark, base, back).count() == 2
    gold = spark.read.parquet(strm.promote_topics(spark, base, os.path.join(tmp_dir, "copies-promote")))
    assert [(r.source, r.event_type, r.n_events) for r in gold.collect()] == [("erp", "WO", 2)]
    for folder in (f"{back}-rows", os.path.join(base, "silver")):
        files = _lake_files(folder)
        assert files and all(".zstd." in f for f in files)


def test_settings_of_a_write_are_put_back(spark):
    """rows of a sink are not sorted by partition, and the session has its own settings again, also after a failure."""
    from fablake.session import shuffles_freed, unsorted_writes

    keys = ("spark.sql.maxConcurrentOutputFileWriters", "spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    now = lambda: [spark.conf.get(k) for k in keys]
    before = now()
    with pytest.raises(ValueError), unsorted_writes(spark, 3), shuffles_freed(spark):
        assert now() == ["3", "true"]
        raise ValueError
    assert now() == before
