"""Folder normalise job, the ingest job, streaming replay and the driver contract."""

import json
import os

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from conftest import SMOKE


def _write(root, rel, data: bytes):
    p = os.path.join(root, rel)
    os.makedirs(os.path.dirname(p), exist_ok=True)
    with open(p, "wb") as f:
        f.write(data)


def test_normalise_folder(spark, tmp_dir):
    from fablake.sources import normalise as nz

    root = os.path.join(tmp_dir, "bucket")
    _write(root, "files/native/health.xml", b"<health><host>h1</host><status>OK</status></health>")
    _write(root, "files/native/orders.csv", b"workOrderId,plant,priority\nWO-1,P1,HIGH\nWO-2,P2,LOW\n")
    _write(root, "files/native/driver.txt", b"2026-07-15T10:00:00Z start\n2026-07-15T10:00:01Z ok\n")
    _write(root, "files/native/conf.yaml", b"a: yes\n")
    _write(root, "files/native/blob.h5", b"\x00\x01\x02")
    _write(root, "files/native/placeholder.parquet", b"not a parquet file\n")
    _write(root, "files/native/sub/health.xml", b"<broken>")
    _write(root, "files/other/noext", b'{"k": 1}')
    _write(root, "normalized/old.json", b"{}")
    pq.write_table(pa.table({"a": [1, 2, 3], "b": ["x", "y", "z"]}), os.path.join(root, "files/native/bench.parquet"))

    out = {r.rel_path: r for r in nz.normalise_folder(spark, root, "normalized").collect()}
    assert "normalized/old.json" not in out
    assert json.loads(out["files/native/health.xml"].doc) == {"health": {"host": "h1", "status": "OK"}}
    csv_doc = json.loads(out["files/native/orders.csv"].doc)
    assert csv_doc["columns"] == ["workOrderId", "plant", "priority"] and csv_doc["row_count"] == 2
    assert json.loads(out["files/native/driver.txt"].doc)["text"].startswith("2026-07-15T10:00:00Z")
    assert json.loads(out["files/native/conf.yaml"].doc) == {"a": True}
    assert json.loads(out["files/native/blob.h5"].doc) == {"content_base64": "AAEC"}
    assert json.loads(out["files/native/bench.parquet"].doc) == {"columns": ["a", "b"], "row_count": 3}
    assert out["files/native/placeholder.parquet"].doc is None
    assert out["files/native/sub/health.xml"].doc is None  # bad file quarantined, folder not aborted
    assert out["files/other/noext"].format == "JSON"
    # the relative path is kept, so equal stems in two folders do not collide
    assert out["files/native/sub/health.xml"].output_key == "normalized/files/native/sub/health.json"
    s = nz.summary(nz.normalise_folder(spark, root, "normalized")).first()
    assert (s.written, s.rejected) == (7, 2)
    limited = nz.normalise_folder(spark, root, "normalized", limit=3).collect()
    assert len(limited) == 3


def test_ingest_is_idempotent_and_complete(spark, tmp_dir):
    from fablake.plans import ingest as ing

    req = ing.requests_from_tables(spark, SMOKE)
    r1 = ing.run(req, ing.BATCH_TIME)
    n_req = req.count()
    assert r1.audit.count() == n_req
    assert r1.accepted.count() + r1.quarantine.count() == n_req
    assert r1.lots.count() + r1.raws.count() == r1.accepted.count()
    # same input, same ids: a replay writes the very same rows
    r2 = ing.run(ing.requests_from_tables(spark, SMOKE), ing.BATCH_TIME)
    assert r1.accepted.select("request_id", "s3_key").exceptAll(r2.accepted.select("request_id", "s3_key")).count() == 0
    paths = ing.write(r1, os.path.join(tmp_dir, "lake"))
    ing.write(r2, os.path.join(tmp_dir, "lake"))
    assert spark.read.parquet(paths["ingestion_log"]).count() == n_req
    codes = {r.reason: r.http_status for r in r1.quarantine.select("reason", "http_status").distinct().collect()}
    assert codes.get("unknown_source", 404) == 404 and codes.get("validation", 400) == 400


def test_stream_replay_adds_nothing(spark):
    from fablake.plans.catalog import QUERIES

    batch = QUERIES["ingest_audit"](spark, SMOKE).groupBy("source", "status").count()
    streamed = QUERIES["stream_replay"](spark, SMOKE).withColumnRenamed("n_requests", "count")
    assert batch.exceptAll(streamed).count() == 0 and streamed.exceptAll(batch).count() == 0


def test_driver_contract(spark):
    import __spark_entry__ as ent

    from fablake.plans.catalog import QUERIES

    df = ent.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and df.columns == ["source", "lineage_row_count"]
    qs, ors = ent.queries(), ent.oracle_sql()
    assert set(ors) <= set(qs)
    assert set(QUERIES) <= set(qs)


def test_positional_lineage_smoke(spark):
    from fablake.plans.catalog import QUERIES

    lin = QUERIES["lineage_positional"](spark, SMOKE)
    # without drift every successful request pairs with its own curated row
    mism = lin.filter(F.col("curated_record_id") != F.col("ingestion_log_id")).count()
    assert mism == 0 and lin.filter(F.col("curated_record_id").isNull()).count() == 0
    assert QUERIES["lineage_drift"](spark, SMOKE).count() > 0


def _custom_registry(**changes):
    import copy

    import yaml

    from fablake.registry import REGISTRY_FILE, parse_registry

    raw = yaml.safe_load(REGISTRY_FILE.read_text())
    raw = copy.deepcopy(raw)
    for name, cfg in changes.items():
        raw["sources"][name] = cfg
    return parse_registry(raw)


def test_disabled_source_and_new_source_by_config(spark):
    """F-4: a disabled source is quarantined (500); D-3: a registry entry alone adds a source."""
    from fablake.plans import ingest as ing

    reg = _custom_registry(
        plm={**{"endpoint": "/plm/events", "schema": "rules/plm_lifecycle_event.json", "target_table": "raw_events",
                "stream": "plm", "raw_bucket": "b"}, "enabled": False},
        scada={"endpoint": "/scada/events", "schema": "rules/equipment_event.json", "target_table": "raw_events",
               "stream": "quality", "raw_bucket": "b", "raw_prefix": "ot/scada"},
    )
    body = json.dumps({"eventType": "ALARM", "equipmentId": "E1", "timestamp": "2024-01-01T00:00:00Z"}).encode()
    req = spark.createDataFrame(
        [("k1", "scada", "application/json", body), ("k2", "plm", "application/json", body)],
        "request_key string, source string, content_type string, body binary",
    )
    r = ing.run(req, ing.BATCH_TIME, reg)
    acc = {x.source: x for x in r.accepted.collect()}
    assert acc["scada"].stream == "quality-events" and acc["scada"].s3_key.startswith("ot/scada/2024/02/01/scada-")
    q = {x.source: (x.reason, x.http_status) for x in r.quarantine.collect()}
    assert q == {"plm": ("configuration", 500)}


def test_missing_mandatory_field_is_reported():
    reg = _custom_registry(broken={"endpoint": "/x"})
    assert any("broken" in e for e in reg.errors) and "broken" not in reg.sources
