"""Ranking, repository, governance, search and reconciliation operators on small data."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from fablake.operators import governance as gov
from fablake.operators import reconcile as rec
from fablake.operators import repository as repo
from fablake.operators import search as srch
from fablake.operators.ranking import distributed_row_number, latest_per_key


def test_distributed_row_number_equals_window_on_skewed_keys(spark):
    rnd = random.Random(7)
    rows = [("hot" if i % 3 else f"k{i % 5}", rnd.randint(0, 50), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "key string, ts int, id int")
    got = distributed_row_number(df, ["key"], ["ts", "id"])
    w = Window.partitionBy("key").orderBy("ts", "id")
    exp = df.withColumn("rn", F.row_number().over(w).cast("bigint"))
    assert got.exceptAll(exp).count() == 0 and exp.exceptAll(got).count() == 0


def test_distributed_row_number_without_partition_keys(spark):
    df = spark.createDataFrame([(i % 13, i) for i in range(500)], "ts int, id int")
    got = {r.id: r.rn for r in distributed_row_number(df, [], ["ts", "id"]).collect()}
    ordered = sorted(range(500), key=lambda i: (i % 13, i))
    assert got == {i: n + 1 for n, i in enumerate(ordered)}


def test_latest_per_key(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 3, 2), ("a", 3, 3), ("b", 2, 4)], "k string, t int, id int")
    got = sorted(tuple(r) for r in latest_per_key(df, ["k"], ["t", "id"]).collect())
    assert got == [("a", 3, 3), ("b", 2, 4)]


def test_repository_golden_cases(spark):
    raws = spark.createDataFrame(
        [(1, "erp", "2024-01-01 00:00:01"), (2, "erp", "2024-01-01 00:00:02"), (3, "equipment", "2024-01-01 00:00:03")],
        "id int, source string, created_at string",
    )
    assert [r.id for r in repo.newest_of_source(raws, "erp").collect()] == [2, 1]
    log = spark.createDataFrame([(1, "req-1"), (2, "req-1"), (3, "req-2")], "id int, request_id string")
    keys = spark.createDataFrame([("req-1",)], "request_id string")
    assert repo.lookup_by_keys(log, keys, "request_id", "inner").count() == 2
    assert [r.id for r in repo.page(raws, limit=1, offset=1).collect()] == [2]


def test_upsert_and_delete(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    changes = spark.createDataFrame([(2, "B"), (3, "c")], "id int, v string")
    assert sorted(tuple(r) for r in repo.upsert(base, changes).collect()) == [(1, "a"), (2, "B"), (3, "c")]
    kept, gone = repo.delete_returning(base, spark.createDataFrame([(2,)], "id int"))
    assert [r.id for r in kept.collect()] == [1] and [r.id for r in gone.collect()] == [2]


def test_constraints(spark):
    df = spark.createDataFrame([(1, "x" * 70), (1, None)], "id int, name string")
    out = {(r.rule, r.column_name): r.violations
           for r in repo.constraint_violations(df, "t", ["name"], {"name": 64}).collect()}
    assert out == {("not_null", "name"): 1, ("max_length_64", "name"): 1, ("unique", "id"): 1}


def test_access_policy_default_deny(spark):
    pol = spark.createDataFrame([("telemetry", "analyst", "read", "internal")],
                                "asset_class string, subject string, operation string, classification string")
    req = spark.createDataFrame([("telemetry", "analyst", "read"), ("telemetry", "viewer", "read")],
                                "asset_class string, subject string, operation string")
    got = {r.subject: r.allowed for r in gov.access_decision(req, pol).collect()}
    assert got == {"analyst": True, "viewer": False}
    assert [r.subject for r in gov.denied_requests(req, pol).collect()] == ["viewer"]


def test_lot_lineage(spark):
    trace = spark.createDataFrame([("LOT-1", "W1"), ("LOT-2", "W1")], "lot_id string, wafer_id string")
    lots = spark.createDataFrame([("LOT-1",)], "lot_id string")
    assert [tuple(r) for r in gov.lineage_of_lots(trace, lots).collect()] == [("LOT-1", "W1")]


def _brute(docs, queries, k):
    out = set()
    for qid, q in queries:
        hits = sorted(d for d, c in docs if q.lower() in c.lower())[:k]
        out |= {(qid, d, 1, i + 1) for i, d in enumerate(hits)}
    return out


def test_search_batch_equals_brute_force(spark):
    rnd = random.Random(3)
    words = ["tool", "calibration", "wafer", "lot", "etch", "Ätz", "über", "gate", "oxide", "anneal"]
    docs = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 30)))) for i in range(300)]
    queries = [(0, "tool calibration"), (1, ""), (2, "wafer lot etch gate"), (3, "ol calibration wa"),
               (4, "ÄTZ ÜBER"), (5, "nothing here at all"), (6, "oxide anneal tool wafer lot")]
    ddf = spark.createDataFrame(docs, "doc_id long, content string")
    qdf = spark.createDataFrame(queries, "query_id long, query string")
    got = {tuple(r) for r in srch.search_batch(ddf, qdf, 5).select("query_id", "doc_id", "score", "rank").collect()}
    assert got == _brute(docs, queries, 5)


def test_search_single(spark):
    docs = spark.createDataFrame([(1, "doc-1", "Tool Calibration report"), (2, "doc-2", "other")],
                                 "doc_id long, title string, content string")
    assert [r.doc_id for r in srch.search(docs, "tool calibration").collect()] == [1]


def test_reconcile_flags_gap(spark):
    b = spark.createDataFrame([("plm",)] * 4 + [("mes",)] * 2, "source string")
    s = spark.createDataFrame([("plm",)] * 3 + [("mes",)] * 2, "source string")
    c = spark.createDataFrame([("plm",)] * 3 + [("mes",)] * 2, "source string")
    out = {r.source: (r.status, r.consistent) for r in rec.reconcile(b, s, c).collect()}
    assert out == {"plm": ("PASS", False), "mes": ("PASS", True)}
    assert rec.overall(rec.reconcile(b, s, c)).first().overall_status == "PASS"
