import json

from fablake.plans import ingest as ing


def _requests(spark):
    rows = [(f"k{i}", "equipment", "application/json", bytearray(json.dumps(
        {"eventType": "E", "equipmentId": str(i) if i % 3 else i, "timestamp": "2024-01-01T00:00:00Z"}).encode())) for i in range(30)]
    return spark.createDataFrame(rows, "request_key string, source string, content_type string, body binary")


def test_rules_run_once_without_a_kept_batch(spark):
    """F5 to F13: one output of the ingest job keeps nothing, and its filter does not evaluate the rules a second time."""
    result = ing.run(_requests(spark), ing.BATCH_TIME, persist=False)
    for df, n in ((result.accepted, 20), (result.quarantine, 10)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "InMemoryRelation" not in plan
        filters = [line for line in plan.splitlines() if "Filter" in line]
        assert not any("try_variant_get" in line for line in filters)
        assert df.count() == n


def test_a_payload_is_opened_once_for_its_rule(spark):
    """F7 to F12: the keys of a payload come from one map, and one array tells a single document from several."""
    result = ing.run(_requests(spark).filter("source = 'equipment'"), ing.BATCH_TIME, persist=False)
    plan = result.quarantine._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapType(StringType,VariantType,true)") == 1
    assert "$[0]" not in plan and ", VariantType," not in plan


def test_strict_documents_as_before(spark):
    from pyspark.sql import functions as F

    from fablake.functions.jsondoc import strict_parse_json

    texts = ['{"a":null}', "null", "[1,2]", '{"a":1} x', '{"a":1},2', '{"a":1}\n{"a":2}', "1],[2", "", " ", "{", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", F.to_json(strict_parse_json(F.col("t"))).alias("j"))
    assert [r.j for r in rows.orderBy("i").collect()] == ['{"a":null}', "null", "[1,2]", *[None] * 8]


def test_extra_and_null_keys_are_told_apart(spark):
    from fablake.operators import validate as val
    from pyspark.sql import functions as F

    rule = {"type": "object", "additionalProperties": False, "required": ["a", "b"],
            "properties": {"a": {"type": "string"}, "b": {"type": ["object", "null"], "properties": {"c": {"type": "integer"}}}}}
    texts = {'{"a":"x","b":null}': [], '{"a":"x","b":{"c":"1"}}': ["b.c:type"], '{"a":"x"}': ["<root>:required(b)"], "[]": ["<root>:type"],
             '{"a":"x","b":{},"z":null}': ["<root>:additionalProperties"], '{"a":null,"z":1}': ["<root>:additionalProperties", "<root>:required(b)", "a:type"]}
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("payload", F.parse_json("t"))
    assert {r.t: r.errors for r in val.validate(df, rule).collect()} == texts
