"""V-1 .. V-22: the rule compiler against JSON Schema semantics, and the rule files
against the platform's sample payloads (valid ones pass, invalid ones fail)."""

import json

import pytest
from pyspark.sql import functions as F

from fablake.operators import validate as val
from fablake.registry import load_registry, load_rule


def _errors(spark, schema, docs):
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "i int, t string")
    df = df.withColumn("payload", F.try_parse_json("t"))
    out = val.validate(df, schema).orderBy("i").collect()
    return [list(r.errors) for r in out]


def test_types_and_integer(spark):
    schema = {"type": "object", "properties": {"n": {"type": "integer"}, "x": {"type": "number"}}}
    got = _errors(spark, schema, [{"n": 25}, {"n": 25.0}, {"n": 25.5}, {"n": True}, {"x": True}, {"x": "1"}, [1]])
    assert got == [[], [], ["n:type"], ["n:type"], ["x:type"], ["x:type"], ["<root>:type"]]


def test_required_null_counts_as_present(spark):
    schema = {"type": "object", "required": ["a", "b"]}
    got = _errors(spark, schema, [{"a": None, "b": 1}, {"b": 1}, {}])
    assert got == [[], ["<root>:required(a)"], ["<root>:required(a)", "<root>:required(b)"]]


def test_keywords_only_test_their_type(spark):
    schema = {"properties": {"s": {"minLength": 2, "maximum": 3, "minItems": 1, "required": ["z"]}}}
    assert _errors(spark, schema, [{"s": 10}, {"s": "a"}, {"s": []}, {"s": {}}]) == [
        ["s:maximum"], ["s:minLength"], ["s:minItems"], ["s:required(z)"]
    ]


def test_pattern_is_a_search_with_python_dollar(spark):
    schema = {"properties": {"v": {"type": "string", "pattern": "^v[0-9]+$"}, "w": {"pattern": "b"}}}
    # '$' matches before a final newline (Python), pattern is unanchored (search)
    assert _errors(spark, schema, [{"v": "v1\n"}, {"v": "v1\r"}, {"w": "abc"}, {"w": "x"}]) == [
        [], ["v:pattern"], [], ["w:pattern"]
    ]


def test_one_of_rejects_integers_matching_two_branches(spark):
    schema = {"type": "array", "items": {"oneOf": [{"type": "string"}, {"type": "number"}, {"type": "integer"}]}}
    assert _errors(spark, schema, [["a", 1.5], ["a", 1], [2.0]]) == [[], ["1:oneOf"], ["0:oneOf"]]


def test_additional_properties(spark):
    schema = {"type": "object", "properties": {"a": {}}, "additionalProperties": False}
    assert _errors(spark, schema, [{"a": 1}, {"a": 1, "b": 2, "c": 3}]) == [[], ["<root>:additionalProperties"]]
    schema2 = {"type": "object", "additionalProperties": {"type": "string"}}
    assert _errors(spark, schema2, [{"x": "1", "y": 2}]) == [["y:type"]]


def test_if_then_vacuous_when_absent(spark):
    schema = {"if": {"properties": {"k": {"const": "A"}}}, "then": {"required": ["a"]}}
    # k absent -> if holds -> then applies
    assert _errors(spark, schema, [{"k": "A"}, {"k": "B"}, {}]) == [
        ["<root>:required(a)"], [], ["<root>:required(a)"]
    ]


def test_unparsable_payload(spark):
    df = spark.createDataFrame([(0, "{bad")], "i int, t string").withColumn("payload", F.try_parse_json("t"))
    assert list(val.validate(df, {"type": "object"}).first().errors) == ["<root>:parse"]


VALID = {
    "mes": {"eventType": "LOT_COMPLETED", "lotId": "LOT-001", "recipeId": "R1", "equipmentId": "E1",
            "waferCount": 25, "temperature": 180.5, "timestamp": "2026-07-15T10:30:00Z"},
    "erp": {"eventType": "WORK_ORDER_RELEASED", "workOrderId": "WO-1", "timestamp": "2026-07-15T10:30:00Z",
            "plant": "P1"},
    "equipment": {"eventType": "STATUS", "equipmentId": "E1", "timestamp": "t", "chamber": "A"},
    "plm": {"eventType": "ECO_RELEASED", "changeOrderId": "ECO-1", "partNumber": "PN-1",
            "lifecycleState": "RELEASED", "owner": "o", "timestamp": "t"},
    "telemetry": {"eventType": "T", "equipmentId": "E1", "timestamp": "t",
                  "metrics": {"temperature": 1.5, "pressure": 2}},
    "yield": {"eventType": "Y", "lotId": "L", "yieldRate": 0.97, "timestamp": "t"},
    "file_multiformat": {
        "eventType": "FILE_INGESTED", "timestamp": "t",
        "metadata": {"sourceSystem": "s", "fileName": "f.yaml", "category": "configuration", "format": "YAML",
                     "contentVersion": "v1.0"},
        "file": {"contentEncoding": "TEXT", "content": "a: 1"},
    },
    "file_csv": {
        "eventType": "FILE_INGESTED", "timestamp": "t",
        "metadata": {"sourceSystem": "s", "fileName": "f.csv", "fileType": "CSV", "structure": "ROW_BASED",
                     "contentVersion": "v1"},
        "file": {"delimiter": ",", "hasHeader": True, "columns": ["a"], "rows": [["x", 1.5, True, None]]},
    },
}

INVALID = [
    ("mes", {"eventType": "LOT_COMPLETED", "lotId": "LOT-001", "recipeId": "R1", "waferCount": "25",
             "timestamp": "not-a-time"},
     ["<root>:required(equipmentId)", "<root>:required(temperature)", "waferCount:type"]),
    ("erp", {"eventType": "X", "workOrderId": 123, "timestamp": "t"}, ["workOrderId:type"]),
    ("equipment", {"eventType": "X", "equipmentId": None, "timestamp": "t"}, ["equipmentId:type"]),
    ("plm", {"eventType": "ECO_RELEASED", "changeOrderId": "c", "partNumber": "p", "lifecycleState": "RETIRED",
             "timestamp": "t"}, ["lifecycleState:enum"]),
    ("file_multiformat", dict(VALID["file_multiformat"], metadata=dict(
        VALID["file_multiformat"]["metadata"], category="manufacturing", format="Kafka")), ["metadata.format:enum"]),
    ("file_csv", dict(VALID["file_csv"], file=dict(VALID["file_csv"]["file"], delimiter="\t")), ["file.delimiter:enum"]),
]


@pytest.mark.parametrize("source", sorted(VALID))
def test_valid_samples_pass(spark, source):
    assert _errors(spark, load_registry().rule(source), [VALID[source]]) == [[]]


@pytest.mark.parametrize("source,doc,expected", INVALID)
def test_invalid_samples_fail(spark, source, doc, expected):
    assert _errors(spark, load_registry().rule(source), [doc]) == [sorted(expected)]


def test_file_content_one_of(spark):
    rule = load_rule("rules/file_content_event.json")
    docs = [
        {"metadata": {"fileType": "JSON", "structure": "OBJECT"}, "file": {"content": {}}},
        {"metadata": {"fileType": "PARQUET", "structure": "ROW_BASED"}, "file": {}},
    ]
    assert _errors(spark, rule, docs) == [[], ["<root>:oneOf"]]


def test_validate_by_source_single_output(spark):
    docs = [("mes", json.dumps(VALID["mes"])), ("erp", json.dumps({"eventType": "x"})), ("other", "{}")]
    df = spark.createDataFrame(docs, "source string, t string").withColumn("payload", F.try_parse_json("t"))
    out = {r.source: list(r.errors) for r in val.validate_by_source(df, ["mes", "erp"]).collect()}
    assert out == {"mes": [], "erp": ["<root>:required(timestamp)", "<root>:required(workOrderId)"], "other": []}
