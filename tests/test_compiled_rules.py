import json

from fablake.operators import validate as val


def test_checks_are_compiled(spark):
    """no sorting or filtering by lambda around the checks, which would run interpreted."""
    schema = {"type": "object", "additionalProperties": False, "properties": {"a": {"type": "string"}}}
    df = spark.createDataFrame([('{"a": 1, "b": 2}',)], "t string")
    out = val.validate(df.withColumn("payload", val.parse_payload(df.t)), schema)
    assert "lambda" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.first()["errors"] == ["<root>:additionalProperties", "a:type"]


def test_keys_with_separators(spark):
    """Errors that name keys of the payload stay apart, whatever the keys hold."""
    schema = {"type": "object", "additionalProperties": {"type": "string"}}
    keys = ["\x01", "\x02", "\x02a", "a\x01b", "\x02b\x01"]
    df = spark.createDataFrame([(json.dumps(dict.fromkeys(keys, 1)),)], "t string")
    out = val.validate(df.withColumn("payload", val.parse_payload(df.t)), schema).first()
    assert out["errors"] == sorted(f"{k}:type" for k in keys)
