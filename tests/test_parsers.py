"""S-7 .. S-13 parsers against the behaviour of Python's own readers."""

import csv
import io
import json

import pytest

from fablake.sources import formats as fmt
from fablake.sources import parsers as prs

CSV_CASES = [
    "a,b\n1,2\n3,4\n",
    "a,b\n1\n",                      # short row -> null
    "a,b\n1,2,3\n",                  # long row -> key null
    "a,b\n1,2\n\n3,4",               # blank line skipped
    "a,a\n1,2\n",                    # duplicate header -> last wins
    "\na,b\n1,2",                    # blank first line -> rejected
    "",                              # empty body -> rejected
    "﻿a,b\r\n1,2\r\n",          # BOM kept on first name
    'a,b\n"x,1","y""z"\n',           # quoted comma and quote
    'a,b\n"multi\nline",2\n',        # quoted line break
    "a,b\n,\n",                      # empty cells
]


def _python_csv(body: str):
    r = csv.DictReader(io.StringIO(body))
    if not r.fieldnames:
        return None
    rows = list(r)
    return json.loads(json.dumps({"columns": r.fieldnames, "rows": rows, "row_count": len(rows)}))


def test_csv_matches_python_reader(spark):
    df = spark.createDataFrame([(i, c.encode()) for i, c in enumerate(CSV_CASES)], "i int, content binary")
    got = {r.i: (json.loads(r.doc) if r.doc else None) for r in prs.parse_csv(df).collect()}
    for i, body in enumerate(CSV_CASES):
        assert got[i] == _python_csv(body), body


def test_json_wraps_and_rejects(spark):
    bodies = [b'{"a": 1}', b"[1, 2]", b"12.5", b'"x"', b"{bad", b"\xff\xfe",
              b'{"a": 1}\n{"b": 2}', b'{"a": 1} x', b"1,2", b"1],[2", b"  ", b' {"a": 1} \n']
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, content binary")
    out = {r.i: r for r in prs.parse_json(df).collect()}
    assert json.loads(out[0].doc) == {"a": 1}
    assert json.loads(out[1].doc) == {"value": [1, 2]}
    assert json.loads(out[2].doc) == {"value": 12.5}
    assert json.loads(out[3].doc) == {"value": "x"}
    assert out[4].doc is None and out[4].reject
    assert out[5].doc is None and "UTF-8" in out[5].reject
    # one document only: JSON lines, trailing content and bare lists are rejected (as json.loads does)
    for i in (6, 7, 8, 9, 10):
        assert out[i].doc is None, bodies[i]
    assert json.loads(out[11].doc) == {"a": 1}


def test_text_binary(spark):
    import base64

    df = spark.createDataFrame([(0, "héllo\n".encode()), (1, b"\xff")], "i int, content binary")
    t = {r.i: r for r in prs.parse_text(df).collect()}
    assert json.loads(t[0].doc) == {"text": "héllo\n"}
    assert t[1].doc is None
    b = {r.i: r for r in prs.parse_binary(df).collect()}
    assert json.loads(b[1].doc) == {"content_base64": base64.b64encode(b"\xff").decode()}


def test_xml_shape(spark):
    body = b'<health id="7"><host>h1</host><tag>a</tag><tag>b</tag><empty/><note lang="en">hi</note>tail</health>'
    df = spark.createDataFrame([(0, body), (1, b"<broken>")], "i int, content binary")
    out = {r.i: r for r in prs.parse_xml(df).collect()}
    assert json.loads(out[0].doc) == {
        "health": {
            "@attributes": {"id": "7"}, "host": "h1", "tag": ["a", "b"], "empty": "",
            "note": {"@attributes": {"lang": "en"}, "#text": "hi"},
        }
    }
    assert out[1].doc is None


def test_yaml_scalars(spark):
    df = spark.createDataFrame([(0, b"a: yes\nb: 012\nc: 2024-01-15\n"), (1, b"- 1\n- 2\n"), (2, b"a: [")],
                               "i int, content binary")
    out = {r.i: r for r in prs.parse_yaml(df).collect()}
    assert json.loads(out[0].doc) == {"a": True, "b": 10, "c": "2024-01-15"}
    assert json.loads(out[1].doc) == {"value": [1, 2]}
    assert out[2].doc is None


@pytest.mark.parametrize(
    "key,declared,expected",
    [
        ("a/b/x.CSV", None, "CSV"), ("x.yml", None, "YAML"), ("x.h5", None, "HDF5"), ("x.tar.gz", None, "JSON"),
        ("x.bin", "AVRO", "AVRO"), (".env", None, "JSON"), ("noext", "yaml", "yaml"),
    ],
)
def test_format_from_key(spark, key, declared, expected):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(key, declared)], "k string, d string")
    got = df.select(fmt.format_from_key(F.col("k"), F.col("d")).alias("f")).first().f
    assert got == expected


@pytest.mark.parametrize(
    "ctype,declared,expected",
    [
        ("application/json; charset=utf-8", None, "JSON"), ("TEXT/CSV", None, "CSV"),
        ("application/octet-stream", None, "BINARY"), (None, None, "JSON"), ("image/png", None, "JSON"),
        ("text/csv", " yaml ", "YAML"), ("text/csv", "nonsense", "CSV"),
    ],
)
def test_resolve_format(spark, ctype, declared, expected):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(ctype, declared)], "c string, d string")
    assert df.select(fmt.resolve_format(F.col("c"), F.col("d")).alias("f")).first().f == expected
