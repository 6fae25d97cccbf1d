"""Source payloads derived from the driver tables, with planted defects.

Every payload is JSON text built by Spark expressions. Defect classes are
chosen by a key modulo so the oracle can state the expected errors per class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fablake.registry import load_registry
from fablake.session import spread
from fablake.sources.tables import read_table

ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def jstr(c: Column) -> Column:
    """JSON string literal of a string column (proper escaping via to_json)."""
    return F.regexp_extract(F.to_json(F.array(c.cast("string"))), r"^\[(.*)\]$", 1)


def jnum(c: Column) -> Column:
    return c.cast("string")


def vs(c: Column) -> Column:
    """A JSON string value (VARIANT)."""
    return c.cast("string").cast("variant")


def vn(c: Column) -> Column:
    """A JSON number / boolean value (VARIANT)."""
    return c.cast("variant")


def json_null() -> Column:
    return F.parse_json(F.lit("null"))


def absent() -> Column:
    return F.lit(None).cast("variant")


def vobj(*pairs: tuple[str, Column]) -> Column:
    """One JSON object per row in a single serializer call: a SQL NULL value drops
    the key, ``json_null()`` writes an explicit null."""
    return F.struct(*[v.alias(k) for k, v in pairs])


def vtext(obj: Column) -> Column:
    return F.to_json(obj)


def jobj(*pairs: tuple[str, Column | None]) -> Column:
    """JSON object text; a NULL value column means the key is absent."""
    frags = [F.concat(F.lit(f'"{k}":'), v) for k, v in pairs if v is not None]
    return F.concat(F.lit("{"), F.concat_ws(",", *frags), F.lit("}"))


# ---------------------------------------------------------------------------
# mes payloads from lineitem; defect = l_partkey % 11
#  0 no lotId, 1 waferCount as text, 2 waferCount 0, 3 wrong eventType,
#  4 extra key, 5 '#' in lotId, 6 bad timestamp (passes the rule),
#  7 equipmentId null, else valid
# ---------------------------------------------------------------------------


def mes_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spread(read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"))
    d = F.col("l_partkey") % 11
    qty = F.col("l_quantity").cast("int")
    # typed values where a key has one type in every row: the serializer writes them as it does a VARIANT, with less work
    payload = vobj(
        ("eventType", F.when(d == 3, F.lit("LOT_STARTED")).otherwise(F.lit("LOT_COMPLETED"))),
        ("lotId", F.when((d != 0) | d.isNull(), F.concat(
            F.when(d == 5, F.lit("LOT#")).otherwise(F.lit("LOT-")), F.col("l_orderkey").cast("string")))),
        ("recipeId", F.concat(F.lit("REC"), F.col("l_suppkey").cast("string"))),
        ("equipmentId", F.when(d == 7, json_null()).otherwise(vs(F.concat(F.lit("EQ"), F.col("l_linenumber").cast("string"))))),
        ("waferCount", F.when(d == 1, vs(qty)).when(d == 2, vn(F.lit(0))).otherwise(vn(qty))),
        ("temperature", F.col("l_extendedprice") / 100),
        ("timestamp", F.when(d == 6, F.lit("not-a-timestamp")).otherwise(F.date_format("l_shipdate", ISO))),
        ("operator", F.when(d == 4, F.lit("night"))),
    )
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate",
        F.lit("mes").alias("source"),
        vtext(payload).alias("payload_text"),
    )


# ---------------------------------------------------------------------------
# erp / equipment / plm / telemetry payloads from events; defect = event_id % 7
# ---------------------------------------------------------------------------


def event_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = spread(read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value"))
    d = F.col("event_id") % 7
    ts = vs(F.date_format("ts", ISO))
    eid = F.col("event_id")
    uid = F.col("user_id")

    def when(cond: Column, value: Column) -> Column:
        return F.when(cond, value).otherwise(absent())

    erp = vobj(
        ("eventType", vs(F.lit("WORK_ORDER_RELEASED"))),
        ("workOrderId", F.when(d == 0, vn(eid)).otherwise(vs(F.concat(F.lit("WO-"), eid.cast("string"))))),
        ("timestamp", when(d != 1, ts)),
        ("plant", vs(F.concat(F.lit("P"), (uid % 5).cast("string")))),
        ("priority", vn(F.col("value"))),
    )
    equipment = vobj(
        ("eventType", when(d != 1, vs(F.lit("STATUS_CHANGED")))),
        ("equipmentId", F.when(d == 0, json_null()).otherwise(vs(F.concat(F.lit("EQ-"), uid.cast("string"))))),
        ("timestamp", ts),
        ("status", vs(F.lit("IDLE"))),
    )
    plm = vobj(
        ("eventType", vs(F.when(d == 1, F.lit("ECO_DRAFT")).otherwise(F.lit("ECO_RELEASED")))),
        ("changeOrderId", vs(F.concat(F.lit("ECO-"), eid.cast("string")))),
        ("partNumber", when(d != 2, vs(F.concat(F.lit("PN-"), uid.cast("string"))))),
        ("lifecycleState", vs(F.when(d == 0, F.lit("ARCHIVED")).otherwise(F.lit("RELEASED")))),
        ("owner", F.when(d == 3, vn(uid)).otherwise(vs(F.concat(F.lit("u"), uid.cast("string"))))),
        ("timestamp", ts),
    )
    temperature = F.when(d == 1, vs(F.col("value"))).when(d == 3, vn(F.lit(True))).otherwise(vn(F.col("value")))
    # to_variant_object keeps NULL fields as JSON null, so the missing key gets its own struct
    metrics = (
        F.when(d == 2, vn(F.lit(5)))
        .when(d == 0, F.to_variant_object(vobj(("temperature", temperature))))
        .otherwise(F.to_variant_object(vobj(("temperature", temperature), ("pressure", vn(uid)))))
    )
    telemetry = vobj(
        ("eventType", vs(F.lit("TELEMETRY"))),
        ("equipmentId", vs(F.concat(F.lit("EQ-"), uid.cast("string")))),
        ("timestamp", ts),
        ("metrics", metrics),
    )
    et = F.col("event_type")
    src = (F.when(et == "purchase", "erp").when(et == "view", "equipment")
           .when(et == "signup", "plm").when(et == "error", "telemetry"))
    text = (F.when(et == "purchase", vtext(erp)).when(et == "view", vtext(equipment))
            .when(et == "signup", vtext(plm)).when(et == "error", vtext(telemetry)))
    return ev.filter(et != "click").select("event_id", src.alias("source"), text.alias("payload_text"))


# ---------------------------------------------------------------------------
# yield CSV records from orders: cells are text; yieldRate 'n/a' when o_orderkey % 13 = 0
# ---------------------------------------------------------------------------


def yield_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    rate = F.when(F.col("o_orderkey") % 13 == 0, F.lit("n/a")).otherwise(
        F.format_number(F.col("o_totalprice") / 500000, 4)
    )
    record = F.create_map(
        F.lit("eventType"), F.lit("YIELD_MEASURED"),
        F.lit("lotId"), F.concat(F.lit("LOT-"), F.col("o_orderkey").cast("string")),
        F.lit("yieldRate"), rate,
        F.lit("timestamp"), F.date_format("o_orderdate", ISO),
    )
    return o.select("o_orderkey", record.alias("record"))


# ---------------------------------------------------------------------------
# file envelopes
# ---------------------------------------------------------------------------


def _meta(source_system: Column, file_name: Column, file_type: str, structure: Column, version: Column) -> Column:
    return F.struct(
        source_system.alias("sourceSystem"), file_name.alias("fileName"), F.lit(file_type).alias("fileType"),
        structure.alias("structure"), version.alias("contentVersion"),
    )


def csv_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer in chunks of 50 (chunk = c_custkey div 50); defect = chunk % 5.

    0 file name not .csv, 1 bad version, 2 no columns, 3 real tab as delimiter.
    c_acctbal cells are numbers: whole values match both number and integer (oneOf).
    """
    c = read_table(spark, sf_dir, "customer")
    chunked = c.groupBy((F.col("c_custkey") / 50).cast("long").alias("chunk")).agg(
        F.array_sort(
            F.collect_list(F.struct("c_custkey", "c_name", "c_acctbal", "c_mktsegment"))
        ).alias("recs")
    )
    d = F.col("chunk") % 5
    rows_json = F.transform(
        "recs",
        lambda r: F.concat(
            F.lit("["), jstr(r["c_custkey"].cast("string")), F.lit(","), jstr(r["c_name"]), F.lit(","),
            jnum(r["c_acctbal"]), F.lit(","), jstr(r["c_mktsegment"]), F.lit("]"),
        ),
    )
    columns = F.when(d == 2, F.lit("[]")).otherwise(F.lit('["c_custkey","c_name","c_acctbal","c_mktsegment"]'))
    meta = jobj(
        ("sourceSystem", jstr(F.lit("crm"))),
        ("fileName", jstr(F.concat(F.lit("customers_"), F.col("chunk"), F.when(d == 0, F.lit(".txt")).otherwise(F.lit(".csv"))))),
        ("fileType", jstr(F.lit("CSV"))),
        ("structure", jstr(F.lit("ROW_BASED"))),
        ("contentVersion", F.when(d == 1, jstr(F.lit("1.0"))).otherwise(jstr(F.lit("v1.2")))),
    )
    file = jobj(
        ("delimiter", F.when(d == 3, jstr(F.lit("\t"))).otherwise(jstr(F.lit(",")))),
        ("hasHeader", F.lit("true")),
        ("columns", columns),
        ("rows", F.concat(F.lit("["), F.array_join(rows_json, ","), F.lit("]"))),
    )
    env = jobj(
        ("eventType", jstr(F.lit("FILE_INGESTED"))), ("timestamp", jstr(F.lit("2024-01-01T00:00:00Z"))),
        ("metadata", meta), ("file", file),
    )
    return chunked.select(F.col("chunk").alias("envelope_id"), F.lit("file_csv").alias("source"), env.alias("payload_text"))


def xml_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation records per region. Even regions carry n_nationkey as a number
    (rejected by the scalar oneOf); region 1 bad root tag, 3 no records,
    4 a namespace that is not a string."""
    n = read_table(spark, sf_dir, "nation")
    g = n.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("recs"))
    r = F.col("n_regionkey")
    rec = F.transform(
        "recs",
        lambda x: jobj(
            ("n_nationkey", F.when(r % 2 == 0, jnum(x["n_nationkey"])).otherwise(jstr(x["n_nationkey"].cast("string")))),
            ("n_name", jstr(x["n_name"])),
        ),
    )
    records = F.when(r == 3, F.lit("[]")).otherwise(F.concat(F.lit("["), F.array_join(rec, ","), F.lit("]")))
    meta = jobj(
        ("sourceSystem", jstr(F.lit("geo"))),
        ("fileName", jstr(F.concat(F.lit("nations_"), r, F.lit(".xml")))),
        ("fileType", jstr(F.lit("XML"))),
        ("structure", jstr(F.lit("TREE"))),
        ("contentVersion", jstr(F.lit("v2"))),
    )
    file = jobj(
        ("rootTag", F.when(r == 1, jstr(F.lit("1nations"))).otherwise(jstr(F.lit("nations")))),
        ("namespaces", F.when(r == 4, F.lit('{"x":5}')).otherwise(F.lit('{"geo":"http://example.org/geo"}'))),
        ("records", records),
    )
    env = jobj(
        ("eventType", jstr(F.lit("FILE_INGESTED"))), ("timestamp", jstr(F.lit("2024-01-01T00:00:00Z"))),
        ("metadata", meta), ("file", file),
    )
    return g.select(r.alias("envelope_id"), F.lit("file_xml").alias("source"), env.alias("payload_text"))


def json_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """supplier chunks of 10 (chunk = s_suppkey div 10); kind = chunk % 4.

    0 OBJECT with an object, 1 ARRAY of names, 2 OBJECT holding an array
    (fails the if/then), 3 JSONL of whole numbers (fails the content oneOf).
    """
    s = read_table(spark, sf_dir, "supplier")
    g = s.groupBy((F.col("s_suppkey") / 10).cast("long").alias("chunk")).agg(
        F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name"))).alias("recs")
    )
    k = F.col("chunk") % 4
    names = F.concat(F.lit("["), F.array_join(F.transform("recs", lambda x: jstr(x["s_name"])), ","), F.lit("]"))
    keys = F.concat(F.lit("["), F.array_join(F.transform("recs", lambda x: x["s_suppkey"].cast("string")), ","), F.lit("]"))
    content = (F.when(k == 0, jobj(("count", jnum(F.size("recs")))))
               .when(k == 3, keys).otherwise(names))
    structure = F.when(k == 1, "ARRAY").when(k == 3, "JSONL").otherwise("OBJECT")
    meta = jobj(
        ("sourceSystem", jstr(F.lit("srm"))),
        ("fileName", jstr(F.concat(F.lit("suppliers_"), F.col("chunk"), F.lit(".json")))),
        ("fileType", jstr(F.lit("JSON"))),
        ("structure", jstr(structure)),
        ("contentVersion", jstr(F.lit("v1"))),
    )
    env = jobj(
        ("eventType", jstr(F.lit("FILE_INGESTED"))), ("timestamp", jstr(F.lit("2024-01-01T00:00:00Z"))),
        ("metadata", meta), ("file", jobj(("content", content))),
    )
    return g.select(F.col("chunk").alias("envelope_id"), F.lit("file_json").alias("source"), env.alias("payload_text"))


def multiformat_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents: category = categories[doc_id % 10], format = formats[doc_id % 21]."""
    reg = load_registry()
    cats = list(reg.categories)
    fmts = reg.formats()
    docs = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    cat = F.element_at(F.array(*[F.lit(c) for c in cats]), (F.col("doc_id") % len(cats) + 1).cast("int"))
    fmt = F.element_at(F.array(*[F.lit(f) for f in fmts]), (F.col("doc_id") % len(fmts) + 1).cast("int"))
    env = F.to_json(
        F.struct(
            F.lit("FILE_INGESTED").alias("eventType"),
            F.lit("2024-01-01T00:00:00Z").alias("timestamp"),
            F.struct(
                F.lit("docs").alias("sourceSystem"),
                F.concat(F.lit("doc-"), F.col("doc_id"), F.lit(".txt")).alias("fileName"),
                cat.alias("category"), fmt.alias("format"), F.lit("v1").alias("contentVersion"),
            ).alias("metadata"),
            F.struct(F.lit("TEXT").alias("contentEncoding"), F.col("text").alias("content")).alias("file"),
        )
    )
    return docs.select("doc_id", cat.alias("category"), fmt.alias("format"), env.alias("payload_text"))
