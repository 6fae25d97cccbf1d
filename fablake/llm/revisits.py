"""WARC revisit records resolved by an as-of join.

A revisit (the server answered 304, not modified) refers to the latest earlier full response (200) of
the same canonical URL.  It is resolved if the validators agree, and then takes the response's payload
and headers, updated by those headers that a 304 may carry.

The join cannot send a URL to one task, since one URL may hold a third of all records.  Records are
dealt by range over (URL, time), so a hot URL spreads over neighbouring ranges; each range finds the
latest response among its own rows, and one row for each (URL, range) carries the latest response on to
the ranges behind it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fablake.llm.common import kept, table

# fixed values: the headers of a 304 answer that update the stored ones (RFC 9110, 15.4.5)
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
# fixed values: query parameters that do not change the page
TRACKING = r"^(?:utm_[a-z]+|fbclid|gclid|ref)(?:=|$)"


def canonical_url(url: Column) -> Column:
    """host (lower case, no www., no default port) + path (at least /) + the other query parameters, sorted.
    Scheme, user and fragment go.  Null without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    rest = F.regexp_replace(rest, r"(?s)#.*$", "")
    host = F.lower(F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*", 0), r"^.*@", ""))
    host = F.regexp_replace(F.regexp_replace(host, r":(?:80|443)$", ""), r"^www\.", "")
    path = F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1)
    query = F.regexp_extract(rest, r"(?s)\?(.*)$", 1)
    params = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.concat(host, F.when(path == "", "/").otherwise(path), F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&")))
                    .otherwise(""))


def resolve(records: DataFrame) -> DataFrame:
    """``records`` (record_id long, url, captured_at long, status int, etag, last_modified, headers map of
    lower-case names, payload) -> record_id, url_key, captured_at, status, refers_to, outcome, headers, payload.

    outcome: ``response`` (not a 304; as it was), ``resolved``, ``changed`` (the latest earlier response has
    another validator), ``unverified`` (no validator that both carry), ``no response`` (none earlier), ``no key``
    (no URL or no time).  Only a resolved one gets the response's payload and merged headers; else both stay.
    A full response is a status of 200.  Of responses at the revisit's own time the one with the smaller
    record_id counts as earlier; ties go by record_id.  Weak and strong ETags with equal text agree.  Repeated
    rows stay.  Other columns are ignored.
    """
    wanted = ["record_id", "url_key", "captured_at", "status", "etag", "last_modified", "headers", "payload"]
    rows = records.withColumn("url_key", canonical_url(F.col("url"))).select(*wanted)
    known = F.col("url_key").isNotNull() & F.col("captured_at").isNotNull() & F.col("record_id").isNotNull()
    revisit = F.coalesce(F.col("status") == 304, F.lit(False))
    order = ["captured_at", "record_id"]
    key = ["url_key", *order]
    # a response's payload stays out of the as-of join and comes to the revisits that get it, in one join by its key
    events = rows.filter(known & F.col("status").isin(200, 304)).withColumn("payload", F.when(revisit, F.col("payload")))
    dealt = events.repartitionByRange(*key).withColumn("range", F.spark_partition_id())
    dealt = kept(dealt, "records")

    response = F.struct(*order, "etag", "last_modified", "headers")
    within = Window.partitionBy("url_key", "range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    near = dealt.withColumn("near", F.last(F.when(F.col("status") == 200, response), ignorenulls=True).over(within)).filter(revisit)

    newest = dealt.groupBy("url_key", "range").agg(F.max(F.when(F.col("status") == 200, F.struct(*order))).alias("newest"))
    behind = Window.partitionBy("url_key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = newest.withColumn("carried", F.last("newest", ignorenulls=True).over(behind)).filter(
        "carried is not null").select("url_key", "range", F.col("carried.record_id").alias("c_id"), F.col("carried.captured_at").alias("c_at"))
    full = dealt.filter("status = 200").groupBy(*key).agg(F.first(response).alias("far")).select(
        F.col("url_key").alias("k"), F.col("captured_at").alias("a"), F.col("record_id").alias("i"), "far")
    carried = carried.join(full, (F.col("url_key") == F.col("k")) & (F.col("c_at") == F.col("a")) & (F.col("c_id") == F.col("i")))
    joined = near.join(carried.select("url_key", "range", "far"), ["url_key", "range"], "left").withColumn(
        "ref", F.coalesce("near", "far")).drop("near", "far", "range")
    nothing = rows.filter(revisit & ~known).withColumn("ref", F.lit(None).cast(joined.schema["ref"].dataType))
    judged = kept(joined.unionByName(nothing).select(*_judgement(known)), "revisits")

    payloads = rows.filter(known & (F.col("status") == 200)).groupBy(*key).agg(F.first("payload").alias("found")).select(
        F.col("url_key").alias("k"), F.col("captured_at").alias("a"), F.col("record_id").alias("refers_to"), "found")
    resolved = judged.filter("outcome = 'resolved'").join(
        payloads, (F.col("url_key") == F.col("k")) & (F.col("ref_at") == F.col("a")) & (judged["refers_to"] == payloads["refers_to"]))
    columns = ["record_id", "url_key", "captured_at", "status", "refers_to", "outcome", "headers", "payload"]
    plain = rows.filter(~revisit).withColumns({"refers_to": F.lit(None).cast("long"), "outcome": F.lit("response")}).select(*columns)
    own = judged.filter("outcome <> 'resolved'").select(*columns)
    restored = resolved.select(*[judged[c] for c in columns[:-1]], F.col("found").alias("payload"))
    return plain.unionByName(own).unionByName(restored)


def _judgement(known: Column) -> list[Column]:
    strong = lambda c: F.regexp_replace(c, r"^W/", "")
    agree = F.when(F.col("etag").isNotNull() & F.col("ref.etag").isNotNull(), strong(F.col("etag")) == strong(F.col("ref.etag"))).when(
        F.col("last_modified").isNotNull() & F.col("ref.last_modified").isNotNull(), F.col("last_modified") == F.col("ref.last_modified"))
    outcome = (F.when(~known, "no key").when(F.col("ref").isNull(), "no response").when(agree.isNull(), "unverified")
               .when(agree, "resolved").otherwise("changed"))
    news = F.map_filter(F.coalesce("headers", F.create_map().cast("map<string,string>")), lambda k, v: k.isin(*PERMITTED))
    stored = F.map_filter(F.coalesce("ref.headers", F.create_map().cast("map<string,string>")), lambda k, v: ~F.map_contains_key(news, k))
    done = outcome == "resolved"
    return [F.col("record_id"), F.col("url_key"), F.col("captured_at"), F.col("status"),
            F.when(done, F.col("ref.record_id")).alias("refers_to"), F.col("ref.captured_at").alias("ref_at"), outcome.alias("outcome"),
            F.when(done, F.map_concat(stored, news)).otherwise(F.col("headers")).alias("headers"), F.col("payload")]


def records_of(pages: DataFrame) -> DataFrame:
    """Two records for each page: its full response with the html as payload, and a revisit three days later.  The revisit
    carries the validators of the page's own payload, but for every eleventh page none; of every other eleventh, the response
    comes after the revisit.  Captures of one canonical URL interleave, so that a revisit may meet another page's response.
    Ids are 2 * page_id and 2 * page_id + 1."""
    html = F.coalesce("html", F.lit(""))
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.md5(html.cast("binary")).alias("digest"),
                        F.octet_length("html").cast("string").alias("bytes"))
    seen = 1_700_000_000 + F.pmod(F.col("page_id") * 7919, F.lit(1_000_003))
    at = seen + F.when(F.col("page_id") % 11 == 7, 86_400 * 5).otherwise(0)
    # a page without a payload has no ETag; its date must do
    tag = F.when(F.col("bytes").isNotNull(), F.concat(F.lit('"'), F.substring("digest", 1, 16), F.lit('"')))
    changed = F.concat(F.lit("day "), F.pmod(F.col("page_id"), F.lit(365)).cast("string"))
    full = base.select(
        (F.col("page_id") * 2).alias("record_id"), "url", at.alias("captured_at"), F.lit(200).alias("status"), tag.alias("etag"),
        changed.alias("last_modified"),
        F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("content-length"), "bytes", F.lit("date"), at.cast("string"),
                     F.lit("cache-control"), F.lit("max-age=60")).alias("headers"), F.col("html").alias("payload"))
    later = seen + 86_400 * 3
    valid = lambda c: F.when(F.coalesce(F.col("page_id") % 11, F.lit(0)) != 3, c)
    again = base.select(
        (F.col("page_id") * 2 + 1).alias("record_id"), "url", later.alias("captured_at"), F.lit(304).alias("status"),
        valid(F.concat(F.lit("W/"), tag)).alias("etag"), valid(changed).alias("last_modified"),
        F.create_map(F.lit("content-length"), F.lit("0"), F.lit("date"), later.cast("string"),
                     F.lit("expires"), (later + 60).cast("string")).alias("headers"), F.lit(None).cast("string").alias("payload"))
    return full.unionByName(again)


def op7_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resolve(records_of(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    entries = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))))
    # the whole payload went through the operator; its digest stands for it in the result
    return out.withColumns({"headers": F.array_join(entries, ";"), "payload": F.md5(F.col("payload").cast("binary"))})


ORACLE = r"""
WITH p AS (SELECT page_id, url, md5(coalesce(html, '')) AS digest, CAST(strlen(html) AS VARCHAR) AS bytes,
                  1700000000 + (page_id * 7919) % 1000003 AS seen_at, 'day ' || (page_id % 365) AS changed FROM pages),
t AS (SELECT *, CASE WHEN bytes IS NOT NULL THEN '"' || substr(digest, 1, 16) || '"' END AS tag FROM p),
r AS (
  SELECT page_id * 2 AS record_id, url, seen_at + CASE WHEN page_id % 11 = 7 THEN 432000 ELSE 0 END AS captured_at, 200 AS status, tag, changed, digest AS payload, bytes FROM t
  UNION ALL
  SELECT page_id * 2 + 1, url, seen_at + 259200, 304, CASE WHEN coalesce(page_id % 11, 0) <> 3 THEN tag END,
         CASE WHEN coalesce(page_id % 11, 0) <> 3 THEN changed END, NULL, NULL FROM t),
u AS (SELECT *, regexp_replace(CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END, '(?s)#.*$', '') AS rest FROM r),
k AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_replace(regexp_extract(rest, '^[^/?]*'), '^.*@', '')), ':(?:80|443)$', ''), '^www\.', '') AS host,
         regexp_extract(rest, '^[^/?]*([^?]*)', 1) AS path,
         list_sort(list_filter(string_split(regexp_extract(rest, '(?s)\?(.*)$', 1), '&'),
           lambda x: x <> '' AND NOT regexp_matches(x, '^(?:utm_[a-z]+|fbclid|gclid|ref)(?:=|$)'))) AS params FROM u),
c AS (SELECT *, host || CASE WHEN path = '' THEN '/' ELSE path END
               || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS url_key FROM k),
a AS (SELECT *, last_value(CASE WHEN status = 200 THEN {'id': record_id, 'tag': tag, 'changed': changed,
                                  'payload': payload, 'bytes': bytes} END IGNORE NULLS)
        OVER (PARTITION BY url_key ORDER BY captured_at, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ref FROM c),
o AS (SELECT *, CASE WHEN status <> 304 THEN 'response' WHEN url_key IS NULL THEN 'no key' WHEN ref IS NULL THEN 'no response'
    WHEN tag IS NOT NULL AND ref.tag IS NOT NULL THEN CASE WHEN tag = ref.tag THEN 'resolved' ELSE 'changed' END
    WHEN changed IS NULL OR ref.changed IS NULL THEN 'unverified'
    WHEN changed = ref.changed THEN 'resolved' ELSE 'changed' END AS outcome FROM a)
SELECT record_id, url_key, captured_at, status, CASE WHEN outcome = 'resolved' THEN ref.id END AS refers_to, outcome,
  CASE WHEN status = 200 THEN 'cache-control=max-age=60;content-length=' || coalesce(bytes, '') || ';content-type=text/html;date=' || captured_at
       WHEN outcome = 'resolved' THEN 'cache-control=max-age=60;content-length=' || coalesce(ref.bytes, '') || ';content-type=text/html;date='
            || captured_at || ';expires=' || (captured_at + 60)
       ELSE 'content-length=0;date=' || captured_at || ';expires=' || (captured_at + 60) END AS headers,
  CASE WHEN outcome = 'resolved' THEN ref.payload ELSE payload END AS payload
FROM o
"""
