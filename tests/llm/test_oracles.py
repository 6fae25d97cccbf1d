"""The SQL of queries on pages, held against them on rows that the given tables lack."""

from collections import Counter

import duckdb
import pytest

from fablake.llm import revisits as rv
from fablake.llm import urlrules as ur

URLS = ["http://x.org/a?PHPSESSID=1", "http://x.org/Ads/1", "http://X.ORG/CGI-BIN/q", "http://x.org/Login?ReturnTo=my-Wiki", "http://example.com/DE/x",
        "http://example.com/de/x", "http://a.example.net/en/1", "http://example.net/fr/1", "no scheme", "", None, "http://", "http://h.org/fr/?PAGE=2&ref=q",
        "http://long.net/" + "segment/" * 5000 + "Ads/x", "http://x.org/fr/" + "a" * 30_000, "http://same.org/1", "http://same.org/1#top", "http://same.org/1?utm_x=2"]


@pytest.fixture(scope="module")
def pages(spark, tmp_path_factory):
    rows = [(i, f"http://alone.org/{i}" if i % 22 == 7 else URLS[i % len(URLS)], None if i % 7 == 0 else f"<html>{i % 5} " + "text " * (i % 50) + "</html>", "clash", "clash") for i in range(200)]
    path = tmp_path_factory.mktemp("pages")
    spark.createDataFrame(rows, "page_id long, url string, html string, host string, verdict string").coalesce(1).write.parquet(f"{path}/pages.parquet")
    return str(path)


@pytest.mark.parametrize("query, sql", [(rv.op7_warc_revisits, rv.ORACLE), (ur.op9_url_filters, ur.ORACLE)])
def test_query_equals_its_sql(spark, pages, query, sql):
    df = query(spark, pages)
    names = sorted(df.columns)
    got = Counter(tuple(r[c] for c in names) for r in df.collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{pages}/pages.parquet/*.parquet'")
    found = con.execute(sql)
    columns = [c[0] for c in found.description]
    assert sorted(columns) == names
    assert got == Counter(tuple(r[columns.index(c)] for c in names) for r in found.fetchall())


def test_revisits_carry_whole_payloads(spark, pages):
    records = rv.records_of(spark.read.parquet(f"{pages}/pages.parquet"))
    html = {r.record_id: r.payload for r in records.filter("status = 200").collect()}
    out = rv.resolve(records).collect()
    assert len(out) == 400 and {r.outcome for r in out} >= {"response", "resolved", "unverified", "no response", "no key"}
    assert all(r.payload == html[r.refers_to] for r in out if r.outcome == "resolved")
    assert all(r.payload == html[r.record_id] for r in out if r.outcome == "response")
