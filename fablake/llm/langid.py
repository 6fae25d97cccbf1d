"""Language identification by Bayesian evidence fusion.

    log P(l | all) = log P(l | host) + text(l) + log P(declared | l) + log P(address | l) + constant

* text: hashed byte trigrams of the whole text against a table learned from labelled documents, mean
  log-likelihood times the root of the number of trigrams (neighbouring trigrams are not independent).
* declared: the language that the markup (``<html lang=...>``) or the table states.
* address: the host's last label and a two-letter first path segment.
* host prior: counts of the languages that texts alone suggest, smoothed level by level
  (all -> last label -> last two labels -> host), by grouped aggregation over all rows.

The table of trigrams is learned from at most ``FIT_ROWS`` labelled documents; every count behind the
priors and the likelihoods of declared languages and addresses covers all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fablake.llm import textscan as ts
from fablake.llm.common import kept, table

#: What the text model is fitted on: so many rows, and the most frequent languages among them (a table of half a
#: megabyte each in every worker). Counts behind priors and likelihoods cover all rows.
FIT_ROWS = 20_000
MAX_LANGUAGES = 200
BUCKETS = 1 << 16
#: Weight, in rows, of the level above in a host's prior, and of the overall share in a likelihood.
SMOOTH = 20.0
LEAST_TRIGRAMS = 20
ROW = "doc_id long, page_id long, declared string, host string, address string, text string"


def _trigrams(scan: ts.Scan) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each byte trigram inside a text, text of each)."""
    data = ts.LOWER[scan.data].astype(np.uint32)
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = ((data[:-2] << 16) | (data[1:-1] << 8) | data[2:]) * np.uint32(2654435761)
    text = np.repeat(np.arange(scan.rows), np.diff(scan.bounds))
    whole = text[:-2] == text[2:]
    return (code >> np.uint32(16)).astype(np.int64)[whole], text[:-2][whole]


def _count(languages: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(languages), BUCKETS), np.int64)
        place = {x: k for k, x in enumerate(languages)}
        for batch in batches:
            lang = np.array([place[x] for x in batch.column(0).to_pylist()], np.int64)
            for scan in ts.scans(batch):
                bucket, text = _trigrams(scan)
                np.add.at(counts, (lang[scan.first + text], bucket), 1)
        for k in range(len(languages)):
            at = np.flatnonzero(counts[k])
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k)), pa.array(at), pa.array(counts[k, at])],
                                                 names=["language", "bucket", "n"])

    return run


class TextModel:
    """languages, and log P(trigram bucket | language), one column each."""

    def __init__(self, languages: list[str], table_: np.ndarray):
        self.languages, self.table = languages, table_


def fit(documents: DataFrame, fit_rows: int = FIT_ROWS) -> TextModel:
    """From at most ``fit_rows`` rows of documents (doc_id, text, lang), those of smallest id hash; of the
    languages, the ``MAX_LANGUAGES`` most frequent ones there."""
    sample = documents.filter("lang is not null and text is not null").select("doc_id", F.lower("lang").alias("lang"))
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id", "lang").limit(fit_rows)
    ids = F.broadcast(kept(sample.select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang")).distinct(), "sample"))
    rows = documents.join(ids, (documents["doc_id"] == ids["_id"]) & (F.lower(documents["lang"]) == ids["_lang"])).select("_lang", "text")
    names = rows.groupBy("_lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "_lang").limit(MAX_LANGUAGES).collect()
    languages = sorted(r["_lang"] for r in names)
    counts = np.zeros((BUCKETS, len(languages)))
    if languages:
        found = rows.filter(F.col("_lang").isin(languages)).mapInArrow(_count(languages), "language long, bucket long, n long")
        found = found.groupBy("language", "bucket").agg(F.sum("n").alias("n")).toPandas()  # BUCKETS rows for each language at most
        counts[found["bucket"].to_numpy(), found["language"].to_numpy()] = found["n"].to_numpy()
    smoothed = counts + 0.1
    return TextModel(languages, np.log(smoothed / smoothed.sum(axis=0)))


def _score(model) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_ = np.ascontiguousarray(model.value.T)
        k = len(table_)
        for batch in batches:
            for scan in ts.scans(batch):
                bucket, text = _trigrams(scan)
                n = np.bincount(text, minlength=scan.rows)
                at = np.concatenate([[0], np.cumsum(n)])
                total = np.zeros((scan.rows, k))
                some = np.flatnonzero(n)
                if len(some):
                    for j in range(k):  # a language at a time: memory follows the text, not the languages
                        total[some, j] = np.add.reduceat(table_[j][bucket], at[some])
                total /= np.sqrt(np.maximum(n, 1))[:, None]
                total -= total.max(axis=1, initial=-np.inf)[:, None] if k else 0
                best = np.where(n >= LEAST_TRIGRAMS, total.argmax(axis=1), -1) if k else np.full(scan.rows, -1)
                scores = pa.ListArray.from_arrays(np.arange(scan.rows + 1, dtype=np.int32) * k, pa.array(total.reshape(-1)))
                own = batch.slice(scan.first, scan.rows)
                yield pa.RecordBatch.from_arrays([*own.columns[:5], scores, pa.array(best.astype(np.int32))],
                                                 names=[*batch.schema.names[:5], "scores", "best"])

    return run


def page_rows(pages: DataFrame) -> DataFrame:
    """Evidence of pages (page_id, url, html): text without markup, scripts and comments; declared language,
    host and address.  What is missing is null."""
    rest = F.when(F.instr("url", "://") > 0, F.substr(F.col("url"), F.instr("url", "://") + 3))
    host = F.lower(F.regexp_extract(rest, r"^[^/?#:]*", 0))
    segment = F.lower(F.regexp_extract(rest, r"^[^/?#]*/([A-Za-z]{2})(?:[/?#]|$)", 1))
    declared = F.lower(F.regexp_extract("html", r"(?i)<html[^>]{0,500}?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1))
    text = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    empty = lambda c: F.when(c != "", c)
    return pages.select(
        F.lit(None).cast("long").alias("doc_id"), F.col("page_id").cast("long").alias("page_id"), empty(declared).alias("declared"),
        empty(host).alias("host"), F.concat(F.regexp_extract(host, r"[^.]*$", 0), F.lit("/"), segment).alias("address"), text.alias("text"))


def document_rows(documents: DataFrame) -> DataFrame:
    """Evidence of documents (doc_id, text, lang, source): the source stands for the host, no address."""
    return documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("long").alias("page_id"),
        F.lower(F.regexp_extract("lang", r"^[A-Za-z]{2,3}", 0)).alias("declared"), F.concat(F.lit("source:"), "source").alias("host"),
        F.lit(None).cast("string").alias("address"), "text")


def _counts(languages: list[str], suffix: str = "") -> list[Column]:
    """Rows of each language; rows too short to tell count for none, so a group of only such rows has zeros."""
    return [F.count_if(F.col("best") == k).cast("double").alias(f"n{k}{suffix}") for k in range(len(languages))]


def identify(rows: DataFrame, model: TextModel) -> DataFrame:
    """``rows`` (``ROW``) -> doc_id, page_id, declared, host, text_lang, lang, probability; one for each row.

    text_lang is what the text alone suggests, null with under ``LEAST_TRIGRAMS`` trigrams.  A null or empty
    text leaves the decision to the other evidence, a null host to the prior over all rows; null evidence
    changes nothing.  Ties go to the first language in alphabetical order.  Without any language in the
    model lang and probability are null.
    """
    spark, languages = rows.sparkSession, model.languages
    k = len(languages)
    schema = "doc_id long, page_id long, declared string, host string, address string, scores array<double>, best int"
    scored = rows.select("doc_id", "page_id", "declared", "host", "address", "text").mapInArrow(
        _score(spark.sparkContext.broadcast(model.table)), schema)
    if not k:
        none = F.lit(None).cast("string")
        return scored.select("doc_id", "page_id", "declared", "host", none.alias("text_lang"), none.alias("lang"),
                             F.lit(None).cast("double").alias("probability"))
    scored = kept(scored.withColumn("best", F.when(F.col("best") >= 0, F.col("best"))), "scores")

    # counts by host; the levels above are sums of them
    level = ["top", "domain", "host"]
    hosts = scored.filter("host is not null").groupBy("host").agg(*_counts(languages)).select(
        "*", F.regexp_extract("host", r"[^.]*$", 0).alias("top"), F.regexp_extract("host", r"[^.]*\.?[^.]*$", 0).alias("domain"))
    names = [f"n{j}" for j in range(k)]
    everything = scored.agg(*_counts(languages)).first()
    total = sum(x or 0.0 for x in everything)
    above = F.array(*[F.lit(((x or 0.0) + 1.0) / (total + k)) for x in everything])
    prior = None
    for depth, key in enumerate(level):
        keys = level[: depth + 1]
        own = hosts.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in names])
        if prior is not None:
            own = own.join(prior, keys[:-1])
        parent = above if prior is None else F.col("p")
        size = sum((F.col(n) for n in names), F.lit(0.0))
        smoothed = F.array(*[(F.col(n) + SMOOTH * parent[j]) / (size + SMOOTH) for j, n in enumerate(names)])
        prior = own.select(*keys, smoothed.alias("p"))
    prior = prior.select(F.col("host").alias("_host"), F.col("p").alias("prior"))

    n_language = [float(x or 0.0) for x in everything]

    def likelihood(column: str) -> DataFrame:
        """log P(value | language) for each value, smoothed towards the value's overall share."""
        seen = scored.filter(F.col(column).isNotNull()).groupBy(column).agg(*_counts(languages), F.count("*").alias("rows"))
        share = (F.col("rows") + 1) / F.lit(scored_rows + 1.0)
        logs = F.array(*[F.log((F.col(n) + SMOOTH * share) / (n_language[j] + SMOOTH)) for j, n in enumerate(names)])
        return seen.select(F.col(column).alias(f"_{column}"), logs.alias(f"l_{column}"))

    scored_rows = float(scored.count())
    declared, address = likelihood("declared"), likelihood("address")
    # a declared language has two or three letters: 18,252 values at most
    out = scored.join(F.broadcast(declared), scored["declared"] == declared["_declared"], "left")
    # rows without a value find nothing, each at a place of its own: they do not meet in one task
    nowhere = F.concat(F.lit("\0"), F.pmod(F.xxhash64("doc_id", "page_id", "scores"), F.lit(4096)).cast("string"))
    out = out.withColumns({"_at": F.coalesce("address", nowhere), "_of": F.coalesce("host", nowhere)})
    out = out.join(address, F.col("_at") == address["_address"], "left").join(prior, F.col("_of") == prior["_host"], "left")
    nothing = F.array(*[F.lit(0.0)] * k)
    fused = F.zip_with(F.zip_with("scores", F.coalesce("l_declared", nothing), lambda a, b: a + b),
                       F.zip_with(F.coalesce("l_address", nothing), F.coalesce("prior", above), lambda a, p: a + F.log(p)), lambda a, b: a + b)
    out = out.withColumn("fused", fused).withColumn("most", F.array_max("fused"))
    mass = F.aggregate("fused", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("most")))
    known = F.array(*[F.lit(x) for x in languages])
    return out.select("doc_id", "page_id", "declared", "host", F.get(known, F.col("best")).alias("text_lang"),
                      F.get(known, (F.array_position("fused", F.col("most")) - 1).cast("int")).alias("lang"), (1.0 / mass).alias("probability"))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and every page.  A page has the doc_id -1 - page_id, so that doc_id is never null."""
    documents = table(spark, sf_dir, "documents")
    rows = document_rows(documents).unionByName(page_rows(table(spark, sf_dir, "pages")))
    out = identify(rows, fit(documents))
    return out.withColumn("doc_id", F.coalesce("doc_id", -1 - F.col("page_id"))).withColumn("probability", F.round("probability", 6))
