"""The corpus pipeline: quality rules, line dedup, near duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.  ``docs`` has the
columns of ``documents``; all stages but the last return those columns.  Null, empty and very long texts,
repeated rows, empty tables and extra columns behave as the operators' docstrings say; extra columns
pass through every filtering stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fablake.llm import decontaminate, linededup, neardup, packing, quality
from fablake.llm.common import kept, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the learned decision list reject go.  Rows that share a doc_id
    are judged together: one rejected row rejects them all.  Rows without a doc_id go if any such row
    is rejected with the same text, so each text has one outcome."""
    rules = quality.fit(docs, table(spark, sf_dir, "labels"))
    named = quality.judge(docs.filter("doc_id is not null"), rules).filter(~F.col("kept"))
    gone = kept(named.select(F.col("doc_id").alias("_gone")).distinct(), "rejected")
    rest = docs.filter("doc_id is not null").join(gone, F.col("doc_id").cast("long") == gone["_gone"], "left_anti")
    nameless = docs.filter("doc_id is null").withColumn("_key", F.xxhash64("text"))
    bad = quality.judge(nameless.select(F.col("_key").alias("doc_id"), "text"), rules).filter(~F.col("kept"))
    bad = bad.select(F.col("doc_id").alias("_bad")).distinct()
    return rest.unionByName(nameless.join(bad, nameless["_key"] == bad["_bad"], "left_anti").drop("_key"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of words go, lines with them.  A document that was cut goes where fewer words
    are left than a run has (the quality rules ask for as many): mostly copies, and the odd words in which near
    copies differ.  One that was not cut stays, however short.  n_chars follows the text where the column is there."""
    own = {c: f"_own_{c}" for c in ("n_words", "deleted") if c in docs.columns}
    out = linededup.drop_repeated_lines(docs.withColumnsRenamed(own))
    cut = F.aggregate("deleted", F.lit(0), lambda n, r: n + r["e"] - r["s"])
    out = out.filter((F.size("deleted") == 0) | (F.col("n_words") - cut >= linededup.MIN_WORDS))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("deleted") == 0, F.col("n_chars")).otherwise(
            F.char_length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest doc_id.
    Rows that repeat a doc_id stay or go together; a row without doc_id stays."""
    verdict = neardup.near_duplicates(docs)
    gone = verdict.filter(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["_gone"], "left_anti")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a text of ``benchmark`` go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boundary records of the packed sequences."""
    return packing.packed(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_dedup_stage),
    ("minhash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Learned rules and tokenizers have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None
