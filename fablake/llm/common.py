"""Helpers shared by the operators: tables, and results kept in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fablake.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def kept(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder and read again: lineage ends here, a lost
    executor costs nothing that was written, and every later use sees the same rows."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
