"""Table access of the curated layer as set operations (F-*, L-*, W-4, K-4, K-7, K-8, V-24).

The platform reads one entity at a time through an ORM; here every read is a
DataFrame over the whole table, and single-key calls become key-set joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fablake.operators.ranking import latest_per_key


def newest_first(created: str = "created_at", tie: str = "id") -> list[Column]:
    """Ties on created_at are unordered in the platform; id breaks them here."""
    return [F.col(created).desc(), F.col(tie).desc()]


def page(df: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """L-1: newest first, then OFFSET/LIMIT (TakeOrderedAndProject + offset)."""
    ordered = df.orderBy(*newest_first())
    return ordered.offset(offset).limit(limit) if offset else ordered.limit(limit)


def newest_of_source(df: DataFrame, source: str, limit: int = 100) -> DataFrame:
    """L-2 / F-2: filter pushed into the scan, then top-n."""
    return df.filter(F.col("source") == source).orderBy(*newest_first()).limit(limit)


def lookup_by_keys(table: DataFrame, keys: DataFrame, key: str, how: str = "left") -> DataFrame:
    """F-1 / F-3 as a key-set join (one call per key becomes one join)."""
    return keys.join(table, key, how)


def upsert(base: DataFrame, changes: DataFrame, key: str = "id", sequence: str | None = None) -> DataFrame:
    """K-7 INSERT .. ON CONFLICT (key) DO UPDATE: any change beats the base row, and of several changes of
    one key the one with the greatest ``sequence`` wins; equal or absent sequences fall back on a hash
    of the whole row, so the result never depends on the order of rows.

    One shuffle on the key; a duplicate-heavy key costs one running max, not a sort.
    """
    order = F.col(sequence).cast("long") if sequence else F.lit(0).cast("long")
    mark = F.xxhash64(*base.columns).alias("_mark")
    b = base.select(*base.columns, F.lit(0).alias("_is_new"), F.lit(0).cast("long").alias("_order"), mark)
    c = changes.select(*base.columns, F.lit(1).alias("_is_new"), order.alias("_order"), mark)
    best = latest_per_key(b.unionByName(c), [key], ["_is_new", "_order", "_mark"])
    return best.select(*base.columns)


def delete_returning(table: DataFrame, doomed_keys: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """K-8 / J-8: (kept rows, deleted rows) by a key set."""
    keys = doomed_keys.select(key).distinct()
    return table.join(keys, key, "left_anti"), table.join(keys, key, "left_semi")


def constraint_violations(
    df: DataFrame,
    table_name: str,
    not_null: list[str],
    max_lengths: dict[str, int],
    unique_key: str | None = "id",
) -> DataFrame:
    """V-24: NOT NULL, VARCHAR(n) and primary-key checks as one aggregate pass.

    Returns one row per rule with the violation count (0 = satisfied).
    """
    aggs = []
    labels = []
    for c in not_null:
        aggs.append(F.count_if(F.col(c).isNull()).alias(f"nn_{c}"))
        labels.append(("not_null", c, f"nn_{c}"))
    for c, n in max_lengths.items():
        aggs.append(F.count_if(F.char_length(F.col(c).cast("string")) > n).alias(f"len_{c}"))
        labels.append((f"max_length_{n}", c, f"len_{c}"))
    counts = df.agg(*aggs) if aggs else None
    parts = []
    if counts is not None:
        stack = F.explode(
            F.array(
                *[
                    F.struct(F.lit(rule).alias("rule"), F.lit(col).alias("column_name"), F.col(alias).alias("violations"))
                    for rule, col, alias in labels
                ]
            )
        )
        parts.append(counts.select(stack.alias("r")).select("r.*"))
    if unique_key:
        dup = (
            df.groupBy(unique_key)
            .agg(F.count(F.lit(1)).alias("n"))
            .agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("violations"))
            .select(F.lit("unique").alias("rule"), F.lit(unique_key).alias("column_name"), "violations")
        )
        parts.append(dup)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(
        F.lit(table_name).alias("table_name"), "rule", "column_name", F.col("violations").cast("bigint")
    )


def count_by(df: DataFrame, key: str | Column, name: str = "record_count") -> DataFrame:
    """A-2 / A-5: partial aggregation before the shuffle; output ordered."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(name))
