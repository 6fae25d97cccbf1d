"""Per-source payload validation with quarantine (V-23, K-10, P-7).

``validate`` adds ``errors`` (sorted ``path:keyword`` list) and ``is_valid``;
``split`` returns (accepted, quarantined). Each source branch carries only
its own compiled rule, so generated code stays small.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fablake.functions.jsondoc import strict_parse_json

from fablake.functions.jsonschema import compile_rule, error_text
from fablake.registry import Registry, load_registry


def parse_payload(text: Column) -> Column:
    """S-7: UTF-8-checked JSON text -> VARIANT; NULL means malformed (quarantine)."""
    return strict_parse_json(text)


def validate(df: DataFrame, rule: dict[str, Any], payload: str = "payload", cache_key: str | None = None) -> DataFrame:
    """Add ``errors`` (sorted) and ``is_valid``; an unparsable payload gets ``<root>:parse``."""
    plan = compile_rule(rule, F.col(payload), cache_key)
    checked = plan.apply(df, "_errs")
    return checked.select(
        *df.columns,
        F.when(F.col(payload).isNotNull(), F.col("_errs")).otherwise(F.array(F.lit("<root>:parse"))).alias("errors"),
    ).select("*", (F.size("errors") == 0).alias("is_valid"))


def validate_source(df: DataFrame, source: str, payload: str = "payload", reg: Registry | None = None) -> DataFrame:
    reg = reg or load_registry()
    return validate(df, reg.rule(source), payload)


def validate_by_source(df: DataFrame, sources: list[str], payload: str = "payload",
                       source_col: str = "source", reg: Registry | None = None) -> DataFrame:
    """One branch per source, each with only its own compiled rule, stacked again.

    Where landing data is partitioned by ``source``, each branch's filter prunes
    to its own files; other input is read once for each branch. Small
    per-branch expressions keep whole-stage code generation; one CASE over
    every rule would not fit it. Rows of sources without a rule keep an empty list.
    """
    reg = reg or load_registry()
    src = F.col(source_col)
    out = None
    for s in sources:
        rule = reg.rule(s)
        # kept by content and application: another registry's rule, or a column of an ended session, is never met
        key = f"{df.sparkSession.sparkContext.applicationId}:{s}:{json.dumps(rule, sort_keys=True)}"
        part = validate(df.filter(src == F.lit(s)), rule, payload, cache_key=key)
        out = part if out is None else out.unionByName(part)
    rest = df.filter(~src.isin(*sources) | src.isNull()).withColumn(
        "errors", F.array().cast("array<string>")
    ).withColumn("is_valid", F.lit(True))
    return out.unionByName(rest) if out is not None else rest


def split(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined) -- a bad row never fails the batch.

    Persist (or write) ``validated`` first when both sides are consumed: the
    filters would otherwise be pushed below the rule's staged projections and
    the rule evaluated once per side.
    """
    return validated.filter("is_valid"), validated.filter(~F.col("is_valid"))


def errors_as_text(col: str = "errors") -> Column:
    return error_text(F.col(col))


def cast_record_by_schema(record: Column, rule: dict[str, Any]) -> Column:
    """B4: a CSV record (MAP<STRING,STRING>) to a VARIANT payload typed by the rule.

    Cells of ``number``/``integer`` properties become JSON numbers when they
    parse, ``boolean`` cells become booleans; anything else stays a string so
    that validation reports it. Returns JSON text.
    """
    props = rule.get("properties", {})
    numeric = [n for n, sub in props.items() if sub.get("type") in ("number", "integer")]
    boolean = [n for n, sub in props.items() if sub.get("type") == "boolean"]

    def typed(k: Column, v: Column) -> Column:
        num = v.try_cast("double")
        low = F.lower(v)
        out = F.when(v.isNull(), F.lit(None).cast("variant"))
        if numeric:
            out = out.when(k.isin(*numeric) & num.isNotNull() & ~F.isnan(num), num.cast("variant"))
        if boolean:
            out = out.when(k.isin(*boolean) & low.isin("true", "false"), (low == "true").cast("variant"))
        return out.otherwise(v.cast("variant"))

    return F.to_json(F.transform_values(record, typed))
