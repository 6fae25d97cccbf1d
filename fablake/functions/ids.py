"""Deterministic ids and small column helpers.

``uuid()`` is re-evaluated when a task is retried, so ids are content hashes:
the same payload at the same position always gets the same id, which makes
every write idempotent on replay.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_id(*parts: Column | str) -> Column:
    """sha2-256 of the parts joined by an unambiguous separator, as 36-char text."""
    cols = [F.coalesce(F.col(p) if isinstance(p, str) else p, F.lit("\u0000")).cast("string") for p in parts]
    h = F.sha2(F.concat_ws("\u0001", *cols), 256)
    # uuid-shaped: 8-4-4-4-12 hex digits
    return F.concat_ws(
        "-",
        F.substring(h, 1, 8),
        F.substring(h, 9, 4),
        F.substring(h, 13, 4),
        F.substring(h, 17, 4),
        F.substring(h, 21, 12),
    )


def map_lookup(mapping: dict[str, str], key: Column) -> Column:
    """Literal map lookup for registry-sized dictionaries (folded by Catalyst)."""
    if not mapping:
        return F.lit(None).cast("string")
    pairs = []
    for k, v in mapping.items():
        pairs += [F.lit(k), F.lit(v)]
    return F.element_at(F.create_map(*pairs), key)


def case_lookup(mapping: dict[str, str], key: Column, default: Column | None = None) -> Column:
    """CASE WHEN chain: null-safe on a missing key, keeps whole-stage codegen."""
    expr = None
    for k, v in mapping.items():
        expr = F.when(key == F.lit(k), F.lit(v)) if expr is None else expr.when(key == F.lit(k), F.lit(v))
    if expr is None:
        return default if default is not None else F.lit(None).cast("string")
    return expr.otherwise(default) if default is not None else expr
