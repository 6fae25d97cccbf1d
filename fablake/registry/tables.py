"""Table definitions: column types, NOT NULL columns, VARCHAR lengths (K-9, V-24).

FIXED VALUES: names, types and lengths must equal the platform's own tables.
"""

from __future__ import annotations

#: table -> {column: (type, not null, longest text)}
TABLES: dict[str, dict[str, tuple[str, bool, int | None]]] = {
    "ingestion_log": {
        "id": ("string", True, None), "request_id": ("string", True, 64), "source": ("string", True, 64),
        "stream": ("string", False, 64), "status": ("string", True, 32), "duration_ms": ("double", False, None),
        "error_message": ("string", False, 2048), "created_at": ("timestamp_ntz", True, None),
    },
    "lot_master": {
        "id": ("string", True, None), "lot_id": ("string", True, 64), "recipe_id": ("string", True, 64),
        "equipment_id": ("string", True, 64), "wafer_count": ("int", True, None), "temperature": ("double", False, None),
        "event_type": ("string", True, 64), "event_timestamp": ("timestamp_ntz", True, None),
        "created_at": ("timestamp_ntz", True, None),
    },
    "raw_events": {
        "id": ("string", True, None), "source": ("string", True, 64), "event_type": ("string", False, 64),
        "payload": ("string", True, None), "s3_key": ("string", False, 512), "created_at": ("timestamp_ntz", True, None),
    },
}


def columns_of(table: str) -> dict[str, str]:
    """column -> Spark type."""
    return {c: kind for c, (kind, _, _) in TABLES[table].items()}


def rules_of(table: str) -> tuple[list[str], dict[str, int]]:
    """(NOT NULL columns, column -> longest text)."""
    columns = TABLES[table].items()
    return [c for c, (_, needed, _) in columns if needed], {c: n for c, (_, _, n) in columns if n is not None}
