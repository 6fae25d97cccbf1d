"""Driver-side registry: read once, turned into small broadcastable DataFrames.

The registry holds at most a few dozen rows per table (sources, streams,
mapping pairs, category/format pairs), so broadcasting it is size-bounded by
configuration, never by data volume.
"""

from __future__ import annotations

import copy
import json
from dataclasses import dataclass, field
from functools import lru_cache
from pathlib import Path
from typing import Any

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

REGISTRY_DIR = Path(__file__).resolve().parent
REGISTRY_FILE = REGISTRY_DIR / "registry.yaml"


class RegistryError(ValueError):
    """Bad registry or rule file: fails the job before any data is read."""


@dataclass(frozen=True)
class Source:
    name: str
    display_name: str
    endpoint: str
    method: str
    type: str
    input_format: str
    schema: str
    target_table: str
    target_schema: str
    stream: str
    raw_bucket: str
    raw_prefix: str
    enabled: bool


@dataclass
class Registry:
    sources: dict[str, Source]
    streams: dict[str, dict[str, Any]]
    mappings: dict[str, dict[str, Any]]
    curators: list[str]
    routing_sources: list[str]
    validation_sources: list[str]
    categories: dict[str, list[str]]
    errors: list[str] = field(default_factory=list)

    # -- lookups -----------------------------------------------------------
    def source(self, name: str) -> Source:
        if name not in self.sources:
            raise RegistryError(f"unknown source: {name}")
        return self.sources[name]

    def physical_stream(self, logical: str) -> str:
        if logical not in self.streams:
            raise RegistryError(f"unknown logical stream: {logical}")
        return self.streams[logical]["name"]

    def formats(self) -> list[str]:
        """Distinct formats in order of first appearance over the categories."""
        seen: list[str] = []
        for fmts in self.categories.values():
            for f in fmts:
                if f not in seen:
                    seen.append(f)
        return seen

    def category_pairs(self) -> list[tuple[str, str]]:
        return [(c, f) for c, fmts in self.categories.items() for f in fmts]

    def rule(self, source_name: str) -> dict[str, Any]:
        return load_rule(self.source(source_name).schema, self)

    def mapped_fields(self, source_name: str) -> dict[str, str]:
        """Payload field -> column of the source's own mapping; empty without one."""
        return (self.mappings.get(source_name) or {}).get("fields") or {}

    def curated_table(self, source_name: str) -> str:
        """Dedicated table only when it has a curator and the source a mapping."""
        src = self.source(source_name)
        if src.target_table in self.curators and self.mappings.get(source_name):
            return src.target_table
        return "raw_events"


def _build_sources(raw: dict[str, Any]) -> tuple[dict[str, Source], list[str]]:
    defaults = raw.get("defaults", {})
    mandatory = raw.get("mandatory", [])
    out: dict[str, Source] = {}
    errors: list[str] = []
    for name, cfg in (raw.get("sources") or {}).items():
        missing = [k for k in mandatory if k not in cfg]
        if missing:
            errors.append(f"source {name}: missing mandatory field(s) {', '.join(missing)}")
            continue
        merged = {**defaults, "display_name": name, "raw_prefix": name, **cfg}
        out[name] = Source(
            name=name,
            display_name=merged["display_name"],
            endpoint=merged["endpoint"],
            method=merged["method"],
            type=merged["type"],
            input_format=merged["input_format"],
            schema=merged["schema"],
            target_table=merged["target_table"],
            target_schema=merged["target_schema"],
            stream=merged["stream"],
            raw_bucket=merged["raw_bucket"],
            raw_prefix=merged["raw_prefix"],
            enabled=bool(merged["enabled"]),
        )
    return out, errors


def parse_registry(raw: dict[str, Any]) -> Registry:
    sources, errors = _build_sources(raw)
    return Registry(
        sources=sources,
        streams=raw.get("streams") or {},
        mappings=raw.get("mappings") or {},
        curators=list(raw.get("curators") or []),
        routing_sources=list(raw.get("routing_sources") or []),
        validation_sources=list(raw.get("validation_sources") or []),
        categories={k: list(v) for k, v in (raw.get("categories") or {}).items()},
        errors=errors,
    )


@lru_cache(maxsize=4)
def load_registry(path: str | None = None) -> Registry:
    p = Path(path) if path else REGISTRY_FILE
    try:
        raw = yaml.safe_load(p.read_text(encoding="utf-8"))
    except (OSError, yaml.YAMLError) as exc:
        raise RegistryError(f"cannot read registry {p}: {exc}") from exc
    return parse_registry(raw)


def _expand(node: Any, reg: Registry) -> Any:
    """Resolve the two registry references a rule may hold."""
    if isinstance(node, list):
        return [_expand(n, reg) for n in node]
    if not isinstance(node, dict):
        return node
    out = {k: _expand(v, reg) for k, v in node.items() if not k.startswith("x-")}
    ref = node.get("x-enumFromRegistry")
    if ref == "categories":
        out["enum"] = list(reg.categories)
    elif ref == "formats":
        out["enum"] = reg.formats()
    if node.get("x-allOfFromRegistry") == "category_formats":
        out["allOf"] = [
            {
                "if": {"properties": {"metadata": {"properties": {"category": {"const": cat}}}}},
                "then": {"properties": {"metadata": {"properties": {"format": {"enum": list(fmts)}}}}},
            }
            for cat, fmts in reg.categories.items()
        ]
    return out


def load_rule(rel_path: str, reg: Registry | None = None) -> dict[str, Any]:
    """Read a rule file (a JSON Schema) once; a missing or broken file is fatal."""
    reg = reg or load_registry()
    return copy.deepcopy(_load_rule_cached(rel_path, reg))


_RULE_CACHE: dict[tuple[str, str], dict[str, Any]] = {}


def _load_rule_cached(rel_path: str, reg: Registry) -> dict[str, Any]:
    # a rule depends on its file and on the registry's matrix, so it is kept by content
    ck = (rel_path, json.dumps(reg.categories, sort_keys=False))
    if ck not in _RULE_CACHE:
        p = REGISTRY_DIR / rel_path
        if not p.exists():
            raise RegistryError(f"rule file not found: {p}")
        try:
            _RULE_CACHE[ck] = _expand(json.loads(p.read_text(encoding="utf-8")), reg)
        except json.JSONDecodeError as exc:
            raise RegistryError(f"invalid rule file {p}: {exc}") from exc
    return _RULE_CACHE[ck]


# ---------------------------------------------------------------------------
# Registry as DataFrames (G-4).  Each is tiny and safe to broadcast.
# ---------------------------------------------------------------------------

SOURCE_SCHEMA = T.StructType(
    [
        T.StructField("source", T.StringType(), False),
        T.StructField("display_name", T.StringType(), False),
        T.StructField("endpoint", T.StringType(), False),
        T.StructField("method", T.StringType(), False),
        T.StructField("type", T.StringType(), False),
        T.StructField("input_format", T.StringType(), False),
        T.StructField("schema", T.StringType(), False),
        T.StructField("target_table", T.StringType(), False),
        T.StructField("target_schema", T.StringType(), False),
        T.StructField("stream", T.StringType(), False),
        T.StructField("raw_bucket", T.StringType(), False),
        T.StructField("raw_prefix", T.StringType(), False),
        T.StructField("enabled", T.BooleanType(), False),
    ]
)


def sources_frame(spark: SparkSession, reg: Registry | None = None) -> DataFrame:
    reg = reg or load_registry()
    rows = [
        (
            s.name, s.display_name, s.endpoint, s.method, s.type, s.input_format, s.schema,
            s.target_table, s.target_schema, s.stream, s.raw_bucket, s.raw_prefix, s.enabled,
        )
        for s in reg.sources.values()
    ]
    return spark.createDataFrame(rows, SOURCE_SCHEMA)


def streams_frame(spark: SparkSession, reg: Registry | None = None) -> DataFrame:
    reg = reg or load_registry()
    rows = [(k, v.get("name"), v.get("shard_count")) for k, v in reg.streams.items()]
    schema = "logical_stream string, physical_stream string, shard_count int"
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, schema).withColumn(
        "shard_count", F.coalesce("shard_count", F.lit(1)).cast("bigint")
    )


def category_pairs_frame(spark: SparkSession, reg: Registry | None = None) -> DataFrame:
    """(category, format) exploded from the matrix: 29 rows."""
    from pyspark.sql import functions as F

    reg = reg or load_registry()
    nested = spark.createDataFrame(
        [(c, f) for c, f in reg.categories.items()], "category string, formats array<string>"
    )
    return nested.select("category", F.explode("formats").alias("format"))
