"""Format resolution for landed payloads (S-4, S-5) as column expressions.

FIXED VALUES: the extension table and the alias table below must equal the
platform's own for files and requests to resolve to the same parser.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# FIXED VALUES: file extension -> format (case-insensitive on the extension)
EXTENSION_FORMATS = {
    ".json": "JSON",
    ".xml": "XML",
    ".csv": "CSV",
    ".txt": "TEXT",
    ".yaml": "YAML",
    ".yml": "YAML",
    ".parquet": "PARQUET",
    ".h5": "HDF5",
    ".hdf5": "HDF5",
}

# FIXED VALUES: upper-cased MIME type or declared format -> parser name
FORMAT_ALIASES = {
    "APPLICATION/JSON": "JSON",
    "TEXT/JSON": "JSON",
    "APPLICATION/XML": "XML",
    "TEXT/XML": "XML",
    "TEXT/CSV": "CSV",
    "TEXT/PLAIN": "TEXT",
    "APPLICATION/X-YAML": "YAML",
    "TEXT/YAML": "YAML",
    "APPLICATION/YAML": "YAML",
    "APPLICATION/OCTET-STREAM": "BINARY",
    "JSON": "JSON",
    "XML": "XML",
    "CSV": "CSV",
    "TEXT": "TEXT",
    "YAML": "YAML",
    "PARQUET": "PARQUET",
    "HDF5": "HDF5",
    "PROTOBUF": "PROTOBUF",
    "AVRO": "AVRO",
    "GRPC": "GRPC",
    "STDF": "STDF",
    "SECS/GEM": "SECS/GEM",
    "OPC-UA": "OPC-UA",
}

# formats whose payload is kept as a base64 envelope
BINARY_FORMATS = ("BINARY", "HDF5", "PROTOBUF", "AVRO", "GRPC", "STDF", "SECS/GEM", "OPC-UA")


def _map(d: dict[str, str]) -> Column:
    pairs = []
    for k, v in d.items():
        pairs += [F.lit(k), F.lit(v)]
    return F.create_map(*pairs)


def extension_of(path: Column) -> Column:
    """Lower-cased suffix of the last path segment ('' when none)."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    ext = F.regexp_extract(name, r"(\.[^.]+)$", 1)
    # a leading-dot name ('.env') has no suffix
    return F.lower(F.when(ext == name, F.lit("")).otherwise(ext))


def format_from_key(path: Column, fallback: Column | None = None) -> Column:
    """S-4: extension table, else the fallback format, else JSON."""
    by_ext = F.element_at(_map(EXTENSION_FORMATS), extension_of(path))
    fb = F.when(fallback.isNotNull() & (fallback != ""), fallback) if fallback is not None else F.lit(None)
    return F.coalesce(by_ext, fb, F.lit("JSON"))


def resolve_format(content_type: Column, declared: Column) -> Column:
    """S-5: declared alias first, else MIME type (before ';', trimmed, upper), else JSON."""
    aliases = _map(FORMAT_ALIASES)
    by_declared = F.when(declared.isNotNull() & (declared != ""), F.element_at(aliases, F.upper(F.trim(declared))))
    mime = F.upper(F.trim(F.split_part(content_type, F.lit(";"), F.lit(1))))
    by_mime = F.when(content_type.isNotNull() & (content_type != ""), F.element_at(aliases, mime))
    return F.coalesce(by_declared, by_mime, F.lit("JSON"))


def aliases_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(FORMAT_ALIASES.items()), "alias string, format string")
