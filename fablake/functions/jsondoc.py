"""Strict single-document JSON parsing.

``try_parse_json`` stops after the first JSON value and ignores whatever
follows (``{"a":1} x`` or a JSON-lines body parse as ``{"a":1}``), while a
JSON document reader must reject both. Wrapping the text as ``[<text>,0]``
makes any trailing content either a syntax error or extra array elements:
the text is one document exactly when the wrapped array has two elements,
and the first is the value -- still a single parse per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strict_parse_json(text: Column) -> Column:
    """VARIANT of ``text`` when it holds exactly one JSON value, else NULL."""
    wrapped = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit(",0]"))), "$", "array<variant>")
    # the index holds the test, so that both uses of the array are always evaluated, and so only once
    return F.get(wrapped, F.when(F.size(wrapped) == 2, 0))
