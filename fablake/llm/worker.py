"""One large table for each Python worker.

Spark reuses its Python workers, also for later stages and other queries, so what a module keeps stays in memory for good.  A table
is therefore held here: asking for another one frees it, and so does ``release``, which every scan of texts calls first.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable
from typing import Any

import pyarrow as pa

_held: dict[Hashable, Any] = {}


def table(key: Hashable, make: Callable[[], Any]) -> Any:
    """The table of this key, made on first use in this process; any other one goes."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def release() -> None:
    """Frees the table, and what Arrow keeps for later batches."""
    _held.clear()
    pa.default_memory_pool().release_unused()
