"""Vectorised scans of whole texts, straight from Arrow's string buffers.

``scans(batch, column)`` cuts a record batch into runs of rows of about
``CHUNK_BYTES`` (one longer text is a run of its own, so memory follows the
longest text, not the batch), and gives each run as a ``Scan``: the bytes of
its texts back to back, plus where each text, word and line begins.  Words are
``[^\\x20\\x09-\\x0D]+`` as UTF-8 bytes; a word never spans two texts.

Hashes are 64-bit: each byte is replaced by a random 64-bit value, a span's
value is a polynomial over them (prefix sums, so any span costs O(1)), and a
finaliser mixes value and length.  They depend on the bytes alone, never on
the process, so they are equal on every executor and every retry.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from fablake.llm import worker

CHUNK_BYTES = 1 << 20
U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (shift-multiply rounds)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values."""
    start = np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    return mix(start + (np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)))


SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"): ord("Z") + 1] += 32
_BYTE = stream(1, 256)
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_INVERSE = U64(pow(int(_BASE), -1, 1 << 64))
_LENGTH = U64(0xD6E8FEB86659FD93)
_powers = np.ones(1, U64)
_inverses = np.ones(1, U64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, n of each at least; those for a text much longer than a chunk are not kept."""
    global _powers, _inverses
    if n <= len(_powers):
        return _powers, _inverses
    size = max(n, CHUNK_BYTES + 1)
    both = tuple(np.concatenate([np.ones(1, U64), np.cumprod(np.full(size - 1, x, U64))]) for x in (_BASE, _INVERSE))
    if n <= CHUNK_BYTES + 1:
        _powers, _inverses = both
    return both


class Scan:
    """Rows ``[first, first + rows)`` of a batch; ``data`` holds their texts' bytes back to back."""

    def __init__(self, first: int, data: np.ndarray, bounds: np.ndarray):
        self.first, self.data, self.bounds = first, data, bounds
        self.rows = len(bounds) - 1

    def _spans(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of each run of True, cut at the ends of texts."""
        n = len(inside)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        edge = np.zeros(n + 1, bool)
        edge[self.bounds] = True
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | edge[1:-1]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | edge[1:-1]
        return np.flatnonzero(begins), np.flatnonzero(ends) + 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(begin, end, first word of each text plus the total)."""
        begin, end = self._spans(~SPACE[self.data])
        return begin, end, np.searchsorted(begin, self.bounds)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(begin, end, first line of each text plus the total); texts cut at line feeds, blank
        lines included, so a text of n line feeds has n + 1 lines."""
        feeds = np.flatnonzero(self.data == 0x0A)
        before = np.searchsorted(feeds, self.bounds)
        heads = before + np.arange(self.rows + 1)
        begin = np.empty(len(feeds) + self.rows, np.int64)
        end = np.empty(len(feeds) + self.rows, np.int64)
        text_of = np.searchsorted(self.bounds, feeds, "right") - 1
        begin[heads[:-1]] = self.bounds[:-1]
        begin[np.arange(len(feeds)) + text_of + 1] = feeds + 1
        end[heads[1:] - 1] = self.bounds[1:]
        end[np.arange(len(feeds)) + text_of] = feeds
        return begin, end, heads

    def hashes(self, begin: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
        """64-bit hash of each span; ``lower`` folds A-Z first."""
        n = len(self.data)
        powers, inverses = _power_tables(n + 1)
        values = _BYTE[LOWER[self.data] if lower else self.data]
        values *= powers[:n]
        prefix = np.zeros(n + 1, U64)
        np.cumsum(values, out=prefix[1:])
        h = (prefix[end] - prefix[begin]) * inverses[begin]
        return mix(h + (end - begin).astype(U64) * _LENGTH)

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Number of True bytes in each text."""
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.bounds[1:]] - total[self.bounds[:-1]]


def scans(batch: pa.RecordBatch, column: str = "text") -> Iterator[Scan]:
    """The batch's texts, in runs of rows; a null text is an empty one."""
    worker.release()
    values = batch.column(batch.schema.get_field_index(column))
    if not pa.types.is_large_string(values.type):
        values = values.cast(pa.large_string())
    n = len(values)
    if not n:
        return
    _, offsets, data = values.buffers()
    at = np.frombuffer(offsets, np.int64)[values.offset: values.offset + n + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if values.null_count:
        valid = values.is_valid().to_numpy(zero_copy_only=False)
        length = np.where(valid, np.diff(at), 0)
        if (length != np.diff(at)).any():  # a null that keeps bytes in the buffer
            at = np.concatenate([at[:1] * 0, np.cumsum(length)])
            whole = np.frombuffer("".join(x for x in values.to_pylist() if x).encode(), np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(at, at[lo] + CHUNK_BYTES, "right")) - 1
        hi = min(max(hi, lo + 1), n, lo + 20_000)
        yield Scan(lo, whole[at[lo]: at[hi]], (at[lo: hi + 1] - at[lo]).astype(np.int64))
        lo = hi


def text_index(counts_at: np.ndarray) -> np.ndarray:
    """For items grouped by text (first item of each text plus the total): each item's text."""
    return np.repeat(np.arange(len(counts_at) - 1), np.diff(counts_at))


def sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of the values of each group; groups are consecutive, ``at`` as in ``text_index``."""
    total = np.zeros(len(values) + 1, values.dtype if values.dtype == U64 else np.int64)
    np.cumsum(values, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def order_by_text(keys: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Positions sorted by (text, key)."""
    order = np.argsort(keys, kind="stable")
    return order[np.argsort(text[order].astype(np.uint16 if len(text) and text[-1] < 65536 else np.int64), kind="stable")]
