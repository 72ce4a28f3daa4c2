"""Columnar text helpers: Arrow batches in, numpy word arrays out.

Everything here is vectorised over a whole block of texts, so one pass costs a few numpy operations per byte and no Python
object per word.  A block is bounded by bytes, so a task's memory does not depend on the number or the length of its texts
(one single text is never split).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are handled at a time.
BLOCK_BYTES = 2_000_000
#: Rows that are handled at a time.
BLOCK_ROWS = 50_000

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_IDENT = _WORD.copy()
_IDENT[95] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Odd multiplier of the polynomial hash and its inverse modulo 2**64.
_B = 0x9E3779B97F4A7C15
_BINV = pow(_B, -1, 1 << 64)
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, element by element."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(32)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.ones(max(n, 1), np.uint64)
    if n > 1:
        out[1:] = np.uint64(base)
        np.multiply.accumulate(out, out=out)
    return out[:n]


_POW = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _pow(kind: str, n: int) -> np.ndarray:
    if len(_POW[kind]) < n:
        _POW[kind] = powers(_B if kind == "up" else _BINV, max(n, BLOCK_BYTES + 1))
    return _POW[kind][:n]


def blocks(batch: pa.RecordBatch, text: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into pieces of at most `limit` bytes of text, or of one row."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), np.int64)
    start, total = 0, 0
    for i, s in enumerate(sizes):
        if i > start and (total + s > limit or i - start >= BLOCK_ROWS):
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(s)
    if start < len(sizes):
        yield batch.slice(start)


def joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts with one zero byte after each, and the start of each text in them."""
    parts = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts.to_pylist()]
    sizes = np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts))
    return np.frombuffer(b"\0".join([*parts, b""]), np.uint8), np.concatenate([[0], np.cumsum(sizes)[:-1]]) if parts else np.zeros(0, np.int64)


def words(texts: pa.Array, *, ident: bool, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row, first byte and end byte (in the joined texts) of every word, in order.

    ident: underscores belong to words.  lower: ASCII letters count as lower case.
    """
    data, starts = joined(texts)
    if not len(data):
        e = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), e, e, e
    if lower:
        data = _LOWER[data]
    edge = np.diff(np.concatenate([[False], (_IDENT if ident else _WORD)[data], [False]]).astype(np.int8))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _pow("up", len(data)), out=prefix[1:])
    h = mix((prefix[end] - prefix[begin]) * _pow("down", len(data))[begin] + (end - begin).astype(np.uint64))
    row = np.searchsorted(starts, begin, "right") - 1
    return h, row, begin, end
