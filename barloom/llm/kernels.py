"""NumPy and byte-string helpers that run inside Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACES = b" \t\n\x0b\x0c\r"
_UPPER = bytes(range(65, 91))

#: A-Z to a-z; every ASCII white space character to a blank
LOWER = bytes.maketrans(_UPPER + SPACES, bytes(range(97, 123)) + b" " * len(SPACES))
#: A-Z to a-z; every other ASCII character that is neither letter nor digit to a blank
ALNUM = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def strings(col: pa.Array) -> pa.Array:
    """The column without NULLs (empty instead)."""
    return pc.fill_null(col, pa.scalar("").cast(col.type)) if col.null_count else col


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of the column and the offsets of each, without a copy."""
    col = strings(col)
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    _, offsets, data = col.buffers()
    if len(col) == 0 or data is None:
        return np.empty(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    off = np.frombuffer(offsets, kind)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[off[0]:off[-1]], off - off[0]


def each_text(col: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of every text; NULL gives empty bytes."""
    data, off = utf8(col)
    raw = data.tobytes()
    for i, j in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        yield raw[i:j]


def slices(off: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes (a longer row stands alone)."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_runs(blanked: bytes, overlap: int = 0, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """Words of a text whose separators are blanks, in runs of about ``size`` bytes.

    Each run starts with the last ``overlap`` words before it, so windows of
    overlap + 1 words are seen exactly once and a huge text needs little memory.
    """
    at, tail, n = 0, [], len(blanked)
    while at < n:
        end = blanked.find(b" ", at + size) if at + size < n else n
        end = n if end < 0 else end
        fresh = blanked[at:end].split()
        if fresh:
            yield tail + fresh
            tail = (tail + fresh)[-overlap:] if overlap else []
        at = end
