"""Vectorised splitting and hashing of words in batches of UTF-8 texts.

Words are runs of bytes of a given class, after A-Z is lower-cased. Every word gets a 64-bit hash: a polynomial in an odd
base modulo 2**64, read off prefix sums of the whole batch, then mixed. Equal words have equal hashes on every machine.
Two different words of a corpus share a hash with a chance of about 2**-64 per pair.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

#: [^\x20\x09-\x0D]+
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False

#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+, after lower-casing
ALPHANUMERIC = np.zeros(256, dtype=bool)
ALPHANUMERIC[ord("0") : ord("9") + 1] = True
ALPHANUMERIC[ord("a") : ord("z") + 1] = True
ALPHANUMERIC[0x80:] = True

#: [^\x00-\x40\x5B-\x60\x7B-\x7F]+, after lower-casing
LETTERS = np.zeros(256, dtype=bool)
LETTERS[ord("a") : ord("z") + 1] = True
LETTERS[0x80:] = True

_powers = np.ones(1, dtype=np.uint64)
_inverses = np.ones(1, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of BASE and of its inverse from 0 to n."""
    global _powers, _inverses
    if len(_powers) <= n:
        out = []
        for base in (BASE, INVERSE):
            t = np.full(max(n + 1, 1 << 20), base, dtype=np.uint64)
            t[0] = 1
            out.append(np.multiply.accumulate(t))
        _powers, _inverses = out
    return _powers, _inverses


class Words:
    """The words of a batch: ``hashes`` and byte ranges ``starts``, ``ends``; text i has words ``first[i]`` to ``first[i + 1]``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, classes: np.ndarray):
        lower = LOWER[data]
        inside = np.zeros(len(lower) + 2, dtype=bool)
        inside[1:-1] = classes[lower]
        edge = inside[1:] != inside[:-1]
        # Words end where a text ends.
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(lower))]
        joined = cuts[inside[cuts] & inside[cuts + 1]]
        marks = np.flatnonzero(edge)
        if len(joined):
            joined = np.unique(joined)
            marks = np.sort(np.concatenate([marks, joined, joined]))
        self.starts, self.ends = marks[0::2], marks[1::2]
        powers, inverses = _tables(len(lower))
        sums = np.zeros(len(lower) + 1, dtype=np.uint64)
        np.cumsum((lower.astype(np.uint64) + np.uint64(1)) * powers[: len(lower)], out=sums[1:])
        self.hashes = mix((sums[self.ends] - sums[self.starts]) * inverses[self.starts])
        self.first = np.searchsorted(self.starts, offsets).astype(np.int64)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, dtype=np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def gathered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of many ranges one after the other, and where each range begins there."""
    offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    return data[np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], ends - starts)], offsets


def strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Ranges of UTF-8 bytes as strings."""
    found, offsets = gathered(data, starts, ends)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(found)))


def pieces(batches: Iterator[pa.RecordBatch], text: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each piece has at most ``limit`` bytes of text, or one row."""
    for batch in batches:
        _, offsets = text_buffers(batch.column(text))
        row = 0
        while row < batch.num_rows:
            end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
            yield batch.slice(row, end - row)
            row = end
