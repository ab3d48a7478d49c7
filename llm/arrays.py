"""Sorted arrays of keys with counts: packed for shuffles, summed per shard, kept in files that workers map into memory."""

import os
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow.fs
import zstandard

Table = tuple[np.ndarray, np.ndarray]  # ascending keys (uint64); counts, one column each (int64)


def pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Differences of keys and counts, byte by byte of all numbers, compressed."""
    planes = [np.diff(keys, prepend=np.uint64(0)).astype("<u8"), *np.ascontiguousarray(counts.T).astype("<u8")]
    raw = b"".join(p.view(np.uint8).reshape(-1, 8).T.tobytes() for p in planes)
    return np.array([len(keys), counts.shape[1]], dtype="<u8").tobytes() + zstandard.ZstdCompressor(level=1).compress(raw)


def unpack(blob: bytes) -> Table:
    n, width = (int(x) for x in np.frombuffer(blob[:16], dtype="<u8"))
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[16:]) if n else b"", dtype=np.uint8)
    planes = [np.ascontiguousarray(p.reshape(8, n).T).view("<u8").ravel() for p in raw.reshape(width + 1, 8 * n)]
    return np.cumsum(planes[0], dtype=np.uint64), np.stack([p.astype(np.int64) for p in planes[1:]], axis=1) if n else np.zeros((0, width), dtype=np.int64)


def summed(tables: list[Table], width: int) -> Table:
    """One table with each key once."""
    if not tables:
        return np.zeros(0, dtype=np.uint64), np.zeros((0, width), dtype=np.int64)
    keys, counts = np.concatenate([t[0] for t in tables]), np.concatenate([t[1] for t in tables])
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[at], np.add.reduceat(counts, at, axis=0) if len(at) else counts


def counted(keys: np.ndarray) -> Table:
    """Distinct keys and how often they occur."""
    keys = np.sort(keys)
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[at], np.diff(np.append(at, len(keys)))[:, None]


def split(table: Table, shard: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """The packed rows of each shard that has any."""
    keys, counts = table
    order = np.argsort(shard, kind="stable")
    shard = shard[order]
    cuts = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(shard) else []
    for a, b in zip(cuts, [*cuts[1:], len(shard)]):
        yield int(shard[a]), pack(keys[order[a:b]], counts[order[a:b]])


def save(uri: str, array: np.ndarray) -> None:
    """Write an array to a file that appears at once, whole. Writing it again is harmless."""
    files, place = pyarrow.fs.FileSystem.from_uri(uri)
    files.create_dir(place.rsplit("/", 1)[0])
    new = f"{place}.{uuid.uuid4().hex}"
    with files.open_output_stream(new, compression=None) as out:
        out.write(np.ascontiguousarray(array))
    files.move(new, place)


@lru_cache(maxsize=4096)
def mapped(uri: str, kind: str) -> np.ndarray:
    """The array of a file, mapped into memory. A file in a remote store is copied to the worker's own disk first; the copy
    has no name any more once it is mapped, so that nothing stays behind."""
    files, place = pyarrow.fs.FileSystem.from_uri(uri)
    copy = None
    if not isinstance(files, pyarrow.fs.LocalFileSystem):
        handle, copy = tempfile.mkstemp()
        os.close(handle)
        pyarrow.fs.copy_files(place, copy, source_filesystem=files, destination_filesystem=pyarrow.fs.LocalFileSystem())
        place = copy
    out = np.memmap(place, dtype=kind, mode="r") if os.path.getsize(place) else np.zeros(0, dtype=kind)
    if copy:
        os.unlink(copy)
    return out
