"""Counts of 64-bit hashes in Spark, and the set of the frequent ones as sorted arrays that workers map into memory.

Map tasks count what they have seen and send packed sorted arrays; each shard (a range of hashes) sums those it gets, keeps
the hashes that are frequent enough and writes them to the shared folder. A set may be larger than any broadcast: only the
pages that are looked at are in memory, once for all workers of a machine.
"""

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.arrays import Table, mapped, save, split, unpack
from llm.frames import stored
from llm.words import pieces

#: Rows of a map task's tables before it sends them on.
HELD = 1_500_000
#: Bytes of text for each shard, and most of a piece that is counted at a time.
SHARD_BYTES, PIECE_BYTES = 16 << 20, 1 << 20


def name_hash(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little")


def codes(column: pa.Array) -> tuple[np.ndarray, list[str]]:
    """A number for each row, and the names behind the numbers."""
    coded = column.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()


def shards_for(docs: DataFrame, text: str = "text") -> int:
    """Shards in proportion to the bytes of the texts, so that a shard does not grow with the corpus."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / SHARD_BYTES))


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shards of equal ranges of keys."""
    return np.minimum((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32), np.uint64(shards - 1)).astype(np.int64)


def starts_of_runs(*sorted_columns: np.ndarray) -> np.ndarray:
    """Where a row of sorted columns differs from the one before."""
    n = len(sorted_columns[0])
    new = np.zeros(n, dtype=bool)
    new[:1] = True
    for c in sorted_columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def merged(tables: list[Table], width: int) -> Table:
    """Each key once: the sum of its first column, and the other columns of its first row."""
    if not tables:
        return np.zeros(0, dtype=np.uint64), np.zeros((0, width), dtype=np.int64)
    keys, columns = np.concatenate([t[0] for t in tables]), np.concatenate([t[1] for t in tables])
    order = np.argsort(keys, kind="stable")
    keys, columns = keys[order], columns[order]
    at = starts_of_runs(keys)
    out = columns[at]
    if len(at):
        out[:, 0] = np.add.reduceat(columns[:, 0], at)
    return keys[at], out


@dataclass(frozen=True)
class HashSet:
    folder: str
    name: str
    shards: int
    filled: frozenset  # shards that have any

    def contains(self, keys: np.ndarray) -> np.ndarray:
        order = np.argsort(keys)
        ranked = keys[order]
        new = starts_of_runs(ranked)
        distinct = ranked[new]
        found = np.zeros(len(distinct), dtype=bool)
        cuts = np.searchsorted(shard_of(distinct, self.shards), np.arange(self.shards + 1))
        for s, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if a < b and s in self.filled:
                known = mapped(f"{self.folder}/{self.name}-{s}", "<u8")
                at = np.minimum(np.searchsorted(known, distinct[a:b]), len(known) - 1)
                found[a:b] = known[at] == distinct[a:b]
        out = np.empty(len(keys), dtype=bool)
        out[order] = np.repeat(found, np.diff(np.append(new, len(keys))))
        return out


def count(rows: DataFrame, of_piece: Callable[[pa.RecordBatch], Table], width: int, shards: int, text: str = "text") -> DataFrame:
    """``shard`` and ``blob``: packed tables of what ``of_piece`` finds in each task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Table] = []
        size = 0

        def flush() -> pa.RecordBatch:
            table = merged(held, width)
            parts = list(split(table, shard_of(table[0], shards)))
            return pa.RecordBatch.from_pydict({"shard": pa.array([p[0] for p in parts], pa.int32()), "blob": pa.array([p[1] for p in parts], pa.binary())})

        for batch in pieces(batches, text, PIECE_BYTES):
            held.append(of_piece(batch))
            size += len(held[-1][0])
            if size > HELD:
                yield flush()
                held, size = [], 0
        yield flush()

    return rows.mapInArrow(run, "shard int, blob binary")


def frequent(counted: DataFrame, least: int, folder: str, name: str, shards: int, others: list[str]) -> tuple[HashSet, DataFrame]:
    """The hashes counted ``least`` times or more as a set, and as a table: ``key``, ``n`` and the ``others`` of one occurrence."""

    def merge(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        keys, columns = merged([unpack(b.as_py()) for b in table.column("blob")], 1 + len(others))
        often = columns[:, 0] >= least
        keys, columns = keys[often], columns[often]
        save(f"{folder}/{name}-{shard}", keys.astype("<u8"))
        return pa.table({"shard": pa.array(np.full(len(keys), shard), pa.int32()), "key": pa.array(keys.view(np.int64)), **{c: pa.array(columns[:, i]) for i, c in enumerate(["n", *others])}})

    schema = "shard int, key long, " + ", ".join(f"{c} long" for c in ["n", *others])
    table = stored(counted.groupBy("shard").applyInArrow(merge, schema))
    filled = frozenset(r.shard for r in table.select("shard").distinct().collect())  # one row a shard
    return HashSet(folder, name, shards, filled), table
