"""Benchmark decontamination with suffix arrays of the training texts.

Each piece of some megabytes of training text is a shard with a suffix array over words: the positions at which a
verbatim match can begin, sorted by the words that follow. Positions whose first words (as many as in the shortest
window) occur nowhere in the benchmark are left out, since no match begins there. Every suffix of every benchmark item is
looked up in the shard by binary search; the range that it finds holds all places of its window, and comparing on from
there gives the longest match at each.

A benchmark too large for a worker is taken in blocks of items, each in a pass over the documents.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from llm.frames import column
from llm.words import ALPHANUMERIC, Words, pieces, text_buffers

WINDOW = 10
#: Bytes of benchmark text that a worker takes at once.
BLOCK_BYTES = 8 << 20


@dataclass
class Benchmark:
    """Words of a block of items as ranks in a sorted array of word hashes; suffix i begins at word i."""

    names: list[str]
    vocabulary: np.ndarray  # sorted hashes; the word with rank r has number r + 1
    words: np.ndarray  # numbers, items one after another
    item: np.ndarray  # of each word
    end: np.ndarray  # of the item of each word
    need: np.ndarray  # words in the window that begins at each word; 0: none does
    seed: int  # words of the shortest window
    seeds: np.ndarray  # sorted hashes of the first words of windows

    @classmethod
    def of(cls, names: list[str], texts: list[str], window: int) -> "Benchmark":
        data, offsets = text_buffers(pa.array(texts, pa.large_string()))
        found = Words(data, offsets, ALPHANUMERIC)
        sizes = np.diff(found.first)
        vocabulary = np.unique(found.hashes)
        words = (np.searchsorted(vocabulary, found.hashes) + 1).astype(np.uint32)
        item = np.repeat(np.arange(len(names)), sizes)
        end = np.repeat(found.first[1:], sizes)
        length = np.minimum(np.repeat(sizes, sizes), window)
        need = np.where(np.arange(len(words)) + length <= end, length, 0)
        seed = int(length.min()) if len(length) else window
        at = np.flatnonzero(need)
        return cls(names, vocabulary, words, item, end, need, seed, np.unique(_grams(words, seed)[at]))


def _grams(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of the ``n`` words from each position; past the end come zeros."""
    padded = np.concatenate([words, np.zeros(n, dtype=words.dtype)]).astype(np.uint64)
    out = np.zeros(len(words), dtype=np.uint64)
    for k in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + padded[k : k + len(words)]
        out ^= out >> np.uint64(29)
    return out


def _keys(words: np.ndarray, at: np.ndarray, ends: np.ndarray, n: int, fill: int = 0) -> np.ndarray:
    """The ``n`` words from each place as bytes that compare like the words; ``fill`` stands past the end."""
    place = at[:, None] + np.arange(n)
    inside = place < ends[:, None]
    rows = np.where(inside, words[np.minimum(place, len(words) - 1)], np.uint32(fill)).astype(">u4")
    return np.ascontiguousarray(rows).view(f"S{4 * n}").ravel()


def search(benchmark: Benchmark, found: Words, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """Matches in a shard: word of the shard, word of the benchmark, words in common (the longest match from there).

    One row for each place of each window.
    """
    none = tuple(np.zeros(0, dtype=np.int64) for _ in range(3))
    if not len(benchmark.words) or not len(found.hashes):
        return none
    rank = np.searchsorted(benchmark.vocabulary, found.hashes)
    rank[rank == len(benchmark.vocabulary)] = 0
    words = np.where(benchmark.vocabulary[rank] == found.hashes, rank + 1, 0).astype(np.uint32)
    doc_end = np.repeat(found.first[1:], np.diff(found.first))
    # The suffixes at which a match can begin.
    at = np.flatnonzero(words)
    for k in range(1, benchmark.seed):
        at = at[(at + k < doc_end[at])]
        at = at[words[at + k] > 0]
    if len(at):
        grams = _grams(words, benchmark.seed)[at]
        i = np.minimum(np.searchsorted(benchmark.seeds, grams), len(benchmark.seeds) - 1)
        at = at[benchmark.seeds[i] == grams]
    if not len(at):
        return none
    keys = _keys(words, at, doc_end[at], window)
    order = np.argsort(keys, kind="stable")
    array, keys = at[order], keys[order]  # the suffix array and its sorted prefixes
    suffix = np.flatnonzero(benchmark.need)
    stop = suffix + benchmark.need[suffix]
    low = np.searchsorted(keys, _keys(benchmark.words, suffix, stop, window), side="left")
    high = np.searchsorted(keys, _keys(benchmark.words, suffix, stop, window, 0xFFFFFFFF), side="right")
    count = np.maximum(high - low, 0)
    theirs = np.repeat(suffix, count)
    start = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
    ours = array[start + np.arange(len(theirs))]
    length = benchmark.need[theirs].astype(np.int64)
    grow = np.arange(len(ours))
    while len(grow):
        o, t = ours[grow] + length[grow], theirs[grow] + length[grow]
        fits = (o < doc_end[ours[grow]]) & (t < benchmark.end[theirs[grow]])
        grow, o, t = grow[fits], o[fits], t[fits]
        grow = grow[words[o] == benchmark.words[t]]
        length[grow] += 1
    return ours, theirs, length


_RANGE = T.StructType([T.StructField("first_word", T.LongType(), False), T.StructField("after_word", T.LongType(), False)])
_MATCH = T.StructType([T.StructField(n, T.StringType() if n == "item_id" else T.LongType(), False) for n in ("item_id", "item_word", "doc_word", "n_words")])
NEW = [
    T.StructField("n_words", T.LongType(), False),
    T.StructField("n_hit", T.LongType(), False),
    T.StructField("hit_ranges", T.ArrayType(_RANGE, False), False),
    T.StructField("hit_items", T.ArrayType(T.StringType(), False), False),
    T.StructField("matches", T.ArrayType(_MATCH, False), False),
]


def _shard(benchmark: Benchmark, batch: pa.RecordBatch, window: int, before: bool) -> list[list]:
    """The new columns for the texts of a shard; ``before``: in addition to those of earlier blocks of the benchmark."""
    data, offsets = text_buffers(batch.column("_text_of_row"))
    found = Words(data, offsets, ALPHANUMERIC)
    ours, theirs, length = search(benchmark, found, window)
    doc = np.searchsorted(found.first, ours, side="right") - 1
    ranges: list[list] = [[] for _ in range(batch.num_rows)]
    items: list[set] = [set() for _ in range(batch.num_rows)]
    matches: list[list] = [[] for _ in range(batch.num_rows)]
    if before:
        for d, (a, b, c) in enumerate(zip(*(batch.column(n).to_pylist() for n in ("hit_ranges", "hit_items", "matches")))):
            ranges[d], items[d], matches[d] = [(x["first_word"], x["after_word"]) for x in a], set(b), c
    # A match that continues the one a word before in both texts ends where that one ends: only the first is told.
    # Documents and items lie one after another; a match at the start of one continues nothing.
    inner = np.lexsort((ours, ours - theirs))
    o, t = ours[inner], theirs[inner]
    d, i = doc[inner], benchmark.item[t]
    first = np.ones(len(o), dtype=bool)
    first[1:] = (o[1:] != o[:-1] + 1) | (t[1:] != t[:-1] + 1) | (d[1:] != d[:-1]) | (i[1:] != i[:-1])
    for k in np.sort(inner[first]):
        d, i, n = int(doc[k]), int(benchmark.item[theirs[k]]), int(length[k])
        at = int(ours[k] - found.first[d])
        items[d].add(benchmark.names[i])
        ranges[d].append((at, at + n))  # every word of a longest match lies in a window
        begin = int(np.searchsorted(benchmark.item, i))
        matches[d].append({"item_id": benchmark.names[i], "item_word": int(theirs[k]) - begin, "doc_word": at, "n_words": n})
    joined = [_joined(r) for r in ranges]
    return [
        np.diff(found.first).tolist(),
        [sum(b - a for a, b in r) for r in joined],
        [[{"first_word": a, "after_word": b} for a, b in r] for r in joined],
        [sorted(x) for x in items],
        matches,
    ]


def _joined(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The ranges in order, overlapping and touching ones as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _blocks(items: DataFrame, block_bytes: int) -> Iterator[tuple[list[str], list[str]]]:
    """Names and texts of the items, ``block_bytes`` of text at a time (or one item)."""
    names: list[str] = []
    texts: list[str] = []
    size = 0
    for row in items.toLocalIterator():
        if names and size + len(row.text) > block_bytes:
            yield names, texts
            names, texts, size = [], [], 0
        names.append(row.item_id)
        texts.append(row.text)
        size += len(row.text)
    if names:
        yield names, texts


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    carry: list[str] | None = None,
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit``, ``hit_ranges``, ``hit_items`` and ``matches``.

    A window is ``window`` consecutive words of an item, or all words of a shorter one; a word inside an occurrence of a
    window is hit; ``hit_items`` are the items with such windows, in order. ``matches`` has each longest common run of
    words that holds a window: item, word of the item, word of the document, number of words. Texts and items that are
    null, empty or without a word hit nothing and are hit by nothing; an item without a name is named by the empty string;
    repeated names are one item in ``hit_items``; repeated documents are judged each; an empty table gives no rows or no
    hits. Columns in ``carry`` (None: all) stay, except those named like the new ones, which are replaced.
    """
    taken = {f.name.lower() for f in NEW}
    kept = [c for c in (docs.columns if carry is None else carry) if c.lower() not in taken]
    items = benchmark.select(F.coalesce(column(item_id).cast("string"), F.lit("")).alias("item_id"), F.coalesce(column(item_text).cast("string"), F.lit("")).alias("text"))
    context = docs.sparkSession.sparkContext
    now = docs.select(*[column(c) for c in kept], column(text).cast("string").alias("_text_of_row"))
    schema = T.StructType([*now.schema.fields, *NEW])
    blocks = 0
    for block in _blocks(items, block_bytes):
        now = now.mapInArrow(_pass(context.broadcast(Benchmark.of(*block, window)), schema, len(kept) + 1, window, blocks > 0), schema)
        blocks += 1
    if not blocks:
        now = now.mapInArrow(_pass(context.broadcast(Benchmark.of([], [], window)), schema, len(kept) + 1, window, False), schema)
    return now.drop("_text_of_row")


def _pass(shared, schema: T.StructType, n_kept: int, window: int, before: bool):
    kinds = [f.type for f in to_arrow_schema(schema)][n_kept:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "_text_of_row"):
            new = _shard(shared.value, batch, window, before)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_kept], *(pa.array(x, k) for x, k in zip(new, kinds))], names=schema.names)

    return run


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents in which no window of the benchmark occurs, with their own columns. Options as for ``scan``."""
    marked = docs.withColumn("_document", F.struct(*[column(c) for c in docs.columns]))
    marked = marked.select("_document", column(text).alias("_words_of"))
    return scan(marked, benchmark, "_words_of", ["_document"], **options).filter(F.size("hit_items") == 0).select("_document.*")
