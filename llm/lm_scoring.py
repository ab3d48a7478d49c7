"""Language-model scores by an interpolated modified Kneser-Ney model of word pairs, counted in Spark.

1. Words of the training texts are counted by their hash. Each shard of the vocabulary is a sorted array of hashes with
   counts; a word's number is its place in the shards.
2. Pairs of numbers are counted. Map tasks sum what they have seen and send packed arrays; each shard sums those it gets,
   and is a sorted array of pairs with counts. Shards are cut by a hash of the pair, so that frequent words spread.
3. From the pairs, each word gets its number of distinct left neighbours and how many of its right neighbours were seen
   once, twice or more often.
4. To score a text, workers map the arrays into memory and look all its pairs up by binary search. Mapped pages are shared
   by the workers of a machine and take no memory of their own.

Nothing is pruned; the model grows with the corpus, and ``spark.sql.shuffle.partitions`` is its number of shards.
"""

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from llm.arrays import Table, counted, mapped, save, split, summed, unpack
from llm.frames import add_columns, column, shared_folder, stored
from llm.words import NOT_SPACE, Words, mix, pieces, text_buffers

END = np.uint64(0x454E44)
#: Numbers that a map task holds before it sends them on.
HELD = 3_000_000
#: What is added to counts in the base score.
ADDED = 0.1
FALLBACK = (0.5, 1.0, 1.5)


def tokens(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text and its end, and where each text begins."""
    found = Words(*text_buffers(text), NOT_SPACE)
    return np.insert(found.hashes, found.first[1:], END), found.first + np.arange(len(found.first))


def _by_top(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shards of equal ranges of 64-bit keys."""
    return np.minimum((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32), np.uint64(shards - 1)).astype(np.int64)


@dataclass
class Vocabulary:
    """Sorted hash arrays; the word at place i of shard s has number ``offsets[s] + i``."""

    folder: str
    offsets: list[int]

    @property
    def size(self) -> int:
        return self.offsets[-1]

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of words (``size``: unknown) and their counts."""
        distinct, _ = counted(hashes)
        ids, counts = np.full(len(distinct), self.size, dtype=np.int64), np.zeros(len(distinct), dtype=np.int64)
        shard = _by_top(distinct, len(self.offsets) - 1)
        cuts = np.searchsorted(shard, np.arange(len(self.offsets)))
        for s, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if a < b and self.offsets[s] < self.offsets[s + 1]:
                known = mapped(f"{self.folder}/word-{s}", "<u8")
                at = np.minimum(np.searchsorted(known, distinct[a:b]), len(known) - 1)
                hit = known[at] == distinct[a:b]
                ids[a:b][hit] = self.offsets[s] + at[hit]
                counts[a:b][hit] = mapped(f"{self.folder}/count-{s}", "<i8")[at[hit]]
        back = np.searchsorted(distinct, hashes)
        return ids[back], counts[back]


def _gathered(docs: DataFrame, text: str, of_piece, width: int, shard_of) -> DataFrame:
    """shard and packed sums of what ``of_piece`` (text to table) finds in each task's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Table] = []
        size = 0

        def flush() -> pa.RecordBatch:
            table = summed(held, width)
            rows = list(split(table, shard_of(table[0])))
            return pa.RecordBatch.from_pydict({"shard": pa.array([r[0] for r in rows], pa.int32()), "blob": pa.array([r[1] for r in rows], pa.binary())})

        for batch in pieces(batches, "text"):
            held.append(of_piece(batch.column("text")))
            size += len(held[-1][0])
            if size > HELD:
                yield flush()
                held, size = [], 0
        yield flush()

    return docs.select(column(text).cast("string").alias("text")).mapInArrow(run, "shard int, blob binary")


def count_words(docs: DataFrame, text: str, folder: str, shards: int) -> tuple[Vocabulary, int]:
    """The vocabulary of the texts, and their number of tokens."""
    gathered = _gathered(docs, text, lambda x: counted(tokens(x)[0]), 1, lambda keys: _by_top(keys, shards))

    def merge(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        keys, counts = summed([unpack(b.as_py()) for b in table.column("blob")], 1)
        save(f"{folder}/word-{shard}", keys.astype("<u8"))
        save(f"{folder}/count-{shard}", counts[:, 0].astype("<i8"))
        return pa.table({"shard": [shard], "n": [len(keys)], "total": [int(counts.sum())]})

    rows = gathered.groupBy("shard").applyInArrow(merge, "shard long, n long, total long").collect()  # one row a shard
    sizes = {r.shard: r.n for r in rows}
    offsets = [0]
    for s in range(shards):
        offsets.append(offsets[-1] + sizes.get(s, 0))
    return Vocabulary(folder, offsets), sum(r.total for r in rows)


def pair_keys(ids: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A key for each token with the one before it (or the start of a text), and the number of the one before."""
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[first[:-1]] = size + 1
    return before.astype(np.uint64) * np.uint64(size + 2) + ids.astype(np.uint64), before


def discounts(of: list[int]) -> tuple[float, float, float]:
    """Discounts of counts 1, 2 and more from the numbers of counts 1 to 4; fixed ones where these say nothing."""
    n1, n2, n3, n4 = of
    if not (n1 and n2 and n3):
        return FALLBACK
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(d if 0 < d < k + 1 else FALLBACK[k] for k, d in enumerate(raw))


def _of_counts(counts: np.ndarray) -> list[int]:
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)]


@dataclass
class Model:
    vocabulary: Vocabulary
    shards: int
    tokens: int
    texts: int
    pairs: int  # distinct
    pair_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    word_mass: float  # share of the uniform distribution in that of words
    pair_shards: frozenset = frozenset()  # shards that have any
    word_shards: frozenset = frozenset()

    @property
    def range(self) -> int:
        """Numbers of words in a shard of their statistics."""
        return -(-(self.vocabulary.size + 2) // self.shards)

    def pair_counts(self, keys: np.ndarray) -> np.ndarray:
        distinct, _ = counted(keys)
        shard = _by_top(mix(distinct), self.shards)
        out = np.zeros(len(distinct), dtype=np.int64)
        order = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange(self.shards + 1))
        for s, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if a < b and s in self.pair_shards:
                known = mapped(f"{self.vocabulary.folder}/pair-{s}", "<u8")
                rows = order[a:b]
                at = np.minimum(np.searchsorted(known, distinct[rows]), len(known) - 1)
                hit = known[at] == distinct[rows]
                out[rows[hit]] = mapped(f"{self.vocabulary.folder}/paircount-{s}", "<u4")[at[hit]]
        return out[np.searchsorted(distinct, keys)]

    def statistics(self, ids: np.ndarray) -> np.ndarray:
        """Of words: right neighbours seen once, twice, more often; left neighbours."""
        out = np.zeros((len(ids), 4), dtype=np.int64)
        order = np.argsort(ids, kind="stable")
        shard = ids[order] // self.range
        cuts = np.searchsorted(shard, np.arange(self.shards + 1))
        for s, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if a < b and s in self.word_shards:
                known = mapped(f"{self.vocabulary.folder}/statistics-{s}", "<u4").reshape(-1, 4)
                out[order[a:b]] = known[ids[order[a:b]] - s * self.range]
        return out

    def score(self, text: pa.Array) -> tuple[np.ndarray, ...]:
        """Of each text: tokens, known tokens, base score, log10 probability."""
        hashes, first = tokens(text)
        ids, counts = self.vocabulary.look_up(hashes)
        size = self.vocabulary.size
        base = np.log10((counts + ADDED) / (self.tokens + ADDED * (size + 1)))
        keys, before = pair_keys(ids, first, size)
        pairs = self.pair_counts(keys)
        left = self.statistics(ids)[:, 3]
        d = np.array([0.0, *self.word_discounts])
        words = (left - d[np.minimum(left, 3)]) / self.pairs if self.pairs else np.zeros(len(ids))
        words = words + self.word_mass / (size + 1)
        # A token comes as often before another as it occurs, the start once a text; unknown tokens never do.
        total = np.zeros(len(ids), dtype=np.int64)
        total[1:] = counts[:-1]
        total[first[:-1]] = self.texts
        d = np.array([0.0, *self.pair_discounts])
        seen = self.statistics(before)[:, :3] @ d[1:]
        known = np.maximum(total, 1)
        chance = np.where(total > 0, (pairs - d[np.minimum(pairs, 3)]) / known + seen / known * words, words)
        at = first[:-1]
        sizes = np.diff(first)
        if not len(at):
            return tuple(np.zeros(0) for _ in range(4))
        return sizes, np.add.reduceat((counts > 0).astype(np.int64), at), np.add.reduceat(base, at), np.add.reduceat(np.log10(chance), at)


def train(docs: DataFrame, text: str = "text", shards: int | None = None) -> Model:
    """A model of all texts of ``docs``; null texts are empty. Its arrays are in the shared folder.

    A vocabulary of more than 4 billion words is refused: pairs of numbers wouldn't fit 64 bits.
    """
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = shared_folder(spark)
    vocabulary, n_tokens = count_words(docs, text, folder, shards)
    size = vocabulary.size
    if (size + 2) ** 2 >= 2**64:
        raise ValueError("the vocabulary is too large for pairs of 64 bits")
    model = Model(vocabulary, shards, n_tokens, docs.count(), 0, FALLBACK, FALLBACK, 1.0)
    width, word_range = np.uint64(size + 2), model.range

    def pairs_of(texts: pa.Array) -> Table:
        hashes, first = tokens(texts)
        return counted(pair_keys(vocabulary.look_up(hashes)[0], first, size)[0])

    gathered = _gathered(docs, text, pairs_of, 1, lambda keys: _by_top(mix(keys), shards))

    def merge_pairs(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        keys, counts = summed([unpack(b.as_py()) for b in table.column("blob")], 1)
        counts = counts[:, 0]
        save(f"{folder}/pair-{shard}", keys.astype("<u8"))
        save(f"{folder}/paircount-{shard}", np.minimum(counts, 2**32 - 1).astype("<u4"))
        left, right = keys // width, keys % width
        sizes = np.stack([counts == 1, counts == 2, counts >= 3, np.zeros(len(counts), dtype=bool)], axis=1).astype(np.int64)
        neighbours = np.zeros((len(keys), 4), dtype=np.int64)
        neighbours[:, 3] = 1
        both = summed([(left, sizes), (right, neighbours)], 4)
        rows = list(split(both, (both[0] // np.uint64(word_range)).astype(np.int64)))
        own = _of_counts(counts)
        blank = [0] * len(rows)
        out = {"shard": [shard] * (len(rows) + 1), "word_shard": [-1, *(r[0] for r in rows)], "blob": [None, *(r[1] for r in rows)], "n": [len(keys), *blank]}
        out |= {f"n{k}": [own[k - 1], *blank] for k in (1, 2, 3, 4)}
        return pa.table(out, schema=pa.schema([("shard", pa.int32()), ("word_shard", pa.int32()), ("blob", pa.binary()), *((c, pa.int64()) for c in ("n", "n1", "n2", "n3", "n4"))]))

    found = stored(gathered.groupBy("shard").applyInArrow(merge_pairs, "shard int, word_shard int, blob binary, n long, n1 long, n2 long, n3 long, n4 long"))
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "n1", "n2", "n3", "n4")]
    of_pairs = found.agg(*sums, F.collect_set("shard").alias("shards")).first()

    def merge_words(table: pa.Table) -> pa.Table:
        shard = table.column("word_shard")[0].as_py()
        keys, counts = summed([unpack(b.as_py()) for b in table.column("blob")], 4)
        dense = np.zeros((word_range, 4), dtype="<u4")
        dense[keys.astype(np.int64) - shard * word_range] = np.minimum(counts, 2**32 - 1)
        save(f"{folder}/statistics-{shard}", dense)
        own = counts[:, 3]
        return pa.table({"shard": pa.array([shard], pa.int32()), "n": [int((own >= 3).sum())], **{f"n{k}": [x] for k, x in zip((1, 2, 3, 4), _of_counts(own))}})

    of_words = found.filter("word_shard >= 0").select("word_shard", "blob").groupBy("word_shard").applyInArrow(merge_words, "shard int, n long, n1 long, n2 long, n3 long, n4 long")
    of_words = of_words.agg(*sums, F.collect_set("shard").alias("shards")).first()
    model.pair_shards, model.word_shards = frozenset(of_pairs.shards), frozenset(of_words.shards)
    model.pairs = of_pairs.n
    model.pair_discounts = discounts([of_pairs.n1, of_pairs.n2, of_pairs.n3, of_pairs.n4])
    model.word_discounts = d = discounts([of_words.n1, of_words.n2, of_words.n3, of_words.n4])
    model.word_mass = (d[0] * of_words.n1 + d[1] * of_words.n2 + d[2] * of_words.n) / of_pairs.n if of_pairs.n else 1.0
    return model


NEW = [
    T.StructField("n_tokens", T.LongType(), False),
    T.StructField("n_known", T.LongType(), False),
    T.StructField("train_tokens", T.LongType(), False),
    T.StructField("base_score", T.DoubleType(), False),
    T.StructField("score", T.DoubleType(), False),
    T.StructField("perplexity", T.DoubleType(), False),
]


def score(docs: DataFrame, model: Model, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``docs`` with ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` and ``perplexity``.

    Tokens are words, A-Z lower-cased, and one end for each text; a null or empty text is an end alone. ``score`` is the
    log10 probability of the text, ``base_score`` that of a model of single words with a constant added to counts. A model
    of no texts gives every token the chance 1. Repeated rows count each; an empty table gives an empty table. Columns in
    ``carry`` (None: all) stay, except those named like the new ones, which are replaced.
    """

    def rows():
        def compute(column: pa.Array) -> list[pa.Array]:
            n, known, base, own = model.score(column)
            perplexity = np.minimum(10.0 ** np.minimum(-own / np.maximum(n, 1), 300), math.inf)
            kinds = [pa.int64()] * 3 + [pa.float64()] * 3
            return [pa.array(x, k) for x, k in zip((n.astype(np.int64), known.astype(np.int64), np.full(len(n), model.tokens), base, own, perplexity), kinds)]

        return compute

    return add_columns(docs, text, carry, NEW, rows)


def held_out(key: str = "doc_id", folds: int = 10):
    """Is the row kept from training? A null key isn't."""
    return F.coalesce(F.crc32(column(key).cast("string")) % folds == 0, F.lit(False))
