"""Documents cut and packed into sequences that cost a model about the same, without padding.

1. A map task turns its texts into token ids. Texts fall apart at blanks where no token can reach over; the ids of each
   part are kept, so that only new parts go through the tokenizer.
2. The task packs its documents a chunk at a time. Whole stretches of ``limit`` ids are sequences of their own. What is
   left of each document has an estimated cost, linear in its length (projections) plus quadratic (attention inside the
   document). In descending order, each goes to the sequence of lowest cost that has room for it.
3. Sequences are exactly as many as the chunk's ids fill. Where no sequence has room for a whole piece, the emptiest one
   takes what fits and the rest is placed again. The last ids of a chunk, fewer than ``limit``, have sequences of a power
   of two of ids each, which need no padding either.

Nothing is shuffled, and a task holds one chunk, or one long text. Sequences are numbered by partition, so a task that is
run again gives the same ones as long as its rows come in the same order, as they do from files.
"""

import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from llm.frames import column, keep_only, unused_name
from llm.words import pieces

LIMIT = 1024
#: Ids that are packed at a time.
CHUNK = 1 << 20
#: Id behind each document.
END = 0
#: Cost of an id, and of a pair of ids that see each other.
LINEAR, QUADRATIC = 1.0, 1 / 4096
#: Parts of texts whose ids a worker keeps (some 200 MB) for its tasks; beyond that it starts anew.
PARTS = 800_000
#: Characters of a part that is kept.
LONG = 100
#: New parts that are tokenized as one text.
LINES = 100
#: In place of the ids of a word that can't be told apart from its neighbours.
UNSAFE = False
#: Sequences of a partition have numbers from its own multiple of this on.
NUMBERS = 1 << 40

#: A blank between two characters that are no white space: the words before it end there, whatever follows, and a token
#: may begin with it, whatever comes before.
SAFE = re.compile(r"(?<=[^\s᠎])(?= [^\s᠎])")
#: Letters end before a mark, and a line break between two such characters is a token.
_CUT = re.compile(r"(?<=[A-Za-zÀ-ÖØ-öø-ɏ])(?=[.,;:!?])|(?<=[^\s᠎])(?=\n[^\s᠎])|(?<=[^\s᠎]\n)(?=[^\s᠎])")
_EDGE = re.compile(r"^[\s᠎]|[\s᠎]\Z|^\Z")


class Ids:
    """Ids of texts as little-endian 32-bit numbers, by a tokenizer file. Special tokens in a text are ordinary text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True
        #: Ids of words at the start of a text, of those behind a blank (with it), and of parts behind others in a word.
        self._first: dict[str, bytes | bool] = {}
        self._later: dict[str, bytes | bool] = {}
        self._behind: dict[str, bytes | bool] = {}
        self._line = np.frombuffer(self._coded(["\n"])[0], dtype="<u4")[0]

    def _coded(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _add(self, known: dict[str, bytes | bool], stems: set[str], blank: str) -> None:
        """Stems without line breaks go as lines of a text, whose breaks are tokens of their own."""
        new = list(stems.difference(known))
        broken = [x for x in new if "\n" in x]
        if broken:
            known.update(zip(broken, self._coded([blank + x for x in broken])))
            new = [x for x in new if x not in known]
        for i, ids in enumerate(self._coded([blank + ("\n" + blank).join(new[i : i + LINES]) for i in range(0, len(new), LINES)])):
            ends = np.append(4 * np.flatnonzero(np.frombuffer(ids, dtype="<u4") == self._line), len(ids)).tolist()
            known.update(zip(new[LINES * i : LINES * i + LINES], [ids[a:b] for a, b in zip([0, *(e + 4 for e in ends)], ends)]))

    def _learn(self, known: dict[str, bytes | bool], words: set[str], blank: str) -> None:
        stems = {w for w in words if w.isalpha() and len(w) <= LONG}
        split, behind = {}, set()
        for w in words.difference(stems):
            # White space at an edge, or nothing: the blank beside it is no safe place.
            if len(w) > LONG or _EDGE.search(w):
                known[w] = UNSAFE
            else:
                split[w] = parts = _CUT.split(w)
                stems.add(parts[0])
                behind.update(parts[1:])
        self._add(known, stems, blank)
        self._add(self._behind, behind, "")
        inner = self._behind
        for w, parts in split.items():
            known[w] = known[parts[0]] + b"".join([inner[x] for x in parts[1:]])

    def of(self, texts: list[str]) -> list[bytes]:
        if len(self._first) + len(self._later) + len(self._behind) > PARTS:
            for known in (self._first, self._later, self._behind):
                known.clear()
        split = [t.split(" ") for t in texts]
        self._learn(self._first, {w[0] for w in split}.difference(self._first), "")
        # One look-up for each word; what is missing is learned for all texts at once, and looked up where it was missing.
        found = [list(map(self._later.get, words)) for words in split]
        gaps = [[i for i, x in enumerate(ids) if x is None] for ids in found]
        new = {words[i] for words, missing in zip(split, gaps) for i in missing if i}
        self._learn(self._later, new, " ")
        out, later = [], self._later
        for text, words, ids, missing in zip(texts, split, found, gaps):
            for i in missing:
                if i:
                    ids[i] = later[words[i]]
            ids[0] = self._first[words[0]]
            try:
                out.append(b"".join(ids))
            except TypeError:  # a word at an unsafe place
                out.append(self._parts(text))
        return out

    def _parts(self, text: str) -> bytes:
        parts = SAFE.split(text) if text else []
        return b"".join(b"".join(self._coded(parts[i : i + 10_000])) for i in range(0, len(parts), 10_000))


@lru_cache(maxsize=1)
def coder(path: str) -> Ids:
    return Ids(path)


def release() -> None:
    coder.cache_clear()


def assign(lengths: np.ndarray, limit: int = LIMIT, linear: float = LINEAR, quadratic: float = QUADRATIC) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of documents of these lengths, one row each: document, start, length, sequence, offset; then the length and
    cost of each sequence.

    Documents of the same length go in their order; of sequences that cost the same, the first is taken.
    """
    if len(lengths) == 0 or lengths.sum() == 0:
        return np.zeros((0, 5), dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
    whole = lengths // limit
    doc = np.repeat(np.arange(len(lengths)), whole)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(whole) - whole, whole)
    full = np.stack([doc, nth * limit, np.full(len(doc), limit), np.arange(len(doc)), np.zeros(len(doc), dtype=np.int64)], axis=1)
    rest = lengths % limit
    total = int(rest.sum())
    tail = [1 << k for k in range(limit.bit_length() - 1, -1, -1) if total % limit >> k & 1]
    sizes = np.array([limit] * (total // limit) + tail, dtype=np.int64)
    room, cost, out = sizes.copy(), np.zeros(len(sizes)), []
    for d in np.argsort(-rest, kind="stable"):
        left, start = int(rest[d]), int(whole[d]) * limit
        while left:
            priced = np.where(room >= left, cost, np.inf)
            at = int(priced.argmin())
            if priced[at] == np.inf:
                at = int(room.argmax())
            n = min(left, int(room[at]))
            out.append((d, start, n, len(doc) + at, int(sizes[at] - room[at])))
            room[at] -= n
            cost[at] += linear * n + quadratic * n * n
            left, start = left - n, start + n
    placed = np.concatenate([full, np.array(out, dtype=np.int64).reshape(-1, 5)])
    placed = placed[np.lexsort((placed[:, 1], placed[:, 0]))]
    return placed, np.concatenate([np.full(len(doc), limit), sizes]), np.concatenate([np.full(len(doc), linear * limit + quadratic * limit * limit), cost])


NEW = [
    T.StructField("start", T.LongType(), False),
    T.StructField("length", T.LongType(), False),
    T.StructField("ids", T.BinaryType(), False),
    T.StructField("doc_tokens", T.LongType(), False),
    T.StructField("sequence_id", T.LongType(), False),
    T.StructField("offset", T.LongType(), False),
    T.StructField("sequence_length", T.LongType(), False),
    T.StructField("sequence_cost", T.DoubleType(), False),
]


def pack(
    docs: DataFrame,
    tokenizer: str,
    text: str = "text",
    carry: list[str] | None = None,
    limit: int = LIMIT,
    chunk: int = CHUNK,
    linear: float = LINEAR,
    quadratic: float = QUADRATIC,
) -> DataFrame:
    """One row for each piece of a document.

    ``tokenizer`` is a path that is the same on every worker. A piece has ``start`` (its document's ids before it),
    ``length``, ``ids`` (little-endian unsigned 32-bit numbers), ``doc_tokens`` (of the whole document with its end),
    ``sequence_id``, ``offset`` (its place there), and the ``sequence_length`` and ``sequence_cost`` of the sequence.
    ``limit`` must be a power of two. A null or empty text is an end alone. Repeated rows are documents of their own. A long
    text has many pieces; nothing is dropped. An empty table gives an empty one. Columns in ``carry`` (None: all) stay with
    each piece, except those named like the new ones, which are replaced.
    """
    if limit < 1 or limit & limit - 1:
        raise ValueError("limit must be a power of two")
    taken = {f.name for f in NEW}
    kept = [c for c in (docs.columns if carry is None else carry) if c.lower() not in taken]
    own = unused_name("text", kept)
    inner = docs.select(*[column(c) for c in kept], column(text).cast("string").alias(own))
    schema = T.StructType([*inner.schema.fields[:-1], *NEW])
    end = np.array([END], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only(release)
        ids_of = coder(tokenizer).of
        first = TaskContext.get().partitionId() * NUMBERS
        held: list[pa.RecordBatch] = []
        ids: list[bytes] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal first
            tokens = np.array([len(x) // 4 for x in ids], dtype=np.int64)
            placed, sizes, costs = assign(tokens, limit, linear, quadratic)
            rows = pa.Table.from_batches(held).select(range(len(kept))).combine_chunks()
            # A few thousand pieces a batch, so that its ids fit an Arrow array.
            for part in np.array_split(placed, max(1, -(-len(placed) // 10_000))):
                doc, start, length, sequence, offset = part.T
                cut = [ids[d][4 * a : 4 * (a + n)] for d, a, n in zip(doc, start, length)]
                carried = [c.take(pa.array(doc)).combine_chunks() for c in rows.columns]
                carried = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in carried]
                numbers = [start, length, cut, tokens[doc], first + sequence, offset, sizes[sequence], costs[sequence]]
                kinds = [pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 4, pa.float64()]
                yield pa.RecordBatch.from_arrays([*carried, *(pa.array(x, k) for x, k in zip(numbers, kinds))], names=schema.names)
            first += len(sizes)

        for batch in pieces(batches, own):
            new = [x + end for x in ids_of(batch.column(own).fill_null("").to_pylist())]
            held.append(batch)
            ids += new
            size += sum(map(len, new)) // 4
            if size >= chunk:
                yield from flush()
                held, ids, size = [], [], 0
        if held:
            yield from flush()

    return inner.mapInArrow(run, schema)


def sequences(packed: DataFrame, key: str = "doc_id") -> DataFrame:
    """``sequence_id``, ``ids`` of the whole sequence, and ``parts`` (document, start and length of each piece, in order).

    At most ``limit`` ids meet in a group.
    """
    part = F.struct("offset", column(key).alias("key"), "start", "length", "ids")
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    ids = F.aggregate(F.col("parts")["ids"], F.lit(b"").cast("binary"), lambda a, b: F.concat(a, b))
    return parts.select("sequence_id", ids.alias("ids"), F.transform("parts", lambda p: F.struct(p["key"].alias("key"), p["start"].alias("start"), p["length"].alias("length"))).alias("parts"))
