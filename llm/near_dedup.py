"""MinHash near-duplicates with sequential Bayesian verification.

1. Each document becomes a set of five-word shingles, hashed to 64 bits, with a MinHash signature and a hash for each band
   of the signature. Documents with equal word sequences have equal digests and are one document from here on.
2. Documents that share a band are candidates. What candidates connect is a cluster. Clusters are dealt into chunks with the
   sets of their documents and a longer signature of bytes. In a cluster of very many documents, each bucket (documents of
   one band) is dealt alone.
3. A chunk compares its candidates, as far as they are not connected yet. A pair's bytes are compared a batch at a time.
   After each batch, the posterior of the similarity given the matches so far (uniform prior) tells how likely the pair is
   similar enough; below the miss probability it is dropped. Survivors are compared on their full sets at once. Only links
   that connect something new leave the chunk, less than it has documents.
4. A cluster larger than a chunk has pivots, from its smallest components, that each chunk compares with its documents.
   Rounds take more pivots each, until all documents outside the largest component were pivots: then every pair has been
   compared or is connected anyway. So a cluster of near copies costs about one pair a document.
5. Links join components; a component is named by its smallest document.

A pair of similarity 0.75 shares no band with a chance of 3e-7, less at higher similarity.
"""

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from llm.frames import column, keep_only, semi_join, stored
from llm.words import NOT_SPACE, Words, mix, pieces, text_buffers

SHINGLE = 5
PERCENT = 75
BANDS, ROWS = 40, 4
#: Bytes of the signature that is verified, and how many are compared at a time.
SIGNATURE, BATCH = 512, 32
MISS = 1e-6
#: Documents of a chunk, and shingles of its documents.
CHUNK, SHINGLES = 4096, 1 << 20
#: Clusters of more documents are dealt bucket by bucket.
LARGE = 1 << 18
#: Pivots of a cluster in the first round; each round has GROWTH times as many as the one before.
PIVOTS, GROWTH = 64, 8

_numbers = np.random.Generator(np.random.PCG64(20)).integers(0, 2**64, size=(2, BANDS * ROWS + SIGNATURE), dtype=np.uint64)
_FLIP, _FACTOR = _numbers[0], _numbers[1] | np.uint64(1)


def shingles(found: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, repeated ones too, and where those of each text begin.

    A text with fewer words has its whole sequence as its one shingle; one without words has none.
    """
    n_words = np.diff(found.first)
    counts = np.where(n_words >= size, n_words - size + 1, (n_words > 0).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(counts)])
    start = np.repeat(found.first[:-1], counts) + np.arange(first[-1]) - np.repeat(first[:-1], counts)
    length = np.repeat(np.minimum(n_words, size), counts)
    hashes = length.astype(np.uint64)
    last = max(0, len(found.hashes) - 1)
    for k in range(size):
        word = found.hashes[np.minimum(start + k, last)] if len(start) else found.hashes[:0]
        hashes = np.where(length > k, mix(hashes ^ word) * np.uint64(0x9E3779B97F4A7C15), hashes)
    return hashes, first


def signatures(hashes: np.ndarray, first: np.ndarray, numbers: range = range(BANDS * ROWS)) -> np.ndarray:
    """MinHash numbers of each set, one row per text; texts without shingles have zeros."""
    out = np.zeros((len(first) - 1, len(numbers)), dtype=np.uint32)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        at, buffer = first[some], np.empty_like(hashes)
        for k, i in enumerate(numbers):
            np.bitwise_xor(hashes, _FLIP[i], out=buffer)
            np.multiply(buffer, _FACTOR[i], out=buffer)
            out[some, k] = np.minimum.reduceat(buffer, at) >> np.uint64(32)
    return out


def bands(signature: np.ndarray) -> np.ndarray:
    out = np.zeros((len(signature), BANDS), dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + signature[:, k::ROWS].astype(np.uint64))
    return out.astype(np.int64)


def sketches(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id``, ``n_shingles``, ``node`` (a hash of the word sequence; null: no words), and ``bands``."""
    schema = T.StructType(
        [
            T.StructField("doc_id", T.LongType()),
            T.StructField("n_shingles", T.LongType()),
            T.StructField("node", T.LongType()),
            T.StructField("bands", T.ArrayType(T.LongType(), False)),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only(None)
        for batch in pieces(batches, "text"):
            found = _words(batch.column("text"))
            hashes, first = shingles(found)
            signature = signatures(hashes, first)
            keys = bands(signature)
            sizes = []
            for i in range(batch.num_rows):
                own = np.sort(hashes[first[i] : first[i + 1]])
                sizes.append(int(np.count_nonzero(own[1:] != own[:-1])) + 1 if len(own) else 0)
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(0, BANDS * len(sizes) + 1, BANDS, dtype=np.int32)), pa.array(keys.ravel()), type=pa.list_(pa.field("element", pa.int64(), nullable=False))
            )
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), nodes(found), lists], names=schema.names)

    return docs.select(column(key).cast("long").alias("doc_id"), column(text).cast("string").alias("text")).mapInArrow(run, schema)


def _words(text: pa.Array) -> Words:
    return Words(*text_buffers(text), NOT_SPACE)


def nodes(found: Words) -> pa.Array:
    """A number for the word sequence of each text; null without words."""
    out = []
    for i in range(len(found.first) - 1):
        words = found.hashes[found.first[i] : found.first[i + 1]]
        out.append(int.from_bytes(hashlib.md5(words.tobytes()).digest()[:8], "little", signed=True) if len(words) else None)
    return pa.array(out, pa.int64())


def least_matches(percent: int = PERCENT, miss: float = MISS) -> list[int]:
    """For each number of batches compared: with fewer matches, a pair is similar enough with a chance below ``miss``.

    Bytes of different minima are equal once in 256.
    """
    s = (np.arange(20_000) + 0.5) / 20_000
    similar, p = s >= percent / 100, s + (1 - s) / 256
    out = []
    for n in range(BATCH, SIGNATURE + 1, BATCH):
        low, high = 0, n
        while low < high:  # the chance grows with the matches
            m = (low + high) // 2
            log = m * np.log(p) + (n - m) * np.log1p(-p)
            weight = np.exp(log - log.max())
            low, high = (low, m) if weight[similar].sum() >= miss * weight.sum() else (m + 1, high)
        out.append(low)
    return out


def likely(a: np.ndarray, b: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray, least: list[int], percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Rows of two signature tables that neither the sizes of the sets nor a batch rules out, and their equal bytes.

    ``a`` may have one row.
    """
    rows = np.flatnonzero(100 * np.minimum(sizes_a, sizes_b) >= percent * np.maximum(sizes_a, sizes_b))
    matches = np.zeros(len(b), dtype=np.int64)
    for i, most in enumerate(least):
        cut = slice(i * BATCH, (i + 1) * BATCH)
        left = a[:, cut] if len(a) == 1 else a[rows, cut]
        matches[rows] += (left == b[rows, cut]).sum(axis=1)
        rows = rows[matches[rows] >= most]
    return rows, matches[rows]


def _signed(texts: DataFrame) -> DataFrame:
    """``node``, ``n`` (shingles), ``signature`` and ``shingles`` (the sorted set, 8 bytes each) of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            hashes, first = shingles(_words(batch.column("text")))
            sets = _sets(hashes, first)
            numbers = signatures(hashes, first, range(BANDS * ROWS, BANDS * ROWS + SIGNATURE)).astype(np.uint8)
            columns = [batch.column("node"), pa.array([len(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in numbers], pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "n", "signature", "shingles"])

    return texts.mapInArrow(run, "node long, n long, signature binary, shingles binary")


def _sets(hashes: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingles of each text."""
    out = []
    for i in range(len(first) - 1):
        own = np.sort(hashes[first[i] : first[i + 1]])
        out.append(own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own)
    return out


class Chunk:
    """Some members of a part, and the pivots that they are compared with."""

    def __init__(self, table: pa.Table):
        self.node, self.n, self.at = (table.column(c).to_numpy() for c in ("node", "n", "at"))
        self.pivot = table.column("pivot").to_numpy().astype(bool)
        self.component = np.unique(table.column("component").to_numpy(), return_inverse=True)[1]
        self.bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
        self.signature = text_buffers(table.column("signature").combine_chunks())[0].reshape(-1, SIGNATURE)
        data, offsets = text_buffers(table.column("shingles").combine_chunks())
        self.first = offsets // 8
        # Numbers of shingles within the chunk, so that a set is a mark at each of its numbers.
        self.shingle = np.unique(np.frombuffer(data.tobytes(), dtype=np.uint64), return_inverse=True)[1]
        self.marked = np.zeros(int(self.shingle.max(initial=-1)) + 1, dtype=bool)

    def common(self, p: int, others: np.ndarray) -> np.ndarray:
        """How many shingles each of the others shares with p."""
        own = self.shingle[self.first[p] : self.first[p + 1]]
        self.marked[own] = True
        size = self.first[others + 1] - self.first[others]
        begin = np.cumsum(size) - size
        theirs = self.shingle[np.arange(size.sum()) + np.repeat(self.first[others] - begin, size)]
        out = np.add.reduceat(self.marked[theirs].astype(np.int64), begin) if len(others) else begin
        self.marked[own] = False
        return out

    def forest(self, least: list[int], percent: int) -> Iterator[tuple[int, int]]:
        """Confirmed links that connect what the chunk connects, at most one less than its components.

        A chunk without pivots of its own compares all its members with each other.
        """
        whole = not self.pivot.any()
        for p in range(len(self.node)) if whole else np.flatnonzero(self.pivot):
            other = self.component != self.component[p]
            if whole:
                other[: p + 1] = False
            else:
                other &= ~self.pivot
            other = np.flatnonzero(other)
            shared = self.bands[other] == self.bands[p]
            at = int(self.at[p])
            # In a part that is one band, a pair that shares an earlier band is met there.
            other = other[shared.any(axis=1) if at < 0 else ~shared[:, :at].any(axis=1)]
            if not len(other):
                continue
            rows, _ = likely(self.signature[p : p + 1], self.signature[other], self.n[p : p + 1], self.n[other], least, percent)
            other = other[rows]
            common = self.common(p, other)
            linked = other[100 * common >= percent * (self.n[p] + self.n[other] - common)]
            _, one = np.unique(self.component[linked], return_index=True)
            for q in linked[one]:
                yield int(self.node[p]), int(self.node[q])
            self.component[np.isin(self.component, self.component[linked[one]])] = self.component[p]


def _links(rows: DataFrame, percent: int, miss: float) -> DataFrame:
    """Pairs (a, b) of nodes: confirmed links that connect all that is linked within a chunk."""
    least = least_matches(percent, miss)

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by([("part", "ascending"), ("node", "ascending")])
        part = table.column("part").to_numpy()
        cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
        pairs = [pair for a, b in zip(cuts, cuts[1:]) for pair in Chunk(table.slice(a, b - a)).forest(least, percent)]
        return pa.table({"a": pa.array([x for x, _ in pairs], pa.int64()), "b": pa.array([x for _, x in pairs], pa.int64())})

    return rows.groupBy("task").applyInArrow(compare, "a long, b long")


def _texts(docs: DataFrame, first: DataFrame, wanted: DataFrame) -> DataFrame:
    """``node`` and ``text`` of the wanted nodes. ``docs``: doc_id and text; ``first``: node and rep, a doc_id that has it."""
    ids = stored(first.join(wanted, "node", "left_semi").select(F.col("rep").alias("doc_id")).distinct())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            yield pa.RecordBatch.from_arrays([nodes(_words(batch.column("text"))), batch.column("text")], names=["node", "text"])

    found = semi_join(docs, ids, "doc_id").select("text").mapInArrow(run, "node long, text string")
    return found.join(wanted, "node", "left_semi").dropDuplicates(["node"])


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest node) for the nodes of ``edges`` (a, b), by alternating large and small stars."""
    now = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        print_of = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if print_of == before or print_of[0] == 0:
            break
        before = print_of
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = stored(small.select("e.*").filter("u <> v").distinct())
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())


def _buckets(own: DataFrame) -> DataFrame:
    """``at``, ``band``, ``node`` and ``low`` (the smallest node there) of the buckets with two nodes or more."""
    every = own.select(F.posexplode("bands").alias("at", "band"), "node")
    shared = every.groupBy("at", "band").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high").drop("high")
    return stored(every.join(shared, ["at", "band"]))


def _label(own: DataFrame, docs: DataFrame, first: DataFrame, percent: int, miss: float, pivots: int, growth: int) -> DataFrame:
    """``node`` and ``component`` of all nodes that share a band with another."""
    buckets = _buckets(own)
    # Candidates, and what they are candidates with, form clusters. A cluster is a part of the work; in one of very many
    # nodes, each bucket is.
    cluster = components(buckets.filter("low < node").select(F.col("low").alias("a"), F.col("node").alias("b")).distinct())
    signed = stored(_signed(_texts(docs, first, cluster.select("node"))).join(own, "node").dropDuplicates(["node"]))
    sizes = cluster.groupBy("component").agg(F.count("*").alias("nodes"))
    placed = cluster.join(sizes, "component").select("node", F.col("component").alias("cluster"), "nodes")
    small = placed.filter(F.col("nodes") <= LARGE).select("node", F.xxhash64("cluster").alias("part"), F.lit(-1).alias("at"))
    large = buckets.join(placed.filter(F.col("nodes") > LARGE).select("node"), "node").select("node", F.xxhash64("at", "band").alias("part"), "at")
    members = stored(small.union(large).join(signed.select("node", "n"), "node"))
    labels = stored(cluster.select("node", F.col("node").alias("component")))
    links = None
    while not members.isEmpty():
        rows = members.join(labels, "node")
        by_component = rows.groupBy("part", "component").agg(F.count("*").alias("size"), F.sum("n").alias("n"))
        spread = by_component.groupBy("part").agg(F.sum("size").alias("total"), F.max("size").alias("largest"), F.sum("n").alias("shingles"))
        chunks = F.greatest(F.ceil(F.col("total") / CHUNK), F.ceil(F.col("shingles") / SHINGLES)).cast("int")
        spread = stored(spread.filter("largest < total").withColumn("chunks", chunks))
        if spread.isEmpty():
            break
        rows = stored(rows.join(by_component.select("part", "component", "size"), ["part", "component"]).join(spread, "part"))
        tasks = max(1, math.ceil((rows.filter("chunks = 1").agg(F.sum("n")).first()[0] or 0) / SHINGLES))
        # Members of a part that fits one chunk are compared with each other. Larger parts have pivots, from their smallest
        # components; once all nodes outside the largest were pivots, the part is done.
        one = rows.filter("chunks = 1").withColumns({"task": F.pmod(F.xxhash64("part"), F.lit(tasks)), "pivot": F.lit(False)})
        many = rows.filter("chunks > 1")
        dealt = many.withColumns({"task": F.xxhash64("part", F.pmod(F.xxhash64("node"), F.col("chunks"))), "pivot": F.lit(False)})
        rank = F.row_number().over(Window.partitionBy("part").orderBy("size", "component", "node"))
        chosen = many.withColumn("rank", rank).filter(F.col("rank") <= pivots).drop("rank").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        chosen = chosen.withColumns({"task": F.xxhash64("part", F.col("chunk").cast("long")), "pivot": F.lit(True)})
        columns = ["task", "part", "at", "node", "component", "pivot"]
        work = one.select(*columns).union(dealt.select(*columns)).union(chosen.select(*columns)).join(signed, "node")
        found = stored(_links(work, percent, miss))
        links = found if links is None else links.union(found)
        joined = components(links)
        labels = stored(cluster.select("node").join(joined, "node", "left").select("node", F.coalesce("component", "node").alias("component")))
        members = stored(many.filter(F.col("total") - F.col("largest") > pivots).select("node", "part", "at", "n"))
        pivots *= growth
    return labels


def near_duplicates(
    docs: DataFrame, text: str = "text", key: str = "doc_id", percent: int = PERCENT, miss: float = MISS, pivots: int = PIVOTS, growth: int = GROWTH
) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` of every row.

    Two documents are linked if their sets of distinct five-word shingles have a similarity of ``percent`` or more; a
    component is what links connect, named by its smallest ``doc_id``. ``kept``: the document names its component.
    A text without words (null, empty, blanks) is linked with nothing. A row with a null ``doc_id`` takes no part: its
    component is null and it is kept. Rows with the same ``doc_id`` are documents of their own, compared by their words.
    Other columns are ignored. An empty table gives an empty table. ``key`` must be an integer.
    """
    table = stored(sketches(docs, text, key))
    part = table.filter("doc_id is not null and node is not null")
    # One row for each word sequence goes on.
    first = stored(part.groupBy("node").agg(F.min("doc_id").alias("rep")))
    own = part.join(first.select(F.col("node"), F.col("rep").alias("doc_id")), ["node", "doc_id"]).select("node", "bands")
    texts = docs.select(column(key).cast("long").alias("doc_id"), column(text).cast("string").alias("text"))
    labels = _label(own, texts, first, percent, miss, pivots, growth)
    names = labels.join(first, "node").groupBy("component").agg(F.min("rep").alias("component_id"))
    ids = first.join(labels, "node", "left").join(names, "component", "left").select("node", F.coalesce("component_id", "rep").alias("component_id"))
    named = table.select("doc_id", "n_shingles", "node").join(ids, "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return named.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
