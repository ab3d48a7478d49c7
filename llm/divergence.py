"""How the sources of a language differ in their words, priced on K-squared quadtrees of term counts.

1. Terms that may be in ``least`` documents are found by hash (``hash_sets``); only they are counted as text, by language,
   source and term, so that rare words, most of a vocabulary, never reach a shuffle as text.
2. The matrix of a language has a row for each source and a column for each kept term. It is cut into blocks of columns
   (and, with very many sources, pairs of bands of rows), and each block becomes a quadtree: a bitmap for each level says
   which quadrants have counts at all, and the lowest ones, of 8 by 8 cells, hold the counts.
3. A pair of row quadrants walks down its columns together. Where neither has a count, all cells have the share of a count
   of zero; so many columns are priced at once by one multiplication. Where one has, the walk goes on, down to the leaves.
4. The sums of all blocks of columns are added up. Terms that stand out are read off the leaves, ``top`` a block.

Shares have a fixed number of digits, and everything is whole numbers.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from llm.frames import column, shared_folder, stored
from llm.hash_sets import PIECE_BYTES, HashSet, codes, count, frequent, name_hash, shards_for, starts_of_runs
from llm.words import LETTERS, LOWER, Words, mix, pieces, strings, text_buffers

#: Documents of a language that a kept term is in, and terms told for each source.
LEAST, TOP = 10, 10
SCALE = 1_000_000_000
LEAF = 8
#: Columns of a block, and rows of a band.
COLUMNS, BAND = 2048, 512
#: Pairs of leaves that are priced at a time.
STEP = 2048


@dataclass
class QuadTree:
    """``levels[d]`` has four bits for each nonzero quadrant of depth d (upper left, upper right, lower left, lower right);
    the n-th bit set on a level leads to the n-th quadrant of the next. The last one leads to ``leaves``."""

    height: int
    levels: list[np.ndarray]
    leaves: np.ndarray
    places: np.ndarray  # row and column of each leaf, in leaves

    @property
    def root(self) -> int:
        return 0 if len(self.leaves) else -1

    def children(self, nodes: np.ndarray, depth: int, quadrant: int) -> np.ndarray:
        """The quadrants of nodes (-1: all zero)."""
        bits = self.levels[depth]
        if not len(bits):
            return np.full(len(nodes), -1)
        at = 4 * np.maximum(nodes, 0) + quadrant
        return np.where((nodes >= 0) & bits[at], np.cumsum(bits)[at] - 1, -1)


def quadtree(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, height: int) -> QuadTree:
    """A tree over 2**height leaves a side."""
    r, c = rows // LEAF, cols // LEAF
    code = np.zeros(len(r), dtype=np.int64)
    for bit in range(height):
        code |= (r >> bit & 1) << (2 * bit + 1) | (c >> bit & 1) << (2 * bit)
    here, at = np.unique(code, return_inverse=True)
    leaves = np.zeros((len(here), LEAF, LEAF), dtype=np.int64)
    leaves[at, rows % LEAF, cols % LEAF] = values
    places = np.zeros((len(here), 2), dtype=np.int64)
    places[at] = np.stack([r, c], axis=1)
    levels = []
    for _ in range(height):
        above = np.unique(here >> 2)
        bits = np.zeros(4 * len(above), dtype=bool)
        bits[4 * np.searchsorted(above, here >> 2) + (here & 3)] = True
        levels.append(bits)
        here = above
    return QuadTree(height, levels[::-1], leaves, places)


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def pair_sums(a: QuadTree, b: QuadTree, zero_a: np.ndarray, zero_b: np.ndarray, n_cols: int) -> np.ndarray:
    """The divergence of each row of one tree and each of another, summed over all columns.

    Leaves hold shares; a row's share of a count of zero is in ``zero_a`` or ``zero_b``.
    """
    if not len(zero_a) or not len(zero_b) or not n_cols:
        return np.zeros((len(zero_a), len(zero_b)), dtype=np.int64)
    blocks_a, blocks_b = -(-len(zero_a) // LEAF), -(-len(zero_b) // LEAF)
    pad_a, pad_b = np.ones(blocks_a * LEAF, dtype=np.int64), np.ones(blocks_b * LEAF, dtype=np.int64)
    pad_a[: len(zero_a)], pad_b[: len(zero_b)] = zero_a, zero_b
    pad_a, pad_b = pad_a.reshape(-1, LEAF), pad_b.reshape(-1, LEAF)
    out = np.zeros((blocks_a, blocks_b, LEAF, LEAF), dtype=np.int64)
    zeros = np.zeros((blocks_a, blocks_b), dtype=np.int64)  # columns without a count in either
    walk = tuple(np.array([x], dtype=np.int64) for x in (a.root, b.root, 0, 0, 0))
    for depth in range(a.height + 1):
        size = 1 << a.height - depth  # leaves a side
        if depth:
            found = []
            for i in range(2):
                for j in range(2):
                    for k in range(2):
                        part = (a.children(walk[0], depth - 1, 2 * i + k), b.children(walk[1], depth - 1, 2 * j + k), 2 * walk[2] + i, 2 * walk[3] + j, 2 * walk[4] + k)
                        inside = (part[2] * size < blocks_a) & (part[3] * size < blocks_b) & (part[4] * size * LEAF < n_cols)
                        found.append([x[inside] for x in part])
            walk = tuple(np.concatenate(x) for x in zip(*found))
        blank = (walk[0] < 0) & (walk[1] < 0)
        if blank.any():
            width = np.minimum(size * LEAF, n_cols - walk[4][blank] * size * LEAF)
            level = np.zeros((-(-blocks_a // size), -(-blocks_b // size)), dtype=np.int64)
            np.add.at(level, (walk[2][blank], walk[3][blank]), width)
            zeros += np.repeat(np.repeat(level, size, axis=0), size, axis=1)[:blocks_a, :blocks_b]
            walk = tuple(x[~blank] for x in walk)
    empty = np.zeros((1, LEAF, LEAF), dtype=np.int64)
    leaves_a, leaves_b = np.concatenate([a.leaves, empty]), np.concatenate([b.leaves, empty])
    for s in range(0, len(walk[0]), STEP):
        node_a, node_b, row_a, row_b, col = (x[s : s + STEP] for x in walk)
        x, y = leaves_a[node_a], leaves_b[node_b]
        x = np.where(x == 0, pad_a[row_a][:, :, None], x)[:, :, None, :]
        y = np.where(y == 0, pad_b[row_b][:, :, None], y)[:, None, :, :]
        real = col[:, None] * LEAF + np.arange(LEAF) < n_cols
        np.add.at(out, (row_a, row_b), (divergence(x, y) * real[:, None, None, :]).sum(axis=3))
    out += zeros[:, :, None, None] * divergence(pad_a[:, None, :, None], pad_b[None, :, None, :])
    return out.transpose(0, 2, 1, 3).reshape(blocks_a * LEAF, blocks_b * LEAF)[: len(zero_a), : len(zero_b)]


def shares(counts: np.ndarray, total: np.ndarray, terms: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / (total + 2 * terms)), exact for counts of any size."""
    if len(counts) and int(counts.max()) >= 2**63 // SCALE - 2:
        return np.array([1 + SCALE * (int(c) + 2) // (int(t) + 2 * terms) for c, t in zip(counts, np.broadcast_to(total, counts.shape))], dtype=np.int64)
    return 1 + SCALE * (counts + 2) // (total + 2 * terms)


def _keys(batch: pa.RecordBatch) -> tuple[np.ndarray, Words, np.ndarray, np.ndarray]:
    """Lower-case bytes, words, and for each word its row and the hash of its language and text."""
    data, offsets = text_buffers(batch.column("text"))
    found = Words(data, offsets, LETTERS)
    row = np.repeat(np.arange(batch.num_rows), np.diff(found.first))
    lang, names = codes(batch.column("lang"))
    salt = np.array([name_hash(x) for x in names], dtype=np.uint64)
    return LOWER[data], found, row, mix(found.hashes ^ salt[lang[row]]) if len(row) else found.hashes


def _documents_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of terms, and how many of the rows have each."""
    _, _, row, key = _keys(batch)
    order = np.argsort(key, kind="stable")
    key, row = key[order], row[order]
    once = key[starts_of_runs(key, row)]
    at = starts_of_runs(once)
    return once[at], np.diff(np.append(at, len(once)))[:, None]


def term_counts(rows: DataFrame, maybe: HashSet) -> DataFrame:
    """``lang``, ``source``, ``term``, ``n`` (occurrences) and ``docs`` of the terms in a set of hashes."""

    def run(batches):
        for batch in pieces(batches, "text", PIECE_BYTES):
            lower, found, row, key = _keys(batch)
            kept = np.flatnonzero(maybe.contains(key))
            source, names = codes(batch.column("source"))
            order = kept[np.lexsort((source[row[kept]], key[kept]))]  # rows stay in order within a term and source
            own_row, own_key = row[order], key[order]
            own_source = source[own_row]
            at = starts_of_runs(own_key, own_source)
            new_row = np.zeros(len(order), dtype=np.int64)
            new_row[starts_of_runs(own_key, own_source, own_row)] = 1
            docs = np.add.reduceat(new_row, at) if len(at) else at
            first = order[at]
            langs = batch.column("lang").take(pa.array(row[first]))
            yield pa.RecordBatch.from_arrays(
                [
                    langs,
                    pa.array(names, pa.string()).take(pa.array(own_source[at])),
                    strings(lower, found.starts[first], found.ends[first]),
                    pa.array(np.diff(np.append(at, len(order)))),
                    pa.array(docs.astype(np.int64)),
                ],
                names=["lang", "source", "term", "n", "docs"],
            )

    parts = rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _block(cells: pa.Table, groups: pa.Table, top: int) -> pa.Table:
    """Sums of all pairs of sources over the terms of a block, and the terms that stand out in each source."""
    lang, a, b = (groups.column(c)[0].as_py() for c in ("lang", "a", "b"))
    terms_of_lang, total_of_lang = groups.column("terms")[0].as_py(), groups.column("lang_total")[0].as_py()
    names = groups.column("source").to_pylist()
    place = {s: i for i, s in enumerate(names)}
    totals, bands = groups.column("total").to_numpy(), groups.column("band").to_numpy()
    coded = cells.column("term").combine_chunks().dictionary_encode() if cells.num_rows else None
    vocabulary = [t.encode() for t in coded.dictionary.to_pylist()] if cells.num_rows else []
    by_bytes = sorted(range(len(vocabulary)), key=vocabulary.__getitem__)
    rank = np.empty(len(vocabulary), dtype=np.int64)
    rank[by_bytes] = np.arange(len(vocabulary))
    col = rank[coded.indices.to_numpy()] if cells.num_rows else np.zeros(0, dtype=np.int64)
    row = np.array([place[s] for s in cells.column("source").to_pylist()], dtype=np.int64)
    n = cells.column("n").to_numpy()
    share = shares(n, totals[row], terms_of_lang) if len(n) else n
    sides = []
    for band in dict.fromkeys((a, b)):
        own = np.flatnonzero(bands == band)
        local = np.full(len(names), -1)
        local[own] = np.arange(len(own))
        inside = local[row] >= 0
        height = max(-(-len(own) // LEAF) - 1, -(-max(len(vocabulary), 1) // LEAF) - 1, 0).bit_length()
        sides.append((own, local[row[inside]], col[inside], share[inside], height))
    height = max(s[4] for s in sides)
    trees = [quadtree(r, c, v, height) for _, r, c, v, _ in sides]
    zero = [shares(np.zeros(len(s[0]), dtype=np.int64), totals[s[0]], terms_of_lang) if terms_of_lang else np.ones(len(s[0]), dtype=np.int64) for s in sides]
    sums = pair_sums(trees[0], trees[-1], zero[0], zero[-1], len(vocabulary))
    # Terms that only sources of other bands have are one more quadrant of zeros.
    elsewhere = groups.column("block_terms")[0].as_py() - len(vocabulary)
    sums += elsewhere * divergence(zero[0][:, None], zero[-1][None, :])
    i, j = (x.ravel() for x in np.meshgrid(sides[0][0], sides[-1][0], indexing="ij"))
    value = sums.ravel()
    if a == b:
        i, j, value = i[i != j], j[i != j], value[i != j]
    else:
        i, j, value = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([value, value])
    source, item, part = [names[x] for x in i], [names[x] for x in j], ["pair"] * len(i)
    if a == b and len(vocabulary):
        q_of = np.zeros(len(vocabulary), dtype=np.int64)
        q_of[col] = cells.column("lang_n").to_numpy()
        q_of = shares(q_of, np.int64(total_of_lang), terms_of_lang)
        leaf, r, c = np.nonzero(trees[0].leaves)
        p = trees[0].leaves[leaf, r, c]
        r, c = trees[0].places[leaf, 0] * LEAF + r, trees[0].places[leaf, 1] * LEAF + c
        more = p > q_of[c]
        r, c, f = r[more], c[more], divergence(p[more], q_of[c[more]])
        order = np.lexsort((c, -f, r))
        r, c, f = r[order], c[order], f[order]
        new = starts_of_runs(r)
        best = np.arange(len(r)) - np.repeat(new, np.diff(np.append(new, len(r)))) < top
        source += [names[sides[0][0][x]] for x in r[best]]
        item += [vocabulary[by_bytes[x]].decode() for x in c[best]]
        value = np.concatenate([value, f[best]])
        part += ["term"] * int(best.sum())
    return pa.table({"lang": pa.array([lang] * len(part), pa.string()), "source": pa.array(source, pa.string()), "part": pa.array(part, pa.string()), "item": pa.array(item, pa.string()), "value": pa.array(value.astype(np.int64))})


def audit(
    docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST, top: int = TOP, columns: int = COLUMNS, band: int = BAND
) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value`` and ``rank`` of every language and source of ``docs``.

    Part ``pair``: every other source of the language, with the divergence of their words. Part ``term``: the ``top`` terms
    that are more frequent in the source than in the language. Nulls in the three columns are read as empty; a source
    without terms has its pairs, with its shares of zero; a language without kept terms has pairs of value 0, one with a
    single source no pairs. Repeated rows are documents of their own. Equal values are ranked by the item's bytes. Other
    columns are ignored. An empty table gives an empty table.
    """
    rows = docs.select(*[F.coalesce(column(c).cast("string"), F.lit("")).alias(n) for c, n in ((text, "text"), (lang, "lang"), (source, "source"))])
    shards, folder = shards_for(rows), shared_folder(docs.sparkSession)
    maybe, _ = frequent(count(rows, _documents_of, 1, shards), least, folder, "term", shards, [])
    counts = stored(term_counts(rows, maybe))
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least).drop("docs")
    cells = stored(counts.drop("docs").join(kept, ["lang", "term"]))
    of_lang = cells.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count_distinct("term").alias("terms"))
    of_source = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = rows.select("lang", "source").distinct().join(of_source, ["lang", "source"], "left").join(of_lang, "lang", "left")
    groups = stored(groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "lang_total", "terms")]))
    most = groups.groupBy("lang").agg(F.max("terms").alias("terms"), F.count("*").alias("sources")).agg(F.max("terms"), F.max("sources")).first()
    blocks, bands = max(1, -(-(most[0] or 0) // columns)), max(1, -(-(most[1] or 0) // band))
    own = F.pmod(F.xxhash64("source"), F.lit(bands)).cast("int")
    others = F.explode(F.sequence(F.lit(0), F.lit(bands - 1)))

    def placed(df: DataFrame, block) -> DataFrame:
        """Rows of a band are needed with every other band."""
        df = df.withColumn("block", block).withColumn("band", own).withColumn("other", others)
        return df.withColumns({"a": F.least("band", "other"), "b": F.greatest("band", "other")}).drop("other")

    block = F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int")
    of_block = cells.select("lang", "term").distinct().groupBy("lang", block.alias("block")).agg(F.count("*").alias("block_terms"))
    left = placed(cells, block).groupBy("lang", "block", "a", "b")
    right = placed(groups, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(of_block, ["lang", "block"], "left")
    right = right.withColumn("block_terms", F.coalesce("block_terms", F.lit(0))).groupBy("lang", "block", "a", "b")

    def price(cells: pa.Table, groups: pa.Table) -> pa.Table:
        return _block(cells, groups, top)

    found = left.cogroup(right).applyInArrow(price, "lang string, source string, part string, item string, value long")
    sums = found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = sums.withColumn("rank", F.row_number().over(order))
    return ranked.filter((F.col("part") == "pair") | (F.col("rank") <= top))
