"""Exact top-k search by inner product: columnar branch and bound.

Queries and candidates are dealt into blocks of bounded size, and each pair of blocks is searched in one task. A block
of candidates lies in vertical layout: one row for each dimension, those with most mass first. Scores grow by a few
dimensions at a time. What the other dimensions can still add is at most the product of the remaining masses of query and
candidate (Cauchy-Schwarz); candidates that can't reach the k-th best lower bound any more are compacted away.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from llm.frames import column

K = 20
#: Vectors in a block of queries and in one of candidates.
QUERIES, CANDIDATES = 2048, 8192
#: Dimensions added at a time.
STEP = 16
#: Queries whose first dimensions are multiplied at once.
TOGETHER = 64
#: Sums of products up to here are exact in a double.
EXACT = 2**53
LONG = 2**63


def quantised(vector: Column, scale: float = 64.0) -> Column:
    """floor(scale * x) of each component, as doubles; null for a vector that is null or holds a null or non-finite one."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    product = F.transform(vector, lambda x: x.cast("double") * scale)
    # Doubles from 2**53 on are whole numbers; floor() would make longs of them.
    return F.when(~bad, F.transform(product, lambda x: F.when(F.abs(x) >= EXACT, x).otherwise(F.floor(x).cast("double"))))


def block_top(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query id, id and score of each query's k best of a block. ``ids`` ascend; rows with the query's id don't count."""
    none = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    if not len(queries) or not len(vectors):
        return none
    mass = np.einsum("ij,ij->j", vectors, vectors)
    order = np.argsort(-mass, kind="stable")
    queries, vertical = queries[:, order], np.ascontiguousarray(vectors[:, order].T)
    dims = len(order)
    cuts = [*range(0, dims, STEP), dims]
    rest_v = [np.sqrt(np.einsum("ij,ij->j", vertical[c:], vertical[c:])) for c in cuts[1:]]
    rest_q = [np.sqrt(np.einsum("ij,ij->i", queries[:, c:], queries[:, c:])) for c in cuts[1:]]
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    own = np.searchsorted(ids, query_ids)
    for low in range(0, len(queries), TOGETHER):
        first = queries[low : low + TOGETHER, : cuts[1]] @ vertical[: cuts[1]]
        for i, partial in enumerate(first, low):
            alive = np.arange(len(ids))
            if own[i] < len(ids) and ids[own[i]] == query_ids[i]:
                alive = np.delete(alive, own[i])
                partial = np.delete(partial, own[i])
            for b in range(len(cuts) - 1):
                if b:
                    partial = partial + queries[i, cuts[b] : cuts[b + 1]] @ vertical[cuts[b] : cuts[b + 1], alive]
                if len(alive) > k:
                    # A little more than the bound itself, for rounding; partial scores are exact.
                    more = rest_q[b][i] * rest_v[b][alive] * (1 + 1e-9)
                    threshold = np.partition(partial - more, len(alive) - k)[len(alive) - k]
                    fit = partial + more >= threshold
                    alive, partial = alive[fit], partial[fit]
            best = np.lexsort((ids[alive], -partial))[:k]
            out.append((np.full(len(best), query_ids[i]), ids[alive[best]], partial[best].astype(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out))


def _plain_top(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The same in whole numbers of any size, for components too large for doubles; scores beyond a long saturate."""
    big = [list(map(int, v)) for v in vectors]
    out = []
    for q, name in zip(queries, query_ids):
        mine = list(map(int, q))
        found = [(-min(max(sum(a * b for a, b in zip(mine, v)), -LONG), LONG - 1), int(i)) for v, i in zip(big, ids) if i != name]
        out += [(name, i, -s) for s, i in sorted(found)[:k]]
    return tuple(np.array(x, dtype=np.int64) for x in zip(*out)) if out else tuple(np.zeros(0, dtype=np.int64) for _ in range(3))


def _matrix(lists: pa.ChunkedArray, width: int) -> np.ndarray:
    out = np.zeros((len(lists), width))
    row = 0
    for chunk in lists.chunks:
        sizes = np.diff(chunk.offsets.to_numpy())
        values = chunk.flatten().to_numpy()
        place = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        out[np.repeat(np.arange(len(chunk)), sizes) + row, place] = values
        row += len(chunk)
    return out


def _numbers(n: int) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))


def search(vectors: DataFrame, queries: Column, key: str = "vec_id", vector: str = "embedding", scale: float = 64.0, k: int = K) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: the ``k`` best of all other vectors for each query.

    ``queries`` tells which rows are queries. Components are quantised to floor(``scale`` * x); the score is the integer
    inner product. Ties go to the smaller id; fewer candidates than ``k`` give fewer rows. Rows with a null id, and
    vectors that are null or hold null or non-finite components, take no part. Rows that share an id count once, with the
    smallest of their vectors. Missing components of a shorter vector are 0. Scores beyond a long saturate. Other columns
    are ignored; an empty table gives an empty table.
    """
    named = vectors.select(column(key).cast("long").alias("id"), queries.alias("is_query"), quantised(column(vector), scale).alias("v"))
    one = named.filter("id is not null and v is not null").groupBy("id").agg(F.min("v").alias("v"), F.max("is_query").alias("is_query"))
    n, n_queries = one.agg(F.count("*"), F.count_if("is_query")).first()
    blocks, query_blocks = -(-n // CANDIDATES) or 1, -(-n_queries // QUERIES) or 1
    hashed = F.xxhash64("id")
    candidates = one.select("id", "v", F.lit(False).alias("asks"), F.pmod(hashed, F.lit(blocks)).alias("c"), F.explode(_numbers(query_blocks)).alias("q"))
    asking = one.filter("is_query").select("id", "v", F.lit(True).alias("asks"), F.explode(_numbers(blocks)).alias("c"), F.pmod(hashed, F.lit(query_blocks)).alias("q"))

    def pair(table: pa.Table) -> pa.Table:
        width = max([0, *(int(np.diff(c.offsets.to_numpy()).max(initial=0)) for c in table.column("v").chunks)])
        every, ids = _matrix(table.column("v"), width), table.column("id").to_numpy()
        asks = table.column("asks").to_numpy().astype(bool)
        order = np.argsort(ids[~asks])
        largest = float(np.abs(every).max(initial=0.0))
        top = block_top if largest * largest * max(width, 1) < EXACT else _plain_top
        found = top(every[asks], ids[asks], every[~asks][order], ids[~asks][order], k)
        return pa.table({n: pa.array(x, pa.int64()) for n, x in zip(("query_id", "vec_id", "score"), found)})

    found = candidates.unionByName(asking).groupBy("q", "c").applyInArrow(pair, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
