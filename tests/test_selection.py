"""Radix selection: equal to a sort for any keys, and never more counters in a window than digits allow."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from newsfold.operators import hash_order
from newsfold.operators.hash_order import hash_order as order_of
from newsfold.operators.hash_order import mark_smallest


def window_sizes(monkeypatch):
    """The rows that each window of a selection sorts."""
    sizes = []
    located = hash_order._locate

    def spied(level, fields, wanted):
        names = [f.name for f in fields]
        sizes.extend(r["n"] for r in level.groupBy(*names, "parent").agg(F.count("*").alias("n")).collect())
        return located(level, fields, wanted)

    monkeypatch.setattr(hash_order, "_locate", spied)
    return sizes


@pytest.mark.parametrize("step", [1, 2, 4])
def test_equals_a_sort(spark, monkeypatch, step):
    monkeypatch.setattr(hash_order, "STEP", step)
    sizes = window_sizes(monkeypatch)
    rng = random.Random(step)
    rows = [(rng.choice(["x", "y", None]), f"k{rng.randrange(150)}", i) for i in range(400)]
    df = spark.createDataFrame(rows, "label string, key string, n int").repartition(5)
    quotas = {(g,): [rng.randrange(60), rng.randrange(60)] for g in ("x", "y", None)}
    marked = mark_smallest(df, ["label"], quotas, order_of(7, "key"), "part").collect()
    digest = {r["n"]: r["d"] for r in df.select("n", hash_order.row_digest(df).alias("d")).collect()}
    for (group,), (a, b) in quotas.items():
        own = sorted((hashlib.md5(f"7:{k}".encode()).hexdigest() + digest[n], n) for g, k, n in rows if g == group)
        expected = {n: 0 if i < a else 1 if i < a + b else 2 for i, (_, n) in enumerate(own)}
        assert {r["n"]: r["part"] for r in marked if r["label"] == group} == expected
    assert max(sizes) <= 16**step


def test_a_null_key_over_many_rows(spark, monkeypatch):
    """All rows have one key hash: the limit lies in the rows' own digits, which are counted a few at a time, too."""
    monkeypatch.setattr(hash_order, "STEP", 2)
    sizes = window_sizes(monkeypatch)
    df = spark.range(20_000).select(F.lit(None).cast("string").alias("key"), "id")
    marked = mark_smallest(df, [], {(): [777, 5000]}, order_of(1, "key"), "part")
    assert Counter(r["part"] for r in marked.select("part").collect()) == {0: 777, 1: 5000, 2: 14223}
    assert max(sizes) <= 256 and len(sizes) <= 16


def test_copies_and_odd_quotas(spark):
    df = spark.range(1000).select(F.lit("k").alias("key"), (F.col("id") % 2).alias("v"))
    for quota in ([0, 0], [300, 300], [1000, 5], [2000, 1], [500, 500]):
        found = Counter(r["part"] for r in mark_smallest(df, [], {(): quota}, order_of(1, "key"), "part").collect())
        a, b = min(quota[0], 1000), min(quota[1], 1000 - min(quota[0], 1000))
        assert found == Counter({0: a, 1: b, 2: 1000 - a - b})
    assert mark_smallest(df.limit(0), [], {(): [3]}, order_of(1, "key"), "part").count() == 0
