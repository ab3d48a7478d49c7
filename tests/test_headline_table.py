"""Batches merged into a table against one dedup of all rows."""

import random

import pytest

from newsfold.operators.rows import dedup_by
from newsfold.plans import headline_table

SCHEMA = "article_url string, article_title string, crawled int"


def batches(seed):
    rng = random.Random(seed)
    urls = [None, "", *[f"u{i}" for i in range(30)]]
    return [[(rng.choice(urls), rng.choice([None, "", "a", "b"]), rng.choice([None, 1, 2, 3])) for _ in range(n)] for n in (40, 1, 0, 25, 60)]


@pytest.mark.parametrize("limit", [200_000, 0])
def test_merges_equal_one_dedup(spark, tmp_path, monkeypatch, limit):
    monkeypatch.setattr("newsfold.session.BROADCAST_ROWS", limit)
    path = str(tmp_path / "t")
    made = batches(limit)
    frames = [spark.createDataFrame(b, SCHEMA) for b in made]
    headline_table.create(spark, path, frames[0].schema, "article_url", ["crawled"], buckets=8)
    assert headline_table.read(spark, path).count() == 0
    seen = []
    for rows, frame in zip(made, frames):
        headline_table.merge(frame, path)
        seen += rows
        expected = dedup_by(spark.createDataFrame(seen, SCHEMA), "article_url", ["crawled"])
        assert set(headline_table.read(spark, path).collect()) == set(expected.collect())
    assert headline_table.read(spark, path).count() == expected.count()
    headline_table.merge(frames[0], path)  # again
    assert sorted(map(str, headline_table.read(spark, path).collect())) == sorted(map(str, expected.collect()))


def test_only_touched_buckets_and_whole_merges_count(spark, tmp_path):
    path = str(tmp_path / "t")
    frame = spark.createDataFrame([(f"u{i}", "t", i) for i in range(200)], SCHEMA)
    headline_table.create(spark, path, frame.schema, "article_url", ["crawled"], buckets=16)
    assert headline_table.merge(frame, path) == list(range(16))
    one = spark.createDataFrame([("u7", "new", 0)], SCHEMA)
    assert len(headline_table.merge(one, path)) == 1
    before = headline_table.read(spark, path).collect()
    assert {r.article_title for r in before if r.article_url == "u7"} == {"new"} and len(before) == 200
    # A merge that ended before its manifest.
    spark.createDataFrame([("lost", "x", 1, 3)], f"{SCHEMA}, bucket int").write.partitionBy("bucket").parquet(f"{path}/rows/killed")
    assert headline_table.read(spark, path).collect() == before
    with pytest.raises(Exception, match="(?i)already exists"):
        headline_table.create(spark, path, frame.schema, "article_url", ["crawled"])


def test_old_rows_are_not_shuffled(spark, tmp_path):
    spark.range(100).selectExpr("cast(id as string) article_url", "'t' article_title", "1 crawled").write.parquet(str(tmp_path / "old"))
    old = spark.read.parquet(str(tmp_path / "old"))
    plan = headline_table.merged(old, old.limit(3), "article_url", ["crawled"])._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "BroadcastHashJoin" in plan
