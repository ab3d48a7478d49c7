"""Suffix tables, and crawl batches that are written again."""

import pytest
from pyspark.sql import functions as F

from newsfold import schemas, session
from newsfold.operators import crawl, domains
from newsfold.sources import readers, writers

RULES = ["com", "co.uk", "uk", "*.ck", "!www.ck", "ck", None, "COM"]
CASES = [
    ("https://a.b.example.com/x", "example.com"),
    ("http://news.example.co.uk", "example.co.uk"),
    ("http://example.uk", "example.uk"),
    ("http://co.uk", None),
    ("http://a.shop.town.ck/", "shop.town.ck"),
    ("http://town.ck", None),
    ("http://www.ck", "www.ck"),
    ("http://x.www.ck", "www.ck"),
    ("http://EXAMPLE.Com", "example.com"),
    ("http://example.org", None),
    ("http://localhost", None),
    ("no url", None),
    (None, None),
]


@pytest.mark.parametrize("rows", [200_000, 1])
def test_suffix_table(spark, monkeypatch, rows):
    monkeypatch.setattr(session, "BROADCAST_ROWS", rows)
    rules = spark.createDataFrame([(r,) for r in RULES], "rule string")
    df = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(CASES)] + [(0, CASES[0][0])], "id int, url string")
    found = domains.with_registered_domain(df, "url", rules)
    assert found.columns == ["id", "url", "domain"]
    assert sorted((r.id, r.domain or "") for r in found.collect()) == sorted([(i, d or "") for i, (_, d) in enumerate(CASES)] + [(0, "example.com")])
    allow = spark.createDataFrame([("www.ck",)], "domain string")
    assert {r.domain for r in domains.with_registered_domain(df, "url", rules, allow=allow).collect()} == {"www.ck", None}
    assert domains.with_registered_domain(df.limit(0), "url", rules).count() == 0


def test_a_hundred_thousand_suffixes(spark):
    rules = spark.range(100_000).select(F.concat(F.lit("s"), F.col("id").cast("string"), F.lit(".example")).alias("rule"))
    df = spark.range(3000).select(F.concat(F.lit("http://www.shop.s"), (F.col("id") * 37).cast("string"), F.lit(".example/")).alias("url"), "id")
    found = domains.with_registered_domain(df, "url", rules)
    assert found.filter(F.col("domain") == F.concat(F.lit("shop.s"), (F.col("id") * 37).cast("string"), F.lit(".example"))).count() == 2703
    assert found.filter("domain is null").count() == 3000 - 2703


def test_long_list_of_sections(spark):
    df = spark.createDataFrame([("De Pin",), ("story",), (None,)], "article_title string")
    table = spark.createDataFrame([("De Pin",), ("De Pin",), (None,)], "t string")
    assert {r[0] for r in crawl.drop_section_pages(df, table).collect()} == {"story", None}
    assert {r[0] for r in crawl.drop_section_pages(df).collect()} == {"story", None}


def articles(spark, *urls):
    rows = [("s" + u[0], u, "title", None, None, None, None) for u in urls]
    return spark.createDataFrame(rows, "source string, " + schemas.RAW_ARTICLE.simpleString()[7:-1].replace(":", " "))


def test_a_batch_written_twice_is_there_once(spark, tmp_path):
    path, day = str(tmp_path / "raw"), F.lit("2024-01-09").cast("timestamp")
    read = lambda: sorted((r.batch, r.source, r.article_url, r.crawl_date) for r in readers.read_crawl_batches(spark, path).collect())
    writers.commit_crawl_batch(articles(spark, "a1", "b1"), path, "2024/01", day)
    writers.commit_crawl_batch(articles(spark, "a2"), path, "2024/02", day)
    first = read()
    assert first == [("2024/01", "sa", "a1", "20240109"), ("2024/01", "sb", "b1", "20240109"), ("2024/02", "sa", "a2", "20240109")]
    writers.commit_crawl_batch(articles(spark, "a1", "b1"), path, "2024/01", day)
    assert read() == first
    writers.commit_crawl_batch(articles(spark, "a3"), path, "2024/02", day)
    assert read() == [*first[:2], ("2024/02", "sa", "a3", "20240109")]
    assert readers.read_crawl_batches(spark, path, batches=["2024/02"]).count() == 1


def test_a_killed_write_is_not_seen(spark, tmp_path):
    path = str(tmp_path / "raw")
    writers.commit_crawl_batch(articles(spark, "a1", "b1"), path, "x")

    def fail(url):
        raise ValueError("killed")

    broken = articles(spark, "a1", "c1").withColumn("article_url", F.udf(fail)("article_url"))
    with pytest.raises(Exception, match="killed"):
        writers.commit_crawl_batch(broken, path, "x")
    # A write that got all its rows out, but not its entry in the manifest.
    lost = articles(spark, "z1").withColumns({"batch": F.lit("x"), "attempt": F.lit("lost"), "crawl_date": F.lit("20240101")})
    lost.write.mode("append").partitionBy("batch", "attempt", "source", "crawl_date").parquet(f"{path}/articles")
    assert sorted(r.article_url for r in readers.read_crawl_batches(spark, path).collect()) == ["a1", "b1"]
