from datetime import datetime

import pytest
from pyspark.sql import functions as F

from newsfold.functions import html
from newsfold.operators import crawl


def one(spark, column, *values):
    names = [f"c{i}" for i in range(len(values))]
    df = spark.createDataFrame([values], ", ".join(f"{n} string" for n in names))
    return df.select(column(*[F.col(n) for n in names]).alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("value", "expected"),
    [
        ("a<b\nc>d&amp;e&AMP;f<i>g\r</i\r>h", "a<b\nc>de&AMP;fg\rh"),
        ("&#39;x&#1234567;&#xe9;&#xE9;", "x&#1234567;&#xE9;"),
        ("<p>one</p> two", "one two"),
        (None, None),
    ],
)
def test_clean_html(spark, value, expected):
    assert one(spark, html.clean_html, value) == expected


def test_extract_title(spark):
    page = "<html><TITLE lang='en'>\n A &amp; <b>B</b> </TITLE><title>x</title>"
    assert one(spark, html.extract_title, page) == "A  B"
    assert one(spark, html.extract_title, "<p>no title</p>") is None
    assert one(spark, html.extract_title, None) is None


def test_extract_body(spark):
    page = "<script>var a='<article>no</article>'</script><!-- <p>no</p> --><article><p>yes</p>\nmore</article><p>no</p>"
    assert one(spark, html.extract_body, page) == "yes\nmore"
    page = "<style>p{}</style><p class='a'>one</p><pre>no</pre><p>two\nlines</p>"
    assert one(spark, html.extract_body, page) == "one\ntwo\nlines"
    assert one(spark, html.extract_body, "nothing") is None


@pytest.mark.parametrize(
    ("page", "expected"),
    [
        ("<article>before <article>a card</article> and after</article>", "before a card and after"),
        ("<article><p>teaser</p></article><ARTICLE class='x'><p>the story itself</p></ARTICLE >", "the story itself"),
        ("<body><p>one<p class='y'>two<p>three</body>", "one\ntwo\nthree"),
        ("<div>menu</div><div class='main'>first part <div>an aside here</div>second part</div>", "first part second part"),
        ("<article>never closed <b>text", "never closed text"),
        ("</article>stray<article>right</article>", "right"),
        ("<article> </article><p>a paragraph</p>", "a paragraph"),
        ("<article><article>inner only</article></article><article>x</article>", "inner only"),
        ("<articles>no</articles><p>yes</p>", "yes"),
        ("<article>one</article><article>two</article>", "one"),
        ("<p>closed</p>loose text<p>again</p>", "closed\nagain"),
        ("<div><div></div></div>", None),
        ("", None),
        (None, None),
    ],
)
def test_extract_body_of_balanced_elements(spark, page, expected):
    assert one(spark, html.extract_body, page) == expected


def test_extract_body_of_many_elements(spark):
    page = "<div>" * 300 + "deep" + "</div>" * 300 + "".join(f"<div>part {i} of many</div>" for i in range(300))
    assert one(spark, html.extract_body, page) == "part 100 of many"


@pytest.mark.parametrize(
    ("value", "expected"),
    [
        ("VIDEO credit", "VIDEO credit"),
        ("first\nsecond", "first\nsecond"),
        ("foto: Shutterstock\n second \nthird", "second"),
        ("x youtube\n\nthird", ""),
        ("video\nsecond", "video\nsecond"),
        (None, None),
    ],
)
def test_trim_media_credit(spark, value, expected):
    assert one(spark, html.trim_media_credit, value) == expected


META = '<meta property="article:published_time" content="{}"/>'


@pytest.mark.parametrize(
    ("url", "page", "expected"),
    [
        ("https://x/2020/13/45/a", "", None),
        ("https://x/2020/02/30/a", "", (datetime(2020, 2, 1), "url", "partial")),
        ("https://x/2020/02/29/a", "", (datetime(2020, 2, 29), "url", "date")),
        ("https://x/2020/02/a", "", (datetime(2020, 2, 1), "url", "partial")),
        ("https://x/a", "", None),
        ("https://x/a", META.format("2021-03-04T05:06:07-04:00"), (datetime(2021, 3, 4, 5, 6, 7), "page tag", "datetime")),
        ("https://x/2020/02/29/a", META.format("2020-02-29T01:02:03Z"), (datetime(2020, 2, 29, 1, 2, 3), "page tag", "datetime")),
        ("https://x/2020/02/a", '<time class="d" datetime="2020-02-05">', (datetime(2020, 2, 5), "page tag", "date")),
        ("https://x/a", META.format("soon"), None),
        ("https://x/a", "<meta content='2021-03-04' property='og:published_time'>", (datetime(2021, 3, 4), "page tag", "date")),
        ("https://x/2020/02/a", None, (datetime(2020, 2, 1), "url", "partial")),
    ],
)
def test_guess_publish_date(spark, url, page, expected):
    found = one(spark, html.guess_publish_date, url, page)
    assert (found if found is None else tuple(found)) == expected


def test_sitemap_links(spark):
    index = """<?xml version="1.0"?><sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">
    <sitemap><loc>https://x/post-sitemap1.xml</loc></sitemap><sitemap><loc>https://x/page-sitemap.xml</loc></sitemap>
    <sitemap><loc>https://x/sitemap/2020/05.xml</loc><loc>https://x/sitemap/2020/05Zxml</loc></sitemap></sitemapindex>"""
    df = spark.createDataFrame([("a", index), ("b", index), ("a", index), ("z", index), ("a", None)], "source string, body string")
    rules = {"a": crawl.POST_SITEMAPS, "b": crawl.MONTHLY_SITEMAPS}
    assert {tuple(r) for r in crawl.sitemap_index_links(df, rules).collect()} == {
        ("a", "https://x/post-sitemap1.xml"),
        ("b", "https://x/sitemap/2020/05.xml"),
        ("b", "https://x/sitemap/2020/05Zxml"),
    }


def test_sitemap_article_links(spark):
    body = """<urlset><url><loc>https://x/2020/01/02/a?b=1&amp;c=2</loc><image:image><image:loc>https://x/i.jpg</image:loc></image:image></url>
    <url><loc><![CDATA[https://x/news/b]]></loc></url><url><loc>https://x/c.jpg?w=1</loc></url><loc>https://x/outside</loc></urlset>"""
    df = spark.createDataFrame([(s, body) for s in "abc"], "source string, body string")
    rules = {"a": crawl.DATED_ARTICLES, "b": crawl.NEWS_ARTICLES, "c": crawl.NO_IMAGES}
    assert {tuple(r) for r in crawl.sitemap_article_links(df, rules).collect()} == {
        ("a", "https://x/2020/01/02/a?b=1&c=2"),
        ("b", "https://x/news/b"),
        ("c", "https://x/2020/01/02/a?b=1&c=2"),
        ("c", "https://x/news/b"),
    }


def test_article_rows(spark):
    rows = [
        ("s", "https://x/2020/01/02/a", 200, "<title>T</title><p>body</p>"),
        ("s", "https://x/b", 201, "<p>no title</p>"),
        ("s", "https://x/c", 404, "<title>T</title>"),
        ("s", "https://x/d", 200, "<title>De Pin</title>"),
        ("s", "https://x/e", None, "<title>T</title>"),
    ]
    fetched = spark.createDataFrame(rows, "source string, url string, status int, body string")
    found = {r["article_url"][-1]: r for r in crawl.article_rows(fetched).collect()}
    assert set(found) == {"a", "b"}
    assert found["a"]["article_text"] == "body" and found["a"]["publish_date"] == datetime(2020, 1, 2)
    assert found["b"]["article_title"] is None


def test_crawl_date(spark):
    df = crawl.with_crawl_date(spark.range(1), F.lit("2024-03-05 10:00:00").cast("timestamp"))
    assert df.first()["crawl_date"] == "20240305"
