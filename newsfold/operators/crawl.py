"""Operators on tables of fetched documents: site maps to links, pages to article rows."""

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsfold import fixed_values as V
from newsfold.functions import html as H
from newsfold.session import lookup_join


@dataclass(frozen=True)
class LinkRule:
    """Which links of a site map to keep: texts it must contain, a pattern, texts it must not contain."""

    contains: tuple[str, ...] = ()
    matches: str | None = None
    excludes: tuple[str, ...] = ()

    def accepts(self, link: Column) -> Column:
        keep = link != ""
        for text in self.contains:
            keep = keep & F.contains(link, F.lit(text))
        if self.matches is not None:
            keep = keep & link.rlike(self.matches)
        if self.excludes:
            keep = keep & ~link.rlike("|".join(re.escape(t) for t in self.excludes))
        return keep


# Link rules of the three kinds of sites.
POST_SITEMAPS = LinkRule(contains=("post-sitemap",))
MONTHLY_SITEMAPS = LinkRule(contains=("/sitemap/",), matches=r"[0-9]{4}/[0-9]{2}.xml")
DATED_ARTICLES = LinkRule(matches=r"[0-9]{4}/[0-9]{2}/[0-9]{2}")
NEWS_ARTICLES = LinkRule(contains=("/news/",))
NO_IMAGES = LinkRule(excludes=V.IMAGE_LINK_MARKS)


def _links(df: DataFrame, links: Column, rules: Mapping[str, LinkRule]) -> DataFrame:
    keep = F.lit(False)
    for source, rule in rules.items():
        keep = keep | ((F.col("source") == source) & rule.accepts(F.col("link")))
    return df.select("source", F.explode(links).alias("link")).filter(keep).distinct()


def sitemap_index_links(df: DataFrame, rules: Mapping[str, LinkRule]) -> DataFrame:
    """Distinct (source, link) of site-map indexes (columns source, body), by the rule of each source."""
    return _links(df, H.sitemap_locations(F.col("body")), rules)


def sitemap_article_links(df: DataFrame, rules: Mapping[str, LinkRule]) -> DataFrame:
    """Distinct (source, link) of site maps (columns source, body), by the rule of each source."""
    return _links(df, H.article_locations(F.col("body")), rules)


def ok_responses(df: DataFrame, codes: Sequence[int] = V.OK_STATUS) -> DataFrame:
    """Documents that were fetched."""
    return df.filter(F.col("status").isin(list(codes)))


def drop_section_pages(
    df: DataFrame, titles: Sequence[str] | DataFrame = V.SECTION_TITLES, title: str = "article_title"
) -> DataFrame:
    """Drop pages whose title is the name of a site section; rows without a title stay.

    A long list is a table with the titles in its first column; it is anti-joined.
    """
    if isinstance(titles, DataFrame):
        return lookup_join(df, titles.select(F.col(titles.columns[0]).alias(title)).distinct(), [title], "left_anti")
    return df.filter(~F.coalesce(F.col(title).isin(list(titles)), F.lit(False)))


def article_rows(fetched: DataFrame, section_titles: Sequence[str] = V.SECTION_TITLES) -> DataFrame:
    """Fetched documents to raw article rows, with the source kept. Narrow: no shuffle."""
    pages = ok_responses(fetched).select(
        "source",
        F.col("url").alias("article_url"),
        H.extract_title(F.col("body")).alias("article_title"),
        H.extract_body(F.col("body")).alias("_text"),
        H.guess_publish_date(F.col("url"), F.col("body")).alias("_date"),
    )
    return drop_section_pages(pages, section_titles).select(
        "source", "article_url", "article_title", H.trim_media_credit(F.col("_text")).alias("article_text"), "_date.*"
    )


def with_crawl_date(df: DataFrame, run_time: Column) -> DataFrame:
    """Add the crawl date as zero-padded yyyymmdd."""
    return df.withColumn("crawl_date", F.date_format(run_time, "yyyyMMdd"))
