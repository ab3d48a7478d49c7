"""Registered domains by a table of public suffixes of any length."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsfold.session import lookup_join


def url_host(url: Column) -> Column:
    """The host of a URL, lower-cased; null without one."""
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def suffix_lengths(hosts: DataFrame, suffixes: DataFrame) -> DataFrame:
    """``host`` and ``labels``: how many of its last labels are its public suffix; hosts that no rule fits are left out.

    ``suffixes`` has one column ``rule``: a suffix (``co.uk``), a wildcard for one label in front of a suffix (``*.ck``), or
    an exception to a wildcard (``!www.ck``: the suffix begins behind its first label). An exception beats all other rules,
    then the longest rule wins. Each host is matched once by an equi join of its tails with the table.
    """
    parts = F.split("host", r"\.")
    tails = hosts.filter(F.col("host").isNotNull()).select("host", F.posexplode(F.reverse(parts)).alias("place", "label"), parts.alias("parts"))
    tail = F.array_join(F.slice("parts", F.size("parts") - F.col("place"), F.col("place") + 1), ".")
    behind = F.array_join(F.slice("parts", F.size("parts") - F.col("place") + 1, F.col("place")), ".")
    # A rule for the tail itself, for its wildcard, and for the exception that names it.
    rules = F.inline(
        F.array(
            F.struct(tail.alias("rule"), F.lit(0).alias("exception"), (F.col("place") + 1).alias("labels")),
            F.struct(F.concat(F.lit("*."), behind).alias("rule"), F.lit(0).alias("exception"), (F.col("place") + 1).alias("labels")),
            F.struct(F.concat(F.lit("!"), tail).alias("rule"), F.lit(1).alias("exception"), F.col("place").alias("labels")),
        )
    )
    known = suffixes.select(F.lower("rule").alias("rule")).filter("rule is not null").distinct()
    fitting = lookup_join(tails.select("host", rules), known, ["rule"], "inner")
    return fitting.groupBy("host").agg(F.max(F.struct("exception", "labels")).alias("best")).select("host", "best.labels")


def with_registered_domain(df: DataFrame, url: str, suffixes: DataFrame, out: str = "domain", allow: DataFrame | None = None) -> DataFrame:
    """Add ``out``: the public suffix of the URL's host and the label in front of it.

    Null for hosts that no rule fits, for bare suffixes, for null URLs, and, with ``allow`` (a table with one column
    ``domain``), for domains outside it. Hosts are matched once each, however many rows have them; the tables may be of any
    length, and a host with a third of all rows is joined by broadcast or over many tasks. Rows keep all other columns.
    """
    host, n = "_host_of_url", "_suffix_labels"
    rows = df.withColumn(host, url_host(F.col(url)))
    lengths = suffix_lengths(rows.select(F.col(host).alias("host")).distinct(), suffixes)
    parts = F.split("host", r"\.")
    domains = lengths.filter(F.size(parts) > F.col("labels")).select("host", F.array_join(F.slice(parts, F.size(parts) - F.col("labels"), F.col("labels") + 1), ".").alias(out))
    if allow is not None:
        domains = lookup_join(domains, allow.select(F.col("domain").alias(out)).distinct(), [out], "inner")
    return lookup_join(rows, domains.select(F.col("host").alias(host), out), [host]).select(*df.columns, out)
