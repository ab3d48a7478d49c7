import math

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from newsfold.functions import labels
from newsfold.operators import reports, split


def lengths(spark):
    rows = [("en", 0, 2, "s"), ("en", 0, 2, "s"), ("en", 0, 2, "t"), ("en", 0, 3, "t"), ("en", 1, 7, "s"), ("it", 1, None, "s"), ("it", 1, 10, "s")]
    return spark.createDataFrame(rows, "lang string, is_sarcastic int, title_length int, source string")


def test_mean_is_rounded_half_to_even(spark):
    found = {(r[0], r[1]): (r[2], r[3]) for r in reports.length_stats(lengths(spark)).collect()}
    assert found == {("en", 0): (2.0, 2.2), ("en", 1): (7.0, 7.0), ("it", 1): (10.0, 10.0)}
    exact = {(r[0], r[1]): r[3] for r in reports.length_stats(lengths(spark), digits=None).collect()}
    assert exact["en", 0] == 2.25
    assert tuple(reports.length_stats_all(lengths(spark)).first()) == (2.5, 4.3)


def test_levels(spark):
    found = {(r["lang"], r["is_sarcastic"]): r for r in reports.histogram_summary(lengths(spark)).collect()}
    assert set(found) == {("en", 0), ("en", 1), ("it", 1), (None, 0), (None, 1), (None, None)}
    total = found[None, None]
    assert (total["median_length"], total["min_length"], total["max_length"], total["n"]) == (2.5, 2, 10, 6)
    bars = reports.length_histogram(lengths(spark)).filter("level = 6").orderBy("title_length").collect()
    assert [(r["title_length"], r["frequency"]) for r in bars] == [(2, 3), (3, 1), (7, 1), (10, 1)]


def test_absent_pairs_are_null(spark):
    found = {r["lang"]: (r["label_0"], r["label_1"]) for r in reports.label_pivot(lengths(spark), "lang").collect()}
    assert found == {"en": (4, 1), "it": (None, 2)}


def test_source_medians(spark):
    found = {(r[0], r[1]): r[2] for r in reports.source_medians(lengths(spark)).collect()}
    assert found == {("s", 0): 2.0, ("t", 0): 2.5, ("s", 1): 8.5}


def test_label_counts_are_sorted(spark):
    assert [tuple(r) for r in reports.label_counts(lengths(spark)).collect()] == [(0, 4), (1, 3)]


def test_domains_of_the_sources(spark):
    urls = [("https://www.lercio.it/a", 1), ("https://nos.nl/b", 0), ("https://x.nl/", 0), (None, 0)]
    df = spark.createDataFrame(urls, "url string, is_sarcastic int")
    domain = labels.registered_domain(F.col("url"), allow=tuple(labels.V.DOMAIN_NAMES))
    found = {r["domain"]: (r["label_0"], r["label_1"]) for r in reports.label_pivot(df.withColumn("domain", domain), "domain").collect()}
    assert found == {"lercio.it": (None, 1), "nos.nl": (1, None)}


@given(st.dictionaries(st.integers(0, 5), st.integers(0, 10**7), min_size=1), st.floats(0.01, 0.99))
def test_class_quotas(counts, fraction):
    quotas = split.class_quotas(counts, fraction)
    size, total = math.ceil(fraction * sum(counts.values())), sum(counts.values())
    assert sum(quotas.values()) == size
    for c, n in counts.items():
        assert 0 <= quotas[c] <= n
        assert total == 0 or abs(quotas[c] - n * size / total) < 1 + 1e-6
