"""Descriptive reports. All of them are derived from small count tables."""

from collections.abc import Sequence

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = (("lang", "is_sarcastic"), ("is_sarcastic",), ())


def label_counts(df: DataFrame, label: str = "is_sarcastic") -> DataFrame:
    """Rows per label, most frequent first."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), label)


def _length_counts(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows per group and length: the one pass over the data behind all length reports."""
    return df.filter(F.col("title_length").isNotNull()).groupBy(*by, "title_length").agg(F.count(F.lit(1)).alias("n"))


def _finest(levels: Sequence[Sequence[str]]) -> list[str]:
    return list(dict.fromkeys(c for level in levels for c in level))


def _median() -> Column:
    return F.percentile("title_length", 0.5, F.col("n")).alias("median_length")


def _mean(digits: int | None) -> Column:
    mean = F.sum(F.col("title_length").cast("long") * F.col("n")) / F.sum("n")
    if digits is not None:
        mean = F.rint(mean * 10.0**digits) / 10.0**digits
    return mean.alias("mean_length")


def length_stats(df: DataFrame, by: Sequence[str] = LEVELS[0], digits: int | None = 1) -> DataFrame:
    """Exact median and mean title length per group; the mean is rounded half to even."""
    return _length_counts(df, by).groupBy(*by).agg(_median(), _mean(digits))


def length_stats_all(df: DataFrame, digits: int | None = 1) -> DataFrame:
    """Median and mean over all rows."""
    return length_stats(df, (), digits)


def length_stats_sets(
    df: DataFrame, levels: Sequence[Sequence[str]] = (LEVELS[0], LEVELS[2]), digits: int | None = 1
) -> DataFrame:
    """The statistics of several grouping levels in one pass; columns outside a level are null."""
    by = _finest(levels)
    sets = [[F.col(c) for c in level] for level in levels]
    return (
        _length_counts(df, by)
        .groupingSets(sets, *by)
        .agg(_median(), _mean(digits), F.grouping_id().cast("int").alias("level"))
    )


def source_medians(df: DataFrame) -> DataFrame:
    """Median title length per source and label."""
    by = ("source", "is_sarcastic")
    return _length_counts(df, by).groupBy(*by).agg(_median())


def label_pivot(df: DataFrame, row: str, label: str = "is_sarcastic", labels: Sequence[int] = (0, 1)) -> DataFrame:
    """Counts with one column per label, ``label_0`` and so on, and ``label_other`` for null and other labels.

    Absent pairs are null, null rows are left out.
    """
    own = [F.col(label).eqNullSafe(v) for v in labels]
    named = {f"label_{v}": is_v for v, is_v in zip(labels, own)} | {"label_other": ~reduce(or_, own)}
    counts = df.filter(F.col(row).isNotNull()).groupBy(row)
    return counts.agg(*[F.nullif(F.count_if(is_v), F.lit(0)).alias(name) for name, is_v in named.items()])


def length_histogram(df: DataFrame, levels: Sequence[Sequence[str]] = LEVELS) -> DataFrame:
    """(group, length, frequency) at several grouping levels, from one pass over the rows."""
    by = _finest(levels)
    sets = [[*[F.col(c) for c in level], F.col("title_length")] for level in levels]
    return (
        _length_counts(df, by)
        .groupingSets(sets, *by, "title_length")
        .agg(F.sum("n").alias("frequency"), F.grouping_id().cast("int").alias("level"))
    )


def histogram_summary(df: DataFrame, levels: Sequence[Sequence[str]] = LEVELS) -> DataFrame:
    """Median, least and greatest length and row count of each histogram."""
    by = _finest(levels)
    sets = [[F.col(c) for c in level] for level in levels]
    return (
        _length_counts(df, by)
        .groupingSets(sets, *by)
        .agg(
            _median(),
            F.min("title_length").alias("min_length"),
            F.max("title_length").alias("max_length"),
            F.sum("n").alias("n"),
            F.grouping_id().cast("int").alias("level"),
        )
    )
