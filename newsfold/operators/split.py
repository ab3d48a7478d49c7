"""Train, validation and test parts with exact sizes."""

import math
from collections.abc import Mapping, Sequence
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsfold import fixed_values as V
from newsfold.operators.hash_order import MAX_GROUPS, hash_order, mark_smallest


def class_quotas(counts: Mapping, fraction: float) -> dict:
    """Rows of each class for a part of ceil(fraction * N) rows, by largest remainder.

    Ties go to the smaller class value.
    """
    total = sum(counts.values())
    if total == 0:
        return dict.fromkeys(counts, 0)
    size = math.ceil(fraction * total)
    exact = {c: Fraction(n * size, total) for c, n in counts.items()}
    quotas = {c: math.floor(x) for c, x in exact.items()}
    by_remainder = sorted(counts, key=lambda c: (quotas[c] - exact[c], c is None, c))
    for c in by_remainder[: size - sum(quotas.values())]:
        quotas[c] += 1
    return quotas


def label_counts_by(df: DataFrame, columns: Sequence[str]) -> list:
    """Row counts per combination, on the driver; the number of combinations is checked."""
    rows = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).limit(MAX_GROUPS + 1).collect()
    if len(rows) > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} label groups")
    return rows


def _names(names: Sequence[str], part: str):
    return F.get(F.array(*[F.lit(n) for n in names]), F.col(part))


def stratified_split(
    df: DataFrame,
    key: str | Sequence[str],
    label: str = "is_sarcastic",
    fraction: float = V.HOLDOUT_FRACTION,
    seed: int = V.SEED,
    names: tuple[str, str] = ("test", "train"),
) -> DataFrame:
    """Add ``split``: ceil(fraction * N) rows, stratified by label, get the first name."""
    def quotas(sizes):
        return {(c,): [n] for c, n in class_quotas({c: n for (c,), n in sizes.items()}, fraction).items()}

    keys = [key] if isinstance(key, str) else list(key)
    marked = mark_smallest(df, [label], quotas, hash_order(seed, *keys), "_part")
    return marked.withColumn("split", _names(names, "_part")).drop("_part")


def train_val_test_quotas(counts: Mapping, fraction: float = V.HOLDOUT_FRACTION) -> dict:
    """Per class: rows of the test part and rows of the validation part taken from the rest."""
    test = class_quotas(counts, fraction)
    val = class_quotas({c: n - test[c] for c, n in counts.items()}, fraction)
    return {c: [test[c], val[c]] for c in counts}


def train_val_test(
    df: DataFrame,
    key: str | Sequence[str],
    label: str = "is_sarcastic",
    fraction: float = V.HOLDOUT_FRACTION,
    seed: int = V.SEED,
) -> DataFrame:
    """Add ``split``: a test part of all rows, a validation part of the rest, both stratified.

    One hash order serves both cuts: the first rows of a label are its test
    rows, the next ones its validation rows.
    """
    def quotas(sizes):
        return {(c,): q for c, q in train_val_test_quotas({c: n for (c,), n in sizes.items()}, fraction).items()}

    keys = [key] if isinstance(key, str) else list(key)
    marked = mark_smallest(df, [label], quotas, hash_order(seed, *keys), "_part")
    return marked.withColumn("split", _names(("test", "val", "train"), "_part")).drop("_part")


def holdout_langs(df: DataFrame, langs: Sequence[str]) -> DataFrame:
    """Add ``part``: "pool" for the given languages, "test" for all others; null languages go."""
    part = F.when(F.col("lang").isin(list(langs)), "pool").otherwise("test")
    return df.filter(F.col("lang").isNotNull()).withColumn("part", part)


def split_sizes(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows per part."""
    return df.groupBy(*by, "split").agg(F.count(F.lit(1)).alias("n"))
