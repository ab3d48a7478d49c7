"""Row operators of the dataset build: filters, dedup, exact samples, unions."""

from collections.abc import Iterable, Sequence
from functools import reduce
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsfold import fixed_values as V
from newsfold.operators.hash_order import hash_order, mark_smallest


def project(df: DataFrame, items: Sequence[str]) -> DataFrame:
    """Keep the named columns in the given order; names the frame lacks are ignored."""
    return df.select([c for c in items if c in df.columns])


def with_title_length(df: DataFrame, title: str = "article_title") -> DataFrame:
    """Add the title length in code points."""
    return df.withColumn("title_length", F.length(title))


def length_band(
    df: DataFrame, low: int = V.MIN_TITLE_LENGTH, high: int = V.MAX_TITLE_LENGTH, length: str = "title_length"
) -> DataFrame:
    """Keep rows with low < length < high; null lengths go."""
    return df.filter((F.col(length) > low) & (F.col(length) < high))


def dedup_by(df: DataFrame, key: str, order: Sequence[str], title: str = "article_title") -> DataFrame:
    """One row per key: the smallest by ``order``, then by the other columns; nulls come last.

    A row whose title was not fetched never replaces one with a title, whatever the order. Null keys form one group. A
    partial minimum runs before the shuffle, so a key with many copies sends one row per task.
    """
    first = df.groupBy(key).agg(F.min(dedup_place(df.columns, key, order, title)).alias("_first"))
    return first.select(*dedup_columns(df.columns, key, "_first"))


def dedup_place(columns: Sequence[str], key: str, order: Sequence[str], title: str = "article_title") -> Column:
    """What decides between rows of a key: the smallest is kept. It holds all columns but the key."""
    ranked = [c for c in order if c != key] + [c for c in columns if c != key and c not in order]
    no_title = [F.col(title).isNull().alias("no_title")] if title in columns and title != key else []
    places = [F.struct(F.col(c).isNull().alias("missing"), F.col(c).alias("value")).alias(f"of_{c}") for c in ranked]
    return F.struct(F.lit(0).alias("row"), *no_title, *places)


def dedup_columns(columns: Sequence[str], key: str, place: str) -> list[Column]:
    """The columns again, from the key and the place."""
    return [F.col(key) if c == key else F.col(place)[f"of_{c}"]["value"].alias(c) for c in columns]


def sample_n(df: DataFrame, n: int, key: str | Sequence[str], seed: int = V.SEED) -> DataFrame:
    """Exactly n rows (all rows if there are fewer), the same for every run and layout.

    A sorted limit would send n rows of every task to one task, so the rows are
    picked by a hash threshold instead.
    """
    keys = [key] if isinstance(key, str) else list(key)
    marked = mark_smallest(df, [], {(): [n]}, hash_order(seed, *keys), "_part")
    return marked.filter(F.col("_part") == 0).drop("_part")


def union_sources(frames: Iterable[DataFrame]) -> DataFrame:
    """Stack frames by column name."""
    return reduce(lambda a, b: a.unionByName(b), frames)


def ends_with_any(text: Column, suffixes: Sequence[str]) -> Column:
    return text.rlike("(?:" + "|".join(re.escape(s) for s in suffixes) + r")\z")


def drop_image_urls(
    df: DataFrame, url: str = "article_url", suffixes: Sequence[str] = V.IMAGE_URL_SUFFIXES
) -> DataFrame:
    """Drop rows whose URL ends like an image; null URLs go too."""
    return df.filter(~ends_with_any(F.col(url), suffixes))


def label_slice(df: DataFrame, label: int | None = None, langs: Sequence[str] | None = None) -> DataFrame:
    """Rows of one label, of some languages, or both."""
    if label is not None:
        df = df.filter(F.col("is_sarcastic") == label)
    return df if langs is None else select_langs(df, langs)


def select_langs(df: DataFrame, langs: Sequence[str]) -> DataFrame:
    """Rows of the given languages; on a table partitioned by language, those folders only."""
    return df.filter(F.col("lang").isin(list(langs)))
