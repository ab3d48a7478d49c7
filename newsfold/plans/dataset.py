"""The dataset build: one configuration row per source, one chain of operators for all of them."""

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsfold import fixed_values as V
from newsfold.functions.text import strip_site_suffix
from newsfold.operators import rows as R

HEADLINE_COLUMNS = ("article_url", "article_title", "is_sarcastic", "title_length", "lang")


@dataclass(frozen=True)
class SourceConfig:
    """How one source becomes headline rows.

    ``label`` None takes the label from the data. ``sample`` is an exact row
    count; ``sample_first`` draws it before image URLs are dropped, so that fewer
    rows may remain. ``order`` decides which of several rows of a URL is kept.
    """

    lang: str
    label: int | None = None
    site_name: str | None = None
    sample: int | None = None
    drop_images: bool = False
    sample_first: bool = False
    lower_title: bool = False
    renames: Mapping[str, str] | None = None
    order: tuple[str, ...] = ()


# The five sources of the three-language dataset.
SOURCES = {
    "de_speld": SourceConfig("nl", 1, lower_title=True),
    "nos": SourceConfig(
        "nl", 0, sample=V.NEWS_SAMPLE_SIZE, lower_title=True, renames={"url": "article_url", "title": "article_title"}
    ),
    "lercio": SourceConfig("it", 1, site_name="Lercio", drop_images=True, lower_title=True),
    "il_giornale": SourceConfig("it", 0, sample=V.NEWS_SAMPLE_SIZE, drop_images=True, lower_title=True),
    "english": SourceConfig("en", None, renames={"article_link": "article_url", "headline": "article_title"}),
}


def build_source(
    df: DataFrame,
    config: SourceConfig,
    low: int = V.MIN_TITLE_LENGTH,
    high: int = V.MAX_TITLE_LENGTH,
    seed: int = V.SEED,
) -> DataFrame:
    """Headline rows of one source.

    Only the columns the chain needs reach the dedup shuffle. Narrow filters run
    after the dedup, as the kept row of a URL decides whether the URL stays.
    """
    if config.renames:
        df = df.withColumnsRenamed(dict(config.renames))
    df = R.project(df, ["article_url", "article_title", "is_sarcastic", *config.order])
    df = R.dedup_by(df, "article_url", config.order).drop(*config.order)
    if config.site_name:
        df = df.withColumn("article_title", strip_site_suffix(F.col("article_title"), config.site_name))
    df = R.length_band(R.with_title_length(df), low, high)
    if config.drop_images and not config.sample_first:
        df = R.drop_image_urls(df)
    if config.sample is not None:
        df = R.sample_n(df, config.sample, "article_url", seed)
    if config.drop_images and config.sample_first:
        df = R.drop_image_urls(df)
    if config.label is not None:
        df = df.withColumn("is_sarcastic", F.lit(config.label))
    if config.lower_title:
        df = df.withColumn("article_title", F.lower("article_title"))
    return df.withColumn("lang", F.lit(config.lang))


def build_dataset(
    frames: Mapping[str, DataFrame],
    configs: Mapping[str, SourceConfig] = SOURCES,
    columns: Sequence[str] = HEADLINE_COLUMNS,
    low: int = V.MIN_TITLE_LENGTH,
    high: int = V.MAX_TITLE_LENGTH,
    seed: int = V.SEED,
) -> DataFrame:
    """All sources as one headline table. ``source`` may be among ``columns``."""
    missing = set(frames) - set(configs)
    if missing:
        raise ValueError(f"no configuration for {sorted(missing)}")
    built = [
        build_source(df, configs[name], low, high, seed).withColumn("source", F.lit(name)).select(*columns)
        for name, df in frames.items()
    ]
    return R.union_sources(built)
