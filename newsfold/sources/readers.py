"""Readers. Every schema is declared; directories are read whole."""

import json
from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LinearSVCModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import StructType

from newsfold import schemas
from newsfold.functions.text import parse_tokens
from newsfold.operators.kernels import Kernel
from newsfold.operators.svm import SvmModel, Trial
from newsfold.session import lookup_join


def _csv(spark: SparkSession, schema: StructType, path: str, multi_line: bool = True) -> DataFrame:
    """CSV with a header. Without line breaks inside fields (``multi_line`` False), large files are split over tasks."""
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("multiLine", multi_line)
        .option("escape", '"')
        .option("pathGlobFilter", "*.csv")
        .option("enforceSchema", False)
        .csv(path)
    )


def read_article_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """All article CSV files of a directory.

    Article texts hold line breaks, so a file is one task. Files written without any (``multi_line`` False) are split.
    """
    return _csv(spark, schemas.RAW_ARTICLE, path, multi_line)


def read_renamed_csv(
    spark: SparkSession,
    path: str,
    schema: StructType = schemas.NEWS_CSV,
    names: Mapping[str, str] = {"url": "article_url", "title": "article_title"},
    multi_line: bool = False,
) -> DataFrame:
    """All CSV files of a directory with other column names, renamed; ``multi_line``: fields may hold line breaks."""
    return _csv(spark, schema, path, multi_line).withColumnsRenamed(dict(names))


def read_json_lines(
    spark: SparkSession,
    path: str,
    schema: StructType = schemas.HEADLINE_JSON,
    names: Mapping[str, str] = {"headline": "article_title", "article_link": "article_url"},
) -> DataFrame:
    """All JSON-lines files of a directory, renamed."""
    return spark.read.schema(schema).option("pathGlobFilter", "*.json").json(path).withColumnsRenamed(dict(names))


def read_dataset(spark: SparkSession, path: str, langs: Sequence[str] | None = None, schema: StructType = schemas.HEADLINE) -> DataFrame:
    """The headline table; with ``langs`` only those language folders are read. ``schema``: ``schemas.PREPARED`` for prepared text."""
    df = spark.read.schema(schema).parquet(path)
    return df if langs is None else df.filter(F.col("lang").isin(list(langs)))


def read_dataset_csv(spark: SparkSession, path: str, schema: StructType = schemas.HEADLINE, multi_line: bool = True) -> DataFrame:
    """The headline table from CSV, with ``schemas.PREPARED`` also that with prepared words.

    Word arrays are the list text that ``write_dataset_csv`` writes; other columns of the file are an error.
    """
    arrays = {f.name for f in schema.fields if isinstance(f.dataType, T.ArrayType)}
    as_text = T.StructType([T.StructField(f.name, T.StringType() if f.name in arrays else f.dataType) for f in schema.fields])
    df = _csv(spark, as_text, path, multi_line)
    return df.select(*[parse_tokens(F.col(c)).alias(c) if c in arrays else F.col(c) for c in schema.names])


def read_sitemaps(spark: SparkSession, path: str) -> DataFrame:
    """Site-map XML files, one row (url, body) per file."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("url"), F.col("value").alias("body")
    )


def read_crawl_batches(spark: SparkSession, path: str, schema: StructType = schemas.RAW_ARTICLE, batches: Sequence[str] | None = None) -> DataFrame:
    """Article rows of the committed batches (or of the named ones), with ``source``, ``crawl_date`` and ``batch``.

    Only folders of attempts that the manifest names are read. ``schema``: the columns of the rows but ``source``.
    """
    manifest = spark.read.schema(schemas.CRAWL_MANIFEST).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(f"{path}/manifest")
    named = manifest if batches is None else manifest.filter(F.col("batch").isin(list(batches)))
    places = T.StructType([T.StructField(c, T.StringType()) for c in ("batch", "attempt", "source", "crawl_date")])
    rows = spark.read.schema(T.StructType([*[f for f in schema.fields if f.name not in places.names], *places.fields])).parquet(f"{path}/articles")
    return lookup_join(rows, named.select("batch", "attempt").distinct(), ["batch", "attempt"], "inner").drop("attempt")


def read_run_records(spark: SparkSession, path: str) -> DataFrame:
    """Run records written by ``write_run_record``."""
    return spark.read.schema(schemas.RUN_RECORD).json(path)


def read_result_files(spark: SparkSession, path: str) -> DataFrame:
    """A tree of result files ``family/run/kind[_split].json``, one row per file."""
    raw = (
        spark.read.schema(schemas.RESULT_FILE)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.json")
        .json(path)
        .select(F.split("_metadata.file_path", "/").alias("_parts"), "*")
    )
    stem = F.regexp_replace(F.element_at("_parts", -1), r"\.json$", "")
    return raw.select(
        F.element_at("_parts", -3).alias("family"),
        F.element_at("_parts", -2).alias("run"),
        F.regexp_replace(stem, "_(eval|test)$", "").alias("kind"),
        F.nullif(F.regexp_extract(stem, "_(eval|test)$", 1), F.lit("")).alias("split"),
        *schemas.RESULT_FILE.names,
    )


def load_model(path: str) -> PipelineModel:
    """A saved pipeline."""
    return PipelineModel.load(path)


def load_svm(spark: SparkSession, path: str) -> SvmModel:
    """A saved SVM."""
    settings = json.loads(spark.read.text(f"{path}/settings").first()["value"])
    model = LinearSVCModel.load(f"{path}/linear")
    trial = Trial(**settings["trial"])
    if settings["kernel"] is None:
        return SvmModel(trial, model)
    return SvmModel(trial, model, Kernel(**settings["kernel"]), spark.read.parquet(f"{path}/landmarks"))
