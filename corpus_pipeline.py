"""A training corpus from raw documents: language, near duplicates, benchmark passages, personal data, tokens."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import byte_bpe, decontamination, language_id, near_dedup, pii
from llm.frames import shared_folder, stored, unused_name

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told, with ``lang`` as told from their texts; the others go."""
    columns = docs.columns
    model = language_id.train(docs.filter(~language_id.held_out()))
    told = language_id.identify(docs, model, carry=columns)
    kept = told.filter(F.col("lang_pred") != language_id.UNDETERMINED)
    return kept.withColumn("lang", F.col("lang_pred")).select(*columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that with the smallest ``doc_id``, nulls last.

    Rows decide, not ids: rows under one id are compared as any others, and rows without an id are deduplicated, too.
    Rows without words are like no other and stay.
    """
    row = unused_name("row", docs.columns)
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()))
    found = near_dedup.near_duplicates(numbered, key=row).select(F.col("doc_id").alias(row), "component_id")
    place = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", F.col(row).alias("row"))
    first = numbered.select(row, "doc_id").join(found, row).groupBy("component_id").agg(F.min(place).alias("first"))
    return numbered.join(first.select(F.col("first.row").alias(row)), row, "left_semi").select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontamination.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind; ``n_chars`` counts anew."""
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and whether they decode to it."""
    coded = byte_bpe.encode(docs.select("doc_id", "lang", "source", "text"), decoded=True)
    return coded.select("doc_id", "lang", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("decodes"))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("byte_bpe", token_stage),
]

#: Language models, MinHash, expectation-maximisation and merges are not SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written as Parquet to the shared folder and read by the next stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_folder(spark)
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
