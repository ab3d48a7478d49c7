"""Scoring of new headlines: predicted label and confidence."""

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsfold.functions.text import normalize_headline
from newsfold.operators import svm


def predict_svm(df: DataFrame, text_model: PipelineModel, model: svm.SvmModel) -> DataFrame:
    """Add ``is_sarcastic`` and ``confidence`` by a trained run; columns with these names are replaced."""
    scored = svm.score(text_model.transform(df), model)
    kept = [c for c in df.columns if c not in ("is_sarcastic", "confidence")]
    return scored.select(*kept, F.col("prediction").cast("int").alias("is_sarcastic"), "confidence")


def predict_external(
    df: DataFrame, make_predict: Callable, text: str = "article_title", batch_size: int = 64
) -> DataFrame:
    """Add ``is_sarcastic`` and ``confidence`` by a model of the caller, which sees normalized headlines."""
    clean = df.withColumn("_clean", normalize_headline(F.coalesce(text, F.lit(""))))
    scored = svm.score_external(clean, "_clean", make_predict, batch_size, "_scores")
    first, second = F.get("_scores", F.lit(0)), F.get("_scores", F.lit(1))
    return svm.score_softmax(scored, first, second).drop("_clean", "_scores")
