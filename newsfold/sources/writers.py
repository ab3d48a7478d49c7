"""Writers."""

import hashlib
import json
import uuid
from dataclasses import asdict

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsfold import schemas
from newsfold.functions.text import render_tokens
from newsfold.operators.crawl import with_crawl_date
from newsfold.operators.svm import SvmModel


def write_dataset(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The headline table, in one folder per language.

    The rebalance hint lets adaptive execution pack small languages into few
    files and split a large one over many tasks.
    """
    df.hint("rebalance", "lang").write.mode(mode).partitionBy("lang").parquet(path)


def write_dataset_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV export; token arrays are written as Python list text."""
    arrays = {f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)}
    columns = [render_tokens(F.col(c)).alias(c) if c in arrays else F.col(c) for c in df.columns]
    (
        df.select(columns)
        .write.mode(mode)
        .option("header", True)
        .option("escape", '"')
        .option("timestampFormat", "yyyy-MM-dd HH:mm:ss")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def write_crawl_batch(df: DataFrame, path: str, run_time=None) -> None:
    """Append article rows (with ``source``) under source and crawl date."""
    stamped = with_crawl_date(df, F.current_timestamp() if run_time is None else run_time)
    stamped.write.mode("append").partitionBy("source", "crawl_date").parquet(path)


def commit_crawl_batch(df: DataFrame, path: str, batch: str, run_time=None) -> None:
    """Write article rows (with ``source``) as the whole content of one batch; doing it again replaces the batch.

    Rows go to a folder of this attempt first, under source and crawl date. Then the batch's entry in the manifest names the
    attempt. ``readers.read_crawl_batches`` reads what the manifest names: of a write that was killed, or repeated, nothing
    is seen but its last whole attempt. Batches may be written at the same time.
    """
    attempt = uuid.uuid4().hex
    stamped = with_crawl_date(df, F.current_timestamp() if run_time is None else run_time)
    marked = stamped.withColumns({"batch": F.lit(batch), "attempt": F.lit(attempt)})
    marked.write.mode("append").partitionBy("batch", "attempt", "source", "crawl_date").parquet(f"{path}/articles")
    entry = df.sparkSession.createDataFrame([(batch, attempt, stamped.columns)], schemas.CRAWL_MANIFEST)
    folder = hashlib.sha256(batch.encode()).hexdigest()
    entry.coalesce(1).write.mode("overwrite").json(f"{path}/manifest/{folder}")


def write_run_record(df: DataFrame, path: str) -> None:
    """Append run records under their model family."""
    df.write.mode("append").partitionBy("family").json(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def save_svm(model: SvmModel, path: str) -> None:
    """A fitted SVM: the linear model and, for other kernels, the landmarks and kernel parameters."""
    spark = SparkSession.getActiveSession()
    model.model.write().overwrite().save(f"{path}/linear")
    settings = {"trial": asdict(model.trial), "kernel": asdict(model.kernel) if model.kernel else None}
    spark.createDataFrame([(json.dumps(settings),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/settings")
    if model.landmarks is not None:
        model.landmarks.write.mode("overwrite").parquet(f"{path}/landmarks")
