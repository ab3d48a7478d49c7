"""Helpers for operators that work on the rows of one text column, and for tables in the shared folder."""

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from llm.words import pieces

#: A side of a join with at most so many rows of a few numbers is broadcast (some 10 MB); a longer one is joined by shuffle.
BROADCAST_ROWS = 500_000


def column(name: str):
    return F.col("`" + name.replace("`", "``") + "`")


def unused_name(name: str, taken: list[str]) -> str:
    """The name, lengthened until no column has it."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name += "_"
    return name


#: What frees the tables of the operator that this worker worked for last.
_release: Callable[[], None] | None = None


def _name(of) -> tuple[str, str]:
    return of.__module__, of.__qualname__


def keep_only(release: Callable[[], None] | None) -> None:
    """Called by a task: tables of the same operator stay for it, those of another are freed first."""
    global _release
    if _release is not None and (release is None or _name(release) != _name(_release)):
        _release()
    _release = release


def add_columns(
    df: DataFrame,
    text: str,
    carry: list[str] | None,
    new: list[T.StructField],
    rows: Callable[[], Callable[[pa.Array], list[pa.Array]]],
    release: Callable[[], None] | None = None,
) -> DataFrame:
    """The columns ``carry`` (None: all) and the ``new`` ones, which ``rows()`` computes from Arrow arrays of texts.

    A carried column with the name of a new one is replaced. ``rows`` is called once in each task. Tables that it keeps for
    later tasks of its worker are freed by ``release`` when the worker turns to other work.
    """
    taken = {f.name.lower() for f in new}
    kept = [c for c in (df.columns if carry is None else carry) if c.lower() not in taken]
    inner = df.select(*[column(c) for c in kept])
    schema = T.StructType([*inner.schema.fields, *new])
    own = text
    # A text that is carried anyway is sent to the workers once.
    if inner.columns.count(text) != 1 or inner.schema[text].dataType != T.StringType():
        own = unused_name("text_of_row", kept)
        inner = df.select(*[column(c) for c in kept], column(text).cast("string").alias(own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only(release)
        compute = rows()
        for batch in pieces(batches, own):
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *compute(batch.column(own))], names=schema.names)

    return inner.mapInArrow(run, schema)


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the one that ``spark.checkpoint.dir`` names; a local session without it gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        folder = spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = "file://" + tempfile.mkdtemp(prefix="llm-")
        spark.sparkContext.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/llm-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The frame written as Parquet to the shared folder and read again: no lineage, nothing kept in executors."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def semi_join(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows of ``df`` whose ``on`` is in ``keys`` (one column). Few keys are broadcast; many are joined by shuffle."""
    if keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return df.join(F.broadcast(keys), on, "left_semi")
    return df.join(keys, on, "left_semi")
