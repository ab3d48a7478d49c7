"""A headline table that takes new batches and stays without duplicates.

Rows lie in hash buckets of their key. A batch is merged by rewriting only the buckets that it touches; the rest of the
table isn't read. The old rows of those buckets are read once, next to the batch's keys, and aren't shuffled.

A manifest says which merge wrote the current rows of each bucket. It is written last, so that of a merge that was killed
nothing is seen, and merging a batch again changes nothing. Merges of one table must run one after the other. Files of
earlier merges stay until they are removed by the owner of the folder.
"""

from collections.abc import Sequence
import json
import uuid

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsfold import session
from newsfold.operators.rows import dedup_by, dedup_columns, dedup_place
from newsfold.session import reliable_checkpoint, unused_name

BUCKETS = 64
_MANIFEST = "version long, bucket int, merge string"
_SETTINGS = "key string, sorted_by array<string>, title string, buckets int, columns string"


def create(
    spark: SparkSession, path: str, schema: T.StructType, key: str, order: Sequence[str], title: str = "article_title", buckets: int = BUCKETS
) -> None:
    """An empty table. ``key``, ``order`` and ``title`` are those of ``dedup_by``; they hold for every merge.

    Take so many buckets that one of them fits a few tasks. An existing table is refused.
    """
    if key not in schema.names or set(order) - set(schema.names):
        raise ValueError("key and order must be columns")
    if "bucket" in {c.lower() for c in schema.names}:
        raise ValueError("a column may not be named bucket")
    fixed = spark.createDataFrame([(key, list(order), title, buckets, schema.json())], _SETTINGS)
    fixed.coalesce(1).write.mode("error").json(f"{path}/settings")
    _commit(spark, path, 0, [], "")


def _commit(spark: SparkSession, path: str, version: int, buckets: Sequence[int], merge: str) -> None:
    entries = spark.createDataFrame([(version, b, merge) for b in buckets] or [(version, None, None)], _MANIFEST)
    entries.coalesce(1).write.mode("error").json(f"{path}/manifest/{version:012d}")


def _current(spark: SparkSession, path: str) -> tuple[int, dict[int, str]]:
    """The last version, and by bucket the merge that wrote it last. At most one entry a bucket goes to the driver."""
    entries = spark.read.schema(_MANIFEST).option("recursiveFileLookup", True).json(f"{path}/manifest")
    last = entries.groupBy("bucket").agg(F.max("version").alias("version"), F.max_by("merge", "version").alias("merge")).collect()
    return max(r["version"] for r in last), {r["bucket"]: r["merge"] for r in last if r["bucket"] is not None}


def _settings(spark: SparkSession, path: str) -> Row:
    return spark.read.schema(_SETTINGS).json(f"{path}/settings").first()


def _rows(spark: SparkSession, path: str, schema: T.StructType, places: dict[int, str]) -> DataFrame:
    if not places:
        return spark.createDataFrame([], schema)
    folders = [f"{path}/rows/{merge}/bucket={bucket}" for bucket, merge in sorted(places.items())]
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(*folders)


def read(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the table, one for each key."""
    schema = T.StructType.fromJson(json.loads(_settings(spark, path)["columns"]))
    return _rows(spark, path, schema, _current(spark, path)[1])


def merged(old: DataFrame, batch: DataFrame, key: str, order: Sequence[str], title: str = "article_title") -> DataFrame:
    """One row per key of both frames, each of which has one row per key already: that which ``dedup_by`` keeps.

    A batch of at most ``session.BROADCAST_ROWS`` rows is sent to the old rows, which stay where they are; with a larger
    one, both are shuffled.
    """
    if batch.limit(session.BROADCAST_ROWS + 1).count() > session.BROADCAST_ROWS:
        return dedup_by(old.unionByName(batch), key, order, title)
    columns = old.columns
    other, place = unused_name("key_of_batch", columns), unused_name("place_of_batch", columns)
    place_of = dedup_place(columns, key, order, title)
    coming = batch.select(F.col(key).alias(other), place_of.alias(place))
    same = F.col(key).eqNullSafe(F.col(other))
    both = old.join(F.broadcast(coming), same, "left").withColumn(place, F.least(place_of, F.col(place)))
    met = old.select(F.col(key).alias(other)).join(F.broadcast(coming.withColumnRenamed(other, key)), same, "left_semi")
    fresh = batch.join(F.broadcast(met), same, "left_anti")  # no more than the batch has keys
    return both.select(*dedup_columns(columns, key, place)).unionByName(fresh.select(*columns))


def merge(batch: DataFrame, path: str) -> list[int]:
    """Add a batch; returns the buckets that were written anew.

    The batch needs the table's columns, others are ignored. Its own duplicates, keys that the table has already, null keys
    (one key) and rows without a title are treated as by ``dedup_by`` over all batches so far. An empty batch changes nothing.
    """
    spark = batch.sparkSession
    fixed = _settings(spark, path)
    schema = T.StructType.fromJson(json.loads(fixed["columns"]))
    key, order, title = fixed["key"], fixed["sorted_by"], fixed["title"]
    first = reliable_checkpoint(dedup_by(batch.select(*schema.names), key, order, title))
    bucket = F.pmod(F.xxhash64(key), F.lit(fixed["buckets"])).cast("int")
    touched = sorted(r[0] for r in first.select(bucket).distinct().collect())
    if not touched:
        return []
    version, places = _current(spark, path)
    old = _rows(spark, path, schema, {b: places[b] for b in touched if b in places})
    name = uuid.uuid4().hex
    whole = merged(old, first, key, order, title) if set(touched) & set(places) else first
    whole.withColumn("bucket", bucket).write.mode("error").partitionBy("bucket").parquet(f"{path}/rows/{name}")
    _commit(spark, path, version + 1, touched, name)
    return touched
