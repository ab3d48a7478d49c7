"""Sharding by extendible hashing.

The hash of a row's key is a string of bits. A bucket is a prefix of bits; it holds the rows whose hash begins with it.
The directory starts with the empty prefix, and only a bucket over the byte limit is split on its next bit. Sizes of all
prefixes down to a depth come from one count per prefix of that depth, so the splits of many levels are decided at once;
buckets that are still too large go on from there with the bits that follow.

Rows with equal keys have equal hashes, and no bit parts them. A bucket at the last bit that is still too large has
overflow shards: its rows are numbered off into chunks by a hash of their other columns.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from llm.frames import BROADCAST_ROWS, column, stored, unused_name

LIMIT = 1 << 20
#: Bits decided at once, and bits of a hash.
STEP, BITS = 16, 64


def hash_bits(key: Column) -> Column:
    """64 bits of the key's MD5, as text; a null key is hashed as such."""
    hexed = F.substring(F.md5(F.coalesce(F.concat(F.lit("k"), key.cast("string")), F.lit("null")).cast("binary")), 1, 16)
    halves = [F.lpad(F.conv(F.substring(hexed, a, 8), 16, 2), 32, "0") for a in (1, 9)]
    return F.concat(*halves)


def _leaves(cells: DataFrame, start: int, stop: int, limit: int) -> DataFrame:
    """Buckets of the cells' trees between depths ``start`` and ``stop``: prefix and bytes.

    ``cells``: prefix of ``stop`` bits, bytes, rows; their trees begin at prefixes of ``start`` bits that are too large
    (or at the root). Prefixes that don't fit at ``stop`` are among the buckets too.
    """
    depths = F.sequence(F.lit(start), F.lit(stop))
    nodes = cells.select(F.explode(depths).alias("depth"), "prefix", "bytes").groupBy("depth", F.expr("substring(prefix, 1, depth)").alias("node"))
    nodes = nodes.agg(F.sum("bytes").alias("bytes"))
    # A node is a bucket if it fits, or is as deep as it goes, and the node above doesn't fit.
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"), F.col("bytes").alias("above"))
    both = nodes.withColumn("parent", F.expr("substring(node, 1, depth - 1)")).join(above, ["depth", "parent"], "left")
    too_large_above = F.coalesce(F.col("above") > limit, F.lit(True))
    return both.filter(((F.col("bytes") <= limit) | (F.col("depth") == stop)) & too_large_above).select(F.col("node").alias("bucket"), F.col("depth"), "bytes")


def directory(sized: DataFrame, limit: int, step: int = STEP, bits: int = BITS) -> list[tuple[int, DataFrame]]:
    """Levels of the directory for rows with ``bits`` and ``bytes``: a depth, and for each prefix of that depth its bucket.

    A level has entries only for what the level above found too large. Each entry: prefix, bucket, bucket_bytes, open
    (still too large).
    """
    levels, todo, start = [], sized, 0
    while True:
        stop = min(bits, start + step)
        cells = stored(todo.groupBy(F.substring("bits", 1, stop).alias("prefix")).agg(F.sum("bytes").alias("bytes")))
        leaves = stored(_leaves(cells, start, stop, limit))
        depths = [r.depth for r in leaves.select("depth").distinct().collect()]  # at most step + 1
        entries = None
        for depth in depths:
            own = leaves.filter(F.col("depth") == depth)
            part = cells.select("prefix", F.substring("prefix", 1, depth).alias("bucket")).join(own.select("bucket", F.col("bytes").alias("bucket_bytes")), "bucket")
            entries = part if entries is None else entries.unionByName(part)
        if entries is None:
            return levels
        entries = stored(entries.select("prefix", "bucket", "bucket_bytes", ((F.col("bucket_bytes") > limit) & (F.length("bucket") == stop)).alias("open")))
        levels.append((stop, entries))
        large = entries.filter("open").select("prefix")
        if stop == bits or large.isEmpty():
            return levels
        todo = todo.withColumn("prefix", F.substring("bits", 1, stop)).join(_small(large), "prefix", "left_semi").drop("prefix")
        start = stop


def _small(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else table


def shard(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT, carry: list[str] | None = None, bits: int = BITS) -> DataFrame:
    """``docs`` with ``shard`` (bits of its prefix, then ``-n`` in overflow shards), ``depth``, ``n_bytes``, ``shard_bytes``.

    ``n_bytes`` is the UTF-8 size of the text, 0 if null. Every shard holds at most ``limit`` bytes, except that a row
    larger than that is a shard of its own or ends one. Rows with equal or null keys share a bucket; what overflows at the
    last bit is chunked by its other columns. Equal rows may go to different chunks. Columns in ``carry`` (None: all) stay,
    except those named like the new ones, which are replaced. An empty table gives an empty table.
    """
    new = ("shard", "depth", "n_bytes", "shard_bytes")
    kept = [c for c in (docs.columns if carry is None else carry) if c.lower() not in new]
    size = F.coalesce(F.octet_length(column(text)), F.lit(0)).cast("long")
    own, prefix, bucket, found = (unused_name(c, kept) for c in ("bits_of_key", "bits_prefix", "bits_bucket", "bits_bytes"))
    rows = docs.select(*[column(c) for c in kept], F.substring(hash_bits(column(key)), 1, bits).alias(own), size.alias("n_bytes"))
    levels = directory(rows.select(F.col(own).alias("bits"), F.col("n_bytes").alias("bytes")), limit, bits=bits)
    rows = rows.withColumn("shard", F.lit(None).cast("string")).withColumn("shard_bytes", F.lit(0).cast("long"))
    for depth, entries in levels:
        named = entries.select(F.col("prefix").alias(prefix), F.col("bucket").alias(bucket), F.col("bucket_bytes").alias(found))
        rows = rows.withColumn(prefix, F.substring(own, 1, depth)).join(_small(named), prefix, "left")
        rows = rows.withColumn("shard", F.coalesce(bucket, "shard")).withColumn("shard_bytes", F.coalesce(found, "shard_bytes")).drop(prefix, bucket, found)
    rows = rows.withColumn("depth", F.length("shard").cast("int")).drop(own)
    if levels and levels[-1][0] == bits and not levels[-1][1].filter("open").isEmpty():
        return _overflow(rows, kept, limit, bits)
    return rows.select(*[column(c) for c in kept], *new)


def _overflow(rows: DataFrame, kept: list[str], limit: int, bits: int) -> DataFrame:
    """Full buckets at the last bit in chunks within the limit: running sizes per partition, then over partitions.

    Rows are numbered where they lie, after being written once; no bucket meets in one task.
    """
    new = ("shard", "depth", "n_bytes", "shard_bytes")
    full = (F.col("depth") == bits) & (F.col("shard_bytes") > limit)
    # Chunk numbers are per part, so that a part's rows fill their own chunks.
    names = [column(c) for c in kept]
    part, row, upto = (unused_name(c, kept) for c in ("part_of_row", "row_of_part", "upto_row"))
    parts = stored(rows.filter(full).withColumn(part, F.spark_partition_id()))
    lying = parts.withColumn(row, F.monotonically_increasing_id())
    order = Window.partitionBy("shard", part).orderBy(row).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = lying.withColumn(upto, F.sum("n_bytes").over(order))
    # A chunk is what ends in the same half limit; with one row of up to half the limit more it still fits.
    half = max(1, limit // 2)
    large = F.col("n_bytes") > half
    chunk = F.concat_ws("-", "shard", F.col(part).cast("string"), F.when(large, F.concat(F.lit("r"), F.col(row).cast("string"))).otherwise(F.floor((F.col(upto) - F.col("n_bytes")) / half).cast("string")))
    chunked = stored(running.withColumn("shard", chunk).select(*names, "shard", "depth", "n_bytes"))
    sizes = chunked.groupBy("shard").agg(F.sum("n_bytes").alias("shard_bytes"))
    return rows.filter(~full).select(*names, *new).unionByName(chunked.join(sizes, "shard").select(*names, *new))


def write_shards(sharded: DataFrame, path: str) -> None:
    """The shards as Parquet folders ``shard=...``; rows of a shard are brought together and written by one task each.

    What comes together is at most the byte limit of a shard, or one longer row.
    """
    sharded.repartition("shard").sortWithinPartitions("shard").write.partitionBy("shard").mode("overwrite").parquet(path)


def read_shards(spark: SparkSession, path: str, schema: T.StructType, text: str = "text") -> DataFrame:
    """Rows of written shards: the columns of ``schema`` (those of the written rows but ``shard``), and ``shard``.

    ``depth``, ``n_bytes`` and ``shard_bytes`` are found anew: from the folder's name, the text as read, and all the rows
    of the folder. The names of the root and of its overflow shards have no bits.
    """
    found = ("shard", "depth", "n_bytes", "shard_bytes")
    kept = [f for f in schema.fields if f.name.lower() not in found]
    rows = spark.read.schema(T.StructType([*kept, T.StructField("shard", T.StringType())])).parquet(path)
    size = F.coalesce(F.octet_length(column(text)), F.lit(0)).cast("long")
    rows = rows.withColumn("shard", F.coalesce("shard", F.lit(""))).withColumn("n_bytes", size)
    sizes = rows.groupBy("shard").agg(F.sum("n_bytes").alias("shard_bytes"))
    depth = F.length(F.substring_index("shard", "-", 1)).cast("int")
    return rows.join(_small(sizes), "shard").withColumn("depth", depth).select(*[column(f.name) for f in kept], *found)
