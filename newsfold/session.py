"""Session helpers."""

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Lookup tables up to this many rows are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 200_000


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that all executors share, named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
            folder = tempfile.mkdtemp(prefix="newsfold-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Checkpoint into the shared folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def unused_name(name: str, taken: list[str]) -> str:
    """The name, lengthened until no column has it."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name += "_"
    return name


def lookup_join(df: DataFrame, table: DataFrame, on: list[str], how: str = "left", salts: int = 32) -> DataFrame:
    """Equi join with a lookup table whose size is checked before it is broadcast.

    A table above ``BROADCAST_ROWS`` is repeated ``salts`` times and joined by
    shuffle, so rows of one hot key spread over ``salts`` tasks. ``how`` is
    "left", "inner" or "left_anti".
    """
    if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return df.join(F.broadcast(table), on, how)
    salt = unused_name("salt", [*df.columns, *table.columns])
    salted = table.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    spread = df.withColumn(salt, F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(salts)).cast("int"))
    return spread.join(salted, [*on, salt], how).drop(salt)


def local_session(cpus: int | str = "*", name: str = "newsfold") -> SparkSession:
    """Session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
