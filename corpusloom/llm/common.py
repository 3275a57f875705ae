"""What the operators of this subpackage share: tables, durable intermediate results, caches."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch. A batch of long documents must fit in a Python worker.
BATCH_ROWS = 1000
BATCH_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Hold Arrow batches to BATCH_ROWS and BATCH_BYTES, unless the session asks for less."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(key).rstrip("bB")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, most)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is set."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="loom-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write df into the shared folder and read it again: cuts the lineage and survives lost executors. It goes when the driver ends."""
    spark = df.sparkSession
    at = f"{shared_dir(spark).rstrip('/')}/loom-{what}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(at)
    path, files = folder(spark, at)
    files.deleteOnExit(path)
    out = spark.read.schema(schema).parquet(at)
    out.stored_at = at
    return out


def folder(spark: SparkSession, at: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def discard(df: DataFrame) -> None:
    """Remove a stored table that nothing reads any more."""
    path, files = folder(df.sparkSession, df.stored_at)
    files.delete(path, True)


def fold(key: Column, parts: int) -> Column:
    """crc32 of a key as text, modulo parts; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % parts


class Memo(dict):
    """A cache of at most 2 * most entries in two generations: what the full young one drops stays findable once more."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        value = self.old.pop(key, None)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value
