"""Streaming twins of batch operators: incremental runs that read what is new, and results as snapshots.

Each job takes a stream, a folder for results and checkpoints that all workers share, and runs until nothing is left.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import dedup, serving


def work_dir(spark: SparkSession) -> str:
    """A fresh folder in the one that the cluster shares; a local one only where none is set."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not at and held.isDefined():
        at = held.get()
    if not at and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{(at or tempfile.mkdtemp(prefix='loom-')).rstrip('/')}/stream-{uuid.uuid4().hex}"


def batches(spark: SparkSession, at: str) -> list[int]:
    """Numbers of the batches whose results are complete, ascending: what is on disk is all that a restart needs to know."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{at}/out/batch=*/_SUCCESS")
    found = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(folder)
    return sorted(int(f.getPath().getParent().getName().removeprefix("batch=")) for f in found or ())


def read(spark: SparkSession, path: str, files: int = 16) -> DataFrame:
    """A stream of the Parquet files of a folder or pattern, so many in a batch. Times without zone become instants, as watermarks need."""
    schema = spark.read.parquet(path).schema
    # As a pattern it may be a single file as well as a folder.
    pattern = path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"
    x = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(pattern)
    for f in schema:
        if f.dataType.typeName() == "timestamp_ntz":
            x = x.withColumn(f.name, F.col(f.name).cast("timestamp"))
    return x


def run(stream: DataFrame, at: str, mode: str, each: Callable[[DataFrame, int], None]) -> None:
    """Work off what there is. A batch that is repeated after a failure writes to the same place, so nothing counts twice."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).foreachBatch(each).start().awaitTermination()


def snapshot(stream: DataFrame, at: str) -> DataFrame:
    """The last complete result of an aggregate."""
    run(stream, at, "complete", lambda batch, k: batch.write.mode("overwrite").parquet(f"{at}/out/batch={k}"))
    return _last(stream, at)


def _last(stream: DataFrame, at: str) -> DataFrame:
    done = batches(stream.sparkSession, at)
    return stream.sparkSession.read.parquet(f"{at}/out/batch={done[-1]}") if done else stream.sparkSession.createDataFrame([], stream.schema)


def appended(stream: DataFrame, at: str) -> DataFrame:
    """All rows that a stream has emitted."""
    spark, schema = stream.sparkSession, stream.schema

    def each(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/batch={k}")

    run(stream, at, "append", each)
    return spark.read.schema(schema).parquet(f"{at}/out/*") if batches(spark, at) else spark.createDataFrame([], schema)


def distinct(stream: DataFrame, keys: list[str], time: str | None = None, late: str = "30 days") -> DataFrame:
    """First row of each key. With a time, state is dropped once the watermark has passed: a copy that comes later than that is let through."""
    return stream.dropDuplicates(keys) if time is None else stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def tumbling(stream: DataFrame, time: str, size: str, keys: list[str], late: str = "30 days") -> DataFrame:
    x = stream.withWatermark(time, late).groupBy(F.window(time, size).alias("w"), *keys).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return x.select(F.col("w.start").cast("timestamp_ntz").alias("start"), *keys, "n", "total")


def sessions(stream: DataFrame, time: str, gap: str, key: str, late: str = "30 days") -> DataFrame:
    x = stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return x.select(key, F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


def daily_scores(stream: DataFrame, least: float = 0.6) -> DataFrame:
    """The dashboard roll-up of a stream of scores, without names."""
    x = stream.where((F.col("confidence") >= least) & F.col("entity_id").isNotNull())
    return x.groupBy("entity_id", F.to_date("scored_at").alias("day")).agg(F.count("*").alias("mentions"), F.round(F.avg(F.col("score_positive") - F.col("score_negative")), 4).alias("avg_polarity"))


def retries(stream: DataFrame, key: str, most: int = 3) -> DataFrame:
    """key, attempts, status after each batch that has failures of a key; the count is kept as state."""

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = (state.get[0] if state.exists else 0) + sum(len(p) for p in parts)
        state.update((n,))
        yield pd.DataFrame({key: [k[0]], "attempts": [n], "status": ["failed" if n >= most else "pending"]})

    return stream.groupBy(key).applyInPandasWithState(step, f"{key} bigint, attempts bigint, status string", "attempts bigint", "append", GroupStateTimeout.NoTimeout)


def top_of_each(stream: DataFrame, at: str, keys: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each group over all batches: ranks are not streamable, so each batch is merged with the last snapshot."""
    spark = stream.sparkSession

    def each(batch: DataFrame, k: int) -> None:
        before = [n for n in batches(spark, at) if n < k]
        x = batch.unionByName(batch.sparkSession.read.parquet(f"{at}/out/batch={before[-1]}")) if before else batch
        x = x.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")
        x.write.mode("overwrite").parquet(f"{at}/out/batch={k}")

    run(stream, at, "append", each)
    return _last(stream, at)


def spike_alerts(stream: DataFrame, at: str, back: int = 7, sigmas: float = 3.0) -> DataFrame:
    """Daily counts by entity with the mean and deviation of the days before, kept up to date as scores come in: counts are merged batch by batch, alerts are drawn from them."""
    spark, kind = stream.sparkSession, "entity_id bigint, day date, n bigint"

    def each(batch: DataFrame, k: int) -> None:
        before = [n for n in batches(spark, at) if n < k]
        x = batch.where("entity_id IS NOT NULL").groupBy("entity_id", F.to_date("scored_at").alias("day")).agg(F.count("*").alias("n"))
        x = x.unionByName(batch.sparkSession.read.schema(kind).parquet(f"{at}/out/batch={before[-1]}")) if before else x
        x.groupBy("entity_id", "day").agg(F.sum("n").alias("n")).write.mode("overwrite").parquet(f"{at}/out/batch={k}")

    run(stream, at, "append", each)
    done = batches(spark, at)
    return serving.spikes(spark.read.schema(kind).parquet(f"{at}/out/batch={done[-1]}") if done else spark.createDataFrame([], kind), back, sigmas)


def ingest(stream: DataFrame, at: str, registry: str, order: str = "doc_id") -> DataFrame:
    """Exact de-duplication across batches against a stored registry of hashes: counts by batch. A repeated batch finds its own hashes apart."""
    spark = stream.sparkSession

    def each(batch: DataFrame, k: int) -> None:
        known = batch.sparkSession.read.schema("text_hash string, batch int").option("recursiveFileLookup", "false").parquet(registry).where(F.col("batch") < k).select("text_hash") if k else batch.sparkSession.createDataFrame([], "text_hash string")
        rows, counts = dedup.insert_new(batch, known, order)
        rows.select("text_hash").write.mode("overwrite").parquet(f"{registry}/batch={k}")
        counts.write.mode("overwrite").parquet(f"{at}/out/batch={k}")

    run(stream, at, "append", each)
    return spark.read.parquet(f"{at}/out/*") if batches(spark, at) else spark.createDataFrame([], "inserted bigint, duplicate bigint")
