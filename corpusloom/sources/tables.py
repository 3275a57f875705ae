"""Tables in and out: Parquet by month, JSON, CSV, XML, a source of feeds, and the schemas and rules of base tables."""

from __future__ import annotations

import datetime
import re
import time
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMAS = {
    "entities": "entity_id bigint, canonical_name string, aliases array<string>, entity_type string, is_active boolean",
    "raw_texts": "doc_id bigint, source string, source_id string, title string, source_url string, text string, content_hash string, metadata map<string,string>, status string, content_type string, ingested_at timestamp, ingested_month date",
    "mentions": "doc_id bigint, entity_id bigint, mention string, start int, end int",
    "contexts": "doc_id bigint, entity_id bigint, context string, quality_score int",
    "scores": "doc_id bigint, entity_id bigint, score_negative double, score_neutral double, score_positive double, label string, confidence double, model_version string, scored_at timestamp, scored_month date",
    "highlights": "entity_id bigint, doc_id bigint, polarity string, title string, confidence double, published_at timestamp",
    "runs": "worker string, started timestamp, finished timestamp, processed bigint, succeeded bigint, failed bigint, status string",
}
STATUSES = ("pending", "enriched", "validated", "failed", "queued", "processing", "processed", "skipped")
LABELS = ("negative", "neutral", "positive")


def rules(table: str) -> dict[str, Column]:
    """What must hold in a base table, by name; for merge.violations."""
    unit = lambda c: F.col(c).between(0, 1)
    return {
        "raw_texts": {"status": F.col("status").isin(*STATUSES), "text_present": F.col("text").isNotNull(), "id_present": F.col("doc_id").isNotNull()},
        "scores": {"label": F.col("label").isin(*LABELS)} | {c: unit(c) for c in ("score_negative", "score_neutral", "score_positive", "confidence")},
        "entities": {"name_present": F.length(F.coalesce("canonical_name", F.lit(""))) > 0},
    }.get(table, {})


def with_month(table: DataFrame, at: str, month: str) -> DataFrame:
    """The partition column, derived before the write."""
    return table.withColumn(month, F.trunc(F.col(at).cast("date"), "MM"))


def write_by_month(table: DataFrame, path: str, at: str, month: str, mode: str = "append") -> None:
    """Directories by month, rows in order of time within a file. Overwriting replaces only months that the table has."""
    x = with_month(table, at, month)
    x.repartition(month, F.pmod(F.xxhash64(*[c for c in x.columns if c not in (month,) and dict(x.dtypes)[c] in ("bigint", "string")][:1]), 16)).sortWithinPartitions(month, at).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(month).parquet(path)


def _files(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def months(spark: SparkSession, path: str, month: str) -> list[str]:
    """The months that a partitioned table has folders for, ascending."""
    folder, files = _files(spark, f"{path}/{month}=*")
    return sorted(f.getPath().getName().split("=", 1)[1] for f in files.globStatus(folder) or ())


def create_months(spark: SparkSession, path: str, month: str, as_of: str, ahead: int = 3) -> list[str]:
    """Empty folders for this month and those that follow."""
    first = datetime.date.fromisoformat(as_of).replace(day=1)
    made = [f"{first.year + (first.month - 1 + k) // 12:04}-{(first.month - 1 + k) % 12 + 1:02}-01" for k in range(ahead + 1)]
    for m in made:
        folder, files = _files(spark, f"{path}/{month}={m}")
        files.mkdirs(folder)
    return made


def drop_months(spark: SparkSession, path: str, month: str, as_of: str, keep: int = 6) -> list[str]:
    """Remove the folders of months before the `keep` ones that precede this month; which went."""
    now = datetime.date.fromisoformat(as_of)
    number = now.year * 12 + now.month - 1 - keep
    first = f"{number // 12:04}-{number % 12 + 1:02}-01"
    gone = [m for m in months(spark, path, month) if m < first]
    for m in gone:
        folder, files = _files(spark, f"{path}/{month}={m}")
        files.delete(folder, True)
    return gone


def read_since(spark: SparkSession, path: str, at: str, month: str, first: str) -> DataFrame:
    """Rows from a day on. The predicate on the partition column goes beside that on the time, so other months are not listed."""
    return spark.read.parquet(path).where((F.col(month) >= F.trunc(F.to_date(F.lit(first)), "MM")) & (F.col(at) >= F.to_date(F.lit(first))))


def read_json_records(spark: SparkSession, column: DataFrame, schema: str) -> DataFrame:
    """Rows of a column `items` that holds JSON lists."""
    return column.select(F.explode(F.from_json("items", f"array<struct<{schema}>>")).alias("r")).select("r.*")


def read_csv(spark: SparkSession, path: str, seps: tuple[str, ...] = (",", ";", "\t", "|")) -> DataFrame:
    """A CSV with header whose separator is the one its first line has most of; a byte-order mark and bad lines are dropped."""
    head = spark.read.text(path).limit(1).collect()
    sep = max(seps, key=lambda s: head[0][0].count(s)) if head else ","
    x = spark.read.option("header", True).option("sep", sep).option("mode", "DROPMALFORMED").option("multiLine", True).csv(path)
    return x.toDF(*[c.lstrip("﻿").strip('"') for c in x.columns])


def write_csv(table: DataFrame, path: str, mark: bool = True) -> None:
    """All fields quoted, with a byte-order mark in front of the header."""
    names = [("﻿" if mark and k == 0 else "") + c for k, c in enumerate(table.columns)]
    table.toDF(*names).write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def write_json(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").json(path)


def read_xml(spark: SparkSession, path: str, row_tag: str = "item") -> DataFrame:
    return spark.read.format("xml").option("rowTag", row_tag).load(path)


class _Feeds(InputPartition):
    def __init__(self, feeds: list[tuple[str, str]]):
        self.feeds = feeds


class _FeedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[_Feeds]:
        """Addresses of a host are dealt to so many partitions at most, each of which asks for one after the other."""
        most, lanes = int(self.options.get("perhost", 2)), {}
        for name, url in zip(self.options.get("names", "").split("\n"), self.options.get("urls", "").split("\n")):
            if url:
                host = urllib.parse.urlsplit(url).netloc
                lanes.setdefault(host, []).append((name, url))
        return [_Feeds(feeds[k::most]) for feeds in lanes.values() for k in range(min(most, len(feeds)))]

    def read(self, partition: _Feeds) -> Iterator[tuple]:
        for name, url in partition.feeds:
            yield self._one(name, url)

    def _one(self, name: str, url: str) -> tuple:
        """The body, or the last error after pauses that double from try to try."""
        tries, pause = int(self.options.get("tries", 3)), float(self.options.get("pause", 1))
        for k in range(tries):
            try:
                with urllib.request.urlopen(url, timeout=float(self.options.get("timeout", 12))) as answer:
                    return name, url, answer.read().decode("utf-8", "replace"), None
            except OSError as e:
                error = str(e)
                if k + 1 < tries:
                    time.sleep(pause * 2**k)
        return name, url, None, error


class FeedSource(DataSource):
    """Bodies of addresses, at most two of a host at a time; one that does not answer in several tries gives a row with the error."""

    @classmethod
    def name(cls) -> str:
        return "feeds"

    def schema(self) -> str:
        return "config_name string, url string, xml string, error string"

    def reader(self, schema) -> _FeedReader:
        return _FeedReader(self.options)


def fetch_feeds(spark: SparkSession, feeds: list[tuple[str, str]], **options) -> DataFrame:
    """config_name, url, xml, error of feeds(name, url). options: tries, pause, timeout, perhost."""
    spark.dataSource.register(FeedSource)
    x = spark.read.format("feeds").option("names", "\n".join(n for n, _ in feeds)).option("urls", "\n".join(u for _, u in feeds))
    return x.options(**options).load()


def read_seed(spark: SparkSession, statement: str) -> DataFrame:
    """The rows of an INSERT INTO table (columns) VALUES ... statement, with ARRAY[...] and doubled quotes as another dialect writes them."""
    found = re.search(r"(?is)INSERT\s+INTO\s+[\w.\"]+\s*\(([^)]*)\)\s*VALUES\s*(.*?)(?:\s+ON\s+CONFLICT\b.*)?;?\s*$", re.sub(r"(?m)^\s*--.*$", "", statement))
    if not found:
        raise ValueError("not an INSERT with VALUES")
    out = []
    # Strings apart from what stands between them, so that brackets and marks inside strings stay.
    for k, part in enumerate(re.split(r"('(?:[^']|'')*')", found[2])):
        if k % 2:
            out.append('"' + part[1:-1].replace("''", "'").replace("\\", "\\\\").replace('"', '\\"') + '"')
        else:
            bare = re.sub(r"::\s*\w+(?:\[\])?", "", part)
            out.append(re.sub(r"(?i)ARRAY\s*\[", "array(", bare).replace("]", ")"))
    columns = ", ".join(c.strip().strip('"') for c in found[1].split(","))
    return spark.sql(f"SELECT * FROM VALUES {''.join(out)} AS seed({columns})")
