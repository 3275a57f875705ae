"""What dashboards read: roll-ups, highlights, rankings, series and alerts. All take `as_of` as a date in text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import merge

#: Dictionaries up to so many rows are sent to all workers; larger ones are joined as the optimiser sees fit.
SMALL_ROWS = 100_000
#: Columns that may leave the engine.
PUBLIC = ("doc_id", "title", "lang", "source", "source_url", "published_at", "entity_id", "canonical_name", "day", "mentions", "positive_count", "negative_count", "neutral_count", "avg_polarity")


def _small(table: DataFrame) -> DataFrame:
    """A broadcast hint only behind a look at the size."""
    return F.broadcast(table) if table.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else table


def polarity() -> Column:
    return F.col("score_positive") - F.col("score_negative")


def dashboard(scores: DataFrame, entities: DataFrame, as_of: str, days: int = 90, least: float = 0.6) -> DataFrame:
    """Counts by label and mean polarity of each entity and day. Scores without entity drop out in the join."""
    x = merge.recent(scores, "scored_at", as_of, days).where(F.col("confidence") >= least).where("entity_id IS NOT NULL")
    by = x.groupBy("entity_id", F.to_date("scored_at").alias("day")).agg(
        F.count("*").alias("mentions"),
        *[F.count_if(F.col("label") == name).alias(f"{name}_count") for name in ("positive", "negative", "neutral")],
        F.round(F.avg(polarity()), 4).alias("avg_polarity"),
    )
    return by.join(_small(entities.select("entity_id", "canonical_name")), "entity_id")


def highlights(scores: DataFrame, docs: DataFrame, as_of: str, n: int = 5, days: int = 30, least: float = 0.7) -> DataFrame:
    """The n most confident positive and negative scores of each entity; the newest first on ties. A snapshot, so nothing stale stays."""
    by = W.partitionBy("entity_id", "polarity").orderBy(F.desc("confidence"), F.desc_nulls_last("scored_at"), "event_id")
    x = merge.recent(scores, "scored_at", as_of, days).where(F.col("entity_id").isNotNull() & F.col("label").isin("positive", "negative") & (F.col("confidence") >= least))
    x = x.withColumnRenamed("label", "polarity").withColumn("rn", F.row_number().over(by).cast("bigint")).where(F.col("rn") <= n)
    return x.join(docs.select("doc_id"), "doc_id", "left_semi").select("entity_id", "polarity", "doc_id", "event_id", "confidence", "rn")


def read_highlights(table: DataFrame, entity_id: int, polarity: str | None = None, n: int = 10, at: str = "published_at") -> DataFrame:
    """Highlights of an entity, by polarity and the newest first."""
    x = table.where(F.col("entity_id") == entity_id)
    x = x if polarity is None else x.where(F.col("polarity") == polarity)
    return x.orderBy("polarity", F.desc_nulls_last(at), "event_id").limit(n)


def series(scores: DataFrame, as_of: str, days: int, unit: str = "day", entity_id: int | None = None, least: float = 0.0) -> DataFrame:
    """Mean polarity by entity (null: the national index) and period."""
    x = merge.recent(scores, "scored_at", as_of, days).where(F.col("confidence") >= least)
    x = x if entity_id is None else x.where(F.col("entity_id") == entity_id)
    return x.groupBy("entity_id", F.to_date(F.date_trunc(unit, "scored_at")).alias(unit)).agg(F.count("*").alias("n"), F.round(F.avg(polarity()), 4).alias("polarity"))


def ranking(scores: DataFrame, as_of: str, days: int = 7, least: float = 0.6) -> DataFrame:
    """Entities by mean polarity. The rank runs over one row for each entity."""
    x = merge.recent(scores, "scored_at", as_of, days).where((F.col("confidence") >= least) & F.col("entity_id").isNotNull())
    x = x.groupBy("entity_id").agg(F.count("*").alias("n"), F.round(F.avg(polarity()), 4).alias("score"))
    return x.withColumn("rank", F.dense_rank().over(W.orderBy(F.desc("score"))).cast("bigint"))


def hotness(scores: DataFrame, as_of: str) -> DataFrame:
    week = F.col("scored_at") >= F.date_sub(F.to_date(F.lit(as_of)), 7)
    return merge.recent(scores, "scored_at", as_of, 30).where("entity_id IS NOT NULL").groupBy("entity_id").agg(F.count_if(week).alias("mentions_7d"), F.count("*").alias("mentions_30d"))


def trend(scores: DataFrame, drop: float = 0.1) -> DataFrame:
    """Weekly polarity of each entity, its change, and whether it fell by more than `drop`."""
    x = scores.where("entity_id IS NOT NULL").groupBy("entity_id", F.to_date(F.date_trunc("week", "scored_at")).alias("week")).agg(F.round(F.avg(polarity()), 4).alias("polarity"))
    change = F.col("polarity") - F.lag("polarity").over(W.partitionBy("entity_id").orderBy("week"))
    return x.withColumn("change", F.round(change, 4)).withColumn("drop_alert", F.coalesce(change < -drop, F.lit(False)))


def head_to_head(scores: DataFrame, left: int, right: int) -> DataFrame:
    """Weekly polarity and counts of two entities side by side."""
    sides = (("left", left), ("right", right))
    x = scores.where(F.col("entity_id").isin(left, right)).groupBy(F.to_date(F.date_trunc("week", "scored_at")).alias("week"))
    return x.agg(*[F.round(F.avg(F.when(F.col("entity_id") == i, polarity())), 4).alias(f"{n}_polarity") for n, i in sides], *[F.count_if(F.col("entity_id") == i).alias(f"{n}_n") for n, i in sides])


def refresh_dashboard(stored: DataFrame, scores: DataFrame, entities: DataFrame, as_of: str, back: int = 2, days: int = 90) -> DataFrame:
    """The stored roll-up with the last `back` days made anew and days that have fallen out dropped."""
    first = F.date_sub(F.to_date(F.lit(as_of)), back)
    kept = merge.expire(stored, "day", as_of, days).where(F.col("day") < first)
    return kept.unionByName(dashboard(scores, entities, as_of, back).where(F.col("day") >= first))


def refresh_highlights(stored: DataFrame, scores: DataFrame, docs: DataFrame, as_of: str, n: int = 5, days: int = 30) -> DataFrame:
    """stored(entity_id, doc_id, polarity, confidence, published_at) without what has expired, updated and extended by today's best of each entity and polarity."""
    fresh = highlights(scores, docs, as_of, n, days).join(scores.select("event_id", F.col("scored_at").alias("published_at")), "event_id")
    fresh = merge.latest(fresh, ["entity_id", "doc_id"], F.struct("confidence", "published_at", "event_id")).select(*stored.columns)
    return merge.upsert(merge.expire(stored, "published_at", as_of, days), fresh, ["entity_id", "doc_id"], ["confidence"])


def spikes(daily: DataFrame, back: int = 7, sigmas: float = 3.0) -> DataFrame:
    """daily(entity_id, day, n) with the mean and deviation of the days before, and whether a day stands out."""
    by = W.partitionBy("entity_id").orderBy("day").rowsBetween(-back, -1)
    x = daily.withColumn("mean", F.avg("n").over(by)).withColumn("sd", F.stddev_samp("n").over(by))
    return x.withColumn("spike", F.col("n") > F.col("mean") + sigmas * F.col("sd"))


def health(rows: DataFrame, status: Column, at: str, as_of: str) -> DataFrame:
    """status, n, oldest, newest, n_old (older than a day on as_of): what a look at a queue or a table tells."""
    old = F.col(at) < F.date_sub(F.to_date(F.lit(as_of)), 1)
    return rows.groupBy(status.alias("status")).agg(F.count("*").alias("n"), F.min(at).alias("oldest"), F.max(at).alias("newest"), F.count_if(old).alias("n_old"))


def public(table: DataFrame, allowed: tuple[str, ...] = PUBLIC) -> DataFrame:
    """Only columns of the allow-list; texts and raw scores never pass."""
    return table.select(*[c for c in table.columns if c in allowed])
