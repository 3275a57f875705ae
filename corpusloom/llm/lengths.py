"""Exact histogram of encoded lengths, and what its suffix sums answer for every context limit.

Null text has length 0. An empty table gives an empty histogram. Every row counts, repeated ones too. Very long
texts have long lengths and share a bucket with others of about their size. Only text is read.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import bpe, common

#: Percentages of the documents that the query names at the lengths which they do not exceed.
PERCENTS = (1, 5, 10, 25, 50, 75, 90, 95, 99)


def bucket(length: Column) -> Column:
    """Monotone in length: its highest bit and the six bits below. At most 64 * 64 values, however long texts get."""
    high = F.length(F.bin(length)) - 1
    shift = F.greatest(high - 6, F.lit(0))
    return high * 64 + F.call_function("shiftright", length, shift.cast("int")).bitwiseAND(F.lit(63))


def histogram(docs: DataFrame, path: str | None = None) -> DataFrame:
    """length, n_docs. Summed before the shuffle, which moves a row for each task and length."""
    common.bound_batches(docs.sparkSession)
    return docs.select(bpe.token_count(F.col("text"), path).alias("length")).groupBy("length").agg(F.count("*").alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """For each length as a context limit: documents and tokens at it and beyond, and totals when cut at it.

    Sums run over the few buckets first and then inside each bucket, so no task sees all lengths.
    """
    hist = hist.select("length", "n_docs", bucket(F.col("length")).alias("b"), (F.col("length") * F.col("n_docs")).alias("n_tokens"))
    later = W.orderBy(F.desc("b")).rowsBetween(W.unboundedPreceding, -1)
    totals = hist.groupBy("b").agg(F.sum("n_docs").alias("d"), F.sum("n_tokens").alias("t"))
    total = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing).orderBy("b")
    totals = totals.select(
        "b",
        F.coalesce(F.sum("d").over(later), F.lit(0)).alias("d_above"),
        F.coalesce(F.sum("t").over(later), F.lit(0)).alias("t_above"),
        F.sum("d").over(total).alias("d_all"),
        F.sum("t").over(total).alias("t_all"),
    )
    inside = W.partitionBy("b").orderBy(F.desc("length")).rowsBetween(W.unboundedPreceding, -1)
    x = hist.join(F.broadcast(totals), "b")  # 4096 buckets at most
    x = x.withColumn("docs_longer", F.col("d_above") + F.coalesce(F.sum("n_docs").over(inside), F.lit(0)))
    x = x.withColumn("tokens_longer", F.col("t_above") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return x.select(
        F.col("length").alias("context_limit"),
        "n_docs",
        "n_tokens",
        "docs_longer",
        "tokens_longer",
        (F.col("t_all") - F.col("tokens_longer") + F.col("docs_longer") * F.col("length")).alias("truncated_total"),
        (F.col("tokens_longer") - F.col("docs_longer") * F.col("length")).alias("tokens_lost"),
        (F.col("d_all") - F.col("docs_longer")).alias("docs_within"),
        F.col("d_all").alias("docs_total"),
        F.col("t_all").alias("tokens_total"),
    )


def quantile(sums: DataFrame, q: float) -> DataFrame:
    """The smallest length that at least a share q of the documents do not exceed."""
    share = F.lit(Decimal(str(q))).cast("decimal(18,12)")
    return sums.where(F.col("docs_within") >= share * F.col("docs_total").cast("decimal(20,0)")).agg(F.min("context_limit").alias("length"))


def truncated_total(sums: DataFrame, limit: int) -> DataFrame:
    """Tokens left when each document is cut at limit, for any limit."""
    here = sums.where(F.col("context_limit") <= limit).agg(F.max(F.struct("context_limit", "docs_longer", "truncated_total")).alias("m"))
    return here.select(F.coalesce(F.col("m.truncated_total") + (F.lit(limit) - F.col("m.context_limit")) * F.col("m.docs_longer"), F.lit(0)).alias("tokens")) if limit >= 0 else here.select(F.lit(0).alias("tokens"))


def quantiles(percents: tuple[int, ...] = PERCENTS) -> Column:
    """Of a row of suffix_sums, the percentages whose quantile is its length, comma-joined. Whole numbers throughout."""
    before = F.col("docs_within") - F.col("n_docs")
    return F.concat_ws(",", *[F.when((100 * before < q * F.col("docs_total")) & (100 * F.col("docs_within") >= q * F.col("docs_total")), str(q)) for q in percents])


def op2_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each length that occurs. Null text has length 0; repeated rows count; an empty table has no lengths."""
    sums = suffix_sums(common.stored(histogram(common.table(spark, sf_dir, "documents")), "lengths"))
    return sums.withColumn("quantile_percents", quantiles())
