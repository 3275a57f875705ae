"""Two-stage scoring behind one interface, with a deterministic lexicon scorer as the model at hand."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V

#: Scores of an error.
NEUTRAL = (0.33, 0.34, 0.33)


def lexicon_scores(positive: tuple[str, ...] = V.POSITIVE, negative: tuple[str, ...] = V.NEGATIVE) -> Callable[[Column], Column]:
    """A scorer: struct of neg, neu, pos that add up to 1, from the number of words that occur."""

    def score(text: Column) -> Column:
        low = F.lower(F.coalesce(text, F.lit("")))
        p, n = T.hits(low, positive).cast("double"), T.hits(low, negative).cast("double")
        total = p + n + 1
        return F.struct((n / total).alias("neg"), (F.lit(1.0) / total).alias("neu"), (p / total).alias("pos"))

    return score


def mention_relevancy(entity: Column, context: Column) -> Column:
    """A relevancy model: how much of an entity's name a context holds; 0 if either is missing."""
    return F.coalesce(T.overlap_ratio(T.token_set(entity), T.token_set(context)), F.lit(0.0))


def labelled(rows: DataFrame, triple: Column) -> DataFrame:
    """rows with label (first of neg, neu, pos on ties), confidence, polarity and entropy of a score triple. A missing triple is neutral."""
    x = rows.withColumn("_t", F.coalesce(triple, F.struct(*[F.lit(v).alias(n) for v, n in zip(NEUTRAL, ("neg", "neu", "pos"))])))
    neg, neu, pos = F.col("_t.neg"), F.col("_t.neu"), F.col("_t.pos")
    label = F.when((neg >= neu) & (neg >= pos), "negative").when(neu >= pos, "neutral").otherwise("positive")
    x = x.withColumn("label", label).withColumn("confidence", F.greatest(neg, neu, pos)).withColumn("polarity", pos - neg).withColumn("entropy", T.entropy(neg, neu, pos))
    return x.withColumn("score_negative", neg).withColumn("score_neutral", neu).withColumn("score_positive", pos).drop("_t")


def normal_label(raw: Column) -> Column:
    """Model labels under their usual names; unknown ones are neutral."""
    names = {"label_0": "negative", "label_1": "neutral", "label_2": "positive", "negative": "negative", "neutral": "neutral", "positive": "positive", "neg": "negative", "neu": "neutral", "pos": "positive"}
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.lower(F.trim(raw))), F.lit("neutral"))


def guards(docs: DataFrame, contexts: DataFrame, relevancy: Callable[[Column, Column], Column] = mention_relevancy, least_doc: int = 50, least_context: int = 10, gate: float = 0.5) -> DataFrame:
    """kind (document or context), reason and number: what scoring takes and what it skips, and why."""
    x = docs.select(F.lit("document").alias("kind"), F.when(F.length(F.coalesce("text", F.lit(""))) < least_doc, "too_short").otherwise("scored").alias("reason"))
    why = F.when(F.length(F.coalesce("context", F.lit(""))) < least_context, "too_short").when(F.coalesce(relevancy(F.col("canonical_name"), F.col("context")), F.lit(0.0)) < gate, "not_relevant").otherwise("scored")
    return x.unionByName(contexts.select(F.lit("context").alias("kind"), why.alias("reason"))).groupBy("kind", "reason").agg(F.count("*").alias("n"))


def score_documents(docs: DataFrame, scorer: Callable[[Column], Column], least: int = 50, head: int = 1500) -> DataFrame:
    """The document-level score of the first characters of title and body, with a null entity; short documents are skipped."""
    text = F.trim(F.concat_ws(". ", F.coalesce("title", F.lit("")), F.coalesce("text", F.lit(""))))
    x = docs.where(F.length(F.coalesce("text", F.lit(""))) >= least)
    return labelled(x.withColumn("entity_id", F.lit(None).cast("bigint")), scorer(F.substring(text, 1, head)))


def score_contexts(contexts: DataFrame, scorer: Callable[[Column], Column], relevancy: Callable[[Column, Column], Column] = mention_relevancy, least: int = 10, gate: float = 0.5) -> DataFrame:
    """Scores of the contexts that the relevancy gate lets through; a gate without an answer lets nothing through."""
    x = contexts.where(F.length("context") >= least).withColumn("relevancy", relevancy(F.col("canonical_name"), F.col("context")))
    return labelled(x.where(F.coalesce("relevancy", F.lit(0.0)) >= gate), scorer(F.col("context")))
