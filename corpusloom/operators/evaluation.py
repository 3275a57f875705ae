"""Measures of predictions, calibration, samples and curation quotas."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V


def confusion(rows: DataFrame, gold: str = "gold", predicted: str = "predicted") -> DataFrame:
    return rows.groupBy(gold, predicted).agg(F.count("*").alias("n"))


def report(matrix: DataFrame, gold: str = "gold", predicted: str = "predicted") -> DataFrame:
    """class, precision, recall, f1, support from a confusion matrix; 0 where nothing was predicted or there."""
    side = lambda c, n: matrix.groupBy(F.col(c).alias("class")).agg(F.sum("n").alias(n))
    hit = matrix.where(F.col(gold) == F.col(predicted)).select(F.col(gold).alias("class"), F.col("n").alias("tp"))
    x = side(gold, "support").join(side(predicted, "said"), "class", "full").join(hit, "class", "left").fillna(0)
    p, r = F.coalesce(F.try_divide("tp", "said"), F.lit(0.0)), F.coalesce(F.try_divide("tp", "support"), F.lit(0.0))
    x = x.select("class", p.alias("precision"), r.alias("recall"), "support")
    return x.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def averages(by_class: DataFrame) -> DataFrame:
    """Macro and weighted means of a report."""
    parts = []
    for m in ("precision", "recall", "f1"):
        parts += [F.avg(m).alias(f"macro_{m}"), F.coalesce(F.try_divide(F.sum(F.col(m) * F.col("support")), F.sum("support")), F.lit(0.0)).alias(f"weighted_{m}")]
    return by_class.agg(*parts)


def agreement(matrix: DataFrame, gold: str = "gold", predicted: str = "predicted") -> DataFrame:
    """accuracy and Cohen's kappa."""
    by = lambda c, n: matrix.groupBy(F.col(c).alias("c")).agg(F.sum("n").alias(n))
    chance = by(gold, "a").join(by(predicted, "b"), "c").agg(F.sum(F.col("a") * F.col("b")).alias("chance"))
    x = matrix.agg(F.sum("n").alias("n"), F.sum(F.when(F.col(gold) == F.col(predicted), F.col("n")).otherwise(0)).alias("hit")).crossJoin(chance)  # one row each
    po, pe = F.col("hit") / F.col("n"), F.col("chance") / (F.col("n") * F.col("n"))
    return x.select("n", po.alias("accuracy"), F.coalesce(F.try_divide(po - pe, 1 - pe), F.lit(0.0)).alias("kappa"))


def pass_rate(rows: DataFrame, category: str, passed: Column) -> DataFrame:
    return rows.groupBy(category).agg(F.count("*").alias("n"), F.count_if(passed).alias("passed")).withColumn("rate", F.col("passed") / F.col("n"))


def evaluated(rows: DataFrame, gold: str = "gold", predicted: str = "predicted", positive: object | None = None, least: int = 10) -> DataFrame:
    """class, precision, recall, f1, support; with `positive`, two classes: that one and the rest. Too few rows are refused."""
    if rows.limit(least).count() < least:
        raise ValueError(f"fewer than {least} rows")
    if positive is not None:
        rows = rows.select(*[(F.col(c) == F.lit(positive)).alias(c) for c in (gold, predicted)])
    return report(confusion(rows, gold, predicted), gold, predicted)


def calibration(rows: DataFrame, confidence: str, correct: Column, edges: tuple[float, ...] = (0.5, 0.7, 0.85), least: float = 0.8) -> DataFrame:
    """bin (a, b, ... by confidence), n, accuracy, and whether the most confident bin is right less often than it should be."""
    name = F.lit(chr(ord("a") + len(edges)))
    for k, e in reversed(list(enumerate(edges))):
        name = F.when(F.col(confidence) < e, chr(ord("a") + k)).otherwise(name)
    x = rows.groupBy(name.alias("bin")).agg(F.count("*").alias("n"), F.avg(correct.cast("double")).alias("accuracy"))
    return x.withColumn("overconfident", (F.col("bin") == chr(ord("a") + len(edges))) & (F.col("accuracy") < least)).withColumn("accuracy", F.round("accuracy", 4))


def shares(rows: DataFrame, label: str) -> DataFrame:
    """label, n, pct of all rows. The total runs over one row for each label."""
    x = rows.groupBy(label).agg(F.count("*").cast("double").alias("n"))
    total = x.agg(F.sum("n").alias("_all"))
    return x.crossJoin(F.broadcast(total)).select(label, "n", F.round(100.0 * F.col("n") / F.col("_all"), 2).alias("pct"))  # one row


def breakdown(rows: DataFrame, by: str = "entity_id", least: int = 3, most: float = 70.0) -> DataFrame:
    """Shares of positive and negative labels and mean confidence of each entity with enough rows, and whether one label prevails."""
    share = lambda name: 100.0 * F.count_if(F.col("label") == name) / F.count("*")
    x = rows.where(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias("n"), share("positive").alias("_p"), share("negative").alias("_n"), F.round(F.avg("confidence"), 4).alias("avg_confidence"))
    x = x.where(F.col("n") >= least)
    return x.select(by, "n", F.round("_p", 1).alias("pos_pct"), F.round("_n", 1).alias("neg_pct"), "avg_confidence", (F.greatest("_p", "_n") > most).alias("biased"))


def uncertainty(rows: DataFrame) -> DataFrame:
    """n, mean confidence and entropy of score triples, and the share of those that are close to a draw."""
    p = [F.col(f"score_{c}") for c in ("negative", "neutral", "positive")]
    x = rows.select("confidence", T.entropy(*p).alias("h"), uncertain(*p).alias("u"))
    return x.agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 4).alias("mean_confidence"), F.round(F.avg("h"), 4).alias("mean_entropy"), F.round(100 * F.avg(F.col("u").cast("double")), 2).alias("uncertain_pct"))


def join_audit(docs: DataFrame, scored: DataFrame, context: Column, least_text: int = 300, least_context: int = 50) -> DataFrame:
    """docs with the first reason why a row cannot go into a fine-tuning set: its text, its score (scored(doc_id, confidence)) or its context, or kept."""
    x = docs.join(scored.groupBy(F.col("doc_id").alias("_d")).agg(F.max("confidence").alias("confidence")), F.col("doc_id") == F.col("_d"), "left").drop("_d")
    reason = F.when(F.length("text") < least_text, "article_short").when(F.col("confidence").isNull(), "score_missing").when(F.length(context) < least_context, "context_short").otherwise("kept")
    return x.withColumn("reason", reason)


def finetune_rows(docs: DataFrame, scores: DataFrame, contexts: DataFrame, seed: int, per_media: int = V.MAX_PER_MEDIA, per_entity: int = V.MAX_PER_ENTITY) -> DataFrame:
    """The curated set: contexts with their scores and articles, without short, boiler-plate, uncertain and repeated ones, within the quotas."""
    x = contexts.where(F.length("context") >= 50).join(scores.where("entity_id IS NOT NULL"), ["doc_id", "entity_id"]).join(docs.where(F.length("text") >= 300), "doc_id")
    x = x.where(~boilerplate_fails(F.col("text")) & ~uncertain(F.col("score_negative"), F.col("score_neutral"), F.col("score_positive")))
    x = x.select("doc_id", "entity_id", F.col("source").alias("media"), F.sha2("context", 256).alias("content_hash"), F.col("label").alias("pseudo_label"), F.round("confidence", 3).alias("ai_confidence"))
    return curated(x, seed, per_media, per_entity)


def joined_by_key(left: DataFrame, right: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of both sides with equal keys, and how many of the left have none on the right."""
    missing = left.join(right.select(*keys).distinct(), keys, "left_anti").agg(F.count("*").alias("missing"))
    return left.join(right, keys), missing


def levels(cases: DataFrame, scores: DataFrame) -> DataFrame:
    """level, key, n, value of the four levels of a report: pass rates of hard and of domain cases by category, shares of labels, polarity by entity.

    cases(level, category, passed) holds the first two; scores(entity_id, label, score_positive, score_negative) the others.
    """
    rate = cases.groupBy("level", F.col("category").alias("key")).agg(F.count("*").alias("n"), F.avg(F.col("passed").cast("double")).alias("value"))
    share = shares(scores, "label").select(F.lit("distribution").alias("level"), F.col("label").alias("key"), F.col("n").cast("bigint").alias("n"), (F.col("pct") / 100).alias("value"))
    by = scores.where("entity_id IS NOT NULL").groupBy(F.col("entity_id").cast("string").alias("key")).agg(F.count("*").alias("n"), F.avg(F.col("score_positive") - F.col("score_negative")).alias("value"))
    return rate.unionByName(share).unionByName(by.withColumn("level", F.lit("entity")).select("level", "key", "n", "value")).withColumn("value", F.round("value", 4))


def nested(docs: DataFrame, contexts: DataFrame) -> DataFrame:
    """docs with an array `contexts` of (entity_id, entity_name, context) in order of entity; empty where there is none. contexts(doc_id, entity_id, entity_name, context)."""
    one = F.struct("entity_id", "entity_name", "context")
    x = contexts.groupBy(F.col("doc_id").alias("_d")).agg(F.array_sort(F.collect_list(one)).alias("contexts"))
    return docs.join(x, F.col("doc_id") == F.col("_d"), "left").drop("_d").withColumn("contexts", F.coalesce("contexts", F.array().cast("array<struct<entity_id:bigint,entity_name:string,context:string>>")))


def flattened(nested_docs: DataFrame) -> DataFrame:
    """One row for each context of a nested data set; documents without any have none."""
    rest = [c for c in nested_docs.columns if c != "contexts"]
    return nested_docs.select(*rest, F.explode("contexts").alias("c")).select(*rest, "c.*")


def seeded(key: Column, seed: int) -> Column:
    """An order that looks random and can be repeated in any engine."""
    return F.md5(F.concat(key.cast("string"), F.lit(str(seed))))


def stratified(rows: DataFrame, label: str, key: str, n: int, seed: int) -> DataFrame:
    by = W.partitionBy(label).orderBy(seeded(F.col(key), seed), key)
    return rows.withColumn("rn", F.row_number().over(by)).where(F.col("rn") <= n)


def curated(rows: DataFrame, seed: int, per_media: int = V.MAX_PER_MEDIA, per_entity: int = V.MAX_PER_ENTITY) -> DataFrame:
    """Greedy choice in seeded order: a pair (content_hash, entity_id) once, at most so many of each media and entity.

    The quotas are coupled, so the choice itself is sequential. Counts only grow, so of the rows of one entity and media
    a prefix is chosen: rows beyond the smaller quota in their pair go first, as do repeated pairs. At most
    entities x media x quota rows are left for the one task that takes them in order.
    """
    x = rows.withColumn("_o", F.concat(seeded(F.col("doc_id"), seed), F.lpad(F.col("doc_id").cast("string"), 20, "0"), F.lpad(F.col("entity_id").cast("string"), 20, "0")))
    x = x.withColumn("_rn", F.row_number().over(W.partitionBy("content_hash", "entity_id").orderBy("_o"))).where("_rn = 1")
    # Of one entity and media, rows after the first min(per_media, per_entity) are never chosen before those.
    x = x.withColumn("_rn", F.row_number().over(W.partitionBy("entity_id", "media").orderBy("_o"))).where(F.col("_rn") <= min(per_media, per_entity)).drop("_rn")
    kind = x.schema

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        media: dict = {}
        entity: dict = {}
        for batch in batches:
            keep = []
            for m, e in zip(batch["media"], batch["entity_id"]):
                ok = media.get(m, 0) < per_media and entity.get(e, 0) < per_entity
                if ok:
                    media[m], entity[e] = media.get(m, 0) + 1, entity.get(e, 0) + 1
                keep.append(ok)
            yield batch[keep]

    return x.repartition(1).sortWithinPartitions("_o").mapInPandas(choose, kind).drop("_o")


def boilerplate_fails(text: Column) -> Column:
    from .quality import boilerplate_ratio

    return boilerplate_ratio(text) > V.MAX_BOILERPLATE


def baseline(rows: DataFrame) -> DataFrame:
    """rows with the lexicon's label beside the model's."""
    from .quality import lexicon_label

    return rows.withColumn("baseline", lexicon_label(F.col("text")))


def uncertain(neg: Column, neu: Column, pos: Column) -> Column:
    """More than 95 % of the largest entropy."""
    return T.entropy(neg, neu, pos) > 0.95 * F.log(F.lit(3.0))


def era(at: Column, fallback: Column | None = None) -> Column:
    """A label for the year of a date in text, else the fallback, else unknown."""
    year = F.regexp_extract(F.coalesce(at.cast("string"), F.lit("")), r"^(\d{4})", 1)
    return F.coalesce(F.when(year != "", F.concat(F.lit("era_"), year)), *([fallback] if fallback is not None else []), F.lit("unknown"))


def preview(text: Column, n: int = 300) -> Column:
    return F.substring(F.trim(F.regexp_replace(T.strip_markup(F.coalesce(text, F.lit(""))), r"\s+", " ")), 1, n)


def sentiment_template(scores: DataFrame, docs: DataFrame, entities: DataFrame, n: int, seed: int) -> DataFrame:
    """A sheet for the gold labels of n scores of each predicted label; the columns to fill in are empty."""
    x = stratified(scores.where(F.col("entity_id").isNotNull()), "label", "event_id", n, seed).drop("rn")
    x = x.join(docs.select("doc_id", "title", "text", "ingested_at"), "doc_id", "left").join(entities.select("entity_id", "canonical_name"), "entity_id", "left")
    return x.select(
        "event_id", "doc_id", F.col("canonical_name").alias("entity_name"), "title", preview(F.col("text")).alias("text_preview"), era(F.col("ingested_at")).alias("era_hint"),
        F.col("label").alias("predicted_label"), F.round("confidence", 3).alias("predicted_confidence"), F.lit("").alias("gold_label"), F.lit("").alias("notes"),
    )


def relevancy_template(docs: DataFrame, terms: dict[int, list[str]], n: int, seed: int, least: int = 500, names: dict[int, str] | None = None, gate: float = 0.5) -> DataFrame:
    """A sheet for the gold relevancy of entities found in n long documents in seeded order; one row for each entity found.

    With names, the relevancy model's confidence and the gate's decision stand beside each entity.
    """
    x = docs.where(F.length("text") >= least).orderBy(seeded(F.col("doc_id"), seed), "doc_id").limit(n)
    low = F.lower(F.concat_ws(" ", "title", "text"))
    found = F.array(*[F.when(low.rlike("|".join(map(T.quoted, t))), F.lit(i).cast("bigint")) for i, t in sorted(terms.items()) if t])
    x = x.withColumn("entity_id", F.explode(F.filter(found, lambda i: i.isNotNull())))
    judged = []
    if names is not None:
        from .scoring import mention_relevancy

        name = F.try_element_at(F.create_map(*[F.lit(v) for k, v_ in sorted(names.items()) for v in (k, v_)]), F.col("entity_id").cast("int"))
        x = x.withColumn("entity_candidate", name).withColumn("relevancy_confidence", F.round(mention_relevancy(F.col("entity_candidate"), F.col("text")), 3))
        judged = ["entity_candidate", "relevancy_confidence", F.when(F.col("relevancy_confidence") >= gate, "pass").otherwise("block").alias("gate_decision")]
    return x.select("doc_id", "entity_id", "title", preview(F.col("text")).alias("text_preview"), era(F.col("ingested_at")).alias("era_hint"), *judged, F.lit("").alias("gold_relevant"), F.lit("").alias("notes"))


def first_of_each(rows: DataFrame, category: str, key: str, n: int = 10) -> DataFrame:
    """The first n rows of each category by key."""
    return rows.withColumn("rn", F.row_number().over(W.partitionBy(category).orderBy(key)).cast("bigint")).where(F.col("rn") <= n)
