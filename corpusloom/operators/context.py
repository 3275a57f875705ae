"""Sentences, context windows around a mention, and readiness for scoring."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from . import dedup

PIECE = r"(?s).*?[.!?]\s+|(?s).+$"


def sentence_table(docs: DataFrame, text: Column, least: int = 10) -> DataFrame:
    """doc_id, pos, start, end, sentence, paragraph: sentences with more than `least` characters, numbered from 0 in their text.

    Offsets add up the lengths of all pieces before; all windows use the one shuffle by document.
    """
    pieces = docs.select("doc_id", F.posexplode(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))).alias("k", "piece"))
    by = W.partitionBy("doc_id").orderBy("k")
    x = pieces.withColumn("start", F.coalesce(F.sum(F.length("piece")).over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    x = x.withColumn("paragraph", F.coalesce(F.sum(F.regexp_count("piece", F.lit("\n\n"))).over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    x = x.withColumn("sentence", F.regexp_replace("piece", r"\s+$", "")).withColumn("end", F.col("start") + F.length("sentence")).where(F.length(F.trim("sentence")) > least)
    return x.select("doc_id", (F.row_number().over(by) - 1).cast("bigint").alias("pos"), "start", "end", "sentence", "paragraph")


def _has(words: Column, markers: tuple[str, ...]) -> Column:
    return F.arrays_overlap(words, F.array(*map(F.lit, markers)))


def windows(
    sentences: DataFrame,
    active: tuple[str, ...] = V.ACTIVE_MARKERS + V.PASSIVE_MARKERS,
    attribution: tuple[str, ...] = V.ATTRIBUTION,
    pronouns: tuple[str, ...] = V.PRONOUNS,
) -> DataFrame:
    """Each sentence as an anchor with its context, cut to 180 words around it.

    A marker word in the sentence stands in for its root verb. An attribution pulls the sentence before, and the one
    before that if there is a quote; an action pulls the next one only if it opens with a pronoun or a quote. That holds
    for an entity that acts or is acted on; `beside` is the context of one that is only mentioned, which pulls no next
    sentence behind an action.
    """
    by = W.partitionBy("doc_id").orderBy("pos")
    quote = f"[{V.QUOTES}]"
    x = sentences.withColumn("_w", T.tokens(F.col("sentence")))
    x = x.withColumn("_1", F.lag("sentence").over(by)).withColumn("_2", F.lag("sentence", 2).over(by)).withColumn("_n", F.lead("sentence").over(by))
    x = x.withColumn("has_action", _has(F.col("_w"), active)).withColumn("attributed", _has(F.col("_w"), attribution))
    back = F.col("attributed") & F.col("_1").isNotNull()
    far = back & F.col("_2").isNotNull() & F.col("_1").rlike(quote)
    opens = F.coalesce(F.get(T.tokens(F.col("_n")), F.lit(0)).isin(*pronouns), F.lit(False)) | F.coalesce(F.substring("_n", 1, 5).rlike(quote), F.lit(False))
    ahead = F.col("_n").isNotNull() & (~F.col("has_action") | opens)
    x = x.withColumn("before", F.concat_ws(" ", F.when(far, F.col("_2")), F.when(back, F.col("_1")))).withColumn("after", F.when(ahead, F.col("_n")).otherwise(""))
    x = x.withColumn("context", capped(F.col("before"), F.col("sentence"), F.col("after")))
    x = x.withColumn("beside", capped(F.col("before"), F.col("sentence"), F.when(F.col("has_action"), F.lit("")).otherwise(F.col("after"))))
    x = x.withColumn("has_quote", F.col("context").rlike(quote))
    x = x.withColumn("quality_score", F.when(F.col("has_action"), 90).otherwise(50)).withColumn("attr_score", F.when(F.col("has_action"), 40).otherwise(10)).withColumn("pos_score", F.when(F.col("paragraph") == 0, 20).otherwise(10))
    return x.drop("_w", "_1", "_2", "_n", "before", "after")


def capped(before: Column, anchor: Column, after: Column, most: int = V.MAX_CONTEXT_WORDS) -> Column:
    """The context, or if it is too long the anchor and as many of the other words as fit; an anchor that is too long is cut."""
    whole = F.trim(F.concat_ws(" ", F.nullif(before, F.lit("")), anchor, F.nullif(after, F.lit(""))))
    w, rest = T.words(anchor), T.words(F.concat_ws(" ", before, after))
    room = F.greatest(F.lit(most) - F.size(w), F.lit(0))
    others = F.array_join(F.slice(rest, 1, room), " ")
    mixed = F.when(before != "", F.concat_ws(" ", others, anchor)).otherwise(F.concat_ws(" ", anchor, others))
    return F.when(F.size(T.words(whole)) <= most, whole).when(F.size(w) >= most, F.array_join(F.slice(w, 1, most), " ")).otherwise(F.trim(mixed))


def anchors(mentions: DataFrame, sentences: DataFrame) -> DataFrame:
    """mentions(doc_id, entity_id, offset) with the sentence that holds the offset; negative offsets have none."""
    s = sentences.select(F.col("doc_id").alias("_d"), "pos", F.col("start").alias("_s"), F.col("end").alias("_e"))
    return mentions.where(F.col("offset") >= 0).join(s, (F.col("doc_id") == F.col("_d")) & (F.col("offset") >= F.col("_s")) & (F.col("offset") < F.col("_e"))).drop("_d", "_s", "_e")


def core_argument(sentence: Column, name: Column, dependents: tuple[str, ...] = V.DEPENDENTS) -> Column:
    """Whether an entity is more than a modifier: the fallback for a parser. False if the word before its first mention makes it one."""
    at = F.position(F.lower(name), F.lower(sentence))
    before = T.tokens(F.substring(sentence, F.lit(1), F.greatest(at - 1, F.lit(0))))
    return F.coalesce(~F.element_at(F.concat(F.array(F.lit("")), before), -1).isin(*dependents), F.lit(True))


def for_mentions(placed: DataFrame, windows_: DataFrame, core: Callable[[Column, Column], Column] = core_argument) -> DataFrame:
    """placed(doc_id, entity_id, offset, pos, mention) with the context and quality of its sentence, as the mention acts in it or stands beside."""
    x = placed.join(windows_, ["doc_id", "pos"]).withColumn("is_main_actor", core(F.col("sentence"), F.col("mention")))
    x = x.withColumn("context", F.when(F.col("is_main_actor"), F.col("context")).otherwise(F.col("beside")))
    return x.withColumn("quality_score", F.when(F.col("is_main_actor"), F.col("quality_score")).otherwise(50)).drop("beside")


def best(contexts: DataFrame) -> DataFrame:
    """The context with the best quality of each document and entity; ties: the first mention."""
    by = W.partitionBy("doc_id", "entity_id").orderBy(F.desc("quality_score"), "offset")
    return contexts.withColumn("_rn", F.row_number().over(by)).where("_rn = 1").drop("_rn")


def readiness(docs: DataFrame, contexts: DataFrame, ready: DataFrame | None = None) -> DataFrame:
    """docs with outcome and n_valid: duplicate title, then too short, then enough context or body, else failed.

    contexts(doc_id, context, quality_score); ready(title): documents outside docs that passed the gate before. Each
    document gets exactly one outcome.
    """
    valid = (F.length("context") >= 50) & (F.col("quality_score") >= 20)
    n = contexts.where(valid).groupBy(F.col("doc_id").alias("_d")).agg(F.count("*").alias("n_valid"))
    x = dedup.by_title(docs).join(n, F.col("doc_id") == F.col("_d"), "left").drop("_d").withColumn("n_valid", F.coalesce("n_valid", F.lit(0)))
    again = F.col("duplicate_of").isNotNull()
    if ready is not None:
        known = ready.select(F.nullif(T.normal_title(F.col("title")), F.lit("")).alias("_known")).where("_known IS NOT NULL").distinct()
        x = x.join(known, T.normal_title(F.col("title")) == F.col("_known"), "left")
        again |= F.col("_known").isNotNull()
    body = F.length(F.coalesce("text", F.lit("")))
    outcome = F.when(again, "skipped_duplicate_title").when(body < 150, "failed_short_body").when((F.col("n_valid") >= 1) | (body >= 500), "queued").otherwise("failed_no_context")
    return x.withColumn("outcome", outcome).drop("duplicate_of", "_known")
