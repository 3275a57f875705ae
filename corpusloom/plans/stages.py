"""Stages from raw documents to scores, their order, and a record of each run.

python -m corpusloom.plans.stages run-prep|run-nlp|run STAGE --data DIR --out DIR [--as-of DATE] [--limit N]
"""

from __future__ import annotations

import argparse
import datetime
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import context, dedup, entities, merge, pages, quality, scoring


@dataclass
class Settings:
    """What differs between collections. as_of and limit come from the command line; nothing reads the clock but the run record."""

    stopwords: tuple[str, ...] = V.STOPWORDS
    language: str = "id"
    version: str = "1"
    positive: tuple[str, ...] = V.POSITIVE
    negative: tuple[str, ...] = V.NEGATIVE
    as_of: str | None = None
    days: int = 30
    limit: int | None = None


Tables = dict[str, DataFrame]


def _pick(docs: DataFrame, status: str, s: Settings) -> DataFrame:
    x = docs.where(F.col("status") == status)
    if s.as_of and "ingested_at" in docs.columns:
        x = merge.recent(x, "ingested_at", s.as_of, s.days)
    return x.limit(s.limit) if s.limit else x


def enrich(t: Tables, s: Settings) -> Tables:
    """Pending documents get their article text, from the page or a long feed body; titles that are already there are skipped."""
    docs = _pick(t["raw_texts"], "pending", s)
    done = t["raw_texts"].where(F.col("status").isin("enriched", "processed", "skipped", "validated"))
    fresh = dedup.not_known(docs, done, F.nullif(quality.T.normal_title(F.col("title")), F.lit("")))
    x = fresh if "html" in docs.columns else fresh.withColumn("html", F.lit(None).cast("string"))
    x = pages.extraction_gate(x, feed_text="text")
    ok = F.col("article_text").isNotNull()
    changes = x.select("doc_id", F.col("article_text").alias("text"), F.when(ok, "enriched").otherwise("failed").alias("status"), F.when(~ok, F.col("gate")).alias("fail_reason"))
    skipped = docs.join(fresh.select("doc_id"), "doc_id", "left_anti").select("doc_id", F.lit(None).cast("string").alias("text"), F.lit("skipped").alias("status"), F.lit("duplicate_title").alias("fail_reason"))
    return t | {"raw_texts": merge.partial_update(t["raw_texts"], changes.unionByName(skipped), ["doc_id"])}


def validate(t: Tables, s: Settings) -> Tables:
    docs = _pick(t["raw_texts"], "enriched", s)
    language = F.coalesce(F.col("lang"), quality.T.language(F.col("text"))) if "lang" in docs.columns else quality.T.language(F.col("text"))
    x = quality.route(quality.quality_score(docs, s.stopwords, F.coalesce(language == s.language, F.lit(False))))
    return t | {"raw_texts": merge.partial_update(t["raw_texts"], x.select("doc_id", "status", "fail_reason"), ["doc_id"])}


def preprocess(t: Tables, s: Settings) -> Tables:
    """Validated documents get their normalised text; copies of content become skipped and point at the survivor. Those of this version are left alone."""
    docs = _pick(t["raw_texts"], "validated", s)
    if "preprocessing_version" in docs.columns:
        docs = docs.where(merge.outdated(F.col("preprocessing_version"), s.version))
    x = dedup.by_content(quality.normalise(docs).drop("content_hash"))
    copy = F.col("duplicate_of").isNotNull()
    changes = x.select("doc_id", F.col("clean_text").alias("text"), F.when(copy, "skipped").otherwise("validated").alias("status"), F.when(copy, "duplicate_content").alias("fail_reason"), F.lit(s.version).alias("preprocessing_version"))
    return t | {"raw_texts": merge.partial_update(t["raw_texts"], changes, ["doc_id"])}


def resolve(t: Tables, s: Settings) -> Tables:
    docs = _pick(t["raw_texts"], "validated", s)
    given = F.try_element_at(F.col("metadata"), F.lit("configured_entity_id")).cast("bigint") if "metadata" in docs.columns else F.lit(None).cast("bigint")
    docs = docs if "configured_entity_id" in docs.columns else docs.withColumn("configured_entity_id", given)
    mentions, mapped = entities.resolve(docs, t["entities"], entities.composed(F.col("title"), F.col("text")))
    return t | {"mentions": mentions, "article_entities": mapped}


def contextualise(t: Tables, s: Settings) -> Tables:
    docs = _pick(t["raw_texts"], "validated", s)
    sentences = context.sentence_table(docs, entities.composed(F.col("title"), F.col("text")))
    mentions = t["mentions"].join(t["article_entities"].select("doc_id", "entity_id"), ["doc_id", "entity_id"], "left_semi").withColumnRenamed("start", "offset")
    placed = context.anchors(mentions.select("doc_id", "entity_id", "offset", "mention"), sentences)
    return t | {"contexts": context.best(context.for_mentions(placed, context.windows(sentences)))}


def ready(t: Tables, s: Settings) -> Tables:
    docs = _pick(t["raw_texts"], "validated", s)
    before = t["raw_texts"].where(F.col("status").isin("queued", "processed")).join(docs.select("doc_id"), "doc_id", "left_anti")
    x = context.readiness(docs, t["contexts"], before)
    status = F.when(F.col("outcome") == "queued", "queued").when(F.startswith("outcome", F.lit("skipped")), "skipped").otherwise("failed")
    changes = x.select("doc_id", status.alias("status"), F.when(F.col("outcome") != "queued", F.col("outcome")).alias("fail_reason"))
    return t | {"raw_texts": merge.partial_update(t["raw_texts"], changes, ["doc_id"])}


def score(t: Tables, s: Settings) -> Tables:
    """Scores of queued documents and of their contexts. Short documents become skipped, the others processed."""
    docs = _pick(t["raw_texts"], "queued", s)
    scorer = scoring.lexicon_scores(s.positive, s.negative)
    columns = ["doc_id", "entity_id", "label", "confidence", "score_negative", "score_neutral", "score_positive"]
    whole = scoring.score_documents(docs, scorer).select(*columns)
    named = t["contexts"].join(docs.select("doc_id"), "doc_id", "left_semi").join(t["entities"].select("entity_id", "canonical_name"), "entity_id")
    parts = scoring.score_contexts(named, scorer).select(*columns)
    status = F.when(F.length(F.coalesce("text", F.lit(""))) < 50, "skipped").otherwise("processed")
    changes = docs.select("doc_id", status.alias("status"))
    return t | {"scores": whole.unionByName(parts), "raw_texts": merge.partial_update(t["raw_texts"], changes, ["doc_id"])}


STAGES: dict[str, Callable[[Tables, Settings], Tables]] = {"enrich": enrich, "validate": validate, "preprocess": preprocess, "entity": resolve, "context": contextualise, "readiness": ready, "score": score}
PREPARE = ("enrich", "validate", "preprocess", "entity", "context", "readiness")


def run(names: tuple[str, ...], tables: Tables, settings: Settings, out: str) -> tuple[Tables, DataFrame]:
    """Stages in turn, each result written and read again, and the record of runs.

    The record has a row for each table that a stage made: seconds, rows, of raw_texts also how many changed their status
    and how many of those failed. A stage that breaks off ends the run; its row says failed and why, and what was made
    before it stands.
    """
    spark, log = next(iter(tables.values())).sparkSession, []
    for name in names:
        began = datetime.datetime.now(datetime.UTC)
        past = lambda: (datetime.datetime.now(datetime.UTC) - began).total_seconds()  # noqa: B023, E731
        try:
            before = tables.get("raw_texts")
            made = {k: x for k, x in STAGES[name](tables, settings).items() if tables.get(k) is not x}
            for k, x in made.items():
                x.write.mode("overwrite").parquet(f"{out}/{name}/{k}")
                tables = tables | {k: spark.read.parquet(f"{out}/{name}/{k}")}
                moved = (None, None)
                if k == "raw_texts" and before is not None:
                    was = before.select(F.col("doc_id").alias("_d"), F.col("status").alias("_was"))
                    now = tables[k].join(was, F.col("doc_id") == F.col("_d")).where(~F.col("status").eqNullSafe(F.col("_was")))
                    moved = tuple(now.agg(F.count("*"), F.count_if(F.col("status") == "failed")).first())
                log.append((name, k, past(), tables[k].count(), *moved, "ok", None))
        except Exception as e:  # noqa: BLE001  the record must tell
            log.append((name, None, past(), None, None, None, "failed", str(e)[:500]))
            break
    return tables, spark.createDataFrame(log, "stage string, made string, seconds double, n bigint, changed bigint, failed bigint, status string, error string")


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("command", choices=("run-prep", "run-nlp", "run"))
    p.add_argument("stage", nargs="?", choices=tuple(STAGES))
    p.add_argument("--data", required=True, help="folder with raw_texts and entities")
    p.add_argument("--out", required=True)
    p.add_argument("--as-of")
    p.add_argument("--limit", type=int)
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("corpusloom").getOrCreate()
    names = PREPARE if a.command == "run-prep" else ("score",) if a.command == "run-nlp" else (a.stage,)
    tables = {n: spark.read.parquet(f"{a.data}/{n}") for n in (("raw_texts", "entities") if names[0] in ("enrich", "validate", "preprocess", "entity") else ("raw_texts", "entities", "mentions", "article_entities", "contexts"))}
    run(names, tables, Settings(as_of=a.as_of, limit=a.limit), a.out)[1].show(truncate=False)


if __name__ == "__main__":
    main()
