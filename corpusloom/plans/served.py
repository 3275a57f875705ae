"""Queries that go through the operators of dashboards, evaluation, changes and resolution, and SQL written apart for them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from ..operators import context, dedup, entities, evaluation, merge, quality, serving
from ..streaming import jobs
from . import documents, relational, standins

LONG = "bigint"
AS_OF = standins.AS_OF


def dashboard_summary(spark, sf_dir):
    return serving.dashboard(standins.scores(spark, sf_dir), standins.entities(spark), AS_OF)


def entity_highlights_topn(spark, sf_dir):
    return serving.highlights(standins.scores(spark, sf_dir), standins.raw_texts(spark, sf_dir), AS_OF)


def public_view(spark, sf_dir):
    return serving.public(standins.raw_texts(spark, sf_dir).where("length(text) >= 500"))


def highlights_read(spark, sf_dir):
    table = standins.scores(spark, sf_dir).withColumnRenamed("label", "polarity")
    return serving.read_highlights(table, 3, "positive", 10, "scored_at").select("entity_id", "polarity", "doc_id", "confidence", "scored_at")


def _index(spark, sf_dir, unit):
    return serving.series(standins.scores(spark, sf_dir), AS_OF, 3650, unit)


def national_index_monthly(spark, sf_dir):
    return _index(spark, sf_dir, "month").where("entity_id IS NULL").select("month", "n", F.col("polarity").alias("index_value"))


def national_index_yearly(spark, sf_dir):
    return _index(spark, sf_dir, "year").where("entity_id IS NULL").select("year", "n", F.col("polarity").alias("index_value"))


def entity_yearly(spark, sf_dir):
    return _index(spark, sf_dir, "year").where("entity_id IS NOT NULL")


def entity_ranking_7d(spark, sf_dir):
    return serving.ranking(standins.scores(spark, sf_dir), AS_OF)


def entity_timeseries(spark, sf_dir):
    return serving.series(standins.scores(spark, sf_dir), AS_OF, 14).where("entity_id IS NOT NULL")


def entity_hotness(spark, sf_dir):
    return serving.hotness(standins.scores(spark, sf_dir), AS_OF)


def _daily(spark, sf_dir):
    return standins.scores(spark, sf_dir).where("entity_id IS NOT NULL").groupBy("entity_id", F.to_date("scored_at").alias("day")).agg(F.count("*").alias("n"))


def spike_alert_3sigma(spark, sf_dir):
    return serving.spikes(_daily(spark, sf_dir)).withColumn("mean", F.round("mean", 4)).withColumn("sd", F.round("sd", 4))


def trend_week_over_week(spark, sf_dir):
    return serving.trend(standins.scores(spark, sf_dir))


def head_to_head(spark, sf_dir):
    return serving.head_to_head(standins.scores(spark, sf_dir), 1, 2)


def label_percentages(spark, sf_dir):
    return evaluation.shares(standins.scores(spark, sf_dir), "label")


def per_entity_breakdown(spark, sf_dir):
    return evaluation.breakdown(standins.scores(spark, sf_dir))


def entropy_stats(spark, sf_dir):
    return evaluation.uncertainty(standins.scores(spark, sf_dir))


def confidence_calibration(spark, sf_dir):
    x = standins.scores(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id")
    return evaluation.calibration(x, "confidence", (F.col("quality") == 1) == (F.col("label") == "positive"))


def finetune_join_audit(spark, sf_dir):
    scored = standins.scores(spark, sf_dir).where("entity_id = 3").select("doc_id", "confidence")
    return evaluation.join_audit(standins.raw_texts(spark, sf_dir), scored, F.col("title")).groupBy("reason").agg(F.count("*").alias("n"))


def binary_report(spark, sf_dir):
    x = evaluation.evaluated(documents._judged(spark, sf_dir), positive=1)
    return x.where("class").select(*[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], F.col("support").cast(LONG).alias("support"))


def insert_if_absent(spark, sf_dir):
    docs = standins.raw_texts(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("text_hash"))
    known, rows = docs.where("doc_id % 4 = 0"), docs.where("doc_id % 4 <> 0")
    fresh = merge.insert_if_absent(known, merge.latest(rows, ["text_hash"], -F.col("doc_id")), ["text_hash"]).select(F.lit(1).alias("inserted"), F.lit(0).alias("given"))
    both = fresh.unionByName(rows.select(F.lit(0).alias("inserted"), F.lit(1).alias("given")))
    return both.agg(F.sum("inserted").alias("inserted"), (F.sum("given") - F.sum("inserted")).alias("duplicate"))


def retry_state(spark, sf_dir):
    from pyspark.sql import Window as W

    x = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type = 'error'")
    x = x.withColumn("attempts", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1)
    return merge.transient(x, F.lit("media_timeout")).select("event_id", F.col("attempts").cast(LONG).alias("attempts"), "status", F.col("fail_reason").alias("reason"))


def constraint_violations(spark, sf_dir):
    scores = standins.scores(spark, sf_dir)
    rules = {
        "confidence_range": F.col("confidence").between(0, 1),
        "label_enum": F.col("label").isin("negative", "neutral", "positive"),
        "entity_null": F.col("entity_id").isNotNull(),
        "low_confidence": F.col("confidence") >= 0.4,
    }
    lost = merge.orphans(scores, "doc_id", standins.raw_texts(spark, sf_dir), "doc_id").select("event_id", F.lit("document_reference").alias("rule"))
    return merge.violations(scores, rules, "event_id").unionByName(lost).groupBy("rule").agg(F.count("*").alias("n"))


def delete_insert_scores(spark, sf_dir):
    scores = standins.scores(spark, sf_dir)
    new = scores.where("event_id % 10 = 0").groupBy("entity_id", "doc_id").agg(F.max("confidence").alias("confidence"))
    return merge.replace(scores.where("event_id % 10 <> 0").select("entity_id", "doc_id", "confidence"), new, ["doc_id", "entity_id"])


def retention_keep_6_months(spark, sf_dir):
    x = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.trunc("o_orderdate", "MM").alias("month"))
    return merge.keep_months(x, "month", "2001-08-01").groupBy("month").agg(F.count("*").alias("n"))


def reprocess_by_version(spark, sf_dir):
    version = F.when(F.col("doc_id") % 3 == 0, "1").when(F.col("doc_id") % 3 == 1, "2")
    return standins.raw_texts(spark, sf_dir).withColumn("version", version).where(merge.outdated(F.col("version"), "2")).select("doc_id", "version")


def queue_lease(spark, sf_dir):
    """Two readers take messages one after the other; what the first acknowledged is gone, what it did not is hidden."""
    queue = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type = 'click'").select(F.col("event_id").alias("msg_id"), F.col("ts").alias("visible_at"), F.lit(0).alias("read_count"))
    first, queue = merge.leased(queue, "2024-01-20 00:00:00", 3600, 30)
    queue = merge.acknowledged(queue, first.where("msg_id % 2 = 0"))
    second, queue = merge.leased(queue, "2024-01-20 00:30:00", 3600, 30)
    return queue.select("msg_id", "visible_at", F.col("read_count").cast(LONG).alias("read_count"))


def refreshed_dashboard(spark, sf_dir):
    """A roll-up stored on the 20th, brought up to date on the 31st."""
    scores, names = standins.scores(spark, sf_dir), standins.entities(spark)
    stored = serving.dashboard(scores.where("scored_at < '2024-01-21'"), names, "2024-01-20")
    return serving.refresh_dashboard(stored, scores, names, AS_OF, 11, 20)


def refreshed_highlights(spark, sf_dir):
    scores, docs = standins.scores(spark, sf_dir), standins.raw_texts(spark, sf_dir)
    empty = spark.createDataFrame([], "entity_id bigint, doc_id bigint, polarity string, confidence double, published_at timestamp_ntz")
    stored = serving.refresh_highlights(empty, scores.where("scored_at < '2024-01-16'"), docs, "2024-01-15")
    return serving.refresh_highlights(stored, scores, docs, AS_OF, 5, 20).select("entity_id", "doc_id", "polarity", F.round("confidence", 6).alias("confidence"))


def dataset_nested(spark, sf_dir):
    """Documents with their contexts as a nested data set, flattened again."""
    docs = standins.raw_texts(spark, sf_dir).where("length(text) >= 500").select("doc_id", "title", "source")
    names = standins.entities(spark).select("entity_id", F.col("canonical_name").alias("entity_name"))
    contexts = documents._contexts(spark, sf_dir).select("doc_id", "entity_id", "context").join(F.broadcast(names), "entity_id")
    x = evaluation.flattened(evaluation.nested(docs, contexts))
    return x.select("doc_id", "title", "source", "entity_id", "entity_name", F.sha2("context", 256).alias("context_sha256"))


def audit_entities(spark, sf_dir):
    terms = sorted({t for i, n, a in standins.ENTITIES for t in (n, *a) if len(t) >= 4})
    return quality.audit_sheet(standins.raw_texts(spark, sf_dir), terms).select("doc_id", "has_entity", "matched_entities")


def language_test(spark, sf_dir):
    profiles = {k: v for k, v in V.PROFILES.items() if k != "id"}
    return standins.raw_texts(spark, sf_dir).select("doc_id", T.language(F.col("text"), profiles).alias("language"))


def _titled(spark, sf_dir):
    """Documents whose titles are words that begin with capitals, as names do."""
    cap = F.array_join(F.transform(F.split(F.lower("title"), " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), " ")
    return standins.raw_texts(spark, sf_dir).withColumn("title", cap)


def name_candidates(spark, sf_dir):
    return entities.candidates(_titled(spark, sf_dir).select("title"), standins.entities(spark), ("the", "and", "que", "der"), 3, ("of", "und"))


def entity_veto(spark, sf_dir):
    """Hits of the dictionary in titles that are part of a longer name or not."""
    docs = _titled(spark, sf_dir).withColumn("text", F.lit(""))
    found = entities.match(docs, entities.dictionary(standins.entities(spark)), entities.composed(F.col("title"), F.col("text")))
    kept = entities.true_hits(found, standins.entities(spark), F.col("title"))
    return kept.groupBy("doc_id", "entity_id").agg(F.count("*").alias("kept"))


def pre_attribution(spark, sf_dir):
    """Documents that were fetched for an entity belong to it alone, others to what the dictionary finds."""
    docs = standins.raw_texts(spark, sf_dir).withColumn("configured_entity_id", F.when(F.col("doc_id") % 4 == 0, F.col("doc_id") % 20))
    names = standins.entities(spark).withColumn("canonical_name", F.col("canonical_name"))
    mapped = entities.resolve(docs, names, entities.composed(F.col("title"), F.col("text")))[1]
    return mapped.where("resolver_source = 'pre_attributed'").select("doc_id", "entity_id", F.col("first_offset").cast(LONG).alias("first_offset"), "confidence", "is_main")


def core_context(spark, sf_dir):
    """Contexts of mentions that act or stand beside."""
    docs = standins.raw_texts(spark, sf_dir)
    word = F.lit("that")
    mentions = docs.select("doc_id", F.lit(4).cast(LONG).alias("entity_id"), word.alias("mention"), (F.instr(F.lower("text"), "that") - 1).cast(LONG).alias("offset"))
    placed = context.anchors(mentions, documents._sentences(spark, sf_dir))
    core = lambda sentence, name: context.core_argument(sentence, name, ("the", "of"))
    return context.for_mentions(placed, documents._windows(spark, sf_dir), core).select("doc_id", "pos", "is_main_actor", F.col("quality_score").cast(LONG).alias("quality_score"), F.length("context").cast(LONG).alias("chars"))


def readiness_history(spark, sf_dir):
    """The gate with titles that became ready before."""
    docs = standins.raw_texts(spark, sf_dir)
    contexts = docs.select("doc_id", F.col("title").alias("context"), (F.col("doc_id") % 50).cast("int").alias("quality_score"))
    return context.readiness(docs.where("doc_id % 3 <> 0"), contexts, docs.where("doc_id % 3 = 0").select("title")).select("doc_id", "outcome")


def near_duplicate_pairs(spark, sf_dir):
    """Vectors with the number of others that point their way. The tables hold scattered vectors, so the angle is wide."""
    x = dedup.near(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 0.45)
    return x.select("vec_id", "representative", "n_links", F.round("best_cosine", 4).alias("best_cosine"))


def feed_parse(spark, sf_dir):
    return documents.feed_parse(spark, sf_dir).withColumn("published_at", F.unix_timestamp("published_at"))


def curation_quota(spark, sf_dir):
    return documents.curation_quota(spark, sf_dir).select("doc_id", "entity_id", "media")


def stream_spike_alerts(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    events = jobs.read(spark, f"{sf_dir}/events.parquet")
    x = events.select(F.when(F.col("event_type") != "error", F.col("user_id") % 20).alias("entity_id"), (F.col("event_id") % n).alias("doc_id"), F.col("ts").alias("scored_at"))
    return jobs.spike_alerts(x, jobs.work_dir(spark)).withColumn("mean", F.round("mean", 4)).withColumn("sd", F.round("sd", 4))


def archive_scan(spark, sf_dir):
    """Articles of answers of an archive, without some domains and sections."""
    from ..sources import feeds

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    one = F.struct("url", F.concat(F.lit("page "), F.col("page_id")).alias("title"), F.regexp_extract("url", "://([^/]+)", 1).alias("domain"), F.lit("20240105T101500Z").alias("seendate"), F.lit("x").alias("language"))
    answers = pages.groupBy((F.col("page_id") % 5).alias("k")).agg(F.to_json(F.struct(F.collect_list(one).alias("articles"))).alias("json"))
    x = feeds.archive(answers)
    x = x.where(~feeds.excluded(F.col("source_url"), F.col("domain"), ("example.net",), ("https://www.",)))
    return x.select("title", "source_url", "domain", "source_id", F.unix_timestamp("published_at").alias("published_at"))


def composite_join(spark, sf_dir):
    """Contexts of long titles and their scores by document and entity, and how many have none."""
    scores = standins.scores(spark, sf_dir).where("entity_id IS NOT NULL").groupBy("doc_id", "entity_id").agg(F.max("confidence").alias("confidence"))
    contexts = documents._mentions(spark, sf_dir).select("doc_id", "entity_id").distinct()
    found, missing = evaluation.joined_by_key(contexts, scores, ["doc_id", "entity_id"])
    return found.agg(F.count("*").alias("joined"), F.round(F.sum("confidence"), 4).alias("confidence")).crossJoin(missing)  # one row each


def lookup_by_name(spark, sf_dir):
    names = spark.range(0, 3).select(F.explode(F.array(*map(F.lit, ("THAT", " pour ", "und", "nobody", "rewh")))).alias("name"), "id")
    return entities.ids_by_name(names, standins.entities(spark)).groupBy("name", "entity_id").agg(F.count("*").alias("n"))


def mentions_by_document(spark, sf_dir):
    """Mentions gathered by document, in the order of their places."""
    one = F.struct("offset", "entity_id", "mention")
    x = documents._mentions(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(one)).alias("m"))
    return x.select("doc_id", F.size("m").cast(LONG).alias("n"), F.array_join(F.transform("m", lambda v: F.concat_ws(":", v["offset"], v["entity_id"], v["mention"])), ",").alias("mentions"))


def entropy_variants(spark, sf_dir):
    p = [F.col(f"score_{c}") for c in ("negative", "neutral", "positive")]
    return standins.scores(spark, sf_dir).select("event_id", F.round(T.entropy(*p), 5).alias("guarded"), F.round(T.entropy_smoothed(*p), 5).alias("smoothed"))


def promotion_merges(spark, sf_dir):
    """Candidates, dictionary and feeds after a promotion, as one table."""
    x = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "click").alias("hits"))
    name = F.when(F.col("user_id") == 4, "That").otherwise(F.concat(F.lit("User No "), F.col("user_id")))
    rows = x.select(name.alias("name"), entities.confirmed(entities.base_confidence(F.col("n")), F.col("hits")).alias("confidence"), "hits", F.when(F.col("user_id") % 2 == 0, "pending").otherwise("rejected").alias("status"))
    configs = spark.createDataFrame([("user_no_2", "User No 2")], "config_name string, entity_name string")
    marked, names, feeds = entities.promote(rows, standins.entities(spark), configs)
    return (
        marked.select(F.lit("candidate").alias("kind"), F.col("name").alias("key"), F.col("status").alias("value"))
        .unionByName(names.select(F.lit("entity").alias("kind"), F.col("canonical_name").alias("key"), F.col("entity_id").cast("string").alias("value")))
        .unionByName(feeds.select(F.lit("feed").alias("kind"), F.col("config_name").alias("key"), F.col("entity_name").alias("value")))
    )


def score_guards(spark, sf_dir):
    from ..operators import scoring

    return scoring.guards(standins.raw_texts(spark, sf_dir), documents._contexts(spark, sf_dir))


def queue_health(spark, sf_dir):
    return serving.health(spark.read.parquet(f"{sf_dir}/events.parquet"), F.col("event_type"), "ts", AS_OF)


def four_level_report(spark, sf_dir):
    judged = documents._judged(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id")
    cases = judged.select(F.when(F.col("doc_id") % 2 == 0, "adversarial").otherwise("domain").alias("level"), F.col("lang").alias("category"), (F.col("gold") == F.col("predicted")).alias("passed"))
    return evaluation.levels(cases, standins.scores(spark, sf_dir))


def scalar_subquery(spark, sf_dir):
    return relational._query(_ABOVE)(spark, sf_dir)


_ABOVE = "SELECT p_partkey, p_brand, p_retailprice FROM part p WHERE p_retailprice > (SELECT 1.01 * avg(p_retailprice) FROM part)"

# -- SQL for the second engine --------------------------------------------------------------------------------

D = standins.DUCK
_TERMS4 = "[" + ", ".join(f"'{t}'" for t in sorted({t for i, n, a in standins.ENTITIES for t in (n, *a) if len(t) >= 4})) + "]"
_PROFILE = ", ".join(f"(-len(list_filter(w, lambda x: x IN ({', '.join(repr(p) for p in V.PROFILES[k])}))), '{k}')" for k in ("de", "en", "es", "fr"))
_DASH = "SELECT s.entity_id, canonical_name, CAST(scored_at AS DATE) AS day, count(*) AS mentions, count(*) FILTER (WHERE label = 'positive') AS positive_count, count(*) FILTER (WHERE label = 'negative') AS negative_count, count(*) FILTER (WHERE label = 'neutral') AS neutral_count, round(avg(score_positive - score_negative), 4) AS avg_polarity FROM scores s JOIN entities e ON s.entity_id = e.entity_id WHERE confidence >= 0.6 AND {} GROUP BY 1, 2, 3"
_BEST = "SELECT entity_id, doc_id, polarity, confidence, scored_at FROM (SELECT * FROM (SELECT entity_id, doc_id, label AS polarity, confidence, scored_at, event_id, row_number() OVER (PARTITION BY entity_id, label ORDER BY confidence DESC, scored_at DESC, event_id) AS rn FROM scores WHERE entity_id IS NOT NULL AND label <> 'neutral' AND confidence >= 0.7 AND {}) WHERE rn <= 5) QUALIFY row_number() OVER (PARTITION BY entity_id, doc_id ORDER BY confidence DESC, scored_at DESC, event_id DESC) = 1"
_TITLED = "titled AS (SELECT doc_id, array_to_string(list_transform(string_split(lower(title), ' '), lambda w: upper(left(w, 1)) || substr(w, 2)), ' ') AS title FROM raw_texts)"
_TWICE, spans_sql = documents.TWICE, documents.spans_sql

_WHOLE = "title || chr(10) || text"
_SALIENT = """counted AS (SELECT doc_id, entity_id, count(*) AS n, bool_or(canonical AND "end" <= tl) AS in_title, min(start) AS first_offset FROM (SELECT s.*, length(r.title) AS tl FROM span s JOIN raw_texts r USING (doc_id)) GROUP BY doc_id, entity_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY in_title DESC, n DESC, first_offset) AS r0, max(in_title OR n > 1) OVER (PARTITION BY doc_id) AS passed FROM counted),
salient AS (SELECT doc_id, entity_id, n, in_title, first_offset, row_number() OVER (PARTITION BY doc_id ORDER BY in_title DESC, n DESC, first_offset) AS rank FROM ranked WHERE in_title OR n > 1 OR (NOT passed AND r0 = 1))"""
_UNGLUE = r"""flat AS (SELECT doc_id, title, text, regexp_replace(regexp_replace(text, 'https?://\S+|www\.\S+', ' ', 'g'), '[\w\.-]+@[\w\.-]+\.\w+', ' ', 'g') AS b, regexp_extract_all(title, '[\p{L}\p{N}_]+')[1:8] AS tw, len(regexp_extract_all(text, 'https?://\S+|www\.\S+')) + len(regexp_extract_all(text, '[\w\.-]+@[\w\.-]+\.\w+')) AS gone FROM raw_texts),
glued AS (SELECT *, CASE WHEN len(tw) > 0 THEN regexp_replace(b, '(?i)^\s*' || array_to_string(tw, '[^\p{L}\p{N}_]*'), '') ELSE b END AS c FROM flat),
loose AS (SELECT *, CASE WHEN length(c) < length(b) THEN regexp_replace(c, '^[ :\-\n"'']+', '') ELSE b END AS u FROM glued),
"""
_GONE = (r"<[^>]+>", *V.PORTAL_PATTERNS, V.PHOTO_CREDIT)
_UNGLUE += "bare AS (SELECT *, " + "regexp_replace(" * len(_GONE) + "u" + "".join(f", '{p}', '{' ' if p.startswith('<') else ''}', 'g')" for p in _GONE) + " AS v FROM loose)"
_MARKED = r"""done AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(translate(v, '“”‘’–—―‒', '""''''----'), '\s+([,.!?;:])', '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '[ \t]+', ' ', 'g')) AS clean FROM bare)"""
#: What stands up to a line's end or a full stop, without looking ahead.
_SHORT = [p.replace(r".*?(?=\n|$|\.)", r"[^\n.]*") for p in (*V.INTERFACE_PATTERNS, V.PHOTO_CREDIT)]


def clean_sql(text: str) -> str:
    """The enrichment cleaner as an expression of two CTEs over src(id, title, body)."""
    inner = f"regexp_replace({text}, 'https?://\\S+|www\\.\\S+', '', 'g')"
    for p in _SHORT:
        inner = f"regexp_replace({inner}, '{p}', '', 'g')"
    return rf"""stripped AS (SELECT *, {inner} AS s, trim(lower(regexp_replace(title, '[^\p{{L}}\p{{N}}_\s]', '', 'g'))) AS f FROM src),
unstuck AS (SELECT *, CASE WHEN length(f) > 0 AND starts_with(lower(left(s, 60)), left(f, 30)) THEN trim(regexp_replace(trim(substr(s, length(f) + 1)), '^[\s\-:|]+[a-zA-Z\s,\d]{{0,20}}', '')) ELSE s END AS g FROM stripped),
listed AS (SELECT *, list_filter(list_transform(string_split_regex(regexp_replace(g, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: length(x) > 15) AS ss FROM unstuck),
cleaned AS (SELECT *, trim(regexp_replace(regexp_replace(array_to_string(list_filter(ss, lambda x, i: list_position(ss, x) = i), ' '), '[ \t]{{2,}}', ' ', 'g'), '\.{{2,}}', '.', 'g')) AS article FROM listed)"""


_NAMES_RE = r"[^\p{L}\p{N}_]([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3})[^\p{L}\p{N}_]"
_LINE_NAMES = _NAMES_RE.replace(r"\s+", r"[ \t]+")
_PARSED = r"trim(regexp_replace(regexp_replace(replace(regexp_replace(replace(replace(replace(replace(text, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;|&apos;', '''', 'g'), '&nbsp;', ' '), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))".replace('\\"', '"')
_WORDS = r"list_distinct(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+'))"
_OUTSIDE = "script|style|nav|header|footer|aside|form|title|h1|noscript"
_TEXT_OF = rf"""array_to_string(list_filter(list_transform(string_split_regex(regexp_replace(html, '(?is)<({_OUTSIDE})[^>]*>.*?</({_OUTSIDE})>', '', 'g'), '(?i)<p(?:\s[^>]*)?>')[2:],
  lambda p: trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(p, '(?is)(</p>|<(div|article|section|table|ul)[\s>]).*$', ''), '<[^>]+>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g'))), lambda p: p <> ''), chr(10))"""

ORACLES: dict[str, str] = {
    "highlights_read": D + " SELECT entity_id, label AS polarity, doc_id, confidence, scored_at FROM scores WHERE entity_id = 3 AND label = 'positive' ORDER BY scored_at DESC NULLS LAST, event_id LIMIT 10",
    "binary_report": documents._Q + "SELECT round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM rep WHERE class = 1",
    "reprocess_by_version": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '1' END AS version FROM documents WHERE doc_id % 3 <> 1",
    "queue_lease": "WITH q AS (SELECT event_id AS msg_id, ts FROM events WHERE event_type = 'click'), a AS (SELECT msg_id FROM q WHERE ts <= TIMESTAMP '2024-01-20 00:00:00' ORDER BY msg_id LIMIT 30), b AS (SELECT msg_id FROM q WHERE ts <= TIMESTAMP '2024-01-20 00:30:00' AND msg_id NOT IN (SELECT msg_id FROM a) ORDER BY msg_id LIMIT 30) SELECT q.msg_id, CASE WHEN a.msg_id IS NOT NULL THEN TIMESTAMP '2024-01-20 01:00:00' WHEN b.msg_id IS NOT NULL THEN TIMESTAMP '2024-01-20 01:30:00' ELSE ts END AS visible_at, CAST(a.msg_id IS NOT NULL AS BIGINT) + CAST(b.msg_id IS NOT NULL AS BIGINT) AS read_count FROM q LEFT JOIN a ON q.msg_id = a.msg_id LEFT JOIN b ON q.msg_id = b.msg_id WHERE a.msg_id IS NULL OR a.msg_id % 2 = 1",
    "refreshed_dashboard": D + " " + _DASH.format("scored_at >= DATE '2024-01-11' AND scored_at < DATE '2024-02-01'"),
    "refreshed_highlights": D + f", old AS ({_BEST.format('scored_at >= DATE ' + repr('2023-12-16') + ' AND scored_at < DATE ' + repr('2024-01-16'))}), kept AS (SELECT * FROM old WHERE scored_at >= DATE '2024-01-11'), new AS ({_BEST.format('scored_at >= DATE ' + repr('2024-01-11') + ' AND scored_at < DATE ' + repr('2024-02-01'))}) SELECT k.entity_id, k.doc_id, k.polarity, round(coalesce(n.confidence, k.confidence), 6) AS confidence FROM kept k LEFT JOIN new n USING (entity_id, doc_id) UNION ALL SELECT entity_id, doc_id, polarity, round(confidence, 6) FROM new n WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.entity_id = n.entity_id AND k.doc_id = n.doc_id)",
    "dataset_nested": documents._BEST + ", one AS (SELECT doc_id, entity_id, context FROM b) SELECT r.doc_id, title, source, one.entity_id, canonical_name AS entity_name, sha256(context) AS context_sha256 FROM raw_texts r JOIN one USING (doc_id) JOIN entities USING (entity_id) WHERE length(text) >= 500",
    "audit_entities": D + f" SELECT doc_id, len(m) > 0 AS has_entity, array_to_string(m[1:3], '; ') AS matched_entities FROM (SELECT doc_id, list_filter({_TERMS4}, lambda t: contains(lower(text), t)) AS m FROM raw_texts)",
    "language_test": D + rf", t AS (SELECT doc_id, regexp_extract_all(lower(left(text, 500)), '[\p{{L}}\p{{N}}_]+') AS w FROM raw_texts), c AS (SELECT doc_id, unnest([{_PROFILE}]) AS s FROM t) SELECT doc_id, CASE WHEN min(s)[1] < 0 THEN min(s)[2] END AS language FROM c GROUP BY doc_id",
    "name_candidates": D + rf""", {_TITLED}, hit AS (SELECT title, {_TWICE.format("title")} AS t FROM titled WHERE contains(lower(title), 'the') OR contains(lower(title), 'and') OR contains(lower(title), 'que') OR contains(lower(title), 'der')),
      found AS (SELECT replace(replace(unnest(regexp_extract_all(t, '{_NAMES_RE}', 1)), '  ', ' '), chr(10) || chr(10), chr(10)) AS name FROM hit)
      SELECT name, count(*) AS mention_count, least(0.5::DOUBLE + count(*) * 0.1::DOUBLE, 0.8::DOUBLE) AS confidence FROM found WHERE NOT list_has_any(string_split_regex(lower(name), '\s+'), ['of', 'und']) AND lower(name) NOT IN (SELECT canonical_name FROM entities) GROUP BY name HAVING count(*) >= 3""",
    "entity_veto": D + rf""", {_TITLED}, {spans_sql("title || chr(10)", "titled")},
      person AS (SELECT doc_id, list_transform(regexp_extract_all({_TWICE.format("title")}, '{_LINE_NAMES}', 1), lambda p: replace(replace(p, '  ', ' '), chr(10) || chr(10), chr(10))) AS ps FROM titled),
      held AS (SELECT s.doc_id, s.entity_id, lower(mention) AS m, lower(list_filter(ps, lambda p: contains(lower(p), lower(mention)) AND length(p) > length(mention))[1]) AS h, canonical_name FROM span s JOIN person USING (doc_id) JOIN entities USING (entity_id))
      SELECT doc_id, entity_id, count(*) AS kept FROM held WHERE h IS NULL OR len(list_filter(string_split(canonical_name, ' '), lambda w: w <> m AND contains(h, w))) > 0 GROUP BY doc_id, entity_id""",
    "pre_attribution": D + f", {spans_sql(_WHOLE, 'raw_texts')}, first AS (SELECT doc_id, entity_id, min(start) AS start FROM span GROUP BY 1, 2) SELECT r.doc_id, r.doc_id % 20 AS entity_id, coalesce(f.start, -1) AS first_offset, 1.0::DOUBLE AS confidence, true AS is_main FROM raw_texts r LEFT JOIN first f ON f.doc_id = r.doc_id AND f.entity_id = r.doc_id % 20 WHERE r.doc_id % 4 = 0",
    "core_context": f"""{D}, {documents._SENTENCES_P}, {documents._WINDOWS.replace("joined AS (SELECT *, trim(concat_ws(' ', nullif(before, ''), sentence, nullif(after, ''))) AS whole,", "joined AS (SELECT * REPLACE (CASE WHEN NOT core AND act THEN '' ELSE after END AS after), trim(concat_ws(' ', nullif(before, ''), sentence, nullif(CASE WHEN NOT core AND act THEN '' ELSE after END, ''))) AS whole,").replace("concat_ws(' ', before, after)", "concat_ws(' ', before, CASE WHEN NOT core AND act THEN '' ELSE after END)").replace("AS after FROM marked)", "AS after, coalesce(list_reverse(regexp_extract_all(lower(left(sentence, greatest(instr(lower(sentence), 'that') - 1, 0))), '" + documents._WORD + "'))[1], '') NOT IN ('the', 'of') AS core FROM marked)")}
      SELECT m.doc_id, pos, core AS is_main_actor, CAST(CASE WHEN act AND core THEN 90 ELSE 50 END AS BIGINT) AS quality_score, length(context) AS chars FROM (SELECT doc_id, instr(lower(text), 'that') - 1 AS o FROM raw_texts) m JOIN windows s ON m.doc_id = s.doc_id AND o >= start AND o < "end" """,
    "readiness_history": D + f", t AS (SELECT *, {documents._TITLE} AS k FROM raw_texts WHERE doc_id % 3 <> 0), old AS (SELECT DISTINCT {documents._TITLE} AS k FROM raw_texts WHERE doc_id % 3 = 0), d AS (SELECT *, min(doc_id) OVER (PARTITION BY k) AS first FROM t) SELECT doc_id, CASE WHEN k <> '' AND (first <> doc_id OR k IN (SELECT k FROM old)) THEN 'skipped_duplicate_title' WHEN length(text) < 150 THEN 'failed_short_body' WHEN (length(title) >= 50 AND doc_id % 50 >= 20) OR length(text) >= 500 THEN 'queued' ELSE 'failed_no_context' END AS outcome FROM d",
    "near_duplicate_pairs": "WITH v AS (SELECT min(vec_id) AS rep, embedding FROM embeddings WHERE embedding IS NOT NULL GROUP BY embedding), p AS (SELECT a.rep AS a, b.rep AS b, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS cosine FROM v a JOIN v b ON a.rep <> b.rep), l AS (SELECT a, count(*) AS n, max(cosine) AS c FROM p WHERE cosine >= 0.45 GROUP BY a) SELECT vec_id, rep AS representative, coalesce(n, 0) AS n_links, round(c, 4) AS best_cosine FROM embeddings JOIN v USING (embedding) LEFT JOIN l ON rep = a",
    "scalar_subquery": _ABOVE,
    "stream_spike_alerts": relational.ORACLES["spike_alert_3sigma"],
    "entity_match_spans": D + f', {spans_sql(_WHOLE, "raw_texts")} SELECT doc_id, entity_id, CAST(start AS INT) AS start, CAST("end" AS INT) AS "end", mention, canonical FROM span',
    "entity_salience_map": D + f", {spans_sql(_WHOLE, 'raw_texts')}, {_SALIENT} SELECT doc_id, entity_id, n, in_title, CAST(first_offset AS INT) AS first_offset, rank, rank = 1 AS is_main, 'dictionary' AS resolver_source FROM salient",
    "normalize_full": D + f", {_UNGLUE}, {_MARKED} SELECT doc_id, length(text) AS original_len, length(clean) AS clean_len, CAST(gone AS BIGINT) AS addresses_removed, CASE WHEN clean <> '' THEN sha256(clean) END AS content_hash FROM done",
    "clean_article": D + f", src AS (SELECT doc_id, title, text FROM raw_texts), {clean_sql('text')} SELECT doc_id, length(article) AS clean_len FROM cleaned",
    "extract_main_text": f"""WITH src AS (SELECT page_id, html, regexp_extract(html, '<title>([^<]*)', 1) AS title, {_TEXT_OF} AS body FROM pages), {clean_sql('body')},
      gated AS (SELECT page_id, article, CASE WHEN html = '' THEN 'fetch_no_html' WHEN length(html) > 1500000 THEN 'rejected_html_too_large' WHEN len(regexp_extract_all(html, '(?i)<p[\\s>]')) < 5 THEN 'rejected_low_paragraph_density' WHEN length(article) < 500 THEN 'text_too_short' WHEN length(article) > 20000 THEN 'section_leakage_too_long'
        WHEN title = '' OR coalesce(len(list_intersect({_WORDS.format('title')}, {_WORDS.format('article')})) / nullif(len({_WORDS.format('title')}), 0), 0) < 0.15 THEN 'title_mismatch' ELSE 'valid_paragraphs' END AS gate FROM cleaned)
      SELECT page_id, gate, CASE WHEN gate = 'valid_paragraphs' THEN CAST(length(article) AS INT) END AS chars FROM gated""",
    "feed_parse": rf"""WITH i AS (SELECT source, 'http://x.example/' || doc_id AS link, nullif(regexp_replace(left(text, 60), '^\s+|\s+$', '', 'g'), '') AS title, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text FROM documents), b AS (SELECT *, {_PARSED} AS body FROM i)
      SELECT source, link AS source_id, title, link AS source_url, CAST(NULL AS VARCHAR) AS image_url, CASE WHEN length(body) < 20 AND title IS NOT NULL THEN title ELSE body END AS text, CAST(1704103200 AS BIGINT) AS published_at FROM b WHERE length(CASE WHEN length(body) < 20 AND title IS NOT NULL THEN title ELSE body END) >= 20""",
    "curation_quota": D + """, x AS (SELECT doc_id, doc_id % 20 AS entity_id, source AS media, text, md5(CAST(doc_id AS VARCHAR) || '42') || lpad(CAST(doc_id AS VARCHAR), 20, '0') || lpad(CAST(doc_id % 20 AS VARCHAR), 20, '0') AS o FROM raw_texts WHERE length(text) >= 300),
      y AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY text, entity_id ORDER BY o) = 1),
      z AS MATERIALIZED (SELECT *, dense_rank() OVER (ORDER BY media) AS mi, row_number() OVER (ORDER BY o) AS k FROM y),
      RECURSIVE_PLACE
      SELECT doc_id, entity_id, media FROM z JOIN (SELECT DISTINCT k FROM walk WHERE took) USING (k)""",
}
ORACLES |= {
    "archive_scan": r"SELECT 'page ' || page_id AS title, url AS source_url, regexp_extract(url, '://([^/]+)', 1) AS domain, left(sha256(url), 32) AS source_id, CAST(1704449700 AS BIGINT) AS published_at FROM pages WHERE regexp_extract(url, '://([^/]+)', 1) <> 'example.net' AND NOT ends_with(regexp_extract(url, '://([^/]+)', 1), '.example.net') AND NOT starts_with(url, 'https://www.')",
    "composite_join": D + f", {spans_sql('text', 'raw_texts')}, c AS (SELECT DISTINCT doc_id, entity_id FROM span), s AS (SELECT doc_id, entity_id, max(confidence) AS confidence FROM scores WHERE entity_id IS NOT NULL GROUP BY 1, 2) SELECT count(s.confidence) AS joined, round(sum(s.confidence), 4) AS confidence, count(*) - count(s.confidence) AS missing FROM c LEFT JOIN s USING (doc_id, entity_id)",
    "lookup_by_name": D + ", o AS (SELECT term, max(entity_id) AS entity_id FROM terms GROUP BY term) SELECT name, entity_id, CAST(3 AS BIGINT) AS n FROM (VALUES ('THAT'), (' pour '), ('und'), ('nobody'), ('rewh')) AS v(name) LEFT JOIN o ON o.term = lower(trim(name))",
    "mentions_by_document": D + f", {spans_sql('text', 'raw_texts')} SELECT doc_id, count(*) AS n, string_agg(start || ':' || entity_id || ':' || mention, ',' ORDER BY start) AS mentions FROM span GROUP BY doc_id",
    "entropy_variants": D + f" SELECT event_id, round(0 - ({' + '.join(documents._ENT(f'score_{c}') for c in ('negative', 'neutral', 'positive'))}), 5) AS guarded, round(0 - ({' + '.join(f'score_{c} * ln(score_{c} + 1e-9)' for c in ('negative', 'neutral', 'positive'))}), 5) AS smoothed FROM scores",
    "promotion_merges": f"{D}, {documents._CAND}, n AS (SELECT CASE WHEN user_id = 4 THEN 'That' ELSE 'User No ' || user_id END AS name, user_id % 2 = 0 AS open, user_id % 2 = 0 AND hits >= 3 AND CAST(confidence AS DOUBLE) >= 0.85 AS ok FROM k), fresh AS (SELECT name FROM n WHERE ok AND lower(name) NOT IN (SELECT lower(canonical_name) FROM entities)), feed AS (SELECT replace(lower(name), ' ', '_') AS key, name FROM n WHERE ok) SELECT 'candidate' AS kind, name AS key, CASE WHEN ok THEN 'approved' WHEN open THEN 'pending' ELSE 'rejected' END AS value FROM n UNION ALL SELECT 'entity', canonical_name, CAST(entity_id AS VARCHAR) FROM entities UNION ALL SELECT 'entity', name, CAST(19 + row_number() OVER (ORDER BY name) AS VARCHAR) FROM fresh UNION ALL SELECT 'feed', 'user_no_2', 'User No 2' UNION ALL SELECT 'feed', key, name FROM feed WHERE key <> 'user_no_2'",
    "score_guards": f"{documents._BEST}, r AS (SELECT length(context) AS n, len(list_intersect(list_distinct({documents._TOKENS('word')}), list_distinct({documents._TOKENS('context')}))) / CAST(len(list_distinct({documents._TOKENS('word')})) AS DOUBLE) AS rel FROM b) SELECT 'context' AS kind, CASE WHEN n < 10 THEN 'too_short' WHEN rel < 0.5 THEN 'not_relevant' ELSE 'scored' END AS reason, count(*) AS n FROM r GROUP BY 1, 2 UNION ALL SELECT 'document', CASE WHEN length(text) < 50 THEN 'too_short' ELSE 'scored' END, count(*) FROM raw_texts GROUP BY 1, 2",
    "queue_health": "SELECT event_type AS status, count(*) AS n, min(ts) AS oldest, max(ts) AS newest, count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-30 00:00:00') AS n_old FROM events GROUP BY 1",
    "four_level_report": documents._Q + "SELECT CASE WHEN doc_id % 2 = 0 THEN 'adversarial' ELSE 'domain' END AS level, lang AS key, count(*) AS n, round(avg(CAST(gold = predicted AS DOUBLE)), 4) AS value FROM judged JOIN documents USING (doc_id) GROUP BY 1, 2 UNION ALL SELECT 'distribution', label, count(*), round(round(100.0 * count(*) / (SELECT count(*) FROM scores), 2) / 100, 4) FROM scores GROUP BY label UNION ALL SELECT 'entity', CAST(entity_id AS VARCHAR), count(*), round(avg(score_positive - score_negative), 4) FROM scores WHERE entity_id IS NOT NULL GROUP BY entity_id",
}
_WALK = """walk(k, took, ms, es) AS (SELECT CAST(0 AS BIGINT), false, list_resize(CAST([] AS BIGINT[]), 1000, 0), list_resize(CAST([] AS BIGINT[]), 20, 0)
        UNION ALL SELECT z.k, w.ms[mi] < 15 AND w.es[entity_id + 1] < 12, CASE WHEN w.ms[mi] < 15 AND w.es[entity_id + 1] < 12 THEN list_transform(w.ms, lambda v, i: v + CAST(i = mi AS BIGINT)) ELSE w.ms END,
          CASE WHEN w.ms[mi] < 15 AND w.es[entity_id + 1] < 12 THEN list_transform(w.es, lambda v, i: v + CAST(i = entity_id + 1 AS BIGINT)) ELSE w.es END FROM walk w JOIN z ON z.k = w.k + 1)"""
ORACLES["curation_quota"] = ORACLES["curation_quota"].replace("RECURSIVE_PLACE", _WALK).replace("WITH ", "WITH RECURSIVE ", 1)

QUERIES = {
    f.__name__: f
    for f in (
        dashboard_summary, entity_highlights_topn, public_view, highlights_read, national_index_monthly, national_index_yearly, entity_yearly, entity_ranking_7d, entity_timeseries, entity_hotness,
        spike_alert_3sigma, trend_week_over_week, head_to_head, label_percentages, per_entity_breakdown, entropy_stats, confidence_calibration, finetune_join_audit, binary_report, insert_if_absent,
        retry_state, constraint_violations, delete_insert_scores, retention_keep_6_months, reprocess_by_version, queue_lease, refreshed_dashboard, refreshed_highlights, dataset_nested, audit_entities,
        language_test, name_candidates, entity_veto, pre_attribution, core_context, readiness_history, near_duplicate_pairs, feed_parse, curation_quota, stream_spike_alerts, scalar_subquery,
        archive_scan, composite_join, lookup_by_name, mentions_by_document, entropy_variants, promotion_merges, score_guards, queue_health, four_level_report,
    )
}
