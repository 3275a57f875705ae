"""Queries of the document operators over the stand-in tables, and independent SQL for a second engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from ..operators import context, dedup, entities, evaluation, merge, pages, quality, scoring
from . import standins

LONG = "bigint"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_score(standins.raw_texts(spark, sf_dir), V.CORPUS_STOPWORDS, F.col("lang") == "en")


def quality_score(spark, sf_dir):
    return _scored(spark, sf_dir).select("doc_id", F.col("score").cast(LONG).alias("score"), "reason")


def quality_routing(spark, sf_dir):
    return quality.route(_scored(spark, sf_dir)).select("doc_id", "status", "fail_reason", "content_type")


def status_distribution(spark, sf_dir):
    return quality.route(_scored(spark, sf_dir)).groupBy("status", "lang").agg(F.count("*").alias("n"))


def fail_reason_counts(spark, sf_dir):
    return quality.route(_scored(spark, sf_dir)).where("status = 'failed'").groupBy("fail_reason").agg(F.count("*").alias("n"))


def normalize_urls_emails(spark, sf_dir):
    docs = standins.raw_texts(spark, sf_dir)
    clean, n = quality.strip_addresses(F.col("text"))
    return docs.select("doc_id", n.cast(LONG).alias("removed"), F.sha2(clean, 256).alias("clean_sha256"))


def normalize_full(spark, sf_dir):
    return quality.normalise(standins.raw_texts(spark, sf_dir)).select("doc_id", "original_len", "clean_len", "addresses_removed", "content_hash")


def clean_article(spark, sf_dir):
    docs = standins.raw_texts(spark, sf_dir)
    return docs.select("doc_id", F.length(quality.clean_article(F.col("text"), F.col("title"))).cast(LONG).alias("clean_len"))


def exact_text_dedup(spark, sf_dir):
    return dedup.exact(standins.raw_texts(spark, sf_dir)).select("doc_id", "duplicate_of")


def dedup_counts(spark, sf_dir):
    docs = standins.raw_texts(spark, sf_dir)
    registry = docs.where("doc_id % 4 = 0").select(F.sha2("text", 256).alias("text_hash"))
    return dedup.insert_new(docs.where("doc_id % 4 <> 0"), registry)[1]


def content_dedup_duplicate_of(spark, sf_dir):
    docs = standins.raw_texts(spark, sf_dir).withColumn("clean_text", T.strip_markup(F.lower("text")))
    return dedup.by_content(docs).select("doc_id", "duplicate_of")


def title_dedup(spark, sf_dir):
    return dedup.by_title(standins.raw_texts(spark, sf_dir)).select("doc_id", "duplicate_of")


def title_anti_join(spark, sf_dir):
    docs = standins.raw_texts(spark, sf_dir)
    return dedup.not_known(docs.where("doc_id % 3 = 0"), docs.where("doc_id % 3 <> 0 AND lang = 'en'"), F.nullif(T.normal_title(F.col("title")), F.lit(""))).select("doc_id", "lang")


def sentence_dedup(spark, sf_dir):
    docs = standins.raw_texts(spark, sf_dir)
    kept = quality.unique_sentences(F.col("text"))
    return docs.select("doc_id", F.array_size(T.sentences(F.col("text"))).cast(LONG).alias("n_sentences"), F.array_size(kept).cast(LONG).alias("n_kept"), F.sha2(F.array_join(kept, " "), 256).alias("kept_sha256"))


def near_duplicate_pairs(spark, sf_dir):
    x = dedup.cosine_pairs(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 0.95)
    return x.select("a", "b", F.round("cosine", 4).alias("cosine"))


def title_relevancy(spark, sf_dir):
    r = quality.title_relevancy(F.col("title"), F.col("text"))
    return standins.raw_texts(spark, sf_dir).select("doc_id", F.round(r, 6).alias("relevancy"), (r >= V.TITLE_THRESHOLD).alias("relevant"))


def title_bigram_causality(spark, sf_dir):
    return standins.raw_texts(spark, sf_dir).select("doc_id", F.round(quality.title_causality(F.col("title"), F.col("text")), 6).alias("causality"))


def fulltext_audit(spark, sf_dir):
    return quality.audit(standins.raw_texts(spark, sf_dir)).groupBy("finding").agg(F.count("*").alias("n"))


def boilerplate_ratio(spark, sf_dir):
    r = quality.boilerplate_ratio(F.col("text"))
    return standins.raw_texts(spark, sf_dir).select("doc_id", F.round(r, 6).alias("ratio"), (r > V.MAX_BOILERPLATE).alias("rejected"))


def lexicon_baseline(spark, sf_dir):
    return standins.raw_texts(spark, sf_dir).select("doc_id", quality.lexicon_label(F.col("text"), V.CORPUS_POSITIVE, V.CORPUS_NEGATIVE).alias("label"))


# -- pages ----------------------------------------------------------------------------------------------------


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def html_paragraph_gate(spark, sf_dir):
    n = F.regexp_count(F.lower("html"), F.lit(r"<p[ >]"))
    return _pages(spark, sf_dir).select("page_id", n.cast(LONG).alias("paragraphs"), F.when(F.length("html") > V.MAX_HTML, "rejected_html_too_large").when(n < V.MIN_PARAGRAPHS, "rejected_low_paragraph_density").otherwise("ok").alias("gate"))


def interstitial_detect(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", T.is_interstitial(F.col("html")).alias("blocked"))


def canonical_url(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", T.canonical_url(F.col("html")).alias("canonical"), pages.first_outside_link(F.col("html")).alias("outside_link"))


def url_host_homepage(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", T.url_host(F.col("url")).alias("host"), T.is_homepage(F.col("url")).alias("homepage"), T.query_value(F.col("url"), "page").alias("page"))


def extract_main_text(spark, sf_dir):
    x = _pages(spark, sf_dir).withColumn("title", F.regexp_extract("html", "<title>([^<]*)", 1))
    return pages.extraction_gate(x).select("page_id", "gate", F.length("article_text").alias("chars"))


def feed_parse(spark, sf_dir):
    from ..sources import feeds

    # The end of a section inside a text is split over two sections.
    whole = F.replace(F.col("text"), F.lit("]]>"), F.lit("]]]]><![CDATA[>"))
    item = F.concat(F.lit("<item><title>"), F.substring("text", 1, 60), F.lit("</title><link>"), F.concat(F.lit("http://x.example/"), F.col("doc_id")), F.lit("</link><pubDate>Mon, 01 Jan 2024 10:00:00 GMT</pubDate><description><![CDATA["), whole, F.lit("]]></description></item>"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return feeds.items(docs.select(F.col("source").alias("config_name"), F.concat(F.lit("<rss><channel>"), item, F.lit("</channel></rss>")).alias("xml"))).drop("metadata")


# -- entities and contexts ------------------------------------------------------------------------------------


def _terms() -> list[tuple[str, int, bool]]:
    last: dict[str, tuple[int, bool]] = {}
    for i, name, aliases in standins.ENTITIES:
        for t in (name, *aliases):
            last[t] = max(last.get(t, (i, t == name)), (i, t == name))
    return [(t, i, c) for t, (i, c) in sorted(last.items())]


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = standins.raw_texts(spark, sf_dir)
    return entities.match(docs, entities.dictionary(standins.entities(spark)), entities.composed(F.col("title"), F.col("text")))


def entity_match_spans(spark, sf_dir):
    return entities.hits(_matched(spark, sf_dir)).drop("title_len")


def entity_match_counts(spark, sf_dir):
    docs = standins.raw_texts(spark, sf_dir)
    found = entities.mentions_native(docs, [t for t, _, _ in _terms()], F.concat_ws("\n", "title", "text"))
    terms = entities.dictionary(standins.entities(spark))
    return found.join(F.broadcast(terms), "term").groupBy("entity_id").agg(F.count("*").alias("mentions"), F.countDistinct("doc_id").alias("docs"))


def top_mentioned_entities(spark, sf_dir):
    return entity_match_counts(spark, sf_dir).orderBy(F.desc("mentions"), "entity_id").limit(5)


def entity_presence(spark, sf_dir):
    """Entities whose alias of four letters and more occurs anywhere: one row for each document and entity."""
    docs, low = standins.raw_texts(spark, sf_dir), F.lower(F.concat_ws(" ", "title", "text"))
    long = [(i, [t for t in (n, *a) if len(t) >= 4]) for i, n, a in standins.ENTITIES]
    found = F.array(*[F.when(low.rlike("|".join(map(T.quoted, terms))), F.lit(i).cast(LONG)) for i, terms in long if terms])
    return docs.select("doc_id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("entity_id"))


def entity_salience_map(spark, sf_dir):
    return entities.salience(_matched(spark, sf_dir))


def name_candidates(spark, sf_dir):
    docs = standins.raw_texts(spark, sf_dir)
    return entities.candidates(docs.select(F.initcap("title").alias("title")), standins.entities(spark), ("the", "and", "que", "der"), 3, ("of", "und"))


def candidate_confidence(spark, sf_dir):
    x = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "click").alias("hits"))
    return x.select("user_id", F.round(entities.confirmed(entities.base_confidence(F.col("n")), F.col("hits")), 4).alias("confidence"))


def candidate_promotion(spark, sf_dir):
    x = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "click").alias("hits"))
    x = x.select(F.concat(F.lit("User No "), F.col("user_id")).alias("name"), entities.confirmed(entities.base_confidence(F.col("n")), F.col("hits")).alias("confidence"), "hits", F.when(F.col("user_id") % 2 == 0, "pending").otherwise("rejected").alias("status"))
    return entities.promoted(x).select("name", "config_name", "status", F.round("confidence", 4).alias("confidence"))


def _sentences(spark, sf_dir):
    return context.sentence_table(standins.raw_texts(spark, sf_dir), F.col("text"))


def sentence_table(spark, sf_dir):
    x = _sentences(spark, sf_dir)
    return x.select("doc_id", "pos", F.col("start").cast(LONG).alias("start"), F.col("end").cast(LONG).alias("end"), F.length("sentence").cast(LONG).alias("chars"))


def _windows(spark, sf_dir):
    return context.windows(_sentences(spark, sf_dir), ("that", "with"), ("was",), ("the",))


def context_windows(spark, sf_dir):
    return _windows(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if("has_action").alias("actions"), F.sum(F.length("context")).cast(LONG).alias("chars"))


def context_word_cap(spark, sf_dir):
    return _windows(spark, sf_dir).groupBy("doc_id").agg(F.max(F.size(T.words(F.col("context")))).alias("most_words"))


def _mentions(spark, sf_dir):
    """All places of the dictionary's terms in the texts."""
    docs, names = standins.raw_texts(spark, sf_dir), standins.entities(spark)
    found = entities.hits(entities.match(docs, entities.dictionary(names), F.col("text")))
    found = found.select("doc_id", "entity_id", F.col("start").cast(LONG).alias("offset"), "mention")
    return found.join(F.broadcast(names.select("entity_id", "canonical_name")), "entity_id")  # the dictionary of the stand-ins: 20 rows


def anchor_sentence(spark, sf_dir):
    return context.anchors(_mentions(spark, sf_dir), _sentences(spark, sf_dir)).select("doc_id", "entity_id", "offset", "pos")


def _contexts(spark, sf_dir):
    found = context.anchors(_mentions(spark, sf_dir), _sentences(spark, sf_dir))
    return context.best(found.join(_windows(spark, sf_dir), ["doc_id", "pos"]))


def best_context(spark, sf_dir):
    return _contexts(spark, sf_dir).select("doc_id", "entity_id", "pos", "quality_score", "attr_score", "pos_score", F.length("context").alias("chars"))


def readiness_gate(spark, sf_dir):
    contexts = standins.raw_texts(spark, sf_dir).select("doc_id", F.col("title").alias("context"), (F.col("doc_id") % 50).cast("int").alias("quality_score"))
    return context.readiness(standins.raw_texts(spark, sf_dir), contexts).select("doc_id", "outcome")


_SCORER = scoring.lexicon_scores(V.CORPUS_POSITIVE, V.CORPUS_NEGATIVE)


def score_documents(spark, sf_dir):
    x = scoring.score_documents(standins.raw_texts(spark, sf_dir), _SCORER)
    return x.select("doc_id", "entity_id", "label", *[F.round(c, 6).alias(c) for c in ("score_negative", "score_neutral", "score_positive", "confidence", "polarity", "entropy")])


def score_entities_gated(spark, sf_dir):
    x = scoring.score_contexts(_contexts(spark, sf_dir), _SCORER)
    return x.select("doc_id", "entity_id", "label", F.round("confidence", 6).alias("confidence"), F.round("relevancy", 6).alias("relevancy"))


# -- evaluation and changes -----------------------------------------------------------------------------------


def _judged(spark, sf_dir):
    gold = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").cast(LONG).alias("gold"))
    return quality_score(spark, sf_dir).join(gold, "doc_id").select("doc_id", "gold", (F.col("score") >= V.QUALITY_THRESHOLD).cast(LONG).alias("predicted"))


def confusion_matrix(spark, sf_dir):
    return evaluation.confusion(_judged(spark, sf_dir))


def classification_report(spark, sf_dir):
    x = evaluation.report(evaluation.confusion(_judged(spark, sf_dir)))
    return x.select("class", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], F.col("support").cast(LONG).alias("support"))


def report_averages(spark, sf_dir):
    x = evaluation.averages(evaluation.report(evaluation.confusion(_judged(spark, sf_dir))))
    return x.select(*[F.round(c, 6).alias(c) for c in x.columns])


def cohen_kappa(spark, sf_dir):
    x = evaluation.agreement(evaluation.confusion(_judged(spark, sf_dir)))
    return x.select("n", F.round("accuracy", 6).alias("accuracy"), F.round("kappa", 6).alias("kappa"))


def pass_rate_by_category(spark, sf_dir):
    x = _judged(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id")
    x = evaluation.pass_rate(x, "lang", F.col("gold") == F.col("predicted"))
    return x.withColumn("rate", F.round("rate", 6))


def upsert_partial_update(spark, sf_dir):
    docs = standins.raw_texts(spark, sf_dir).select("doc_id", "title", "lang", "source")
    changes = docs.where("doc_id % 5 = 0").select("doc_id", F.when(F.col("doc_id") % 10 == 0, F.concat("title", F.lit("!"))).alias("title"), F.lit("xx").alias("lang"))
    return merge.partial_update(docs, changes, ["doc_id"])


def upsert_by_key(spark, sf_dir):
    docs = standins.raw_texts(spark, sf_dir).select("doc_id", "lang", "source")
    rows = docs.where("doc_id % 7 = 0").select((F.col("doc_id") * 2).alias("doc_id"), F.lit("new").alias("lang"), "source")
    return merge.upsert(docs, rows, ["doc_id"], ["lang"])


def curation_quota(spark, sf_dir):
    docs = standins.raw_texts(spark, sf_dir).where("length(text) >= 300")
    rows = docs.select("doc_id", (F.col("doc_id") % 20).alias("entity_id"), F.col("source").alias("media"), F.sha2("text", 256).alias("content_hash"))
    return evaluation.curated(rows, 42, 15, 12)


def gold_template_sentiment(spark, sf_dir):
    return evaluation.sentiment_template(standins.scores(spark, sf_dir), standins.raw_texts(spark, sf_dir), standins.entities(spark), 10, 42).drop("text_preview")


def gold_template_relevancy(spark, sf_dir):
    terms = {i: [t for t in (n, *a) if len(t) >= 4] for i, n, a in standins.ENTITIES}
    return evaluation.relevancy_template(standins.raw_texts(spark, sf_dir), terms, 30, 42, names={i: n for i, n, _ in standins.ENTITIES}).drop("text_preview")


def failure_samples(spark, sf_dir):
    x = evaluation.first_of_each(quality.route(_scored(spark, sf_dir)).where("status = 'failed'"), "fail_reason", "doc_id")
    return x.select("fail_reason", "doc_id", "rn", F.length("text").cast(LONG).alias("chars"))


# -- SQL for the second engine --------------------------------------------------------------------------------

_STOP = "[" + ", ".join(f"'{w}'" for w in V.CORPUS_STOPWORDS) + "]"
_WORD = r"[\p{L}\p{N}_]+"


def _hits(expr: str, words: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"CAST(contains({expr}, '{w}') AS INT)" for w in words) + ")"


_Q = rf"""{standins.DUCK}, w AS (
  SELECT *, list_filter(regexp_split_to_array(trim(text), '\s+'), lambda x: x <> '') AS ws,
    list_filter(list_distinct(regexp_extract_all(lower(title), '{_WORD}')), lambda x: NOT list_contains({_STOP}, x)) AS tw, list_distinct(regexp_extract_all(lower(text), '{_WORD}')) AS xw FROM raw_texts
), f AS (
  SELECT *, len(ws) AS n, list_has_any(ws, {_STOP}) AS stop, len(tw) AS nt, CASE WHEN len(tw) > 0 THEN len(list_intersect(tw, xw)) / CAST(len(tw) AS DOUBLE) ELSE 0 END AS ratio FROM w
), e AS (
  SELECT *, CASE WHEN length(text) >= 1000 THEN 25 WHEN length(text) >= 500 THEN 15 WHEN length(text) >= 300 THEN 10 ELSE 0 END
    + CASE WHEN n >= 150 THEN 25 WHEN n >= 70 THEN 15 WHEN n >= 40 THEN 5 ELSE 0 END + CASE WHEN n > 0 THEN (CASE WHEN stop THEN 15 ELSE 0 END) + (CASE WHEN lang = 'en' THEN 10 ELSE 0 END) ELSE 0 END
    + CASE WHEN nt > 0 THEN CAST(floor(ratio * 25) AS INT) ELSE 0 END AS got, 50 + CASE WHEN n > 0 THEN 25 ELSE 0 END + CASE WHEN nt > 0 THEN 25 ELSE 0 END AS most, {_hits("lower(text)", V.SOFT_PHRASES)} AS soft FROM f
), q AS (
  SELECT *, CASE WHEN text = '' OR title = '' THEN 'empty_input' WHEN {_hits("lower(left(text, 200))", V.BLOCK_PHRASES)} > 0 THEN 'noise_page' WHEN length(text) > 20000 THEN 'rejected_section_page'
    WHEN nt > 0 AND ratio < 0.2 THEN 'rejected_title_mismatch' END AS no, CAST(floor(CAST(greatest(got - soft * 8, 0) AS DOUBLE) / most * 100) AS BIGINT) AS raw_score FROM e
), scored AS (
  SELECT *, CASE WHEN no IS NOT NULL THEN 0 ELSE least(raw_score, 100) END AS score, coalesce(no, CASE WHEN raw_score >= 80 THEN 'validated' WHEN n < 70 THEN 'low_quality_too_short' WHEN NOT stop THEN 'low_quality_no_stopword' ELSE 'low_quality' END) AS reason FROM q
), judged AS (SELECT doc_id, CAST(l.quality AS BIGINT) AS gold, CAST(score >= 80 AS BIGINT) AS predicted FROM scored JOIN labels l USING (doc_id)),
matrix AS (SELECT gold, predicted, count(*) AS n FROM judged GROUP BY gold, predicted),
per AS (SELECT class, coalesce(tp / nullif(CAST(said AS DOUBLE), 0), 0) AS precision, coalesce(tp / nullif(CAST(support AS DOUBLE), 0), 0) AS recall, support FROM (
  SELECT c AS class, coalesce(sum(n) FILTER (WHERE gold = c AND predicted = c), 0) AS tp, coalesce(sum(n) FILTER (WHERE gold = c), 0) AS support, coalesce(sum(n) FILTER (WHERE predicted = c), 0) AS said
  FROM matrix, (SELECT gold AS c FROM matrix UNION SELECT predicted FROM matrix) k GROUP BY c)),
rep AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM per)
"""
_TITLE = r"""regexp_replace(regexp_replace(trim(lower(coalesce(title, ''))), '[\[\]\(\)\{\}"'':;,!?./]', '', 'g'), '\s+', ' ', 'g')"""
_FIRST = "{pre} SELECT r.doc_id, CASE WHEN f.first <> r.doc_id THEN f.first END AS duplicate_of FROM (SELECT doc_id, {key} AS k FROM raw_texts) r LEFT JOIN (SELECT {key} AS k, min(doc_id) AS first FROM raw_texts GROUP BY 1) f ON r.k = f.k AND r.k <> ''"
_MARKUP = r"trim(regexp_replace(regexp_replace(replace(regexp_replace(replace(replace(replace(replace(lower(text), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;|&apos;', '''', 'g'), '&nbsp;', ' '), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))".replace('\\"', '"')
_SENT = r"""list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: length(s) > 15)"""
_SENTENCES = r"""pieces AS (SELECT doc_id, generate_subscripts(p, 1) AS k, unnest(p) AS piece FROM (SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?]\s+)', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> '') AS p FROM raw_texts)),
placed AS (SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, regexp_replace(piece, '\s+$', '') AS sentence FROM pieces),
sentences AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS BIGINT) AS pos, CAST(start AS BIGINT) AS start, CAST(start + length(sentence) AS BIGINT) AS "end", sentence FROM placed WHERE length(trim(sentence)) > 10)"""
_ALTS = "|".join(t.replace(" ", "  ") for t in sorted((t for t, _, _ in _terms()), key=lambda t: (-len(t), t)))
#: Every character that is no letter, digit or underscore stands twice, so that a pattern may take one on either side.
TWICE = r"'  ' || regexp_replace({}, '([^\p{{L}}\p{{N}}_])', '\1\1', 'g') || '  '"
_ALT = rf"[^\p{{L}}\p{{N}}_]({_ALTS})[^\p{{L}}\p{{N}}_]"
_OTHER = r"'[\p{L}\p{N}_]', '', 'g'"


def spans_sql(raw: str, source: str) -> str:
    """CTEs up to span(doc_id, raw, start, "end", mention, entity_id, canonical): all matches in the expression raw of source."""
    return rf"""twice AS (SELECT doc_id, {raw} AS raw, {TWICE.format(f"lower({raw})")} AS t FROM {source}),
cut AS (SELECT doc_id, raw, regexp_extract_all(t, '{_ALT}', 1) AS ms, string_split_regex(t, '{_ALT}') AS ps FROM twice),
part AS (SELECT doc_id, raw, k, ms[k] AS m, ps[k] AS p FROM (SELECT doc_id, raw, ms, ps, unnest(range(1, len(ms) + 1)) AS k FROM cut)),
size AS (SELECT *, length(regexp_replace(p, {_OTHER})) AS po, length(p) - length(regexp_replace(p, {_OTHER})) AS pw, length(regexp_replace(m, {_OTHER})) AS mo, length(m) - length(regexp_replace(m, {_OTHER})) AS mw FROM part),
far AS (SELECT *, sum(pw) OVER w + sum(mw) OVER w - mw + (sum(po) OVER w + sum(mo + 2) OVER w - mo - 1 - 2) // 2 AS start, mw + mo // 2 AS n FROM size WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
owner AS (SELECT term, max(entity_id) AS entity_id FROM terms GROUP BY term),
named AS (SELECT o.term, o.entity_id, bool_or(t.canonical) AS canonical FROM owner o JOIN terms t ON t.term = o.term AND t.entity_id = o.entity_id GROUP BY 1, 2),
span AS (SELECT doc_id, raw, CAST(start AS BIGINT) AS start, CAST(start + n AS BIGINT) AS "end", substr(raw, CAST(start AS BIGINT) + 1, CAST(n AS BIGINT)) AS mention, entity_id, canonical FROM far JOIN named ON named.term = lower(substr(raw, CAST(start AS BIGINT) + 1, CAST(n AS BIGINT))))"""


_MENTIONS = (
    "found AS (SELECT doc_id, replace(unnest(regexp_extract_all('  ' || regexp_replace(lower(title || chr(10) || text), '([^\\p{L}\\p{N}_])', '\\1\\1', 'g') || '  ', '[^\\p{L}\\p{N}_](" + _ALTS + ")[^\\p{L}\\p{N}_]', 1)), '  ', ' ') AS term FROM raw_texts), "
    "owner AS (SELECT term, max(entity_id) AS entity_id FROM terms GROUP BY term), counted AS (SELECT entity_id, count(*) AS mentions, count(DISTINCT doc_id) AS docs FROM found JOIN owner USING (term) GROUP BY entity_id)"
)
_CAND = "c AS (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'click') AS hits FROM events GROUP BY user_id), b AS (SELECT *, least(0.5 + n * 0.1, 0.8) AS base FROM c), k AS (SELECT *, CASE WHEN hits >= 10 THEN least(base + 0.15, 0.95) WHEN hits >= 5 THEN least(base + 0.10, 0.90) WHEN hits >= 3 THEN least(base + 0.05, 0.85) ELSE base END AS confidence FROM b)"
_LEX = f"lx AS (SELECT *, {_hits('low', V.CORPUS_POSITIVE)} AS p, {_hits('low', V.CORPUS_NEGATIVE)} AS g FROM (SELECT *, lower(left(trim(title || '. ' || text), 1500)) AS low FROM raw_texts WHERE length(text) >= 50)), ls AS (SELECT doc_id, CAST(g AS DOUBLE) / (p + g + 1) AS neg, 1.0::DOUBLE / (p + g + 1) AS neu, CAST(p AS DOUBLE) / (p + g + 1) AS pos FROM lx)"
_ENT = lambda c: f"CASE WHEN {c} > 1e-9 THEN {c} * ln({c}) ELSE 0 END"
D = standins.DUCK

ORACLES: dict[str, str] = {
    "quality_score": _Q + "SELECT doc_id, score, reason FROM scored",
    "quality_routing": _Q + "SELECT doc_id, CASE WHEN reason = 'validated' THEN 'validated' ELSE 'failed' END AS status, nullif(reason, 'validated') AS fail_reason, CASE WHEN reason = 'validated' THEN 'FULLTEXT' END AS content_type FROM scored",
    "status_distribution": _Q + "SELECT CASE WHEN reason = 'validated' THEN 'validated' ELSE 'failed' END AS status, lang, count(*) AS n FROM scored GROUP BY 1, 2",
    "fail_reason_counts": _Q + "SELECT reason AS fail_reason, count(*) AS n FROM scored WHERE reason <> 'validated' GROUP BY 1",
    "normalize_urls_emails": D + r" SELECT doc_id, len(regexp_extract_all(text, 'https?://\S+|www\.\S+')) + len(regexp_extract_all(text, '[\w\.-]+@[\w\.-]+\.\w+')) AS removed, sha256(regexp_replace(regexp_replace(text, 'https?://\S+|www\.\S+', ' ', 'g'), '[\w\.-]+@[\w\.-]+\.\w+', ' ', 'g')) AS clean_sha256 FROM raw_texts",
    "exact_text_dedup": _FIRST.format(pre=D, key="text"),
    "dedup_counts": D + " SELECT count(*) FILTER (WHERE fresh) AS inserted, count(*) FILTER (WHERE NOT fresh) AS duplicate FROM (SELECT row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1 AND text NOT IN (SELECT text FROM documents WHERE doc_id % 4 = 0) AS fresh FROM raw_texts WHERE doc_id % 4 <> 0)",
    "content_dedup_duplicate_of": _FIRST.format(pre=D, key=_MARKUP),
    "title_dedup": _FIRST.format(pre=D, key=_TITLE),
    "title_anti_join": D + f" SELECT doc_id, lang FROM raw_texts WHERE doc_id % 3 = 0 AND ({_TITLE} = '' OR {_TITLE} NOT IN (SELECT {_TITLE} FROM raw_texts WHERE doc_id % 3 <> 0 AND lang = 'en'))",
    "sentence_dedup": D + rf", s AS (SELECT doc_id, len(string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS n_sentences, {_SENT} AS ss FROM raw_texts), u AS (SELECT doc_id, n_sentences, list_filter(ss, lambda x, i: list_position(ss, x) = i) AS kept FROM s) SELECT doc_id, n_sentences, len(kept) AS n_kept, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM u",
    "title_relevancy": D + rf", t AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(title), '{_WORD}')) AS a, list_distinct(regexp_extract_all(lower(text), '{_WORD}')) AS b FROM raw_texts), r AS (SELECT doc_id, CASE WHEN len(a) = 0 THEN 0 ELSE len(list_intersect(a, b)) / CAST(len(a) AS DOUBLE) END AS v FROM t) SELECT doc_id, round(v, 6) AS relevancy, v >= 0.15 AS relevant FROM r",
    "boilerplate_ratio": D + r", r AS (SELECT doc_id, CASE WHEN length(text) > 0 THEN len(regexp_extract_all(text, '(?i)(Baca Juga|Simak Juga|Berita Terkait|Advertisement|Ikuti Kami|Copyright|©|Reportase:|Jurnalis:|Editor:)[^\n]*')) * 50 / CAST(length(text) AS DOUBLE) ELSE 0 END AS v FROM raw_texts) SELECT doc_id, round(v, 6) AS ratio, v > 0.2 AS rejected FROM r",
    "lexicon_baseline": D + f", l AS (SELECT doc_id, {_hits('lower(text)', V.CORPUS_POSITIVE)} AS p, {_hits('lower(text)', V.CORPUS_NEGATIVE)} AS n FROM raw_texts) SELECT doc_id, CASE WHEN p > n THEN 'positive' WHEN n > p THEN 'negative' ELSE 'neutral' END AS label FROM l",
    "html_paragraph_gate": "SELECT page_id, len(regexp_extract_all(lower(html), '<p[ >]')) AS paragraphs, CASE WHEN length(html) > 1500000 THEN 'rejected_html_too_large' WHEN len(regexp_extract_all(lower(html), '<p[ >]')) < 5 THEN 'rejected_low_paragraph_density' ELSE 'ok' END AS gate FROM pages",
    "interstitial_detect": "SELECT page_id, regexp_matches(lower(left(html, 3000)), '" + "|".join(V.INTERSTITIAL_PATTERNS) + "') AS blocked FROM pages",
    "url_host_homepage": r"SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)), '^www\.', '') AS host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) IN ('', '/', '/index.html', '/index.php') AS homepage, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page FROM pages",
    "entity_match_counts": D + ", " + _MENTIONS + " SELECT * FROM counted",
    "top_mentioned_entities": D + ", " + _MENTIONS + " SELECT * FROM counted ORDER BY mentions DESC, entity_id LIMIT 5",
    "entity_presence": D + " SELECT DISTINCT doc_id, entity_id FROM raw_texts, terms WHERE length(term) >= 4 AND contains(lower(title || ' ' || text), term)",
    "candidate_confidence": f"WITH {_CAND} SELECT user_id, round(CAST(confidence AS DOUBLE), 4) AS confidence FROM k",
    "candidate_promotion": f"WITH {_CAND} SELECT 'User No ' || user_id AS name, 'user_no_' || user_id AS config_name, 'approved' AS status, round(CAST(confidence AS DOUBLE), 4) AS confidence FROM k WHERE user_id % 2 = 0 AND hits >= 3 AND CAST(confidence AS DOUBLE) >= 0.85",
    "sentence_table": D + ", " + _SENTENCES + ' SELECT doc_id, pos, start, "end", length(sentence) AS chars FROM sentences',
    "anchor_sentence": D + ", " + spans_sql("text", "raw_texts") + ", " + _SENTENCES + ', m AS (SELECT doc_id, entity_id, start AS "offset" FROM span) SELECT m.doc_id, entity_id, "offset", pos FROM m JOIN sentences s ON m.doc_id = s.doc_id AND "offset" >= s.start AND "offset" < s."end"',
    "readiness_gate": D + f", t AS (SELECT *, {_TITLE} AS k FROM raw_texts), d AS (SELECT *, min(doc_id) OVER (PARTITION BY k) AS first FROM t) SELECT doc_id, CASE WHEN k <> '' AND first <> doc_id THEN 'skipped_duplicate_title' WHEN length(text) < 150 THEN 'failed_short_body' WHEN (length(title) >= 50 AND doc_id % 50 >= 20) OR length(text) >= 500 THEN 'queued' ELSE 'failed_no_context' END AS outcome FROM d",
    "score_documents": D + f", {_LEX} SELECT doc_id, CAST(NULL AS BIGINT) AS entity_id, CASE WHEN neg >= neu AND neg >= pos THEN 'negative' WHEN neu >= pos THEN 'neutral' ELSE 'positive' END AS label, round(neg, 6) AS score_negative, round(neu, 6) AS score_neutral, round(pos, 6) AS score_positive, round(greatest(neg, neu, pos), 6) AS confidence, round(pos - neg, 6) AS polarity, round(0 - ({_ENT('neg')} + {_ENT('neu')} + {_ENT('pos')}), 6) AS entropy FROM ls",
    "confusion_matrix": _Q + "SELECT gold, predicted, n FROM matrix",
    "classification_report": _Q + "SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM rep",
    "report_averages": _Q + "SELECT " + ", ".join(f"round(avg({m}), 6) AS macro_{m}, round(sum({m} * support) / sum(support), 6) AS weighted_{m}" for m in ("precision", "recall", "f1")) + " FROM rep",
    "cohen_kappa": _Q + ", t AS (SELECT CAST(sum(n) AS BIGINT) AS n, sum(n) FILTER (WHERE gold = predicted) AS hit FROM matrix), c AS (SELECT sum(a * b) AS chance FROM (SELECT gold AS k, sum(n) AS a FROM matrix GROUP BY 1) x JOIN (SELECT predicted AS k, sum(n) AS b FROM matrix GROUP BY 1) y USING (k)) SELECT n, round(hit / CAST(n AS DOUBLE), 6) AS accuracy, round((hit / CAST(n AS DOUBLE) - chance / (CAST(n AS DOUBLE) * n)) / (1 - chance / (CAST(n AS DOUBLE) * n)), 6) AS kappa FROM t, c",
    "pass_rate_by_category": _Q + "SELECT lang, count(*) AS n, count(*) FILTER (WHERE gold = predicted) AS passed, round(count(*) FILTER (WHERE gold = predicted) / CAST(count(*) AS DOUBLE), 6) AS rate FROM judged JOIN documents USING (doc_id) GROUP BY lang",
    "upsert_partial_update": D + " SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN title || '!' ELSE title END AS title, CASE WHEN doc_id % 5 = 0 THEN 'xx' ELSE lang END AS lang, source FROM raw_texts",
    "upsert_by_key": "WITH n AS (SELECT doc_id * 2 AS doc_id, 'new' AS lang, source FROM documents WHERE doc_id % 7 = 0) SELECT d.doc_id, coalesce(n.lang, d.lang) AS lang, d.source FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id UNION ALL SELECT doc_id, lang, source FROM n WHERE doc_id NOT IN (SELECT doc_id FROM documents)",
}

_AUDIT_STOP = "[" + ", ".join(f"'{w}'" for w in V.AUDIT_STOPWORDS) + "]"
_CAUSE = rf"""t AS (SELECT doc_id, text, regexp_extract_all(lower(title), '{_WORD}') AS tw, lower(left(text, 2000)) AS head FROM raw_texts),
p AS (SELECT *, list_distinct(list_transform(range(1, len(tw)), lambda i: tw[i] || ' ' || tw[i + 1])) AS pairs, list_distinct(list_filter(tw, lambda x: NOT list_contains({_AUDIT_STOP}, x))) AS single FROM t),
c AS (SELECT *, CAST(len(list_filter(pairs, lambda b: contains(head, b))) AS DOUBLE) AS found, CAST(len(list_filter(single, lambda b: contains(head, b))) AS DOUBLE) AS alone FROM p),
caused AS (SELECT *, CASE WHEN len(pairs) = 0 THEN 0 WHEN found > 0 THEN found / len(pairs) WHEN len(single) = 0 THEN 0 ELSE alone / len(single) * 0.5 END AS causality FROM c)"""
_TOKENS = lambda c: f"regexp_extract_all(lower({c}), '{_WORD}')"
_WORDS = lambda c: rf"list_filter(regexp_split_to_array(trim({c}), '\s+'), lambda x: x <> '')"
_QUOTE = "'[" + V.QUOTES + "]'"
_SENTENCES_P = _SENTENCES.replace("regexp_replace(piece, '\\s+$', '') AS sentence FROM pieces", "regexp_replace(piece, '\\s+$', '') AS sentence, coalesce(sum(len(regexp_extract_all(piece, '\\n\\n'))) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS paragraph FROM pieces").replace('AS "end", sentence FROM placed', 'AS "end", sentence, paragraph FROM placed')
_WINDOWS = f"""near AS (SELECT *, {_TOKENS("sentence")} AS toks, lag(sentence) OVER w AS l1, lag(sentence, 2) OVER w AS l2, lead(sentence) OVER w AS nx FROM sentences WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
marked AS (SELECT *, list_has_any(toks, ['that', 'with']) AS act, list_has_any(toks, ['was']) AND l1 IS NOT NULL AS back, coalesce({_TOKENS("nx")}[1] = 'the', false) OR coalesce(regexp_matches(left(nx, 5), {_QUOTE}), false) AS opens FROM near),
sided AS (SELECT *, concat_ws(' ', CASE WHEN back AND l2 IS NOT NULL AND regexp_matches(l1, {_QUOTE}) THEN l2 END, CASE WHEN back THEN l1 END) AS before, CASE WHEN nx IS NOT NULL AND (NOT act OR opens) THEN nx ELSE '' END AS after FROM marked),
joined AS (SELECT *, trim(concat_ws(' ', nullif(before, ''), sentence, nullif(after, ''))) AS whole, {_WORDS("sentence")} AS aw, {_WORDS("concat_ws(' ', before, after)")} AS ow FROM sided),
windows AS (SELECT *, CASE WHEN len({_WORDS("whole")}) <= 180 THEN whole WHEN len(aw) >= 180 THEN array_to_string(aw[1:180], ' ')
  WHEN before <> '' THEN trim(concat_ws(' ', array_to_string(ow[1:180 - len(aw)], ' '), sentence)) ELSE trim(concat_ws(' ', sentence, array_to_string(ow[1:180 - len(aw)], ' '))) END AS context FROM joined)"""
_PLACES = 'm AS (SELECT doc_id, entity_id, canonical_name AS word, start AS "offset" FROM span JOIN entities USING (entity_id))'
_BEST = f"{D}, {spans_sql('text', 'raw_texts')}, {_SENTENCES_P}, {_WINDOWS}, {_PLACES}, b AS (SELECT m.doc_id, entity_id, word, pos, act, paragraph, context FROM m JOIN windows s ON m.doc_id = s.doc_id AND \"offset\" >= s.start AND \"offset\" < s.\"end\" QUALIFY row_number() OVER (PARTITION BY m.doc_id, entity_id ORDER BY act DESC, \"offset\") = 1)"
_CTX = f"g AS (SELECT *, {_hits('lower(context)', V.CORPUS_POSITIVE)} AS p, {_hits('lower(context)', V.CORPUS_NEGATIVE)} AS n, len(list_intersect(list_distinct({_TOKENS('word')}), list_distinct({_TOKENS('context')}))) / CAST(len(list_distinct({_TOKENS('word')})) AS DOUBLE) AS rel FROM b WHERE length(context) >= 10), h AS (SELECT *, CAST(n AS DOUBLE) / (p + n + 1) AS neg, 1e0 / (p + n + 1) AS neu, CAST(p AS DOUBLE) / (p + n + 1) AS pos3 FROM g WHERE rel >= 0.5)"
_OWN = "['google.com', 'gstatic.com', 'googleapis.com', 'schema.org', 'youtube.com']"

ORACLES |= {
    "title_bigram_causality": f"{D}, {_CAUSE} SELECT doc_id, round(causality, 6) AS causality FROM caused",
    "fulltext_audit": f"{D}, {_CAUSE} SELECT CASE WHEN text = '' THEN 'empty_text' WHEN length(text) > 20000 THEN 'section_leakage_too_long' WHEN len(regexp_extract_all(text, '(?i)(Baca Juga|Simak Juga|Berita Terkait|Advertisement|Iklan)')) > 5 THEN 'boilerplate_spam' WHEN causality < 0.15 THEN 'title_causality_mismatch' ELSE 'valid' END AS finding, count(*) AS n FROM caused GROUP BY 1",
    "canonical_url": f"""SELECT page_id, coalesce(nullif(regexp_extract(html, '(?i)<link[^>]+rel=["'']canonical["''][^>]+href=["'']([^"'']+)["'']', 1), ''), nullif(regexp_extract(html, '(?i)<link[^>]+href=["'']([^"'']+)["''][^>]+rel=["'']canonical["'']', 1), '')) AS canonical,
      list_filter(regexp_extract_all(html, 'href="(https?://[^"]+)"', 1), lambda u: len(list_filter({_OWN}, lambda d: contains(u, d))) = 0)[1] AS outside_link FROM pages""",
    "context_windows": f"{D}, {_SENTENCES_P}, {_WINDOWS} SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE act) AS actions, CAST(sum(length(context)) AS BIGINT) AS chars FROM windows GROUP BY doc_id",
    "context_word_cap": f"{D}, {_SENTENCES_P}, {_WINDOWS} SELECT doc_id, CAST(max(len({_WORDS('context')})) AS INTEGER) AS most_words FROM windows GROUP BY doc_id",
    "best_context": f"{_BEST} SELECT doc_id, entity_id, pos, CASE WHEN act THEN 90 ELSE 50 END AS quality_score, CASE WHEN act THEN 40 ELSE 10 END AS attr_score, CASE WHEN paragraph = 0 THEN 20 ELSE 10 END AS pos_score, CAST(length(context) AS INTEGER) AS chars FROM b",
    "near_duplicate_pairs": "SELECT * FROM (SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 4) AS cosine FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id) x WHERE cosine >= 0.95",
    "score_entities_gated": f"{_BEST}, {_CTX} SELECT doc_id, entity_id, CASE WHEN neg >= neu AND neg >= pos3 THEN 'negative' WHEN neu >= pos3 THEN 'neutral' ELSE 'positive' END AS label, round(greatest(neg, neu, pos3), 6) AS confidence, round(CAST(rel AS DOUBLE), 6) AS relevancy FROM h",
}

_DRAWN = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(event_id AS VARCHAR) || '42'), event_id) AS rn FROM scores WHERE entity_id IS NOT NULL) x WHERE rn <= 10"
ORACLES |= {
    "gold_template_sentiment": f"{D} SELECT event_id, s.doc_id, canonical_name AS entity_name, title, coalesce('era_' || year(ingested_at), 'unknown') AS era_hint, label AS predicted_label, round(confidence, 3) AS predicted_confidence, '' AS gold_label, '' AS notes FROM ({_DRAWN}) s LEFT JOIN raw_texts r ON s.doc_id = r.doc_id LEFT JOIN entities e ON s.entity_id = e.entity_id",
    "gold_template_relevancy": f"{D}, found AS (SELECT DISTINCT doc_id, entity_id, title, text, 'era_' || year(ingested_at) AS era_hint FROM (SELECT * FROM raw_texts WHERE length(text) >= 500 ORDER BY md5(CAST(doc_id AS VARCHAR) || '42'), doc_id LIMIT 30) r, terms WHERE length(term) >= 4 AND contains(lower(title || ' ' || text), term)), judged AS (SELECT *, round(len(list_intersect(list_distinct({_TOKENS('canonical_name')}), list_distinct({_TOKENS('text')}))) / CAST(len(list_distinct({_TOKENS('canonical_name')})) AS DOUBLE), 3) AS relevancy_confidence FROM found JOIN entities USING (entity_id)) SELECT doc_id, entity_id, title, era_hint, canonical_name AS entity_candidate, relevancy_confidence, CASE WHEN relevancy_confidence >= 0.5 THEN 'pass' ELSE 'block' END AS gate_decision, '' AS gold_relevant, '' AS notes FROM judged",
    "failure_samples": _Q + "SELECT * FROM (SELECT reason AS fail_reason, doc_id, row_number() OVER (PARTITION BY reason ORDER BY doc_id) AS rn, length(text) AS chars FROM scored WHERE reason <> 'validated') x WHERE rn <= 10",
}

QUERIES = {
    f.__name__: f
    for f in (
        quality_score, quality_routing, status_distribution, fail_reason_counts, normalize_urls_emails, normalize_full, clean_article, exact_text_dedup, dedup_counts, content_dedup_duplicate_of,
        title_dedup, title_anti_join, sentence_dedup, near_duplicate_pairs, title_relevancy, title_bigram_causality, fulltext_audit, boilerplate_ratio, lexicon_baseline, html_paragraph_gate,
        interstitial_detect, canonical_url, url_host_homepage, extract_main_text, feed_parse, entity_match_spans, entity_match_counts, top_mentioned_entities, entity_presence, entity_salience_map,
        name_candidates, candidate_confidence, candidate_promotion, sentence_table, context_windows, context_word_cap, anchor_sentence, best_context, readiness_gate, score_documents,
        score_entities_gated, confusion_matrix, classification_report, report_averages, cohen_kappa, pass_rate_by_category, upsert_partial_update, upsert_by_key, curation_quota,
        gold_template_sentiment, gold_template_relevancy, failure_samples,
    )
}
