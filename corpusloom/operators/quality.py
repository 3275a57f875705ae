"""Quality score and routing, normalisation, cleaning, and audits of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V


def _points(amount: Column, steps: tuple[tuple[int, int], ...]) -> Column:
    out = F.lit(0)
    for least, points in reversed(steps):
        out = F.when(amount >= least, points).otherwise(out)
    return out


def quality_score(docs: DataFrame, stopwords: tuple[str, ...] = V.STOPWORDS, is_language: Column | None = None) -> DataFrame:
    """docs(title, text, ...) with `score` 0-100 and `reason`. One projection; nothing is shuffled.

    is_language: whether the language test passes; it stands in for a detector. Stop-words match white-space tokens
    exactly. Rejections come first, in order: empty, blocked page, section page, title mismatch.
    """
    text, title = F.coalesce("text", F.lit("")), F.coalesce("title", F.lit(""))
    stop = F.array(*map(F.lit, stopwords))
    x = docs.withColumn("_w", T.words(text)).withColumn("_t", F.array_except(T.token_set(title), stop)).withColumn("_x", T.token_set(text))
    n_words, has_stop = F.size("_w"), F.arrays_overlap("_w", stop)
    ratio = T.overlap_ratio(F.col("_t"), F.col("_x"))
    titled, worded = F.size("_t") > 0, n_words > 0
    earned = _points(F.length(text), V.LENGTH_POINTS) + _points(n_words, V.WORD_POINTS)
    earned += F.when(worded, F.when(has_stop, 15).otherwise(0) + F.when(is_language if is_language is not None else F.lit(False), 10).otherwise(0)).otherwise(0)
    earned += F.when(titled, (ratio * 25).cast("int")).otherwise(0)
    most = F.lit(50) + F.when(worded, 25).otherwise(0) + F.when(titled, 25).otherwise(0)
    earned = F.greatest(earned - T.hits(F.lower(text), V.SOFT_PHRASES) * V.SOFT_PENALTY, F.lit(0))
    score = F.least(((earned / most) * 100).cast("int"), F.lit(100))
    blocked = T.hits(F.lower(F.substring(text, 1, V.BLOCK_WINDOW)), V.BLOCK_PHRASES) > 0
    rejected = (
        F.when((text == "") | (title == ""), "empty_input")
        .when(blocked, "noise_page")
        .when(F.length(text) > V.MAX_LENGTH, "rejected_section_page")
        .when(titled & (ratio < 0.2), "rejected_title_mismatch")
    )
    x = x.withColumn("_no", rejected).withColumn("score", F.when(F.col("_no").isNotNull(), 0).otherwise(score)).withColumn("_n", n_words).withColumn("_s", has_stop)
    low = F.when(F.col("_n") < 70, "low_quality_too_short").when(~F.col("_s"), "low_quality_no_stopword").otherwise("low_quality")
    x = x.withColumn("reason", F.coalesce("_no", F.when(F.col("score") >= V.QUALITY_THRESHOLD, "validated").otherwise(low)))
    return x.drop("_w", "_t", "_x", "_no", "_n", "_s")


def route(scored: DataFrame) -> DataFrame:
    """Status, failure reason and default content type of scored documents."""
    ok = F.col("reason") == "validated"
    return scored.withColumn("status", F.when(ok, "validated").otherwise("failed")).withColumn("fail_reason", F.when(~ok, F.col("reason"))).withColumn("content_type", F.when(ok, "FULLTEXT"))


def strip_addresses(text: Column) -> tuple[Column, Column]:
    """Text without URLs and e-mail addresses, and how many there were."""
    linked, mailed = F.contains(text, F.lit("://")) | F.contains(text, F.lit("www.")), F.contains(text, F.lit("@"))
    n = F.when(linked, F.regexp_count(text, F.lit(V.URL))).otherwise(0) + F.when(mailed, F.regexp_count(text, F.lit(V.EMAIL))).otherwise(0)
    bare = T.bound(F.when(linked, F.regexp_replace(text, V.URL, " ")).otherwise(text), lambda t: F.when(F.contains(t, F.lit("@")), F.regexp_replace(t, V.EMAIL, " ")).otherwise(t))
    return bare, n


def unglue_title(text: Column, title: Column) -> Column:
    """Text without its title at the start: up to eight title words with any marks between, ignoring case."""

    def cut(t: Column, w: Column) -> Column:
        # Words are letters and digits only, so they need no escapes. Most texts do not begin with the first word and are not searched.
        rest = F.regexp_replace(t, F.concat(F.lit(r"(?i)^\s*"), F.array_join(w, r"[^\p{L}\p{N}_]*")), F.lit(""))
        begins = F.startswith(F.lower(F.regexp_replace(F.substring(t, 1, 200), r"^\s+", "")), F.lower(F.substring(F.get(w, F.lit(0)), 1, 50))) | F.rlike(t, F.lit(r"^\s{100}"))
        return F.when((F.size(w) > 0) & begins, T.bound(rest, lambda r: F.when(F.length(r) < F.length(t), F.regexp_replace(r, r"^[ :\-\n\"']+", "")).otherwise(t))).otherwise(t)

    return T.bound(text, lambda t: T.bound(F.slice(F.regexp_extract_all(title, F.lit(T.WORD), F.lit(0)), 1, 8), lambda w: cut(t, w)))


def strip_portal(text: Column, title: Column | None = None) -> Column:
    if title is not None:
        text = unglue_title(text, title)
    text = T.replaced(text, r"<[^>]+>", " ", "<")
    for p, signs in zip(V.PORTAL_PATTERNS, V.PORTAL_SIGNS):
        text = T.replaced(text, p, "", *signs)
    return T.replaced(text, V.PHOTO_CREDIT, "", "(")


def plain_marks(text: Column) -> Column:
    return F.regexp_replace(F.translate(text, "“”‘’–—―‒", "\"\"''----"), r"\s+([,.!?;:])", "$1")


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(T.replaced(text, r"\n{3,}", "\n\n", "\n\n\n"), r"[ \t]+", " "))


def normalise(docs: DataFrame, unicode: bool = True) -> DataFrame:
    """docs with clean_text, clean_len, original_len, addresses_removed and content_hash. Only the Unicode step leaves the JVM."""
    source = F.coalesce("text", F.lit(""))
    x = docs.withColumn("_u", T.unicode_normal(source) if unicode else source)
    bare, n = strip_addresses(F.col("_u"))
    clean = collapse(plain_marks(strip_portal(bare, F.coalesce("title", F.lit("")))))
    x = x.withColumn("original_len", F.length(source).cast("bigint")).withColumn("addresses_removed", n.cast("bigint")).withColumn("clean_text", clean).drop("_u")
    return x.withColumn("clean_len", F.length("clean_text").cast("bigint")).withColumn("content_hash", T.content_hash(F.col("clean_text")))


def unique_sentences(text: Column, longer_than: int = 15) -> Column:
    """Sentences in order, the first of equal ones, without short ones."""
    return F.array_distinct(F.filter(F.transform(T.sentences(text), lambda s: T.trimmed(s)), lambda s: F.length(s) > longer_than))


def clean_article(text: Column, title: Column) -> Column:
    """The enrichment cleaner: addresses, interface phrases, credits, glued title, repeated sentences, doubled dots."""
    text = T.replaced(text, T.plain(V.URL), "", "://", "www.")
    for p, signs in zip((*V.INTERFACE_PATTERNS, V.PHOTO_CREDIT), (*V.INTERFACE_SIGNS, ("(",))):
        text = T.replaced(text, T.plain(p), "", *signs)

    def unglued(t: Column, flat: Column) -> Column:
        glued = (F.length(flat) > 0) & F.startswith(T.lowered(F.substring(t, 1, 60)), F.substring(flat, 1, 30))
        rest = T.trimmed(F.regexp_replace(T.trimmed(F.substring(t, F.length(flat) + 1, F.length(t))), T.plain(r"^[\s\-:|]+[a-zA-Z\s,\d]{0,20}"), ""))
        return F.when(glued, rest).otherwise(t)

    flat = T.trimmed(T.lowered(F.regexp_replace(title, T.plain(r"[^\p{L}\p{N}_\s]"), "")))
    text = F.array_join(unique_sentences(T.bound(text, lambda t: T.bound(flat, lambda f: unglued(t, f)))), " ")
    return T.trimmed(F.regexp_replace(F.regexp_replace(text, r"[ \t]{2,}", " "), r"\.{2,}", "."))


def title_relevancy(title: Column, text: Column) -> Column:
    return F.when((F.coalesce(title, F.lit("")) == "") | (F.coalesce(text, F.lit("")) == ""), 0.0).otherwise(T.overlap_ratio(T.token_set(title), T.token_set(text)))


def title_causality(title: Column, text: Column) -> Column:
    """Share of title bigrams inside the first 2000 characters; without any, half the share of its words."""
    w, head = T.tokens(title), F.lower(F.substring(text, 1, 2000))
    pairs = F.array_distinct(T.bigrams(w))
    found = F.size(F.filter(pairs, lambda b: F.contains(head, b)))
    single = F.array_except(w, F.array(*map(F.lit, V.AUDIT_STOPWORDS)))
    alone = F.when(F.size(single) == 0, 0.0).otherwise(F.size(F.filter(single, lambda b: F.contains(head, b))) / F.size(single) * 0.5)
    return F.when(F.size(pairs) == 0, 0.0).when(found == 0, alone).otherwise(found / F.size(pairs))


def boilerplate_ratio(text: Column) -> Column:
    return F.when(F.length(text) > 0, F.regexp_count(text, F.lit(V.CURATION_BOILERPLATE)) * 50 / F.length(text)).otherwise(0.0)


def audit(docs: DataFrame) -> DataFrame:
    """docs with `finding` of the full-text audit: the first rule that fails, or valid."""
    text = F.coalesce("text", F.lit(""))
    return docs.withColumn(
        "finding",
        F.when(text == "", "empty_text")
        .when(F.length(text) > V.MAX_LENGTH, "section_leakage_too_long")
        .when(F.regexp_count(text, F.lit(V.AUDIT_BOILERPLATE)) > V.AUDIT_HITS, "boilerplate_spam")
        .when(title_causality(F.coalesce("title", F.lit("")), text) < 0.15, "title_causality_mismatch")
        .otherwise("valid"),
    )


def named_in(text: Column, terms: list[str], most: int = 3) -> Column:
    """The first terms, in the order given, that a text holds anywhere, ignoring case."""
    return T.bound(F.lower(F.coalesce(text, F.lit(""))), lambda low: F.slice(F.filter(F.array(*map(F.lit, terms)), lambda w: F.contains(low, w)), 1, most))


def audit_sheet(docs: DataFrame, terms: list[str]) -> DataFrame:
    """docs with the audit's finding, whether a dictionary term occurs, and the first three of them."""
    x = audit(docs).withColumn("_m", named_in(F.col("text"), sorted(t.lower() for t in terms)))
    return x.withColumn("has_entity", F.size("_m") > 0).withColumn("matched_entities", F.array_join("_m", "; ")).withColumn("is_valid", F.col("finding") == "valid").drop("_m")


def lexicon_label(text: Column, positive: tuple[str, ...] = V.POSITIVE, negative: tuple[str, ...] = V.NEGATIVE) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    p, n = T.hits(low, positive), T.hits(low, negative)
    return F.when(p > n, "positive").when(n > p, "negative").otherwise("neutral")


def text_source(docs: DataFrame, fetched: Column, least: int = V.MIN_LENGTH) -> DataFrame:
    """docs with the text to judge: its own if long enough, else the fetched one, with the title before it."""
    own = F.coalesce("text", F.lit(""))
    return docs.withColumn("judged_text", F.trim(F.concat_ws(". ", F.nullif(F.col("title"), F.lit("")), F.when(F.length(own) >= least, own).otherwise(F.coalesce(fetched, own)))))
