"""Dictionary entities: matching, veto, salience; discovery and promotion of new names."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V

#: Terms that are sent to the workers in one broadcast. A larger dictionary goes out in blocks, whose hits are united.
MOST_TERMS = 500_000
SPANS = "array<struct<entity_id:bigint,start:int,end:int,mention:string,canonical:boolean>>"
IN_WORD = re.compile(r"\w").match


def composed(title: Column, body: Column) -> Column:
    """The one text that all offsets refer to."""
    return F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(body, F.lit("")))


def dictionary(entities: DataFrame, least: int = 2) -> DataFrame:
    """term, entity_id, canonical of entities(entity_id, canonical_name, aliases). Of equal terms the last entity's stays."""
    x = entities.select("entity_id", F.lower("canonical_name").alias("term"), F.lit(True).alias("canonical")).unionByName(
        entities.select("entity_id", F.explode("aliases").alias("term")).select("entity_id", F.lower("term").alias("term"), F.lit(False).alias("canonical")).where(F.length("term") >= least)
    )
    last = F.max(F.struct("entity_id", "canonical")).alias("m")
    return x.groupBy("term").agg(last).select("term", "m.entity_id", "m.canonical")


class Matcher:
    """Leftmost-longest whole-word matches of all terms in one pass, ignoring case; matches do not overlap."""

    def __init__(self, terms: list[tuple[str, int, bool]]):
        self.automaton = ahocorasick.Automaton()
        for term, entity, canonical in terms:
            self.automaton.add_word(term, (len(term), entity, canonical))
        if terms:
            self.automaton.make_automaton()
        self.empty = not terms

    def every(self, text: str | None) -> list[tuple[int, int, int, str, bool]]:
        """All whole-word matches, also those that overlap."""
        if not text or self.empty:
            return []
        low = text.lower()
        if len(low) != len(text):
            low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
        found = []
        for end, (n, entity, canonical) in self.automaton.iter(low):
            start, stop = end - n + 1, end + 1
            if not (start and IN_WORD(low[start - 1])) and not (stop < len(low) and IN_WORD(low[stop])):
                found.append((entity, start, stop, text[start:stop], canonical))
        return found

    def spans(self, text: str | None) -> list[tuple[int, int, int, str, bool]]:
        return apart(self.every(text))


NAMES = ("entity_id", "start", "end", "mention", "canonical")
KIND = pa.list_(pa.struct([("entity_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("mention", pa.string()), ("canonical", pa.bool_())]))


def apart(found: list[tuple[int, int, int, str, bool]]) -> list[tuple[int, int, int, str, bool]]:
    """Of matches, from left to right, the longest that begin behind the last one taken."""
    out, free = [], 0
    for s in sorted(found, key=lambda s: (s[1], s[1] - s[2], s[0], s[4])):
        if s[1] >= free:
            free = s[2]
            out.append(s)
    return out


def match(docs: DataFrame, terms: DataFrame, text: Column) -> DataFrame:
    """docs with `spans`: all matches in a text. Terms go out in blocks of MOST_TERMS; what several blocks find is united before overlaps are settled."""
    context, blocks, rows = docs.sparkSession.sparkContext, [], []
    for r in terms.orderBy("term").toLocalIterator():
        rows.append((r["term"], r["entity_id"], r["canonical"]))
        if len(rows) == MOST_TERMS:
            blocks.append(context.broadcast(rows))
            rows = []
    if rows or not blocks:
        blocks.append(context.broadcast(rows))

    def found(sent, whole: bool):
        @F.arrow_udf(SPANS)
        def spans(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            matcher = Matcher(sent.value)
            of = matcher.spans if whole else matcher.every
            for batch in batches:
                yield pa.array([[dict(zip(NAMES, s)) for s in of(t)] for t in batch.to_pylist()], KIND)

        return spans(text)

    if len(blocks) == 1:
        return docs.withColumn("spans", found(blocks[0], True))

    @F.arrow_udf(SPANS)
    def settled(every: pa.Array) -> pa.Array:
        return pa.array([[dict(zip(NAMES, s)) for s in apart([tuple(x[n] for n in NAMES) for x in row])] for row in every.to_pylist()], KIND)

    return docs.withColumn("spans", settled(F.concat(*[found(b, False) for b in blocks])))


def term_pattern(terms: list[str]) -> str:
    """A Java pattern for whole-word matches, longest term first: for counts, which need no offsets and stay in the JVM."""
    body = "|".join(T.quoted(t) for t in sorted(terms, key=lambda t: (-len(t), t)))
    return rf"(?i)(?<![\p{{L}}\p{{N}}_])({body})(?![\p{{L}}\p{{N}}_])"


def mentions_native(docs: DataFrame, terms: list[str], text: Column) -> DataFrame:
    """doc_id, term for each match."""
    return docs.select("doc_id", F.explode(F.transform(F.regexp_extract_all(text, F.lit(term_pattern(terms)), F.lit(1)), F.lower)).alias("term"))


def full_names(text: Column, gap: str = r"\s+") -> Column:
    """Runs of two to four capitalised words: the fallback for a tagger of persons. gap: what may stand between them."""
    return F.regexp_extract_all(text, F.lit(rf"(?<![\p{{L}}\p{{N}}_])([A-Z][a-z]+(?:{gap}[A-Z][a-z]+){{1,3}})(?![\p{{L}}\p{{N}}_])"), F.lit(1))


def veto(matched: Column, canonical: Column, persons: Column) -> Column:
    """True for a false positive: the first longer person name that holds the match shares no other part of the canonical name."""
    low = F.lower(matched)
    holder = F.get(F.filter(persons, lambda p: F.contains(F.lower(p), low) & (F.length(p) > F.length(matched))), F.lit(0))
    parts = F.filter(F.split(F.trim(F.lower(canonical)), r"\s+"), lambda w: w != low)
    return F.when(holder.isNull(), False).otherwise(~F.exists(parts, lambda w: F.contains(F.lower(holder), w)))


def hits(matched: DataFrame) -> DataFrame:
    """One row for each match of a non-empty span list."""
    return matched.select("doc_id", "title", F.posexplode("spans").alias("k", "s")).select("doc_id", F.length(F.coalesce("title", F.lit(""))).alias("title_len"), "s.*")


def true_hits(matched: DataFrame, entities: DataFrame, text: Column) -> DataFrame:
    """Rows of hits() without those that are part of somebody else's name. The names of persons come from the fallback tagger, within a line."""
    x = matched.select("doc_id", "title", full_names(text, r"[ \t]+").alias("_persons"), F.explode("spans").alias("s"))
    x = x.join(entities.select(F.col("entity_id").alias("_e"), F.col("canonical_name").alias("_name")), F.col("s.entity_id") == F.col("_e"))
    x = x.where(~veto(F.col("s.mention"), F.col("_name"), F.col("_persons")))
    return x.select("doc_id", F.length(F.coalesce("title", F.lit(""))).alias("title_len"), "s.*")


def salience(matched: DataFrame) -> DataFrame:
    """The salient entities of matched texts, all hits counted."""
    return salient(hits(matched))


def salient(found: DataFrame) -> DataFrame:
    """doc_id, entity_id, n, in_title, first_offset, rank, is_main, confidence of the entities that count in a text, from rows of hits.

    An entity counts if its canonical name is in the title or it occurs twice; if none does, the first in rank counts.
    """
    x = found.groupBy("doc_id", "entity_id").agg(
        F.count("*").alias("n"), F.max(F.col("canonical") & (F.col("end") <= F.col("title_len"))).alias("in_title"), F.min("start").alias("first_offset")
    )
    by = W.partitionBy("doc_id").orderBy(F.desc("in_title"), F.desc("n"), "first_offset")
    x = x.withColumn("rank", F.row_number().over(by).cast("bigint")).withColumn("_ok", F.col("in_title") | (F.col("n") > 1))
    x = x.withColumn("_any", F.max("_ok").over(W.partitionBy("doc_id")))
    x = x.where(F.col("_ok") | (~F.col("_any") & (F.col("rank") == 1))).drop("_ok", "_any")
    x = x.withColumn("rank", F.row_number().over(by).cast("bigint"))
    return x.withColumn("is_main", F.col("rank") == 1).withColumn("resolver_source", F.lit("dictionary"))


def resolve(docs: DataFrame, entities: DataFrame, text: Column) -> tuple[DataFrame, DataFrame]:
    """Mentions and the entities of documents(doc_id, title, ..., configured_entity_id).

    A document that was fetched for an entity belongs to that one alone, with all its mentions or one at -1; the others
    go through the dictionary, the veto and the salience gate.
    """
    matched = match(docs, dictionary(entities), text)
    free, fixed = matched.where("configured_entity_id IS NULL"), matched.where("configured_entity_id IS NOT NULL")
    found = true_hits(free, entities, text)
    own = hits(fixed).join(fixed.select("doc_id", F.col("configured_entity_id").alias("entity_id")), ["doc_id", "entity_id"], "left_semi")
    placed = own.groupBy("doc_id", "entity_id").agg(F.min("start").alias("first_offset"), F.count("*").alias("n"))
    given = pre_attributed(fixed, placed)
    columns = ["doc_id", "entity_id", "start", "end", "mention"]
    unplaced = given.where("first_offset < 0").join(entities.select("entity_id", F.col("canonical_name").alias("mention")), "entity_id", "left")
    mentions = found.select(*columns).unionByName(own.select(*columns)).unionByName(unplaced.select("doc_id", "entity_id", F.lit(-1).alias("start"), F.lit(-1).alias("end"), F.coalesce("mention", F.lit("Unknown")).alias("mention")))
    mapped = salient(found).select("doc_id", "entity_id", "first_offset", F.lit(1.0).alias("confidence"), "is_main", "resolver_source")
    return mentions, mapped.unionByName(given)


def pre_attributed(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Rows for documents with a configured entity: confidence 1, offset -1 where the text does not name it."""
    x = docs.where(F.col("configured_entity_id").isNotNull()).select("doc_id", F.col("configured_entity_id").alias("entity_id"))
    return x.join(found.select("doc_id", "entity_id", "first_offset"), ["doc_id", "entity_id"], "left").select(
        "doc_id", "entity_id", F.coalesce("first_offset", F.lit(-1)).alias("first_offset"), F.lit(1.0).alias("confidence"), F.lit(True).alias("is_main"), F.lit("pre_attributed").alias("resolver_source")
    )


def candidates(titles: DataFrame, known: DataFrame, keywords: tuple[str, ...] = V.TITLE_KEYWORDS, least: int = 3, not_person: tuple[str, ...] = V.NOT_A_PERSON) -> DataFrame:
    """name, mention_count, confidence of new names in titles with a keyword. known(canonical_name)."""
    low = F.lower("title")
    x = titles.where(F.exists(F.array(*map(F.lit, keywords)), lambda k: F.contains(low, k))).select(F.explode(full_names(F.col("title"))).alias("name"))
    x = x.where(~F.arrays_overlap(F.split(F.lower("name"), r"\s+"), F.array(*map(F.lit, not_person)))).groupBy("name").agg(F.count("*").alias("mention_count"))
    x = x.where(F.col("mention_count") >= least)
    have = known.select(F.lower("canonical_name").alias("_have")).distinct()
    x = x.join(have, F.lower("name") == F.col("_have"), "left_anti")
    return x.withColumn("confidence", base_confidence(F.col("mention_count")))


def base_confidence(n: Column) -> Column:
    return F.least(F.lit(0.5) + n * 0.1, F.lit(0.8))


def confirmed(confidence: Column, found: Column) -> Column:
    """Confidence after a search that found so many articles."""
    return F.when(found >= 10, F.least(confidence + 0.15, F.lit(0.95))).when(found >= 5, F.least(confidence + 0.10, F.lit(0.90))).when(found >= 3, F.least(confidence + 0.05, F.lit(0.85))).otherwise(confidence)


def ids_by_name(rows: DataFrame, entities: DataFrame, name: str = "name") -> DataFrame:
    """rows with the entity_id of a canonical name or an alias, ignoring case; null where there is none."""
    terms = dictionary(entities, 1).select(F.col("term").alias("_t"), "entity_id")
    return rows.join(terms, F.lower(F.trim(name)) == F.col("_t"), "left").drop("_t")


def promote(candidates_: DataFrame, entities: DataFrame, configs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Candidates, dictionary and feed configurations after a promotion: each accepted name is marked, entered and gets a feed. Names that are there already are not entered twice.

    candidates_(name, confidence, hits, status), entities(entity_id, canonical_name, aliases), configs(config_name, entity_name).
    """
    from . import merge

    ready = promoted(candidates_)
    marked = merge.upsert(candidates_, ready.select(*candidates_.columns), ["name"], ["status"])
    last = entities.agg(F.coalesce(F.max("entity_id"), F.lit(-1)).alias("_last"))
    fresh = merge.insert_if_absent(entities.select(F.lower("canonical_name").alias("_k")), ready.select(F.lower("name").alias("_k"), "name").dropDuplicates(["_k"]), ["_k"])
    # Few names are promoted at a time; their numbers follow the last one in the order of the names.
    numbered = fresh.crossJoin(F.broadcast(last)).select((F.col("_last") + F.row_number().over(W.orderBy("name"))).alias("entity_id"), F.col("name").alias("canonical_name"), F.array().cast("array<string>").alias("aliases"))
    feeds = merge.insert_if_absent(configs, ready.select("config_name", F.col("name").alias("entity_name")).dropDuplicates(["config_name"]), ["config_name"])
    return marked, entities.select("entity_id", "canonical_name", "aliases").unionByName(numbered), configs.unionByName(feeds.select(*configs.columns))


def promoted(rows: DataFrame) -> DataFrame:
    """Pending candidates that enter the dictionary, with the key of their feed."""
    x = rows.where((F.col("status") == "pending") & (F.col("confidence") >= 0.85) & (F.col("hits") >= 3))
    return x.withColumn("status", F.lit("approved")).withColumn("config_name", T.slug(F.col("name")))
