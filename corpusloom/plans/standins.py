"""Tables of documents, scores and entities made from the test tables, as one SQL text for each engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
AS_OF = "2024-01-31"

#: id, canonical name, aliases. One alias belongs to two entities, some names hold others.
ENTITIES = (
    (0, "thatin", ("ononst",)),
    (1, "inoran", ("hehely", "orantion")),
    (2, "und", ("die",)),
    (3, "der", ()),
    (4, "that", ("with",)),
    (5, "the thatin", ()),
    (6, "orre", ("rewh",)),
    (7, "pour les", ("pour",)),
    (8, "que", ("rewh",)),
    (9, "von der", ("von",)),
    (10, "sich", ("auf",)),
    (11, "elle", ("une",)),
    (12, "del", ("los", "las")),
    (13, "from", ()),
    (14, "this", ("are",)),
    (15, "dans", ("par",)),
    (16, "keit", ("heit",)),
    (17, "est", ()),
    (18, "for the", ("for",)),
    (19, "was", ("and the",)),
)

_RAW = """raw_texts AS (
  SELECT d.doc_id, coalesce(left(CASE WHEN d.doc_id % 10 = 3 THEN p.text ELSE d.text END, 60), left(d.text, 60)) AS title,
    d.text, d.lang, d.source, {at} AS ingested_at
  FROM documents d LEFT JOIN documents p ON d.doc_id % 10 = 3 AND p.doc_id = d.doc_id - 1)"""
_SCORES = """scores AS (
  SELECT event_id, entity_id, doc_id, score_negative, score_neutral, score_positive, scored_at,
    CASE WHEN score_negative >= score_neutral AND score_negative >= score_positive THEN 'negative'
      WHEN score_neutral >= score_positive THEN 'neutral' ELSE 'positive' END AS label,
    greatest(score_negative, score_neutral, score_positive) AS confidence
  FROM (SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE user_id % 20 END AS entity_id,
      event_id % (SELECT count(*) FROM documents) AS doc_id, ts AS scored_at, pos AS score_positive, (1 - pos) * s AS score_negative, (1 - pos) * (1 - s) AS score_neutral
    FROM (SELECT *, value / (value + 10) AS pos, CAST((event_id * 37) % 100 AS DOUBLE) / 100 AS s FROM events) x) y)"""
_NAMES = "entities AS (SELECT * FROM (VALUES " + ", ".join(f"(CAST({i} AS BIGINT), '{n}')" for i, n, _ in ENTITIES) + ") AS e(entity_id, canonical_name))"
_TERMS = "terms AS (SELECT * FROM (VALUES " + ", ".join(f"(CAST({i} AS BIGINT), '{t}', {str(t == n).lower()})" for i, n, a in ENTITIES for t in (n, *a)) + ") AS t(entity_id, term, canonical))"

SPARK = "WITH " + ", ".join((_RAW.format(at="CAST('2024-01-01' AS TIMESTAMP_NTZ) + make_dt_interval(0, 0, CAST(d.doc_id AS INT))"), _SCORES, _NAMES, _TERMS))
DUCK = "WITH " + ", ".join((_RAW.format(at="TIMESTAMP '2024-01-01' + to_minutes(CAST(d.doc_id AS BIGINT))"), _SCORES, _NAMES, _TERMS))


def views(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = TABLES) -> None:
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A statement over the test tables and their stand-ins."""
    statement = text if text.lstrip().upper().startswith("WITH") else f"{SPARK}\n{text}"
    views(spark, sf_dir, tuple(t for t in TABLES if t in statement))
    return spark.sql(statement)


def raw_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, "SELECT * FROM raw_texts")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, "SELECT * FROM scores")


def entities(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, n, list(a)) for i, n, a in ENTITIES], "entity_id bigint, canonical_name string, aliases array<string>")
