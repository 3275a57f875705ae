"""Licences found by the Dice coefficient over word bigrams, with DataFrame functions only.

A whole text is normalised (lower case, everything but a-z and 0-9 a space, so line breaks, indents and comment
marks do not count) and read as a row of word bigrams. Each window that begins with a bigram of a template and
has as many bigrams as it (fewer at the text's end) is compared with it as a set: Dice = 2 |A and B| / (|A| + |B|). It can reach LEAST only if
|A| >= LEAST / (2 - LEAST) |B|, and then shares at least as many bigrams with the template; so

* a text without one of the marker words, which some of any so many bigrams of a template must hold, has no hit;
* a template of which the whole text holds fewer bigrams than that is not compared at all.

All happens within a row: no shuffle. Null and empty texts have no hit. Every row gets a result, repeated rows too.
A hit goes where a better one overlaps it, as licences
quote each other. Several best licences of one text: the first name, then its first place. Very long texts cost in proportion to the
bigrams that they share with templates. An empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .licence_texts import TEMPLATES

LEAST = 0.8
#: Words too frequent in any text to mark a licence. A fixed list.
FREQUENT = frozenset("a all an and any are as at be by for from in is it its no not of on or other out see such that the this to use was which will with without you your".split())


def bigrams_of(text: str) -> list[str]:
    w = re.sub("[^a-z0-9]+", " ", text.lower()).split()
    return [f"{a} {b}" for a, b in zip(w, w[1:])]


def least_shared(n: int) -> int:
    """Bigrams that a set must have, and share, to reach LEAST with a set of n."""
    return math.ceil(LEAST / (2 - LEAST) * n - 1e-9)


@lru_cache(8)
def markers(templates: tuple[tuple[str, str], ...]) -> tuple[str, ...]:
    """Words of which any least_shared(n) bigrams of a template of n hold at least one."""
    sets = [set(bigrams_of(t)) for _, t in templates]
    bare = [len(b) - least_shared(len(b)) + 1 for b in sets]  # bigrams that must hold a marker
    chosen: list[str] = []
    while True:
        open_ = [b for b, n in zip(sets, bare) if sum(any(w in chosen for w in g.split()) for g in b) < n]
        if not open_:
            return tuple(chosen)
        gain = Counter(w for b in open_ for g in b if not any(x in chosen for x in g.split()) for w in set(g.split()))
        # Frequent words only where nothing else is left.
        chosen.append(min(gain, key=lambda w: (w in FREQUENT, -gain[w], w)))


def hits(text: Column, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> Column:
    """array of (licence, word, until, dice): for each template that reaches LEAST, the words of its best window, the first of equal ones."""
    lists = [(name, bigrams_of(t)) for name, t in templates]
    known = F.array(*map(F.lit, dict.fromkeys(g for _, b in lists for g in b)))
    rows = [
        F.struct(F.lit(name).alias("licence"), F.lit(len(b)).alias("span"), F.lit(len(set(b))).alias("n"), F.lit(least_shared(len(set(b)))).alias("least"), F.array(*map(F.lit, dict.fromkeys(b))).alias("b"))
        for name, b in lists
    ]
    words = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " ")), " ")
    mark = F.array(*map(F.lit, markers(tuple(templates))))
    none = F.array().cast("array<struct<licence:string,word:bigint,until:bigint,dice:double>>")

    def best(b: Column, t: Column) -> Column:
        """The best window of a row of bigrams for a template."""
        starts = F.filter(F.transform(b, lambda g, i: F.when(F.array_contains(t["b"], g), i)), lambda i: i.isNotNull())

        def window(i: Column) -> Column:
            a = F.array_distinct(F.slice(b, i + 1, t["span"]))
            return F.struct((F.lit(2.0) * F.size(F.array_intersect(a, t["b"])) / (F.size(a) + t["n"])).alias("dice"), (-i).alias("back"))

        return F.array_max(F.transform(starts, window))

    def of(b: Column) -> Column:
        held = F.array_intersect(b, known)
        likely = F.filter(F.array(*rows), lambda t: (F.size(held) >= t["least"]) & (F.size(F.array_intersect(held, t["b"])) >= t["least"]))
        found = F.transform(likely, lambda t: F.struct(t["licence"].alias("licence"), t["span"].alias("span"), best(b, t).alias("best")))
        found = F.filter(found, lambda x: x["best"]["dice"] >= LEAST)
        at = lambda x: (-x["best"]["back"]).cast("bigint")
        return F.transform(found, lambda x: F.struct(x["licence"].alias("licence"), at(x).alias("word"), (at(x) + x["span"]).alias("until"), x["best"]["dice"].alias("dice")))

    def alone(found: Column) -> Column:
        """Hits that no better one overlaps."""
        return F.filter(found, lambda h: ~F.exists(found, lambda o: (o["dice"] > h["dice"]) & (o["word"] < h["until"]) & (h["word"] < o["until"])))

    def with_bigrams(w: Column) -> Column:
        return F.transform(F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.concat(F.get(w, i), F.lit(" "), x))

    # A transform over an array of one binds what is used more than once, so that it is made once.
    bound = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))
    return bound(words, lambda w: F.when(F.arrays_overlap(w, mark), bound(bound(with_bigrams(w), of), alone)).otherwise(none))


def read_templates(spark: SparkSession, folder: str) -> tuple[tuple[str, str], ...]:
    """Templates from a folder of licence texts, a file each, named by the files. They become part of the plan: some hundred texts at most."""
    rows = spark.read.text(folder, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), "value").collect()
    return tuple(sorted((r["name"].removesuffix(".txt"), r["value"]) for r in rows))


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """doc_id, licences (sorted names, comma-joined), n_templates that reach LEAST, best_licence, best_dice and at_word for each row of docs."""
    x = docs.select("doc_id", hits(F.col("text"), templates).alias("hits"))
    order = lambda h: F.struct((-h["dice"]).alias("d"), h["licence"].alias("licence"), h["word"].alias("word"))
    x = x.withColumn("best", F.array_min(F.transform("hits", order)))
    return x.select(
        "doc_id",
        F.array_join(F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["licence"]))), ",").alias("licences"),
        F.size("hits").cast("bigint").alias("n_templates"),
        F.col("best.licence").alias("best_licence"),
        F.round(F.coalesce(-F.col("best.d"), F.lit(0.0)), 6).alias("best_dice"),
        F.col("best.word").alias("at_word"),
    )


def op9_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against all templates. Null or empty text: no hit. Null or repeated ids: a row each. Empty table: no rows."""
    return scan(common.table(spark, sf_dir, "documents"))


#: The same rows by joins of written-out bigrams and windows.
OP9_SQL = (
    "WITH template(id, licence, text) AS (VALUES "
    + ", ".join("({}, '{}', '{}')".format(k, n, t.replace("'", "''")) for k, (n, t) in enumerate(TEMPLATES))
    + r"""), doc AS (SELECT row_number() OVER () AS r, doc_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM documents),
tw AS (SELECT id, licence, string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM template),
tb AS (SELECT DISTINCT id, w[i] || ' ' || w[i + 1] AS g FROM (SELECT id, w, unnest(range(1, len(w))) AS i FROM tw)),
tn AS (SELECT tw.id, any_value(licence) AS licence, any_value(len(w)) - 1 AS span, count(*) AS n FROM tw JOIN tb USING (id) GROUP BY tw.id),
b AS (SELECT r, i, w[i] || ' ' || w[i + 1] AS g FROM (SELECT r, w, unnest(range(1, len(w))) AS i FROM doc)),
m AS (SELECT b.r, tb.id, b.i, b.g FROM b JOIN tb USING (g)),
likely AS (SELECT r, id FROM m JOIN tn USING (id) GROUP BY r, id HAVING 3 * count(DISTINCT g) >= 2 * any_value(n)),
start AS (SELECT m.r, m.id, m.i FROM m JOIN likely USING (r, id)),
shared AS (SELECT s.r, s.id, s.i, count(DISTINCT m.g) AS n FROM start s JOIN tn USING (id) JOIN m ON m.r = s.r AND m.id = s.id AND m.i >= s.i AND m.i < s.i + span GROUP BY s.r, s.id, s.i),
held AS (SELECT s.r, s.id, s.i, count(DISTINCT b.g) AS n FROM start s JOIN tn USING (id) JOIN b ON b.r = s.r AND b.i >= s.i AND b.i < s.i + span GROUP BY s.r, s.id, s.i),
dice AS (SELECT r, id, licence, i - 1 AS word, 2.0::DOUBLE * shared.n / (held.n + tn.n) AS dice FROM shared JOIN held USING (r, id, i) JOIN tn USING (id)),
every AS (SELECT r, id, licence, word, word + span AS until, dice FROM dice JOIN tn USING (id, licence) WHERE dice >= 0.8::DOUBLE QUALIFY row_number() OVER (PARTITION BY r, id ORDER BY dice DESC, word) = 1),
hit AS (SELECT * FROM every h WHERE NOT EXISTS (SELECT 1 FROM every o WHERE o.r = h.r AND o.dice > h.dice AND o.word < h.until AND h.word < o.until)),
best AS (SELECT r, licence AS best_licence, dice, word FROM hit QUALIFY row_number() OVER (PARTITION BY r ORDER BY dice DESC, licence, word) = 1),
named AS (SELECT r, string_agg(DISTINCT licence, ',' ORDER BY licence) AS licences, count(*) AS n FROM hit GROUP BY r)
SELECT doc_id, coalesce(licences, '') AS licences, coalesce(n, 0) AS n_templates, best_licence, round(coalesce(dice, 0.0), 6) AS best_dice, word AS at_word
FROM doc LEFT JOIN named USING (r) LEFT JOIN best USING (r)
"""
)
