"""Chat formatting that is read back by a deterministic parser, with DataFrame functions only.

Grammar: a header line ``#!turns R`` with the rung R, then for each turn ``<s>[INST] role [/INST]text</s>``.
Rung 0 writes roles and texts as they are. Rung 1 puts a backslash behind the opening bracket of every control
string (one more where backslashes stand there already), rung 2 behind every opening bracket at all, and the
parser, which cuts at ``</s>`` and at the first `` [/INST]``, takes one away again. The text of a rung is reparsed
and compared with the source; the next rung is tried until both are identical, and a job whose last rung
fails ends with an error rather than with other turns.

Turns go by turn number (null first), then role and text. Null roles and texts are empty. A row with a null
conv_id is a conversation of its own: what belongs to nothing is not one hot group. A conversation becomes one
string, as its digests need, so its size is bounded by what a task can hold; repeated rows are turns of their own.
An empty table has no conversations; only the four columns are read, so others cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LOSS = "assistant"
HEADER = "#!turns {}\n"
OPEN, MIDDLE, CLOSE = "<s>[INST] ", " [/INST]", "</s>"
ANGLE, SQUARE = r"<(\\*/?s>)", r"\[(\\*/?INST\])"
ANGLE_BACK, SQUARE_BACK = r"<\\(\\*/?s>)", r"\[\\(\\*/?INST\])"
#: Rungs of escaping, the last that is tried first to last.
RUNGS = (0, 1, 2)
#: A conversation that imitates control strings.
IMITATION = "SELECT * FROM VALUES (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS v(conv_id, turn, role, text)"


def escaped(text: Column, rung: int) -> Column:
    if rung == 0:
        return text
    if rung == 1:
        return F.regexp_replace(F.regexp_replace(text, ANGLE, r"<\\$1"), SQUARE, r"[\\$1")
    return F.regexp_replace(text, r"([<\[])", r"$1\\")


def unescaped(text: Column, rung: Column) -> Column:
    one = F.regexp_replace(F.regexp_replace(text, ANGLE_BACK, "<$1"), SQUARE_BACK, "[$1")
    return F.when(rung == "0", text).when(rung == "1", one).otherwise(F.regexp_replace(text, r"([<\[])\\", "$1"))


def rendered(turns: Column, rung: int) -> Column:
    """The text of an array of (role, text)."""
    body = F.transform(turns, lambda t: F.concat(F.lit(OPEN), escaped(t["role"], rung), F.lit(MIDDLE), escaped(t["text"], rung), F.lit(CLOSE)))
    return F.concat(F.lit(HEADER.format(rung)), F.array_join(body, ""))


def _pieces(text: Column) -> Column:
    """What stands before each end of a turn in a formatted text."""
    pieces = F.split(F.substring(text, len(HEADER.format(0)) + 1, 2147483647), CLOSE)
    return F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))


def _head(piece: Column) -> Column:
    """Characters of a piece up to the end of its control strings."""
    return F.position(F.lit(MIDDLE), piece) + len(MIDDLE) - 1


def _role(piece: Column) -> Column:
    return F.substring(piece, F.lit(len(OPEN) + 1), _head(piece) - len(MIDDLE) - len(OPEN))


def _rung(text: Column) -> Column:
    return F.substring(text, HEADER.index("{") + 1, 1)


def parsed(text: Column) -> Column:
    """The turns of a formatted text as an array of (role, text), unescaped as its header says."""
    rung = _rung(text)
    return F.transform(
        _pieces(text), lambda p: F.struct(unescaped(_role(p), rung).alias("role"), unescaped(F.substring(p, _head(p) + 1, F.length(p)), rung).alias("text"))
    )


def mask(text: Column) -> Column:
    """The loss mask of a formatted text, run by run: how many characters, whether they count, and the characters that do."""
    run = lambda said, loss: F.struct(F.length(said).alias("n"), loss.alias("loss"), F.when(loss, said).alias("said"))
    no = F.lit(False)
    header = run(F.substring(text, 1, len(HEADER.format(0))), no)
    runs = lambda p: F.array(run(F.substring(p, F.lit(1), _head(p)), no), run(F.substring(p, _head(p) + 1, F.length(p)), _role(p) == LOSS), run(F.lit(CLOSE), no))
    return F.concat(F.array(header), F.flatten(F.transform(_pieces(text), runs)))


def under_mask(text: Column) -> Column:
    """All text under the loss mask of a formatted text, unescaped, end to end."""
    rung = _rung(text)
    return F.array_join(F.transform(F.filter(mask(text), lambda r: r["loss"]), lambda r: unescaped(r["said"], rung)), "")


def formatted(rows: DataFrame) -> DataFrame:
    """conv_id, turns (the source), formatted, rung and recovered (the turns read back) for each conversation of rows(conv_id, turn, role, text)."""
    one = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("conv_id", one.alias("one"), F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()).alias("alone"))
    x = rows.groupBy("conv_id", "alone").agg(F.array_sort(F.collect_list("one")).alias("t"))
    x = x.select("conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    # Each rung is written and compared only where those before it failed.
    true = lambda k: parsed(rendered(F.col("turns"), k)) == F.col("turns")
    found = F.raise_error(F.lit("no rung gives back the turns"))
    for k in reversed(RUNGS):
        found = F.when(true(k), F.struct(F.lit(k).alias("rung"), rendered(F.col("turns"), k).alias("formatted"))).otherwise(found)
    x = x.select("conv_id", "turns", found.alias("f")).select("conv_id", "turns", "f.rung", "f.formatted")
    return x.withColumn("recovered", parsed(F.col("formatted")))


def digests(x: DataFrame) -> DataFrame:
    """What the parser and the loss mask read from the formatted texts."""
    said = F.array_join(F.transform("recovered", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    x = x.withColumn("loss", under_mask(F.col("formatted")))
    return x.select(
        "conv_id",
        F.size("recovered").cast("bigint").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
        (F.col("recovered") == F.col("turns")).alias("identical"),
    )


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one that imitates control strings. Nulls are empty texts; rows without conv_id stand alone; an empty table leaves conversation -7."""
    rows = common.table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text")
    return digests(formatted(rows.union(spark.sql(IMITATION))))


OP4_SQL = r"""
WITH rows AS (
  SELECT row_number() OVER () AS r, conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')) AS v(conv_id, turn, role, text)
), sized AS (
  SELECT *, contains(role || text, '</s>') OR contains(role, ' [/INST]') AS hard,
    length(role) + length(text) + 22 AS n0,
    length(regexp_replace(regexp_replace(role, '<(\\*/?s>)', '<\\\1', 'g'), '\[(\\*/?INST\])', '[\\\1', 'g'))
    + length(regexp_replace(regexp_replace(text, '<(\\*/?s>)', '<\\\1', 'g'), '\[(\\*/?INST\])', '[\\\1', 'g')) + 22 AS n1
  FROM rows
), said AS (
  SELECT conv_id, count(*) AS n, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS s,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    CASE WHEN bool_or(hard) THEN sum(n1) ELSE sum(n0) END AS chars
  FROM sized GROUP BY conv_id, CASE WHEN conv_id IS NULL THEN r END
)
SELECT conv_id, n AS n_turns, sha256(s) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(chars + 10 AS BIGINT) AS formatted_chars, true AS identical
FROM said
"""
