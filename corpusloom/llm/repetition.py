"""Repetition rules: characters inside repeated n-grams of several lengths and inside repeated lines.

Words are runs of other bytes than ASCII white space. A batch of texts becomes one array of word numbers;
rolling hashes of n consecutive words are sorted, and equal neighbours are compared word by word, so hashes
only find candidates. A word is covered for n if it lies in an occurrence of an n-gram that is not the first
in its text. Null text has no words and fails the base rule; repeated rows are judged one by one, and equal
texts get equal verdicts. An empty table gives an empty result. Very long texts are judged whole, alone in
their batch if need be. Only doc_id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: n: share of a text's word characters that n-grams seen before may cover. Widely published limits for web text.
LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
DUP_LINE_SHARE = 0.30
DUP_LINE_CHARS = 0.20
LENGTHS = tuple(LIMITS)
SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SHARES = ("dup_line_share", "dup_line_char_share", *(f"cover_{n}" for n in LENGTHS))
KIND = "struct<" + ",".join([f"{c}:bigint" for c in COUNTS] + ["base_failed:boolean", "kept:boolean"] + [f"{c}:double" for c in SHARES]) + ">"
PRIME = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def covered(words: np.ndarray, doc: np.ndarray, rolled: np.ndarray, n: int, first_too: bool) -> np.ndarray:
    """Mask of the words inside occurrences of repeated n-grams; the first occurrence counts if first_too."""
    starts = np.flatnonzero(doc[: len(doc) - n + 1] == doc[n - 1 :]) if len(doc) >= n else np.zeros(0, np.int64)
    mark = np.zeros(len(words) + 1, np.int64)
    if len(starts):
        h = rolled[starts]
        order = np.argsort(h)
        h, at = h[order], starts[order]
        same = np.flatnonzero(h[1:] == h[:-1])
        a, b = at[same], at[same + 1]
        true = doc[a] == doc[b]
        for k in range(n):
            true &= words[a + k] == words[b + k]
        same = same[true]
        linked = np.zeros(len(at), bool)  # equal to the one before it in sorted order
        linked[same + 1] = True
        hit = linked.copy()
        hit[same] = True
        if not first_too:
            run = np.flatnonzero(~linked)
            firsts = np.minimum.reduceat(at, run)
            hit &= at != np.repeat(firsts, np.diff(np.append(run, len(at))))
        mark[: len(words)] += np.bincount(at[hit], minlength=len(words))
        mark -= np.bincount(at[hit] + n, minlength=len(words) + 1)
    return np.cumsum(mark[:-1]) > 0


def measure(texts: list[bytes | None]) -> dict[str, np.ndarray]:
    """Counts and shares of each text."""
    split = [(t or b"").split() for t in texts]
    sizes = np.array([len(x) for x in split], np.int64)
    every = [w for x in split for w in x]
    number = {w: k for k, w in enumerate(dict.fromkeys(every))}
    words = np.fromiter(map(number.__getitem__, every), np.int64, len(every))
    doc = np.repeat(np.arange(len(texts)), sizes)
    flat = np.frombuffer(b"".join(number), np.uint8)
    ends = np.cumsum(np.fromiter(map(len, number), np.int64, len(number)))
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True

    def per_word(mask: np.ndarray) -> np.ndarray:
        run = np.concatenate([[0], np.cumsum(mask)])[np.concatenate([[0], ends])]
        return np.diff(run)[words]

    def per_text(x: np.ndarray) -> np.ndarray:
        return np.bincount(doc, weights=x, minlength=len(texts)).astype(np.int64)

    chars = per_word((flat & 0xC0) != 0x80)
    out = {"n_words": sizes, "word_chars": per_text(chars), "n_symbols": per_text(per_word(symbol[flat]))}
    dup, dup_chars, lines, all_chars = (np.zeros(len(texts), np.int64) for _ in range(4))
    for k, t in enumerate(texts):
        real = [x for x in t.split(b"\n") if x.strip()] if t else []
        lines[k] = len(real)
        all_chars[k] = sum(map(len, real))
        if len(once := dict.fromkeys(real)) < len(real):
            dup[k] = len(real) - len(once)
            dup_chars[k] = all_chars[k] - sum(map(len, once))
    out["n_dup_lines"] = dup
    number_hash = mixed(words.astype(np.uint64) * PRIME + np.uint64(1))
    rolled, salt = number_hash, mixed(doc.astype(np.uint64) + PRIME)
    share = lambda a, b: np.divide(a, b, out=np.zeros(len(texts)), where=b > 0)
    out |= {"dup_line_share": share(dup, lines), "dup_line_char_share": share(dup_chars, all_chars)}
    for n in range(2, max(LENGTHS) + 1):
        if n <= len(words):
            rolled = rolled[: len(words) - n + 1] * PRIME + number_hash[n - 1 :]
        else:
            rolled = rolled[:0]
        if n == 3:
            out["n_repeat_words"] = per_text(covered(words, doc, rolled ^ salt[: len(rolled)], n, True))
        if n in LENGTHS:
            out[f"cover_{n}"] = share(per_text(covered(words, doc, rolled ^ salt[: len(rolled)], n, False) * chars), out["word_chars"])
    n = out["n_words"]
    out["base_failed"] = (n < 50) | (100 * out["n_repeat_words"] > 50 * n)
    bad = (out["dup_line_share"] > DUP_LINE_SHARE) | (out["dup_line_char_share"] > DUP_LINE_CHARS)
    for k in LENGTHS:
        bad |= out[f"cover_{k}"] > LIMITS[k]
    out["kept"] = ~out["base_failed"] & ~bad
    return out


def verdict(text: Column) -> Column:
    """struct of the counts, base_failed, kept and the shares."""

    @F.arrow_udf(KIND)
    def judge(texts: pa.Array) -> pa.Array:
        m = measure(texts.cast(pa.binary()).to_pylist())
        names = [*COUNTS, "base_failed", "kept", *SHARES]
        return pa.StructArray.from_arrays([pa.array(m[c]) for c in names], names)

    return judge(text)


def rules(docs: DataFrame) -> DataFrame:
    """doc_id and the verdict of each row of docs. One pass, no shuffle."""
    common.bound_batches(docs.sparkSession)
    return docs.select("doc_id", verdict(F.col("text")).alias("_v")).select("doc_id", "_v.*")


def kept_only(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with their columns."""
    common.bound_batches(docs.sparkSession)
    return docs.where(verdict(F.col("text"))["kept"])


def op3_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document. Null text: no words, fails. Null or repeated ids: a row each. Empty table: no rows."""
    return rules(common.table(spark, sf_dir, "documents"))


def _cover_sql(n: int) -> str:
    """Word numbers inside an n-gram that has stood in the text before."""
    return f"""cover_{n} AS (SELECT r, sum(cs[p]) AS chars FROM (SELECT DISTINCT r, cs, unnest(range(i, i + {n})) AS p FROM (
  SELECT r, cs, i, row_number() OVER (PARTITION BY r, g ORDER BY i) AS nth FROM (SELECT r, cs, i, array_to_string(w[i:i + {n - 1}], ' ') AS g FROM (SELECT r, w, cs, unnest(range(1, len(w) - {n} + 2)) AS i FROM doc WHERE len(w) >= {n})))
  WHERE nth > 1) GROUP BY r)"""


#: The same rows by written-out n-grams.
OP3_SQL = (
    r"""
WITH split AS (SELECT row_number() OVER () AS r, doc_id, text, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
doc AS (SELECT *, list_transform(w, lambda x: length(x)) AS cs FROM split),
line AS (SELECT r, string_split(text, chr(10)) AS parts FROM doc WHERE text IS NOT NULL),
said AS (SELECT r, t, count(*) AS n FROM (SELECT r, unnest(parts) AS t FROM line) WHERE regexp_matches(t, '[^\x20\x09-\x0D]') GROUP BY r, t),
lines AS (SELECT r, sum(n) AS n_lines, sum(n - 1) AS n_dup, sum(n * strlen(t)) AS line_chars, sum((n - 1) * strlen(t)) AS dup_chars FROM said GROUP BY r),
again AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 3)) AS p FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM (SELECT r, i, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM doc WHERE len(w) >= 3))) WHERE n > 1) GROUP BY r),
"""
    + ",\n".join(map(_cover_sql, LENGTHS))
    + r""",
counted AS (SELECT r, doc_id, len(w) AS n_words, coalesce(list_sum(cs), 0) AS word_chars, coalesce(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')), 0) AS n_symbols,
  coalesce(n_dup, 0) AS n_dup_lines, coalesce(again.n, 0) AS n_repeat_words, coalesce(n_dup / n_lines, 0.0) AS dup_line_share, coalesce(dup_chars / line_chars, 0.0) AS dup_line_char_share,
  """
    + ", ".join(f"CASE WHEN len(w) > 0 THEN coalesce(cover_{n}.chars, 0) / list_sum(cs) ELSE 0.0 END AS cover_{n}" for n in LENGTHS)
    + "\n  FROM doc LEFT JOIN lines USING (r) LEFT JOIN again USING (r) "
    + " ".join(f"LEFT JOIN cover_{n} USING (r)" for n in LENGTHS)
    + f"""),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted)
SELECT doc_id, n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND dup_line_share <= {DUP_LINE_SHARE}::DOUBLE AND dup_line_char_share <= {DUP_LINE_CHARS}::DOUBLE{"".join(f" AND cover_{n} <= {x}::DOUBLE" for n, x in LIMITS.items())} AS kept,
  {", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in SHARES)}
FROM judged
"""
)
