"""Rows that every operator must take: nulls, empty and very long texts, ties, repeated rows, columns with clashing names."""

CLASH = ("fp", "key", "word", "n", "row", "kept", "score", "lang_pred", "held_out", "component_id", "n_words", "_lang", "_row", "_kept", "_bad", "_d", "_v", "_g", "text2", "a", "b", "u", "v", "x", "hits", "rare", "_id", "grade")
LONG = "the quick brown fox and some more words go here again " * 4000
ROWS = [
    (None, "some text without an id that is long enough to have shingles"),
    (1, None),
    (2, ""),
    (3, " \n\t \n"),
    (4, LONG),
    (5, "a repeated row with several words in it, twice the very same"),
    (5, "a repeated row with several words in it, twice the very same"),
    (6, "a repeated row with several words in it, twice the very same"),
    (7, "x" * 100_000),
    (8, "漢字 😀 ﬁ İstanbul \x00 \x1c \x85 <|endoftext|> é́"),
    (9, "1234 !!! ---"),
    (10, None),
]


def documents(spark, rows=None, lang="en"):
    """A table of documents with more columns than asked for."""
    df = spark.createDataFrame([(i, t, lang if i is None or i % 3 else None, None, None) for i, t in (ROWS if rows is None else rows)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return df.selectExpr("*", *[f"{k} AS {c}" for k, c in enumerate(CLASH)])


def empty(spark):
    return documents(spark, [])
