"""Edge rows of the quality score, the normaliser and the gates."""

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions import values as V
from corpusloom.operators import pages, quality
from corpusloom.plans import documents, standins


def scored(spark, text, title="alpha beta", language=False):
    df = spark.createDataFrame([(1, title, text)], "doc_id bigint, title string, text string")
    return quality.quality_score(df, is_language=F.lit(language)).select("score", "reason").first()


def body(words, chars=None):
    t = "alpha beta yang " + " ".join(["kata"] * (words - 3))
    return t if chars is None else t.ljust(chars, "x")


@pytest.mark.parametrize("text,title", [("", "t"), (None, "t"), ("t", ""), ("t", None)])
def test_empty(spark, text, title):
    assert tuple(scored(spark, text, title)) == (0, "empty_input")


def test_block_phrases_count_only_early(spark):
    for p in V.BLOCK_PHRASES:
        assert scored(spark, p + " " + body(200))[1] == "noise_page"
        assert scored(spark, body(200, 1200) + p)[1] != "noise_page"


def test_section_page(spark):
    assert scored(spark, body(200, 20000))[1] != "rejected_section_page"
    assert scored(spark, body(200, 20001))[1] == "rejected_section_page"


@pytest.mark.parametrize("n,points", [(299, 0), (300, 10), (499, 10), (500, 15), (999, 15), (1000, 25)])
def test_length_points(spark, n, points):
    text = "alpha beta yang ".ljust(n, "x")
    assert scored(spark, text)[0] == int((points + 0 + 15 + 25) / 100 * 100)


@pytest.mark.parametrize("n,points", [(39, 0), (40, 5), (69, 5), (70, 15), (149, 15), (150, 25)])
def test_word_points(spark, n, points):
    text = body(n)
    length = 25 if len(text) >= 1000 else 15 if len(text) >= 500 else 10 if len(text) >= 300 else 0
    assert scored(spark, text)[0] == length + points + 15 + 25


def test_title_overlap(spark):
    ten = " ".join(f"w{k}" for k in range(10))
    assert scored(spark, "w1 " + body(200), ten)[1] == "rejected_title_mismatch"
    assert scored(spark, "w1 w2 " + body(200), ten)[1] != "rejected_title_mismatch"
    # A title of stop-words alone takes the title's points out of the possible ones: 25 + 25 + 15 of 75.
    assert scored(spark, body(200), "yang dan")[0] == int(65 / 75 * 100)


def test_soft_phrases_each_cost_eight(spark):
    base = scored(spark, body(300), language=True)[0]
    for k in range(1, len(V.SOFT_PHRASES) + 1):
        text = body(300) + " " + " ".join(V.SOFT_PHRASES[:k])
        assert scored(spark, text, language=True)[0] == max(0, base - 8 * k)


def test_stopword_is_case_sensitive(spark):
    assert scored(spark, "alpha beta Yang " + "kata " * 100)[1] == "low_quality_no_stopword"


def test_normaliser(spark):
    text = "ﬁne​&amp;\xa0word “q” ‘r’ a–b—c―d‒e , end\n\n\n\nx http://a.b/c me@x.org <b>bold</b>  two   (Foto: X) editor: somebody. rest"
    df = spark.createDataFrame([(1, None, text)], "doc_id bigint, title string, text string")
    r = quality.normalise(df).first()
    assert r["clean_text"] == "fine& word \"q\" 'r' a-b-c-d-e, end\n\nx bold two rest"
    assert r["addresses_removed"] == 2
    again = quality.normalise(spark.createDataFrame([(1, None, r["clean_text"])], "doc_id bigint, title string, text string")).first()
    assert again["clean_text"] == r["clean_text"]


def test_glued_headline(spark):
    df = spark.createDataFrame([("Big News: Today (live)", "BIG NEWS today LIVE - The body.")], "title string, text string")
    assert df.select(quality.unglue_title(F.col("text"), F.col("title"))).first()[0] == "The body."
    df = spark.createDataFrame([("Big News", "Other start")], "title string, text string")
    assert df.select(quality.unglue_title(F.col("text"), F.col("title"))).first()[0] == "Other start"


def test_sentences_once(spark):
    df = spark.createDataFrame([("This is a sentence. Short one. This is a sentence. And another one here!",)], "text string")
    assert df.select(quality.unique_sentences(F.col("text"))).first()[0] == ["This is a sentence.", "And another one here!"]


def page(paragraphs, extra=""):
    return "<html><title>x</title><nav><p>menu</p></nav>" + extra + "".join(f"<p>{p}</p>" for p in paragraphs) + "</html>"


def test_extraction_gate(spark):
    long = "alpha beta gamma delta sentence number {} goes on and on for quite a while so that it counts. "
    good = page([long.format(k) * 2 for k in range(6)])
    linked = page(["p"] * 5, '<script type="application/ld+json">{"@graph":[{"@type":"NewsArticle","articleBody":"' + " ".join(f"Alpha beta linked sentence {k} is here for you." for k in range(20)) + '"}]}</script>')
    rows = [(1, good, "alpha beta", None), (2, page([long.format(1)] * 3), "alpha beta", None), (3, linked, "alpha beta", None), (4, None, "t", None), (5, page(["short"] * 9), "t", None), (6, good, "zeta eta theta", None), (7, None, "alpha beta", " ".join(long.format(k) for k in range(20)))]
    df = spark.createDataFrame(rows, "k int, html string, title string, feed string")
    got = {r["k"]: r["gate"] for r in pages.extraction_gate(df, feed_text="feed").collect()}
    assert got == {1: "valid_paragraphs", 2: "rejected_low_paragraph_density", 3: "valid_jsonld", 4: "fetch_no_html", 5: "text_too_short", 6: "title_mismatch", 7: "valid_rss_fulltext"}


def test_recovery(spark):
    rows = [(None, 200), ("http://x.y/", 200), ("http://x.y/a", 404)]
    df = spark.createDataFrame([(u, s, None, "t", None) for u, s in rows], "resolved_url string, http_status int, html string, title string, attempts int")
    assert [r["recovery_status"] for r in pages.recovery(df).collect()] == ["failed_unresolved", "rejected_homepage_redirect", "fetch_http_404"]


def test_page_links(spark):
    a = '<link rel="canonical" href="http://a.b/c">'
    b = "<LINK href='http://d.e/f' rel='canonical'>"
    df = spark.createDataFrame([(a,), (b,), ("x",), (None,), ("<p>Just a Moment...</p>",)], "h string")
    got = df.select(T.canonical_url(F.col("h")).alias("c"), T.is_interstitial(F.col("h")).alias("i")).collect()
    assert [r["c"] for r in got] == ["http://a.b/c", "http://d.e/f", None, None, None]
    assert [r["i"] for r in got] == [False, False, False, False, True]


def test_token_url(spark):
    import base64

    token = base64.urlsafe_b64encode(b"\x08\x13\x22\x1ahttps://news.example/a-b\xd2\x01").decode().rstrip("=")
    assert spark.createDataFrame([(token,)], "t string").select(T.token_url(F.col("t"))).first()[0] == "https://news.example/a-b"


def test_dates(spark):
    rows = ["Mon, 01 Jan 2024 10:00:00 GMT", "20240203T040506Z", "2024-05-06T07:08:09+02:00", "nonsense", None, "2024-02-30"]
    got = [r[0] for r in spark.createDataFrame([(r,) for r in rows], "d string").select(F.date_format(T.parsed_date(F.col("d")), "yyyy-MM-dd HH:mm")).collect()]
    assert got[0] == "2024-01-01 10:00" and got[1] == "2024-02-03 04:05" and got[2] == "2024-05-06 05:08" and got[3:] == [None, None, None]


def test_reasons(spark):
    df = spark.createDataFrame([(r,) for r in ("media_timeout", "http_403", "http_404", "other", None)], "r string")
    assert [r[0] for r in df.select(T.reason_category(F.col("r"))).collect()] == ["timeout", "blocked", "dead_link", "other", None]


def test_clean_article_keeps_digits_at_the_ends_of_sentences(spark):
    """No sentence loses digits that are its place in the text: here sentence k begins and ends with k."""
    parts = [f"{k} apples lie on the table of house no {k}" for k in range(12)]
    df = spark.createDataFrame([(". ".join(parts) + "!", "Another title")], "text string, title string")
    assert df.select(quality.clean_article(F.col("text"), F.col("title"))).first()[0] == ". ".join(parts) + "!"


def test_extracted_text_keeps_digits_at_the_ends_of_sentences(spark):
    parts = [f"{k} apples lie on the table of a house that has the number {k}." for k in range(12)]
    page = "".join(f"<p>{p}</p>" for p in parts)
    df = spark.createDataFrame([(page, "Apples on the table")], "html string, title string")
    assert pages.extraction_gate(df).select("gate", "article_text").first() == ("valid_paragraphs", " ".join(parts))


def test_repeated_sentences_that_begin_with_their_place(spark):
    """The second of equal sentences goes, though the first begins with the digit of its place."""
    df = spark.createDataFrame([("Short. 148.9.179.169 is an address! 148.9.179.169 is an address! 3 is the place of this one.",)], "text string")
    assert df.select(quality.unique_sentences(F.col("text"))).first()[0] == ["148.9.179.169 is an address!", "3 is the place of this one."]


@pytest.mark.parametrize(
    "title,text,want",
    [
        # A line ends at a line feed only.
        ("x", "The first sentence is here. Sponsor of\rthis\u2028all\x85of it. The rest is here.", "The first sentence is here. The rest is here."),
        ("x", "The first sentence is here. Editor: me\r\nThe rest is here now.", "The first sentence is here. The rest is here now."),
        # s and k in their rare forms; no i with a dot in capitals.
        ("x", "The first sentence is here. \u017fponsor of it", "The first sentence is here."),
        ("x", "The first sentence is here. S\u0130MAK JUGA: it goes on", "The first sentence is here. S\u0130MAK JUGA: it goes on"),
        # A title is as long in lower case as it was; the sigma at a word's end is like others.
        ("\u0130stanbul is far", "\u0130stanbul is far - Ankara, 12 here is a whole sentence of it.", "whole sentence of it."),
        ("\u03a3\u0391\u03a3 is here", "\u03c3\u03b1\u03c3 is here: some words, and a whole sentence of it.", "ole sentence of it."),
    ],
)
def test_clean_article_reads_patterns_as_the_sql_does(spark, title, text, want):
    import duckdb

    from corpusloom.plans import served

    df = spark.createDataFrame([(text, title)], "text string, title string")
    got = df.select(quality.clean_article(F.col("text"), F.col("title"))).first()[0]
    con = duckdb.connect()
    assert got == con.execute(f"WITH src AS (SELECT ? AS text, ? AS title), {served.clean_sql('text')} SELECT article FROM cleaned", [text, title]).fetchone()[0]
    assert got == want


def test_paragraphs_keep_hard_spaces_inside(spark):
    """White space is what it is in the SQL; spaces of any width at the ends of a paragraph go."""
    df = spark.createDataFrame([("<p>\u00a0one\u00a0two \r\n three\x0bfour \u2003</p><p>\u3000</p><p>five</p>",)], "html string")
    assert df.select(pages.main_text(F.col("html"))["main_text"]).first()[0] == "one\u00a0two three\x0bfour\nfive"


def test_borders_and_ends_of_sentences_are_those_of_the_sql(spark):
    """A vertical tab and a hard space part nothing, a space of any width at an end goes, U+0001 parts."""
    whole = "A first whole sentence.\x0bIt goes on here.\u00a0So it does."
    text = f"{whole} \u2003Wide space around this one.\u00a0\r\nA sign\x01inside of this sentence."
    df = spark.createDataFrame([(text,)], "text string")
    assert df.select(quality.unique_sentences(F.col("text"))).first()[0] == [whole, "Wide space around this one.\u00a0\r\nA sign", "inside of this sentence."]


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_a_null_text_has_no_counts_of_sentences(spark, monkeypatch, ansi):
    """As in the SQL, counts of a null text are null, those of an empty one are not, whether the session is an ANSI one or not."""
    df = spark.createDataFrame([(1, None), (2, ""), (3, "One sentence of it. One sentence of it.")], "doc_id bigint, text string")
    monkeypatch.setattr(standins, "raw_texts", lambda spark, sf_dir: df)
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        got = documents.sentence_dedup(spark, "").orderBy("doc_id").collect()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)
    assert [(r["n_sentences"], r["n_kept"], r["kept_sha256"] is None) for r in got] == [(None, None, True), (1, 0, False), (2, 1, False)]
