"""Entities, contexts, merges, evaluation, feeds, stages and files on hand-made rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import context, dedup, entities, evaluation, merge, scoring, serving
from corpusloom.plans import stages
from corpusloom.sources import feeds, tables


def spans(terms, text):
    return [(e, s, x) for e, s, _, x, _ in entities.Matcher(terms).spans(text)]


def test_leftmost_longest():
    terms = [("ali", 1, True), ("ali baba", 2, True), ("baba", 3, False), ("ba", 4, False)]
    assert spans(terms, "Ali Baba and alibaba, BABA") == [(2, 0, "Ali Baba"), (3, 22, "BABA")]
    assert spans(terms, "") == [] and spans([], "Ali") == []
    assert spans([("éa", 1, True)], "İéa ÉA") == [(1, 4, "ÉA")]


def test_spans_never_overlap():
    rng = np.random.default_rng(3)
    terms = [(" ".join(rng.choice(list("abc"), rng.integers(1, 4))), k, True) for k in range(8)]
    for _ in range(200):
        s = entities.Matcher(terms).spans(" ".join(rng.choice(list("abcd"), 12)))
        assert all(a[2] <= b[1] for a, b in zip(s, s[1:]))


def test_dictionary_last_writer(spark):
    df = spark.createDataFrame([(1, "One", ["shared", "x"]), (2, "Two", ["Shared"])], "entity_id bigint, canonical_name string, aliases array<string>")
    got = {r["term"]: (r["entity_id"], r["canonical"]) for r in entities.dictionary(df).collect()}
    assert got == {"one": (1, True), "shared": (2, False), "two": (2, True)}


def test_salience(spark):
    dic = spark.createDataFrame([(1, "ann", []), (2, "bob", ["robert"]), (3, "cid", [])], "entity_id bigint, canonical_name string, aliases array<string>")
    docs = spark.createDataFrame([(1, "Ann", "bob robert cid"), (2, None, "cid bob"), (3, "nobody", "here")], "doc_id bigint, title string, text string")
    m = entities.match(docs, entities.dictionary(dic), entities.composed(F.col("title"), F.col("text")))
    got = sorted((r["doc_id"], r["entity_id"], r["rank"], r["is_main"]) for r in entities.salience(m).collect())
    assert got == [(1, 1, 1, True), (1, 2, 2, False), (2, 3, 1, True)]


def test_terms_in_blocks_give_the_same_spans(spark, monkeypatch):
    dic = spark.createDataFrame([(1, "ann lee", ["ann"]), (2, "lee", []), (3, "bob", ["lee bob", "rob"])], "entity_id bigint, canonical_name string, aliases array<string>")
    docs = spark.createDataFrame([(1, "Ann Lee Bob", "rob, ann; LEE"), (2, None, None)], "doc_id bigint, title string, text string")
    found = lambda: [tuple(r) for r in entities.hits(entities.match(docs, entities.dictionary(dic), entities.composed(F.col("title"), F.col("text")))).orderBy("doc_id", "start").collect()]
    whole = found()
    monkeypatch.setattr(entities, "MOST_TERMS", 2)
    assert found() == whole and len(whole) == 5


def test_veto_needs_a_holder_and_keeps_the_whole_name(spark):
    df = spark.createDataFrame([("dans", "dans", []), ("Joko Widodo", "Joko Widodo", ["Joko Widodo Putra"]), ("Bobby", "Bobby Nasution", ["Bobby Afif Nasution"]), ("Bobby", "Bobby Nasution", ["Bobby Danuardi", "Bobby Nasution X"])], "m string, c string, p array<string>")
    assert [r[0] for r in df.select(entities.veto(F.col("m"), F.col("c"), F.col("p"))).collect()] == [False, False, False, True]


def test_resolve_keeps_configured_documents_apart(spark):
    dic = spark.createDataFrame([(1, "Ann Lee", ["Ann"]), (2, "Bob", [])], "entity_id bigint, canonical_name string, aliases array<string>")
    rows = [(1, "Ann met Bob", "Ann went. Bob too.", None), (2, "Ann met Bob", "Ann went. Bob too.", 2), (3, "Nothing", "here", 1), (4, "Ann Smith speaks", "it rains", None), (5, "x", "y", 77)]
    docs = spark.createDataFrame(rows, "doc_id bigint, title string, text string, configured_entity_id bigint")
    mentions, mapped = entities.resolve(docs, dic, entities.composed(F.col("title"), F.col("text")))
    got = {(r["doc_id"], r["entity_id"]): (r["first_offset"], r["resolver_source"]) for r in mapped.collect()}
    assert got == {(1, 1): (0, "dictionary"), (1, 2): (8, "dictionary"), (2, 2): (8, "pre_attributed"), (3, 1): (-1, "pre_attributed"), (5, 77): (-1, "pre_attributed")}
    assert sorted((r["doc_id"], r["start"]) for r in mentions.where("doc_id > 1").collect()) == [(2, 8), (2, 22), (3, -1), (5, -1)]


def test_core_argument_and_history(spark):
    df = spark.createDataFrame([("The house of Ann fell", "Ann"), ("Ann fell", "Ann"), ("it fell", "Ann")], "s string, n string")
    assert [r[0] for r in df.select(context.core_argument(F.col("s"), F.col("n"))).collect()] == [False, True, True]
    docs = spark.createDataFrame([(1, "T one", "x" * 600), (2, "Two!", "x" * 600)], "doc_id bigint, title string, text string")
    none = spark.createDataFrame([], "doc_id bigint, context string, quality_score int")
    old = spark.createDataFrame([("two",), (None,), ("",)], "title string")
    assert {r["doc_id"]: r["outcome"] for r in context.readiness(docs, none, old).collect()} == {1: "queued", 2: "skipped_duplicate_title"}


def test_language_by_frequent_words(spark):
    from corpusloom.functions import text as T

    df = spark.createDataFrame([("Presiden yang akan datang dan tidak di sini",), ("the end of the road",), ("xyz",), (None,)], "t string")
    assert [r[0] for r in df.select(T.language(F.col("t"))).collect()] == ["id", "en", None, None]


def test_null_keys_meet_nothing(spark):
    table = spark.createDataFrame([(1, "a"), (None, "b"), (None, "c")], "k bigint, v string")
    changes = spark.createDataFrame([(1, "x"), (None, "y")], "k bigint, v string")
    assert sorted(r["v"] for r in merge.partial_update(table, changes, ["k"]).collect()) == ["b", "c", "x"]


def test_months_are_made_and_dropped(spark, tmp_path):
    at = f"{tmp_path}/m"
    x = spark.createDataFrame([(k, f"2024-{k:02}-05") for k in range(1, 10)], "id bigint, d string").withColumn("at", F.to_timestamp("d")).drop("d")
    tables.write_by_month(x, at, "at", "month")
    assert tables.create_months(spark, at, "month", "2024-11-20", 2) == ["2024-11-01", "2024-12-01", "2025-01-01"]
    assert tables.drop_months(spark, at, "month", "2024-11-20", 6) == [f"2024-0{k}-01" for k in range(1, 5)]
    assert tables.months(spark, at, "month")[0] == "2024-05-01" and sorted(r["id"] for r in spark.read.parquet(at).collect()) == [5, 6, 7, 8, 9]


def test_streams_restart_from_what_is_on_disk(spark, tmp_path):
    from corpusloom.streaming import jobs

    kind = "entity_id bigint, scored_at timestamp, value double"
    source, at = f"{tmp_path}/in", f"{tmp_path}/work"
    write = lambda rows: spark.createDataFrame(rows, "entity_id bigint, t string, value double").selectExpr("entity_id", "CAST(t AS TIMESTAMP) AS scored_at", "value").coalesce(1).write.mode("append").parquet(source)
    stream = lambda: spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(source)
    top = lambda: sorted((r["entity_id"], r["value"]) for r in jobs.top_of_each(stream(), f"{at}/top", ["entity_id"], [F.desc("value")], 1).collect())
    days = lambda: sorted((r["entity_id"], r["n"], r["spike"]) for r in jobs.spike_alerts(stream(), f"{at}/spikes", 7, 0.5).collect())
    spark.createDataFrame([], kind).write.parquet(source)
    assert top() == [] and days() == []
    assert jobs.appended(stream(), f"{at}/rows").count() == 0 and jobs.snapshot(stream().groupBy("entity_id").count(), f"{at}/snap").count() == 0
    write([(1, "2024-01-01 10:00:00", 5.0), (2, "2024-01-01 11:00:00", 1.0), (None, "2024-01-01 11:00:00", 9.0)])
    first = jobs.top_of_each(stream(), f"{at}/top", ["entity_id"], [F.desc("value")], 1).where("entity_id IS NOT NULL")
    assert sorted((r["entity_id"], r["value"]) for r in first.collect()) == [(1, 5.0), (2, 1.0)]
    # Nothing is held in memory between the runs: the best of the first batch must come from disk.
    write([(1, "2024-01-02 10:00:00", 3.0), (2, "2024-01-02 11:00:00", 4.0)])
    again = jobs.top_of_each(stream(), f"{at}/top", ["entity_id"], [F.desc("value")], 1).where("entity_id IS NOT NULL")
    assert sorted((r["entity_id"], r["value"]) for r in again.collect()) == [(1, 5.0), (2, 4.0)]
    write([(1, "2024-01-03 10:00:00", 1.0)] * 5)
    assert [x[:2] for x in days() if x[2]] == [(1, 5)]
    write([(1, "2024-01-04 10:00:00", 1.0)] * 40)
    assert [x[:2] for x in days() if x[2]] == [(1, 5), (1, 40)]


def test_finetune_rows(spark):
    docs = spark.createDataFrame([(1, "m", "x" * 300), (2, "m", "x" * 299), (3, "m", "Advertisement\n" * 40)], "doc_id bigint, source string, text string")
    scores = spark.createDataFrame([(k, 7, "positive", 0.8, 0.1, 0.1, 0.8) for k in (1, 2, 3)] + [(1, 8, "neutral", 0.34, 0.33, 0.34, 0.33)], "doc_id bigint, entity_id bigint, label string, confidence double, score_negative double, score_neutral double, score_positive double")
    contexts = spark.createDataFrame([(d, e, f"context {d} {e} " * 6) for d in (1, 2, 3) for e in (7, 8)], "doc_id bigint, entity_id bigint, context string")
    got = evaluation.finetune_rows(docs, scores, contexts, 42).collect()
    assert [(r["doc_id"], r["entity_id"], r["pseudo_label"]) for r in got] == [(1, 7, "positive")]
    with pytest.raises(ValueError, match="fewer"):
        evaluation.evaluated(spark.createDataFrame([(1, 1)], "gold int, predicted int"))


def test_veto(spark):
    df = spark.createDataFrame([("Ali", "Ali Baba", ["Tom Ali"]), ("Ali", "Ali Baba", ["Ali Baba"]), ("Ali", "Ali Baba", [])], "m string, c string, p array<string>")
    assert [r[0] for r in df.select(entities.veto(F.col("m"), F.col("c"), F.col("p"))).collect()] == [True, False, False]


def test_candidates(spark):
    t = spark.createDataFrame([("Presiden Joko Anwar datang",)] * 3 + [("Menteri Kota Jakarta Raya",)] * 3 + [("Budi Karya tiba",)] * 5, "title string")
    known = spark.createDataFrame([("nobody",)], "canonical_name string")
    got = [tuple(r) for r in entities.candidates(t, known).select("name", "mention_count", F.round("confidence", 3)).collect()]
    assert got == [("Presiden Joko Anwar", 3, 0.8)]


def test_sentences_and_windows(spark):
    text = "First sentence is here. He said “well” today. Third sentence was kata there! Dia went home again. Tiny. The last sentence stands alone"
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    s = context.sentence_table(docs, F.col("text"))
    rows = s.orderBy("pos").collect()
    assert [text[r["start"] : r["end"]] for r in rows] == [r["sentence"] for r in rows] and [r["pos"] for r in rows] == [0, 1, 2, 3, 4]
    w = {r["pos"]: r["context"] for r in context.windows(s, active=("kata",)).collect()}
    assert w[2] == "First sentence is here. He said “well” today. Third sentence was kata there! Dia went home again."
    assert w[0] == "First sentence is here. He said “well” today." and w[4] == "The last sentence stands alone"


@pytest.mark.parametrize("n,kept", [(179, 181), (180, 180), (181, 180)])
def test_word_cap(spark, n, kept):
    df = spark.createDataFrame([("", " ".join(["a"] * n), "b c")], "b string, a string, n string")
    got = df.select(context.capped(F.col("b"), F.col("a"), F.col("n"))).first()[0].split()
    assert len(got) == min(180, n + 2) and got[: min(n, 180)] == ["a"] * min(n, 180)


def test_readiness_partitions(spark):
    docs = spark.createDataFrame([(1, "T one", "x" * 600), (2, "t ONE!", "x" * 600), (3, "b", "x" * 149), (4, "c", "x" * 150), (5, "d", "x" * 499), (6, "e", "x" * 500)], "doc_id bigint, title string, text string")
    ctx = spark.createDataFrame([(4, "y" * 50, 20), (5, "y" * 49, 90)], "doc_id bigint, context string, quality_score int")
    got = {r["doc_id"]: r["outcome"] for r in context.readiness(docs, ctx).collect()}
    assert got == {1: "queued", 2: "skipped_duplicate_title", 3: "failed_short_body", 4: "queued", 5: "failed_no_context", 6: "queued"}


def test_duplicate_of_points_at_survivors(spark):
    docs = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b"), (4, "a"), (5, ""), (6, ""), (7, None)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["duplicate_of"] for r in dedup.exact(docs).collect()}
    assert got == {1: None, 2: None, 3: 1, 4: 1, 5: None, 6: None, 7: None}


def test_near_pairs_recall(spark):
    x = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").limit(300)
    v = {r["vec_id"]: np.array(r["embedding"], float) for r in x.collect()}
    ids = sorted(v)
    m = np.stack([v[i] / np.linalg.norm(v[i]) for i in ids])
    c = m @ m.T
    least = float(np.quantile(c[np.triu_indices(len(ids), 1)], 0.999))
    want = {(ids[i], ids[j]) for i, j in zip(*np.triu_indices(len(ids), 1)) if c[i, j] >= least}
    # The settings are those of production: they come from rows and threshold.
    got = {(r["a"], r["b"]) for r in dedup.cosine_pairs(x, least).collect()}
    assert got == want


def test_hash_plan_keeps_buckets_and_recall():
    for n, least in ((10, 0.9), (2000, 0.95), (10**6, 0.95), (10**9, 0.95)):
        planes, tables_ = dedup.hash_plan(n, least, 0.999)
        assert n / 2**planes <= 32 or planes == 2
        assert (1 - (1 - np.arccos(least) / np.pi) ** planes) ** tables_ <= 0.001 + 1e-12


def test_near_tells_copies_and_links(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((6, 32))
    close = base[0] + 0.05 * rng.standard_normal(32)
    rows = [(k, v.tolist()) for k, v in enumerate([*base, base[0], base[0], close, base[5]])] + [(99, None)]
    x = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = {r["vec_id"]: (r["representative"], r["n_links"]) for r in dedup.near(x, 0.95).collect()}
    assert got == {0: (0, 1), 1: (1, 0), 2: (2, 0), 3: (3, 0), 4: (4, 0), 5: (5, 0), 6: (0, 1), 7: (0, 1), 8: (8, 1), 9: (5, 0)}


def test_near_finds_every_link_of_a_wide_angle(spark, monkeypatch):
    """Several blocks, against all pairs: scattered vectors, a dense group, copies, one key with two vectors, and cosines that are no number or just at the threshold."""
    rng = np.random.default_rng(3)
    v = rng.standard_normal((300, 16)).astype(np.float32)
    v[100:160] = v[100] + 0.01 * v[100:160]
    v[200], v[201], v[202] = v[5], 0, np.nan
    at = np.zeros((2, 16), np.float32)  # 9 / sqrt(400), just 0.45
    at[0, :2], at[1, :7] = (1, 1), (4, 5, 12, 3, 2, 1, 1)
    v[203:205] = at
    ids = [*range(299), 7]
    m = v.astype(float)
    with np.errstate(all="ignore"):
        norm = np.sqrt((m * m).sum(axis=1))
        c = m @ m.T / (norm[:, None] * norm)
    assert 0.4499 < c[203, 204] < 0.4501  # the root of the product, as in SQL, makes it 0.45
    rep = np.array([5 if k == 200 else i for k, i in enumerate(ids)])
    link = ~(c < 0.45) & (rep[:, None] != rep) & (np.arange(300) != 200)  # the copy is no vector of its own
    link[203, 204] = link[204, 203] = True
    n = {r: link[rep == r].sum() - link[200].sum() * (r == 5) for r in set(rep)}
    x = spark.createDataFrame([(i, row.tolist()) for i, row in zip(ids, v)] + [(400, None), (None, [9.0] * 16), (401, [1.0, 2.0]), (402, [1.0, None])], "vec_id bigint, embedding array<float>")
    monkeypatch.setattr(dedup, "block_plan", lambda n, most: 5, raising=False)
    rows = dedup.near(x, 0.45).collect()
    assert sorted((r["vec_id"], r["n_links"]) for r in rows if r["vec_id"] not in (None, 401, 402)) == sorted((i, n[r]) for i, r in zip(ids, rep))
    assert [r["n_links"] for r in rows if r["vec_id"] in (None, 401, 402)] == [0, 0, 0]
    assert all(np.isnan(r["best_cosine"]) for r in rows if r["vec_id"] not in (None, 401, 402))
    best = {r["vec_id"]: r["best_cosine"] for r in dedup.near(x.where("vec_id between 0 and 298 and vec_id not in (7, 201, 202)"), 0.45).collect()}
    use = [k for k in range(299) if k not in (7, 200, 201, 202)]
    for k in use:
        over = [c[k, j] for j in use if j != k and c[k, j] >= 0.45]
        assert best[k] is None if not over else abs(best[k] - max(over)) < 1e-12


def test_feed_parse_returns_whole_texts(spark, tmp_path):
    from corpusloom.plans import documents

    texts = {f"d{k}": " ".join(f"word{k}x{i}" for i in range(n)) for k, n in enumerate((5, 60, 20_000))}
    texts["d9"] = "an array ends x[y[0]]> 1 and goes on " + "after it " * 100 + "to the end"
    spark.createDataFrame([(i, t, "s") for i, t in texts.items()], "doc_id string, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["source_id"].rsplit("/", 1)[1]: r["text"] for r in documents.feed_parse(spark, str(tmp_path)).collect()}
    assert got == texts


def test_merges(spark):
    old = spark.createDataFrame([(1, "a", {"k": "1", "z": "0"}), (2, "b", None), (None, "n", None)], "id bigint, v string, m map<string,string>")
    new = spark.createDataFrame([(1, None, {"k": "2"}), (3, "c", None)], "id bigint, v string, m map<string,string>")
    got = {r["id"]: (r["v"], r["m"]) for r in merge.partial_update(old, new, ["id"], ("m",)).collect()}
    assert got[1] == ("a", {"z": "0", "k": "2"}) and got[2][0] == "b" and 3 not in got
    assert {r["id"] for r in merge.insert_if_absent(old, new, ["id"]).collect()} == {3}
    assert sorted((r["id"], r["v"]) for r in merge.upsert(old.dropna(subset=["id"]), new, ["id"], ["v"]).collect()) == [(1, None), (2, "b"), (3, "c")]
    swap = spark.createDataFrame([(None, "new", None)], "id bigint, v string, m map<string,string>")
    assert sorted(r["v"] for r in merge.replace(old, swap, ["id"]).collect()) == ["a", "b", "new"]
    assert merge.latest(new.withColumn("o", F.lit(1)), ["id"], F.col("o")).count() == 2


def test_recent_borders(spark):
    df = spark.createDataFrame([("2024-01-01",), ("2023-12-31",), ("2024-01-31",), ("2024-02-01",)], "d string").withColumn("d", F.to_date("d"))
    assert sorted(str(r["d"]) for r in merge.recent(df, "d", "2024-01-31", 30).collect()) == ["2024-01-01", "2024-01-31"]


def test_violations(spark):
    df = spark.createDataFrame([(1, "x", 1.5), (2, "negative", 0.5)], "id int, label string, confidence double")
    rules = {"label": F.col("label").isin("negative"), "range": F.col("confidence").between(0, 1)}
    assert sorted((r["id"], r["rule"]) for r in merge.violations(df, rules, "id").collect()) == [(1, "label"), (1, "range")]


def test_scores(spark):
    df = spark.createDataFrame([(0.4, 0.4, 0.2), (0.2, 0.4, 0.4)], "neg double, neu double, pos double")
    got = scoring.labelled(df, F.struct("neg", "neu", "pos")).collect()
    assert [r["label"] for r in got] == ["negative", "neutral"]
    assert scoring.labelled(df.limit(1), F.lit(None).cast("struct<neg:double,neu:double,pos:double>")).first()["label"] == "neutral"
    raw = spark.createDataFrame([("LABEL_2",), ("what",), (None,)], "l string")
    assert [r[0] for r in raw.select(scoring.normal_label(F.col("l"))).collect()] == ["positive", "neutral", "neutral"]


def test_evaluation(spark):
    rows = spark.createDataFrame([(1, 1)] * 3 + [(1, 0)] + [(0, 0)] * 2 + [(0, 1)] * 2 + [(2, 0)], "gold int, predicted int")
    m = evaluation.confusion(rows)
    r = {x["class"]: x for x in evaluation.report(m).collect()}
    assert r[1]["precision"] == pytest.approx(0.6) and r[1]["recall"] == pytest.approx(0.75) and r[2]["f1"] == 0
    a = evaluation.agreement(m).first()
    assert a["accuracy"] == pytest.approx(5 / 9) and a["kappa"] == pytest.approx((5 / 9 - (4 * 4 + 5 * 4) / 81) / (1 - (4 * 4 + 5 * 4) / 81))


def test_curation_is_greedy(spark):
    rng = np.random.default_rng(5)
    rows = [(k, int(rng.integers(4)), f"m{rng.integers(3)}", f"h{rng.integers(40)}") for k in range(120)]
    df = spark.createDataFrame(rows, "doc_id bigint, entity_id bigint, media string, content_hash string")
    got = {r["doc_id"] for r in evaluation.curated(df, 1, 9, 6).collect()}
    import hashlib

    order = sorted(rows, key=lambda r: hashlib.md5(f"{r[0]}1".encode()).hexdigest())
    want, seen, media, entity = set(), set(), {}, {}
    for d, e, m, h in order:
        if (h, e) in seen:
            continue
        seen.add((h, e))
        if media.get(m, 0) < 9 and entity.get(e, 0) < 6:
            media[m], entity[e] = media.get(m, 0) + 1, entity.get(e, 0) + 1
            want.add(d)
    assert got == want


def test_feed_items(spark):
    xml = """<rss><item><title><![CDATA[A title & more]]></title><guid>g1</guid><link>http://a/1</link><pubDate>Tue, 02 Jan 2024 03:04:05 +0100</pubDate>
    <description>&lt;p&gt;short&lt;/p&gt;</description><content:encoded><![CDATA[<p>Body of the item &amp; that is long enough</p>]]></content:encoded><enclosure url="http://i/1.png"/></item>
    <entry><title>Only a headline, which is long enough</title><link href="http://a/2"/><updated>bad</updated></entry><item><title>tiny</title><guid>g3</guid></item><item><title>No identity whatsoever here</title></item></rss>"""
    got = feeds.items(spark.createDataFrame([("f", xml)], "config_name string, xml string")).collect()
    assert [(r["source_id"], r["text"], r["image_url"]) for r in got] == [("g1", "Body of the item & that is long enough", "http://i/1.png"), ("http://a/2", "Only a headline, which is long enough", None)]
    assert got[0]["published_at"].isoformat() == "2024-01-02T02:04:05" and got[1]["published_at"] is None


def test_search_results(spark):
    html = '<a class="result__a" href="//duck/l/?uddg=https%3A%2F%2Fnews.example%2Fx&amp;rut=1">A <b>hit</b></a>'
    got = feeds.search_results(spark.createDataFrame([(1, html)], "entity_id bigint, html string")).first()
    assert (got["title"], got["source_url"]) == ("A hit", "https://news.example/x")


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q"', "x;y"), (2, None, "z")], "id int, t string, u string")
    tables.write_csv(df, f"{tmp_path}/c")
    back = tables.read_csv(spark, f"{tmp_path}/c")
    assert back.columns == ["id", "t", "u"] and back.count() == 2
    x = spark.createDataFrame([(1, "2024-01-05"), (2, "2024-02-05")], "id bigint, d string").withColumn("at", F.to_timestamp("d")).drop("d")
    tables.write_by_month(x, f"{tmp_path}/m", "at", "month")
    tables.write_by_month(x.where("id = 2").withColumn("id", F.lit(9).cast("bigint")), f"{tmp_path}/m", "at", "month", "overwrite")
    assert sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/m").collect()) == [1, 9]
    assert [r["id"] for r in tables.read_since(spark, f"{tmp_path}/m", "at", "month", "2024-02-01").collect()] == [9]
    (tmp_path / "f.xml").write_text("<rss><item>one</item></rss>")
    got = tables.fetch_feeds(spark, [("a", f"file://{tmp_path}/f.xml"), ("b", f"file://{tmp_path}/none.xml")], pause=0.01).orderBy("config_name").collect()
    assert got[0]["xml"].startswith("<rss>") and got[1]["xml"] is None and got[1]["error"]


def test_hosts_are_asked_in_two_lanes():
    urls = [f"http://{h}.example/{k}" for h, n in (("a", 5), ("b", 1)) for k in range(n)]
    lanes = tables._FeedReader({"names": "\n".join("n" for _ in urls), "urls": "\n".join(urls)}).partitions()
    assert sorted(len(p.feeds) for p in lanes) == [1, 2, 3] and sorted(u for p in lanes for _, u in p.feeds) == urls


def test_seed_statements(spark):
    x = tables.read_seed(spark, "-- people\nINSERT INTO people (canonical_name, aliases, entity_type)\nVALUES ('Ann O''Lee', ARRAY['Ann','A [x]']::text[], 'person'),\n ('Bob \"B\"', ARRAY['Rob'], 'party') ON CONFLICT (canonical_name) DO NOTHING;")
    assert [tuple(r) for r in x.orderBy("canonical_name").collect()] == [("Ann O'Lee", ["Ann", "A [x]"], "person"), ('Bob "B"', ["Rob"], "party")]


def test_public_never_leaks(spark):
    df = spark.createDataFrame([(1, "t", "secret", 0.5)], "doc_id int, title string, text string, score_positive double")
    assert serving.public(df).columns == ["doc_id", "title"]


def test_stages(spark, tmp_path):
    long = " ".join(f"Alpha beta is sentence number {k} yang about Rina Sari today." for k in range(30))
    rows = [(1, "Alpha beta Rina Sari", long, "pending"), (2, "Alpha beta copy", long, "pending"), (3, "Something else", "short", "pending"), (4, "alpha BETA rina sari!", long, "processed")]
    docs = spark.createDataFrame([(*r, "id", None) for r in rows], "doc_id bigint, title string, text string, status string, lang string, fail_reason string")
    dic = spark.createDataFrame([(7, "Rina Sari", ["Rina"])], "entity_id bigint, canonical_name string, aliases array<string>")
    out, log = stages.run((*stages.PREPARE, "score"), {"raw_texts": docs, "entities": dic}, stages.Settings(), str(tmp_path))
    got = {r["doc_id"]: (r["status"], r["fail_reason"]) for r in out["raw_texts"].collect()}
    assert got[1] == ("skipped", "duplicate_title") and got[3][0] == "failed" and got[4][0] == "processed"
    assert got[2][0] == "processed"
    assert {r["entity_id"] for r in out["scores"].collect()} == {None, 7} and log.count() >= 7
    first = log.where("stage = 'enrich'").first()
    assert (first["changed"], first["failed"], first["status"]) == (3, 1, "ok")
    broken, log = stages.run(("entity", "context"), {"raw_texts": docs.drop("title")}, stages.Settings(), f"{tmp_path}/x")
    assert [(r["stage"], r["status"]) for r in log.collect()] == [("entity", "failed")] and log.first()["error"]
