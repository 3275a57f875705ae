"""Operators on a whole corpus: chat, near duplicates, decontamination, language model, pipeline."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import chat, decontaminate, mixer, mixing, simhash

from .edge import CLASH, ROWS, documents, empty

DATA = "/root/testdata/sf0.001"


def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("turns", F.lit(1)).withColumn("plain", F.lit(2))


HARD = ["</s>", "<s>", "<\\s>", "<\\\\/s>", "[INST]", "[/INST]", "[\\/INST]", " [/INST]", "x</s", "<", "\\", "", "#!turns 1\n", "a\nb", "</s><s>[INST] user [/INST]", None]


def test_every_text_survives(spark):
    rng = np.random.default_rng(1)
    rows = [(c, t, str(rng.choice(["user", "assistant", "system", "</s>", "r [/INST]", ""])), HARD[rng.integers(len(HARD))]) for c in range(300) for t in range(rng.integers(1, 5))]
    rows += [(1000 + k, 0, "assistant", "".join(x or "" for x in rng.choice([h for h in HARD if h], 6))) for k in range(200)]
    x = chat.formatted(turns(spark, rows)).cache()
    assert x.where("recovered <> turns").count() == 0
    assert {r["rung"] for r in x.collect()} == {0, 1}
    said = lambda r: "".join(t["text"] for t in r["turns"] if t["role"] == "assistant")
    assert all(r["loss"] == said(r) for r in x.withColumn("loss", chat.under_mask(F.col("formatted"))).collect())


def test_every_rung_reads_back_and_the_last_failure_is_an_error(spark, monkeypatch):
    rows = turns(spark, [(c, 0, "assistant", "".join(x or "" for x in h)) for c, h in enumerate(zip(HARD, HARD[3:], HARD[5:]))])
    monkeypatch.setattr(chat, "RUNGS", (2,))
    x = chat.formatted(rows)
    assert x.where("recovered <> turns").count() == 0 and {r["rung"] for r in x.collect()} == {2}
    monkeypatch.setattr(chat, "RUNGS", (0,))
    with pytest.raises(Exception, match="no rung"):
        chat.formatted(rows).collect()


def test_mask_covers_the_whole_text(spark):
    rng = np.random.default_rng(2)
    x = chat.formatted(turns(spark, [(c, 0, str(rng.choice(["user", "assistant"])), HARD[c % len(HARD)]) for c in range(60)]))
    for r in x.select("turns", "formatted", chat.mask(F.col("formatted")).alias("m")).collect():
        at, loss = 0, []
        for run in r["m"]:
            if run["loss"]:
                loss.append(r["formatted"][at : at + run["n"]])
            at += run["n"]
        assert at == len(r["formatted"]) and loss == [run["said"] for run in r["m"] if run["loss"]]
        assert len(loss) == sum(t["role"] == "assistant" for t in r["turns"])


def test_op4_edges(spark):
    rows = [(1, 2, "assistant", "two"), (1, 1, "user", None), (1, 2, "assistant", "two"), (1, None, None, "first"), (None, 1, "user", "x"), (None, 1, "assistant", "y" * 200_000), (2, 0, "assistant", "")]
    got = {r["conv_id"]: r for r in chat.digests(chat.formatted(turns(spark, rows))).collect()}
    assert got[1]["n_turns"] == 4 and got[1]["loss_chars"] == 6 and got[2]["loss_chars"] == 0
    alone = [r for r in chat.digests(chat.formatted(turns(spark, rows))).collect() if r["conv_id"] is None]
    assert sorted((r["n_turns"], r["loss_chars"]) for r in alone) == [(1, 0), (1, 200_000)]
    assert got[1]["turns_sha256"] == hashlib.sha256(b"\nfirst\nuser\n\nassistant\ntwo\nassistant\ntwo\n").hexdigest()
    assert chat.digests(chat.formatted(turns(spark, rows).limit(0))).count() == 0


def test_op4_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{DATA}/conversations.parquet'")
    want = sorted(map(repr, con.execute(chat.OP4_SQL).fetchall()))
    assert sorted(repr(tuple(r)) for r in chat.op4_chat_format(spark, DATA).collect()) == want


def fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def components(ids, fps):
    up = list(range(len(ids)))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    f = np.array(fps, np.uint64)
    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f[i + 1 :] ^ f[i]) <= 3) + i + 1:
            up[find(i)] = find(int(j))
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(ids))]


@pytest.mark.parametrize("divided,tree", [(4096, 2048), (0, 2048), (3, 2048), (4096, 8)])
def test_op6_brute(spark, monkeypatch, divided, tree):
    monkeypatch.setattr(simhash, "DIVIDED", divided)
    monkeypatch.setattr(simhash, "TREE", tree)
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").unionByName(documents(spark).select((F.col("doc_id") + 10_000).alias("doc_id"), "text"))
    rows = docs.collect()
    fps = [fingerprint(r["text"]) for r in rows]
    want = sorted(zip([r["doc_id"] for r in rows], [f"{f:016x}" for f in fps], components([r["doc_id"] for r in rows], fps)), key=repr)
    assert sorted((tuple(r) for r in simhash.groups(docs).collect()), key=repr) == want


@pytest.mark.parametrize("tree", [2048, 16])
def test_links_join_a_chain_and_a_cloud(spark, monkeypatch, tree):
    monkeypatch.setattr(simhash, "TREE", tree)
    rng = np.random.default_rng(9)
    at, fps = int(rng.integers(1 << 62)), set()
    for _ in range(120):  # a chain: ends far apart
        fps.add(at)
        for b in rng.choice(64, 3, replace=False):
            at ^= 1 << int(b)
    centre = int(rng.integers(1 << 62))
    fps |= {centre ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (300, 2))}
    fps |= {int(x) for x in rng.integers(0, 1 << 62, 200)}
    fps = sorted(fps)
    df = spark.createDataFrame([(f if f < 1 << 63 else f - (1 << 64),) for f in fps], "fp bigint")
    star = {r["node"]: r["root"] for r in simhash.stars(simhash.links(df)).collect()}
    got = defaultdict(set)
    for f in fps:
        s = f if f < 1 << 63 else f - (1 << 64)
        got[star.get(s, s)].add(f)
    want = defaultdict(set)
    for f, c in zip(fps, components(list(range(len(fps))), fps)):
        want[c].add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_forest_finds_all():
    rng = np.random.default_rng(2)
    fp = np.unique(rng.integers(0, 1 << 12, 900).astype(np.uint64))
    tree = np.sort(rng.integers(0, 3, len(fp)))
    pairs = {(int(q), int(n)) for a, b in simhash.Forest(fp, tree).search(fp, tree) for q, n in zip(a, b)}
    want = {(i, j) for i in range(len(fp)) for j in range(len(fp)) if tree[i] == tree[j] and int(fp[i] ^ fp[j]).bit_count() <= 3}
    assert pairs == want


def test_op6_keeps_one_of_each(spark):
    kept = simhash.one_of_each(documents(spark))
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == documents(spark).columns
    assert ids.count(5) == 1 and 6 not in ids and 1 in ids and 2 not in ids and 10 not in ids and len(ids) == len(set(ids))
    assert simhash.groups(empty(spark)).count() == 0 and simhash.one_of_each(empty(spark)).count() == 0


def test_op6_keeps_one_row_of_each_component_without_ids_or_with_repeated_ones(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["amber", "birch", "cedar", "delta", "ember", "fjord", "grove", "heath"], 40)) for _ in range(8)]
    # 0-2 only without ids (2 twice), 3 with and without, 4 and 5 under one id, 6 and 7 alone.
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[2]), (None, texts[2]), (None, texts[3]), (30, texts[3]), (4, texts[4]), (4, texts[5]), (6, texts[6]), (7, texts[7])]
    want = sorted([(0, t) for t in texts[:3]] + [(30, texts[3]), (4, texts[4]), (4, texts[5]), (6, texts[6]), (7, texts[7])])
    assert len(set(components(list(range(8)), [fingerprint(t) for t in texts]))) == 8
    for k in (1, -1):
        got = simhash.one_of_each(documents(spark, rows[::k])).collect()
        assert sorted((r["doc_id"] or 0, r["text"]) for r in got) == want


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def contaminated(docs, items):
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 12)) if w else ():
            windows[tuple(w[k : k + 13])].add(i)
    sizes, out = {len(k) for k in windows}, []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (g := tuple(w[k : k + n])) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[g]
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(found), digest, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [400_000, 200])
def test_op8_brute(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").unionByName(documents(spark).select("doc_id", "text"))
    items = spark.read.parquet(f"{DATA}/benchmark.parquet").unionByName(spark.createDataFrame([(900, "Twice the very SAME"), (901, "a"), (902, None), (903, " .. "), (901, "a"), (904, "in it, twice")], "item_id bigint, text string")).withColumn("doc_id", F.lit(1))
    got = sorted((tuple(r)[:6] for r in decontaminate.contamination(docs, items).collect()), key=repr)
    assert got == contaminated([tuple(r) for r in docs.collect()], [tuple(r)[:2] for r in items.select("item_id", "text").collect()])


@pytest.mark.parametrize("block", [400_000, 2])
def test_op8_judges_rows_not_ids(spark, monkeypatch, block):
    """Repeated and null ids over several partitions, with one block of queries and with many."""
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    rows = [(1, "alpha beta"), (1, "alpha beta"), (None, "gamma delta"), (None, "gamma delta"), (None, "none of them"), (7, "clean"), (7, "gamma delta alpha beta"), (8, None), (8, "")]
    docs = documents(spark, rows).repartition(4)
    items = spark.createDataFrame([(1, "alpha beta"), (2, "gamma delta"), (3, "delta alpha")], "item_id bigint, text string")
    got = sorted((tuple(r)[:6] for r in decontaminate.contamination(docs, items).collect()), key=repr)
    assert got == contaminated([r[:2] for r in rows], [tuple(r) for r in items.collect()])
    kept = sorted(((r["doc_id"], r["text"]) for r in decontaminate.clean_only(docs, items).collect()), key=repr)
    assert kept == sorted([(None, "none of them"), (7, "clean"), (8, None), (8, "")], key=repr)


def test_op8_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    assert sorted(repr(tuple(r)) for r in decontaminate.op8_decontamination(spark, DATA).collect()) == sorted(map(repr, con.execute(decontaminate.OP8_SQL).fetchall()))


def test_op8_edges(spark):
    items = spark.createDataFrame([(1, "x y")], "item_id bigint, text string")
    assert decontaminate.contamination(empty(spark), items).count() == 0
    none = decontaminate.contamination(documents(spark), items.limit(0)).collect()
    assert len(none) == len(ROWS) and not any(r["contaminated"] for r in none)
    clean = decontaminate.clean_only(documents(spark), spark.createDataFrame([(1, "with several words")], "item_id bigint, text string"))
    assert clean.columns == documents(spark).columns and sorted(str(r["doc_id"]) for r in clean.collect()) == sorted(str(i) for i, _ in ROWS if i not in (5, 6))


def test_op8_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x beta"), (2, "alpha x x x beta"), (3, "beta alpha"), (4, "alpha"), (5, None)], "doc_id bigint, text string")
    got = decontaminate.proximity(decontaminate.build_index(docs), [(7, "Alpha BETA"), (8, "missing alpha")], 2).collect()
    assert sorted(map(tuple, got)) == [(7, 1), (7, 3)]


def test_op10_base_and_model(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").unionByName(documents(spark).select("doc_id", "text"))
    rows, c = docs.collect(), Counter()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    tokens = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    for r in rows:
        if not held(r["doc_id"]):
            c.update(tokens(r["text"]))
    n, v = sum(c.values()), len(c)
    want = sorted(((r["doc_id"], held(r["doc_id"]), len(tokens(r["text"])), sum(c[t] > 0 for t in tokens(r["text"])), n, round(sum(np.log10((c[t] + 1) / (n + v + 1)) for t in tokens(r["text"])), 3)) for r in rows), key=repr)
    got = mixing.scores(docs).collect()
    assert sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 3)) for r in got), key=repr) == want
    assert all(r["score"] < 0 for r in got)
    # A model that has learnt the corpus codes its held-out texts in far fewer bits than eight a byte.
    real = [r for r in got if r["held_out"] and r["n_tokens"] > 100]
    assert np.mean([r["bits_per_byte"] for r in real]) < 3.2


def test_op10_edges(spark):
    assert mixing.scores(empty(spark)).count() == 0
    none = mixing.scores(documents(spark), F.lit(True)).collect()
    assert len(none) == len(ROWS) and {r["n_known"] for r in none} == {0} and {r["base_score"] for r in none} == {0.0}
    assert all(np.isfinite(r["score"]) for r in none)


def random_model(seed):
    rng = np.random.default_rng(seed)
    tables = [rng.integers(0, 248, 1 << 16).astype(np.uint8) for _ in range(len(mixing.ORDERS) + 1)]
    return mixing.Trees(rng.integers(0, 50, 65536)), tables


def coded(spark, texts, ranks, trees, tables):
    """log2 of the probability of each text, by the operator's coder."""
    code = mixer.coder(spark, mixer.packed(mixing.START, mixing.RATE, mixing.STEP, mixing.MIDDLE, trees, ranks, tables))
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").repartition(3)
    return [r["x"] / np.log(2) for r in rows.select("k", code(F.col("t")).alias("x")).orderBy("k").collect()]


def test_probabilities_add_up(spark):
    """What may stand first in a text, a byte or the end, has probabilities that add up to one."""
    trees, tables = random_model(3)
    code = Coder(trees, tables, {})
    total = sum(2 ** code.text([bytes([b])] if b != mixing.END else [mixing.END], 1) for b in range(256))
    assert abs(total - 1) < 1e-3
    assert np.allclose(coded(spark, ["", None, " \t\n"], {}, trees, tables), code.text([mixing.END]))


def test_coder_is_the_one_written_out(spark):
    """Words short and long, capitals, other scripts and white space of all kinds, with a model of noise."""
    rng = np.random.default_rng(4)
    trees, tables = random_model(4)
    words = ["".join(chr(c) for c in rng.integers(97, 123, rng.integers(1, 9))) for _ in range(60)] + ["x" * 500, "ÉÀ", "漢字", "The", "a\x00b", "\x1c\x85"]
    ranks = {w.encode(): k + 1 for k, w in enumerate(words[:9])} | {b"the": 10}
    texts = [str(rng.choice([" ", "\n", "\t \r", "\x0b\x0c"])).join(words[k] for k in rng.integers(0, len(words), n)) for n in (1, 5, 40, 90)] + ["THE the The"]
    code = Coder(trees, tables, ranks)
    want = [code.text([*mixing.tokens_of(t.encode()), mixing.END]) for t in texts]
    assert np.allclose(coded(spark, texts, ranks, trees, tables), want, rtol=1e-5)


def test_op10_counts_and_scores_stay_in_the_jvm(spark):
    """Counts of words and runs, passed on in many parts, and what a scorer with frequent words tells of texts; no text goes to Python."""
    rng = np.random.default_rng(5)
    words = ["".join(chr(c) for c in rng.integers(97, 123, rng.integers(1, 9))) for _ in range(80)] + ["y" * 300, "ÉÀ", "漢字", "The", "a\x00b", "\x00"]
    texts = [" ".join(words[k] for k in rng.integers(0, len(words), n)) for n in (1, 30, 200, 90)] + ["THE the\tThe\n", "", None, " \n"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").repartition(2)
    said = [mixing.tokens_of((t or "").encode()) for t in texts]
    got, ranks = Counter(), {words[0].encode(): 1, b"the": 2}
    counted, runs = mixer.words_in(rows, 10), mixer.runs_in(rows, ranks, 50)
    assert counted.count() > len(set(w for t in said for w in t))
    for r in counted.collect():
        got[bytes(r["word"])] += r["n"]
    assert got == Counter(w for t in said for w in t)
    want, got = Counter(), Counter()
    for t in said:
        rank = 0
        for w in [*t, b"\n"]:
            s = b"\n" if w == b"\n" else w + b" "
            for k, c in enumerate(s):
                want[rank << 34 | min(k, 3) << 32 | int.from_bytes(s[max(k - 3, 0) : k], "big") << 8 | c] += 1
            rank = ranks.get(w, rank)
    for r in runs.collect():
        got[r["key"]] += r["n"]
    assert got == want
    trees, tables = random_model(5)
    head = {w: float(k) for k, w in enumerate(sorted({w for t in said for w in t})[::2])}
    code = mixer.scorer(spark, mixer.packed(mixing.START, mixing.RATE, mixing.STEP, mixing.MIDDLE, trees, ranks, tables, head))
    scored = spark.createDataFrame(list(enumerate(texts)), "k int, t string").repartition(2).select("k", code(F.col("t")).alias("s"))
    plain = Coder(trees, tables, ranks)
    for t, s in zip(said, [r["s"] for r in scored.orderBy("k").collect()]):
        assert (s["n_words"], s["n_bytes"], s["n_head"], s["head_log"]) == (len(t), sum(len(w) + 1 for w in t), sum(w in head for w in t), sum(head.get(w, 0) for w in t))
        assert [bytes(w) for w in s["rare"]] == [w for w in t if w not in head]
        assert np.isclose(s["log"] / np.log(2), plain.text([*t, mixing.END]), rtol=1e-5)
    for df in (counted, runs, scored):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Arrow" not in plan and "Python" not in plan


class Coder:
    """The coder written out bit by bit, with whole numbers for hashes."""

    def __init__(self, trees, tables, ranks):
        self.paths = {k: (trees.nodes[a : a + n].tolist(), trees.bits[a : a + n].tolist()) for k, (a, n) in enumerate(zip(trees.start.tolist(), trees.size.tolist()))}
        self.tables, self.ranks = tables, ranks

    @staticmethod
    def stir(x):
        x = (x ^ x >> 15) * 0x9E3779B1 & 0xFFFFFFFF
        return x ^ x >> 13

    @classmethod
    def context(cls, before, order, rank=None):
        """before: the bytes of the word so far, the nearest last."""
        if order:
            h = sum((c + 1) * pow(0x01000193, d + 1, 1 << 32) for d, c in enumerate(before[::-1][:order]))
        else:
            h = sum((c + 1) * pow(0x01000193, k, 1 << 32) for k, c in enumerate(before))
        h = cls.stir(h & 0xFFFFFFFF)
        return h if rank is None else cls.stir(h + (rank + 1) * 0xC2B2AE35 & 0xFFFFFFFF)

    @classmethod
    def contexts(cls, before, rank):
        return [cls.context(before, 3), cls.context(before, 5), cls.context(before, 0), cls.context(before, 3, rank)]

    @staticmethod
    def slot(h, node, bits):
        return ((h * 0x9E3779B1 & 0xFFFFFFFF) >> 38 - bits) * 64 + ((h + node * 0x85EBCA6B & 0xFFFFFFFF) >> 26)

    def text(self, tokens, most=None):
        """log2 of the probability of tokens, or of their first bytes."""
        weights, total, rank, done = mixing.START.astype(float).copy(), 0.0, 0, 0
        for w in tokens:
            said = [w] if w == mixing.END else [*w, mixing.SPACE]
            for k, c in enumerate(said):
                if done == most:
                    return total
                done += 1
                hs = self.contexts(said[:k], rank)
                codes = None
                for node, bit in zip(*self.paths[(said[k - 1] if k else mixing.SPACE) << 8 | c]):
                    found = [int(t[self.slot(h, node, len(t).bit_length() - 1)]) for t, h in zip(self.tables, hs)]
                    if codes is None:  # the gate is that of the byte's first decision
                        codes = [f & 3 for f in found]
                        gate = (3 if codes[2] == 3 else 2 if codes[1] >= 2 else codes[1]) + 4 * codes[3]
                    x = np.array([((f >> 2) - 31) * 0.25 for f in found]) * (1 if bit else -1)
                    wrong = 1 / (1 + np.exp(weights[gate] @ x))
                    total += np.log2(1 - min(max(wrong, 1e-6), 1 - 1e-6))
                    weights[gate] += mixing.RATE * wrong * x
            if w != mixing.END:
                rank = self.ranks.get(w, rank)
        return total


def huffman(pairs):
    """Paths of the trees, made with lists instead of heaps."""
    paths = {}
    for before in range(256):
        alive = [(pairs.get((before, c), 0) + 1, c) for c in range(256)]
        above = {}
        for inner in range(256, 511):
            (a, x), (b, y) = sorted(alive)[:2]
            alive = [v for v in alive if v[1] not in (x, y)] + [(a + b, inner)]
            above[x], above[y] = (inner, 0), (inner, 1)
        for c in range(256):
            nodes, bits, at = [], [], c
            while at != 510:
                at, bit = above[at]
                nodes.append(before << 8 | at - 256)
                bits.append(bit)
            paths[before << 8 | c] = (nodes[::-1], bits[::-1])
    return paths


def test_op10_brute(spark, tmp_path):
    """The whole query against counts and a coder written out, over texts in training and not."""
    text = [r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").limit(25).collect()]
    docs = [(k, (t or "")[:700]) for k, t in enumerate(text)] + [(100, None), (101, ""), (None, "the of"), (102, "the xqzzy " * 30), (3, "a repeated id")]
    spark.createDataFrame(docs, "doc_id bigint, text string").toPandas().convert_dtypes().to_parquet(f"{tmp_path}/documents.parquet")
    tokens = {i: mixing.tokens_of((t or "").encode()) for i, (_, t) in enumerate(docs)}
    held = [zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2 for d, _ in docs]
    taught = [tokens[i] for i in tokens if not held[i]]
    words = Counter(w for t in taught for w in t)
    ranks = {w: k + 1 for k, (w, _) in enumerate(sorted(words.items(), key=lambda x: (-x[1], x[0]))[: mixing.COMMON])}
    pairs = Counter({(mixing.SPACE, mixing.END): len(taught)})
    for w, n in words.items():
        for a, b in zip(b" " + w, w + b" "):
            pairs[a, b] += n
    coder = Coder(mixing.Trees(np.zeros(65536, np.int64)), [], ranks)
    coder.paths = huffman(pairs)
    bits = mixing.bits_for(len(words))
    sums = [defaultdict(lambda: [0, 0]) for _ in range(4)]
    for t in taught:
        rank = 0
        for w in [*t, mixing.END]:
            said = [w] if w == mixing.END else [*w, mixing.SPACE]
            for k, c in enumerate(said):
                hs = Coder.contexts(said[:k], rank)
                for node, bit in zip(*coder.paths[(said[k - 1] if k else mixing.SPACE) << 8 | c]):
                    for s, h in zip(sums, hs):
                        s[Coder.slot(h, node, bits)][bit] += 1
            if w != mixing.END:
                rank = ranks.get(w, rank)
    for s in sums:
        table = np.full(1 << bits, 31 << 2, np.uint8)
        for part in range(max(1, (1 << bits) >> 16)):
            mine = {k: v for k, v in s.items() if k >> 16 == part}
            middle = sorted([a + b for a, b in mine.values()] + [0] * (65536 - len(mine)))[32768]
            for k, (a, b) in mine.items():
                n = a + b - middle
                table[k] = round(min(31, max(-31, np.rint(np.log((b + 0.4) / (a + 0.4)) / 0.25)))) + 31 << 2 | (n >= 1) + (n >= 2) + (n >= 16)
        coder.tables.append(table)
    want = sorted(((d if d is not None else -1), held[i], coder.text([*tokens[i], mixing.END])) for i, (d, _) in enumerate(docs))
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["held_out"], r["score"] / np.log10(2)) for r in mixing.op10_context_mixing(spark, str(tmp_path)).collect())
    assert [g[:2] for g in got] == [w[:2] for w in want] and any(held) and not all(held)
    assert np.allclose([g[2] for g in got], [w[2] for w in want], rtol=1e-4)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = corpus_pipeline.run(spark, DATA).collect()
    rows = {r["doc_id"]: r for r in docs.collect()}
    from .test_texts import brute_rules, library

    good = {i: r["text"] for i, r in rows.items() if brute_rules(r["text"])[-1]}
    fps = {i: fingerprint(t) for i, t in good.items()}
    ids = sorted(good)
    first = {i for i, c in zip(ids, components(ids, [fps[i] for i in ids])) if i == c}
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {x[0] for x in contaminated([(i, good[i]) for i in first], items) if x[5]}
    assert {r["doc_id"] for r in out} == first - bad
    assert all(r["ids"] == library(rows[r["doc_id"]]["text"]) and r["n_tokens"] == len(r["ids"]) for r in out)


def test_stages_judge_rows_not_ids(spark, tmp_path):
    """Repeated and null ids, copies of texts under other ids and none: each stage against brute force over rows."""
    from .test_texts import brute_rules

    base = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").limit(90).select("doc_id", "text").collect()]
    rows = base + [(None, base[1][1]), (None, base[2][1]), (None, base[40][1] + " and more words"), (5, base[60][1] + " of another text"), (5, base[61][1] + " of a third text"), (7, None), (None, ""), (base[3][0], base[3][1])]
    docs = documents(spark, rows, "en").select("doc_id", "text").withColumn("lang", F.lit("en")).withColumn("text2", F.lit(1)).repartition(5)
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    key = lambda r: (r[0] is None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).hexdigest())
    stages = dict(corpus_pipeline.STAGES)
    kept = sorted({r: None for r in rows if brute_rules(r[1])[-1]}, key=key)
    got = stages["quality"](spark, docs, DATA)
    assert sorted({tuple(r)[:2] for r in got.collect()}, key=key) == kept
    # Of each component the first row, by id, rows without one last, then by digest.
    group = components(list(range(len(kept))), [fingerprint(t) for _, t in kept])
    first = sorted((min((kept[k] for k in range(len(kept)) if group[k] == c), key=key) for c in set(group)), key=key)
    got = stages["near_duplicates"](spark, got, DATA)
    assert sorted((tuple(r)[:2] for r in got.collect()), key=key) == first
    clean = [r for r, x in ((r, contaminated([(0, r[1])], items)[0]) for r in first) if not x[5]]
    assert sorted((tuple(r)[:2] for r in stages["decontamination"](spark, got, DATA).collect()), key=key) == clean and len(clean) < len(first)
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert sorted((tuple(r)[:2] for r in stages["decontamination"](spark, got, str(tmp_path)).collect()), key=key) == first


def test_pipeline_edges(spark):
    docs = documents(spark)
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, DATA)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert made.columns == docs.columns
            assert stage(spark, empty(spark), DATA).count() == 0
        made.collect()
    assert set(CLASH) <= set(docs.columns)
