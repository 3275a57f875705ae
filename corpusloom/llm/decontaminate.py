"""A distributed positional inverted index over training texts, and exact phrase and proximity search in it.

The index is dealt by document: a shard holds the texts of about TOKENS tokens as one row with its terms and,
end to end, the ascending positions of each term. Shards need no shuffle, so frequent words make long
lists in each shard and no hot key. A search gets the queries of one bounded block by broadcast; within
a shard it starts from the rarest term of each phrase and intersects its list, moved by the offsets, with
those of the other terms from the rarest on. Further blocks of queries are further passes over the stored index.

Null texts have no words; items without words or id have no windows. Rows are judged one by one, also those
whose id is repeated or null: what blocks add up goes by the shard's number and the place in the shard. A very
long text is one place in a shard of its own size. An empty table has no rows in the result, an empty benchmark
hits nothing. Only doc_id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW = 13
TOKENS = 1 << 20
#: Words of one broadcast block of items: some 13 numbers of 4 bytes for each.
BLOCK_WORDS = 400_000
#: Candidates that a search holds at a time.
CANDIDATES = 1 << 21
#: The type of doc_id is that of the documents; shard: partition and running number when the index was built.
INDEX = "shard bigint, doc_ids array<{}>, doc_ends array<int>, terms binary, term_ends binary, positions binary"
HITS = "doc_id {}, n_words bigint, n_hit bigint, n_items bigint, items array<bigint>, shard bigint, place int, runs array<int>"
#: Letters A-Z become a-z, other ASCII that is neither letter nor digit becomes a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


def packed(x: np.ndarray) -> bytes:
    """Differences, compressed; the size comes first."""
    raw = np.diff(x.astype(np.int32), prepend=np.int32(0)).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(x: bytes) -> np.ndarray:
    raw = pa.decompress(x[8:], int.from_bytes(x[:8], "little"), codec="zstd")
    return np.cumsum(np.frombuffer(raw, np.int32), dtype=np.int32)


def _shard(shard: int, ids: list, texts: list[list[bytes]]) -> dict:
    every = [w for t in texts for w in t]
    number = {w: k for k, w in enumerate(dict.fromkeys(every))}
    term = np.fromiter(map(number.__getitem__, every), np.int32, len(every))
    ends = np.cumsum(np.bincount(term, minlength=len(number)))
    return {"shard": shard, "doc_ids": ids, "doc_ends": np.cumsum([len(t) for t in texts]).tolist(), "terms": b" ".join(number), "term_ends": packed(ends), "positions": packed(np.argsort(term, kind="stable"))}


def _built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids, texts, n, kind = [], [], 0, None
    number = TaskContext.get().partitionId() << 33

    def row() -> pa.RecordBatch:
        schema = pa.schema([("shard", pa.int64()), ("doc_ids", pa.list_(kind)), ("doc_ends", pa.list_(pa.int32())), ("terms", pa.binary()), ("term_ends", pa.binary()), ("positions", pa.binary())])
        return pa.RecordBatch.from_pylist([_shard(number, ids, texts)], schema)

    for batch in batches:
        kind = batch.schema.field("doc_id").type
        for i, t in zip(batch["doc_id"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist()):
            ids.append(i)
            texts.append(words_of(t))
            n += len(texts[-1])
            if n >= TOKENS:
                yield row()
                ids, texts, n, number = [], [], 0, number + 1
    if ids:
        yield row()


def kind_of(df: DataFrame) -> str:
    return df.schema["doc_id" if "doc_id" in df.columns else "doc_ids"].dataType.simpleString().removeprefix("array<").removesuffix(">")


def build_index(docs: DataFrame) -> DataFrame:
    """The index of docs(doc_id, text), stored in the shared folder. doc_id: whole numbers, or strings."""
    common.bound_batches(docs.sparkSession)
    key = F.col("doc_id") if kind_of(docs) == "string" else F.col("doc_id").cast("bigint").alias("doc_id")
    rows = docs.select(key, "text")
    return common.stored(rows.mapInArrow(_built, INDEX.format(kind_of(rows))), "index")


class Shard:
    def __init__(self, row: dict):
        self.ids, self.ends = row["doc_ids"], np.array(row["doc_ends"], np.int64)
        self.number = {w: k for k, w in enumerate(row["terms"].split(b" "))} if row["terms"] else {}
        self.term_ends = unpacked(row["term_ends"]).astype(np.int64)
        self.positions = unpacked(row["positions"]).astype(np.int64)
        self.df = np.diff(self.term_ends, prepend=0)
        # (term, position) as one ascending list: an intersection is a search in it.
        self.keyed = np.repeat(np.arange(len(self.df)), self.df) << 32 | self.positions

    def doc(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, at, "right")

    def phrases(self, terms: list[bytes], windows: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (window, position) of all occurrences. windows: numbers of terms, padded with -1."""
        mine = np.array([self.number.get(w, -1) for w in terms], np.int64)
        pad = np.arange(windows.shape[1]) >= sizes[:, None]
        t = np.where(pad, 0, mine[windows])
        there = np.flatnonzero((t >= 0).all(axis=1))
        if not len(there) or not len(self.df):
            return
        t, pad, sizes = t[there], pad[there], sizes[there]
        count = np.where(pad, np.iinfo(np.int64).max, self.df[t])
        rare = np.argsort(count, axis=1, kind="stable")
        n = count.min(axis=1)
        cuts = np.cumsum(n) // CANDIDATES
        for part in np.split(np.arange(len(there)), np.flatnonzero(np.diff(cuts)) + 1):
            w = np.repeat(part, n[part])
            first = t[w, rare[w, 0]]
            ends = np.cumsum(n[part])
            at = self.positions[np.arange(len(w)) + np.repeat(self.term_ends[t[part, rare[part, 0]]] - ends, n[part])] - rare[w, 0]
            del first
            keep = at >= 0
            w, at = w[keep], at[keep]
            for k in range(1, windows.shape[1]):
                more = sizes[w] > k
                if not more.any():
                    break
                offset = rare[w, k]
                want = t[w, offset] << 32 | (at + offset)
                found = np.searchsorted(self.keyed, want)
                keep = ~more | (self.keyed[np.minimum(found, len(self.keyed) - 1)] == want)
                w, at = w[keep], at[keep]
            keep = self.doc(at) == self.doc(at + sizes[w] - 1)
            yield there[w[keep]], at[keep]

    def near(self, words: list[bytes], slop: int) -> np.ndarray:
        """Documents with an occurrence of the rarest word that has each other word within slop positions."""
        t = [self.number.get(w, -1) for w in dict.fromkeys(words)]
        if not t or min(t) < 0:
            return np.zeros(0, np.int64)
        lists = sorted((self.positions[self.term_ends[k] - self.df[k] : self.term_ends[k]] for k in t), key=len)
        at = lists[0]
        for x in lists[1:]:
            d = self.doc(at)
            start = np.where(d > 0, self.ends[np.maximum(d - 1, 0)], 0)
            lo = np.searchsorted(x, np.maximum(at - slop, start))
            keep = lo < np.searchsorted(x, np.minimum(at + slop, self.ends[d] - 1), "right")
            at = at[keep]
        return np.unique(self.doc(at))


def blocks(items: DataFrame) -> Iterator[dict]:
    """The windows of items(item_id, text) in blocks of about BLOCK_WORDS words, one at a time on the driver."""

    def made(rows: list[tuple[int, list[bytes]]]) -> dict:
        number: dict[bytes, int] = {}
        ids, windows, sizes = [], [], []
        for i, words in rows:
            w = [number.setdefault(x, len(number)) for x in words]
            for k in range(max(1, len(w) - WINDOW + 1)):
                part = w[k : k + WINDOW]
                ids.append(i)
                sizes.append(len(part))
                windows.append(part + [-1] * (WINDOW - len(part)))
        return {"terms": list(number), "windows": np.array(windows, np.int32), "sizes": np.array(sizes, np.int64), "items": np.array(ids, np.int64)}

    rows, n = [], 0
    for r in items.select("item_id", "text").where(F.col("item_id").isNotNull()).toLocalIterator():
        if words := words_of((r[1] or "").encode()):
            rows.append((r[0], words))
            n += len(words)
            if n >= BLOCK_WORDS:
                yield made(rows)
                rows, n = [], 0
    if rows:
        yield made(rows)


def search(index: DataFrame, block: dict | None) -> DataFrame:
    """For each indexed document: its words, those hit, the items with occurring windows, and the runs hit.

    shard, place: where the document stands in the index, for adding up blocks; runs: begins and ends of the hit words.
    """
    sent, kind = index.sparkSession.sparkContext.broadcast(block), kind_of(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = sent.value
        for batch in batches:
            for row in batch.to_pylist():
                s = Shard(row)
                total = int(s.ends[-1]) if len(s.ends) else 0
                mark, pairs = np.zeros(total + 1, np.int64), [np.zeros((2, 0), np.int64)]
                if q is not None:
                    for w, at in s.phrases(q["terms"], q["windows"], q["sizes"]):
                        np.add.at(mark, at, 1)
                        np.add.at(mark, at + q["sizes"][w], -1)
                        pairs.append(np.unique(np.stack([s.doc(at), q["items"][w]]), axis=1))
                hit = np.cumsum(mark[:-1]) > 0
                runs = np.flatnonzero(np.diff(hit.astype(np.int8), prepend=0, append=0))
                doc, item = np.unique(np.concatenate(pairs, axis=1), axis=1)
                begins = np.append(0, s.ends[:-1])
                of = np.concatenate([[0], np.cumsum(hit)])
                n_hit = of[s.ends] - of[begins]
                # A run that crosses a border between texts is cut there.
                out = {"doc_id": s.ids, "n_words": s.ends - begins, "n_hit": n_hit}
                d_lo, d_hi = np.searchsorted(doc, np.arange(len(s.ids))), np.searchsorted(doc, np.arange(len(s.ids)), "right")
                out["n_items"] = d_hi - d_lo
                out["items"] = [item[a:b].tolist() for a, b in zip(d_lo, d_hi)]
                out["shard"], out["place"] = np.full(len(s.ids), row["shard"]), np.arange(len(s.ids))
                out["runs"] = [_cut(runs, a, b) if n else [] for a, b, n in zip(begins, s.ends, n_hit)]
                columns = [("doc_id", pa.string() if kind == "string" else pa.int64()), *COLUMNS]
                yield pa.record_batch([pa.array(out[c], t) for c, t in columns], names=[c for c, _ in columns])

    return index.mapInArrow(run, HITS.format(kind))


COLUMNS = [("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items", pa.list_(pa.int64())), ("shard", pa.int64()), ("place", pa.int32()), ("runs", pa.list_(pa.int32()))]


def _cut(runs: np.ndarray, begin: int, end: int) -> list[int]:
    a, b = np.maximum(runs[::2], begin), np.minimum(runs[1::2], end)
    keep = a < b
    return np.stack([a[keep] - begin, b[keep] - begin], axis=1).ravel().tolist()


def items_digest(items: Column) -> Column:
    """SHA-256 of the ids, sorted as strings and joined by commas."""
    return F.sha2(F.concat_ws(",", F.array_sort(F.transform(items, lambda i: i.cast("string")))), 256)


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items and runs for each row of docs."""
    index = build_index(docs)
    found = [search(index, block) for block in blocks(items)] or [search(index, None)]
    out = found[0]
    if len(found) > 1:
        out = _added(found)
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        items_digest(F.col("items")).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        "items",
        "runs",
    )


def _added(found: list[DataFrame]) -> DataFrame:
    """What several blocks of queries hit, by document: items and runs united. Documents without a hit are taken from the first block alone."""
    rest = found[0].where("false")
    for f in found[1:]:
        rest = rest.unionByName(f.where("n_hit > 0"))
    every = found[0].unionByName(rest)
    spans = F.transform(F.sequence(F.lit(0), F.size("runs") - 2, F.lit(2)), lambda k: F.struct(F.get("runs", k).alias("a"), F.get("runs", k + 1).alias("b")))
    every = every.withColumn("spans", F.when(F.size("runs") > 0, spans).otherwise(F.array().cast("array<struct<a:int,b:int>>")))
    x = every.groupBy("shard", "place", "doc_id", "n_words").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    n_hit = F.aggregate("spans", start, lambda s, r: F.struct((s["n"] + F.greatest(r["b"] - F.greatest(r["a"], s["end"]), F.lit(0))).alias("n"), F.greatest(s["end"], r["b"]).alias("end")))["n"]
    runs = F.flatten(F.transform("spans", lambda r: F.array(r["a"], r["b"])))
    return x.select("doc_id", "n_words", n_hit.cast("bigint").alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), "items", runs.alias("runs"))


def proximity(index: DataFrame, queries: list[tuple[int, str]], slop: int) -> DataFrame:
    """query, doc_id: indexed documents in which the words of a query stand within slop positions of its rarest word."""
    asked = [(i, words_of(t.encode())) for i, t in queries]
    if sum(len(w) for _, w in asked) > BLOCK_WORDS:
        raise ValueError("ask in blocks of at most BLOCK_WORDS words")
    sent = index.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                s = Shard(row)
                found = [(i, s.ids[d]) for i, words in sent.value for d in s.near(words, slop)]
                yield pa.record_batch([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], names=["query", "doc_id"])

    return index.mapInArrow(run, "query bigint, doc_id bigint")


def clean_only(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs that are not contaminated.

    A row's verdict hangs on its text alone, so texts are indexed under their SHA-256 and rows go or stay by it,
    whatever their id. Contaminated texts grow with the input, so both sides are shuffled at every size.
    """
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    bad = contamination(docs.select(digest.alias("doc_id"), "text"), items).where("contaminated").select(F.col("doc_id").alias("_digest")).distinct()
    x = docs.select(F.struct(*docs.columns).alias("_row"), digest.alias("_of"))
    return x.join(bad, x["_of"] == bad["_digest"], "left_anti").select("_row.*")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items. Null text: no words, clean. Null or repeated ids: a row each. Empty tables: see the module."""
    found = contamination(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


#: The same rows by a join of written-out windows.
OP8_SQL = r"""
WITH item AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(w[i:i + 12], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM item WHERE len(w) > 0)),
doc AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
said AS (SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM doc, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)),
hit AS (SELECT said.r, said.i, said.k, win.item_id FROM said JOIN win ON said.g = win.g AND said.k = win.k),
word AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT r, i, k FROM hit)) GROUP BY r),
of AS (SELECT r, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT r, item_id FROM hit) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN word USING (r) LEFT JOIN of USING (r)
"""
