"""SimHash fingerprints, BK-trees over their Hamming distance, and the groups that links make.

Fingerprints that differ in at most three bits agree on one of four blocks of 16 bits, and beside it on one
quarter of the rest. Each distinct fingerprint goes to the shards of its blocks; a shard that many share is
divided by the quarters. A shard's fingerprints become BK-trees: a child hangs below its parent under their Hamming distance,
and a search follows only edges within the radius of the distance just measured. Trees have a bounded number
of nodes, so a shard that is too large gives several, and its fingerprints search each of them in a task of
its own. A task returns a spanning forest of the links it finds, not all pairs; stars made in rounds join
these up. Equal fingerprints are one node throughout, so exact copies cost nothing.

Null and wordless texts have fingerprint zero and link like any other. A null doc_id gets a row; it is never
the id of a component unless all ids in it are null, which makes the component's id null. Repeated rows keep
their number. An empty table gives an empty result. Very long texts are hashed whole, their shingles in blocks.
Operators on whole rows carry them in a struct, so columns with clashing names come through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SHINGLE = 3
SEED = 42
RADIUS = 3
#: Nodes of one tree at most.
TREE = 2048
#: Fingerprints of a shard of 16 bits from which on it is divided into shards of 28 bits.
DIVIDED = 2 * TREE
BLOCK = 1 << 16
#: Pairs of query and node that a search holds at a time.
FRONTIER = 1 << 21


def fingerprint_of(text: bytes | None) -> int:
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - SHINGLE + 1)
    if n == 1:
        return xxhash.xxh64_intdigest(joined, SEED)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes)
    starts, ends = (ends - sizes)[:n].tolist(), (ends - 1)[SHINGLE - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    votes = np.zeros(64, np.int64)
    for k in range(0, n, BLOCK):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[k : k + BLOCK], ends[k : k + BLOCK])], "<u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def fingerprint(text: Column) -> Column:
    """The 64 bits as a signed bigint."""

    @F.arrow_udf("bigint")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint_of(t) for t in texts.cast(pa.binary()).to_pylist()], np.uint64).view(np.int64))

    return of(text)


def hexed(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def shard_keys(fp: Column) -> Column:
    """Keys of which fingerprints within RADIUS share at least one: the four blocks of 16 bits, each with its number above."""
    return F.array(*[F.lit(j << 16).cast("bigint") + F.shiftrightunsigned(fp, 16 * j).bitwiseAND(F.lit(0xFFFF)) for j in range(4)])


def divided_keys(fp: Column, key: Column) -> Column:
    """Finer keys for a key of shard_keys: with a quarter of the other 48 bits. Fingerprints within RADIUS that share the key share one of these."""
    block = lambda j: F.shiftrightunsigned(fp, 16 * j).bitwiseAND(F.lit(0xFFFF))
    rest = F.lit(None).cast("bigint")
    for j in range(4):
        a, b, c = (block(k) for k in range(4) if k != j)
        rest = F.when(F.shiftright(key, 16) == j, F.shiftleft(a, 32).bitwiseOR(F.shiftleft(b, 16)).bitwiseOR(c)).otherwise(rest)
    return F.array(*[F.lit(1 << 40).cast("bigint") + F.shiftleft(key, 14) + F.lit(q << 12).cast("bigint") + F.shiftrightunsigned(rest, 12 * q).bitwiseAND(F.lit(0xFFF)) for q in range(4)])


class Forest:
    """BK-trees of several shards, grown level by level. tree: the shard of each fingerprint, ascending."""

    def __init__(self, fp: np.ndarray, tree: np.ndarray):
        self.fp = fp
        self.trees, first = np.unique(tree, return_index=True)
        self.roots = first
        parent, edge = np.full(len(fp), -1, np.int64), np.zeros(len(fp), np.int64)
        at = np.repeat(first, np.diff(np.append(first, len(fp))))  # the node that each waiting fingerprint stands at
        wait = np.setdiff1d(np.arange(len(fp)), first, assume_unique=True)
        at = at[wait]
        while len(wait):
            d = np.bitwise_count(fp[wait] ^ fp[at]).astype(np.int64)
            slot = at * 65 + d
            order = np.argsort(slot, kind="stable")
            wait, at, d, slot = wait[order], at[order], d[order], slot[order]
            new = np.append(True, slot[1:] != slot[:-1])
            child = wait[new]
            parent[child], edge[child] = at[new], d[new]
            at = np.repeat(child, np.diff(np.append(np.flatnonzero(new), len(wait))))
            wait, at = wait[~new], at[~new]
        below = np.flatnonzero(parent >= 0)
        slots = parent[below] * 65 + edge[below]
        order = np.argsort(slots)
        self.children, self.slots = below[order], slots[order]

    def search(self, fp: np.ndarray, tree: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, node) within radius. tree: the shard that each query searches."""
        where = np.searchsorted(self.trees, tree)
        sizes = np.diff(np.append(self.roots, len(self.fp)))[where]
        cuts = np.cumsum(sizes) // FRONTIER
        for part in np.split(np.arange(len(fp)), np.flatnonzero(np.diff(cuts)) + 1):
            q, node = part, self.roots[where[part]]
            while len(q):
                d = np.bitwise_count(fp[q] ^ self.fp[node]).astype(np.int64)
                hit = d <= radius
                if hit.any():
                    yield q[hit], node[hit]
                lo = np.searchsorted(self.slots, node * 65 + np.maximum(d - radius, 0))
                n = np.searchsorted(self.slots, node * 65 + np.minimum(d + radius, 64), "right") - lo
                q, ends = np.repeat(q, n), np.cumsum(n)
                node = self.children[np.arange(len(q)) + np.repeat(lo - ends + n, n)]


def labels(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """The smallest number linked to each of n numbers, after the links a-b are added to label."""
    label = np.arange(n) if label is None else label
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(label, up := label[label]):
            label = up
    return label


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard in; links of a spanning forest of each shard out. Shards are bounded, so a few are held at a time."""
    held: pa.Table | None = None

    def work(t: pa.Table) -> pa.RecordBatch:
        fp = t["fp"].to_numpy().view(np.uint64)
        shard = np.unique(np.rec.fromarrays([t[c].to_numpy() for c in ("key", "a", "b")]), return_inverse=True)[1]
        grows, asks = t["grows"].to_numpy(zero_copy_only=False), t["asks"].to_numpy(zero_copy_only=False)
        nodes, queries = np.flatnonzero(grows), np.flatnonzero(asks)
        queries = queries[np.isin(shard[queries], shard[nodes])]
        nodes = nodes[np.argsort(shard[nodes], kind="stable")]
        forest, label = Forest(fp[nodes], shard[nodes]), np.arange(len(fp))
        for q, node in forest.search(fp[queries], shard[queries]):
            label = labels(len(fp), queries[q], nodes[node], label)
        linked = np.flatnonzero(label != np.arange(len(fp)))
        return pa.record_batch({"u": pa.array(fp[linked].view(np.int64)), "v": pa.array(fp[label[linked]].view(np.int64))})

    for batch in batches:
        t = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        if not t.num_rows:
            continue
        keys = [t[c].to_numpy() for c in ("key", "a", "b")]
        change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0))
        if len(change) and t.num_rows > 8 * TREE:
            yield work(t.slice(0, cut := int(change[-1]) + 1))
            t = t.slice(cut)
        held = t
    if held is not None and held.num_rows:
        yield work(held)


def links(nodes: DataFrame) -> DataFrame:
    """u, v: links among distinct fingerprints (column fp), enough to join all that are within RADIUS."""
    keyed = nodes.select("fp", F.explode(shard_keys(F.col("fp"))).alias("key"))
    hot = keyed.groupBy(F.col("key").alias("_k")).agg(F.count("*").alias("n")).where(F.col("n") > DIVIDED).select("_k")
    keyed = keyed.join(hot, F.col("key") == F.col("_k"), "left")
    keyed = keyed.select("fp", F.explode(F.when(F.col("_k").isNull(), F.array("key")).otherwise(divided_keys(F.col("fp"), F.col("key")))).alias("key"))
    large = keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > TREE // 2)
    parts = large.select("key", F.ceil(F.col("n") / (TREE // 2)).cast("int").alias("parts"))
    x = keyed.join(parts, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    x = x.withColumn("p", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    x = x.select("fp", "key", "p", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("o"))
    x = x.select("fp", "key", F.least("p", "o").alias("a"), F.greatest("p", "o").alias("b"), (F.col("p") <= F.col("o")).alias("grows"), (F.col("p") >= F.col("o")).alias("asks"))
    x = x.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b")
    return x.mapInArrow(_linked, "u bigint, v bigint")


def stars(edges: DataFrame) -> DataFrame:
    """node, root: each node of edges(u, v) and the smallest node reachable. Alternates two star steps until nothing changes."""

    def step(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        if large:
            both = both.union(both.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
        x = both.join(low, both["u"] == low["c"])
        if large:
            out = x.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = x.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select(F.col("c").alias("u"), F.col("m").alias("v")))
        return out.where(F.col("u") != F.col("v")).distinct()

    def sign(e: DataFrame):
        return e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()

    edges = common.stored(edges.where(F.col("u") != F.col("v")).distinct(), "links")
    was = sign(edges)
    # Each round leaves fewer nodes that are not yet stars, so this ends; the sign (count and xor of hashes) tells when nothing changed.
    while was[0]:
        new = common.stored(step(step(edges, True), False), "stars")
        common.discard(edges)
        edges, now = new, sign(new)
        if now == was:
            break
        was = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def rooted(prints: DataFrame, least: Column) -> DataFrame:
    """fp, least, root: the distinct fingerprints of prints, the smallest value among the rows of each, and the smallest fingerprint of its component."""
    classes = common.stored(prints.groupBy("fp").agg(F.min(least).alias("least")), "classes")
    star = stars(links(classes.select("fp")))
    return classes.join(star, classes["fp"] == star["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint and component_id for each row of docs."""
    common.bound_batches(docs.sparkSession)
    prints = common.stored(docs.select("doc_id", fingerprint(F.col("text")).alias("fp")), "prints")
    found = rooted(prints, F.col("doc_id"))
    named = found.groupBy("root").agg(F.min("least").alias("component_id"))
    found = found.join(named, "root").select("fp", "component_id")
    return prints.join(found, "fp").select("doc_id", hexed(F.col("fp")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of docs for each component: the one with the smallest id, rows without id last; of equal ids the smallest tag.

    The tag tells rows apart whose id is null or repeated: digests of text and other columns, and the id. Rows of one tag
    are copies in one component. Join and choice share one shuffle, as both go by the tag.
    """
    common.bound_batches(docs.sparkSession)
    name, rest = F.col("doc_id").cast("string"), [c for c in docs.columns if c not in ("doc_id", "text")]
    tag = F.concat(F.sha2(F.coalesce("text", F.lit("")), 256), hexed(F.xxhash64(F.lit(0), *rest)), F.coalesce(F.concat(F.lit("+"), name), F.lit("-")))
    prints = common.stored(docs.select(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", tag.alias("tag")).alias("row"), fingerprint(F.col("text")).alias("fp")), "prints")
    kept = rooted(prints, F.col("row")).groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.tag").alias("_tag"))
    x = docs.select(F.struct(*docs.columns).alias("_row"), tag.alias("_tag"))
    return x.join(kept, "_tag", "left_semi").dropDuplicates(["_tag"]).select("_row.*")


def op6_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document. Null text: fingerprint zero. Null or repeated ids: a row each. Empty table: no rows."""
    return groups(common.table(spark, sf_dir, "documents"))
