"""Exact, title, content, sentence, pair and near duplicates."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T


def survivors(docs: DataFrame, key: Column, order: str = "doc_id") -> DataFrame:
    """docs with duplicate_of: the first row of those with an equal key, null for that row itself and for null keys.

    The first is found by a partial aggregate on keys alone, so texts are not sorted and a hot key is summed before the
    shuffle; the join back is one that adaptive execution can split.
    """
    keyed = docs.withColumn("_key", key)
    first = keyed.where(F.col("_key").isNotNull()).groupBy(F.col("_key").alias("_k")).agg(F.min(order).alias("_first"))
    x = keyed.join(first, F.col("_key") == F.col("_k"), "left")
    return x.withColumn("duplicate_of", F.when(F.col("_first") != F.col(order), F.col("_first"))).drop("_key", "_k", "_first")


def exact(docs: DataFrame) -> DataFrame:
    return survivors(docs, T.content_hash(F.coalesce("text", F.lit(""))))


def by_title(docs: DataFrame) -> DataFrame:
    return survivors(docs, F.nullif(T.normal_title(F.col("title")), F.lit("")))


def by_content(docs: DataFrame, clean: str = "clean_text") -> DataFrame:
    return survivors(docs, T.content_hash(F.col(clean)))


def not_known(new: DataFrame, known: DataFrame, key: Column) -> DataFrame:
    """Rows of new whose key no row of known has. Null keys are kept."""
    have = known.select(key.alias("_have")).where(F.col("_have").isNotNull()).distinct()
    return new.withColumn("_key", key).join(have, F.col("_key") == F.col("_have"), "left_anti").drop("_key")


def insert_new(batch: DataFrame, registry: DataFrame, order: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Rows of batch with new texts, and counts (inserted, duplicate). registry(text_hash) is what is known."""
    hashed = survivors(batch.withColumn("text_hash", F.sha2(F.coalesce("text", F.lit("")), 256)), F.col("text_hash"), order)
    known = registry.select(F.col("text_hash").alias("_known")).distinct()
    x = hashed.join(known, F.col("text_hash") == F.col("_known"), "left").withColumn("_new", F.col("_known").isNull() & F.col("duplicate_of").isNull())
    counts = x.agg(F.count_if("_new").alias("inserted"), F.count_if(~F.col("_new")).alias("duplicate"))
    return x.where("_new").drop("_known", "_new", "duplicate_of"), counts


def pairs(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each combination of keys."""
    return rows.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def copies(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key and representative: the smallest key with an equal vector."""
    first = vectors.groupBy(F.col(vector).alias("_v")).agg(F.min(key).alias("representative"))
    return vectors.join(first, F.col(vector) == F.col("_v")).select(key, "representative")


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def hash_plan(n: int, least: float, recall: float, bucket: int = 32) -> tuple[int, int]:
    """Planes of a table, so that n scattered vectors give buckets of a bounded size, and tables, so that a pair at `least` is missed as rarely as asked."""
    planes = max(2, math.ceil(math.log2(max(n, 1) / bucket))) if n > bucket else 2
    together = (1 - math.acos(least) / math.pi) ** planes
    return planes, max(1, math.ceil(math.log(1 - recall) / math.log(1 - together)))


def cosine_pairs(vectors: DataFrame, least: float, key: str = "vec_id", vector: str = "embedding", recall: float = 0.9999, seed: int = 7) -> DataFrame:
    """a < b and cosine of pairs of distinct vectors that reach `least`.

    Random hyperplanes put vectors into buckets; planes grow with the logarithm of the rows, so buckets do not, and tables
    grow to keep the recall of pairs just at `least`. A pair is compared in the first table that has both in one
    bucket, so nothing is compared or sent on twice; cosines are exact. Equal vectors count as one, under their smallest
    key (copies() tells which), so a large group of them makes no pairs.
    """
    import numpy as np

    vectors = vectors.where(F.col(vector).isNotNull()).groupBy(vector).agg(F.min(key).alias(key))
    n, dims = vectors.agg(F.count("*"), F.coalesce(F.max(F.size(vector)), F.lit(1))).first()
    planes, tables = hash_plan(n, least, recall)
    normals = np.random.default_rng(seed).standard_normal((tables, planes, dims))

    weights = 1 << np.arange(planes)

    @F.arrow_udf("array<int>")
    def buckets(batch: pa.Array) -> pa.Array:
        size = np.diff(batch.offsets.to_numpy())
        flat = batch.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        v = np.zeros((len(batch), dims))
        v[np.arange(dims) < size[:, None]] = np.nan_to_num(flat)
        sides = v @ normals.reshape(tables * planes, dims).T > 0
        return pa.array(list((sides.reshape(len(v), tables, planes) * weights).sum(axis=2).astype(np.int32)), pa.list_(pa.int32()))

    x = vectors.select(key, vector, F.sqrt(_dot(F.col(vector), F.col(vector))).alias("norm"), buckets(F.col(vector)).alias("buckets"))
    x = x.select(key, vector, "norm", "buckets", F.posexplode("buckets").alias("t", "bucket"))
    l, r = x.alias("l"), x.alias("r")
    same = l.join(r, (F.col("l.t") == F.col("r.t")) & (F.col("l.bucket") == F.col("r.bucket")) & (F.col(f"l.{key}") < F.col(f"r.{key}")))
    first = F.array_position(F.zip_with("l.buckets", "r.buckets", lambda a, b: a == b), F.lit(True)) - 1
    cosine = _dot(F.col(f"l.{vector}"), F.col(f"r.{vector}")) / (F.col("l.norm") * F.col("r.norm"))
    return same.where(first == F.col("l.t")).select(F.col(f"l.{key}").alias("a"), F.col(f"r.{key}").alias("b"), cosine.alias("cosine")).where(F.col("cosine") >= least)


def block_plan(n: int, most: int = 4096) -> int:
    """Blocks of n vectors: none much over `most`, and some tasks for small tables."""
    return max(1, math.ceil(n / most), min(8, n // 256))


def all_links(vectors: DataFrame, least: float, key: str = "vec_id", vector: str = "embedding", most: int = 4096) -> DataFrame:
    """_r, n_links, best_cosine of distinct vectors that have others of their size at `least`: every pair is compared, none is missed.

    Vectors are dealt into blocks, and a task sees two blocks at a time and sums up what it finds, so no pair becomes a row and a
    large group of similar vectors costs no more than others. A vector is sent once for each block: work grows with the square of
    the rows, as the links of a wide angle do. As in SQL, a cosine that is no number (of a zero vector, say) exceeds all others, and
    vectors of one key or of none are not compared. Vectors that hold a null have no links.
    """
    import numpy as np

    whole = F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull())
    x = vectors.where(whole).groupBy(F.col(vector).alias("_v")).agg(F.min(key).alias("_r")).where(F.col("_r").isNotNull())
    blocks, slack = block_plan(vectors.count(), most), 1e-12
    x = x.withColumn("_b", F.pmod(F.xxhash64("_v"), F.lit(blocks)).cast("int"))
    cells = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda j: F.struct(F.least(j, F.col("_b")).alias("lo"), F.greatest(j, F.col("_b")).alias("hi")))
    x = x.select("_r", "_v", "_b", F.inline(cells))

    def compare(cell: pa.Table) -> pa.Table:
        n, lists = len(cell), cell["_v"].combine_chunks()
        code = cell["_r"].combine_chunks().dictionary_encode().indices.to_numpy()
        size = np.diff(lists.offsets.to_numpy())
        v = np.zeros((n, max(1, size.max())))
        v[np.arange(v.shape[1]) < size[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
        first = cell["_b"].to_numpy() == (lo := cell["lo"][0].as_py())
        alone = lo == cell["hi"][0].as_py()
        a = np.nonzero(first)[0]
        b = a if alone else np.nonzero(~first)[0]
        links, best = np.zeros(n, np.int64), np.full(n, -np.inf)
        with np.errstate(all="ignore"):
            square = np.einsum("ij,ij->i", v, v)
            unit = v / np.sqrt(square)[:, None]
            other = unit[b].T
            for s in range(0, len(a), 256):
                cosine = unit[a[s : s + 256]] @ other
                i, j = np.nonzero(~(cosine < least - slack))
                c, p, q = cosine[i, j], a[s + i], b[j]
                ok = (code[p] != code[q]) & (size[p] == size[q]) & ((j > s + i) if alone else True)
                c, p, q = c[ok], p[ok], q[ok]
                edge = np.nonzero(np.abs(c - least) <= slack)[0]
                for e in np.array_split(edge, len(edge) // 65536 + 1):
                    c[e] = np.einsum("ij,ij->i", v[p[e]], v[q[e]]) / np.sqrt(square[p[e]] * square[q[e]])
                ok = ~(c < least)
                c, p, q = np.clip(c[ok], -1, 1), p[ok], q[ok]
                for end in (p, q):
                    links += np.bincount(end, minlength=n)
                    np.maximum.at(best, end, c)
        found = np.nonzero(links)[0]
        return pa.table({"_r": cell["_r"].combine_chunks().take(pa.array(found)), "n_links": links[found], "best_cosine": best[found]})

    kind = vectors.schema[key].dataType.simpleString()
    parts = x.groupBy("lo", "hi").applyInArrow(compare, f"_r {kind}, n_links bigint, best_cosine double")
    return parts.groupBy("_r").agg(F.sum("n_links").alias("n_links"), F.max("best_cosine").alias("best_cosine"))


def near(vectors: DataFrame, least: float, key: str = "vec_id", vector: str = "embedding", recall: float | None = None) -> DataFrame:
    """key, representative, n_links, best_cosine for every row with a vector: the smallest key with an equal vector, and the other distinct vectors that reach `least`.

    Every link is found. With a recall, which pays for narrow angles over many rows, links come from cosine_pairs and a link just at `least` is found with that chance.
    """
    if recall is None:
        ends = all_links(vectors, least, key, vector)
    else:
        pairs_ = cosine_pairs(vectors, least, key, vector, recall)
        ends = pairs_.select(F.explode(F.array("a", "b")).alias("_r"), "cosine").groupBy("_r").agg(F.count("*").alias("n_links"), F.max("cosine").alias("best_cosine"))
    x = copies(vectors.where(F.col(vector).isNotNull()), key, vector)
    return x.join(ends, x["representative"] == ends["_r"], "left").select(key, "representative", F.coalesce("n_links", F.lit(0)).alias("n_links"), "best_cosine")
