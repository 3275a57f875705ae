"""Ordinal cumulative-link regression on graded ratings.

P(grade > k) = sigmoid(s - threshold k), with one score s from hashed-text weights shared by all thresholds.
The grades of a labelled text: 0 toxic, 1 of low quality, 2 good. Features are the distinct words of a
text, their beginnings, their shapes (letters, digits and marks in runs) and repeated neighbours, hashed to 2**BITS slots.
The fit is on the SAMPLE labelled rows with the smallest hash of their id: a bounded, documented sample.

Null texts have no features and get the grade of the thresholds alone. Labels without a quality or toxic
value count that value as 1 and 0; several labels of one id: the lowest grade; several texts of a labelled id:
the one with the smallest SHA-256. Without labels all probabilities are one half. Every row gets a result,
repeated rows too; equal texts get equal ones. An empty table of documents gives an empty result. Very long texts
have at most 2**BITS features. Columns other than doc_id, text and the labels' own are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

GRADES = 3
#: A text is kept if it is above the lowest grade with at least this probability.
KEEP = 0.8
SAMPLE = 12000
#: Features that the sample may have in all: rows beyond, in the same order, are left out of the fit.
SAMPLE_FEATURES = 24_000_000
BITS = 18
ROUNDS = 300
#: Slots seen in fewer texts of the sample carry no weight.
LEAST_TEXTS = 4
#: Pull of a weight to zero, in mean log-likelihood: weights that gain less stay zero.
SPARE = 4e-4
#: Bytes of the beginnings of words that are features as well: stems with endings.
STEM = 4
WORD = re.compile(rb"[a-z\x80-\xff]+").findall
UPPER, LOWER, DIGIT = re.compile(rb"[A-Z]+"), re.compile(rb"[a-z\x80-\xff]+"), re.compile(rb"[0-9]+")


def _shape(word: bytes) -> bytes:
    return DIGIT.sub(b"9", LOWER.sub(b"a", UPPER.sub(b"A", word)))[:8]


def features(text: bytes | None, shapes: dict, numbers: dict) -> np.ndarray:
    """The slots of a text, ascending."""
    if not text:
        return np.zeros(0, np.int32)
    tokens = text.split()
    words = dict.fromkeys(WORD(text.lower()))
    found = {b"w" + w for w in words}
    found |= {b"p" + w[:STEM] for w in words if len(w) > STEM}
    found |= {shapes[t] for t in dict.fromkeys(tokens)}
    again = sum(a == b for a, b in zip(tokens, tokens[1:]))
    found.add(b"r%d" % min(9, 10 * again // max(1, len(tokens))))
    return np.unique(np.fromiter(map(numbers.__getitem__, found), np.int32, len(found)))


@lru_cache(1)
def caches() -> tuple[common.Memo, common.Memo]:
    """Bounded, and kept from batch to batch of a worker."""
    return common.Memo(lambda t: b"s" + _shape(t), 50_000), common.Memo(lambda f: zlib.crc32(f) >> (32 - BITS), 100_000)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(rows: list[np.ndarray], grade: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by AdaGrad on the mean log-likelihood of all rows, which start in the majority's order."""
    weights, n = np.zeros(1 << BITS), len(rows)
    if not n:
        return weights, np.zeros(GRADES - 1)
    slot = np.concatenate(rows)
    of = np.repeat(np.arange(n), [len(r) for r in rows])
    often = np.bincount(slot, minlength=1 << BITS) >= LEAST_TEXTS
    slot, of = slot[often[slot]], of[often[slot]]
    used = np.flatnonzero(often)  # all others stay zero
    slot = np.searchsorted(used, slot).astype(np.int32)
    # By text for the scores, by slot for the gradient: sums of neighbours.
    some, text_at = np.unique(of, return_index=True)
    order = np.argsort(slot, kind="stable")
    by_slot, slot_at = of[order].astype(np.int32), np.flatnonzero(np.diff(slot[order], prepend=-1))
    above = np.array([((grade > k).sum() + 1) / (n + 2) for k in range(GRADES - 1)])
    first = -np.log(above[0] / (1 - above[0]))
    gap = np.log(np.maximum(-np.diff(np.log(above / (1 - above))), 0.1))
    w, squares_w, squares_t = np.zeros(len(used)), np.full(len(used), 1e-8), np.full(GRADES - 1, 1e-8)
    for _ in range(ROUNDS):
        t = first + np.concatenate([[0], np.cumsum(np.exp(gap))])
        s = np.zeros(n)
        if len(some):
            s[some] = np.add.reduceat(w.take(slot), text_at)
        over = np.concatenate([np.ones((1, n)), sigmoid(s - t[:, None]), np.zeros((1, n))])  # P(grade >= k)
        a, b = over[grade, np.arange(n)], over[grade + 1, np.arange(n)]
        p = np.maximum(a - b, 1e-12)
        ga, gb = a * (1 - a) / p, b * (1 - b) / p  # of the log-likelihood, by s
        g = (np.add.reduceat((ga - gb).take(by_slot), slot_at) if len(used) else np.zeros(0)) / n
        squares_w += g * g
        rate = 0.3 / np.sqrt(squares_w)
        w = w + rate * g
        w = np.sign(w) * np.maximum(np.abs(w) - rate * SPARE, 0)
        gt = np.array([((grade == k) * gb).sum() - ((grade == k + 1) * ga).sum() for k in range(GRADES - 1)]) / n
        by = np.array([gt.sum(), *(gt[k + 1 :].sum() * np.exp(gap[k]) for k in range(GRADES - 2))])
        squares_t += by * by
        move = 0.1 * by / np.sqrt(squares_t)
        first, gap = first + move[0], gap + move[1:]
    weights[used] = w
    return weights, first + np.concatenate([[0], np.cumsum(np.exp(gap))])


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    common.bound_batches(docs.sparkSession)
    grade = F.when(F.coalesce("toxic", F.lit(0)) > 0, 0).when(F.coalesce("quality", F.lit(1)) <= 0, 1).otherwise(2)
    rated = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.min(grade).alias("grade"))
    rated = rated.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = docs.select("doc_id", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("_sha")).join(F.broadcast(rated), F.col("doc_id") == F.col("_id"))  # at most `sample` rows

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes, numbers = caches()
        for b in batches:
            f = [features(t, shapes, numbers) for t in b["text"].cast(pa.binary()).to_pylist()]
            yield pa.record_batch([b["doc_id"].cast(pa.int64()), b["grade"].cast(pa.int32()), b["_sha"], pa.array(f, pa.list_(pa.int32()))], names=["id", "grade", "sha", "f"])

    # Of equal ids one row goes on; the sums run over the few rows of the sample.
    one = rows.select("doc_id", "text", "_sha", "grade").mapInArrow(of, "id bigint, grade int, sha string, f array<int>").groupBy("id", "grade").agg(F.min_by("f", "sha").alias("f"))
    so_far = F.sum(F.size("f").cast("bigint")).over(W.orderBy(F.xxhash64("id"), "id"))
    got = one.withColumn("so_far", so_far).where(F.col("so_far") <= SAMPLE_FEATURES).select("id", "grade", "f").orderBy("id").toArrow()
    return fit([np.array(x, np.int32) for x in got["f"].to_pylist()], got["grade"].to_numpy().astype(np.int64))


def rated(text: Column, spark: SparkSession, model: tuple[np.ndarray, np.ndarray]) -> Column:
    """struct of expected_grade and the tail probabilities p_at_least_1 and p_at_least_2."""
    sent = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<expected_grade:double,p_at_least_1:double,p_at_least_2:double>")
    def rate(texts: pa.Array) -> pa.Array:
        weights, thresholds = sent.value
        shapes, numbers = caches()
        s = np.array([weights[features(t, shapes, numbers)].sum() for t in texts.cast(pa.binary()).to_pylist()])
        p = sigmoid(s[:, None] - thresholds) if len(s) else np.zeros((0, 2))
        return pa.StructArray.from_arrays([pa.array(p.sum(axis=1)), pa.array(p[:, 0]), pa.array(p[:, 1])], ["expected_grade", "p_at_least_1", "p_at_least_2"])

    return rate(text)


def grade(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, expected_grade, p_at_least_1, p_at_least_2 and kept (above the lowest grade with probability KEEP) for each row of docs."""
    model = learn(docs, labels)
    x = docs.select("doc_id", rated(F.col("text"), docs.sparkSession, model).alias("_g")).select("doc_id", "_g.*")
    return x.withColumn("kept", F.col("p_at_least_1") >= KEEP)


def op7_ordinal_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, by a fit on the labelled ones. Null text: no features. Null or repeated ids: a row each. No labels: one half throughout."""
    return grade(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
