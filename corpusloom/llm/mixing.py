"""Language-model scores by online logistic context mixing.

A text is coded as its lower-cased words, a space behind each, and a newline as its end. Each byte is a
path of bits in a Huffman tree that belongs to the byte before it, so likely bytes cost few decisions.
Predictors of the next bit are counts of that bit in training, found by hashes of the tree's node, which knows the
byte before, and a context: the 3 and the 5 bytes before within the word, the whole word so far,
and of the last common word of the text together with the 3 bytes before. The last one reaches over the border
of the word: it tells language and phrase. Log-odds are added with weights that a gate picks, the gate
being how often the longest contexts have been seen. The weights begin a text with fixed values and are refined
after each bit by the coding error, over the whole text. A text has weights of its own, so that its score depends
neither on partitions nor on other texts. The coder itself and all that counts texts and words is in mixer.py.

Training needs each distinct word only once, with its count, and each distinct run of four bytes with its common
word; those counts come from all training rows by shuffles. Tables of slots grow with the number of distinct words
up to 2**MOST_BITS slots of a byte, which bounds what is broadcast; in a table that is more than half full, a context
counts as seen only as far as it stands out from the middle slot. The base score needs exact counts of all words:
frequent ones, HEAD at most, are broadcast, and the rest of a text's words meet their counts in a shuffled join.

Null and empty texts are the end token alone. Repeated rows and null ids are scored one by one. Very long texts
are coded from end to end with a few weights and one word held. Without training rows all counts are zero and every prediction is
open; an empty table gives an empty result. Only doc_id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, mixer

FOLDS, HELD = 7, 2
#: Words whose counts are broadcast.
HEAD = 1 << 17
#: The most frequent words, the last of which is a context; a rank fits into seven bits.
COMMON = 64
#: Distinct words, and distinct runs of bytes, that a task counts before it passes them on.
FLUSH = 400_000
LEAST_BITS, MOST_BITS, RUN_BITS = 16, 24, 22
CHUNK = 16
ORDERS = (3, 5, 0)  # bytes before; 0: the whole word so far
RATE = 0.005
SPACE, END = 32, 10
#: Log-odds in steps of a quarter, and two bits for how often the context has been seen.
STEP, MIDDLE = 0.25, 31
#: Initial weights of the predictors (3, 5 bytes, word, common word) by gate: the common word's context new, seen once, 2 to 15
#: times, more often, and within each: five bytes new, seen once, seen more, word so far seen 16 times. Fitted, like RATE, on folds 0 and 1
#: of FOLDS by a model of folds 3 to 6; the held-out fold took no part.
START = np.array(
    [
        [0.49, -0.05, 0.03, 0.04],
        [0.38, 0.15, 0.13, -0.1],
        [0.63, 0.17, 0.02, -0.07],
        [0.45, 0.21, 0.18, -0.02],
        [0.29, 0.06, 0.07, 0.2],
        [0.6, 0.2, 0, 0.1],
        [0.52, 0.25, 0.12, 0.27],
        [0.39, 0.25, 0.19, 0.18],
        [0.6, 0.22, 0.02, 0.22],
        [0.76, 0.23, 0.16, 0.2],
        [0.59, 0.36, 0.16, 0.26],
        [0.36, 0.38, 0.16, 0.23],
        [0.55, -0.01, 0.05, 0.19],
        [0.69, 0.4, 0.01, 0.35],
        [0.37, 0.47, 0.21, 0.47],
        [-0.06, 0.34, 0.25, 0.65],
    ],
    np.float32,
)


def tokens_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


# -- counts -------------------------------------------------------------------------------------------------


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n over all rows of docs, stored in the shared folder."""
    return common.stored(mixer.words_in(docs.select("text"), FLUSH).groupBy("word").agg(F.sum("n").alias("n")), "words")


def frequent(words: DataFrame, most: int = HEAD) -> dict[bytes, int]:
    """All words seen at least 2**k times, for the least k that leaves at most `most`."""
    level = F.length(F.bin("n")) - 1
    rows = words.groupBy(level.alias("k")).agg(F.count("*").alias("words")).collect()
    total, least = 0, 64
    for k, n in sorted(((r["k"], r["words"]) for r in rows), reverse=True):
        if total + n > most:
            break
        total, least = total + n, k
    got = words.where(level >= least).toArrow()
    return dict(zip(got["word"].to_pylist(), got["n"].to_pylist()))


def common_words(words: DataFrame) -> dict[bytes, int]:
    """The most frequent words and their ranks from 1 on; of equal counts the smaller word."""
    rows = words.orderBy(F.desc("n"), "word").limit(COMMON).collect()
    return {bytes(r["word"]): k + 1 for k, r in enumerate(rows)}


def run_counts(docs: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """key, n of all runs of bytes in docs beside their common words, stored in the shared folder."""
    return common.stored(mixer.runs_in(docs.select("text"), ranks, 4 * FLUSH).groupBy("key").agg(F.sum("n").alias("n")), "runs")


# -- trees -----------------------------------------------------------------------------------------------------


class Trees:
    """A Huffman tree of all 256 bytes for each byte before, from counts of pairs."""

    def __init__(self, pairs: np.ndarray):
        paths: list[tuple[list[int], list[int]]] = []
        for before, row in enumerate(pairs.reshape(256, 256).astype(np.int64) + 1):
            heap: list[tuple[int, int]] = [(int(n), s) for s, n in enumerate(row)]
            heapq.heapify(heap)
            up = np.zeros(511, np.int64)
            side = np.zeros(511, np.int8)
            weight = {s: n for n, s in heap}
            for inner in range(256, 511):
                (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
                up[x], up[y], side[y] = inner, inner, 1
                weight[inner] = a + b
                heapq.heappush(heap, (a + b, inner))
            for s in range(256):
                nodes, bits, at = [], [], s
                while at != 510:
                    bits.append(int(side[at]))
                    at = int(up[at])
                    nodes.append(before << 8 | at - 256)
                paths.append((nodes[::-1], bits[::-1]))
        self.size = np.array([len(n) for n, _ in paths], np.int32)
        self.start = np.cumsum(self.size, dtype=np.int32) - self.size
        self.nodes = np.concatenate([n for n, _ in paths]).astype(np.uint32)
        self.bits = np.concatenate([b for _, b in paths]).astype(np.int8)


def pair_counts(words: DataFrame) -> np.ndarray:
    """How often each byte follows each other one: 65,536 sums. A null word is the end of a text."""
    rows = mixer.pairs_in(words).groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(65536, np.int64)
    out[rows["pair"].to_numpy()] = rows["n"].to_numpy()
    return out


# -- tables -------------------------------------------------------------------------------------------------


def coded(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Counts as a byte: log-odds in STEPs, and 0, 1, 2 to 15, more for how often the context was seen beyond the middle slot."""
    n = zero + one
    odds = np.clip(np.rint(np.log((one + 0.4) / (zero + 0.4)) / STEP), -MIDDLE, MIDDLE) + MIDDLE
    return (odds.astype(np.uint8) << 2) | np.digitize(n - np.sort(n)[len(n) // 2], (1, 2, 16)).astype(np.uint8)


def table(rows: DataFrame, order: int, trees, bits: int) -> np.ndarray:
    """A hashed predictor as bytes, from words or, if order is -1, runs. trees: sent. Partial sums of slot ranges meet in as many tasks as there are ranges; all sums are whole numbers."""
    chunk = min(CHUNK, bits)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, x in zip(batch["part"].to_pylist(), batch["sums"].to_pylist()):
                raw = np.frombuffer(pa.decompress(x, 16 << chunk, codec="zstd", asbytes=True), np.int64)
                sums[part] = sums[part] + raw if part in sums else raw
        for part, s in sums.items():
            yield pa.record_batch([pa.array([part], pa.int32()), pa.array([coded(s[::2], s[1::2]).tobytes()], pa.binary())], names=["part", "codes"])

    out = np.full(1 << bits, MIDDLE << 2, np.uint8)
    found = mixer.slots_in(rows, trees, order, bits, chunk).repartition("part").mapInArrow(whole, "part int, codes binary").toArrow()
    for part, codes in zip(found["part"].to_pylist(), found["codes"].to_pylist()):
        at = part << chunk
        out[at : at + (1 << chunk)] = np.frombuffer(codes, np.uint8)
    return out


def bits_for(n: int) -> int:
    """Slots for contexts of n distinct words, as a power of two."""
    return min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(2 * n + 1))))


# -- scoring ------------------------------------------------------------------------------------------------


def learn(rows: DataFrame) -> tuple[DataFrame, int, dict[bytes, int], Trees, list[np.ndarray]]:
    """What the texts of rows teach: word counts, ends, ranks of common words, trees and tables."""
    spark, words, ends = rows.sparkSession, word_counts(rows), rows.count()
    ranks = common_words(words)
    # The ends of texts are a null word.
    said = words.unionByName(spark.range(0, 1 if ends else 0, 1, 1).select(F.lit(None).cast("binary").alias("word"), F.lit(ends).alias("n")))
    trees = Trees(pair_counts(said))
    sent, bits = mixer.sent(spark, mixer.packed_trees(trees)), bits_for(words.count())
    tables = [table(said, o, sent, bits) for o in ORDERS]
    runs = run_counts(rows, ranks)
    tables.append(table(runs, -1, sent, min(bits, RUN_BITS)))
    common.discard(runs)
    return words, ends, ranks, trees, tables


def scores(docs: DataFrame, held=None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte for each row of docs."""
    spark = docs.sparkSession
    common.bound_batches(spark)
    held = common.fold(F.col("doc_id"), FOLDS) == HELD if held is None else held
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", held.alias("held_out"))
    words, ends, ranks, trees, tables = learn(rows.where(~F.col("held_out")))
    n, v = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    n, v = n + ends, v + (ends > 0)
    head = {w: float(np.log10(c + 1)) for w, c in frequent(words).items()}
    code = mixer.scorer(spark, mixer.packed(START, RATE, STEP, MIDDLE, trees, ranks, tables, head))
    found = common.stored(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", code(F.col("text")).alias("s")), "scored")
    found = found.select("row", "doc_id", "held_out", "s.*")
    rare = found.select("row", F.explode("rare").alias("w"))
    rare = rare.join(words, rare["w"] == words["word"], "left")
    rare = rare.groupBy("row").agg(F.sum(F.when(F.col("n") > 0, F.log10(F.col("n") + 1)).otherwise(0.0)).alias("rare_log"), F.count("n").alias("rare_known"))
    x = found.drop("rare").join(rare.withColumnRenamed("row", "r"), F.col("row") == F.col("r"), "left")
    logs = F.col("head_log") + F.coalesce("rare_log", F.lit(0.0)) + F.lit(float(np.log10(ends + 1)))
    return x.select(
        "doc_id",
        "held_out",
        (F.col("n_words") + 1).alias("n_tokens"),
        (F.col("n_head") + F.coalesce("rare_known", F.lit(0)) + int(ends > 0)).alias("n_known"),
        F.lit(n).cast("bigint").alias("train_tokens"),
        (logs - (F.col("n_words") + 1) * float(np.log10(n + v + 1))).alias("base_score"),
        (F.col("log") / float(np.log(10))).alias("score"),
        (-F.col("log") / float(np.log(2)) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )


def op10_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, learnt from the folds that are not held out. Null or empty text: the end token alone. Null or repeated ids: a row each."""
    return scores(common.table(spark, sf_dir, "documents"))
