"""Language by segmentation-marginalised unigrams over the pieces of a fixed public vocabulary.

A word is a run of letters and non-ASCII characters of the lower-cased text, with a space before it. A
language gives each piece a probability; a word's probability is the sum over all ways to cut it into
pieces, from a forward pass over the whole word, however long. Training counts pieces by their expected number
over all segmentations (forward and backward pass, one step from equal probabilities unless more are asked for).
Distinct words of a batch are worked on together: all of them move one byte further at a time, and the pieces
that end there are found by walks down a tree of all pieces, one walk from each earlier byte that is still on it.

Null texts and texts without a letter are `und` with score 0; so is every text if nothing can be learnt.
Rows without language teach nothing; every row gets its result, repeated rows too, and equal texts get equal
ones. An empty table gives an empty result. Very long words are summed in logarithms, as their probabilities
would vanish. Of equal posteriors the first language by name wins. Columns other than doc_id, text and lang are
carried along in a struct, so their names cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

VOCABULARY = "piece_bpe_32k.model"
#: Words of more bytes are summed in logarithms: 1e-8 to this power is still a number.
LINEAR = 32
#: Bytes of distinct words that a lattice holds, unless one word alone has more.
HELD_BYTES = 1 << 20
#: A column with more values than this is no column of languages; the driver holds a number for each of them and each piece.
MOST_LANGUAGES = 2000
#: Weight, in pieces, of the mean over languages in each language's probabilities.
PRIOR = 2000.0
#: The tree's edges lie in a table of 2**SLOTS places.
SLOTS = 19
#: Folds of documents; the first is held out.
FOLDS = 5
#: ASCII other than a-z becomes a space.
LETTERS = bytes(b if b > 127 or 97 <= b <= 122 else 32 for b in range(256))
ASCII_LETTER = re.compile(rb"[a-z]").search
UNKNOWN = "und"


class Pieces:
    """A tree of all pieces, all single bytes among them, as a table of edges. Number 0 stands for no piece."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        found = {bytes([b]) for b in range(256)}
        for i in range(model.get_piece_size()):
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
                found.add(model.id_to_piece(i).replace("▁", " ").encode())
        self.pieces = sorted(found)
        self.n = len(self.pieces) + 1
        edges: dict[int, int] = {}
        number = [0]
        for k, piece in enumerate(self.pieces):
            at = 0
            for byte in piece:
                at = edges.setdefault(at << 8 | byte, len(number))
                if at == len(number):
                    number.append(0)
            number[at] = k + 1
        self.number = np.array(number, np.int32)
        self.edge, self.node = np.full(1 << SLOTS, -1, np.int32), np.zeros(1 << SLOTS, np.int32)
        self.probes = 1
        keys = np.fromiter(edges, np.int32, len(edges))
        for key, slot in zip(keys.tolist(), self.slot(keys).tolist()):
            tries = 1
            while self.edge[slot] >= 0:
                slot, tries = (slot + 1) % (1 << SLOTS), tries + 1
            self.edge[slot], self.node[slot] = key, edges[key]
            self.probes = max(self.probes, tries)

    def slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint32) * np.uint32(0x9E3779B1)) >> np.uint32(32 - SLOTS)).astype(np.int32)

    def step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The node below each node for a byte; 0 where there is none."""
        key = node << np.int32(8) | byte
        at = self.slot(key)
        edge = self.edge.take(at)
        out = np.where(edge == key, self.node.take(at), 0)
        open_ = np.flatnonzero((edge != key) & (edge >= 0))
        for _ in range(1, self.probes):
            if not len(open_):
                break
            here = at[open_] = (at[open_] + 1) % (1 << SLOTS)
            edge = self.edge[here]
            hit = edge == key[open_]
            out[open_[hit]] = self.node[here[hit]]
            open_ = open_[~hit & (edge >= 0)]
        return out


@lru_cache(2)
def pieces(path: str | None = None) -> Pieces:
    return Pieces(path or public_tokenizers.path(VOCABULARY))


class Lattice:
    """All segmentations of distinct words, each with a space before it.

    Words stand in order of length, the longest first, so that those of at least L bytes are the first `count[L]`.
    A cell (L, n, rows, pieces) holds the pieces of n bytes that end behind byte L: within it, every word occurs once.
    log: probabilities are logarithms, for words of any length.
    """

    def __init__(self, words: list[bytes], vocabulary: Pieces, log: bool = False):
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        self.order = np.argsort(-size, kind="stable")
        flat, start = np.frombuffer(b" ".join([b"", *words]), np.uint8), (np.cumsum(size) - size)[self.order]
        size, self.log = size[self.order], log
        self.count = _counts(size)
        self.cells = []
        # Walks that are still in the tree: their word, node and length so far, by length.
        row, node, n = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64)
        for level in range(1, len(self.count) - 1):
            here = self.count[level]
            alive = row < here
            row = np.concatenate([np.arange(here), row[alive]])
            node = np.concatenate([np.zeros(here, np.int32), node[alive]])
            n = np.concatenate([np.ones(here, np.int64), n[alive] + 1])
            node = vocabulary.step(node, flat[start[row] + (level - 1)].astype(np.int32))
            alive = node > 0
            row, node, n = row[alive], node[alive], n[alive]
            piece = vocabulary.number.take(node)
            ends = np.flatnonzero(piece)
            lengths = n[ends]
            cuts = np.flatnonzero(np.diff(lengths)) + 1
            for part in np.split(ends, cuts) if len(ends) else ():
                rows = row[part]
                self.cells.append((level, int(n[part[0]]), slice(0, here) if len(rows) == here else rows, piece[part]))

    def _ends(self, values: list[np.ndarray]) -> np.ndarray:
        """Of values by level, each word's at its end."""
        return np.concatenate([values[level][self.count[level + 1] : self.count[level]] for level in range(len(self.count) - 2, 0, -1)] or [values[0]])

    def _blank(self, p: np.ndarray) -> list[np.ndarray]:
        return [np.full((n, p.shape[1]), -np.inf if self.log else 0.0) for n in self.count[:-1]]

    def forward(self, p: np.ndarray) -> list[np.ndarray]:
        """By level, the probability of all ways to get there. p: by piece number and language, logarithms if log."""
        alpha = self._blank(p)
        alpha[0][:] = 0 if self.log else 1
        for level, n, rows, piece in self.cells:
            if self.log:
                alpha[level][rows] = np.logaddexp(alpha[level][rows], alpha[level - n][rows] + p.take(piece, axis=0))
            else:
                alpha[level][rows] += alpha[level - n][rows] * p.take(piece, axis=0)
        return alpha

    def backward(self, p: np.ndarray) -> list[np.ndarray]:
        beta = self._blank(p)
        for level in range(1, len(beta)):
            beta[level][self.count[level + 1] :] = 0 if self.log else 1
        for level, n, rows, piece in reversed(self.cells):
            if self.log:
                beta[level - n][rows] = np.logaddexp(beta[level - n][rows], beta[level][rows] + p.take(piece, axis=0))
            else:
                beta[level - n][rows] += beta[level][rows] * p.take(piece, axis=0)
        return beta

    def log_probability(self, p: np.ndarray) -> np.ndarray:
        ends = self._ends(self.forward(np.log(p) if self.log else p))
        out = np.empty_like(ends)
        out[self.order] = ends if self.log else np.log(ends)
        return out

    def expected(self, p: np.ndarray, times: np.ndarray, n: int) -> np.ndarray:
        """Expected number of each piece in each language. times: how often each language has each word."""
        p = np.log(p) if self.log else p
        alpha, beta, times = self.forward(p), self.backward(p), times[self.order]
        whole = self._ends(alpha)
        out = np.zeros((n, times.shape[1]))
        share = []
        for level, size, rows, piece in self.cells:
            if self.log:
                share.append(np.exp(alpha[level - size][rows] + p.take(piece, axis=0) + beta[level][rows] - whole[rows]) * times[rows])
            else:
                share.append(alpha[level - size][rows] * p.take(piece, axis=0) * beta[level][rows] / whole[rows] * times[rows])
        if share:
            piece, share = np.concatenate([c[3] for c in self.cells]), np.concatenate(share)
            for g in range(times.shape[1]):
                out[:, g] = np.bincount(piece, share[:, g], n)
        return out


def _counts(size: np.ndarray) -> list[int]:
    """How many of the descending sizes are at least 0, 1, 2 and so on, up to one more than the largest."""
    return np.searchsorted(-size, -np.arange(int(size.max(initial=0)) + 2), "right").tolist()


def lattices(words: list[bytes], vocabulary: Pieces) -> Iterator[tuple[np.ndarray, Lattice]]:
    """Lattices of bounded size over all words, and the numbers of the words that each one holds."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    for long in (False, True):
        at = np.flatnonzero((sizes > LINEAR) == long)
        for part in np.split(at, np.flatnonzero(np.diff(np.cumsum(sizes[at]) // HELD_BYTES)) + 1):
            if len(part):
                yield part, Lattice([words[k] for k in part], vocabulary, long)


def words_of(text: str | None) -> list[bytes] | None:
    """The words of a text; None if it has no letter."""
    if not text:
        return None
    raw = text.lower().encode()
    if not ASCII_LETTER(raw) and not any(map(str.isalpha, text)):
        return None
    return raw.translate(LETTERS).split()


def numbered(texts: list[list[bytes] | None]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words, the number of each word, and the text it stands in."""
    every = [w for t in texts for w in t or ()]
    number = {w: k for k, w in enumerate(dict.fromkeys(every))}
    return list(number), np.fromiter(map(number.__getitem__, every), np.int64, len(every)), np.repeat(np.arange(len(texts)), [len(t or ()) for t in texts])


def learn(docs: DataFrame, steps: int = 1, path: str | None = None) -> tuple[list[str], np.ndarray]:
    """Languages and piece probabilities from the rows of docs(text, lang) that have both.

    Gathers a row for each language and piece, at most MOST_LANGUAGES x 32,000.
    """
    common.bound_batches(docs.sparkSession)
    taught = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    context, model = docs.sparkSession.sparkContext, None
    for _ in range(steps):
        sent = context.broadcast(model)

        def count(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            v, known = pieces(path), sent.value
            sums: dict[str, np.ndarray] = {}
            for batch in batches:
                texts = [words_of(t) for t in batch["text"].to_pylist()]
                langs, names = batch["lang"].to_pylist(), {}
                column = [names.setdefault(x, len(names)) for x in langs]
                words, word, text = numbered(texts)
                if not words:
                    continue
                times = np.zeros((len(words), len(names)))
                np.add.at(times, (word, np.array(column)[text]), 1)
                p = np.full((v.n, 1), 1 / v.n) if known is None else known[1][:, [known[0].index(x) for x in names]]
                found = sum(x.expected(p, times[at], v.n) for at, x in lattices(words, v))
                for name, k in names.items():
                    sums[name] = sums.get(name, 0) + found[:, k]
                if len(sums) > MOST_LANGUAGES:
                    raise ValueError(f"more than {MOST_LANGUAGES} languages")
            for name, x in sums.items():
                at = np.flatnonzero(x)
                yield pa.record_batch([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(x[at])], names=["lang", "piece", "n"])

        rows = taught.select("text", "lang").mapInArrow(count, "lang string, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n"))
        v, rows = pieces(path), rows.toArrow()
        names = sorted(set(rows["lang"].to_pylist()))
        if not names:
            return [], np.zeros((v.n, 0))
        n = np.zeros((v.n, len(names)))
        n[rows["piece"].to_numpy(), np.searchsorted(names, rows["lang"].to_pylist())] = rows["n"].to_numpy()
        mean = (n / np.maximum(n.sum(axis=0), 1e-300)).mean(axis=1, keepdims=True)
        mean = 0.999 * mean + 0.001 / v.n
        model = names, (n + PRIOR * mean) / (n.sum(axis=0) + PRIOR)
    return model


def predicted(text: Column, spark: SparkSession, model: tuple[list[str], np.ndarray], path: str | None = None) -> Column:
    """struct of lang_pred and score, the posterior of that language with equal priors."""
    sent = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def predict(texts: pa.Array) -> pa.Array:
        v, (names, p) = pieces(path), sent.value
        split = [words_of(t) for t in texts.to_pylist()]
        words, word, doc = numbered(split)
        lang, score = [UNKNOWN] * len(split), np.zeros(len(split))
        if words and names:
            known = np.zeros((len(words), len(names)))
            for at, x in lattices(words, v):
                known[at] = x.log_probability(p)
            total = np.stack([np.bincount(doc, known[word, g], len(split)) for g in range(len(names))], axis=1)
            best = total.argmax(axis=1)
            posterior = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
            for k, t in enumerate(split):
                if t:
                    lang[k], score[k] = names[best[k]], posterior[k]
        return pa.StructArray.from_arrays([pa.array(lang), pa.array(score)], ["lang_pred", "score"])

    return predict(text)


def _judged(docs: DataFrame) -> DataFrame:
    """Whole rows of docs as _row, beside _held and _lang; learns from the rows that are not held out."""
    common.bound_batches(docs.sparkSession)
    held = common.fold(F.col("doc_id"), FOLDS) == 0
    model = learn(docs.where(~held))
    return docs.select(F.struct(*docs.columns).alias("_row"), held.alias("_held"), predicted(F.col("text"), docs.sparkSession, model).alias("_lang"))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score for each row of docs."""
    return _judged(docs.select("doc_id", "text", "lang")).select("_row.doc_id", F.col("_held").alias("held_out"), "_lang.lang_pred", "_lang.score")


def sure_only(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of docs whose text has a language with a posterior of at least `least`."""
    return _judged(docs).where((F.col("_lang.lang_pred") != UNKNOWN) & (F.col("_lang.score") >= least)).select("_row.*")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, learnt from the four folds that are not held out. Null text or no letter: `und`, 0. Null or repeated ids: a row each."""
    return identify(common.table(spark, sf_dir, "documents"))
