"""Byte-pair encoding as a streaming transducer with bounded lookahead, and incremental decoding.

For a merge list, the last token of every prefix is unique: it is the token t ending there for which
(last token of the prefix before t, t) is a pair that the merges leave alone. So the encodings of all
prefixes form a tree of parent links. No token is longer than ``lookahead`` bytes, so whatever follows
hangs below one of the last ``lookahead`` positions; once their paths to the root meet, all tokens above
the meeting point are stable and leave the transducer. It holds the bytes since that point and no more.

Null text encodes as empty text (no tokens). The special string is one token, as in the tokenizers library.
Repeated rows are encoded one by one, an empty table gives an empty result, and of very long texts the transducer
holds no more than of short ones; only what it puts out grows. Only doc_id and text are read, so other columns
cannot clash.
"""

from __future__ import annotations

import codecs
import hashlib
import json
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

VOCABULARY = "byte_bpe_50k.json"
#: Pre-tokens up to this many bytes are remembered; longer ones are streamed each time.
SHORT = 64
MEMO = 250_000
NONE = ()
#: The state behind the first so many bytes of a short pre-token is remembered as well.
HEAD = 6
#: Tokens that the decoder turns into text at a time.
BLOCK = 8192


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte: itself if printable Latin-1, else the next letter from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    rest = [b for b in range(256) if b not in letters]
    return letters | {b: chr(256 + k) for k, b in enumerate(rest)}


def laid_out(items: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(x) for x in items], np.int64)
    return np.frombuffer(b"".join(items), np.uint8), np.cumsum(sizes) - sizes, sizes


def gathered(ids: np.ndarray, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> bytes:
    """The items of ids, end to end."""
    n = sizes[ids]
    ends = np.cumsum(n)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[ids] - ends + n, n)].tobytes()


class Merges:
    """A merge list, its tokens as bytes, and its sufficient lookahead."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        of = {letter: b for b, letter in byte_letters().items()}
        special = {x["id"]: x["content"] for x in spec["added_tokens"]}
        self.special = next(iter(special.values()), None)
        self.special_id = next(iter(special), None)
        vocab = spec["model"]["vocab"]
        raw = {w: bytes(of[c] for c in w) for w, i in vocab.items() if i not in special}
        self.size = max([*vocab.values(), *special]) + 1
        self.bytes: list[bytes] = [b""] * self.size
        self.id: dict[bytes, int] = {}
        number = list(range(self.size))  # one int object per id
        for word, b in raw.items():
            self.bytes[vocab[word]] = b
            self.id[b] = number[vocab[word]]
        for i, text in special.items():
            self.bytes[i] = text.encode()
        self.rank: dict[tuple[bytes, bytes], int] = {}
        #: The merge that makes a token.
        self.made: dict[bytes, tuple[bytes, bytes]] = {}
        for k, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[raw[a], raw[b]] = k
            self.made.setdefault(raw[a] + raw[b], (raw[a], raw[b]))
        self.lookahead = max(map(len, self.id))
        ends: dict[bytes, set[int]] = {}
        for b in self.id:
            if len(b) > 2:
                ends.setdefault(b[-3:], set()).add(len(b))
        #: Lengths of the tokens of three bytes and more that end with three given bytes, longest first.
        self.lengths = {end: tuple(sorted(n, reverse=True)) for end, n in ends.items()}
        self.edges = common.Memo(lambda x: self._edge(*x), 100_000)
        self.kept = common.Memo(lambda pair: self._kept(*pair), 200_000)
        # For gathers: each token's bytes, and its number with a comma, end to end.
        self.flat, self.starts, self.sizes = laid_out(self.bytes)
        self.digits, self.digit_starts, self.digit_sizes = laid_out([f"{i},".encode() for i in range(self.size)])

    def _kept(self, a: int, b: int) -> bool:
        """Do the merges, applied to the bytes of a and b, give back a and b? Follows what stands on both sides of the border as ranks go up."""
        left, right, i, j, never = self.edge(a, 1), self.edge(b, 0), 0, 0, len(self.rank)
        while True:
            (x, rx), (y, ry) = left[i], right[j]
            across = self.rank.get((x, y), never)
            if across < rx and across <= ry and across < never:
                return False
            if rx == ry == never:
                return True
            if rx <= ry:
                i += 1
            else:
                j += 1

    def _edge(self, token: int, side: int) -> list[tuple[bytes, int]]:
        """What stands at the left (0) or right (1) end of a token while it is built, each with the rank of the merge that absorbs it."""
        out, at, absorbed = [], self.bytes[token], len(self.rank)
        while True:
            out.append((at, absorbed))
            if len(at) == 1:
                return out[::-1]
            made = self.made[at]
            at, absorbed = made[side], self.rank[made]

    def edge(self, token: int, side: int) -> list[tuple[bytes, int]]:
        return self.edges[token, side]

    def merge(self, text: bytes) -> list[bytes]:
        parts = [text[k : k + 1] for k in range(len(text))]
        while len(parts) > 1:
            ranked = [(r, k) for k, pair in enumerate(zip(parts, parts[1:])) if (r := self.rank.get(pair)) is not None]
            if not ranked:
                break
            _, k = min(ranked)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts


class Transducer:
    """Bytes of one pre-token in, stable token ids out."""

    def __init__(self, merges: Merges):
        self.m = merges
        self.reset()

    def reset(self) -> None:
        #: Bytes since the last stable point; last[i], up[i]: last token of the prefix of i bytes, and where it begins.
        self.held, self.last, self.up, self.before = b"", [None], [0], None

    def resume(self, held: bytes, last: list, up: list) -> None:
        """Go on from where another run over the bytes held was."""
        self.held, self.last, self.up, self.before = held, last.copy(), up.copy(), None

    def push(self, more: bytes) -> list[int]:
        """Take more bytes; return the tokens that have become stable."""
        m, kept, ids, lengths = self.m, self.m.kept, self.m.id.get, self.m.lengths.get
        held, last, up = self.held + more, self.last, self.up
        for i in range(len(self.held) + 1, len(held) + 1):
            for n in lengths(held[i - 3 : i], NONE) if i > 2 else NONE:
                if n <= i and (t := ids(held[i - n : i])) is not None:
                    p = last[i - n] if i > n else self.before
                    if p is None or kept[p, t]:
                        break
            else:
                n = 2
                t = ids(held[i - 2 : i]) if i > 1 else None
                p = last[i - 2] if i > 2 else self.before
                if t is None or p is not None and not kept[p, t]:
                    n, t = 1, ids(held[i - 1 : i])
            last.append(t)
            up.append(i - n)
        self.held = held
        return self._settle() if len(held) > 4 * m.lookahead else []

    def _path(self, at: int) -> list[int]:
        out = []
        while at:
            out.append(self.last[at])
            at = self.up[at]
        return out[::-1]

    def _settle(self) -> list[int]:
        """Emit what all paths that can still be extended share."""
        live = set(range(max(1, len(self.held) + 1 - self.m.lookahead), len(self.held) + 1))
        while len(live) > 1:
            top = max(live)
            live.discard(top)
            live.add(self.up[top])
        at = live.pop()
        if not at:
            return []
        out = self._path(at)
        self.before = out[-1]
        self.held, self.last, self.up = self.held[at:], [None, *self.last[at + 1 :]], [0, *(max(0, k - at) for k in self.up[at + 1 :])]
        return out

    def finish(self) -> list[int]:
        out = self._path(len(self.held))
        self.reset()
        return out


class Encoder:
    """Whole texts to ids. Pre-tokens are encoded by the transducer; short ones and words between single spaces are remembered."""

    def __init__(self, path: str | None = None):
        self.m = Merges(path or public_tokenizers.path(VOCABULARY))
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.spaces = regex.compile(r"\s\s").search
        self.transducer = Transducer(self.m)
        self.short = common.Memo(lambda piece: tuple(self._piece(piece)), MEMO // 5)
        self.words = common.Memo(self._word, MEMO)
        self.heads = common.Memo(self._head, MEMO // 5)

    def _head(self, head: bytes) -> tuple[bytes, list, list]:
        t = Transducer(self.m)
        t.push(head)
        return t.held, t.last, t.up

    def _piece(self, piece: bytes) -> list[int]:
        if len(piece) <= SHORT:
            if len(piece) > HEAD:
                self.transducer.resume(*self.heads[piece[:HEAD]])
                piece = piece[HEAD:]
            self.transducer.push(piece)
            return self.transducer.finish()
        out: list[int] = []
        for k in range(0, len(piece), 256):
            out += self.transducer.push(piece[k : k + 256])
        return out + self.transducer.finish()

    def _word(self, word: str) -> tuple[int, ...]:
        """The ids of a space and a word. The mark behind a letter is a pre-token of its own."""
        if word[-1:] in (".", ",") and word[-2:-1].isalpha():
            return self.words[word[:-1]] + self.short[word[-1:].encode()]
        if word.isalpha():
            piece = f" {word}".encode()
            return tuple(self._piece(piece))
        return self._pieces(f" {word}")

    def _pieces(self, text: str) -> tuple[int, ...]:
        pieces = [p.encode() for p in self.split(text)]
        return tuple(chain.from_iterable(self.short[p] if len(p) <= SHORT else self._piece(p) for p in pieces))

    def _part(self, text: str):
        """Tuples of ids that make up a text without the special string."""
        if not text:
            return ()
        if self.spaces(text):
            return (self._pieces(text),)
        # No two white-space characters meet, so each space opens the pre-token of the word behind it.
        first, *words = text.split(" ")
        if max(map(len, words), default=0) > SHORT:
            return chain((self._pieces(first),), (self._pieces(f" {w}") if len(w) > SHORT else self.words[w] for w in words))
        return chain((self._pieces(first),), map(self.words.__getitem__, words))

    def _tuples(self, text: str | None):
        """Tuples of ids, end to end those of a text."""
        special, parts = self.m.special, []
        for k, part in enumerate((text or "").split(special) if special else [text or ""]):
            if k:
                parts.append(((self.m.special_id,),))
            parts.append(self._part(part))
        return chain.from_iterable(parts)

    def encode(self, text: str | None) -> np.ndarray:
        """int32 ids."""
        return np.fromiter(chain.from_iterable(self._tuples(text)), np.int32)

    def count(self, text: str | None) -> int:
        """How many ids a text has. Those of a word that has been seen are not laid end to end again."""
        return sum(map(len, self._tuples(text)))

    def decode(self, ids: np.ndarray):
        """Text piece by piece: a state machine holds back the bytes of an unfinished character; broken ones become U+FFFD."""
        machine, m = codecs.getincrementaldecoder("utf-8")("replace"), self.m
        for k in range(0, len(ids), BLOCK):
            yield machine.decode(gathered(ids[k : k + BLOCK], m.flat, m.starts, m.sizes))
        yield machine.decode(b"", True)

    def ids_digest(self, ids: np.ndarray) -> str:
        digest, m = hashlib.sha256(), self.m
        for k in range(0, len(ids), BLOCK):
            block = gathered(ids[k : k + BLOCK], m.digits, m.digit_starts, m.digit_sizes)
            digest.update(block if k + BLOCK < len(ids) else block[:-1])
        return digest.hexdigest()

    def text_digest(self, ids: np.ndarray) -> str:
        digest = hashlib.sha256()
        for piece in self.decode(ids):
            digest.update(piece.encode())
        return digest.hexdigest()


@lru_cache(2)
def encoder(path: str | None = None) -> Encoder:
    """One per Python worker and vocabulary; its caches last from task to task."""
    return Encoder(path)


def token_ids(text: Column, path: str | None = None) -> Column:
    """array<int> of the ids of a text column."""

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        encode = encoder(path).encode
        return pa.array([encode(t) for t in texts.to_pylist()], pa.list_(pa.int32()))

    return ids(text)


def token_count(text: Column, path: str | None = None) -> Column:
    """bigint number of ids of a text column."""

    @F.arrow_udf("bigint")
    def count(texts: pa.Array) -> pa.Array:
        return pa.array(list(map(encoder(path).count, texts.to_pylist())), pa.int64())

    return count(text)


def decoded(ids: Column, path: str | None = None) -> Column:
    """The text of an array<int> column; null and empty arrays give empty text."""

    @F.arrow_udf("string")
    def text(rows: pa.Array) -> pa.Array:
        decode = encoder(path).decode
        return pa.array(["".join(decode(np.array(x or [], np.int32))) for x in rows.to_pylist()], pa.string())

    return text(ids)


def digests(text: Column, path: str | None = None, with_ids: bool = False) -> Column:
    """struct of n_tokens, ids_sha256 and decoded_sha256 (of the text decoded from the ids), and the ids if asked for."""
    kind = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    @F.arrow_udf(f"struct<{kind.replace(' bigint', ':bigint').replace(' string', ':string').replace(' array', ':array')}>")
    def digest(texts: pa.Array) -> pa.Array:
        e = encoder(path)
        n, a, b, kept = [], [], [], []
        for t in texts.to_pylist():
            ids = e.encode(t)
            n.append(len(ids))
            a.append(e.ids_digest(ids))
            b.append(e.text_digest(ids))
            if with_ids:
                kept.append(pa.array(ids, pa.int32()))
        arrays = [pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
        names = ["n_tokens", "ids_sha256", "decoded_sha256"]
        if with_ids:
            sizes = [0]
            for x in kept:
                sizes.append(sizes[-1] + len(x))
            arrays.append(pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.concat_arrays(kept) if kept else pa.array([], pa.int32())))
            names.append("ids")
        return pa.StructArray.from_arrays(arrays, names)

    return digest(text)


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row of docs; repeated rows and null ids are kept as they are. One pass, no shuffle."""
    common.bound_batches(docs.sparkSession)
    return docs.select("doc_id", digests(F.col("text"), path).alias("_d")).select("doc_id", "_d.*")


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document. Null text: no tokens, empty text back. Null or repeated ids: a row each. Empty table: no rows."""
    return round_trip(common.table(spark, sf_dir, "documents"))
