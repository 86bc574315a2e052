"""Byte-level BPE by a rank queue: encoding that stays fast for pre-tokens of any length, and decoding.

A pattern cuts a text into pre-tokens. One that is a token itself is taken as it is; others start as single
bytes, and the pair of neighbours with the lowest rank merges first, the leftmost of equals. Neighbours are a
linked list in arrays. The queue has a bucket for each rank with the positions of pairs of that rank, and a
bitmap of two levels that says which buckets hold any: find-first-set of the upper word and then of the lower
one gives the next rank. A merge leaves old entries behind; an entry whose position no longer has a pair of
its bucket's rank is stale and skipped. So a pre-token of n bytes takes time in proportion to n, but for
sorting buckets. All pre-tokens of a part of a batch that the worker hasn't seen yet share one queue: no pair
crosses from one to the next, and merges of one keep their order, whatever merges of others come between.
Short pre-tokens are remembered in a table of bounded size.

Nulls are empty; the empty text has no tokens. Very long texts and pre-tokens are encoded whole. Strings of
special tokens in a text are ordinary text. Pairs that tie in rank merge from the left. Repeated rows are
repeated; ids keep their type; extra columns are ignored. An empty table gives an empty result. A rank file
must hold all 256 single bytes, each rank once; others raise.
"""

from __future__ import annotations

import base64
import math
from array import array
from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoor.llm.common import kind, prepare, small, text_of, texts

#: Pre-tokens of at most LONG characters are remembered; the table starts anew before a part that finds over KEPT in it.
KEPT, LONG = 600_000, 48
#: A code point that is no letter, number or space.
MARK = 0x378
#: Code points that the regex module's tables (Unicode 17) take for letters or numbers, and those of the tokenizer's library (Unicode 16 and older) don't.
NEWER = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4),
    (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A),
    (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3),
    (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128),
    (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2),
    (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)


class RankQueue:
    """Positions by rank, the lowest rank first: buckets, and a bitmap of two levels over them."""

    def __init__(self, n_ranks: int) -> None:
        self.width = math.isqrt(max(1, n_ranks - 1)) + 1
        self.buckets: list[list[int]] = [[] for _ in range(n_ranks)]
        self.lower = [0] * self.width
        self.upper = 0

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets[rank]
        if not bucket:
            word, bit = divmod(rank, self.width)
            self.lower[word] |= 1 << bit
            self.upper |= 1 << word
        bucket.append(position)

    def fill(self, ranks: np.ndarray) -> None:
        """Push all positions of an array of ranks that aren't negative."""
        at = np.flatnonzero(ranks >= 0)
        if not len(at):
            return
        at = at[np.argsort(ranks[at], kind="stable")]
        of = ranks[at]
        ends = np.append(np.flatnonzero(of[1:] != of[:-1]) + 1, len(of))
        a = 0
        for rank, e in zip(of[ends - 1].tolist(), ends.tolist(), strict=True):
            word, bit = divmod(rank, self.width)
            self.lower[word] |= 1 << bit
            self.upper |= 1 << word
            self.buckets[rank] += at[a:e].tolist()
            a = e

    def pop(self) -> tuple[int, list[int]]:
        """The lowest rank and its positions in order; rank -1 if there is none."""
        if not self.upper:
            return -1, []
        word = (self.upper & -self.upper).bit_length() - 1
        bits = self.lower[word]
        bit = (bits & -bits).bit_length() - 1
        bits &= bits - 1
        self.lower[word] = bits
        if not bits:
            self.upper ^= 1 << word
        rank = word * self.width + bit
        bucket, self.buckets[rank] = self.buckets[rank], []
        bucket.sort()
        return rank, bucket


class Codec:
    """Encodes and decodes by a rank file and the pattern that cuts texts before merging.

    others: ranges of code points that the pattern is to take for marks, whatever this library's tables say.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, others: Sequence[tuple[int, int]] = ()) -> None:
        import regex

        self.pattern = regex.compile(pattern)
        self.others = {c: MARK for a, b in others for c in range(a, b + 1)}
        self.from_here = chr(min(self.others, default=0x10FFFF))
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.bytes_of: list[bytes] = [b""] * self.size
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        singles = [ranks.get(bytes([b]), -1) for b in range(256)]
        if min(singles) < 0 or len(set(ranks.values())) < len(ranks):
            raise ValueError("a rank file must hold every byte, and each rank once")
        self.single = np.array([*singles, self.size], np.int64)  # the last stands between pre-tokens
        #: behind[left][right] and ahead[right][left]: the rank of both tokens together.
        none: dict[int, int] = {}
        self.behind: list[dict[int, int]] = [none] * self.size
        self.ahead: list[dict[int, int]] = [none] * self.size
        self.first = np.full((257, 257), -1, np.int64)  # the same for single bytes
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    for table, at, of in ((self.behind, left, right), (self.ahead, right, left)):
                        if table[at] is none:
                            table[at] = {}
                        table[at][of] = rank
            if len(token) == 2:
                self.first[token[0], token[1]] = rank
        self.queue = RankQueue(self.size)
        self.known: dict[str, bytes] = {}

    def cut(self, text: str) -> list[str]:
        """The pre-tokens of a text."""
        if text.isascii() or not self.others or max(text) < self.from_here:
            return self.pattern.findall(text)
        return [text[slice(*m.span())] for m in self.pattern.finditer(text.translate(self.others))]

    def merged(self, parts: Sequence[bytes]) -> list[array]:
        """The tokens of each part by merging, all parts in one queue; none is empty."""
        n = sum(map(len, parts)) + len(parts) + 1
        data = np.full(n, 256, np.int64)  # 256 stands before, between and behind the parts: no pair holds it
        starts = np.cumsum([1, *(len(p) + 1 for p in parts)])
        is_byte = np.ones(n, bool)
        is_byte[starts - 1] = False
        data[is_byte] = np.frombuffer(b"".join(parts), np.uint8)
        ranks = np.full(n, -1, np.int64)
        ranks[:-1] = self.first[data[:-1], data[1:]]
        queue = self.queue
        queue.fill(ranks)
        token, rank_of = self.single[data].tolist(), ranks.tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        buckets, push = queue.buckets, queue.push
        while True:
            rank, positions = queue.pop()
            if rank < 0:
                break
            behind, ahead = self.behind[rank].get, self.ahead[rank].get
            for i, p in enumerate(positions):
                if rank_of[p] != rank:
                    continue  # stale
                q = after[p]
                token[p] = rank
                rank_of[q] = -1
                after[p] = r = after[q]
                before[r] = p
                rank_of[p] = one = behind(token[r], -1)
                b = before[p]
                rank_of[b] = two = ahead(token[b], -1)
                if one >= 0:
                    if buckets[one]:
                        buckets[one].append(p)
                    else:
                        push(one, p)
                if two >= 0:
                    if buckets[two]:
                        buckets[two].append(b)
                    else:
                        push(two, b)
                if 0 <= one < rank or 0 <= two < rank:  # a lower rank has come up: it is next
                    for rest in positions[i + 1 :]:
                        push(rank, rest)
                    break
        out = []
        for p in starts[:-1].tolist():
            ids = array("I")
            while (t := token[p]) < self.size:
                ids.append(t)
                p = after[p]
            out.append(ids)
        return out

    def learn(self, chunks: set[str]) -> None:
        """Add pre-tokens to the table of known ones."""
        parts = {c: c.encode() for c in chunks}
        for c, data in parts.items():
            if (rank := self.ranks.get(data)) is not None:
                self.known[c] = array("I", [rank]).tobytes()
        rest = [c for c in chunks if c not in self.known]
        for c, ids in zip(rest, self.merged([parts[c] for c in rest]), strict=True):
            self.known[c] = ids.tobytes()

    def encode_all(self, found: list[str]) -> list[np.ndarray]:
        """The token ids of each text."""
        if len(self.known) > KEPT:
            self.known.clear()
        cut = [self.cut(t) for t in found]
        unseen = set().union(*cut).difference(self.known)
        self.learn(unseen)
        out = [np.frombuffer(b"".join(map(self.known.__getitem__, chunks)), np.uint32) for chunks in cut]
        for c in unseen:
            if len(c) > LONG:
                del self.known[c]
        return out

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decode(self, ids: Sequence[int]) -> bytes:
        """The bytes of tokens; ids that no token has raise."""
        if ids and not 0 <= min(ids) <= max(ids) < self.size:
            raise ValueError("an id without a token")
        return b"".join(map(self.bytes_of.__getitem__, ids))


def read_ranks(path: str) -> dict[bytes, int]:
    """Token -> rank of a file with a base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


_CODECS: dict[tuple[str, str | None], Codec] = {}


def codec(ranks: str, pattern: str | None = None) -> Codec:
    """The codec of a rank file, or of one of the public tokenizers by name, made once in a worker. pattern: theirs, if none is given."""
    import os

    if (ranks, pattern) not in _CODECS:
        path, cut = ranks, pattern
        if cut is None or not os.path.exists(ranks):
            import public_tokenizers

            path, cut = path if os.path.exists(ranks) else public_tokenizers.path(ranks), cut or public_tokenizers.PATTERN
        _CODECS[ranks, pattern] = Codec(read_ranks(path), cut, NEWER)
    return _CODECS[ranks, pattern]


def _encode(batches: Iterator[pa.RecordBatch], ranks: str, pattern: str | None, back: bool) -> Iterator[pa.RecordBatch]:
    use = codec(ranks, pattern)
    for b in small(batches):
        ids = use.encode_all(texts(b, "t"))
        ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
        flat = np.concatenate([*ids, np.zeros(0, np.uint32)]).astype(np.int32)
        columns = {"doc_id": b.column("doc_id"), "ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))}
        if back:
            columns["data"] = pa.array([use.decode(x.tolist()) for x in ids], pa.binary())
        yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _decode(batches: Iterator[pa.RecordBatch], ranks: str, pattern: str | None) -> Iterator[pa.RecordBatch]:
    use = codec(ranks, pattern)
    for b in batches:
        data = pa.array([None if ids is None else use.decode(ids) for ids in b.column("ids").to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([*b.columns, data], [*b.schema.names, "data"])


def encoded(docs: DataFrame, ranks: str, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", back: bool = False) -> DataFrame:
    """doc_id, ids (array<int>): the tokens of each row's text. ranks, pattern: see codec().

    back: with data (binary), what decoding the tokens gives, in the same pass.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("t"))
    more = {"ids": "array<int>", "data": "binary"} if back else {"ids": "array<int>"}
    return rows.mapInArrow(partial(_encode, ranks=ranks, pattern=pattern, back=back), kind(rows.select("doc_id"), **more))


def decoded(rows: DataFrame, ranks: str, pattern: str | None = None) -> DataFrame:
    """rows (ids, ...) with data (binary): the bytes that the tokens stand for; null ids give null. An id without a token raises."""
    prepare(rows.sparkSession)
    return rows.mapInArrow(partial(_decode, ranks=ranks, pattern=pattern), kind(rows, data="binary"))
