"""Exact token counts at every prefix, by dynamic programming over prefixes.

A BPE text splits into chunks that no merge crosses: a run of spaces with what follows up to the next
space, cut further between characters that no piece holds side by side. Within a chunk the encoding of each prefix
ends in one token, the only vocabulary entry that fits behind the encoding of the shorter prefix (two
neighbours fit if encoding their concatenation gives those two back). So count[j] = count[i] + 1 for the
start i of that token: one pass gives the count at every prefix. What each character adds is kept for chunks
in a bounded table per worker and strung together, so the counts at every prefix of a text are one running
sum. They are stored compressed; the count of the whole text, of any prefix, the longest prefix within a
budget and whether a text is over it are look-ups in them, without encoding again.

The model must be a sentencepiece BPE model with byte fallback, a space before the text, no normalisation and
no user-defined pieces, none of which crosses a space; other models raise. Nulls are empty; the empty text
has no tokens. Very long texts and very long chunks are counted whole. Of prefixes that tie in their count the
longest is within a budget. Repeated rows are repeated; ids keep their type; extra columns are ignored. An
empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoor.llm.common import kind, prepare, small, text_of, texts

SPACE = "▁"
#: Chunks kept by a worker; the table starts anew beyond it.
KEPT = 600_000
#: Prefixes of this length are kept with their counts, for other chunks that begin alike.
HEAD = 6
#: Longer chunks are handled the same, only not kept.
LONG = 64


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = number() if key & 7 == 2 else 8 if key & 7 == 1 else 4
            yield key >> 3, data[at : at + size]
            at += size


def check_model(model: bytes) -> None:
    """Raise unless a sentencepiece model is set up as this module needs it. The fields of its format."""
    wrong, parts = [], {1: [], 2: [], 3: []}
    for n, value in _fields(model):
        if n in parts:
            parts[n].append(value)
    trainer, normaliser = (dict(x for part in parts[n] for x in _fields(part)) for n in (2, 3))
    if trainer.get(3, 1) != 2:
        wrong.append("not BPE")
    if not trainer.get(35, 0):
        wrong.append("no byte fallback")
    if trainer.get(24, 0):
        wrong.append("spaces as suffixes")
    if normaliser.get(2, b"") or normaliser.get(4, 1) or not normaliser.get(5, 1):
        wrong.append("texts are normalised")
    if not normaliser.get(3, 1):
        wrong.append("no space before the text")
    if any(dict(_fields(piece)).get(3, 1) == 4 for piece in parts[1]):
        wrong.append("user-defined pieces")
    if wrong:
        raise ValueError(f"a model that prefix counts don't hold for: {', '.join(wrong)}")


class PrefixCounts(dict):
    """Chunk -> what each of its characters adds to the token count, a signed byte each, for a model as check_model() takes."""

    def __init__(self, model_file: str) -> None:
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        lib = self.library
        check_model(lib.serialized_model_proto())
        special = {i for i in range(lib.get_piece_size()) if lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i)}
        self.score = {lib.id_to_piece(i): lib.get_score(i) for i in range(lib.get_piece_size()) if i not in special}
        self.longest = max(map(len, self.score))
        if any(SPACE in p.lstrip(SPACE) for p in self.score) or self.longest > 120:
            raise ValueError("a piece crosses a space, or is too long")
        self.beside = {p[i : i + 2] for p in self.score for i in range(len(p) - 1)}
        self.fits: dict[str, dict[str, bool | str]] = {}
        self.heads: dict[str, tuple] = {}
        self.parts: dict[str, bytes] = {}
        # Pieces that merging never makes, as no pair of pieces makes them up, don't count.
        self.made = {p for p in self.score if len(p) == 1 or self._merge(p) == [p]}
        # Every ending of a piece: True if it is a piece itself.
        self.ending = {p[i:]: False for p in self.made for i in range(len(p))} | dict.fromkeys(self.made, True)

    def _merge(self, text: str) -> list[str]:
        """Merge the best-scored pair, the first of equals, until none is left."""
        parts = list(text)
        while len(parts) > 1:
            best, at = max(((self.score.get(a + b, -np.inf), -i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))), default=(-np.inf, 0))
            if best == -np.inf:
                break
            parts[-at : 2 - at] = [parts[-at] + parts[1 - at]]
        return parts

    def _fit(self, row: dict[str, bool | str], piece: str) -> bool:
        row[piece] = fit = self._merge(row[""] + piece) == [row[""], piece]
        return fit

    def prefix_counts(self, part: str) -> list[int]:
        """count[j]: tokens of the first j characters of a part that split() left whole."""
        count, ending, rows = [0], self.ending, self.fits
        last: list[dict] = [{}]  # what is known to fit behind the last token of each prefix
        head = part[:HEAD]
        if head in self.heads and len(part) > HEAD:
            count, last = map(list, self.heads[head])
        for j in range(len(count), len(part) + 1):
            i = j - 1
            while i >= 0:
                whole = ending.get(piece := part[i:j])
                if whole is None:
                    i = -1
                    break
                if whole:
                    if not i:
                        break
                    fit = last[i].get(piece)
                    if fit or (fit is None and self._fit(last[i], piece)):
                        break
                i -= 1
            if i >= 0:
                count.append(count[i] + 1)
            else:  # a character without a piece is its bytes
                piece = part[j - 1]
                count.append(count[j - 1] + len(piece.encode()))
            row = rows.get(piece)
            if row is None:
                row = rows[piece] = {"": piece}
            last.append(row)
            if j == HEAD:
                if len(self.heads) > KEPT // 4:
                    self.heads.clear()
                self.heads[head] = tuple(count), tuple(last)
        return count

    def split(self, chunk: str) -> list[str]:
        """Cut where no piece holds both neighbours."""
        beside, out, a = self.beside, [], 0
        for i in range(1, len(chunk)):
            if chunk[i - 1 : i + 1] not in beside:
                out.append(chunk[a:i])
                a = i
        out.append(chunk[a:])
        return out

    def __missing__(self, chunk: str) -> bytes:
        out, parts = [], self.parts
        for part in self.split(chunk):
            steps = parts.get(part)
            if steps is None:
                at = self.prefix_counts(part)
                steps = bytes([(after - before) & 255 for before, after in zip(at, at[1:], strict=False)])
                if len(part) <= LONG:
                    parts[part] = steps
            out.append(steps)
        all_steps = b"".join(out)
        if len(self) > KEPT:
            self.clear()
        if len(parts) > KEPT:
            parts.clear()
        if len(chunk) <= LONG:
            self[chunk] = all_steps
        return all_steps

    def chunks(self, text: str) -> list[str]:
        """What to add up: no merge crosses from one to the next."""
        if not text:
            return []
        text = SPACE + text.replace(" ", SPACE)
        if SPACE * 2 in text:
            return re.findall(f"{SPACE}+[^{SPACE}]*", text)
        return [SPACE + x for x in text.split(SPACE)[1:]]

    def steps(self, text: str) -> np.ndarray:
        """What each character of the text adds to the count."""
        if not text:
            return np.zeros(0, np.int8)
        all_steps = np.frombuffer(b"".join(map(self.__getitem__, self.chunks(text))), np.int8)
        out = all_steps[1:].copy()
        out[0] += all_steps[0]  # the first space is not the text's own
        return out

    def every_prefix(self, text: str) -> np.ndarray:
        """Entry j is the token count of text[:j]; entry 0 is 0."""
        return counts(self.steps(text))


def counts(steps: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(steps, dtype=np.int64)])


def stored(steps: np.ndarray) -> bytes:
    """The counts at every prefix, as compressed steps from one to the next."""
    return zlib.compress(steps.tobytes(), 1)


def loaded(data: bytes) -> np.ndarray:
    return counts(np.frombuffer(zlib.decompress(data), np.int8))


def longest_within(counts: np.ndarray, budget: int) -> int:
    """The length of the longest prefix with at most budget tokens."""
    return int(np.flatnonzero(counts <= budget)[-1])


_MODELS: dict[str, PrefixCounts] = {}


def counter(model_file: str) -> PrefixCounts:
    if model_file not in _MODELS:
        _MODELS[model_file] = PrefixCounts(model_file)
    return _MODELS[model_file]


def _count(batches: Iterator[pa.RecordBatch], model: str, limit: int) -> Iterator[pa.RecordBatch]:
    import os

    if not os.path.exists(model):
        import public_tokenizers

        model = public_tokenizers.path(model)
    table = counter(model)
    for b in small(batches):
        found = texts(b, "t")
        rows = []
        for x in found:
            steps = table.steps(x)
            at = counts(steps)
            rows.append((int(at[-1]), len(x) if at[-1] <= limit else longest_within(at, limit), bool(at[-1] > limit), stored(steps)))
        columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.bool_(), pa.binary()))]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(x.encode()) for x in found], pa.int64()), *columns], ["doc_id", "n_bytes", "n_tokens", "within_limit", "over_limit", "prefix_counts"])


def token_counts(docs: DataFrame, model: str = "piece_bpe_32k.model", limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, within_limit, over_limit, prefix_counts: one row per row of docs.

    within_limit: characters of the longest prefix with at most limit tokens; over_limit: the text has more;
    prefix_counts: the counts at every prefix, see loaded(). model: a file, or the name of one of the public
    tokenizers, which each executor looks up itself.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("t"))
    more = {"n_bytes": "long", "n_tokens": "long", "within_limit": "long", "over_limit": "boolean", "prefix_counts": "binary"}
    return rows.mapInArrow(partial(_count, model=model, limit=limit), kind(rows.select("doc_id"), **more))
