"""Quality classifier: naive Bayes support vectors.

A text's n-gram indicators (words, word pairs, word shapes, pairs of shapes, and how much of the text each
shape and immediate repetition take, in steps) are scaled by the log-count ratios of the classes; a linear
hinge-loss model is fitted by dual coordinate descent, and its margin becomes a score by a logistic curve
fitted to margins of folds left out. It is fitted on at most max_train labelled documents, those with the
lowest hashes of their ids; scoring reads every whole text.

Nulls and texts without words have no n-grams and get the score of the intercept. Very long texts and words
are read whole, in time in proportion to their length. Labels without an id or a label, and labels of no
document, are ignored; of repeated labels of an id the largest counts, and of repeated documents of an id one
text (that of the smallest hash) is fitted on. Ids that tie in their hash go by the id. With labels of one
class or none the score is the smoothed share of label 1; a score that ties with the threshold counts as
above. Repeated rows are repeated; ids keep their type; extra columns are ignored by judged() and kept by
keep_good(). An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoor.llm.common import kind, prepare, raw, small, text_of

#: At most so many labelled documents are fitted on.
MAX_TRAIN = 8_000
BITS = 18
KEPT = 300_000
EPOCHS = 25
#: Bytes of text whose indicators are looked up together: each takes some 40 bytes for a moment.
PART = 1 << 18
C = 1.0
_WORD, _SHAPE, _PAIR, _SHAPES, _PART = (x << 40 for x in range(1, 6))
_MIX = np.uint64(0x9E3779B97F4A7C15)

#: Character class by byte: lower, upper, digit, other ASCII by itself, rest.
_CLASS = bytes(ord("a") if 97 <= i <= 122 or i >= 128 else ord("A") if 65 <= i <= 90 else ord("0") if 48 <= i <= 57 else i for i in range(256))


_RUNS = re.compile(rb"(.)\1{2,}", re.S)


def shape(word: bytes) -> bytes:
    """Of the whole word: runs of lower case, upper case, digits and each other character, a run as one or, if longer, two."""
    return _RUNS.sub(rb"\1\1", word.translate(_CLASS))


class _Words(dict):
    """Word -> its hash and its shape's, in one number."""

    def __missing__(self, word: bytes) -> int:
        x = (xxhash.xxh32_intdigest(word.lower()) & 0x7FFFFFFF) << 16 | xxhash.xxh32_intdigest(shape(word)) & 0xFFFF
        if len(word) <= 64:
            if len(self) > KEPT:
                self.clear()
            self[word] = x
        return x


_WORDS = _Words()


def _hashed(x: np.ndarray) -> np.ndarray:
    return ((x.astype(np.uint64) * _MIX) >> np.uint64(64 - BITS)).astype(np.int32)


def features(data: bytes) -> np.ndarray:
    """The distinct indicators of a text, hashed to BITS bits."""
    found = data.split()
    if not found:
        return np.zeros(0, np.int32)
    both = np.fromiter(map(_WORDS.__getitem__, found), np.int64, len(found))
    word, form = both >> 16, both & 0xFFFF
    n = len(found)
    out = [word + _WORD, form + _SHAPE]
    kinds, counts = np.unique(form, return_counts=True)
    part = np.floor(-2 * np.log2(counts / n)).astype(np.int64)
    out.append(_PART + kinds * 64 + np.minimum(part, 63))
    if n > 1:
        out += [_PAIR + ((word[:-1] * 31 + word[1:]) & ((1 << 40) - 1)), _SHAPES + form[:-1] * 65536 + form[1:]]
        again = np.count_nonzero(word[:-1] == word[1:]) / (n - 1)
        out.append(np.array([_PART + (1 << 30) + (0 if not again else 1 + int(-2 * np.log2(again)))]))
    hashed = np.sort(_hashed(np.concatenate(out)))
    return hashed[np.concatenate([[True], hashed[1:] != hashed[:-1]])]


def fit_hinge(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, c: float = C, epochs: int = EPOCHS, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and intercept of an L2-regularised hinge loss, by dual coordinate descent (Hsieh et al., 2008).

    rows: indicator lists; each document's scaled indicators have length 1. Classes weigh the same.
    """
    w, bias = np.zeros(len(scale)), 0.0
    values = [scale[r] / max(np.linalg.norm(scale[r]), 1e-9) for r in rows]
    cost = np.where(y > 0, c * len(y) / (2 * max(1, (y > 0).sum())), c * len(y) / (2 * max(1, (y < 0).sum())))
    alpha, rng = np.zeros(len(y)), np.random.default_rng(seed)
    square = np.array([v @ v + 1.0 for v in values])
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)):
            g = y[i] * (w[rows[i]] @ values[i] + bias) - 1
            new = min(max(alpha[i] - g / square[i], 0.0), cost[i])
            if new != alpha[i]:
                d = (new - alpha[i]) * y[i]
                w[rows[i]] += d * values[i]
                bias += d
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w, float(bias)


def ratios(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Log-count ratio of each indicator between the classes, smoothed by one."""
    good, bad = (np.ones(1 << BITS) for _ in range(2))
    for r, label in zip(rows, y, strict=True):
        (good if label > 0 else bad)[r] += 1
    return np.log(good / good.sum()) - np.log(bad / bad.sum())


def _margin(row: np.ndarray, w: np.ndarray, scale: np.ndarray, bias: float) -> float:
    v = scale[row]
    return float(w[row] @ v / max(np.linalg.norm(v), 1e-9)) + bias


def fit_logistic(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """a, b of 1 / (1 + exp(-(a m + b))), with Platt's smoothed targets."""
    t = np.where(y > 0, ((y > 0).sum() + 1) / ((y > 0).sum() + 2), 1 / ((y < 0).sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        g, h = p - t, p * (1 - p) + 1e-12
        grad = np.array([g @ m, g.sum()])
        hess = np.array([[h @ (m * m) + 1e-6, h @ m], [h @ m, h.sum() + 1e-6]])
        da, db = np.linalg.solve(hess, grad)
        a, b = a - da, b - db
        if abs(da) + abs(db) < 1e-9:
            break
    return float(a), float(b)


def train(rows: list[np.ndarray], labels: np.ndarray) -> dict:
    """weights (already scaled by the ratios), scale, bias, a, b."""
    y = np.where(labels > 0, 1.0, -1.0)
    if len(set(y)) < 2:
        p = ((y > 0).sum() + 1) / (len(y) + 2)
        return {"w": np.zeros(1 << BITS), "scale": np.zeros(1 << BITS), "bias": 0.0, "a": 1.0, "b": float(np.log(p / (1 - p)))}
    fold, margins = np.arange(len(y)) % 3, np.zeros(len(y))
    for k in range(3):
        inside = np.flatnonzero(fold != k)
        if len(set(y[inside])) < 2:
            inside = np.arange(len(y))
        scale = ratios([rows[i] for i in inside], y[inside])
        w, bias = fit_hinge([rows[i] for i in inside], y[inside], scale)
        for i in np.flatnonzero(fold == k):
            margins[i] = _margin(rows[i], w, scale, bias)
    a, b = fit_logistic(margins, y)
    scale = ratios(rows, y)
    w, bias = fit_hinge(rows, y, scale)
    return {"w": w, "scale": scale, "bias": bias, "a": a, "b": b}


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = pa.array([features(x) for x in raw(b, "t")], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), found], ["id", "label", "features"])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train: int = MAX_TRAIN) -> dict:
    """Fit on labelled documents that aren't held out. The hash order makes the bounded sample repeatable."""
    prepare(docs.sparkSession)
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter("id is not null and label is not null")
    marks = marks.filter(~held_out(F.col("id"))).groupBy("id").agg(F.max("label").alias("label"))
    there = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("t")).filter("id is not null")
    # The documents that labels are for are few; of these, one text an id, and at most max_train ids.
    chosen = marks.orderBy(F.xxhash64("id"), "id").limit(max_train)
    texts = there.join(F.broadcast(chosen), "id").withColumn("h", F.xxhash64("t"))
    got = texts.groupBy("id", "label").agg(F.min_by("t", "h").alias("t")).mapInArrow(_features, kind(chosen, features="array<int>")).toArrow()
    ids, tags, rows = (got.column(c).combine_chunks() for c in ("id", "label", "features"))
    order = np.lexsort((np.array([xxhash.xxh64_intdigest(str(i)) for i in ids.to_pylist()], np.uint64),)) if len(ids) else np.zeros(0, int)
    starts, flat = np.asarray(rows.offsets), np.asarray(rows.values)
    lists = [flat[starts[i] : starts[i + 1]] for i in order]
    return train(lists, np.asarray(tags)[order] if len(ids) else np.zeros(0))


def scores(found: list[bytes], model: dict) -> np.ndarray:
    """The scores of texts, all their indicators looked up at once."""
    rows = [features(x) for x in found]
    ends = np.cumsum([len(r) for r in rows])
    flat = np.concatenate([*rows, np.zeros(0, np.int32)])
    scale = model["scale"][flat].astype(np.float64)
    dots, squares = (np.diff(np.concatenate([[0.0], np.concatenate([[0.0], np.cumsum(x)])[ends]])) for x in (model["w"][flat] * scale, scale * scale))
    z = model["a"] * (dots / np.maximum(np.sqrt(np.maximum(squares, 0.0)), 1e-9) + model["bias"]) + model["b"]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _score(batches: Iterator[pa.RecordBatch], model: dict) -> Iterator[pa.RecordBatch]:
    for b in small(batches, most=PART):
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores(raw(b, "t"), model), pa.float64())], ["doc_id", "score"])


def _good(batches: Iterator[pa.RecordBatch], model: dict, at: int, threshold: float) -> Iterator[pa.RecordBatch]:
    for b in small(batches, f"c{at}", PART):
        found = [x or b"" for x in raw(b, f"c{at}")]
        yield b.filter(pa.array(scores(found, model) >= threshold))


def _light(model: dict) -> dict:
    return {k: v.astype(np.float32) if isinstance(v, np.ndarray) else v for k, v in model.items()}


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, **how) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted."""
    model = _light(learn(docs, labels, id_col, text_col, **how))
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("t"))
    out = rows.mapInArrow(partial(_score, model=model), kind(rows.select("doc_id"), score="double"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, **how) -> DataFrame:
    """docs, whose texts are strings, that the classifier doesn't reject, all columns as they were."""
    model = _light(learn(docs, labels, id_col, text_col, **how))
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    return plain.mapInArrow(partial(_good, model=model, at=docs.columns.index(text_col), threshold=threshold), plain.schema).toDF(*docs.columns)
