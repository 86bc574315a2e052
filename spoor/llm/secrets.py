"""Secret scans: two character Markov models, compared by log-likelihood ratio.

Plain patterns find assignments, access keys and long hexadecimal runs. The method adds what they can't
name: every run of key characters of a text, of any length and of any kinds of characters, is scored under a
model of random strings and one of ordinary words and identifiers, both of second order, backing off to
lower ones, and trained from a labelled table (see samples_table()), a parameter. A run whose log-likelihood
ratio is high enough, in all and a character, is a secret; nothing else decides. A run is scored whole, with
the letters beyond ASCII before it as context.

A null text is empty; it and texts without matches have no spans. Very long texts and runs are read whole,
in time in proportion to their length. Runs that tie with the thresholds count as secrets; repeated rows are
repeated; ids keep their type, null included; extra columns are ignored. An empty table gives an empty
result. With an empty labelled table the models are equal and only plain spans are found.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoor.llm.common import kind, prepare, small, text_of, texts

KINDS = "assign", "access", "hex", "random"
#: The base patterns and the least lengths of their matches.
ASSIGN = re.compile(r"""(?ai:(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
LEAST = {"assign": 12, "access": 18, "hex": 16}
#: What an assignment needs somewhere, so that most texts are passed over quickly.
CUE = re.compile(r"(?ai:passw|secret|token|api_?key)")

#: Characters of runs; a run may end in up to two = besides.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
#: Codes of bytes of letters beyond ASCII, and of all else, which ends a run.
BEYOND, EDGE = len(ALPHABET), len(ALPHABET) + 1
N = EDGE + 1
_CODE = np.full(256, EDGE, np.uint8)
_CODE[128:] = BEYOND
_CODE[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(len(ALPHABET))
#: Thresholds of the log-likelihood ratio, in all and a character.
WHOLE, EACH = 36.0, 0.7

#: Words that ordinary identifiers are made of, besides those of the texts themselves.
WORDS = (
    "account action address array async backup batch begin block buffer build button cache callback cancel channel char check class client close cluster code collection "
    "color column command commit common compile config connect console container content context control convert cookie count create current data database date debug "
    "default delete deploy device directory display document download driver editor element email empty enable engine entry error event execute export field file filter "
    "find first folder format frame from function generate global group handle header height history host html image import index info init input insert instance integer "
    "interface item job key label language last layout length level library line link list load local locale location login manager map match member memory menu message "
    "method mobile mode model module name network node number object option order output page panel parent parse path pattern payment port position preview print process "
    "product profile project property provider public query queue range"
).split()


def composed(words: list[str], rng: random.Random) -> str:
    """An identifier made of words, in one of the usual ways."""
    some = rng.choices(words, k=rng.randint(1, 4))
    how = rng.randrange(9)
    text = (
        "".join(w.capitalize() for w in some) if how == 0 else some[0] + "".join(w.capitalize() for w in some[1:]) if how == 1 else "_".join(some) if how == 2 else "-".join(some) if how == 3
        else "/".join(some) if how == 4 else "_".join(some).upper() if how == 5 else some[0].upper() if how == 6 else some[0].capitalize() if how == 7 else some[0]
    )
    return text + (rng.choice(["", "-", "_"]) + str(rng.randint(0, 2030)) if rng.random() < 0.15 else "")


#: Pools of random strings, and how often each is drawn from.
POOLS = [(ALPHABET[:64], 40), (ALPHABET[:62], 40), (ALPHABET[26:62], 15), (ALPHABET[:26] + ALPHABET[52:62], 20), ("0123456789abcdef", 8), ("0123456789ABCDEF", 6), (ALPHABET[:62] + "_-", 30), (ALPHABET[26:52], 6), (ALPHABET[:26], 6), (ALPHABET[:52], 10)]


def samples(words: list[str] = WORDS, n: int = 6000, seed: int = 11, pools: list[tuple[str, int]] = POOLS) -> list[tuple[str, int]]:
    """A labelled table: (string, 1 for random or 0 for ordinary). words: what ordinary strings are made of."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        pool = rng.choices([p for p, _ in pools], [w for _, w in pools])[0]
        out.append(("".join(rng.choices(pool, k=rng.randint(12, 64))), 1))
        out.append((composed(words, rng), 0))
    for _ in range(n // 8):
        date = [str(rng.randint(1, 31)), f"{rng.randint(1, 12):02}", str(rng.randint(1990, 2030))]
        out.append(("-".join(date[:: rng.choice([1, -1])]), 0))
        out.append((rng.choice(ALPHABET) * rng.randint(2, 60), 0))
        out += [("".join(rng.choices("0123456789", k=rng.randint(1, 20))), 0) for _ in range(3)]
    return out


#: Documents whose words make ordinary samples, and how many words at most.
SAMPLE_DOCS, SAMPLE_WORDS = 2_000, 20_000


def samples_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS, sample_words: int = SAMPLE_WORDS, **how) -> DataFrame:
    """samples() as a table: string, label. Ordinary ones are made of WORDS and of words that several documents have.

    A secret is hardly ever in several documents, so words of letters that at least three different texts have
    are ordinary. They come from the sample_docs documents whose ids have the lowest hashes, sample_words of
    them at most, again those with the lowest hashes.
    """
    spark = docs.sparkSession
    ids = docs.select(F.xxhash64(F.col(id_col).cast("string")).alias("h")).distinct().orderBy("h").limit(sample_docs)
    some = docs.select(F.xxhash64(F.col(id_col).cast("string")).alias("h"), text_of(text_col).alias("t")).join(F.broadcast(ids), "h", "left_semi")
    words = some.select(F.xxhash64("t").alias("k"), F.explode(F.array_distinct(F.regexp_extract_all("t", F.lit(r"([\p{L}]+)"), F.lit(1)))).alias("w")).filter("length(w) between 2 and 60")
    often = words.groupBy("w").agg(F.countDistinct("k").alias("n")).filter("n >= 3").select("w").orderBy(F.xxhash64("w"), "w").limit(sample_words)
    found = sorted(r["w"] for r in often.collect())
    rows = samples(WORDS, **how) + [x for x in samples(found, seed=12, **how) if not x[1]] + [(x, 0) for w in found for x in (w, w.upper(), w.capitalize())] if found else samples(WORDS, **how)
    return spark.createDataFrame(rows, "string string, label int")


#: Samples that the models are trained on at most; a larger table raises.
MAX_SAMPLES = 200_000


def fit(table: DataFrame) -> np.ndarray:
    """The models of a labelled table: string, label."""
    rows = table.select("string", "label").filter("string <> '' and label is not null").limit(MAX_SAMPLES + 1).collect()
    if len(rows) > MAX_SAMPLES:
        raise ValueError(f"over {MAX_SAMPLES} labelled strings")
    return models([(r["string"], int(r["label"] > 0)) for r in rows])


def models(rows: list[tuple[str, int]]) -> np.ndarray:
    """log P(random) - log P(ordinary) of each code behind two others; N * N * N."""
    counts = np.zeros((2, N, N, N), np.float64)
    for label in (0, 1):
        joined = "\n\n" + "".join(f"{text}\n\n" for text, of in rows if of == label)
        codes = _CODE[np.frombuffer(joined.encode(), np.uint8)].astype(np.int64)
        inside = codes[2:] != EDGE
        counts[label] += np.bincount(((codes[:-2] * N + codes[1:-1]) * N + codes[2:])[inside], minlength=N**3).reshape(N, N, N)
    # A rare context falls back on what one character tells, and that on how frequent characters are.
    none = counts.sum(axis=(1, 2)) + 1.0
    none /= none.sum(axis=-1, keepdims=True)
    one = counts.sum(axis=1)
    one = (one + 4.0 * none[:, None]) / (one.sum(axis=-1, keepdims=True) + 4.0)
    mixed = (counts + 2.0 * one[:, None]) / (counts.sum(axis=-1, keepdims=True) + 2.0)
    return (np.log(mixed[1]) - np.log(mixed[0])).astype(np.float32)


def ratios(data: bytes, model: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and log-likelihood ratio of every run of key characters in UTF-8."""
    codes = np.concatenate([[EDGE, EDGE], _CODE[np.frombuffer(data, np.uint8)], [EDGE]]).astype(np.int32)
    inside = codes < BEYOND
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    each = model.ravel()[(codes[:-2] * N + codes[1:-1]) * N + codes[2:]].astype(np.float64)  # of the code two further on
    sums = np.concatenate([[0.0], np.cumsum(np.where(inside[2:], each, 0.0))])
    return starts - 2, ends - 2, sums[ends - 2] - sums[starts - 2]


def model_spans(found: list[str], model: np.ndarray) -> list[list[tuple[int, int]]]:
    """For each text the runs that the models alone take for secrets, as code points."""
    out: list[list[tuple[int, int]]] = [[] for _ in found]
    raw = [t.encode() for t in found]
    begins = np.cumsum([0, *(len(x) + 1 for x in raw)])
    starts, ends, llr = ratios(b"\n".join(raw), model)
    hits = np.flatnonzero((llr >= WHOLE) & (llr >= EACH * (ends - starts)))
    for i in hits.tolist():
        k = int(np.searchsorted(begins, starts[i], "right")) - 1
        a, b = int(starts[i] - begins[k]), int(ends[i] - begins[k])
        while b < len(raw[k]) and b < int(ends[i] - begins[k]) + 2 and raw[k][b] == 0x3D:
            b += 1
        if len(raw[k]) != len(found[k]):
            a = len(raw[k][:a].decode())
            b = a + int(b - (starts[i] - begins[k]))
        out[k].append((a, b))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted: kinds are numbered as in KINDS."""
    out = []
    if CUE.search(text):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def all_spans(found: list[str], model: np.ndarray) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """For each text its base spans, and those with what the models add: runs that no base span overlaps."""
    out = []
    for text, runs in zip(found, model_spans(found, model), strict=True):
        base = base_spans(text)
        more, k, reach = [], 0, 0
        for a, e in runs:
            while k < len(base) and base[k][0] < e:
                reach = max(reach, base[k][2])
                k += 1
            if reach <= a:
                more.append((a, 3, e))
        out.append((base, sorted(base + more)))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _scan(batches: Iterator[pa.RecordBatch], model: np.ndarray) -> Iterator[pa.RecordBatch]:
    for b in small(batches):
        found = all_spans(texts(b, "t"), model)
        counts = [pa.array([sum(s[1] == k for s in base) for base, _ in found], pa.int64()) for k in range(3)]
        names = [pa.array([joined(x[i]) for x in found], pa.string()) for i in (0, 1)]
        total = pa.array([len(x) for _, x in found], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *counts, *names, total], ["doc_id", "n_assign", "n_access", "n_hex", "base", "spans", "n_spans"])


def scan(docs: DataFrame, table: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex (plain ones), base, spans (kind:start:end, comma-joined), n_spans.

    table: labelled strings, as samples_table() gives them.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("t"))
    kinds = dict.fromkeys(("n_assign", "n_access", "n_hex"), "long") | {"base": "string", "spans": "string", "n_spans": "long"}
    return rows.mapInArrow(partial(_scan, model=fit(table)), kind(rows.select("doc_id"), **kinds))


def masked(docs: DataFrame, table: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with each secret of the text, base or added, replaced by mark; all other columns as they were."""
    prepare(docs.sparkSession)
    at = docs.columns.index(text_col)
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))).withColumn(f"c{at}", F.col(f"c{at}").cast("string"))
    return plain.mapInArrow(partial(_masked, at=at, mark=mark, model=fit(table)), plain.schema).toDF(*docs.columns)


def _masked(batches: Iterator[pa.RecordBatch], at: int, mark: str, model: np.ndarray) -> Iterator[pa.RecordBatch]:
    for b in small(batches, f"c{at}"):
        out = []
        whole = b.column(at).to_pylist()
        for text, (_, spans) in zip(whole, all_spans([t or "" for t in whole], model), strict=True):
            parts, last = [], 0
            for a, _, e in spans:
                if a >= last:
                    parts += [text[last:a], mark]
                last = max(last, e)
            out.append("".join([*parts, text[last:]]) if parts else text)
        columns = [pa.array(out, b.schema.field(at).type) if i == at else c for i, c in enumerate(b.columns)]
        yield pa.RecordBatch.from_arrays(columns, b.schema.names)
