"""Benchmark decontamination with one Aho-Corasick automaton over normalised benchmark texts.

A-Z are lower-cased and words are runs of digits, a-z and code points from 0x80. A window of an item is 13
consecutive words, or all of a shorter item. Whatever 13 consecutive words of an item a document repeats, 7 of
them that begin at a multiple of 7 are among them; so the patterns of the automaton are these pieces, and
whole short items. Words are written as fixed numbers of letters from a small alphabet, which keeps nodes
few and their branches short: three letters a word at most, and a word that no item has is like any other
such. A document is scanned once; where a piece is found, the seven windows of 13 words around it are looked up
among the distinct windows of all items and compared word by word, so that the time doesn't depend on how many
items share a piece. Hits are mapped back to words, and words to offsets in the original text.

The automaton and the windows hold at most BLOCK_CHARS characters of items, some 60 bytes each, and goes to the workers as
a broadcast variable. A larger benchmark is several automata, one after another: each scan writes what it
found, by place, before the next begins.

Nulls and texts without words have nothing to hit; items without words are ignored. Very long texts are
scanned whole, in time in proportion to their length. Items that repeat an id are one item with the windows
of all its rows; items without an id are ignored; items that tie in a window are all counted. Repeated
documents are repeated in the result; ids of both tables keep their types; extra columns are ignored.
Empty tables: no documents, no rows; no items, no hits.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoor.llm.common import discard, in_place, kind, positioned, prepare, small, text_of, texts, written

WINDOW, PIECE = 13, 7
#: Characters of item texts in one automaton.
BLOCK_CHARS = 4_000_000
LOWER = {a: a + 32 for a in range(0x41, 0x5B)}
#: Fixed value: what a word is, after lower-casing.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text: str) -> list[str]:
    return WORD.findall(text.translate(LOWER) if not text.isascii() else text.lower())


class Items:
    """The automaton over a block of items, and what it needs to tell hits from it."""

    def __init__(self, items: list[tuple[object, str]]) -> None:
        import ahocorasick

        items = [(i, w) for i, w in ((i, words(t)) for i, t in items) if w]
        self.number = {w: n for n, w in enumerate(dict.fromkeys(w for _, found in items for w in found), 1)}  # 0 is for words of no item
        size = 2
        while size**3 < len(self.number) + 1:
            size += 1
        # Three alphabets, one for each letter of a word, so that no match begins inside a word.
        letters = [[chr(0x100 + size * k + j) for j in range(size)] for k in range(3)]
        self.code = ["".join(x) for x in itertools.islice(itertools.product(*letters), len(self.number) + 1)]
        self.ids = list(dict.fromkeys(i for i, _ in items))
        at = {i: n for n, i in enumerate(self.ids)}
        short: dict[str, set[int]] = {}
        pieces: set[str] = set()
        long: list[tuple[int, list[int]]] = []
        for i, found in items:
            numbers = [self.number[w] for w in found]
            codes = [self.code[n] for n in numbers]
            if len(found) < WINDOW:
                short.setdefault("".join(codes), set()).add(at[i])
            else:
                long.append((at[i], numbers))
                pieces.update("".join(codes[a : a + PIECE]) for a in range(0, len(found) - PIECE + 1, PIECE))
        self.windows = Windows(long)
        self.automaton = None
        if pieces or short:
            self.automaton = ahocorasick.Automaton()
            self.short = [(), *short.values()]
            list_of = {pattern: n for n, pattern in enumerate(short, 1)}
            for pattern in pieces | short.keys():
                self.automaton.add_word(pattern, (len(pattern) // len(letters), pattern in pieces, list_of.get(pattern, 0)))
            self.automaton.make_automaton()

    def hits(self, found: list[str]) -> tuple[list[tuple[int, int]], set]:
        """Ranges of hit words (merged, end exclusive), in order, and the ids of the items they come from."""
        if not found or self.automaton is None:
            return [], set()
        numbers = list(map(self.number.get, found, itertools.repeat(0)))
        ranges: list[tuple[int, int]] = []
        of: set[int] = set()
        lists: set[int] = set()
        starts: set[int] = set()
        for end, (n, piece, short) in self.automaton.iter("".join(map(self.code.__getitem__, numbers))):
            b = end // 3 + 1
            if short:
                ranges.append((b - n, b))
                lists.add(short)
            if piece:
                starts.update(range(max(0, b - WINDOW), min(b - n, len(found) - WINDOW) + 1))
        for k in lists:
            of.update(self.short[k])
        if starts:
            hit, more = self.windows.look_up(numbers, sorted(starts))
            ranges.extend((a, a + WINDOW) for a in hit)
            of.update(more)
        return merged(ranges), {self.ids[k] for k in of}


class Windows:
    """The distinct windows of items by 64-bit hashes, each with a place where it is and the list of items that have it.

    Hashes only lead to a window, words tell: equal hashes of different windows of items are ruled out by
    another multiplier, and what a document has is compared word by word. Windows of the same items share a list.
    """

    def __init__(self, items: list[tuple[int, list[int]]]) -> None:
        self.words = np.array([w for _, numbers in items for w in numbers], np.int32)
        lengths = np.array([len(numbers) for _, numbers in items], np.int64)
        of = np.repeat(np.array([i for i, _ in items], np.int64), lengths)
        ends = np.repeat(np.cumsum(lengths), lengths)
        starts = np.flatnonzero(np.arange(len(self.words)) + WINDOW <= ends)
        for multiplier in itertools.count(0x9E3779B97F4A7C15, 2):
            self.powers = np.array([pow(multiplier, k + 1, 1 << 64) for k in range(WINDOW)], np.uint64)
            hashes = self._hash(self.words, starts)
            order = np.lexsort((of[starts], hashes))
            self.hashes, first = np.unique(hashes[order], return_index=True)
            self.places = starts[order][first]
            bounds = np.append(first, len(order))
            mine = np.repeat(self.places, np.diff(bounds))
            if all((self.words[starts[order] + k] == self.words[mine + k]).all() for k in range(WINDOW)):
                break
        shared: dict[bytes, int] = {}
        self.lists: list[np.ndarray] = []
        self.list_of = np.zeros(len(self.places), np.int64)
        ids = of[starts][order]
        for k, (a, e) in enumerate(itertools.pairwise(bounds)):
            part = np.unique(ids[a:e]) if e - a > 1 else ids[a:e]
            n = self.list_of[k] = shared.setdefault(part.tobytes(), len(self.lists))
            if n == len(self.lists):
                self.lists.append(part.copy())

    def _hash(self, numbers: np.ndarray, starts: np.ndarray) -> np.ndarray:
        out = np.zeros(len(starts), np.uint64)
        for k in range(WINDOW):
            out += numbers[starts + k].astype(np.uint64) * self.powers[k]
        return out

    def look_up(self, numbers: list[int], starts: list[int]) -> tuple[list[int], set[int]]:
        """Those starts at which a document has a window of an item, and the items, each list of them taken once."""
        if not len(self.hashes):
            return [], set()
        text, at = np.array(numbers, np.int32), np.array(starts, np.int64)
        hashes = self._hash(text, at)
        k = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        same = self.hashes[k] == hashes
        for j in range(WINDOW):
            same &= text[at + j] == self.words[self.places[k] + j]
        lists = np.unique(self.list_of[k[same]])
        return at[same].tolist(), {i for n in lists for i in self.lists[n].tolist()}


def merged(ranges: list) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(map(tuple, ranges)):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def contaminates(n_hit: int, n_words: int) -> bool:
    """Some words are hit, and at least a twentieth of all."""
    return n_hit > 0 and 20 * n_hit >= n_words


def spans(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The offsets in the original text of ranges of its words."""
    if not ranges:
        return []
    at = [m.span() for m in WORD.finditer(text.translate(LOWER))]
    return [(at[a][0], at[b - 1][1]) for a, b in ranges]


_BUILT: dict[int, Items] = {}


def built(block) -> Items:
    """The automaton of a broadcast block of items. The worker keeps the last one it made."""
    if block.id not in _BUILT:
        _BUILT.clear()
        _BUILT[block.id] = Items(block.value)
    return _BUILT[block.id]


class Block:
    """A block of items as a broadcast variable, with a name of its own."""

    def __init__(self, spark, items: list[tuple[object, str]]) -> None:
        self.variable = spark.sparkContext.broadcast(items)
        self.id = self.variable._jbroadcast.id()

    def __getstate__(self) -> dict:
        return {"variable": self.variable, "id": self.id}

    @property
    def value(self) -> list[tuple[object, str]]:
        return self.variable.value


FOUND = {"n_words": "long", "hit_words": "array<array<int>>", "spans": "array<array<int>>"}


def _scan(batches: Iterator[pa.RecordBatch], block: Block, item_type: str) -> Iterator[pa.RecordBatch]:
    """Each row without its text t, with n_words, hit_words, spans, items."""
    ranges_kind = pa.list_(pa.list_(pa.int32()))
    items_kind = pa.list_(pa.type_for_alias(item_type))
    for b in small(batches):
        out: list[list] = [[], [], [], []]
        for text in texts(b, "t"):
            found = words(text)
            ranges, ids = built(block).hits(found)
            for column, x in zip(out, (len(found), [list(r) for r in ranges], [list(s) for s in spans(text, ranges)], sorted(ids)), strict=True):
                column.append(x)
        kept = [n for n in b.schema.names if n != "t"]
        kinds = pa.int64(), ranges_kind, ranges_kind, items_kind
        yield pa.RecordBatch.from_arrays([*(b.column(n) for n in kept), *(pa.array(x, t) for x, t in zip(out, kinds, strict=True))], [*kept, *FOUND, "items"])


def _blocks(items: Iterator) -> Iterator[list[tuple[object, str]]]:
    block, size = [], 0
    for r in items:
        if block and size + len(r["t"]) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append((r["i"], r["t"]))
        size += len(r["t"])
    yield block


#: Item ids as Arrow names them; ids of other types are taken as strings.
ARROW = {"bigint": "int64", "int": "int32", "smallint": "int16", "tinyint": "int8"}


def blocks(benchmark: DataFrame, item_col: str = "item_id", item_text: str = "text") -> tuple[list[Block], str, str]:
    """The items in blocks of bounded size, and the type of their ids for Spark and for Arrow. One block at a time passes through the driver."""
    spark_type = benchmark.schema[item_col].dataType.simpleString()
    if spark_type not in ARROW:
        spark_type = "string"
    items = benchmark.select(F.col(item_col).cast(spark_type).alias("i"), text_of(item_text).alias("t")).filter("i is not null and t <> ''").orderBy("i", "t")
    return [Block(benchmark.sparkSession, block) for block in _blocks(items.toLocalIterator())], spark_type, ARROW.get(spark_type, "string")


def n_hit() -> Column:
    return F.aggregate("hit_words", F.lit(0).cast("long"), lambda n, r: n + (r[1] - r[0]))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of ranges that several scans found, as one."""
    for b in batches:
        columns = []
        for name, c in zip(b.schema.names, b.columns, strict=True):
            columns.append(pa.array([[list(r) for r in merged([r for part in lists for r in part])] for lists in c.to_pylist()], pa.list_(pa.list_(pa.int32()))) if name in ("hit_words", "spans") else c)
        yield pa.RecordBatch.from_arrays(columns, b.schema.names)


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", stored: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, items, spans, contaminated. stored: see positioned()."""
    prepare(docs.sparkSession)
    parts, item_type, arrow_type = blocks(benchmark)
    more = {**FOUND, "items": f"array<{item_type}>"}
    if len(parts) == 1:
        rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("t"))
        found = rows.mapInArrow(partial(_scan, block=parts[0], item_type=arrow_type), kind(rows.select("doc_id"), **more))
    else:
        placed, file, row = positioned(docs, stored)
        placed = placed.select(F.col(id_col).alias("doc_id"), F.col(file).alias("file"), F.col(row).alias("row"), text_of(text_col).alias("t"))
        narrow = kind(placed.select("doc_id", "file", "row"), **more)
        scans = [written(placed.mapInArrow(partial(_scan, block=p, item_type=arrow_type), narrow), "scan") for p in parts]
        hits = scans[0].filter("size(items) > 0")
        for x in scans[1:]:
            hits = hits.unionByName(x.filter("size(items) > 0"))
        hits = hits.groupBy("file", "row").agg(F.collect_list("hit_words").alias("hit_words"), F.collect_list("spans").alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        lists = hits.select("file", "row", "items", "hit_words", "spans")
        hits = written(lists.mapInArrow(_merged, kind(lists.select("file", "row"), items=f"array<{item_type}>", hit_words=FOUND["hit_words"], spans=FOUND["spans"])), "hits")
        all_rows = scans[0].select("doc_id", "file", "row", "n_words")
        found = all_rows.join(hits, ["file", "row"], "left")
        found = found.withColumns({c: F.coalesce(c, F.array().cast(more[c])) for c in ("hit_words", "spans", "items")})
        discard(*scans[1:])
    found = found.select("doc_id", "n_words", n_hit().alias("n_hit"), "items", "spans")
    return found.withColumn("contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words"))


def _clean(batches: Iterator[pa.RecordBatch], block: Block, at: int) -> Iterator[pa.RecordBatch]:
    for b in small(batches, f"c{at}"):
        keep = []
        for text in b.column(at).to_pylist():
            found = words(text or "")
            keep.append(not contaminates(sum(e - a for a, e in built(block).hits(found)[0]), len(found)))
        yield b.filter(pa.array(keep, pa.bool_()))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", stored: bool = False) -> DataFrame:
    """docs without the contaminated documents, all columns as they were. stored: see positioned()."""
    prepare(docs.sparkSession)
    cols = docs.columns
    at = cols.index(text_col)
    parts, *_ = blocks(benchmark)
    if len(parts) == 1 and docs.schema[at].dataType.simpleString() == "string":
        plain = docs.toDF(*(f"c{i}" for i in range(len(cols))))
        return plain.mapInArrow(partial(_clean, block=parts[0], at=at), plain.schema).toDF(*cols)
    placed, file, row = positioned(docs, stored)
    place = placed.select(F.struct(F.col(file).alias("file"), F.col(row).alias("row")).alias("place"), F.col(text_col).alias("text"))
    bad = report(place, benchmark, "place", "text").filter("contaminated").select(F.col("doc_id.file").alias(file), F.col("doc_id.row").alias(row))
    return in_place(placed, written(bad, "contaminated"), file, row, "left_anti", F.lit(0)).select(*cols)
