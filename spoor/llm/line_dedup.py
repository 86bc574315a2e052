"""Line dedup by range-partitioned hashes.

Each document sends one row per distinct line key: a 128-bit hash, the document and the positions. Rows are
range-partitioned and sorted by hash, then document: a key that holds a third of all lines is cut into
several ranges by its documents. Each range streams its groups once and holds fewer than min_docs rows of
one; groups at the edge of a range are settled from one total per edge. What comes back per document is a
compressed bitmap of the lines that stay, never text, and it goes to where the document lies: texts are read
in place and never shuffle (see in_place()).

A null text is one empty line; so is an empty one. Empty keys always stay. Very long texts are split whole,
in time in proportion to their length. A document is its id and text together: rows that repeat both count as
one document and all get its result; rows without an id count by text. Of lines with the same key the first
by id (null first), then hash of the text, then position, comes first; that settles ties. Ids keep their
type; extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoor.llm.common import discard, in_place, kind, positioned, prepare, raw, small, text_of, written

#: Fixed values: [\x20\x09-\x0D], as bytes.
STRIPPED = b" \t\n\x0b\x0c\r"
#: Bytes of a row of LINES in memory, about, and of a range of them.
ROW_BYTES, RANGE_BYTES = 80, 128 << 20
BATCH = 8192


def line_key(line: bytes) -> bytes:
    """Stripped of ASCII white space, A-Z lower-cased, in UTF-8."""
    return line.strip(STRIPPED).lower()


def text_key(data: bytes) -> int:
    return xxhash.xxh3_64_intdigest(data) - (1 << 63)


def lines_schema(id_type: pa.DataType) -> pa.Schema:
    longs = ("tkey", "file", "row", "n_lines")
    return pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", id_type), *((x, pa.int64()) for x in longs), ("positions", pa.list_(pa.int32()))])


def streamed_schema(id_type: pa.DataType) -> pa.Schema:
    edge = [("at", pa.int64()), ("leads", pa.bool_()), ("n_docs", pa.int64()), ("first_id", id_type), ("first_key", pa.int64()), ("last_id", id_type), ("last_key", pa.int64())]
    return pa.schema([*lines_schema(id_type), *edge])


LINES_SQL = "h1 long, h2 long, doc_id {id}, tkey long, file long, row long, n_lines long, positions array<int>"
STREAMED_SQL = f"{LINES_SQL}, at long, leads boolean, n_docs long, first_id {{id}}, first_key long, last_id {{id}}, last_key long"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in small(batches):
        rows = []
        for doc_id, file, row, data in zip(*(b.column(c).to_pylist() for c in ("doc_id", "file", "row")), raw(b, "t"), strict=True):
            at: dict[bytes, list[int]] = {}
            lines = data.split(b"\n")
            for i, line in enumerate(lines):
                if key := line_key(line):
                    at.setdefault(key, []).append(i)
            tkey = text_key(data)
            for key, positions in at.items():
                h = xxhash.xxh3_128_intdigest(key)
                rows.append(((h >> 64) - (1 << 63), (h & ((1 << 64) - 1)) - (1 << 63), doc_id, tkey, file, row, len(lines), positions))
        yield _batch(rows, lines_schema(b.schema.field("doc_id").type))


def _stream(batches: Iterator[pa.RecordBatch], min_docs: int, keep_first: bool) -> Iterator[pa.RecordBatch]:
    """One sorted range: the rows of its common lines, and a row with n_docs for each group at its edges."""
    at = TaskContext.get().partitionId()
    out: list[tuple] = []
    held: list[tuple] = []
    key, docs, edge, first, last, schema = None, 0, True, None, None, None
    nothing = (None,) * 5

    def total() -> tuple:
        return (*key, *(None,) * 6, at, None, docs, *first, *last)

    for b in batches:
        schema = streamed_schema(b.schema.field("doc_id").type)
        for h1, h2, doc_id, tkey, *rest in zip(*(c.to_pylist() for c in b.columns), strict=True):
            doc = doc_id, tkey
            if (h1, h2) != key:
                if key is not None and edge:
                    out.append(total())
                    edge = False
                key, docs, held, first, last = (h1, h2), 0, [], doc, None
            if doc != last:
                docs, last = docs + 1, doc
            leads = doc == first  # the first of its group in this range; whether the group begins here, the edges tell
            held.append((h1, h2, *doc, *rest, at, leads, *nothing))
            if edge or docs >= min_docs:
                out += (x for x in held if edge or not (keep_first and x[9] and len(x[7]) == 1) or min_docs > 1)
                held = []
            if len(out) >= BATCH:
                yield _batch(out, schema)
                out = []
    if key is not None:
        out += held  # the last group may go on in the next range
        out.append(total())
    if out:
        yield _batch(out, schema)


def _edges(streamed: DataFrame) -> list[tuple]:
    """h1, h2, documents in all, first document: of the groups at edges, two for each range at most."""
    found: dict[tuple, list] = {}
    for r in sorted(streamed.filter("n_docs is not null").collect(), key=lambda r: r["at"]):
        found.setdefault((r["h1"], r["h2"]), []).append(r)
    out = []
    for key, parts in found.items():
        again = sum((a["last_id"], a["last_key"]) == (b["first_id"], b["first_key"]) for a, b in zip(parts, parts[1:], strict=False))
        out.append((*key, sum(p["n_docs"] for p in parts) - again, parts[0]["first_key"], parts[0]["first_id"]))
    return out


def dropped_lines(placed: DataFrame, min_docs: int, keep_first: bool) -> DataFrame:
    """file, row, n_lines, gone (array of positions): the lines to drop, for documents that have any.

    placed: doc_id, t, file, row. A line is common if at least min_docs documents have its key. keep_first:
    its first occurrence, by document and position, stays; else none does.
    """
    spark = placed.sparkSession
    id_type = placed.schema["doc_id"].dataType.simpleString()
    rows = written(placed.mapInArrow(_lines, LINES_SQL.format(id=id_type)), "lines")  # the sampling of ranges reads it once more
    order = ["h1", "h2", "doc_id", "tkey"]
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count() * ROW_BYTES // RANGE_BYTES)
    ranges = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    streamed = written(ranges.mapInArrow(partial(_stream, min_docs=min_docs, keep_first=keep_first), STREAMED_SQL.format(id=id_type)), "common")
    edges = spark.createDataFrame(_edges(streamed), f"h1 long, h2 long, total long, lead_key long, lead_id {id_type}")
    found = streamed.filter("n_docs is null").join(F.broadcast(edges), ["h1", "h2"], "left").filter(F.coalesce(F.col("total") >= min_docs, F.lit(True)))
    gone = F.col("positions")
    if keep_first:
        lead = F.col("leads") & (F.col("total").isNull() | (F.col("lead_id").eqNullSafe(F.col("doc_id")) & (F.col("lead_key") == F.col("tkey"))))
        gone = F.when(lead, F.slice("positions", 2, F.size("positions"))).otherwise(gone)
    out = written(found.groupBy("file", "row").agg(F.max("n_lines").alias("n_lines"), F.flatten(F.collect_list(gone)).alias("gone")), "gone")
    discard(rows, streamed)
    return out


def pack(n_lines: int, gone: list[int] | None) -> bytes:
    """The compressed keep bitmap: a bit per line, 1 if it stays."""
    keep = np.ones(n_lines, np.uint8)
    if gone:
        keep[np.asarray(gone)] = 0
    return zlib.compress(np.packbits(keep).tobytes(), 6)


def unpack(bitmap: bytes, n_lines: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n_lines).astype(bool)


def apply_bitmap(data: bytes, bitmap: bytes) -> bytes:
    """The text without the lines that the bitmap drops."""
    lines = data.split(b"\n")
    keep = unpack(bitmap, len(lines))
    return data if keep.all() else b"\n".join(x for x, k in zip(lines, keep, strict=True) if k)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        maps = pa.array([pack(n, gone) for n, gone in zip(b.column("n_lines").to_pylist(), b.column("gone").to_pylist(), strict=True)], pa.binary())
        yield pa.RecordBatch.from_arrays([b.column("file"), b.column("row"), maps], ["file", "row", "bitmap"])


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in small(batches):
        n, gone, maps, digests = [], [], [], []
        for data, bitmap in zip(raw(b, "t"), b.column("bitmap").to_pylist(), strict=True):
            n.append(data.count(b"\n") + 1)
            maps.append(bitmap or pack(n[-1], None))
            gone.append(n[-1] - int(unpack(bitmap, n[-1]).sum()) if bitmap else 0)
            digests.append(hashlib.sha256(apply_bitmap(data, bitmap) if bitmap else data).hexdigest())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests, pa.string()), pa.array(maps, pa.binary())], ["doc_id", "n_lines", "n_dropped", "kept_sha256", "keep_bitmap"])


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 1, keep_first: bool = True, stored: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_lines, n_dropped, kept_sha256 (of the text that stays), keep_bitmap. stored: see positioned()."""
    prepare(docs.sparkSession)
    placed, file, row = positioned(docs, stored)
    placed = placed.select(F.col(id_col).alias("doc_id"), F.col(file).alias("file"), F.col(row).alias("row"), text_of(text_col).alias("t"))
    gone = dropped_lines(placed, min_docs, keep_first)
    maps = written(gone.mapInArrow(_packed, "file long, row long, bitmap binary"), "bitmaps")
    discard(gone)
    both = in_place(placed, maps, "file", "row", "left", F.length("bitmap")).select("doc_id", "t", "bitmap")
    return both.mapInArrow(_kept, kind(both.select("doc_id"), n_lines="long", n_dropped="long", kept_sha256="string", keep_bitmap="binary"))
