"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Every distinct fingerprint emits all variants within half the radius; two fingerprints within the radius
share a variant, so the shuffle on variants brings each linked pair together. A variant's bucket holds at
most one ball of fingerprints (65 for radius 2) however many documents there are, since copies have been
folded into one fingerprint first. Neighbours in a sorted bucket are verified and become links; links go
through hooking and pointer jumping (both distributed) to components.

Nulls and texts without words have fingerprint zero and link like any other. Very long texts are hashed
whole, a block of shingles at a time. A bit that ties, set in exactly half, is 0. Rows without an id keep a
row of their own and don't lend an id to a component; a component of such rows only has a null id. Ids keep
their type. Repeated rows are repeated in the result; extra columns, whatever their names, are kept by
keep_one() and ignored by the rest. An empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spoor.llm.common import discard, in_place, kind, positioned, prepare, raw, small, text_of, written

SEED = 42
BLOCK = 1 << 15


def fingerprint(data: bytes, words: int = 3) -> int:
    """The 64-bit SimHash of a text in UTF-8, as a signed integer."""
    found = data.lower().split()  # bytes.lower() and bytes.split() know ASCII only
    n = max(1, len(found) - words + 1) if found else 0
    if not n:
        return 0
    counts = np.zeros(64, np.int64)
    digest = partial(xxhash.xxh64_digest, seed=SEED)
    for a in range(0, n, BLOCK):
        part = found[a : a + BLOCK + words - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(words)), strict=False)) if len(found) >= words else [b" ".join(found)]
        bits = np.frombuffer(b"".join(map(digest, shingles)), np.uint8).reshape(-1, 8)
        counts += np.unpackbits(bits, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big", signed=True)


def _fingerprints(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for b in small(batches):
        fps = [fingerprint(x, words) for x in raw(b, "t")]
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(fps, pa.int64())], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """doc_id, fp (long): one row per row of docs."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("t"))
    return rows.mapInArrow(partial(_fingerprints, words=words), kind(docs.select(F.col(id_col).alias("doc_id")), fp="long"))


def balls(radius: int) -> list[int]:
    """XOR masks, as signed integers, of all variants within half the radius."""
    if radius % 2 or radius < 0:
        raise ValueError("the radius must be even: half of it is the radius of the balls")
    masks = [sum(1 << b for b in bits) for k in range(radius // 2 + 1) for bits in itertools.combinations(range(64), k)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(classes: DataFrame, radius: int = 2) -> DataFrame:
    """a, b: links that connect what is connected at radius or fewer differing bits. classes: fp, distinct."""
    variants = classes.select("fp", F.explode(F.array(*(F.lit(m).cast("long") for m in balls(radius)))).alias("m")).select("fp", F.col("fp").bitwiseXOR(F.col("m")).alias("v"))
    before = F.lag("fp").over(Window.partitionBy("v").orderBy("fp"))
    return (
        variants.withColumn("a", before)
        .filter("a is not null and a <> fp")
        .filter(F.bit_count(F.col("a").bitwiseXOR(F.col("fp"))) <= radius)
        .select("a", F.col("fp").alias("b"))
        .distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node of each component, for the nodes of the undirected edges (a, b).

    Each round hooks every node and its root to the smallest grandparent among the neighbours, then jumps
    pointers; rounds grow as the logarithm of the longest path. Each round is written to the shared folder.
    """
    both = written(edges.union(edges.select("b", "a")).toDF("u", "v").distinct(), "links")
    state = written(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("root")), "roots")
    while True:
        f = state.toDF("v", "fv")
        near = both.join(f, "v").select("u", "fv")  # degrees are bounded by the ball, so no key of this join is hot
        low = near.groupBy("u").agg(F.min("fv").alias("low")).join(state.toDF("u", "fu"), "u")
        hooks = low.select(F.col("u").alias("node"), F.least("low", "fu").alias("root")).union(low.select("fu", "low"))
        hooked = written(hooks.groupBy("node").agg(F.min("root").alias("root")), "hooked")
        up = hooked.toDF("root", "up")
        jumped = hooked.join(up, "root", "left").select("node", F.least(F.coalesce("up", "root"), "root").alias("root"))
        after = written(jumped, "roots")
        done = after.join(state.toDF("node", "old"), "node").filter("root <> old").isEmpty()
        discard(hooked, state)
        if done:
            discard(both)
            return after
        state = after


def placed_classes(prints: DataFrame, first: str, radius: int) -> DataFrame:
    """fp, root, first: of each fingerprint of prints, a written table, its component and the least of the column first."""
    classes = written(prints.groupBy("fp").agg(F.min(first).alias("first")), "classes")
    roots = components(links(classes.select("fp"), radius)).withColumnRenamed("node", "fp")
    return written(classes.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first"), "placed")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id that links reach): one row per row of docs."""
    prints = written(fingerprints(docs, id_col, text_col, words), "fingerprints")
    lowest = placed_classes(prints, "doc_id", radius)
    ids = lowest.groupBy("root").agg(F.min("first").alias("component_id"))
    of = written(lowest.select("fp", "root").join(ids, "root").select("fp", "component_id"), "components")
    return prints.join(of, "fp").select("doc_id", "fp", "component_id")  # two plain exchanges: a hot fingerprint is split by the adaptive skew join


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2, stored: bool = False) -> DataFrame:
    """docs with the row of the smallest id of each group, the first by place of rows that tie, all columns as they were.

    Rows without an id stay. Texts are read to be hashed and to be kept, in place. stored: see positioned().
    """
    cols = docs.columns
    placed, file, row = positioned(docs, stored)
    place = F.struct(F.col(id_col).alias("id"), F.col(file).alias("file"), F.col(row).alias("row"))
    prints = fingerprints(placed.filter(F.col(id_col).isNotNull()).select(place.alias("place"), F.col(text_col).alias("text")), "place", "text", words)
    prints = written(prints.withColumnRenamed("doc_id", "place"), "fingerprints")
    stay = placed_classes(prints, "place", radius).groupBy("root").agg(F.min("first").alias("first")).select("first.file", "first.row")
    gone = prints.select("place.file", "place.row").join(stay, ["file", "row"], "left_anti").toDF(file, row)  # by place, so a large group spreads out
    gone = written(gone, "near-copies")
    discard(prints)
    return in_place(placed, gone, file, row, "left_anti", F.lit(0)).select(*cols)
