"""Merkle manifest of a dataset: a tree of hashes for each group of rows, one above them, and a proof for each row.

A row's leaf is the SHA-256 of its fields. Leaves of a group are in order of their ids; every 8 consecutive
nodes of a level become the hash of their hexadecimal digests, one after another, until one is left. Subroots,
in order of their groups, likewise make the root.

The variant is that of a broadcast upper tree. Leaves are sorted by ranges and numbered from counts of the
ranges, so that no task sorts a group. Blocks of 8 ** k consecutive leaves are each reduced to a node of level
k in one task and written as a row; k is the least with which about TOP blocks are left. Only those nodes
reach the driver, which builds the small top tree and broadcasts each block's path from there to the root (paths
share the runs they go through). Executors then read the blocks again and finish the proofs row by row, and
fold a leaf with its proof into the root that it claims. A group with a third of all rows is many blocks.

Null fields have a mark of their own, null ids come first in order and null groups are a group, the first.
Empty and very long texts are hashed whole. Rows that tie in their ids are in order of their leaves; rows that
repeat are leaves of their own. Ids keep their type; extra columns are ignored. An empty table gives an empty
result. Over MAX_TOP groups raise, as their subroots are the top tree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoor.llm.common import discard, prepare, written

FAN = 8
#: Blocks to aim at; nodes that the driver takes at most; leaves of a block at most, as a power of FAN.
TOP, MAX_TOP, DEEPEST = 4096, 262_144, 7
#: Rows of a result batch, each with a proof of some KB.
ROWS = 512
#: Bytes of a leaf's row in a shuffle, about, and of a range of them.
LEAF_BYTES, RANGE_BYTES = 160, 128 << 20


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(fields: Sequence[Column]) -> Column:
    """Hexadecimal SHA-256 of each field's UTF-8 length, a colon and its value, one after another; - for a null."""
    parts = []
    for f in fields:
        s = f.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def above(nodes: list[str]) -> list[str]:
    """The next level: the hash of each run of FAN nodes."""
    return [digest("".join(nodes[i : i + FAN])) for i in range(0, len(nodes), FAN)]


def n_levels(n: int) -> int:
    """Levels above n nodes until one is left."""
    out = 0
    while n > 1:
        n, out = -(-n // FAN), out + 1
    return out


def fold(node: str, proof: Sequence[str], places: Sequence[int]) -> str:
    """The root that a node and its proof make: at each level, the others of its run around it."""
    for others, place in zip(proof, places, strict=True):
        at = 64 * place
        node = digest(others[:at] + node + others[at:])
    return node


def siblings(nodes: list[str], i: int) -> tuple[str, int]:
    """The others of node i's run, one after another, and its place in the run."""
    a = i - i % FAN
    run = nodes[a : a + FAN]
    return "".join(run[: i - a] + run[i - a + 1 :]), i - a


def climbed(nodes: list[str]) -> tuple[str, list[list[tuple[str, int]]]]:
    """The root of a list of nodes, and the path of each to it. Paths share their parts."""
    paths: list[list[tuple[str, int]]] = [[] for _ in nodes]
    size = 1
    while len(nodes) > 1:
        steps = [siblings(nodes, i) for i in range(len(nodes))]
        for i, path in enumerate(paths):
            path.append(steps[i // size])
        nodes, size = above(nodes), size * FAN
    return nodes[0], paths


def top_tree(blocks: dict[int, list[str]]) -> tuple[str, dict[int, str], dict[tuple[int, int], list[tuple[str, int]]]]:
    """The root, the subroot of each tree, and the path of each (tree, block) to the root."""
    under = {t: climbed(nodes) for t, nodes in sorted(blocks.items())}
    subroots = {t: root for t, (root, _) in under.items()}
    root, over = climbed(list(subroots.values()))
    return root, subroots, {(t, b): path + up for (t, (_, paths)), up in zip(under.items(), over, strict=True) for b, path in enumerate(paths)}


BLOCK = pa.schema([("tree", pa.int32()), ("block", pa.int64()), ("levels", pa.int32()), ("node", pa.string())])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted leaves -> a row for each block: its leaves together, and the node they are reduced to."""
    key, held, id_type = None, ([], [], []), None

    def row() -> pa.RecordBatch:
        ids, leaves, claims = held
        nodes = leaves
        for _ in range(key[2]):
            nodes = above(nodes)
        values = [*([x] for x in key), nodes, [ids], [leaves], [claims]]
        kinds = [*(f.type for f in BLOCK), pa.list_(id_type), pa.list_(pa.string()), pa.list_(pa.string())]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds, strict=True)], [*BLOCK.names, "ids", "leaves", "claims"])

    for b in batches:
        id_type = b.schema.field("id").type
        for tree, block, levels, *values in zip(*(b.column(c).to_pylist() for c in ("tree", "block", "levels", "id", "leaf", "claim")), strict=True):
            if key != (tree, block, levels):
                if key is not None:
                    yield row()
                key, held = (tree, block, levels), ([], [], [])
            for column, x in zip(held, values, strict=True):
                column.append(x)
    if key is not None:
        yield row()


def _proofs(batches: Iterator[pa.RecordBatch], top) -> Iterator[pa.RecordBatch]:
    """Each leaf of each block with its proof, and what it folds to."""
    for b in batches:
        if not b.num_rows:
            continue
        root, subroots, paths = top.value
        id_type = b.schema.field("ids").type.value_type
        kinds = id_type, *[pa.string()] * 3, pa.list_(pa.string()), pa.list_(pa.int32()), pa.string()
        names = "id", "leaf", "subroot", "root", "proof", "places", "folded_root"
        for tree, block, levels, ids, leaves, claims in zip(*(b.column(c).to_pylist() for c in ("tree", "block", "levels", "ids", "leaves", "claims")), strict=True):
            steps, nodes = [], leaves
            for _ in range(levels):
                steps.append([siblings(nodes, i) for i in range(len(nodes))])
                nodes = above(nodes)
            rest, rows = paths[tree, block], []
            for i, (own, one, claim) in enumerate(zip(ids, leaves, claims, strict=True)):
                path = [level[i // FAN**k] for k, level in enumerate(steps)] + rest
                proof, places = [p[0] for p in path], [p[1] for p in path]
                rows.append((own, one, subroots[tree], root, proof, places, fold(one if claim is None else claim, proof, places)))
                if len(rows) >= ROWS or i == len(ids) - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], list(names))
                    rows = []


def _numbered(leaves: DataFrame) -> tuple[DataFrame, int]:
    """leaves (id, grp, leaf, claim) with tree (of the group), rank in the tree, levels; and the k of its blocks."""
    spark = leaves.sparkSession
    order = [F.col("grp").asc_nulls_first(), F.col("id").asc_nulls_first(), "leaf"]
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-leaves.count() * LEAF_BYTES // RANGE_BYTES))
    placed = leaves.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("mid", F.monotonically_increasing_id())
    placed = written(placed, "placed").withColumn("part", F.shiftright("mid", 33))
    runs = placed.groupBy("grp", "part").agg(F.count("*").alias("n"), F.min("mid").alias("first")).limit(MAX_TOP + ranges + 1).collect()  # one a group and range
    groups: dict[str | None, int] = {}
    for r in runs:
        groups[r["grp"]] = groups.get(r["grp"], 0) + r["n"]
    k = 2
    while k < DEEPEST and sum(-(-n // FAN**k) for n in groups.values()) > max(TOP, len(groups)):
        k += 1
    if len(runs) > MAX_TOP + ranges or sum(-(-n // FAN**k) for n in groups.values()) > MAX_TOP:
        raise ValueError(f"over {MAX_TOP} nodes in the top tree")
    tree = {g: i for i, g in enumerate(sorted(groups, key=lambda g: (g is not None, (g or "").encode())))}
    starts, so_far = [], dict.fromkeys(groups, 0)
    for r in sorted(runs, key=lambda r: r["part"]):
        starts.append((r["grp"], r["part"], tree[r["grp"]], so_far[r["grp"]] - r["first"], min(k, n_levels(groups[r["grp"]]))))
        so_far[r["grp"]] += r["n"]
    side = F.broadcast(spark.createDataFrame(starts, "g string, p long, tree int, shift long, levels int"))
    rows = placed.join(side, F.col("grp").eqNullSafe(F.col("g")) & (F.col("part") == F.col("p")))
    return rows.select("tree", "levels", (F.col("mid") + F.col("shift")).alias("rank"), "id", "leaf", "claim"), k


def manifest(leaves: DataFrame) -> DataFrame:
    """id, leaf, subroot, root, proof, places, folded_root, verified of leaves (id, grp, leaf, claim): one row per row.

    grp: a string, the group whose tree the row is in. claim: a leaf recomputed from a row that may have changed,
    null for the leaf itself; folded_root is what it makes with the proof of the original. proof: at each level
    the digests of the others of the run, one after another; places: the row's own place among them. See fold().
    """
    spark = leaves.sparkSession
    prepare(spark)
    leaves = written(leaves.select("id", F.col("grp").cast("string").alias("grp"), "leaf", "claim"), "leaves")
    id_type = leaves.schema["id"].dataType.simpleString()
    ranked, k = _numbered(leaves)
    dealt = ranked.withColumn("block", F.shiftright("rank", 3 * k)).repartition("tree", "block").sortWithinPartitions("tree", "block", "rank")
    blocks = written(dealt.mapInArrow(_blocks, f"tree int, block long, levels int, node string, ids array<{id_type}>, leaves array<string>, claims array<string>"), "blocks")
    discard(leaves)
    nodes: dict[int, list[str]] = {}
    for r in sorted(blocks.select("tree", "block", "node").collect(), key=lambda r: (r["tree"], r["block"])):  # MAX_TOP at most
        nodes.setdefault(r["tree"], []).append(r["node"])
    top = spark.sparkContext.broadcast(top_tree(nodes) if nodes else None)
    rows = blocks.drop("node").mapInArrow(partial(_proofs, top=top), f"id {id_type}, leaf string, subroot string, root string, proof array<string>, places array<int>, folded_root string")
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def document_leaves(docs: DataFrame, changed: dict[str, Column] | None = None, when: Column | None = None, fields: Sequence[str] = FIELDS, id_col: str = "doc_id", group_col: str = "lang") -> DataFrame:
    """id, grp, leaf, claim of documents. claim: the leaf with the fields of changed replaced, of rows for which when holds."""
    cols = [F.col(f) for f in fields]
    claim = F.lit(None).cast("string")
    if changed:
        claim = F.when(F.coalesce(when if when is not None else F.lit(True), F.lit(False)), leaf([changed.get(f, F.col(f)) for f in fields]))
    return docs.select(F.col(id_col).alias("id"), F.col(group_col).cast("string").alias("grp"), leaf(cols).alias("leaf"), claim.alias("claim"))
