"""Passes written as user code that sees a log's records one after another, with their context.

A pass is an object with a state: start() makes it, step() takes it and a record and gives it back with any rows
to put out, finish() may put out more at the end of a log. Records come in the order of the log, whatever its
length: a log is cut into blocks of lines, each block is sorted and streamed in one task, and states go from
block to block.

A pass that can put two states together (combine) is run in two scans: one gives each block's own state, a
running combination of these, one small row a block, gives the state at the start of each block, and the
second scan puts out rows. Blocks of one log then run side by side. A pass that can't is run block after block: all
logs' first blocks, then their second ones, and so on, each round written before the next. Blocks are cut by how
many lines a log has there, so gaps in the numbers of lines make no rounds: that takes as many rounds as the longest
log has blocks' worth of lines, but never holds more than a block. A round reads its own lines and the states that
the round before it left, nothing else.

Keys may be null; a null is a key like any other. Lines that tie in order come in any order. An empty table
gives an empty result. Passes travel to the workers by pickling: a class of a module must be importable there
(SparkContext.addPyFile), unless its module is registered to be pickled by value.
"""

from __future__ import annotations

import pickle
import uuid
from collections import namedtuple
from collections.abc import Iterable, Iterator
from functools import partial, reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from spoor.session import shared_dir, ship, small_batches, written

#: Lines of a block.
BLOCK = 1_000_000
#: Rows of a batch that a worker puts out.
ROWS = 8192


class RecordPass:
    """What a user's pass inherits from. output: the columns it puts out, as DDL; columns: those of a record that it reads."""

    output: str
    columns: tuple[str, ...] = ("line_no", "op", "fields", "isolate", "script_id", "origin")

    def start(self) -> Any:
        """The state before a log's first record."""
        return None

    def step(self, state: Any, record: Any) -> tuple[Any, Iterable[tuple]]:
        """The state after a record, and rows to put out for it."""
        raise NotImplementedError

    def finish(self, state: Any) -> Iterable[tuple]:
        """Rows to put out after a log's last record."""
        return ()

    #: combine(before, after): the state after two stretches of records, each folded from start(). None if there is no such thing.
    combine = None


def _groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[bool, tuple, tuple]]:
    """(whether another block or log begins, its keys and block, the rest of the row) of rows sorted by these."""
    now = None
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            key = row[: n_keys + 1]
            yield key != now, key, row[n_keys + 1 :]
            now = key


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _fold(batches: Iterator[pa.RecordBatch], work: RecordPass, n_keys: int, schema: pa.Schema, puts_out: bool, states: bool) -> Iterator[pa.RecordBatch]:
    """Sorted rows (keys, block, order, state, columns) -> rows (keys, block, output, state). A row with a state is what its block starts from."""
    record = namedtuple("Record", work.columns)
    nothing = (None,) * (len(schema) - n_keys - 2)
    out: list[tuple] = []
    now, state = None, None
    for new, key, (_, given, *values) in _groups(batches, n_keys):
        if new:
            if now is not None and states:
                out.append((*now, *nothing, pickle.dumps(state)))
            now, state = key, work.start()
        if given is not None:
            state = pickle.loads(given)
            continue
        state, rows = work.step(state, record(*values))
        if puts_out:
            out += ((*key, *row, None) for row in rows)
        if len(out) >= ROWS:
            yield _batch(out, schema)
            out = []
    if now is not None and states:
        out.append((*now, *nothing, pickle.dumps(state)))
    if out:
        yield _batch(out, schema)


def _carried(batches: Iterator[pa.RecordBatch], work: RecordPass, n_keys: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Sorted states of blocks (keys, block, state) -> for each block, the state of all before it in its log."""
    out: list[tuple] = []
    log, before = None, None
    for _, key, (state,) in _groups(batches, n_keys):
        own = pickle.loads(state)
        if log == key[:-1] and log is not None:
            out.append((*key, pickle.dumps(before)))
            before = work.combine(before, own)
        else:
            log, before = key[:-1], own
        if len(out) >= ROWS:
            yield _batch(out, schema)
            out = []
    if out:
        yield _batch(out, schema)


def _finished(batches: Iterator[pa.RecordBatch], work: RecordPass, n_keys: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for _, key, (state,) in _groups(batches, n_keys):
        if rows := [(*key[:-1], *row) for row in work.finish(pickle.loads(state))]:
            yield _batch(rows, schema)


def _same(keys: tuple[str, ...]) -> Column:
    """That keys are those of a side that has them as _k0, _k1, ..."""
    return reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_k{j}")) for j, k in enumerate(keys)), F.lit(True))


def _rounds(table: DataFrame, keys: tuple[str, ...], block: int) -> tuple[DataFrame, DataFrame | None]:
    """(table, written, with _block counted from 0 in each log; keys and _block of the logs that have several, or None where none has).

    Stretches of block numbers with a line or more are put together until they hold block lines; a block has less than twice that, but for ties.
    """
    b = "_block"
    table = written(table, "records")
    lines = table.groupBy(*keys, b).agg(F.count("*").alias("_n"))
    log, so_far = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(F.col(b).asc_nulls_first())
    summed = lines.withColumns({"_all": F.sum("_n").over(log), "_cut": F.floor((F.sum("_n").over(so_far.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1) / block)})
    long = summed.filter(F.col("_all") > block)
    nth = (F.dense_rank().over(log.orderBy("_cut")) - 1).cast("long")
    cuts = written(long.select(*(F.col(k).alias(f"_k{j}") for j, k in enumerate(keys)), F.col(b).alias("_of"), nth.alias("_nth")), "cuts")
    if cuts.isEmpty():
        return table.withColumn(b, F.lit(0).cast("long")), None
    numbered = table.join(cuts, _same(keys) & F.col(b).eqNullSafe(F.col("_of")), "left").withColumn(b, F.coalesce("_nth", F.lit(0).cast("long"))).select(*table.columns)
    parts = written(numbered, "blocks", by=b, split=True).select(*table.columns)
    return parts, cuts.select(*(F.col(f"_k{j}").alias(k) for j, k in enumerate(keys)), F.col("_nth").alias(b)).distinct()


def run_records(rows: DataFrame, work: RecordPass, keys: tuple[str, ...] = ("log_id",), order: str = "line_no", block: int = BLOCK) -> DataFrame:
    """keys and the output of work over rows, each log (keys) in the order of a column of whole numbers."""
    spark = rows.sparkSession
    ship(spark)
    small_batches(spark)
    n, b = len(keys), "_block"
    key_fields = rows.select(*keys).schema
    output = _parse_datatype_string(work.output)
    kind = StructType([*key_fields, *_parse_datatype_string(f"{b} long"), *output, *_parse_datatype_string("_state binary")])
    carry_kind = StructType([*key_fields, *_parse_datatype_string(f"{b} long, _state binary")])
    final_kind = StructType([*key_fields, *output])
    arrow, carry_arrow, final_arrow = map(to_arrow_schema, (kind, carry_kind, final_kind))
    ends = type(work).finish is not RecordPass.finish
    table = rows.select(*keys, F.floor(F.col(order) / block).alias(b), F.col(order).alias("_order"), F.lit(None).cast("binary").alias("_state"), *(F.col(c).alias(f"_c{i}") for i, c in enumerate(work.columns)))

    def starting(states: DataFrame) -> DataFrame:
        """States as the first row of their blocks."""
        return states.select(*keys, b, F.lit(None).cast(table.schema["_order"].dataType).alias("_order"), "_state", *(F.lit(None).cast(table.schema[f"_c{i}"].dataType).alias(f"_c{i}") for i in range(len(work.columns))))

    def folded(part: DataFrame, puts_out: bool, states: bool, path: str | None = None) -> DataFrame:
        dealt = part.repartition(*keys, b).sortWithinPartitions(*keys, b, F.col("_order").asc_nulls_first())
        return written(dealt.mapInArrow(partial(_fold, work=work, n_keys=n, schema=arrow, puts_out=puts_out, states=states), kind), "fold", path=path)

    if work.combine is not None:
        own = folded(table, False, True).select(*keys, b, "_state")
        sorted_states = own.repartition(*keys).sortWithinPartitions(*keys, b)  # a row a block, streamed
        carried = written(sorted_states.mapInArrow(partial(_carried, work=work, n_keys=n, schema=carry_arrow), carry_kind), "carried")
        found = folded(table.unionByName(starting(carried)), True, ends)
    else:
        parts, cuts = _rounds(table, keys, block)
        if cuts is None:
            found = folded(parts, True, ends)
        else:
            at, part = f"{shared_dir(spark)}/fold-{uuid.uuid4().hex}", parts.filter(F.col(b) == 0)
            for i in range(cuts.agg(F.max(b)).first()[0] + 1):  # as many as the longest log has blocks
                now = folded(part, True, True, f"{at}/{i:06}")
                more = cuts.filter(F.col(b) == i + 1).select(*(F.col(k).alias(f"_k{j}") for j, k in enumerate(keys))).distinct()
                last = now.filter("_state is not null").join(more, _same(keys), "left_semi")
                part = parts.filter(F.col(b) == i + 1).unionByName(starting(last.withColumn(b, F.lit(i + 1).cast("long"))))
            found = spark.read.schema(kind).parquet(f"{at}/*")
    out = found.filter("_state is null").select(*keys, *output.names)
    if ends:
        last = found.filter("_state is not null").groupBy(*keys).agg(F.max(b).alias(b), F.max_by("_state", b).alias("_state"))
        out = out.unionByName(last.mapInArrow(partial(_finished, work=work, n_keys=n, schema=final_arrow), final_kind))
    return out
