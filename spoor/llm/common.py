"""Shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spoor.session import discard, shared_dir, ship, small_batches, table, written

__all__ = ["positioned", "in_place", "prepare", "shared_dir", "table", "written", "discard", "text_of", "texts", "raw", "small", "kind", "fresh"]

#: Bytes of text that a Python worker handles at once; a longer text is handled alone.
PART_BYTES = 1 << 20

#: The ASCII white space of every contract, [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"


def prepare(spark: SparkSession) -> None:
    """Before an operator that runs Python on the executors."""
    ship(spark)
    small_batches(spark)


def text_of(column: str = "text") -> Column:
    """Null texts count as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def kind(df: DataFrame, **more: str) -> str:
    """The schema of df with more columns behind, as mapInArrow takes it."""
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + [f"{k} {v}" for k, v in more.items()])


def small(batches: Iterator[pa.RecordBatch], column: str = "t", most: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds at most so many bytes of the text column, or one row."""
    for b in batches:
        col = b.column(column)
        if col.nbytes <= most or not len(col):
            yield b
            continue
        ends = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(col), 0), np.int64))
        a = 0
        while a < len(ends):
            e = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
            yield b.slice(a, e - a)
            a = e


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return batch.column(column).to_pylist()


def raw(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The UTF-8 of a string column, without decoding it."""
    col = batch.column(column)
    return col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()).to_pylist()


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df hasn't got, for helper columns next to whatever columns it brings."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = f"_{name}"
    return name


#: Bytes of one side that a join broadcasts at most.
BROADCAST_BYTES = 64 << 20


def positioned(docs: DataFrame, stored: bool) -> tuple[DataFrame, str, str]:
    """docs with two columns that say where each row lies, a hash of its file and its number in it; and their names.

    stored: docs is a Parquet table as read, perhaps filtered or with fewer columns, so that its rows have
    lasting places. Any other DataFrame is written to the shared folder first, as is one without places.
    """
    file, row = fresh(docs, "_file"), fresh(docs, "_row")

    def with_places(df: DataFrame) -> DataFrame:
        where = df.metadataColumn("_metadata")
        return df.select("*", F.xxhash64(where["file_path"]).alias(file), where["row_index"].alias(row))

    if stored:
        try:
            return with_places(docs), file, row
        except AnalysisException:
            pass
    return with_places(written(docs, "docs")), file, row


def in_place(docs: DataFrame, side: DataFrame, file: str, row: str, how: str, size: Column) -> DataFrame:
    """docs, as positioned, joined on its places with side (file, row, ...) while its rows stay where they are.

    side is broadcast. If it has over BROADCAST_BYTES, counting size a row, the files of docs are dealt into
    groups, and each group is read by itself and joined with its part of side. A group whose part is over the
    bound too, as when one file has most of the rows, is dealt again by row numbers, counted from another start
    in each file so that rows of the same number come apart, until each part is within it; only files of such
    groups are read more than once. So no more than the bound, or one row, is broadcast at once.
    """
    weight = size + F.lit(64)
    total = side.agg(F.sum(weight)).first()[0] or 0
    k = -(-total // BROADCAST_BYTES)
    if k <= 1:
        return docs.join(F.broadcast(side), [file, row], how)
    group = fresh(docs, "_group")
    of = F.pmod(F.col(file), F.lit(k))
    place = F.pmod(F.xxhash64(file), F.lit(1 << 40)) + F.col(row)
    parts = written(side.withColumn(group, of), "side", by=group)
    out = None
    for i, slices in enumerate(_slices(parts.select(F.col(group).cast("int").alias("g"), place.alias("r"), weight.alias("w")), k)):
        for j in range(slices):
            mine = F.pmod(place, F.lit(slices)) == j
            part = docs.filter((of == i) & mine).join(F.broadcast(parts.filter((F.col(group) == i) & mine).drop(group)), [file, row], how)
            out = part if out is None else out.unionByName(part)
    return out


def _slices(narrow: DataFrame, k: int) -> list[int]:
    """In how many slices, by place r, each of k groups g is within the bound, w being a row's bytes. k numbers a round come to the driver."""
    spark = narrow.sparkSession
    slices, still = [1] * k, list(range(k))
    while still:
        now = spark.createDataFrame([(g, slices[g]) for g in still], "g int, n long")
        loads = narrow.join(F.broadcast(now), "g").groupBy("g", F.pmod("r", "n").alias("slice")).agg(F.sum("w").alias("load"), F.count("*").alias("rows"))
        over = loads.filter((F.col("load") > BROADCAST_BYTES) & (F.col("rows") > 1)).groupBy("g").agg(F.max("load").alias("most")).collect()
        for r in over:
            slices[r.g] *= max(2, -(-r.most // BROADCAST_BYTES))
        still = [r.g for r in over]
    return slices
