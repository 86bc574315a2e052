"""Exact duplicates by two-pass Bloom filtering, with DataFrame functions only.

Pass 1 gives each document a word of a Bloom filter and two bits in it, from a hash of its normalised text,
counts how many documents have each pair of bits, which combines before the shuffle, and keeps the bits of
pairs that at least two have. Pass 2 tests each document against that filter: texts that don't have both
bits can't have a copy and pass straight through; only the rest shuffle on their hash. One group of copies
may hold any share of the rows. The filter has a word for each repeated text at most and is broadcast up to
BROADCAST_WORDS of them; a larger one is cut into slices by its words, the hashes are written by slice, without
a shuffle, and slice after slice is broadcast to its own hashes. So whatever the size, only possible repeats
shuffle. Texts never do: they are read once to be hashed and once to be kept, in place (see in_place()).

Null texts count as empty; empty texts are equal to each other. Very long texts are hashed whole. Of equal
texts the longest original stays, of these the smallest id; a null id loses ties to any other. Rows that
repeat in every column are copies like any other: one stays. Ids keep their type. Extra columns, whatever
their names, are kept by drop_copies() and ignored by groups(). An empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spoor.llm.common import SPACES, discard, fresh, in_place, positioned, shared_dir, text_of, written

#: At most 16 bytes each, so the filter is broadcast up to about 32 MB.
BROADCAST_WORDS = 2_000_000


def normalised(text: Column) -> Column:
    """Without the characters [\\x20\\x09-\\x0D]."""
    for space in SPACES:
        text = F.replace(text, F.lit(space), F.lit(""))
    return text


def digest(text_col: str) -> Column:
    return F.sha2(normalised(text_of(text_col)).cast("binary"), 256)


def _word(h: Column, words: int) -> Column:
    return h.bitwiseAND(F.lit(words - 1).cast("long"))


def _bits(h: Column) -> Column:
    """Two of the 64 bits of a word, by bits of the hash that _word() doesn't look at."""
    one, two = (F.shiftrightunsigned(h, 40 + 6 * k).bitwiseAND(F.lit(63).cast("long")).cast("int") for k in (0, 1))
    return F.call_function("shiftleft", F.lit(1).cast("long"), one).bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), two))


def repeated_bits(hashes: DataFrame, words: int) -> DataFrame:
    """word, bits: the filter of the hashes (h) that at least two rows have."""
    pairs = hashes.select(_word(F.col("h"), words).alias("word"), _bits(F.col("h")).alias("pair")).groupBy("word", "pair").count().filter("count > 1")
    return pairs.groupBy("word").agg(F.bit_or("pair").alias("bits"))


def flagged(rows: DataFrame, name: str) -> DataFrame:
    """rows, a written table with hash h, with the boolean column name: false only where no other row has the same h."""
    words = 1 << max(10, (rows.count() // 2).bit_length())  # two rows a word, 32 bits a row
    bloom = written(repeated_bits(rows.select("h"), words), "bloom")
    n = bloom.count()
    placed = rows.withColumn("word", _word(F.col("h"), words))
    pair = _bits(F.col("h"))

    def tested(part: DataFrame, side: DataFrame) -> DataFrame:
        hit = part.join(F.broadcast(side), "word", "left")
        return hit.withColumn(name, F.coalesce(F.col("bits").bitwiseAND(pair) == pair, F.lit(False))).select(*rows.columns, name)

    if n <= BROADCAST_WORDS:
        return tested(placed, bloom)
    # Words are of a hash, so twice as many slices as needed on average are never too few.
    slices = min(words, 1 << (2 * n // max(1, BROADCAST_WORDS) - 1).bit_length())
    of = F.pmod("word", F.lit(slices))
    spark, at = rows.sparkSession, f"{shared_dir(rows.sparkSession)}/slices-{uuid.uuid4().hex}"
    placed.withColumn("slice", of).write.partitionBy("slice").parquet(f"{at}/in")
    parts = spark.read.schema(placed.withColumn("slice", F.lit(0)).schema).parquet(f"{at}/in")
    out = tested(placed, bloom).schema
    for i in range(slices):
        tested(parts.filter(F.col("slice") == i).drop("slice"), bloom.filter(of == i)).write.mode("append").parquet(f"{at}/out")
    return spark.read.schema(out).parquet(f"{at}/out")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the most code points, then the smallest id, stays.
    """
    seen = docs.select(F.col(id_col).alias("doc_id"), F.char_length(text_of(text_col)).alias("n"), digest(text_col).alias("text_sha256"))
    seen = written(seen.withColumn("h", F.xxhash64("text_sha256")).withColumn("rid", F.monotonically_increasing_id()), "digests")
    tested = flagged(seen, "maybe")
    alone = tested.filter("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    maybe = tested.filter("maybe").select("doc_id", "n", "text_sha256", "rid")
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), "rid"))
    of = written(maybe.groupBy("text_sha256").agg(best.alias("best"), F.count("*").alias("group_size")), "groups")
    joined = maybe.join(of, "text_sha256")  # both sides are plain exchanges, so a hot group is split by the adaptive skew join
    return alone.unionByName(joined.select("doc_id", F.col("best.id").alias("keep_id"), "group_size", (F.col("rid") == F.col("best.rid")).alias("kept"), "text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stored: bool = False) -> DataFrame:
    """docs with one row of each group of equal texts, all its columns as they were. stored: see positioned()."""
    cols = docs.columns
    placed, file, row = positioned(docs, stored)
    seen = placed.select(F.col(file).alias("file"), F.col(row).alias("row"), F.col(id_col).alias("id"), F.char_length(text_of(text_col)).alias("n"), F.unhex(digest(text_col)).alias("sha"))
    seen = written(seen.withColumn("h", F.xxhash64("sha")), "digests")
    maybe = flagged(seen, "maybe").filter("maybe").select("sha", "n", "id", "file", "row")
    maybe = written(maybe, "maybe")
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("id").isNull().alias("no_id"), "id", "file", "row"))
    stay = maybe.groupBy("sha").agg(best.alias("best")).select("best.file", "best.row")
    gone = maybe.join(stay, ["file", "row"], "left_anti").select(F.col("file").alias(file), F.col("row").alias(row))  # by place, so a large group spreads out
    gone = written(gone, "copies")
    discard(seen, maybe)
    return in_place(placed, gone, file, row, "left_anti", F.lit(0)).select(*cols)
