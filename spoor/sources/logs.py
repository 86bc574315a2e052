"""Trace logs as ordered lines: segments of one log are put together by rank, whatever their splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A segment is <stem>.<rank>.log; its log is known by folder and stem.
SEGMENT = r"^(.*\.)([0-9]+)(\.log)$"


def log_of(path: Column) -> Column:
    stem = F.regexp_extract(path, SEGMENT, 1)
    return F.when(stem != "", F.concat(stem, F.lit("0.log"))).otherwise(path)


def rank_of(path: Column) -> Column:
    rank = F.regexp_extract(path, SEGMENT, 2)
    return F.when(rank != "", rank.cast("long")).otherwise(F.lit(0).cast("long"))


def read_lines(spark: SparkSession, paths: str | list[str], root_name: str | None = None) -> DataFrame:
    """log_id, line_no (0, 1, ... in each log), line.

    A line's place is its segment's rank, its split's offset and its number within the split; counts of the
    splits, which are few, turn that into line numbers without sorting a whole log in one task.
    """
    raw = spark.read.text(paths)
    path, block = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    placed = raw.select(log_of(path).alias("log_id"), rank_of(path).alias("rank"), path.alias("path"), block.alias("block"), F.monotonically_increasing_id().alias("mid"), F.col("value").alias("line"))
    splits = placed.groupBy("log_id", "rank", "path", "block").agg(F.count("*").alias("n"), F.min("mid").alias("first"))
    order = Window.partitionBy("log_id").orderBy("rank", "path", "block").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select("path", "block", "first", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("start"))
    lines = placed.join(starts, ["path", "block"]).select("log_id", (F.col("start") + F.col("mid") - F.col("first")).alias("line_no"), "line")
    return lines if root_name is None else lines.withColumn("root_name", F.lit(root_name))


def stats(lines: DataFrame) -> DataFrame:
    """log_id, lines, bytes (a line's end counts one)."""
    return lines.groupBy("log_id").agg(F.count("*").alias("lines"), F.sum(F.octet_length("line") + 1).cast("long").alias("bytes"))


def read_idl(spark: SparkSession, path: str) -> DataFrame:
    """interface, parent, alias_for, aliases, members, methods, properties, from one JSON object."""
    body = "struct<parent:string,aliasFor:string,aliases:array<string>,members:array<string>,methods:array<string>,properties:array<string>>"
    whole = spark.read.text(path, wholetext=True)
    rows = whole.select(F.explode(F.from_json("value", f"map<string,{body}>")).alias("interface", "d"))
    return rows.select("interface", "d.parent", F.col("d.aliasFor").alias("alias_for"), "d.aliases", "d.members", "d.methods", "d.properties")


def read_entities(spark: SparkSession, path: str) -> DataFrame:
    """domain, display_name, tracking (0 where missing)."""
    whole = spark.read.text(path, wholetext=True)
    rows = whole.select(F.explode(F.from_json("value", "map<string,struct<displayName:string,tracking:double>>")).alias("domain", "e"))
    return rows.select("domain", F.col("e.displayName").alias("display_name"), F.coalesce("e.tracking", F.lit(0.0)).alias("tracking"))


def read_rules(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.text(paths).select(F.col("value").alias("rule"))


def read_suffixes(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """suffix: the rules of a public suffix list, one a line, without comments."""
    rows = spark.read.text(paths).select(F.regexp_extract("value", r"^\s*(\S+)", 1).alias("suffix"))
    return rows.filter("suffix <> '' and suffix not like '//%'")
