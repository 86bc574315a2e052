"""Joins by order: the last row before a time, and intervals that hold a point or meet another.

Neither compares all pairs. An as-of join is one union of both sides in the order of a key, cut into blocks of that
order where a key may be long: each block carries its last row of the right side to the next ones. An interval
join deals both sides into bins of a width and compares only what shares a bin; each pair is given by the bin
where the later of both begins, once. Null keys and orders meet nothing; of right rows that tie the one with the greatest values
comes last. Repeated rows are repeated; empty tables give what the kind of join gives without matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoor.plans.context import carry_last
from spoor.session import written


def asof(left: DataFrame, right: DataFrame, keys: list[str], left_on: str, right_on: str, bring: list[str], within: Column | None = None, block: int | None = None) -> DataFrame:
    """left with the columns of bring of the last row of right whose right_on isn't after left_on, by keys; null without one.

    within: a condition on left_on and right_on, such as how far back a row may lie. block: rows of both sides that a task
    holds at most of a key, give or take ties; without it, a key is one window.
    """
    cols = left.columns
    got = F.struct(F.col(right_on).alias("_on"), *bring)
    rows = left.withColumns({"_at": F.col(left_on), "_side": F.lit(1), "_got": F.lit(None).cast(right.select(got.alias("g")).schema["g"].dataType)})
    other = right.filter(F.col(right_on).isNotNull()).select(*keys, F.col(right_on).alias("_at"), F.lit(0).alias("_side"), got.alias("_got"))
    none = [F.lit(None).cast(left.schema[c].dataType).alias(c) for c in cols if c not in keys]
    both = rows.unionByName(other.select(*keys, *none, "_at", "_side", "_got"))
    for k in keys:
        both = both.withColumn("_got", F.when(F.col(k).isNotNull(), F.col("_got")))
    order = [F.col(c).asc_nulls_first() for c in ("_at", "_side", "_got")]
    if block is None:
        both = both.withColumn("_place", F.struct("_at", "_side", "_got"))
    else:
        both = _numbered(both, keys, order).withColumnRenamed("_nth", "_place")
    filled = carry_last(both, keys, "_place", F.col("_got"), "_last", block).filter("_side = 1")
    ok = F.col("_at").isNotNull()
    if within is not None:
        ok = ok & F.coalesce(within, F.lit(False))
    plain = filled.withColumn(right_on, F.col("_last._on")) if within is not None and right_on not in cols else filled
    return plain.select(*cols, *(F.when(ok, F.col(f"_last.{c}")).alias(c) for c in bring))


def _numbered(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """rows with _nth, their number in the order of their keys, by ranges and the ranges' counts: no task sorts a key."""
    dealt = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_mid", F.monotonically_increasing_id())
    return written(dealt, "ordered").withColumnRenamed("_mid", "_nth")


def _bins(start: Column, end: Column, width: int | float) -> Column:
    return F.explode(F.sequence(F.floor(start / width), F.floor(end / width)))


def in_intervals(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, start: str, end: str, width: int | float) -> DataFrame:
    """points joined with every interval (start to end, end not included) of the same keys that holds at, numbers all.

    width: that of a bin; about the length of an interval. An interval is in as many bins as it touches; those that end before they start hold nothing.
    """
    binned = intervals.filter(F.col(start) < F.col(end)).withColumn("_bin", _bins(F.col(start), F.col(end), width))
    rows = points.withColumn("_bin", F.floor(F.col(at) / width))
    return rows.join(binned, [*keys, "_bin"]).filter((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_bin")


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], left_span: tuple[str, str], right_span: tuple[str, str], width: int | float) -> DataFrame:
    """Pairs of intervals of the same keys that have a point in common, each once."""
    (a, b), (c, d) = left_span, right_span
    one = left.filter(F.col(a) < F.col(b)).withColumn("_bin", _bins(F.col(a), F.col(b), width))
    two = right.filter(F.col(c) < F.col(d)).withColumn("_bin", _bins(F.col(c), F.col(d), width))
    later = F.greatest(F.col(a), F.col(c))
    met = (F.col(a) < F.col(d)) & (F.col(c) < F.col(b)) & (F.floor(later / width) == F.col("_bin"))
    return one.join(two, [*keys, "_bin"]).filter(met).drop("_bin")
