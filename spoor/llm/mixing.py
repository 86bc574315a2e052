"""Mixing sources to target weights by entropy balancing, with DataFrame functions only.

Each source's token target is a constraint. The document rates nearest to 1 in relative entropy, under the
constraints and a cap, are exponentially tilted: rate = min(cap, exp(lambda[source] * size / mean size)).
The dual in lambda is convex; its gradient and curvature are sums over a histogram of sizes, so a Newton
iteration is one aggregation that combines before its shuffle, kept inside a bracket that each step
narrows. Sums are of decimals, so reruns give the same rates to the last bit. Rates become whole copies by a
hash of the document, and the words still missing or over are settled by documents of falling sizes, a few of
each order of size and source, in one pass.

A null text has size 0; a null source is a source of its own and comes last; very long texts count whole.
Rows that repeat id, source and size are one unit: all get the same copies. Documents that tie in size go by a
hash of their id, then the id. Documents without words are taken 0 words. Ids keep their type; extra columns
are kept by copies() and ignored by the rest. An empty table gives an empty result.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spoor.llm.common import discard, fresh, text_of, written

CAP = 2.0
#: Newton steps at most; if a source is further than OFF from its target then, tilts() warns.
STEPS = 150
OFF = 1e-6
#: Tilts are between this and its negative: more than any document of one word needs to be taken cap times.
BRACKET = 2.0**40
#: Documents of one source and order of size that may settle what rounding leaves.
EACH_ORDER = 4
#: Rows of a table with a few rows for each source that are broadcast at most.
BROADCAST_ROWS = 200_000
#: What sums are of: exact, and so the same in any order.
EXACT = "decimal(38,9)"


def size_of(text: Column) -> Column:
    """The number of runs of anything but [\\x20\\x09-\\x0D]."""
    return F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def targets(sizes: DataFrame, weights: list[float], share: float = 1.5, cap: float = CAP) -> DataFrame:
    """source, source_size, target, for sizes: source, source_size.

    Weights go to the sources by code point, null last, and repeat. Targets share out share times all sizes;
    what a source can't hold (cap times its size) is shared out again by weight until none is above. Sources
    are numbered over ranges of them, and each round of sharing out is one aggregation, so there may be many.
    """
    order = F.col("source").isNull(), F.col("source").cast("binary")
    ranged = written(sizes.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "sources")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    before = ranged.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    k = F.row_number().over(Window.partitionBy("part").orderBy(*order)) + F.col("before") - 1
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.pmod(k, F.lit(len(weights))) + 1).cast("int"))
    rows = ranged.join(F.broadcast(before), "part").select("source", "source_size", w.alias("w"), (F.col("source_size") * F.lit(cap)).alias("most"))
    rows = written(rows, "weights")
    level, filled = float("-inf"), -1
    while True:
        full = F.col("most") <= F.lit(level) * F.col("w")
        got = rows.agg(
            F.sum("source_size").alias("all"), F.sum(F.when(full, F.col("most").cast(EXACT))).alias("held"), F.sum(F.when(~full, F.col("w").cast(EXACT))).alias("w"), F.count(F.when(full, 1)).alias("n")
        ).first()
        if got["n"] == filled or not got["w"]:
            break
        filled, level = got["n"], (share * (got["all"] or 0) - float(got["held"] or 0)) / float(got["w"])
    full = F.col("most") <= F.lit(level) * F.col("w") if got["w"] else F.lit(True)
    return rows.select("source", "source_size", F.when(full, F.col("most")).otherwise(F.lit(level) * F.col("w")).alias("target"))


def units(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """source, doc_id, size, m: how many rows have these three."""
    rows = docs.select(F.col(source_col).alias("source"), F.col(id_col).alias("doc_id"), size_of(text_of(text_col)).alias("size"))
    return rows.groupBy("source", "doc_id", "size").agg(F.count("*").alias("m"))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def tilts(hist: DataFrame, goal: DataFrame, cap: float = CAP) -> DataFrame:
    """source, source_size, target, mean, lam: the tilt of each source, by Newton steps in a bracket.

    hist: source, size, n. goal: source, source_size, target. A source whose target is all it can hold, or
    nothing, needs no tilt: lam is null and the rate is cap or 0.
    """
    mean = hist.groupBy("source").agg(F.try_divide(F.sum(F.col("size") * F.col("n")), F.sum(F.when(F.col("size") > 0, F.col("n")))).alias("mean"))
    start = goal.join(mean.withColumnRenamed("source", "s"), _same("source", "s"), "left").drop("s")
    loose = (F.col("target") > 0) & (F.col("target") < F.col("source_size") * F.lit(cap))
    guess = F.ln(F.try_divide("target", "source_size"))  # right if all documents were of the mean size
    start = start.withColumns({"lam": F.when(loose, guess), "low": F.lit(-BRACKET), "high": F.lit(BRACKET), "off": F.lit(1.0)})
    state = written(start, "tilts")
    few = state.count() <= BROADCAST_ROWS
    for _ in range(STEPS // 3):
        old, after = state, state
        for _ in range(3):
            after = _newton(hist, after, few, cap)
        state = written(after, "tilts")
        discard(old)
        if not (state.agg(F.max("off")).first()[0] or 0.0) > OFF:
            break
    else:
        warnings.warn(f"after {STEPS} steps the tilts of some sources are over {OFF:g} off their targets; settling does the rest", stacklevel=2)
    return state.select("source", "source_size", "target", "mean", "lam")


def _newton(hist: DataFrame, state: DataFrame, few: bool, cap: float) -> DataFrame:
    """state after one step: one aggregation of the histogram; off is how far the tilt it began with was."""
    size = F.col("size").cast("double")
    x = size / F.col("mean")
    rate = F.exp(F.least(F.col("lam") * x, F.lit(50.0)))
    loose = state.filter("lam is not null").select(F.col("source").alias("s"), "lam", "mean")
    sums = (
        hist.join(F.broadcast(loose) if few else loose, _same("source", "s"))
        .groupBy("s")
        .agg(
            F.sum((F.col("n") * size * F.least(rate, F.lit(cap))).cast(EXACT)).cast("double").alias("now"), F.sum(F.when(rate < cap, F.col("n") * size * x * rate).otherwise(0.0).cast(EXACT)).cast("double").alias("slope")
        )
    )
    joined = state.join(sums, _same("source", "s"), "left").drop("s")
    lam, gap = F.col("lam"), F.col("target") - F.col("now")
    low, high = F.when(gap > 0, lam).otherwise(F.col("low")), F.when(gap < 0, lam).otherwise(F.col("high"))
    step = lam + F.try_divide(gap, F.col("slope"))
    inside = (F.col("slope") > 0) & (step > low) & (step < high)
    off = F.try_divide(F.abs(gap), F.col("target"))
    after = F.when(off < 1e-9, lam).when(lam.isNotNull(), F.when(inside, step).otherwise((low + high) / 2))
    return joined.select("source", "source_size", "target", "mean", after.alias("lam"), low.alias("low"), high.alias("high"), off.alias("off"))


def rate_of(size: Column, cap: float = CAP) -> Column:
    """Copies a document is due, from columns target, mean, lam of its source."""
    tilted = F.least(F.exp(F.least(F.col("lam") * size / F.col("mean"), F.lit(50.0))), F.lit(cap))
    return F.when(size == 0, F.lit(0.0)).when(F.col("lam").isNotNull(), tilted).when(F.col("target") > 0, F.lit(cap)).otherwise(F.lit(0.0))


def rounded(rate: Column, doc_id: Column, size: Column) -> Column:
    """Copies: the whole part of the rate, and one more with the rest as chance, by a hash of the document."""
    chance = F.pmod(F.xxhash64(F.lit("copies"), doc_id.cast("string"), size), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return (F.floor(rate) + F.when(chance < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def settled(parts: DataFrame, tilt: DataFrame, cap: float = CAP) -> DataFrame:
    """source, doc_id, size, step (1 or -1): changes to whole copies that bring each source near its target.

    parts: source, doc_id, size, m, copies. What may change is a few documents of each source and order of
    size, those of the smallest hashes. From the largest to the smallest, each changes if no more than its
    words are missing or over.
    """
    now = parts.groupBy(F.col("source").alias("s")).agg(F.sum(F.col("copies") * F.col("size") * F.col("m")).alias("taken"))
    state = written(tilt.join(now, _same("source", "s")).select(F.col("source").alias("s"), (F.col("target") - F.col("taken")).alias("gap")), "gaps")
    mass = F.col("size") * F.col("m")
    near = parts.join(F.broadcast(state) if state.count() <= BROADCAST_ROWS else state, _same("source", "s"))
    can = ((F.col("gap") > 0) & (F.col("copies") < cap) | (F.col("gap") < 0) & (F.col("copies") > 0)) & (mass > 0) & (mass < 2 * F.abs("gap"))
    h = F.xxhash64(F.lit("settled"), F.col("doc_id").cast("string"), F.col("size"))
    one = F.struct(h.alias("h"), "doc_id", "size", mass.alias("mass"))
    some = near.filter(can).groupBy("source", "gap", F.floor(F.log2(mass)).alias("order"), F.pmod(h, F.lit(EACH_ORDER)).alias("k")).agg(F.min(one).alias("one"))
    lists = some.groupBy("source", "gap").agg(F.array_sort(F.collect_list(F.struct((-F.col("one.mass")).alias("by"), F.col("one.doc_id").alias("doc_id"), F.col("one.size").alias("size"), F.col("one.mass").alias("mass")))).alias("docs"))
    kind = lists.schema["docs"].dataType.simpleString()
    start = F.struct(F.abs("gap").cast("double").alias("left"), F.array().cast(kind).alias("took"))
    step = lambda a, x: F.when(x["mass"] <= a["left"], F.struct((a["left"] - x["mass"]).cast("double").alias("left"), F.array_append(a["took"], x).alias("took"))).otherwise(a)
    lists = lists.withColumn("so", F.aggregate("docs", start, step))
    # Then the one of the others that comes nearest to what is left, if that is nearer than none.
    left = F.col("so.left")
    others = F.filter("docs", lambda x: ~F.array_contains(F.col("so.took"), x) & (x["mass"] < 2 * left))
    last = F.array_min(F.transform(others, lambda x: F.struct(F.abs(left - x["mass"]).alias("off"), x.alias("d"))))["d"]
    chosen = lists.select("source", F.signum("gap").cast("long").alias("step"), F.explode(F.array_compact(F.array_append("so.took", last))).alias("d"))
    return written(chosen.select("source", "d.doc_id", "d.size", "step"), "changes")


def plan(docs: DataFrame, weights: list[float], share: float = 1.5, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cap: float = CAP) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(units, tilt of each source, changes): what copies() and mix() need."""
    parts = written(units(docs, id_col, text_col, source_col), "units")
    hist = written(parts.groupBy("source", "size").agg(F.sum("m").alias("n")), "sizes")
    goal = targets(hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, cap)
    tilt = tilts(hist, written(goal, "targets"), cap)
    tilt = written(tilt, "tilt")
    return parts, tilt, settled(written(with_copies(parts, tilt, None, cap), "copies"), tilt, cap)


def with_copies(rows: DataFrame, tilt: DataFrame, changes: DataFrame | None, cap: float = CAP, source_col: str = "source", id_col: str = "doc_id", size_col: str = "size") -> DataFrame:
    """rows with source_size, target, copies."""
    few = tilt.count() <= BROADCAST_ROWS
    side = tilt.toDF("_source", "source_size", "target", "mean", "lam")
    out = rows.join(F.broadcast(side) if few else side, F.col(source_col).eqNullSafe(F.col("_source")))
    copies = rounded(rate_of(F.col(size_col), cap), F.col(id_col), F.col(size_col))
    if changes is not None:  # a bounded number for each source
        few = changes.count() <= BROADCAST_ROWS
        steps = changes.toDF("_csource", "_cid", "_csize", "_step")
        out = out.join(F.broadcast(steps) if few else steps, F.col(source_col).eqNullSafe(F.col("_csource")) & F.col(id_col).eqNullSafe(F.col("_cid")) & (F.col(size_col) == F.col("_csize")), "left")
        copies = copies + F.coalesce("_step", F.lit(0))
        out = out.withColumn("copies", copies).drop("_csource", "_cid", "_csize", "_step")
    else:
        out = out.withColumn("copies", copies)
    return out.drop("_source", "mean", "lam")


def mix(docs: DataFrame, weights: list[float], share: float = 1.5, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cap: float = CAP) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, copies, taken."""
    parts, tilt, changes = plan(docs, weights, share, id_col, text_col, source_col, cap)
    out = with_copies(parts, tilt, changes, cap).withColumn("taken", F.col("copies") * F.col("size"))
    return out.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), "m"))).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


def copies(docs: DataFrame, weights: list[float], share: float = 1.5, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cap: float = CAP) -> DataFrame:
    """The mix itself: docs with each document as often as it is taken, all columns, and copy (1, 2, ...)."""
    _, tilt, changes = plan(docs, weights, share, id_col, text_col, source_col, cap)
    cols = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(cols))))
    at = {c: f"c{cols.index(c)}" for c in (id_col, text_col, source_col)}
    sized = plain.withColumn("_size", size_of(text_of(at[text_col])))
    out = with_copies(sized, tilt, changes, cap, at[source_col], at[id_col], "_size").filter("copies > 0")
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(*plain.columns, "copy")
    return out.toDF(*cols, fresh(docs, "copy"))
