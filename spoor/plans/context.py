"""Execution context: which isolate, script and origin each record of a log belongs to."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spoor.functions import fields as f
from spoor.functions import hashes
from spoor.session import written

#: Fixed value: a script whose code ends so was put in by the automation tool, not by the page.
INJECTED = "//# sourceURL=__puppeteer_evaluation_script__\n)"
PAYLOAD = ("c", "n", "g", "s", "j")
#: Lines of a log that one task holds at most, when logs are read from files.
BLOCK = 1_000_000
#: Rounds of pointer doubling, two doublings each: chains of evals of up to 4 ** 15 links.
ROUNDS = 15


@dataclass(frozen=True)
class Trace:
    """logs, scripts, trace (payload records with context), broken (records and why)."""

    logs: DataFrame
    scripts: DataFrame
    trace: DataFrame
    broken: DataFrame


def records(lines: DataFrame) -> DataFrame:
    """log_id, line_no, op, fields, line: op is the first character; empty lines have none."""
    return lines.select("log_id", "line_no", F.substring("line", 1, 1).alias("op"), f.split_fields(F.substring("line", 2, 1 << 30)).alias("fields"), "line")


def _blocks(df: DataFrame, keys: list[str], order: str, block: int) -> tuple[DataFrame, list[str]]:
    """df with its keys without nulls and the block of each row: windows and joins on these columns share one exchange."""
    names = [f"_k{i}" for i in range(len(keys))]
    cols = {n: F.coalesce(F.col(k).cast("string"), F.lit("\x00")) for n, k in zip(names, keys, strict=True)}
    return df.withColumns({**cols, "_b": F.floor(F.col(order) / block)}), names


def carry_last(df: DataFrame, keys: list[str], order: str, value: Column, name: str, block: int | None = None) -> DataFrame:
    """df with name: the last value that isn't null, up to and with each row, in the order of its keys.

    With block, no task holds more than block rows of a key: rows are filled inside blocks of the order
    column, and what each block leaves is carried over by a window over the blocks.
    """
    if block is None:
        w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(name, F.last(value, ignorenulls=True).over(w))
    b, own = _blocks(df.withColumn("_v", value), keys, order, block)
    inside = Window.partitionBy(*own, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    filled = b.withColumn("_in", F.last("_v", ignorenulls=True).over(inside))
    left = b.groupBy(*own, "_b").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col(order))).alias("_left"))
    over = Window.partitionBy(*own).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = left.select(*own, "_b", F.last("_left", ignorenulls=True).over(over).alias("_carry"))
    out = filled.join(carried, [*own, "_b"], "left").withColumn(name, F.coalesce("_in", "_carry"))
    return out.drop("_v", "_b", "_in", "_carry", *own)


def running_count(df: DataFrame, keys: list[str], order: str, when: Column, name: str, block: int | None = None) -> DataFrame:
    """df with name: how many rows so far, with this one, fulfil when."""
    n = F.when(when, 1).otherwise(0)
    if block is None:
        w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(name, F.sum(n).over(w).cast("long"))
    b, own = _blocks(df.withColumn("_v", n), keys, order, block)
    inside = Window.partitionBy(*own, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    left = b.groupBy(*own, "_b").agg(F.sum("_v").alias("_left"))
    over = Window.partitionBy(*own).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = left.select(*own, "_b", F.coalesce(F.sum("_left").over(over), F.lit(0)).alias("_carry"))
    out = b.withColumn("_in", F.sum("_v").over(inside)).join(carried, [*own, "_b"], "left").withColumn(name, (F.col("_in") + F.col("_carry")).cast("long"))
    return out.drop("_v", "_b", "_in", "_carry", *own)


def with_context(rows: DataFrame, block: int | None = None) -> DataFrame:
    """rows (log_id, line_no, op, fields) with isolate, script_id, origin, token and epoch.

    The active script is that of the last ! or ~, as any ~ leaves none; the origin is the last @ of the
    same isolate; epoch counts the @ of the isolate so far.
    """
    first = F.get("fields", F.lit(0))
    rows = carry_last(rows, ["log_id"], "line_no", F.when(F.col("op") == "~", first), "isolate", block)
    active = F.when(F.col("op") == "~", F.struct(F.lit(None).cast("int").alias("id"))).when(F.col("op") == "!", F.struct(first.try_cast("int").alias("id")))
    rows = carry_last(rows, ["log_id"], "line_no", active, "_active", block)
    at = F.when(F.col("op") == "@", F.struct(f.strip_quotes(first).alias("origin"), f.strip_quotes(F.get("fields", F.lit(1))).alias("token")))
    rows = carry_last(rows, ["log_id", "isolate"], "line_no", at, "_at", block)
    rows = running_count(rows, ["log_id", "isolate"], "line_no", F.col("op") == "@", "epoch", block)
    return rows.withColumns({"script_id": F.col("_active.id"), "origin": F.col("_at.origin"), "token": F.col("_at.token")}).drop("_active", "_at")


def eval_roots(scripts: DataFrame, keys: list[str], parent: str = "eval_parent_id", script: str = "script_id") -> DataFrame:
    """keys, script, root, depth: the script at the top of each chain of evals, by pointer doubling.

    A chain of d links takes about log2 d joins. A parent that isn't there makes its child a root.
    """
    ids = [*keys, script]
    base = scripts.select(*ids, F.col(parent).alias("up"))
    known = base.select(*keys, F.col(script).alias("up"))
    ok = base.join(known.withColumn("_has", F.lit(True)), [*keys, "up"], "left")
    start = ok.select(*ids, F.when(F.col("_has"), F.col("up")).otherwise(F.col(script)).alias("root"), F.when(F.col("_has"), 1).otherwise(0).cast("long").alias("depth"))

    def doubled(state: DataFrame) -> DataFrame:
        up = state.select(*keys, F.col(script).alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"))
        return state.join(up, [*keys, "root"]).select(*ids, F.col("next").alias("root"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("root") != F.col("next")).alias("moved"))

    state = written(start, "eval-roots")
    for _ in range(ROUNDS):  # two doublings a round; the second moves nothing once all are at their roots
        after = written(doubled(doubled(state).drop("moved")), "eval-roots")
        state = after.drop("moved")
        if after.filter("moved").isEmpty():
            return state
    own = F.col("moved")  # parents that go round in circles have no root: each such script is its own
    return after.select(*ids, F.when(own, F.col(script)).otherwise(F.col("root")).alias("root"), F.when(own, 0).otherwise(F.col("depth")).alias("depth"))


def script_table(context: DataFrame) -> DataFrame:
    """Scripts that $ records define: ids, code, digests, URL or eval parent, first origin, injected flag."""
    at = lambda i: F.get("fields", F.lit(i))
    parent = at(1).try_cast("int")
    defined = context.filter("op = '$'").select(
        "log_id", "isolate", at(0).try_cast("int").alias("script_id"), "line_no", at(2).alias("code"), hashes.size(at(2)).alias("size"), hashes.sha2(at(2)).alias("sha2"), hashes.sha3(at(2)).alias("sha3"),
        F.when(parent.isNull(), f.strip_quotes(at(1))).alias("url"), parent.alias("eval_parent_id"), F.col("origin").alias("first_origin"),
    )
    return flag_injected(defined)


def flag_injected(scripts: DataFrame, keys: tuple[str, ...] = ("log_id", "isolate")) -> DataFrame:
    """scripts with is_injected: no URL or the tool's mark at the top of the chain of evals."""
    own = F.col("eval_parent_id").isNull() & ((F.col("url") == "") | F.col("code").endswith(INJECTED))
    top = scripts.select(*keys, F.col("script_id").alias("root"), F.coalesce(own, F.lit(False)).alias("is_injected"))
    roots = eval_roots(scripts, list(keys)).drop("depth")
    return scripts.join(roots.join(top, [*keys, "root"]).drop("root"), [*keys, "script_id"])


def payload(context: DataFrame) -> DataFrame:
    """Payload records with their parts: offset, receiver, tag (receiver without object id), member, args."""
    op, parts = F.col("op"), F.col("fields")
    rows = context.filter(op.isin(*PAYLOAD)).withColumns({"offset": F.get(parts, F.lit(0)).try_cast("int"), "receiver": f.receiver_of(op, parts), "member": f.member_of(op, parts), "args": f.arguments_of(op, parts)})
    return rows.withColumn("tag", f.receiver_tag(F.col("receiver"))).drop("line")


def java_ops(trace: DataFrame) -> DataFrame:
    """Records of the Java bridge (j) with sub_op (g, s, c, n), receiver, tag, member, result and args of the operation inside.

    result: what a get read, a set wrote or a call gave. Records with another sub-operation or none keep only that.
    """
    sub = F.get("fields", F.lit(1))
    inner = F.concat(F.slice("fields", 1, 1), F.slice("fields", 3, 1 << 30))  # offset and fields as other records have them
    rows = trace.filter("op = 'j'").drop("receiver", "tag", "member", "args").withColumns({"sub_op": sub, "_f": inner})
    op, parts = F.col("sub_op"), F.col("_f")
    first = F.when(op == "c", 5).otherwise(3)
    args = F.when(op.isin("c", "n") & (F.size(parts) >= first), F.slice(parts, first, F.size(parts))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumns({"receiver": f.receiver_of(op, parts), "member": f.member_of(op, parts), "result": F.when(op.isin("g", "s", "c"), F.get(parts, F.lit(3))), "args": args})
    return rows.withColumn("tag", f.receiver_tag(F.col("receiver"))).drop("_f", "fields")


def trace_tables(lines: DataFrame, block: int | None = BLOCK, mode: str = "quarantine") -> Trace:
    """All tables of a set of logs. mode: quarantine puts what contradicts itself in broken; failfast stops.

    Lines are parsed and put in context once and written to the shared folder, and so are the parts of records:
    passes read the columns and kinds of records that they need from there.
    """
    from spoor.sources.logs import stats

    context = written(with_context(records(lines), block), "context")
    scripts = written(script_table(context), "scripts")
    keys = ["log_id", "isolate", "script_id"]
    parts = written(payload(context), "trace")  # else every pass's filters would be pushed below the codec, with all its steps in each
    seen = scripts.select(*keys).distinct().withColumn("_known", F.lit(True))
    twice = scripts.groupBy(*keys).agg(F.count("*").alias("n"), F.max("line_no").alias("line_no")).filter("n > 1").select("log_id", "line_no", F.lit("script defined again").alias("why"))
    lost = scripts.filter("eval_parent_id is not null").join(seen.withColumnRenamed("script_id", "eval_parent_id"), ["log_id", "isolate", "eval_parent_id"], "left_anti").select("log_id", "line_no", F.lit("unknown parent script").alias("why"))
    active = context.filter("op = '!' and script_id is not null").join(seen, keys, "left_anti").select("log_id", "line_no", F.lit("unknown active script").alias("why"))
    bad_id = context.filter("op = '$'").filter(F.get("fields", F.lit(0)).try_cast("int").isNull()).select("log_id", "line_no", F.lit("bad script id").alias("why"))
    bad_offset = parts.filter("offset is null").select("log_id", "line_no", F.lit("bad offset").alias("why"))
    bad_fields = context.filter("fields is null").select("log_id", "line_no", F.lit("fields can't be read").alias("why"))
    broken = twice.unionByName(lost).unionByName(active).unionByName(bad_id).unionByName(bad_offset).unionByName(bad_fields)
    if mode == "failfast":
        first = broken.first()
        if first is not None:
            raise ValueError(f"{first['log_id']} line {first['line_no']}: {first['why']}")
    first_of = scripts.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("line_no"))).filter("_n = 1").drop("_n")
    return Trace(stats(context), first_of, parts, broken)


def in_page(trace: DataFrame, scripts: DataFrame, keys: tuple[str, ...] = ("log_id", "isolate", "script_id"), bring: tuple[str, ...] = ()) -> DataFrame:
    """Records that passes count: of a known script that isn't injected, with an origin that isn't empty."""
    known = scripts.filter("not is_injected").select(*keys, *bring)
    return trace.filter("script_id is not null and origin <> ''").join(known, list(keys))


def annotate(context: DataFrame) -> DataFrame:
    """log_id, line_no, json: each line with what it defines, the script that is active after it, and a payload's offset if a script is active and it isn't negative."""
    at = lambda i: F.get("fields", F.lit(i))
    defines = F.col("op") == "$"
    doc = F.struct(
        F.col("line").alias("t"), F.when(defines, at(0).try_cast("int")).alias("d"), F.when(defines, hashes.sha2(at(2))).alias("s"),
        F.when(F.col("op").isin(*PAYLOAD) & F.col("script_id").isNotNull() & (at(0).try_cast("int") >= 0), at(0).try_cast("int")).alias("o"), F.when(F.length("line") > 0, F.col("script_id")).alias("x"),
    )
    return context.select("log_id", "line_no", F.to_json(doc).alias("json"))


def relabel(rows: DataFrame, keys: list[str], order: str, column: str, prefix: str, name: str) -> DataFrame:
    """rows with name: the nth distinct value of column, by first appearance, becomes prefix and n."""
    first = rows.filter(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.min(order).alias("_first"))
    number = F.dense_rank().over(Window.partitionBy(*keys).orderBy("_first")) - 1
    labels = first.select(*keys, column, F.concat(F.lit(prefix), number.cast("string")).alias(name))
    return rows.join(labels, [*keys, column], "left")


def from_files(spark: SparkSession, paths: str | list[str], block: int | None = BLOCK, mode: str = "quarantine") -> Trace:
    from spoor.sources.logs import read_lines

    return trace_tables(read_lines(spark, paths), block, mode)


def root_domains(logs: DataFrame, submissions: DataFrame, submission: str = "submission_id") -> DataFrame:
    """logs with root_url and root_domain of their submission (id, url); empty where there is none."""
    from spoor.functions.urls import hostname

    urls = submissions.select(F.col("id").alias(submission), F.col("url").alias("root_url")).dropDuplicates([submission])
    out = logs.join(urls, submission, "left").withColumn("root_url", F.coalesce("root_url", F.lit("")))
    return out.withColumn("root_domain", hostname(F.col("root_url")))
