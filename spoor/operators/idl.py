"""Interface definitions: members resolved through parents and aliases, once, as a table to join with."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spoor.functions import fields as f
from spoor.operators.usage import counted

#: Names that belong to the language itself, so that an interface file needn't list them.
GLOBALS = (
    "Console Save hasOwnProperty setImmediate setTimeout clearImmediate globalThis Infinity NaN undefined eval isFinite isNaN parseFloat parseInt "
    "decodeURI decodeURIComponent encodeURI encodeURIComponent escape unescape Object Function Boolean Symbol Error AggregateError EvalError RangeError ReferenceError "
    "SyntaxError TypeError URIError InternalError Number BigInt Math Date Array Int8Array Uint8Array Uint8ClampedArray Int16Array Uint16Array Int32Array Uint32Array "
    "BigInt64Array BigUint64Array Float32Array Float64Array String RegExp Map Set WeakMap WeakSet ArrayBuffer SharedArrayBuffer DataView Atomics JSON Iterator AsyncIterator "
    "Promise GeneratorFunction AsyncGeneratorFunction Generator AsyncGenerator AsyncFunction WeakRef FinalizationRegistry Intl Reflect Proxy"
).split()


#: Interfaces of a definition file at most: it is one JSON object, and its closure is worked out on the driver.
MAX_INTERFACES = 200_000


def ancestry(idl: DataFrame) -> DataFrame:
    """class, ancestor, depth: itself, what it is an alias for, and parents upwards, each by its nearest way."""
    rows = idl.select("interface", "alias_for", "parent").limit(MAX_INTERFACES + 1).collect()
    if len(rows) > MAX_INTERFACES:
        raise ValueError(f"over {MAX_INTERFACES} interfaces")
    up: dict[str, set[str]] = {}
    for r in rows:
        up.setdefault(r["interface"], set()).update(x for x in (r["alias_for"], r["parent"]) if x is not None)
    out = []
    for name in up:
        depth, edge, seen = 0, [name], {name}
        while edge:
            out += [(name, x, depth) for x in edge]
            edge = sorted({y for x in edge for y in up.get(x, ())} - seen)
            seen.update(edge)
            depth += 1
    return idl.sparkSession.createDataFrame(out, "class string, ancestor string, depth int")


def resolved(idl: DataFrame) -> DataFrame:
    """class, member, base, role: p(roperty), m(ethod) or c(onstructor, no member), by the nearest ancestor."""
    chain = ancestry(idl)
    names = idl.select("interface", F.explode_outer("methods").alias("member"), F.lit("m").alias("role")).filter("member is not null")
    props = F.coalesce("properties", F.lit(None).cast("array<string>"))
    names = names.unionByName(idl.select("interface", F.explode_outer(props).alias("member"), F.lit("p").alias("role")).filter("member is not null"))
    plain = idl.filter("properties is null and methods is null").select("interface", F.explode_outer("members").alias("member"), F.lit("?").alias("role")).filter("member is not null")
    members = chain.join(names.unionByName(plain), F.col("ancestor") == F.col("interface")).select("class", "member", F.col("ancestor").alias("base"), "role", "depth")
    made = idl.select(F.col("interface").alias("class"), F.lit("").alias("member"), F.col("interface").alias("base"), F.lit("c").alias("role"), F.lit(0).alias("depth"))
    nearest = Window.partitionBy("class", "member").orderBy("depth", F.when(F.col("role") == "p", 0).otherwise(1), "base")
    return members.unionByName(made).withColumn("_n", F.row_number().over(nearest)).filter("_n = 1").drop("_n", "depth")


def looked_up(rows: DataFrame, table: DataFrame, tag: str = "tag", member: str = "member") -> DataFrame:
    """rows with base and role, null where the definitions don't know the member. Definitions come broadcast if Spark sees they are small."""
    known = table.select(F.col("class").alias(tag), F.col("member").alias(member), "base", "role")
    return rows.join(known, [tag, member], "left")


def unknown_apis(rows: DataFrame, idl: DataFrame, table: DataFrame, compat: bool = False) -> DataFrame:
    """rows (op, tag, member) of APIs that the definitions don't hold; aliases count as their interface.

    Members that are noise, records of the Java bridge and such as lack their fields aren't uses of an API.

    compat: every construction counts as unknown, as its member is empty.
    """
    alias = idl.select(F.explode("aliases").alias("alias"), "interface").filter("alias is not null")
    known = table.select(F.col("class").alias("tag"), "member").unionByName(alias.join(table, alias["interface"] == table["class"]).select(F.col("alias").alias("tag"), "member")).distinct()
    names = idl.select(F.col("interface").alias("member")).distinct()
    calls = counted(rows).filter(~(F.col("op").isin("c", "g") & F.col("member").isin(*GLOBALS)))
    calls = calls.join(names, "member", "left_anti")
    if compat:
        known = known.filter("member <> ''")
    return calls.join(known, ["tag", "member"], "left_anti")


def missing(rows: DataFrame, scripts: DataFrame, idl: DataFrame, table: DataFrame, keys: tuple[str, ...] = ("log_id", "isolate"), compat: bool = False) -> DataFrame:
    """name, keys, line_no, use ("op offset url origin"): every use of an API that the definitions don't hold.

    A script without URL or origin takes those of its eval parent. Uses stay rows, as one name may have any
    number of them; by name, keys and line_no they are in order.
    """
    up = scripts.select(*keys, F.col("script_id").alias("eval_parent_id"), F.col("url").alias("up_url"), F.col("first_origin").alias("up_origin"))
    of = scripts.join(up, [*keys, "eval_parent_id"], "left").select(*keys, "script_id", F.coalesce(F.nullif("url", F.lit("")), "up_url", F.lit("")).alias("of_url"), F.coalesce(F.nullif("first_origin", F.lit("")), "up_origin", F.lit("")).alias("of_origin"))
    found = unknown_apis(rows, idl, table, compat).join(of, [*keys, "script_id"])
    text = F.format_string("%s %d %s %s", "op", "offset", "of_url", "of_origin")
    return found.select(f.full_name(F.col("tag"), F.col("member")).alias("name"), *keys, "line_no", text.alias("use"))
