"""Feature usage: what scripts call, get, set and construct. Each pass is a plan over trace and scripts.

trace: log_id, isolate, line_no, op, script_id, origin, epoch, offset, receiver, tag, member, args, of
records that in_page() let through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spoor.functions import fields as f

SITE = ["log_id", "isolate", "script_id", "offset"]


def counted(trace: DataFrame, ops: tuple[str, ...] = ("g", "s", "c", "n")) -> DataFrame:
    """Records of the given kinds whose member isn't noise; receivers may be anything. Records without their fields are left out."""
    return trace.filter(F.col("op").isin(*ops)).filter("tag is not null").filter(~f.is_noise(F.col("member")))


def named(trace: DataFrame, ops: tuple[str, ...] = ("g", "c", "s"), idl: DataFrame | None = None) -> DataFrame:
    """counted() records with name, normalised where idl (class, member, base, role) knows the member."""
    return _normal(counted(trace, ops).withColumn("name", f.full_name(F.col("tag"), F.col("member"))), idl)


def morphism(trace: DataFrame, site: list[str] = SITE) -> DataFrame:
    """site, n_members: distinct bare member names of each call site."""
    return counted(trace, ("g", "c", "s")).groupBy(*site).agg(F.count_distinct("member").alias("n_members"))


def features(trace: DataFrame, poly: bool = False, site: list[str] = SITE, idl: DataFrame | None = None) -> DataFrame:
    """origin, site, name, op, n_uses, of call sites with one member name (poly: with several).

    Whether a site has several goes by bare member names; names are those that idl normalises, where it does.

    Uses are counted first, before any shuffle too; only those counts are then dealt by site, where the
    first and the last member name say whether there are several.
    """
    counts = named(trace, idl=idl).groupBy("origin", *site, "name", "op", "member").agg(F.count("*").alias("n_uses"))
    here = Window.partitionBy(*site)
    one = F.col("_first").eqNullSafe(F.col("_last"))
    chosen = counts.withColumns({"_first": F.min("member").over(here), "_last": F.max("member").over(here)}).filter(~one if poly else one)
    return chosen.groupBy("origin", *site, "name", "op").agg(F.sum("n_uses").alias("n_uses"))


def features_by_origin(trace: DataFrame, idl: DataFrame | None = None) -> DataFrame:
    """log_id, origin, features (sorted array): names used, normalised where the interfaces know them."""
    return named(trace, idl=idl).groupBy("log_id", "origin").agg(F.array_sort(F.collect_set("name")).alias("features"))


def features_by_log(trace: DataFrame, idl: DataFrame | None = None) -> DataFrame:
    """log_id, features: the union over origins."""
    return named(trace, idl=idl).groupBy("log_id").agg(F.array_sort(F.collect_set("name")).alias("features"))


def _normal(rows: DataFrame, idl: DataFrame | None) -> DataFrame:
    """name becomes base.member where idl (class, member, base, role) resolves it."""
    if idl is None:
        return rows
    known = idl.select(F.col("class").alias("tag"), "member", "base")
    return rows.join(known, ["tag", "member"], "left").withColumn("name", F.coalesce(f.full_name(F.col("base"), F.col("member")), F.col("name")))


def distinct_scripts(scripts: DataFrame, order: list[str] | None = None) -> DataFrame:
    """The first script of each code: size, digests, URL, parent's digest, first origin."""
    by = Window.partitionBy("sha2", "size").orderBy(*(order or ["log_id", "isolate", "line_no"]))
    return scripts.filter("not is_injected").withColumn("_n", F.row_number().over(by)).filter("_n = 1").drop("_n")


def with_parent(scripts: DataFrame, keys: tuple[str, ...] = ("log_id", "isolate")) -> DataFrame:
    """scripts with parent_sha2 and parent_url of their eval parent, null without one."""
    up = scripts.select(*keys, F.col("script_id").alias("eval_parent_id"), F.col("sha2").alias("parent_sha2"), F.col("url").alias("parent_url"))
    return scripts.join(up, [*keys, "eval_parent_id"], "left")


def blobs(scripts: DataFrame) -> DataFrame:
    """sha2, size, code: each code once."""
    return scripts.filter("not is_injected").groupBy("sha2", "size").agg(F.min("code").alias("code"))


def created_elements(trace: DataFrame, site: list[str] = SITE) -> DataFrame:
    """origin, site, tag_name (lower case), n_made: calls of HTMLDocument.createElement with a string."""
    arg = F.get("args", F.lit(0))
    rows = trace.filter("op = 'c' and tag = 'HTMLDocument' and member = 'createElement'").filter(f.has_pair(arg, '"', '"'))
    return rows.groupBy("origin", *site, F.lower(f.strip_quotes(arg)).alias("tag_name")).agg(F.count("*").alias("n_made"))


def ordered(item: Column, order: str = "line_no") -> Column:
    """Aggregate: items in the order of a column."""
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), item.alias("i")))), lambda x: x["i"])


def call_rows(trace: DataFrame, site: list[str] = SITE) -> DataFrame:
    """origin, site, api, line_no, args: a row per call. Receivers keep their object ids."""
    rows = counted(trace, ("c",))
    return rows.select("origin", *site, f.full_name(F.col("receiver"), F.col("member")).alias("api"), "line_no", "args")


def call_arguments(trace: DataFrame, site: list[str] = SITE) -> DataFrame:
    """origin, site, api, calls: call_rows() as an array of argument lists in order, for a site whose calls fit one row."""
    return call_rows(trace, site).groupBy("origin", *site, "api").agg(ordered(F.col("args")).alias("calls"))


def flow_rows(trace: DataFrame, skip_repeats: bool = False, key: tuple[str, ...] = ("log_id", "isolate", "script_id")) -> DataFrame:
    """key, line_no, action ("offset,name"): a row per record; skip_repeats leaves out the same action again."""
    rows = named(trace, ("g", "c", "s", "n")).select(*key, "line_no", F.concat_ws(",", F.col("offset").cast("string"), "name").alias("action"))
    if skip_repeats:
        before = F.lag("action").over(Window.partitionBy(*key).orderBy("line_no"))
        rows = rows.withColumn("_before", before).filter(~F.col("action").eqNullSafe(F.col("_before"))).drop("_before")
    return rows


def flow(trace: DataFrame, skip_repeats: bool = False, key: tuple[str, ...] = ("log_id", "isolate", "script_id")) -> DataFrame:
    """key, actions: flow_rows() as an array in order, for scripts whose records fit one row."""
    return flow_rows(trace, skip_repeats, key).groupBy(*key).agg(ordered(F.col("action")).alias("actions"))


def multi_origin_objects(trace: DataFrame) -> DataFrame:
    """log_id, isolate, obj_id, origins, names: objects that several origins touched."""
    bare = f.strip_curlies(F.col("receiver"))
    rows = trace.filter(F.instr(bare, ",") > 0).withColumn("obj_id", F.get(F.split(bare, ","), F.lit(0))).withColumn("name", f.full_name(F.col("tag"), F.col("member")))
    got = rows.groupBy("log_id", "isolate", "obj_id").agg(F.array_sort(F.collect_set("origin")).alias("origins"), F.array_sort(F.collect_set("name")).alias("names"))
    return got.filter(F.size("origins") > 1)


def top_features(trace: DataFrame, k: int = 100) -> DataFrame:
    """name, n_uses of the k most used names: the limit is the feature."""
    return named(trace).groupBy("name").agg(F.count("*").alias("n_uses")).orderBy(F.desc("n_uses"), "name").limit(k)


def usage_rollup(trace: DataFrame) -> DataFrame:
    """origin, op, n_uses with subtotals."""
    return named(trace).rollup("origin", "op").agg(F.count("*").alias("n_uses"))
