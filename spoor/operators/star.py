"""The star schema of scripts, instances, features and usages, with natural keys."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spoor.functions import fields as f
from spoor.functions import hashes, urls
from spoor.operators.usage import counted
from spoor.session import written


@dataclass(frozen=True)
class Star:
    scripts: DataFrame
    instances: DataFrame
    features: DataFrame
    usages: DataFrame
    urls: DataFrame


KEY = ["sha2", "sha3", "size"]


def _keyed(scripts: DataFrame) -> DataFrame:
    """scripts with all of KEY: without SHA3-256 digests, these are null."""
    return scripts if "sha3" in scripts.columns else scripts.withColumn("sha3", F.lit(None).cast("string"))


def script_rows(scripts: DataFrame) -> DataFrame:
    """KEY: each code once."""
    return _keyed(scripts).filter("not is_injected").select(*KEY).distinct()


def instance_key() -> Column:
    return hashes.instance_hash(F.col("log_id"), F.col("sha2"), F.coalesce("sha3", F.lit("")), F.col("size"), F.col("isolate"), F.col("script_id"))


def instance_rows(scripts: DataFrame) -> DataFrame:
    """instance_hash, log, script by KEY, parent instance, script URL and origin by their digests."""
    rows = _keyed(scripts).filter("not is_injected").withColumn("instance_hash", instance_key())
    up = rows.select("log_id", "isolate", F.col("script_id").alias("eval_parent_id"), F.col("instance_hash").alias("parent_hash"))
    url = lambda c: F.when(F.col(c) != "", F.sha2(F.col(c).cast("binary"), 256))
    out = rows.join(up, ["log_id", "isolate", "eval_parent_id"], "left")
    return out.select("instance_hash", "log_id", "isolate", "script_id", *KEY, "parent_hash", url("url").alias("script_url_sha256"), url("first_origin").alias("origin_url_sha256"))


def imported(instances: DataFrame, scripts: DataFrame) -> DataFrame:
    """instances with the columns of scripts (KEY and others, such as a surrogate) joined on all of KEY, null digests alike."""
    side = scripts.select(*(F.col(k).alias(f"_{k}") for k in KEY), *(c for c in scripts.columns if c not in KEY))
    same = F.lit(True)
    for k in KEY:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return instances.join(side, same).drop(*(f"_{k}" for k in KEY))


def with_urls(instances: DataFrame, dim: DataFrame, bring: tuple[str, ...] = ("id",)) -> DataFrame:
    """instances with columns of the URL dimension (sha256, ...) twice: script_<column> and origin_<column>, null without a URL."""
    for role in ("script", "origin"):
        side = dim.select(F.col("sha256").alias(f"{role}_url_sha256"), *(F.col(c).alias(f"{role}_{c}") for c in bring))
        instances = instances.join(side, f"{role}_url_sha256", "left")
    return instances


def with_features(usages: DataFrame, features: DataFrame, bring: tuple[str, ...] = ("id",)) -> DataFrame:
    """usages with columns of the feature dimension (name, ...) as feature_<column>."""
    return usages.join(features.select("name", *(F.col(c).alias(f"feature_{c}") for c in bring)), "name", "left")


def full_usages(trace: DataFrame, idl: DataFrame | None = None) -> DataFrame:
    """Records with name, receiver_name, base and role; a construction is its receiver with role c."""
    rows = counted(trace)
    if idl is None:
        rows = rows.withColumns({"base": F.lit(None).cast("string"), "role": F.lit(None).cast("string")})
    else:
        known = idl.select(F.col("class").alias("tag"), "member", "base", "role")
        rows = rows.join(known, ["tag", "member"], "left")
    return rows.withColumn("name", f.full_name(F.coalesce("base", "tag"), F.col("member")))


def feature_rows(uses: DataFrame) -> DataFrame:
    """name, receiver_name (the first seen), member, base, role."""
    at = F.struct("log_id", "line_no")
    return uses.groupBy("name").agg(F.min_by("tag", at).alias("receiver_name"), F.min_by("member", at).alias("member"), F.max_by("base", at).alias("base"), F.max_by("role", at).alias("role"))


def usage_rows(uses: DataFrame, scripts: DataFrame) -> DataFrame:
    """instance_hash, origin, name, offset, op, n_uses."""
    keyed = _keyed(scripts).filter("not is_injected").select("log_id", "isolate", "script_id", instance_key().alias("instance_hash"))
    counted = uses.groupBy("log_id", "isolate", "script_id", "origin", "name", "offset", "op").agg(F.count("*").alias("n_uses"))
    return counted.join(keyed, ["log_id", "isolate", "script_id"]).drop("log_id", "isolate", "script_id")


def star(trace: DataFrame, scripts: DataFrame, idl: DataFrame | None = None, suffixes: DataFrame | None = None) -> Star:
    uses = full_usages(trace, idl)
    named = scripts.select(F.col("url")).unionByName(scripts.select(F.col("first_origin").alias("url"))).unionByName(trace.select(F.col("origin").alias("url")))
    return Star(script_rows(scripts), instance_rows(scripts), feature_rows(uses), usage_rows(uses, scripts), urls.dimension(named, suffixes=suffixes))


def surrogate(rows: DataFrame, key: list[str], name: str) -> DataFrame:
    """rows with a dense number by natural key, from 1: for sinks that want one.

    Numbers are given inside ranges of the key and shifted by the ranges' counts, so no task sorts all rows.
    """
    dealt = rows.repartitionByRange(*key).withColumn("_p", F.spark_partition_id())
    dealt = written(dealt, "surrogate")
    inside = F.row_number().over(Window.partitionBy("_p").orderBy(*key))
    counts = dealt.groupBy("_p").agg(F.count("*").alias("_n"))
    shift = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.join(counts.select("_p", shift.alias("_shift")), "_p").withColumn(name, (inside + F.col("_shift")).cast("long")).drop("_p", "_shift")


def json_records(tables: Star) -> DataFrame:
    """value: the four tables as tagged JSON lines; usages leave out their origin."""
    from spoor.sources.sinks import json_lines

    parts = {"mega_script": tables.scripts, "mega_instance": tables.instances, "mega_feature": tables.features, "mega_usage": tables.usages.drop("origin")}
    out = None
    for tag, df in parts.items():
        rows = json_lines(df, tag)
        out = rows if out is None else out.unionByName(rows)
    return out
