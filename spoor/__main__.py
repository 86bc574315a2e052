"""python -m spoor --aggs features+flow [--output json|parquet] [--to DIR] LOG..."""

from __future__ import annotations

import argparse
import importlib
import sys
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoor.plans import context, passes
from spoor.session import shared_dir
from spoor.sources import logs, sinks

VERSION = "0.1"


def stdin_lines(spark: SparkSession, log_root: str = "-") -> DataFrame:
    """One log from standard input: the driver copies it, a line at a time, to the shared folder, where executors read it."""
    path = f"{shared_dir(spark)}/stdin-{uuid.uuid4().hex}.0.log"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(hadoop)
    try:
        while part := sys.stdin.buffer.read(1 << 20):
            out.write(part)
    finally:
        out.close()
    return logs.read_lines(spark, path).withColumn("log_id", F.lit(log_root))


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser("spoor")
    p.add_argument("logs", nargs="*")
    p.add_argument("--version", action="version", version=VERSION)
    p.add_argument("--aggs", default="noop", help="passes, joined by +")
    p.add_argument("--annotate", action="store_true", help="each line with its context, as JSON")
    p.add_argument("--output", choices=["stdout", "json", "parquet", "published", "database"], default="stdout", help="published and database take each run once")
    p.add_argument("--to", help="folder of results, or the JDBC URL of a database")
    p.add_argument("--run", default="", help="id of this run; the same again adds nothing")
    p.add_argument("--driver", help="class of the JDBC driver")
    p.add_argument("--causality-mode", choices=["compat", "intent"], default="compat")
    p.add_argument("--failfast", action="store_true", help="stop at records that contradict others")
    p.add_argument("--only-blocked", action="store_true", help="adblock gives only what is blocked")
    p.add_argument("--plugin", action="append", default=[], help="name=module:class of a record pass to add")
    p.add_argument("--root-domain", default="")
    p.add_argument("--submission", help="id of the submission that the logs are of, kept with every row")
    p.add_argument("--log-root", default="-", help="the name of the log that standard input (-) is")
    p.add_argument("--suffixes", nargs="*", help="public suffix lists")
    p.add_argument("--idl")
    p.add_argument("--entities")
    p.add_argument("--rules", nargs="*")
    p.add_argument("--block", type=int, default=context.BLOCK, help="lines of a log that one task holds at most")
    a = p.parse_args(args)
    if not a.logs:
        p.error("no logs")
    spark = SparkSession.builder.appName("spoor").getOrCreate()
    files = [x for x in a.logs if x != "-"]
    parts = [logs.read_lines(spark, files)] if files else []
    if len(files) < len(a.logs):
        parts.append(stdin_lines(spark, a.log_root))
    lines = reduce(DataFrame.unionByName, parts)
    if a.annotate:
        found = {"annotate": context.annotate(context.with_context(context.records(lines), a.block))}
    else:
        inputs = passes.Inputs(
            logs.read_idl(spark, a.idl) if a.idl else None, logs.read_entities(spark, a.entities) if a.entities else None, logs.read_rules(spark, a.rules) if a.rules else None,
            logs.read_suffixes(spark, a.suffixes) if a.suffixes else None, a.root_domain,
            a.causality_mode, a.only_blocked,
        )
        for plugin in a.plugin:
            name, _, place = plugin.partition("=")
            module, _, work = place.partition(":")
            passes.record_pass(name, getattr(importlib.import_module(module), work)(), block=a.block)
        tables = context.trace_tables(lines, a.block, "failfast" if a.failfast else "quarantine")
        found = passes.run(a.aggs, tables, inputs)
    run = a.run or uuid.uuid4().hex
    for name, df in found.items():
        if a.submission:
            df = df.withColumn("submission_id", F.lit(a.submission))
        if a.output == "parquet":
            df.write.mode("overwrite").parquet(f"{a.to}/{name}")
        elif a.output == "json":
            sinks.write_json_lines(df, name, f"{a.to}/{name}")
        elif a.output == "published":
            sinks.publish(df, f"{a.to}/{name}", run)
        elif a.output == "database":
            flat = df.select(*(F.to_json(c).alias(c) if kind.startswith(("array", "struct", "map")) else F.col(c) for c, kind in df.dtypes))
            sinks.import_database(flat, a.to, name, run, {"driver": a.driver} if a.driver else {})
        else:
            for row in sinks.json_lines(df, name).toLocalIterator():
                print(row["value"])
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
