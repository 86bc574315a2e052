"""URLs: parts, registrable domains, keys without a scheme, and a dimension of distinct URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A start of the public suffix list, to be replaced by a table for real use.
SUFFIXES = "com org net edu gov io dev app info de fr es it nl eu uk co.uk org.uk ac.uk jp co.jp com.au com.br cn com.cn in co.in ru example".split()


def part(url: Column, name: str) -> Column:
    return F.try_parse_url(url, F.lit(name))


def hostname(url: Column) -> Column:
    return F.coalesce(part(url, "HOST"), F.lit(""))


def port(url: Column) -> Column:
    authority = F.coalesce(part(url, "AUTHORITY"), F.lit(""))
    return F.regexp_extract(authority, r":([0-9]+)$", 1)


def registrable(host: Column, suffixes: list[str] | None = None) -> Column:
    """The label before the longest public suffix, and that suffix; the host itself if it has none.

    The suffixes are literals of the expression, longest first, so this needs no join.
    """
    known = sorted(suffixes or SUFFIXES, key=lambda s: (-s.count("."), s))
    labels = F.split(host, r"\.")
    out = host
    by_depth: dict[int, list[str]] = {}
    for s in known:
        by_depth.setdefault(s.count(".") + 1, []).append(s)
    for depth in sorted(by_depth):
        tail = F.substring_index(host, ".", -depth)
        out = F.when((F.size(labels) > depth) & tail.isin(by_depth[depth]), F.substring_index(host, ".", -(depth + 1))).otherwise(out)
    return out


def with_registrable(rows: DataFrame, host: str, suffixes: DataFrame, name: str = "etld1") -> DataFrame:
    """rows with name: the label before the longest public suffix of a host and that suffix, by a join with a table.

    suffixes: suffix, as public lists have them: plain, *.suffix (any one label before it) and !suffix (not one
    after all). A host without a known suffix has its last label as one; a host that is a suffix stays as it is.
    """
    plain = suffixes.select(F.lower(F.trim("suffix")).alias("suffix")).filter("suffix <> '' and suffix not like '//%'").distinct()
    rule = plain.select(F.regexp_replace("suffix", r"^(\*\.|!)", "").alias("ending"), F.when(F.col("suffix").startswith("*."), 1).when(F.col("suffix").startswith("!"), -1).otherwise(0).alias("more"))
    labels = F.split("_host", r"\.")
    hosts = rows.select(F.col(host).alias("_host")).filter("_host is not null").distinct().withColumns({"labels": labels, "n": F.size(labels)})
    ends = hosts.select("_host", "labels", "n", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i")).withColumn("ending", F.array_join(F.slice("labels", F.col("i"), F.col("n")), "."))
    met = ends.join(rule, "ending").withColumn("length", F.col("n") - F.col("i") + 1 + F.col("more")).filter(F.col("length") <= F.col("n"))
    # An exception wins over any other rule; else the longest does.
    best = met.groupBy("_host").agg(F.max(F.struct((F.col("more") == -1).alias("exception"), "length")).alias("b")).select("_host", F.col("b.length").alias("length"))
    first = F.greatest(F.col("n") - F.coalesce("length", F.lit(1)), F.lit(1))
    kept = hosts.join(best, "_host", "left").select("_host", F.array_join(F.slice("labels", first, F.col("n")), ".").alias(name))
    return rows.join(kept.withColumnRenamed("_host", host), host, "left")


def parts(url: Column, suffixes: list[str] | None = None) -> Column:
    """struct(sha256, full, scheme, hostname, port, path, query, etld1, stemmed); only the first two if it can't be parsed."""
    host = hostname(url)
    etld1 = registrable(host, suffixes)
    path = F.coalesce(part(url, "PATH"), F.lit(""))
    ok = part(url, "PROTOCOL").isNotNull()
    maybe = lambda c: F.when(ok, c)
    return F.struct(
        F.sha2(url.cast("binary"), 256).alias("sha256"), url.alias("full"), maybe(F.lower(part(url, "PROTOCOL"))).alias("scheme"), maybe(host).alias("hostname"), maybe(port(url)).alias("port"),
        maybe(path).alias("path"), maybe(F.coalesce(part(url, "QUERY"), F.lit(""))).alias("query"), maybe(etld1).alias("etld1"), maybe(F.concat(etld1, path)).alias("stemmed"),
    )


def schemeless(url: Column, origin: Column) -> Column:
    """The URL without its scheme; a relative one gets the origin's host, with no resolution of its path."""
    bare = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*:", "")
    host = hostname(origin)
    path = F.when(bare.startswith("/"), bare).otherwise(F.concat(F.lit("/"), bare))
    return F.when(bare.startswith("//"), bare).when(host != "", F.concat(F.lit("//"), host, path)).otherwise(bare)


def link_key(url: Column, origin: Column) -> Column:
    return F.concat(origin, F.lit("$"), schemeless(url, origin))


def site(url: Column) -> Column:
    """Up to the third slash."""
    return F.substring_index(url, "/", 3)


def dimension(raw: DataFrame, column: str = "url", suffixes: DataFrame | list[str] | None = None) -> DataFrame:
    """One row per distinct URL that isn't null or empty, with its parts. suffixes: a list, or a table as with_registrable() takes."""
    distinct = raw.select(F.col(column).alias("u")).filter("u <> ''").distinct()
    if not isinstance(suffixes, DataFrame):
        return distinct.select(parts(F.col("u"), suffixes).alias("p")).select("p.*")
    rows = with_registrable(distinct.select(parts(F.col("u")).alias("p")).select("p.*"), "hostname", suffixes, "_etld1")
    cols = {"etld1": F.col("_etld1"), "stemmed": F.concat("_etld1", "path")}
    return rows.select("sha256", "full", "scheme", "hostname", "port", "path", "query", *(c.alias(n) for n, c in cols.items()))


def upsert(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """What an insert that ignores conflicts adds: the first of rows by key that target hasn't got."""
    return rows.dropDuplicates(keys).join(target.select(*keys), keys, "left_anti")
