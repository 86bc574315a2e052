"""URL filters by association rules.

A URL's tokens (its host and parent domains, words of these, path segments by position, file ending, query
names; all whole) are the items of a transaction; URLs that hand-written rules decide, or any other labels,
add a verdict. Spark's FP-growth mines combinations of tokens with a verdict. Before, tokens below the
minimum support go, as no rule can hold them, and of tokens that are in exactly the same URLs one stays, the
shortest, as the others say the same. Rules are pruned by support, confidence, length and by simpler rules
that are at least as good, and match by an inverted index from each rule's rarest token.

What bounds the mining: FP-growth has no bound for the length of its sets, which grow with the power of two of
the tokens that URLs share. Where some URL has over MAX_ITEMS of them left, the same sets, of at most max_tokens,
are counted level by level instead: each is one that is frequent and a token behind it. Either way gives
exactly the sets of at least the minimum support with their counts. The number of rules is checked and raises
beyond MAX_RULES.

A null URL or one without :// has no host, path or tokens and gets the default verdict. Very long URLs are
split whole. Rules that tie in confidence go by number of tokens, support, then tokens. Repeated rows are
repeated; ids keep their type; extra columns are ignored; an empty table gives an empty result; no labels, no
mined rules.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoor.llm.common import kind, prepare, written

BLOCK, ALLOW = "verdict=block", "verdict=allow"
MAX_RULES = 50_000
#: Tokens of a URL up to which FP-growth is used.
MAX_ITEMS = 14
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first ://: up to / ? # or the end, A-Z lower-cased; then up to ? # or the end."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.substring(url, at + 3, F.length(url))
    path = F.regexp_extract(rest, "(?s)^[^/?#]*([^?#]*)", 1)
    return F.when(at > 0, ascii_lower(F.regexp_extract(rest, "(?s)^([^/?#]*)", 1))).otherwise(""), F.when(at > 0, path).otherwise("")


def tokens(host: str, path: str, query: str) -> list[str]:
    """The items of a URL. Numbers stand for each other, as they say which page it is, not of what kind."""
    out = set()
    if host:
        parts = host.split(".")
        out.update("host=" + ".".join(parts[i:]) for i in range(len(parts)))
        out.update("label=" + x for p in parts for x in re.split("[-_]", p) if x)
    for i, x in enumerate(s for s in path.split("/") if s):
        x = re.sub(r"[0-9]+", "0", x)
        out.add(f"path{i}={x}")
        if "." in x:
            out.add("ending=" + x.rsplit(".", 1)[1])
    out.update("query=" + x.split("=")[0] for x in query.split("&") if x)
    return sorted(out)


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [tokens(h, p, q) for h, p, q in zip(*(b.column(c).to_pylist() for c in ("host", "path", "query")), strict=True)]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.list_(pa.string()))], [*b.schema.names, "tokens"])


def parsed(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, query: one row per row of pages."""
    url = F.col(url_col).cast("string")
    host, path = host_and_path(url)
    query = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^[^#?]*\?([^#]*)", 1)).otherwise("")
    return pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), F.coalesce(query, F.lit("")).alias("query"))


def ruled(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest of rules (verdict, host, path) that fits; null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def telling(labelled: DataFrame, min_support: float) -> tuple[DataFrame, int]:
    """(i, tokens (sorted), verdict of each row, with the tokens that mining needs; the number of rows)."""
    rows = labelled.select("tokens", "verdict", F.monotonically_increasing_id().alias("i"))
    rows = written(rows, "labelled")
    total = rows.count()
    # Tokens with the same number and sums of hashes of rows are in the same rows.
    seen = rows.select(F.explode("tokens").alias("token"), F.xxhash64("i").alias("h")).groupBy("token").agg(F.count("*").alias("n"), F.bit_xor("h").alias("x"), F.bit_xor(F.xxhash64("h")).alias("y"))
    one = F.min(F.struct(F.length("token").alias("length"), "token"))
    frequent = seen.filter(F.col("n") >= min_support * total).groupBy("n", "x", "y").agg(one.alias("one")).select(F.col("one.token").alias("token"))
    # Each row has few tokens, and a token that many rows have is joined where the rows are: there are at most
    # (tokens a row) / min_support frequent ones.
    kept = rows.select("i", "verdict", F.explode_outer("tokens").alias("token")).join(F.broadcast(frequent), "token", "left_semi")
    return written(kept.groupBy("i", "verdict").agg(F.array_sort(F.collect_set("token")).alias("tokens")), "telling"), total


def sets_by_growth(kept: DataFrame, least: int, n: int, max_tokens: int) -> DataFrame:
    """whole, block, allow, all: the sets of at most max_tokens that at least `least` of n rows have, by FP-growth; null for a verdict that fewer have."""
    from pyspark.ml.fpm import FPGrowth

    items = kept.select(F.array_append("tokens", F.concat(F.lit("verdict="), F.col("verdict"))).alias("items"))
    frequent = FPGrowth(itemsCol="items", minSupport=max(0.0, least - 0.5) / n).fit(items).freqItemsets
    short = frequent.filter(F.size("items") <= max_tokens + 1).withColumn("whole", F.sort_array(F.filter("items", lambda x: ~x.isin(BLOCK, ALLOW))))
    return short.groupBy("whole").agg(
        F.sum(F.when(F.array_contains("items", BLOCK), F.col("freq"))).alias("block"),
        F.sum(F.when(F.array_contains("items", ALLOW), F.col("freq"))).alias("allow"),
        F.sum(F.when(F.size("items") == F.size("whole"), F.col("freq"))).alias("all"),
    ).filter((F.size("whole") > 0) & (F.size("whole") <= max_tokens))


def sets_by_level(kept: DataFrame, least: int, max_tokens: int) -> DataFrame:
    """The same by counting sets of one token, then of two, and so on: a row brings those whose beginning is frequent."""
    at = kept.select("i", "verdict", "tokens", F.array().cast("array<string>").alias("whole"), F.lit(0).alias("last"))
    out = None
    many = lambda v: F.count(F.when(F.col("verdict") == v, 1))
    for level in range(max_tokens):
        at = at.filter(F.size("tokens") > F.col("last")).withColumn("next", F.explode(F.sequence(F.col("last") + 1, F.size("tokens"))))
        at = at.select("i", "verdict", "tokens", F.array_append("whole", F.element_at("tokens", F.col("next"))).alias("whole"), F.col("next").alias("last"))
        counts = at.groupBy("whole").agg(many("block").alias("block"), many("allow").alias("allow"), F.count("*").alias("all")).filter(F.col("all") >= least)
        counts = written(counts, "sets")
        out = counts if out is None else out.unionByName(counts)
        if level + 1 < max_tokens:
            at = written(at.join(counts.select("whole"), "whole", "left_semi"), "growing")
    return out.select("whole", *(F.when(F.col(v) >= least, F.col(v)).alias(v) for v in ("block", "allow")), "all")


def mine(labelled: DataFrame, min_support: float = 0.005, min_confidence: float = 0.8, max_tokens: int = 3) -> list[tuple[tuple[str, ...], str, float, float]]:
    """(tokens, verdict, confidence, support) of rules mined from labelled: tokens (array), verdict."""
    kept, total = telling(labelled, min_support)
    n, widest = kept.agg(F.count("*"), F.max(F.size("tokens"))).first()
    if not n:
        return []
    least = max(1, math.ceil(min_support * total))
    of = sets_by_growth(kept, least, n, max_tokens) if widest <= MAX_ITEMS else sets_by_level(kept, least, max_tokens)
    sure = of.filter(F.greatest(F.coalesce("block", F.lit(0)), F.coalesce("allow", F.lit(0))) >= min_confidence * F.col("all"))
    rows = sure.limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"over {MAX_RULES} rules: raise min_support")
    rules: dict[tuple[str, ...], tuple[str, float, float]] = {}
    for r in sorted(rows, key=lambda r: (len(r["whole"]), r["whole"])):
        n, verdict = max(((r["allow"] or 0), "allow"), ((r["block"] or 0), "block"))
        rule, sure_by = tuple(r["whole"]), n / r["all"]
        parts = (rules.get(x) for k in range(1, len(rule)) for x in itertools.combinations(rule, k))
        if not any(p and p[0] == verdict and p[1] >= sure_by for p in parts):  # a part of it that is as sure says it already
            rules[rule] = verdict, sure_by, n / total
    return [(k, *v) for k, v in rules.items()]


def index(rules: list[tuple[tuple[str, ...], str, float, float]]) -> dict[str, list]:
    """Inverted: each rule under the token of its own that the fewest rules have."""
    often = Counter(t for r in rules for t in r[0])
    out = defaultdict(list)
    for r in rules:
        out[min(r[0], key=lambda t: (often[t], t))].append((frozenset(r[0]), *r[1:]))
    return dict(out)


def judge(found: list[str], rules: dict[str, list], default: str = "allow") -> tuple[str, list[str] | None]:
    """Verdict and rule: the surest rule that matches; then the one with the most tokens, then support."""
    have = set(found)
    best = max((r for t in have for r in rules.get(t, ()) if r[0] <= have), key=lambda r: (r[2], len(r[0]), r[3], sorted(r[0])), default=None)
    return (best[1], sorted(best[0])) if best else (default, None)


def _judged(batches: Iterator[pa.RecordBatch], rules: dict[str, list], default: str) -> Iterator[pa.RecordBatch]:
    for b in batches:
        known = b.column("verdict").to_pylist()
        found = [judge(x, rules, default) if v is None else (v, None) for x, v in zip(b.column("tokens").to_pylist(), known, strict=True)]
        columns = {n: c for n, c in zip(b.schema.names, b.columns, strict=True) if n not in ("tokens", "verdict")}
        columns |= {"verdict": pa.array([x[0] for x in found], pa.string()), "mined_rule": pa.array([x[1] for x in found], pa.list_(pa.string()))}
        yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", default: str = "allow", min_support: float = 0.005, min_confidence: float = 0.8) -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict, mined_rule.

    The hand-written rules decide what they fit; what they decide is the labels from which rules for all
    other URLs are mined.
    """
    prepare(pages.sparkSession)
    rows = parsed(pages, id_col, url_col).withColumn("by_rule", ruled(F.col("host"), F.col("path"), rules))
    rows = rows.select("page_id", "host", "path", "by_rule.rule", "by_rule.verdict", "query")
    rows = written(rows.mapInArrow(_tokens, kind(rows, tokens="array<string>")), "tokens")  # read for mining and to judge
    mined = index(mine(rows.filter("verdict is not null"), min_support, min_confidence))
    rows = rows.drop("query")
    out = rows.mapInArrow(partial(_judged, rules=mined, default=default), kind(rows.drop("tokens", "verdict"), verdict="string", mined_rule="array<string>"))
    return out.select("page_id", "host", "path", "rule", "verdict", "mined_rule")
