"""Ad-block rules held against URLs by joins, without Python for URLs.

Rules are parsed once, each row by itself. A rule is listed under keys that every URL it matches must have: whole
words of its pattern, or, where words may be cut off, any three letters or digits in a row. Of its keys the one
that fewest URLs have is chosen, so that words like `https` or `www` lead to no rule that has anything else. URLs are
joined with rules on keys, and each pair is verified once for each distinct URL by the rule's own pattern. What a rule says about the request (third party, domains) is tested on the rows.

Rules without a key (regular expressions, patterns with fewer than three letters in a row) are held against every URL
as one list, of MAX_LOOSE at most; more raise. Every other rule may be one of any number.

Letter case is ignored for A-Z only. Rows without a URL aren't blocked; without an origin no domain rule applies to
them, without third_party no rule that asks for it. Repeated rows are repeated in the result, repeated rules are one rule.
No rules: nothing is blocked. Other columns stay as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoor.functions.blocklist import is_regex, parse, regex, why_not
from spoor.session import ship, written

#: Rules without a key.
MAX_LOOSE = 5_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARSED = "pattern string, exception boolean, important boolean, third_party boolean, domains array<string>, not_domains array<string>, keys array<string>"


def keys(pattern: str) -> list[str]:
    """Keys that all URLs matched by a pattern have: w and a whole word, or g and three letters of one."""
    if is_regex(pattern):
        return []
    low = pattern.translate(str.maketrans(UPPER, LOWER))
    found = [(m.start(), m.end()) for m in re.finditer("[a-z0-9]+", low)]
    whole = [f"w{low[a:e]}" for a, e in found if (a and low[a - 1] != "*") and e < len(low) and low[e] != "*"]
    return sorted(set(whole or [f"g{low[k : k + 3]}" for a, e in found for k in range(a, e - 2)]))


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for line in b["rule"]:
            if line and not why_not(line) and (rule := parse(line)).for_scripts:
                # d: a line ends at \n alone, as in the other matcher
                flags = "(?d)" if rule.match_case else "(?di)"
                out.append((flags + regex(rule.pattern), rule.exception, rule.important, rule.third_party, sorted(rule.domains), sorted(rule.not_domains), keys(rule.pattern)))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in PARSED.split(", ")])


def rules_table(rules: DataFrame, column: str = "rule") -> DataFrame:
    """The rules that may match requests for scripts, parsed; each once."""
    ship(rules.sparkSession)
    return rules.select(F.col(column).cast("string").alias("rule")).distinct().mapInPandas(_parse, PARSED).distinct()


def url_keys(url: Column) -> Column:
    """All keys of a URL, as keys() names them, each once."""
    low = F.translate(url, UPPER, LOWER)
    words = F.filter(F.split(low, "[^a-z0-9]+"), lambda w: w != "")
    grams = F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - 2, F.lit(1))), lambda k: F.concat(F.lit("g"), F.substring(w, k, F.lit(3))))))
    return F.array_distinct(F.concat(F.transform(words, lambda w: F.concat(F.lit("w"), w)), grams))


def _under(host: Column, domain: Column) -> Column:
    return (host == domain) | host.endswith(F.concat(F.lit("."), domain))


def applies(r: Column, host: Column, third_party: Column) -> Column:
    """Whether a rule that matches a URL is about this request."""
    party = r["third_party"].isNull() | F.coalesce(r["third_party"] == third_party, F.lit(False))
    yes = (F.size(r["domains"]) == 0) | F.exists(r["domains"], lambda x: _under(host, x))
    return party & yes & ~F.exists(r["not_domains"], lambda x: _under(host, x))


def match_by_joins(urls: DataFrame, rules: DataFrame, column: str = "rule") -> DataFrame:
    """urls (url, origin_host, third_party, ...) with blocked: an important rule blocks, of the others an exception wins."""
    parsed = written(rules_table(rules, column), "rules")
    said = F.struct("exception", "important", "third_party", "domains", "not_domains").alias("said")
    distinct = written(urls.select("url").filter("url is not null").distinct(), "urls")
    of_urls = distinct.select("url", F.explode(url_keys(F.col("url"))).alias("key"))
    of_rules = parsed.select("*", F.explode("keys").alias("key"))
    # how many distinct URLs have each key that a rule has; counts combine before they move
    often = of_urls.join(of_rules.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.count("*").alias("n"))
    # a rule with a key that no URL has matches none: the rarest key is that one
    rarest = of_rules.join(often, "key", "left").groupBy("pattern", "exception", "important", "third_party", "domains", "not_domains").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key")).alias("least"))
    listed = written(rarest.filter("least.n > 0").select("pattern", said, F.col("least.key").alias("key")), "listed")
    pairs = of_urls.join(listed, "key").filter(F.regexp_like("url", F.col("pattern"))).select("url", "said")
    loose = parsed.filter("size(keys) = 0").select(F.struct("pattern", said).alias("r"))
    count = loose.limit(MAX_LOOSE + 1).count()
    if count > MAX_LOOSE:
        raise ValueError(f"over {MAX_LOOSE} rules without a key")
    if count:
        one = F.broadcast(loose.agg(F.collect_list("r").alias("rs")))  # one row
        found = distinct.crossJoin(one).select("url", F.explode(F.filter("rs", lambda r: F.regexp_like("url", r["pattern"]))).alias("r"))
        pairs = pairs.unionByName(found.select("url", "r.said"))
    # what matching rules say, each thing once, so that a URL's list is as long as there are kinds of them
    lists = pairs.groupBy("url").agg(F.collect_set("said").alias("_said"))
    host = F.coalesce("origin_host", F.lit(""))
    about = F.filter("_said", lambda r: applies(r, host, F.col("third_party")))
    blocks = F.exists(about, lambda r: ~r["exception"]) & ~F.exists(about, lambda r: r["exception"])
    blocked = F.exists(about, lambda r: r["important"] & ~r["exception"]) | blocks
    return urls.join(lists, "url", "left").select(*urls.columns, F.coalesce(blocked, F.lit(False)).alias("blocked"))
