"""Ad-block rules: host rules as joins, everything else as one compiled matcher per Python worker.

Supported: ||host^, |start, end|, *, ^, plain parts, /regular expressions/, @@ exceptions, and the options
third-party, lists of request types (script, image, ~image and so on), important, match-case and
domain=a|~b. All requests here are for scripts: a rule for other types only is known but never matches.
Comments, cosmetic rules and rules with other options are left out; left_out() is a table of them and why.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from spoor.session import ship


@dataclass(frozen=True)
class Rule:
    pattern: str
    exception: bool = False
    third_party: bool | None = None
    domains: frozenset[str] = field(default_factory=frozenset)
    not_domains: frozenset[str] = field(default_factory=frozenset)
    important: bool = False
    match_case: bool = False
    for_scripts: bool = True


#: Options that name a type of request.
TYPES = frozenset("script image stylesheet object xmlhttprequest subdocument ping websocket webrtc document font media popup other".split())
#: Other names of the same options.
SAME = {"3p": "third-party", "1p": "~third-party", "first-party": "~third-party", "xhr": "xmlhttprequest", "css": "stylesheet", "frame": "subdocument", "doc": "document"}


def why_not(line: str) -> str | None:
    """Why parse() leaves a line out; null if it doesn't."""
    line = line.strip()
    if not line or line[0] in "![":
        return "comment"
    if re.search("#@?[?$%]?#", line):
        return "cosmetic"
    try:
        return None if parse(line) else "no pattern"
    except (ValueError, re.error) as e:
        return str(e)


def _options(line: str) -> tuple[str, list[str]]:
    """The pattern and the options of a rule without its mark of an exception."""
    if line.startswith("/") and (m := re.match(r"(/.+/)(?:\$([^/]*))?$", line)):
        return m[1], [x for x in (m[2] or "").split(",") if x]
    pattern, sign, options = line.rpartition("$")
    if not sign or not options:
        return line, []
    return pattern, [x for x in options.split(",") if x]


def parse(line: str) -> Rule | None:
    """A rule, or null for a line that is none. An option that isn't supported raises ValueError."""
    line = line.strip()
    if not line or line[0] in "![" or re.search("#@?[?$%]?#", line):
        return None
    exception = line.startswith("@@")
    pattern, options = _options(line[2 * exception :])
    third, yes, no, types, not_types, flags = None, set(), set(), set(), set(), set()
    for option in options:
        name, _, values = option.partition("=")
        name = SAME.get(name, name)
        bare = name.removeprefix("~")
        if bare == "third-party":
            third = name == bare
        elif bare in TYPES:
            (types if name == bare else not_types).add(bare)
        elif name in ("important", "match-case"):
            flags.add(name)
        elif name == "domain":
            for d in values.split("|"):
                (no if d.startswith("~") else yes).add(d.lstrip("~").lower())
        else:
            raise ValueError(f"option {name}")
    for_scripts = "script" in types or not types and "script" not in not_types
    rule = Rule(pattern, exception, third, frozenset(yes), frozenset(no), "important" in flags, "match-case" in flags, for_scripts)
    re.compile(regex(pattern))
    return rule if pattern else None


def is_regex(pattern: str) -> bool:
    return len(pattern) > 2 and pattern[0] == pattern[-1] == "/" and bool(re.search(r"[\\\[\](){}^$|+?.*]", pattern[1:-1]))


def regex(pattern: str) -> str:
    if is_regex(pattern):
        return pattern[1:-1]
    start, end = "", ""
    if pattern.startswith("||"):
        start, pattern = r"^[a-z][a-z0-9+.-]*://(?:[^/?#]*\.)?", pattern[2:]
    elif pattern.startswith("|"):
        start, pattern = "^", pattern[1:]
    if pattern.endswith("|"):
        end, pattern = "$", pattern[:-1]
    body = re.escape(pattern).replace(r"\*", ".*").replace(r"\^", r"(?:[^A-Za-z0-9_.%-]|$)")
    return start + body + end


def _under(host: str, domain: str) -> bool:
    return host == domain or host.endswith("." + domain)


class Matcher:
    """Rules indexed by their longest plain part, so that a URL is held against few of them."""

    def __init__(self, lines: list[str]) -> None:
        self.rules: list[tuple[Rule, re.Pattern]] = []
        self.by_part: dict[str, list[int]] = {}
        self.rest: list[int] = []
        for line in lines:
            if why_not(line) or not (rule := parse(line)).for_scripts:
                continue
            i = len(self.rules)
            self.rules.append((rule, re.compile(regex(rule.pattern), re.A if rule.match_case else re.A | re.I)))
            if is_regex(rule.pattern):
                self.rest.append(i)
                continue
            part = max(re.split(r"[^a-z0-9]+", rule.pattern.lower()), key=len)
            # a part that may be cut off on either side can't be looked up as a whole word
            whole = re.search(rf"(?:^\|\||[^a-z0-9*]){re.escape(part)}(?=[^a-z0-9*])", rule.pattern.lower()) if part else None
            self.by_part.setdefault(part, []).append(i) if whole else self.rest.append(i)

    def blocked(self, url: str, origin_host: str, third_party: bool) -> bool:
        """An important rule blocks whatever exceptions say; of the others an exception wins."""
        found = excepted = False
        for i in [*(i for p in set(re.split(r"[^a-z0-9]+", url.lower())) for i in self.by_part.get(p, ())), *self.rest]:
            rule, pattern = self.rules[i]
            if rule.third_party not in (None, third_party):
                continue
            if rule.domains and not any(_under(origin_host, d) for d in rule.domains) or any(_under(origin_host, d) for d in rule.not_domains):
                continue
            if pattern.search(url):
                if rule.important and not rule.exception:
                    return True
                found, excepted = found or not rule.exception, excepted or rule.exception
        return found and not excepted


_MATCHERS: dict[int, Matcher] = {}


def _match(batches: Iterator[pd.DataFrame], rules, key: int) -> Iterator[pd.DataFrame]:
    if key not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[key] = Matcher(rules.value)
    for b in batches:
        yield b.assign(blocked=[_MATCHERS[key].blocked(u, h, t) for u, h, t in zip(b["url"], b["origin_host"], b["third_party"], strict=True)])


def match(urls: DataFrame, rules: DataFrame, column: str = "rule", limit: int = 500_000) -> DataFrame:
    """urls (url, origin_host, third_party, ...) with blocked. The list of rules is checked to be one, not a corpus."""
    ship(urls.sparkSession)
    lines = [r[0] for r in rules.select(F.col(column)).limit(limit + 1).collect() if r[0]]
    if len(lines) > limit:
        raise ValueError(f"over {limit} rules")
    kind = StructType([*urls.schema.fields, StructField("blocked", BooleanType())])
    sent = urls.sparkSession.sparkContext.broadcast(lines)
    return urls.mapInPandas(partial(_match, rules=sent, key=sent._jbroadcast.id()), kind)


def left_out(rules: DataFrame, column: str = "rule") -> DataFrame:
    """rule, why: the lines that match() doesn't use."""
    ship(rules.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(x, why_not(x or "")) for x in b[column]]
            yield pd.DataFrame([r for r in rows if r[1]], columns=["rule", "why"])

    return rules.select(column).mapInPandas(run, "rule string, why string")


def host_rules(rules: DataFrame, column: str = "rule") -> DataFrame:
    """host: of rules that name just a host, for a join instead of a matcher."""
    return rules.select(F.regexp_extract(F.col(column), r"^\|\|([A-Za-z0-9.-]+)\^$", 1).alias("host")).filter("host <> ''").distinct()


def blocked_hosts(urls: DataFrame, hosts: DataFrame, host: str = "host") -> DataFrame:
    """urls with blocked: whether its host or one it is under is listed. One join on the host's endings, which are few."""
    labels = F.split(F.col(host), r"\.")
    endings = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    distinct = urls.select(host).distinct().withColumn("ending", F.explode(endings))
    hit = distinct.join(hosts.select(F.col("host").alias("ending")), "ending", "left_semi").select(host).distinct().withColumn("blocked", F.lit(True))
    return urls.join(hit, host, "left").withColumn("blocked", F.coalesce("blocked", F.lit(False)))
