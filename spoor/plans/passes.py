"""Passes by name: each is a function from trace tables to a result, so that a user can add one."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoor.functions import blocklist, urls
from spoor.operators import causality, idl, parties, star, usage
from spoor.plans import context
from spoor.plans.context import Trace, in_page
from spoor.plans.records import RecordPass, run_records


@dataclass(frozen=True)
class Inputs:
    """What passes may need besides the trace."""

    idl: DataFrame | None = None
    entities: DataFrame | None = None
    rules: DataFrame | None = None
    suffixes: DataFrame | None = None
    root_domain: str = ""
    #: How causality resolves scripts: compat or intent.
    causality_mode: str = "compat"
    #: Whether adblock gives only what is blocked.
    only_blocked: bool = False


PASSES: dict[str, Callable[[Trace, Inputs], DataFrame]] = {}
#: Names that stand for several passes, each a kind of record of its own.
GROUPS = {"Mfeatures": ("mega_script", "mega_instance", "mega_feature", "mega_usage")}


def named_pass(name: str):
    def add(f: Callable[[Trace, Inputs], DataFrame]):
        PASSES[name] = f
        return f

    return add


def _seen(t: Trace) -> DataFrame:
    return in_page(t.trace, t.scripts)


def _active(t: Trace) -> DataFrame:
    """Scripts that some counted record belongs to."""
    keys = ["log_id", "isolate", "script_id"]
    return t.scripts.join(_seen(t).select(*keys).distinct(), keys)


def _table(i: Inputs) -> DataFrame | None:
    return None if i.idl is None else idl.resolved(i.idl)


def _links(t: Trace, i: Inputs) -> DataFrame:
    return causality.causality(_seen(t), t.scripts, i.causality_mode, root_domain=i.root_domain)


def _needs(value: DataFrame | None, what: str) -> DataFrame:
    if value is None:
        raise ValueError(f"this pass needs {what}")
    return value


named_pass("features")(lambda t, i: usage.features(_seen(t), idl=_table(i)))
named_pass("poly_features")(lambda t, i: usage.features(_seen(t), poly=True, idl=_table(i)))
named_pass("scripts")(lambda t, i: usage.distinct_scripts(usage.with_parent(t.scripts)).drop("code"))
named_pass("blobs")(lambda t, i: usage.blobs(t.scripts))
named_pass("ufeatures")(lambda t, i: usage.features_by_log(_seen(t), _table(i)))
named_pass("mega_script")(lambda t, i: star.script_rows(t.scripts))
named_pass("mega_instance")(lambda t, i: star.instance_rows(t.scripts))
named_pass("mega_feature")(lambda t, i: star.feature_rows(star.full_usages(_seen(t), _table(i))))
named_pass("mega_usage")(lambda t, i: star.usage_rows(star.full_usages(_seen(t), _table(i)), t.scripts))
named_pass("create_element")(lambda t, i: usage.created_elements(_seen(t)))
named_pass("callargs")(lambda t, i: usage.call_arguments(_seen(t)))
named_pass("callargs_rows")(lambda t, i: usage.call_rows(_seen(t)))
named_pass("flow_rows")(lambda t, i: usage.flow_rows(_seen(t)))
named_pass("flow")(lambda t, i: usage.flow(_seen(t)))
named_pass("fptp")(lambda t, i: parties.parties(_active(t).drop("code"), _needs(i.entities, "entities"), i.root_domain or None, i.suffixes))
named_pass("idlapis")(lambda t, i: idl.missing(_seen(t), t.scripts, _needs(i.idl, "interface definitions"), idl.resolved(i.idl)))
named_pass("causality")(lambda t, i: _links(t, i))
named_pass("causality_graphml")(lambda t, i: causality.graphs(_links(t, i), t.scripts))
named_pass("java_ops")(lambda t, i: context.java_ops(t.trace))
named_pass("noop")(lambda t, i: t.logs)
named_pass("multi_origin")(lambda t, i: usage.multi_origin_objects(_seen(t)))


def record_pass(name: str, work: RecordPass, **how) -> None:
    """Add a pass of user code that sees records one after another; how: see run_records()."""
    named_pass(name)(lambda t, i: run_records(_seen(t), work, **how))


@named_pass("adblock")
def adblock(t: Trace, i: Inputs) -> DataFrame:
    """url, origin_host, blocked: once for each pair, or for those that are blocked."""
    pairs = _active(t).filter("url <> '' and first_origin <> 'null'").select("url", urls.hostname(F.col("first_origin")).alias("origin_host")).distinct()
    pairs = pairs.withColumn("url_host", urls.hostname(F.col("url")))
    if i.suffixes is None:
        third = urls.registrable(F.col("url_host")) != urls.registrable(F.col("origin_host"))
    else:
        pairs = urls.with_registrable(urls.with_registrable(pairs, "url_host", i.suffixes, "_site"), "origin_host", i.suffixes, "_page")
        third = F.col("_site") != F.col("_page")
    rows = pairs.select("url", "origin_host", third.alias("third_party"))
    found = blocklist.match(rows, _needs(i.rules, "rules"))
    return found.filter("blocked") if i.only_blocked else found


def run(names: str, tables: Trace, inputs: Inputs | None = None) -> dict[str, DataFrame]:
    """Results of passes given as a+b+c; each name counts once."""
    chosen = list(dict.fromkeys(x for n in names.split("+") if n for x in GROUPS.get(n, (n,))))
    if unknown := [n for n in chosen if n not in PASSES]:
        raise ValueError(f"no pass {', '.join(unknown)}; there are {', '.join([*PASSES, *GROUPS])}")
    return {n: PASSES[n](tables, inputs or Inputs()) for n in chosen}
