"""Registered queries over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spoor.functions import blocklist, fields, hashes, html, tables, urls
from spoor.operators import blocking, causality, idl, parties, ranges, star, usage
from spoor.plans import context, lens, records
from spoor.session import table, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

IDL = [
    ("Node", None, None, None, ["append"], ["parent"]), ("Document", "Node", None, None, ["write", "createElement"], ["cookie"]), ("HTMLDocument", "Document", None, None, [], []),
    ("Window", None, None, ["Global"], ["eval"], ["location", "length"]), ("Element", "Node", None, None, [], ["innerHTML"]), ("HTMLScriptElement", "Element", None, None, [], ["src"]),
    ("HTMLIFrameElement", "Element", None, None, [], ["src", "href"]), ("Location", None, None, None, [], ["href"]),
]
IDL_SCHEMA = "interface string, parent string, alias_for string, aliases array<string>, methods array<string>, properties array<string>"

def _resolved_sql() -> str:
    """What IDL resolves to, worked out from the list by hand of a loop, as VALUES."""
    at = {i: (p, m, pr) for i, p, _, _, m, pr in IDL}
    rows = []
    for name in at:
        up, found = name, {}
        while up:
            for m in at[up][2]:
                found.setdefault(m, (up, "p"))
            for m in at[up][1]:
                found.setdefault(m, (up, "m"))
            up = at[up][0]
        rows += [(name, m, *b) for m, b in found.items()] + [(name, "", name, "c")]
    return "idl(class, mem, base, role) as (values " + ", ".join(str(r) for r in rows) + ")"


RESOLVED = _resolved_sql()


def _idl(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(IDL, IDL_SCHEMA).withColumn("members", F.lit(None).cast("array<string>"))


RECORDS = f"rec as ({lens.RECORDS})"
CTX = f"""{RECORDS},
c1 as (select *, last_value(case when op = '~' then f0 end ignore nulls) over w as isolate,
              last_value(case when op = '~' then '-' when op = '!' then f0 end ignore nulls) over w as active
       from rec window w as (partition by log_id order by line_no rows between unbounded preceding and current row)),
ctx as (select *, try_cast(active as int) as script_id, last_value(case when op = '@' then f0 end ignore nulls) over w as origin,
               cast(count(*) filter (where op = '@') over w as bigint) as epoch
        from c1 window w as (partition by log_id, isolate order by line_no rows between unbounded preceding and current row))"""
SCRIPTS = f"""scr as (select *, sha256(code) as sha2, cast(strlen(code) as bigint) as size from ({lens.SCRIPTS}) s)"""
FLAGGED = f"""{SCRIPTS},
roots as (select script_id, script_id as root from scr where eval_parent_id is null union all select s.script_id, r.root from roots r join scr s on s.eval_parent_id = r.script_id),
fl as (select s.*, p.url = '' as is_injected from scr s join roots r using (script_id) join scr p on p.script_id = r.root)"""
SEEN = f"""{CTX}, {FLAGGED},
seen as (select c.*, case when op in ('g', 's', 'c') then member else '' end as mem, k as offset_, case when op = 'n' then ctor else concat(ctor, '.', member) end as name
         from ctx c join fl on c.script_id = fl.script_id where not is_injected and op in ('g', 's', 'c', 'n') and origin <> ''),
named as (select * from seen where op <> 'n' and member <> '12')"""
#: named by what the interfaces normalise: SQL that stands behind SEEN and RESOLVED.
NORMAL = "normal as (select n.* replace (coalesce(base || '.' || member, name) as name) from named n left join idl on class = ctor and idl.mem = member)"


def query(name: str, sql: str | None = None, recursive: bool = False):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql.replace("with ", "with recursive ", 1) if recursive else sql
        return f

    return add


def joined(c: Column, by: str = "|") -> Column:
    return F.array_join(c, by)


# ---- context


@query("features_mono", f"""with {SEEN},
{RESOLVED}, {NORMAL},
counts as (select log_id, isolate, script_id, offset_ as "offset", origin, name, op, member, count(*) as n from normal group by all),
m as (select *, min(member) over p as low, max(member) over p as high from counts window p as (partition by log_id, isolate, script_id, "offset"))
select origin, log_id, isolate, script_id, "offset", name, op, cast(sum(n) as bigint) as n_uses from m where low = high group by all""", recursive=True)
def features_mono(spark: SparkSession, d: str) -> DataFrame:
    return usage.features(lens.seen(spark, d), idl=idl.resolved(_idl(spark)))


@query("features_poly", f"""with {SEEN},
{RESOLVED}, {NORMAL},
counts as (select script_id, origin, name, op, ctor, member, count(*) as n from normal group by all),
m as (select script_id, ctor from counts group by all having count(distinct member) >= 2)
select origin, script_id, ctor, name, op, cast(sum(n) as bigint) as n_uses from counts join m using (script_id, ctor) group by all""", recursive=True)
def features_poly(spark: SparkSession, d: str) -> DataFrame:
    """Sites are (script, receiver) here, as an offset of the lens has one member only."""
    return usage.features(lens.seen(spark, d).withColumnRenamed("tag", "ctor").withColumn("tag", F.col("ctor")), poly=True, site=["script_id", "ctor"], idl=idl.resolved(_idl(spark)))


@query("morphism", f"""with {SEEN} select script_id, ctor as tag, count(distinct member) as n_members from named group by all""", recursive=True)
def morphism(spark: SparkSession, d: str) -> DataFrame:
    return usage.morphism(lens.seen(spark, d), ["script_id", "tag"])


@query("log_stats", f"with r as ({lens.LINES}) select log_id, count(*) as lines, cast(sum(strlen(line) + 1) as bigint) as bytes from r group by log_id")
def log_stats(spark: SparkSession, d: str) -> DataFrame:
    from spoor.sources.logs import stats

    return stats(lens.lines(spark, d))


_CTX_SQL = f"with {CTX} select log_id, line_no, isolate, script_id, origin, epoch from ctx"


@query("ctx_fill", _CTX_SQL)
def ctx_fill(spark: SparkSession, d: str) -> DataFrame:
    return lens.context_rows(spark, d).select("log_id", "line_no", "isolate", "script_id", "origin", "epoch")


@query("ctx_fill_blocked", _CTX_SQL)
def ctx_fill_blocked(spark: SparkSession, d: str) -> DataFrame:
    """The same for logs too long for one task: blocks of lines, and what each carries over."""
    return lens.context_rows(spark, d, block=1000).select("log_id", "line_no", "isolate", "script_id", "origin", "epoch")


@query("codec_fields", f"""with {RECORDS} select log_id, line_no, op, case when op in ('~', '!') then 1 when op = '@' then 2 when op = 's' then 4 when op = 'c' then 4 when op = 'j' then case sub when 'c' then 6 when 'n' then 4 else 5 end else 3 end as n_fields,
case when op in ('~', '!') then f0 when op = '@' then concat('"', f0, '"') else cast(k as varchar) end as first_field,
case when op = '@' then '"t"' when op in ('~', '!') then null when op in ('s', 'c', 'n', 'j') then concat('"', arg, '"') else concat('"', member, '"') end as last_field from rec""")
def codec_fields(spark: SparkSession, d: str) -> DataFrame:
    f = F.col("fields")
    return context.records(lens.lines(spark, d)).select("log_id", "line_no", "op", F.size(f).alias("n_fields"), F.get(f, F.lit(0)).alias("first_field"), F.when(F.size(f) > 1, F.element_at(f, -1)).alias("last_field"))


@query("codec_escape", "select doc_id, sha256(coalesce(text, '')) as round_trip from documents")
def codec_escape(spark: SparkSession, d: str) -> DataFrame:
    """Every text packed into a record body and split again."""
    text = F.array(F.coalesce("text", F.lit("")))
    packed = table(spark, d, "documents").select("doc_id", fields.pack_fields(text).alias("body"))
    back = F.coalesce(F.get(fields.split_fields(F.col("body")), F.lit(0)), F.lit(""))
    return packed.select("doc_id", hashes.sha2(back).alias("round_trip"))


@query("filter_name", r"""with n as (select event_id, case event_id % 5 when 0 then '?' when 1 then cast(user_id as varchar) when 2 then event_type when 3 then concat('-', cast(user_id as varchar)) else '99999999999999999999' end as name from events)
select event_id, name in ('?', '<anonymous>') or (regexp_matches(name, '^[+-]?[0-9]+$') and try_cast(name as bigint) is not null) as is_noise from n""")
def filter_name(spark: SparkSession, d: str) -> DataFrame:
    user, i = F.col("user_id").cast("string"), F.col("event_id") % 5
    name = F.when(i == 0, "?").when(i == 1, user).when(i == 2, F.col("event_type")).when(i == 3, F.concat(F.lit("-"), user)).otherwise("99999999999999999999")
    return table(spark, d, "events").select("event_id", fields.is_noise(name).alias("is_noise"))


@query("strip_quotes", """with q as (select conv_id, turn, case when turn % 2 = 0 then concat('"', text, '"') else text end as t from conversations)
select conv_id, turn, case when length(t) >= 2 and t like '"%' and t like '%"' then substr(t, 2, length(t) - 2) else t end as bare, length(t) >= 2 and t like '"%' and t like '%"' as was_quoted from q""")
def strip_quotes(spark: SparkSession, d: str) -> DataFrame:
    t = F.when(F.col("turn") % 2 == 0, F.concat(F.lit('"'), "text", F.lit('"'))).otherwise(F.col("text"))
    return table(spark, d, "conversations").withColumn("t", t).select("conv_id", "turn", fields.strip_quotes(F.col("t")).alias("bare"), fields.has_pair(F.col("t"), '"', '"').alias("was_quoted"))


def _parts(spark: SparkSession, d: str) -> DataFrame:
    """The parts of the lens's records, written as trace_tables() does."""
    return written(context.payload(context.records(lens.lines(spark, d))), "trace")


@query("receiver_split", f"""with {RECORDS} select log_id, line_no, op, ctor as tag, case when op = 'n' then '' else member end as member, concat(ctor, case when op = 'n' then '' else concat('.', member) end) as name
from rec where op in ('g', 's', 'c', 'n')""")
def receiver_split(spark: SparkSession, d: str) -> DataFrame:
    return _parts(spark, d).filter("op <> 'j'").select("log_id", "line_no", "op", "tag", "member", fields.full_name(F.col("tag"), F.col("member")).alias("name"))


@query("java_ops", f"""with {RECORDS} select log_id, line_no, k as "offset", sub as sub_op, case when sub = 'n' then ctor else concat('{{', obj, ',', ctor, '}}') end as receiver, ctor as tag,
case sub when 'n' then '' when 'c' then '<anonymous>' else member end as member, case sub when 'n' then null when 'c' then '#U' else concat('"', arg, '"') end as result, case when sub in ('c', 'n') then concat('"', arg, '"') end as arg from rec where op = 'j'""")
def java_ops(spark: SparkSession, d: str) -> DataFrame:
    """Operations on the Java bridge, with what is inside them."""
    got = context.java_ops(_parts(spark, d))
    return got.select("log_id", "line_no", "offset", "sub_op", "receiver", "tag", "member", "result", F.get("args", F.lit(0)).alias("arg"))


@query("annotate", f"""with {CTX}, l as ({lens.LINES})
select log_id, line_no, line as t, case when op not in ('~', '!', '@') and script_id is not null then k end as o, script_id as x from ctx join l using (log_id, line_no)""")
def annotate(spark: SparkSession, d: str) -> DataFrame:
    j = F.from_json("json", "t string, o int, x int")
    return context.annotate(lens.context_rows(spark, d)).select("log_id", "line_no", j.alias("j")).select("log_id", "line_no", "j.t", "j.o", "j.x")


@query("relabel", f"""with {RECORDS}, f as (select log_id, ctor, min(line_no) as first from rec group by all),
n as (select log_id, ctor, concat('obj', cast(dense_rank() over (partition by log_id order by first) - 1 as varchar)) as label from f) select log_id, line_no, ctor as tag, label from rec join n using (log_id, ctor)""")
def relabel(spark: SparkSession, d: str) -> DataFrame:
    rows = lens.view(spark, d, "events", lens.RECORDS).select("log_id", "line_no", F.col("ctor").alias("tag"))
    return context.relabel(rows, ["log_id"], "line_no", "tag", "obj", "label").select("log_id", "line_no", "tag", "label")


# ---- scripts


@query("script_hashes", f"with {SCRIPTS} select script_id, sha2, size from scr")
def script_hashes(spark: SparkSession, d: str) -> DataFrame:
    return lens.scripts(spark, d).select("script_id", "sha2", "size")


@query("sha3")
def sha3(spark: SparkSession, d: str) -> DataFrame:
    return lens.scripts(spark, d).select("script_id", hashes.sha3(F.col("code")).alias("sha3"))


@query("scripts_dedup", f"""with {FLAGGED} select script_id, sha2, size, url, first_origin from (select *, row_number() over (partition by sha2, size order by script_id) as n from fl where not is_injected) x where n = 1""", recursive=True)
def scripts_dedup(spark: SparkSession, d: str) -> DataFrame:
    return usage.distinct_scripts(lens.flagged_scripts(spark, d), ["script_id"]).select("script_id", "sha2", "size", "url", "first_origin")


@query("blobs", f"with {FLAGGED} select distinct sha2, size, cast(length(code) as bigint) as n_chars from fl where not is_injected", recursive=True)
def blobs(spark: SparkSession, d: str) -> DataFrame:
    return usage.blobs(lens.flagged_scripts(spark, d)).select("sha2", "size", F.char_length("code").cast("long").alias("n_chars"))


@query("eval_chain", f"""with {SCRIPTS}, ch as (select script_id, script_id as root, cast(0 as bigint) as depth from scr where eval_parent_id is null
union all select s.script_id, c.root, c.depth + 1 from ch c join scr s on s.eval_parent_id = c.script_id) select script_id, root, depth from ch""", recursive=True)
def eval_chain(spark: SparkSession, d: str) -> DataFrame:
    return context.eval_roots(lens.scripts(spark, d), ["log_id", "isolate"]).select("script_id", "root", "depth")


@query("eval_parent_join", f"with {SCRIPTS} select s.script_id, p.sha2 as parent_sha2, p.url as parent_url from scr s left join scr p on p.script_id = s.eval_parent_id")
def eval_parent_join(spark: SparkSession, d: str) -> DataFrame:
    return usage.with_parent(lens.scripts(spark, d)).select("script_id", "parent_sha2", "parent_url")


@query("injected_flag", f"with {FLAGGED} select script_id, is_injected from fl", recursive=True)
def injected_flag(spark: SparkSession, d: str) -> DataFrame:
    return lens.flagged_scripts(spark, d).select("script_id", "is_injected")


# ---- passes


@query("ufeatures_by_origin", f"with {SEEN} select log_id, origin, string_agg(distinct name, '|' order by name) as features from named group by all", recursive=True)
def ufeatures_by_origin(spark: SparkSession, d: str) -> DataFrame:
    return usage.features_by_origin(lens.seen(spark, d)).withColumn("features", joined(F.col("features")))


@query("ufeatures_all", f"""with {SEEN}, {RESOLVED}, x as (select log_id, coalesce(base || '.' || member, name) as name from named left join idl on class = ctor and idl.mem = member)
select log_id, string_agg(distinct name, '|' order by name) as features from x group by all""", recursive=True)
def ufeatures_all(spark: SparkSession, d: str) -> DataFrame:
    return usage.features_by_log(lens.seen(spark, d), idl.resolved(_idl(spark))).withColumn("features", joined(F.col("features")))


@query("idl_lookup", f"with {SEEN}, {RESOLVED} select log_id, line_no, ctor as tag, s.mem as member, base, role from seen s left join idl on class = ctor and idl.mem = s.mem", recursive=True)
def idl_lookup(spark: SparkSession, d: str) -> DataFrame:
    return idl.looked_up(lens.seen(spark, d).filter("op <> 'j'"), idl.resolved(_idl(spark))).select("log_id", "line_no", "tag", "member", "base", "role")


@query("idl_missing", f"""with {SEEN}, {RESOLVED}
select log_id, line_no, ctor as tag, s.mem as member from seen s anti join idl on class = ctor and idl.mem = s.mem where s.mem <> '12' and not (op in ('c', 'g') and member = 'eval')""", recursive=True)
def idl_missing(spark: SparkSession, d: str) -> DataFrame:
    spec = _idl(spark)
    return idl.unknown_apis(lens.seen(spark, d), spec, idl.resolved(spec)).select("log_id", "line_no", "tag", "member")


@query("idlapis", f"""with {SEEN}, {RESOLVED}, m as (select s.* from seen s anti join idl on class = ctor and idl.mem = s.mem where s.mem <> '12' and not (op in ('c', 'g') and member = 'eval'))
select name, m.line_no, concat(op, ' ', cast(k as varchar), ' ', coalesce(nullif(s.url, ''), p.url, ''), ' ', coalesce(nullif(s.first_origin, ''), p.first_origin, '')) as use
from m join scr s using (script_id) left join scr p on p.script_id = s.eval_parent_id""", recursive=True)
def idlapis(spark: SparkSession, d: str) -> DataFrame:
    spec = _idl(spark)
    return idl.missing(lens.one_log(lens.seen(spark, d)), lens.scripts(spark, d), spec, idl.resolved(spec)).select("name", "line_no", "use")


@query("create_element", f"""with {SEEN} select origin, log_id, isolate, script_id, lower(arg) as tag_name, count(*) as n_made from seen where op = 'c' and ctor = 'HTMLDocument' and member = 'createElement' group by all""", recursive=True)
def create_element(spark: SparkSession, d: str) -> DataFrame:
    return usage.created_elements(lens.seen(spark, d), ["log_id", "isolate", "script_id"])


@query("call_arguments", f"""with {SEEN} select origin, log_id, script_id, concat('{{', obj, ',', ctor, '}}.', member) as api, string_agg(concat('"', arg, '"'), '|' order by line_no) as calls, count(*) as n_calls
from seen where op = 'c' and member <> '12' group by all""", recursive=True)
def call_arguments(spark: SparkSession, d: str) -> DataFrame:
    got = usage.call_arguments(lens.seen(spark, d), ["log_id", "script_id"])
    return got.select("origin", "log_id", "script_id", "api", joined(F.flatten("calls")).alias("calls"), F.size("calls").cast("long").alias("n_calls"))


@query("conversation_turns", "select conv_id, string_agg(concat(role, ':', cast(length(text) as varchar)), '|' order by turn, concat(role, ':', cast(length(text) as varchar))) as turns from conversations group by conv_id")
def conversation_turns(spark: SparkSession, d: str) -> DataFrame:
    """Ordered lists over another table: the aggregate of flow and call_arguments."""
    item = F.concat("role", F.lit(":"), F.char_length("text").cast("string"))
    return table(spark, d, "conversations").groupBy("conv_id").agg(joined(usage.ordered(item, "turn")).alias("turns"))


_FLOW = "acts as (select *, concat(cast(offset_ as varchar), ',', name) as action from seen where op = 'n' or member <> '12')"


@query("flow", f"with {SEEN}, {_FLOW} select log_id, isolate, script_id, string_agg(action, '|' order by line_no) as actions from acts group by all", recursive=True)
def flow(spark: SparkSession, d: str) -> DataFrame:
    return usage.flow(lens.seen(spark, d)).withColumn("actions", joined(F.col("actions")))


@query("flow_dedup", f"""with {SEEN}, {_FLOW}, b as (select *, lag(action) over (partition by log_id, isolate, script_id order by line_no) as before from acts)
select log_id, isolate, script_id, string_agg(action, '|' order by line_no) as actions from b where action is distinct from before group by all""", recursive=True)
def flow_dedup(spark: SparkSession, d: str) -> DataFrame:
    return usage.flow(lens.seen(spark, d), skip_repeats=True).withColumn("actions", joined(F.col("actions")))


@query("flow_rows", f"with {SEEN}, {_FLOW} select log_id, isolate, script_id, line_no, action from acts", recursive=True)
def flow_rows(spark: SparkSession, d: str) -> DataFrame:
    """The same as rows, for scripts of any length."""
    return usage.flow_rows(lens.seen(spark, d))


class ActionNumbers(records.RecordPass):
    """User code: each script's actions, numbered, without those that repeat the one before."""

    output = "line_no long, isolate string, script_id int, action string, nth long"
    columns = ("line_no", "op", "isolate", "script_id", "offset", "tag", "member")

    def start(self) -> dict:
        return {}  # (isolate, script) -> first action, last action, how many were counted

    def step(self, state: dict, r) -> tuple[dict, list[tuple]]:
        if r.op == "j" or r.tag is None or r.member in ("?", "<anonymous>") or re.fullmatch("[+-]?[0-9]+", r.member):
            return state, []
        action = f"{r.offset},{r.tag}" + (f".{r.member}" if r.member else "")
        first, last, n = state.get((r.isolate, r.script_id), (action, None, 0))
        if last == action:
            return state, []
        state[r.isolate, r.script_id] = first, action, n + 1
        return state, [(r.line_no, r.isolate, r.script_id, action, n + 1)]


class CombinedNumbers(ActionNumbers):
    def combine(self, before: dict, after: dict) -> dict:
        out = dict(before)
        for key, (first, last, n) in after.items():
            if key in before:
                began, stood, m = before[key]
                out[key] = began, last, m + n - (stood == first)
            else:
                out[key] = first, last, n
        return out


_NUMBERED = f"""with {SEEN}, {_FLOW}, b as (select *, lag(action) over (partition by log_id, isolate, script_id order by line_no) as before from acts)
select log_id, line_no, isolate, script_id, action, row_number() over (partition by log_id, isolate, script_id order by line_no) as nth from b where action is distinct from before"""


@query("record_fold", _NUMBERED, recursive=True)
def record_fold(spark: SparkSession, d: str) -> DataFrame:
    """User code over records in order, blocks of a log side by side."""
    return records.run_records(lens.seen(spark, d), CombinedNumbers(), block=1000)


@query("record_fold_rounds", _NUMBERED, recursive=True)
def record_fold_rounds(spark: SparkSession, d: str) -> DataFrame:
    """The same by user code that can't put states together, block after block."""
    return records.run_records(lens.seen(spark, d), ActionNumbers(), block=50_000)


@query("multi_origin", f"""with {SEEN} select log_id, isolate, obj as obj_id, string_agg(distinct origin, '|' order by origin) as origins, string_agg(distinct name, '|' order by name) as names
from seen where op <> 'n' group by all having count(distinct origin) > 1""", recursive=True)
def multi_origin(spark: SparkSession, d: str) -> DataFrame:
    got = usage.multi_origin_objects(lens.seen(spark, d))
    return got.withColumns({"origins": joined(F.col("origins")), "names": joined(F.col("names"))})


@query("topk_features", f"with {SEEN} select name, count(*) as n_uses from named group by name order by n_uses desc, name limit 20", recursive=True)
def topk_features(spark: SparkSession, d: str) -> DataFrame:
    return usage.top_features(lens.seen(spark, d), 20)


@query("rollup_usage", f"with {SEEN} select origin, op, count(*) as n_uses from named group by rollup (origin, op)", recursive=True)
def rollup_usage(spark: SparkSession, d: str) -> DataFrame:
    return usage.usage_rollup(lens.seen(spark, d))


# ---- star schema


@query("mega_scripts", f"with {FLAGGED} select distinct sha2, size from fl where not is_injected", recursive=True)
def mega_scripts(spark: SparkSession, d: str) -> DataFrame:
    return star.script_rows(lens.flagged_scripts(spark, d)).select("sha2", "size")


_INST = """inst as (select *, sha256(concat(log_id, '|', sha2, '||', cast(size as varchar), '|', isolate, '|', cast(script_id as varchar))) as instance_hash from fl where not is_injected)"""


@query("mega_instances", f"""with {FLAGGED}, {_INST} select i.instance_hash, i.script_id, i.sha2, i.size, p.instance_hash as parent_hash,
case when i.url <> '' then sha256(i.url) end as script_url_sha256, case when i.first_origin <> '' then sha256(i.first_origin) end as origin_url_sha256 from inst i left join inst p on p.script_id = i.eval_parent_id""", recursive=True)
def mega_instances(spark: SparkSession, d: str) -> DataFrame:
    return star.instance_rows(lens.flagged_scripts(spark, d)).drop("log_id", "isolate", "sha3")


_USES = "uses as (select s.*, base, role, concat(coalesce(base, ctor), case when s.mem = '' then '' else concat('.', s.mem) end) as full_name from seen s left join idl on class = ctor and idl.mem = s.mem where s.mem <> '12')"


@query("mega_features", f"""with {SEEN}, {RESOLVED}, {_USES} select full_name as name, arg_min(ctor, (log_id, line_no)) as receiver_name, arg_min(mem, (log_id, line_no)) as member, max(base) as base, max(role) as role from uses group by full_name""", recursive=True)
def mega_features(spark: SparkSession, d: str) -> DataFrame:
    return star.feature_rows(star.full_usages(lens.seen(spark, d), idl.resolved(_idl(spark))))


@query("mega_usages", f"""with {SEEN}, {RESOLVED}, {_USES}, {_INST} select instance_hash, origin, full_name as name, offset_ as "offset", op, count(*) as n_uses from uses u join inst i on i.script_id = u.script_id group by all""", recursive=True)
def mega_usages(spark: SparkSession, d: str) -> DataFrame:
    uses = star.full_usages(lens.one_log(lens.seen(spark, d)), idl.resolved(_idl(spark)))
    return star.usage_rows(uses, lens.flagged_scripts(spark, d))


@query("surrogate_ids", "select c_name, c_custkey, row_number() over (order by c_name, c_custkey) as id from customer")
def surrogate_ids(spark: SparkSession, d: str) -> DataFrame:
    return star.surrogate(table(spark, d, "customer").select("c_name", "c_custkey"), ["c_name", "c_custkey"], "id")


_HOST_OF = "nullif(regexp_extract({}, '^[a-z]+://([^/?#:]+)', 1), '')"


@query("star_joins", f"""with {FLAGGED} select script_id, {_HOST_OF.format('url')} as script_hostname, {_HOST_OF.format('first_origin')} as origin_hostname from fl where not is_injected""", recursive=True)
def star_joins(spark: SparkSession, d: str) -> DataFrame:
    """Instances against the dimension of URLs under two names."""
    scripts = lens.flagged_scripts(spark, d)
    dim = urls.dimension(scripts.select("url").unionByName(scripts.select(F.col("first_origin").alias("url"))))
    return star.with_urls(star.instance_rows(scripts), dim, ("hostname",)).select("script_id", "script_hostname", "origin_hostname")


@query("star_scripts", f"""with {FLAGGED}, k as (select sha2, size, row_number() over (order by sha2, size) as script_key from (select distinct sha2, size from fl where not is_injected) x)
select script_id, script_key from fl join k using (sha2, size) where not is_injected""", recursive=True)
def star_scripts(spark: SparkSession, d: str) -> DataFrame:
    """Instances against imported scripts by all three parts of their key; the lens has no third digest, which counts as equal."""
    scripts = lens.flagged_scripts(spark, d)
    return star.imported(star.instance_rows(scripts), star.surrogate(star.script_rows(scripts), star.KEY, "script_key")).select("script_id", "script_key")


@query("star_features", f"""with {SEEN}, {RESOLVED}, {_USES}, {_INST}, n as (select full_name, row_number() over (order by full_name) as feature_id from (select distinct full_name from uses) x)
select full_name as name, feature_id, count(*) as n_rows, cast(sum(n) as bigint) as n_uses from (select instance_hash, origin, full_name, offset_, op, count(*) as n from uses u join inst i on i.script_id = u.script_id group by all) y join n using (full_name) group by all""", recursive=True)
def star_features(spark: SparkSession, d: str) -> DataFrame:
    """Usages against the dimension of features."""
    uses = star.full_usages(lens.one_log(lens.seen(spark, d)), idl.resolved(_idl(spark)))
    dim = star.surrogate(star.feature_rows(uses).select("name"), ["name"], "id")
    rows = star.with_features(star.usage_rows(uses, lens.flagged_scripts(spark, d)), dim)
    return rows.groupBy("name", "feature_id").agg(F.count("*").alias("n_rows"), F.sum("n_uses").alias("n_uses"))


@query("upsert_orders", "select o_custkey, count(*) as n_orders from orders where o_custkey not in (select c_custkey from customer where c_acctbal > 5000) group by o_custkey")
def upsert_orders(spark: SparkSession, d: str) -> DataFrame:
    """Rows that a target hasn't got."""
    have = table(spark, d, "customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    rows = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n_orders"))
    return urls.upsert(have, rows, ["o_custkey"])


# ---- URLs and HTML

_HOST = "regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)"


@query("url_parts", rf"""select page_id, sha256(url) as sha256, regexp_extract(url, '^([a-z]+):', 1) as scheme, {_HOST} as hostname, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) as path, regexp_extract(url, '\?([^#]*)', 1) as query,
regexp_extract({_HOST}, '([^.]+[.][^.]+)$', 1) as etld1, concat(regexp_extract({_HOST}, '([^.]+[.][^.]+)$', 1), regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1)) as stemmed from pages""")
def url_parts(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select("page_id", urls.parts(F.col("url")).alias("p"))
    return p.select("page_id", "p.sha256", "p.scheme", "p.hostname", "p.path", "p.query", "p.etld1", "p.stemmed")


@query("url_dim_upsert", f"select distinct sha256(url) as sha256, url as full from pages where url <> '' and url not in (select url from pages where {_HOST} like '%.org')")
def url_dim_upsert(spark: SparkSession, d: str) -> DataFrame:
    dim = urls.dimension(table(spark, d, "pages"))
    return urls.upsert(dim.filter("hostname like '%.org'").select("sha256"), dim, ["sha256"]).select("sha256", "full")


@query("url_schemeless", r"select page_id, concat('https://o.example$', regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*:', '')) as key from pages")
def url_schemeless(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", urls.link_key(F.col("url"), F.lit("https://o.example")).alias("key"))


@query("url_site", "select page_id, array_to_string(string_split(url, '/')[1:3], '/') as site from pages")
def url_site(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", urls.site(F.col("url")).alias("site"))


_INLINE = r"select page_id, sha256(unnest(regexp_extract_all(html, '(?s)<script[^>]*>(.*?)</script', 1))) as sha2 from pages"


@query("html_inline", _INLINE)
def html_inline(spark: SparkSession, d: str) -> DataFrame:
    """Inside the JVM, for well-formed pages."""
    return table(spark, d, "pages").select("page_id", F.explode(html.inline_scripts(F.col("html"))).alias("code")).select("page_id", hashes.sha2(F.col("code")).alias("sha2"))


@query("html_tokens", _INLINE)
def html_tokens(spark: SparkSession, d: str) -> DataFrame:
    """By the tokenizer that takes any page."""
    return html.tokenize(table(spark, d, "pages"), ["page_id"], "html").filter("kind = 'inline'").select("page_id", hashes.sha2(F.col("text")).alias("sha2"))


# ---- causality


_INCLUDED = "inc as (select page_id, s.url from pages join scr s on s.script_id = page_id * 3 where s.url <> '' union all select page_id, s.url from pages join scr s on s.script_id = page_id % 10 * 3 where s.url <> '')"


@query("include_join", f"""with {SCRIPTS}, src as (select script_id, url from scr where url <> ''), {_INCLUDED},
n1 as (select url, count(*) as n_includers from inc group by url), n2 as (select url, count(*) as n_sources from src group by url)
select script_id, page_id, n_includers, n_sources from src join inc using (url) join n1 using (url) join n2 using (url)""")
def include_join(spark: SparkSession, d: str) -> DataFrame:
    """Many to many by key, with how many there are on either side."""
    rest, includes = _loaded(spark, d)
    got = causality.met(rest, includes)
    return got.select(F.col("child_id").alias("script_id"), F.col("parent_id").alias("page_id"), "n_includers", "n_sources")


def _loaded(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Scripts with a URL, and pages as what includes them, all under one origin: each page one of its own, and one that others have too."""
    origin = F.lit("https://o.example")
    scripts = lens.scripts(spark, d).filter("url <> ''").withColumns({"first_origin": origin, "is_injected": F.lit(False)})
    pages = table(spark, d, "pages").select("page_id", F.explode(F.array(F.col("page_id") * 3, F.col("page_id") % 10 * 3)).alias("of"))
    pages = pages.join(scripts.select(F.col("script_id").alias("of"), "url"), "of")
    includes = pages.select(F.lit("all").alias("log_id"), F.lit("iso").alias("isolate"), F.col("page_id").alias("script_id"), urls.link_key(F.col("url"), origin).alias("key"), "url", F.lit(False).alias("by_write"))
    return causality.pool_of(scripts), includes


@query("causality_eval", f"with {FLAGGED} select 'eval' as genesis, script_id as child_id, sha2 as child_sha2, eval_parent_id as parent_id, p2 as parent_sha2 from (select f.*, p.sha2 as p2 from fl f left join fl p on p.script_id = f.eval_parent_id) x where not is_injected and eval_parent_id is not null", recursive=True)
def causality_eval(spark: SparkSession, d: str) -> DataFrame:
    return _causality(spark, d).filter("genesis = 'eval'").select("genesis", "child_id", "child_sha2", F.col("parent_id").cast("long"), "parent_sha2")


def _causality(spark: SparkSession, d: str, mode: str = "compat") -> DataFrame:
    return causality.causality(lens.one_log(lens.seen(spark, d)), lens.flagged_scripts(spark, d), mode)


@query("causality_compat", f"""with {FLAGGED}, {CTX},
frames as (select distinct arg as url from ctx c join fl on fl.script_id = c.script_id where not is_injected and origin <> '' and op = 's' and ((ctor = 'HTMLIFrameElement' and member = 'src') or (ctor = 'Location' and member = 'href') or member = 'location'))
select genesis, count(*) as n from (select 'eval' as genesis from fl where not is_injected and eval_parent_id is not null
union all select 'static' from fl where not is_injected and eval_parent_id is null
union all select 'static_iframe' from (select distinct first_origin from fl where not is_injected and eval_parent_id is null and first_origin not in (select url from frames)) o
union all select 'iframe' from (select distinct c.script_id, arg from ctx c join fl on fl.script_id = c.script_id where not is_injected and origin <> '' and op = 's' and ((ctor = 'HTMLIFrameElement' and member = 'src') or (ctor = 'Location' and member = 'href') or member = 'location')) f) x group by genesis""", recursive=True)
def causality_compat(spark: SparkSession, d: str) -> DataFrame:
    return _causality(spark, d).groupBy("genesis").agg(F.count("*").alias("n"))


def _rows_sql(mode: str) -> str:
    """Every link of the lens's causes, stage by stage."""
    key = lambda origin, url: f"concat({origin}, '$', regexp_replace({url}, '^[A-Za-z][A-Za-z0-9+.-]*:', ''))"
    row = lambda genesis, child="null", parent="null", by="null", child_frame="false", parent_frame="false", n_in="null", n_src="null": (
        f"select {genesis} as genesis, cast({child} as bigint) as child_id, cast({parent} as bigint) as parent_id, cast({by} as varchar) as by_url, {child_frame} as child_frame, {parent_frame} as parent_frame, cast({n_in} as bigint) as n_includers, cast({n_src} as bigint) as n_sources"
    )
    links = f"""cz as (select c.* from ({lens.CAUSES}) c join fl on fl.script_id = c.script_id where not is_injected and origin <> ''),
inc as (select distinct script_id, {key("origin", "url")} as key, url, k = 3 as by_write from cz where k in (0, 1, 3)),
ins as (select distinct script_id, sha256(code) as sha2, k = 4 as by_write from cz where k = 2 or k = 4 and code <> '' union select script_id, sha256(concat('go', cast(t_id as varchar), '()')), true from cz where k = 4),
frames as (select distinct script_id, text as url from cz where k in (5, 6)),
rest as (select *, case when url <> '' then {key("first_origin", "url")} end as key from fl where not is_injected and eval_parent_id is null),
unmet as (select * from rest where key is null or key not in (select key from inc)),
left_ as (select * from unmet where {"sha2 not in (select sha2 from ins)" if mode == "intent" else "true"})"""
    over = "unmet" if mode == "intent" else "(select * from unmet where key is null)"
    parts = [
        row("'eval'", "script_id", "eval_parent_id") + " from fl where not is_injected and eval_parent_id is not null",
        row("case when by_write then 'write_include' else 'include' end", "r.script_id", "i.script_id", "i.url", n_in="n1", n_src="n2")
        + " from rest r join inc i using (key) join (select key, count(*) as n1 from inc group by key) using (key) join (select key, count(*) as n2 from rest where key is not null group by key) using (key)",
        row("'iframe'", parent="script_id", by="url", child_frame="true") + " from frames",
        row("case when by_write then 'write_insert' else 'insert' end", "r.script_id", "i.script_id") + f" from {over} r join ins i using (sha2)",
        row("'static'", "script_id", by="first_origin", parent_frame="true") + " from left_ where key is not null",
        row("'static_iframe'", by="first_origin", child_frame="true") + " from (select distinct first_origin from left_ where key is not null and first_origin not in (select url from frames)) o",
        row("'unknown'", "script_id") + " from left_ where key is null and sha2 not in (select sha2 from ins)",
    ]
    return f"with {FLAGGED}, {links} " + " union all ".join(parts)


def _causes(spark: SparkSession, d: str, mode: str) -> DataFrame:
    got = causality.causality(lens.causes(spark, d), lens.flagged_scripts(spark, d), mode)
    return got.select("genesis", F.col("child_id").cast("long"), F.col("parent_id").cast("long"), "by_url", "child_frame", "parent_frame", "n_includers", "n_sources")


@query("causality_rows", _rows_sql("compat"), recursive=True)
def causality_rows(spark: SparkSession, d: str) -> DataFrame:
    return _causes(spark, d, "compat")


@query("causality_intent", _rows_sql("intent"), recursive=True)
def causality_intent(spark: SparkSession, d: str) -> DataFrame:
    return _causes(spark, d, "intent")


@query("causality_graphml", f"""with e as ({_rows_sql("compat").replace("with ", "with recursive ", 1)}) select 'all' as log_id, count(distinct by_url) as n_frames from e where child_frame or parent_frame""")
def causality_graphml(spark: SparkSession, d: str) -> DataFrame:
    """How many frames the graph has; tests look at whole documents."""
    scripts = lens.flagged_scripts(spark, d)
    made = causality.graphs(causality.causality(lens.causes(spark, d), scripts), scripts)
    frames = F.size(F.regexp_extract_all("value", F.lit('<data key="d6">true</data>'), F.lit(0)))
    return made.groupBy("log_id").agg(F.sum(frames).cast("long").alias("n_frames"))


@query("graph_degrees", f"""with {FLAGGED}, e as (select script_id as child, eval_parent_id as parent from fl where not is_injected and eval_parent_id is not null),
i as (select child as script_id, count(*) as n_in from e group by all), o as (select parent as script_id, count(*) as n_out from e group by all)
select coalesce(i.script_id, o.script_id) as script_id, coalesce(n_in, 0) as n_in, coalesce(n_out, 0) as n_out from i full join o on i.script_id = o.script_id""", recursive=True)
def graph_degrees(spark: SparkSession, d: str) -> DataFrame:
    got = causality.degrees(_causality(spark, d).filter("genesis = 'eval'"))
    return got.select("script_id", "n_in", "n_out")


@query("static_anti", f"with {SCRIPTS}, {_INCLUDED} select script_id from scr where url <> '' and url not in (select url from inc)")
def static_anti(spark: SparkSession, d: str) -> DataFrame:
    return causality.unmet(*_loaded(spark, d)).select("script_id")


# ---- parties and blocklists


@query("fptp", f"""with {SCRIPTS}, ent as (select concat('src', cast(n_nationkey as varchar), '.example') as d0, case when n_nationkey = 0 then 'example.com' when n_nationkey = 1 then 'example.fr' else concat('n', cast(n_nationkey as varchar), '.com') end as domain, n_name, cast(n_nationkey as double) / 10 as tracking from nation),
h as (select script_id, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) as script_host, regexp_extract(first_origin, '^[a-z]+://([^/?#:]+)', 1) as origin_host from scr where url <> ''),
o as (select h.*, coalesce(e1.n_name, script_host) as script_owner, coalesce(e1.tracking, 0.0) as tracking, coalesce(e2.n_name, origin_host) as origin_owner from h
left join ent e1 on e1.domain = case when script_host like '%.com' then 'example.com' else concat('example.', regexp_extract(script_host, '([a-z]+)$', 1)) end left join ent e2 on e2.domain = origin_host)
select script_id, script_owner, tracking, origin_owner, script_owner <> origin_owner as third_party from o""")
def fptp(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("n_nationkey")
    domain = F.when(key == 0, "example.com").when(key == 1, "example.fr").otherwise(F.concat(F.lit("n"), key.cast("string"), F.lit(".com")))
    ent = table(spark, d, "nation").select(domain.alias("domain"), F.col("n_name").alias("display_name"), (key.cast("double") / 10).alias("tracking"))
    return parties.parties(lens.scripts(spark, d).filter("url <> ''"), ent).select("script_id", "script_owner", "tracking", "origin_owner", "third_party")


@query("adblock_hosts", f"select page_id, {_HOST} as host, {_HOST} = 'example.org' or {_HOST} like '%.example.org' or {_HOST} = 'spam-farm.example.net' as blocked from pages")
def adblock_hosts(spark: SparkSession, d: str) -> DataFrame:
    rules = spark.createDataFrame([("||example.org^",), ("||spam-farm.example.net^",), ("/x*y",)], "rule string")
    pages = table(spark, d, "pages").select("page_id", urls.hostname(F.col("url")).alias("host"))
    return blocklist.blocked_hosts(pages, blocklist.host_rules(rules)).select("page_id", "host", "blocked")


@query("adblock", rf"""select page_id, (({_HOST} = 'example.org' or {_HOST} like '%.example.org') or contains(url, '/de/') or regexp_matches(url, 'page=2.*ref')) and not contains(url, '/fr/') as blocked from pages""")
def adblock(spark: SparkSession, d: str) -> DataFrame:
    rules = spark.createDataFrame([("||example.org^",), ("/de/",), ("page=2*ref",), ("@@/fr/",), ("! a note",)], "rule string")
    rows = table(spark, d, "pages").select("page_id", "url", F.lit("o.example").alias("origin_host"), F.lit(True).alias("third_party"))
    return blocklist.match(rows, rules).select("page_id", "blocked")


@query("adblock_options", rf"""select page_id, ({_HOST} like '%.example.com' and contains(url, '/fr/')) or ((contains({_HOST}, '.org') or regexp_matches(url, '/[0-9]+[.]html') or contains(url, 'utm_source')) and not contains(url, '/es/') and not contains(url, '/fr/')) as blocked from pages""")
def adblock_options(spark: SparkSession, d: str) -> DataFrame:
    """Types of requests, important rules over exceptions, regular expressions and letter case."""
    rules = [".org^$image,script", "/en/$image", "/net/$~script", "/[0-9]+[.]html/$third-party", "||example.com^fr/$script,important", "@@/es/", "@@/fr/", "UTM_source$match-case", "utm_source$match-case", "/de/$popunder", "! note"]
    rows = table(spark, d, "pages").select("page_id", "url", F.lit("o.example").alias("origin_host"), F.lit(True).alias("third_party"))
    return blocklist.match(rows, spark.createDataFrame([(x,) for x in rules], "rule string")).select("page_id", "blocked")


@query("adblock_joined", rf"""with p as (select page_id, url, case when page_id % 2 = 0 then 'shop.example' else 'news.shop.example' end as origin, page_id % 3 <> 0 as third from pages),
m as (select page_id, regexp_matches(url, '^[a-z]+://([^/?#]*[.])?example[.](com|org|net)/(en|fr|de)/[1-9].*page=') as numbered, contains(url, '.html') and third as html, contains(url, '/es/') and origin = 'news.shop.example' as es,
contains(url, 'utm_source') as feed, contains(url, '//blog.') and third as blog, regexp_matches(url, '/[0-9]{{2}}[#?]') as two from p)
select page_id, coalesce(blog or ((numbered or html or es or two) and not feed), false) as blocked from m""")
def adblock_joined(spark: SparkSession, d: str) -> DataFrame:
    """Rules found by their rarest key and verified by their own pattern, inside the JVM."""
    lines = [f"||example.{tld}^{lang}/{k}*page=" for tld in ("com", "org", "net") for lang in ("en", "fr", "de") for k in range(1, 10)]
    lines += [".html$third-party", "/es/$domain=news.shop.example|other.example", "@@utm_source", "//blog.$third-party,important", "/\\/[0-9]{2}[#?]/", "! note", "/en/$image"]
    even = F.col("page_id") % 2 == 0
    origin = F.when(even, "shop.example").otherwise("news.shop.example").alias("origin_host")
    rows = table(spark, d, "pages").select("page_id", "url", origin, (F.col("page_id") % 3 != 0).alias("third_party"))
    return blocking.match_by_joins(rows, spark.createDataFrame([(x,) for x in lines], "rule string")).select("page_id", "blocked")


@query("url_suffixes", rf"""with h as (select page_id, {_HOST} as host from pages)
select page_id, host, case when host like '%_.example.net' and host <> 'm.example.net' and not host like '%.m.example.net' then regexp_extract(host, '(([^.]+[.])?[^.]+[.]example[.]net)$', 1) end as own_net,
regexp_extract(host, '([^.]+[.]example[.]com)$', 1) as own_com from h""")
def url_suffixes(spark: SparkSession, d: str) -> DataFrame:
    """Registrable domains by a table of suffixes, with a wildcard and an exception."""
    rules = spark.createDataFrame([(x,) for x in ("com", "org", "net", "example.com", "*.example.net", "!m.example.net")], "suffix string")
    hosts = table(spark, d, "pages").select("page_id", urls.hostname(F.col("url")).alias("host"))
    got = urls.with_registrable(hosts, "host", rules)
    host = F.col("host")
    net = F.when(host.endswith(".example.net") & (host != "m.example.net") & ~host.endswith(".m.example.net"), F.col("etld1"))
    return got.select("page_id", "host", net.alias("own_net"), F.when(host.endswith(".example.com"), F.col("etld1")).otherwise("").alias("own_com"))


@query("html_kinds", r"""select page_id, len(regexp_extract_all(html, '<script[^>]*\ssrc=')) as n_src, len(regexp_extract_all(html, '<[a-z][^>]*\son[a-z]+=')) as n_handlers from pages""")
def html_kinds(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages")
    got = html.tokenize(pages, ["page_id"], "html").groupBy("page_id").agg(F.count(F.when(F.col("kind") == "src", 1)).alias("n_src"), F.count(F.when(F.col("kind") == "handler", 1)).alias("n_handlers"))
    return pages.select("page_id").join(got, "page_id", "left").select("page_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_src", "n_handlers")))


@query("entities_file", "select concat(lower(replace(n_name, ' ', '-')), '.example') as domain, n_name as display_name, case when n_nationkey % 2 = 0 then cast(n_nationkey as double) / 10 else 0.0 end as tracking from nation")
def entities_file(spark: SparkSession, d: str) -> DataFrame:
    """Owners of domains, written as the file that they come in and read back."""
    from spoor.session import shared_dir
    from spoor.sources import logs

    key = F.col("n_nationkey")
    entry = F.struct(F.col("n_name").alias("displayName"), F.when(key % 2 == 0, key.cast("double") / 10).alias("tracking"))
    domain = F.concat(F.lower(F.replace("n_name", F.lit(" "), F.lit("-"))), F.lit(".example"))
    whole = table(spark, d, "nation").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(domain, entry)))).alias("value"))  # 25 rows, one file
    at = f"{shared_dir(spark)}/entities-{uuid.uuid4().hex}"
    whole.coalesce(1).write.text(at)
    return logs.read_entities(spark, at)


@query("integrity", f"with {CTX} select log_id, line_no, 'unknown active script' as why from ctx where op = '!' and script_id is not null")
def integrity(spark: SparkSession, d: str) -> DataFrame:
    """What contradicts itself: the lens's logs name scripts that they don't define."""
    return context.trace_tables(lens.lines(spark, d), block=None).broken


@query("noop", "select count(*) as n_records from events")
def noop(spark: SparkSession, d: str) -> DataFrame:
    return lens.lines(spark, d).agg(F.count("*").alias("n_records"))


@query("live_context", _CTX_SQL)
def live_context(spark: SparkSession, d: str) -> DataFrame:
    """The same context by the streaming operator, over a finished stream of the table's lines."""
    from spoor.session import shared_dir
    from spoor.streaming import live

    at = f"{shared_dir(spark)}/live-{uuid.uuid4().hex}"
    lens.lines(spark, d).write.parquet(f"{at}/in")
    stream = spark.readStream.schema("log_id string, line_no long, line string").option("maxFilesPerTrigger", "1000").parquet(f"{at}/in")
    q = live.live_context(stream).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(live.CONTEXT).parquet(f"{at}/out").select("log_id", "line_no", "isolate", "script_id", "origin", "epoch")


@query("live_context_any_order", _CTX_SQL)
def live_context_any_order(spark: SparkSession, d: str) -> DataFrame:
    """The same context from micro-batches that hold the lines of each log in no order."""
    from spoor.session import shared_dir
    from spoor.streaming import live

    at = f"{shared_dir(spark)}/live-{uuid.uuid4().hex}"
    nth = F.row_number().over(Window.partitionBy("log_id").orderBy("line_no")) - 1
    lines = lens.lines(spark, d).withColumn("nth", nth.cast("long"))
    lines.repartition(6, F.xxhash64("line_no")).sortWithinPartitions(F.xxhash64("line")).write.parquet(f"{at}/in")
    before = {k: spark.conf.get(k, None) for k in live.STORE}
    try:
        for k, v in live.STORE.items():
            spark.conf.set(k, v)
        stream = spark.readStream.schema("log_id string, line_no long, line string, nth long").option("maxFilesPerTrigger", "2").parquet(f"{at}/in")
        q = live.live_context_any_order(stream, None).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(live.CONTEXT).parquet(f"{at}/out").select("log_id", "line_no", "isolate", "script_id", "origin", "epoch")


# ---- joins by order

_ASOF = """with p as (select user_id, event_id, ts, value from events where event_type = 'purchase'), v as (select user_id, ts as seen, event_id as seen_id, value as seen_value from events where event_type in ('view', 'click'))
select p.user_id, p.event_id, v.seen_id, v.seen_value from p asof left join v on p.user_id = v.user_id and p.ts >= v.seen"""


def _asof(spark: SparkSession, d: str, block: int | None) -> DataFrame:
    events = table(spark, d, "events")
    bought = events.filter("event_type = 'purchase'").select("user_id", "event_id", "ts", "value")
    seen = events.filter("event_type in ('view', 'click')").select("user_id", F.col("ts").alias("seen"), F.col("event_id").alias("seen_id"), F.col("value").alias("seen_value"))
    return ranges.asof(bought, seen, ["user_id"], "ts", "seen", ["seen_id", "seen_value"], block=block).select("user_id", "event_id", "seen_id", "seen_value")


@query("asof_join", _ASOF)
def asof_join(spark: SparkSession, d: str) -> DataFrame:
    """What a user looked at last before each purchase."""
    return _asof(spark, d, None)


@query("asof_join_blocked", _ASOF)
def asof_join_blocked(spark: SparkSession, d: str) -> DataFrame:
    """The same for keys of any length: rows numbered by ranges, blocks of them filled and carried on."""
    return _asof(spark, d, 500)


@query("interval_join", """select l_orderkey, l_linenumber, count(*) as n_open from lineitem join orders on o_orderkey >= l_orderkey - 3 and o_orderkey < l_orderkey + 4 group by all""")
def interval_join(spark: SparkSession, d: str) -> DataFrame:
    """Orders in the interval around each line's order, by bins of their number."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") - 3).alias("from_key"), (F.col("l_orderkey") + 4).alias("to_key"))
    orders = table(spark, d, "orders").select("o_orderkey")
    got = ranges.in_intervals(orders, lines, [], "o_orderkey", "from_key", "to_key", 64)
    return got.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n_open"))


@query("overlap_join", """with e as (select user_id, event_id, epoch_us(ts) // 1000000 as a, epoch_us(ts) // 1000000 + cast(floor(value) as bigint) * 60 as b from events),
x as (select * from e where user_id % 3 = 0), y as (select user_id, event_id as other_id, a as c, b as d from e)
select event_id, other_id from x join y using (user_id) where a < b and c < d and a < d and c < b and event_id < other_id""")
def overlap_join(spark: SparkSession, d: str) -> DataFrame:
    """Stretches of a user's events that overlap, by bins of an hour."""
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    e = table(spark, d, "events").select("user_id", "event_id", at.alias("a"), (at + F.floor("value") * 60).alias("b"))
    other = e.select("user_id", F.col("event_id").alias("other_id"), F.col("a").alias("c"), F.col("b").alias("d"))
    return ranges.overlapping(e.filter("user_id % 3 = 0"), other, ["user_id"], ("a", "b"), ("c", "d"), 3600).filter("event_id < other_id").select("event_id", "other_id")


@query("published_orders", "select o_orderkey, o_custkey from orders where o_orderkey % 3 <> 2")
def published_orders(spark: SparkSession, d: str) -> DataFrame:
    """Two runs published to one table, of which the second one is repeated and overlaps the first; a third is only staged."""
    from spoor.session import shared_dir
    from spoor.sources import sinks

    at = f"{shared_dir(spark)}/published-{uuid.uuid4().hex}"
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    for run, part in (("one", orders.filter("o_orderkey % 3 = 0")), ("two", orders.filter("o_orderkey % 3 <> 2")), ("two", orders.filter("o_orderkey % 3 <> 2"))):
        sinks.publish(part, at, run, ["o_orderkey"])
    orders.filter("o_orderkey % 3 = 2").write.parquet(f"{at}/data/killed")
    return sinks.published(spark, at)


# ---- sketches and variants


@query("sketch_counts", """select event_type, count(distinct user_id) as n_users, count(distinct event_id) as n_events, true as near_users, true as near_events, true as near_middle from events group by event_type""")
def sketch_counts(spark: SparkSession, d: str) -> DataFrame:
    """Distinct counts and the middle value, by states kept for each user and merged over them without looking at the events again, held against exact ones."""
    from spoor.operators import sketches

    events = table(spark, d, "events").withColumn("part", F.col("user_id") % 16)
    merged = sketches.merged(sketches.states(events, ["event_type", "part"], {"users": "user_id", "events": "event_id"}, {"middle": "value"}), ["event_type"], ["users", "events"], {"middle": 0.5})
    low, high = F.percentile("value", 0.5 - sketches.RANK_ERROR), F.percentile("value", 0.5 + sketches.RANK_ERROR)
    exact = events.groupBy("event_type").agg(F.count_distinct("user_id").alias("n_users"), F.count_distinct("event_id").alias("n_events"), low.alias("low"), high.alias("high"))
    near = lambda n: F.abs(F.col(n) - F.col(f"n_{n}")) <= sketches.COUNT_ERROR * F.col(f"n_{n}") + 1
    return exact.join(merged, "event_type").select("event_type", "n_users", "n_events", near("users").alias("near_users"), near("events").alias("near_events"), F.col("middle").between(F.col("low"), F.col("high")).alias("near_middle"))


@query("variant_props", """select event_id, cast(json_extract(props, '$.k') as bigint) as k, json_type(json_extract(props, '$.k')) is not null as has_k from events
union all select -event_id - 1, null, false from events""")
def variant_props(spark: SparkSession, d: str) -> DataFrame:
    """A JSON column as a variant: paths into it; text that is no JSON gives null, as each event's broken copy does."""
    from spoor.functions import variants

    events = table(spark, d, "events").select("event_id", "props")
    broken = events.select((-F.col("event_id") - 1).alias("event_id"), F.concat(F.lit("{"), F.coalesce("props", F.lit(""))).alias("props"))
    rows = variants.parsed(events.unionByName(broken), "props", "v")
    return rows.select("event_id", variants.at("v", "$.k", "bigint").alias("k"), variants.has("v", "$.k").alias("has_k"))


# ---- event time

#: Events in six micro-batches by time, of which every seventh comes two batches later. wm: the watermark that rows of a batch are
#: late by, which is what the batch before saw when it began; windows are closed by the newer one.
_ARRIVING = """arr as (select *, least(5, floor(event_id * 6 / (select max(event_id) + 1 from events)) + case when event_id % 7 = 0 then 2 else 0 end) as batch from events),
tops as (select batch, max(ts) as top from arr group by batch),
wm as (select b.batch, (select max(top) from tops t where t.batch < b.batch - 1) - interval 6 hour as wm from (select distinct batch from arr) b)"""


def _arriving(spark: SparkSession, d: str, close: str | None = None) -> DataFrame:
    """close: how long after all events a last micro-batch of one row comes."""
    from spoor.session import shared_dir
    from spoor.streaming import live

    events = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    total = events.agg(F.max("event_id") + 1).first()[0] or 1
    batch = F.least(F.lit(5), F.floor(F.col("event_id") * 6 / total) + F.when(F.col("event_id") % 7 == 0, 2).otherwise(0))
    rows = events.withColumn("batch", batch.cast("int"))
    if close is not None:
        rows = rows.unionByName(live.closing(rows, "ts", close).withColumn("batch", F.lit(6)))
    return live.in_batches(rows, "batch", 6 if close is None else 7, f"{shared_dir(spark)}/events-{uuid.uuid4().hex}")


def _finished(stream: DataFrame) -> DataFrame:
    from spoor.session import shared_dir
    from spoor.streaming import live

    return live.finished(stream, f"{shared_dir(stream.sparkSession)}/stream-{uuid.uuid4().hex}")


@query("live_counts", f"""with {_ARRIVING}, k as (select *, time_bucket(interval 1 hour, ts) as start from arr join wm using (batch)),
ok as (select * from k where wm is null or start + interval 1 hour > wm)
select start, event_type, count(*) as n from ok where start + interval 1 hour <= (select max(top) from tops) - interval 6 hour group by all""")
def live_counts(spark: SparkSession, d: str) -> DataFrame:
    """Events an hour from a stream, without those that come after the watermark has passed their hour; hours that are not over yet aren't there."""
    from spoor.streaming import live

    got = _finished(live.live_counts(_arriving(spark, d), "ts", ["event_type"], "6 hours", "1 hour").select(F.col("window.start").alias("start"), "event_type", F.col("count").alias("n")))
    return got.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("live_sessions", f"""with {_ARRIVING}, ok as (select * from arr join wm using (batch) where wm is null or ts + interval 90 minute > wm),
m as (select *, case when ts - lag(ts) over w < interval 90 minute then 0 else 1 end as fresh from ok window w as (partition by user_id order by ts, event_id)),
s as (select *, sum(fresh) over (partition by user_id order by ts, event_id) as nth from m),
g as (select user_id, min(ts) as start, max(ts) + interval 90 minute as "end", count(*) as n from s group by user_id, nth)
select user_id, start, "end", n from g where "end" <= (select max(top) from tops) - interval 6 hour""")
def live_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Stretches of a user's events with gaps of under 90 minutes, late events dropped. A stretch that an event came to after it had been
    put out is taken together with what it came in, also where that is still open at the end and the stretch so isn't over."""
    from spoor.streaming import live

    found = _finished(live.live_sessions(_arriving(spark, d, "10 hours"), "ts", ["user_id"], "6 hours", "90 minutes"))
    last = table(spark, d, "events").agg(F.max(F.col("ts").cast("timestamp")).alias("last"))
    got = live.whole_sessions(found, ["user_id"]).crossJoin(last).filter(F.col("end") <= F.col("last") - F.expr("interval 6 hours")).drop("last")
    return got.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query("live_distinct", f"""with {_ARRIVING}, twice as (select event_id, ts, batch from arr union all select event_id, ts, least(5, batch + 1) from arr where event_id % 5 = 0)
select event_id, min(ts) as ts from twice join wm using (batch) where wm is null or ts > wm group by event_id""")
def live_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Events that are sent again one batch later, once; events behind the watermark don't count."""
    from spoor.session import shared_dir
    from spoor.streaming import live

    events = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    total = events.agg(F.max("event_id") + 1).first()[0] or 1
    batch = F.least(F.lit(5), F.floor(F.col("event_id") * 6 / total) + F.when(F.col("event_id") % 7 == 0, 2).otherwise(0)).cast("int")
    once = events.select("event_id", "ts", batch.alias("batch"))
    twice = once.unionByName(once.filter("event_id % 5 = 0").withColumn("batch", F.least(F.lit(5), F.col("batch") + 1)))
    stream = live.in_batches(twice, "batch", 6, f"{shared_dir(spark)}/events-{uuid.uuid4().hex}")
    return _finished(live.live_distinct(stream, "ts", ["event_id"], "6 hours")).select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


# ---- table functions


@query("udtf_context", _CTX_SQL)
def udtf_context(spark: SparkSession, d: str) -> DataFrame:
    """The context by a table function from SQL: a log's lines dealt and sorted by Spark, the state in the function."""
    tables.register(spark)
    context.records(lens.lines(spark, d)).select("log_id", "line_no", "op", "fields").createOrReplaceTempView("lens_lines")
    return spark.sql("select log_id, line_no, isolate, script_id, origin, epoch from context_of(table(lens_lines) partition by log_id order by line_no)")


@query("udtf_scripts", _INLINE)
def udtf_scripts(spark: SparkSession, d: str) -> DataFrame:
    """Inline scripts by a table function, joined to each page's row."""
    tables.register(spark)
    table(spark, d, "pages").createOrReplaceTempView("lens_pages")
    return spark.sql("select page_id, sha2(s.text, 256) as sha2 from lens_pages, lateral scripts_in_html(html) s where s.kind = 'inline'")


@query("udtf_pass", _NUMBERED, recursive=True)
def udtf_pass(spark: SparkSession, d: str) -> DataFrame:
    """A user's record pass, registered at run time and called from SQL."""
    tables.register_pass(spark, "action_numbers", ActionNumbers())
    lens.seen(spark, d).createOrReplaceTempView("lens_seen")
    return spark.sql("select log_id, line_no, isolate, script_id, action, nth from action_numbers(table(select log_id, line_no, op, isolate, script_id, offset, tag, member from lens_seen) partition by log_id order by line_no)")
