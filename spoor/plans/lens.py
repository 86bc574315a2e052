"""The driver's tables seen as a trace, so that every operator can be compared with SQL over the same rows.

The SELECTs here run in Spark and in DuckDB alike. Events become records of one log per user, documents
become scripts, pages give URLs and HTML, nations give owners of domains.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoor.plans import context
from spoor.session import table, written

CTORS = ["Window", "HTMLDocument", "HTMLScriptElement", "Location", "HTMLIFrameElement", "Array", "?", "<anonymous>"]
MEMBERS = ["createElement", "src", "href", "write", "innerHTML", "eval", "12", "cookie", "location", "length"]
TAGS = ["DIV", "Span", "script", "iframe", "a"]


def _pick(values: list[str], index: str) -> str:
    return "case " + index + " " + " ".join(f"when {i} then '{v}'" for i, v in enumerate(values)) + " end"


#: log_id, line_no, op, k, f0 (isolate, script or origin), obj, ctor, member, arg, sub (what a record of the Java bridge does).
RECORDS = f"""
select concat('log', cast(user_id as string)) as log_id, event_id as line_no, k,
       case when event_type = 'signup' then '~' when event_type = 'error' and k % 3 = 0 then '@' when event_type = 'error' then '!'
            when event_type = 'view' then 'g' when event_type = 'click' then 'c' when k % 10 = 0 then 'n' when k % 10 = 5 then 'j' else 's' end as op,
       case when event_type = 'signup' then concat('iso', cast(k % 3 as string)) when event_type = 'error' and k % 3 = 0 then concat('https://o', cast(k % 5 as string), '.example')
            when event_type = 'error' and k = 99 then '?' when event_type = 'error' then cast(k % 40 as string) end as f0,
       cast(event_id % 50 as string) as obj, {_pick(CTORS, "(v % 8)")} as ctor, {_pick(MEMBERS, "(k % 10)")} as member, {_pick(TAGS, "(v % 5)")} as arg, {_pick(["g", "s", "c", "n"], "(event_id % 4)")} as sub
from (select *, cast(regexp_extract(props, '([0-9]+)', 1) as int) as k, cast(floor(value) as int) as v from events) e
"""

#: log_id, line_no, line: the records as the emitter would write them.
LINES = f"""
select log_id, line_no, case
    when op in ('~', '!') then concat(op, f0)
    when op = '@' then concat('@"', replace(f0, ':', '\\:'), '":"t"')
    when op = 'g' then concat('g', cast(k as string), ':{{', obj, ',', ctor, '}}:"', member, '"')
    when op = 's' then concat('s', cast(k as string), ':{{', obj, ',', ctor, '}}:"', member, '":"', arg, '"')
    when op = 'j' then concat('j', cast(k as string), ':', sub, case sub when 'c' then concat(':%<anonymous>:{{', obj, ',', ctor, '}}:#U') when 'n' then concat(':%', ctor) else concat(':{{', obj, ',', ctor, '}}:"', member, '"') end, ':"', arg, '"')
    when op = 'c' then concat('c', cast(k as string), ':%', member, ':{{', obj, ',', ctor, '}}:"', arg, '"')
    else concat('n', cast(k as string), ':%', ctor, ':"', arg, '"') end as line
from ({RECORDS}) r
"""

#: Scripts: every third document is loaded from a URL, the others are evals of the document a third on.
SCRIPTS = """
select 'all' as log_id, 'iso' as isolate, doc_id as script_id, doc_id as line_no, coalesce(text, '') as code,
       case when doc_id % 30 = 0 then '' when doc_id % 3 = 0 then concat('https://', source, '.example.', case when lang = 'en' then 'com' else lang end, '/', lang, '/', cast(doc_id as string)) end as url,
       case when doc_id % 3 <> 0 then cast(floor(doc_id / 3) as bigint) end as eval_parent_id, concat('https://', lang, '.example') as first_origin
from documents
"""

#: Records that bring scripts about: a document acts on the one three times its number on. Each kind of cause once.
CAUSES = f"""
select 'all' as log_id, 'iso' as isolate, a.script_id, a.script_id * 2 + part as line_no, cast(1 as bigint) as epoch, k,
       case when k = 1 then 'https://zz.example' else t.first_origin end as origin, case when k = 3 then 'c' else 's' end as op,
       case k when 3 then 'HTMLDocument' when 4 then 'HTMLDivElement' when 5 then 'HTMLIFrameElement' when 6 then 'Location' else 'HTMLScriptElement' end as tag,
       case k when 2 then 'text' when 3 then 'write' when 4 then 'innerHTML' when 6 then 'href' else 'src' end as member, t.script_id as t_id, t.url, t.code,
       case k when 2 then t.code when 5 then case when t.first_origin in ('https://en.example', 'https://de.example') then t.first_origin else 'https://other.example' end
              when 6 then concat('https://loc', cast(t.script_id % 5 as string), '.example')
              when 3 then case when part = 0 then '<scr' else concat('ipt src=', t.url, '></script>') end
              when 4 then concat('<b onclick=go', cast(t.script_id as string), '()>x</b><script>', t.code, '</script>') else t.url end as text
from (select *, script_id % 7 as k from ({SCRIPTS}) s) a join ({SCRIPTS}) t on t.script_id = a.script_id * 3 join (select 0 as part union all select 1) p on part = 0 or k = 3
where a.script_id > 0 and not (k in (0, 1, 3) and t.url = '')
"""


def view(spark: SparkSession, sf_dir: str, name: str, sql: str) -> DataFrame:
    """A SELECT of this module over one of the driver's tables."""
    at = f"lens_{name}"
    table(spark, sf_dir, name).createOrReplaceTempView(at)
    return spark.sql(sql.replace(f"from {name}", f"from {at}"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.parser.escapedStringLiterals", "true")
    try:
        return view(spark, sf_dir, "events", LINES)
    finally:
        spark.conf.unset("spark.sql.parser.escapedStringLiterals")


def context_rows(spark: SparkSession, sf_dir: str, block: int | None = None) -> DataFrame:
    return context.with_context(context.records(lines(spark, sf_dir)), block)


def scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spoor.functions import hashes

    rows = view(spark, sf_dir, "documents", SCRIPTS)
    return rows.withColumns({"sha2": hashes.sha2(F.col("code")), "size": hashes.size(F.col("code"))})


def flagged_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.flag_injected(scripts(spark, sf_dir))


def seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counted records, with the lens's scripts known by their number alone. Their parts are written first, as trace_tables() does."""
    rows = written(context.payload(context_rows(spark, sf_dir)), "trace")
    return context.in_page(rows, flagged_scripts(spark, sf_dir), ("script_id",))


def causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CAUSES as counted records."""
    rows = view(spark, sf_dir, "documents", CAUSES).withColumn("args", F.array(F.concat(F.lit('"'), "text", F.lit('"'))))
    return context.in_page(rows, flagged_scripts(spark, sf_dir))


def one_log(rows: DataFrame) -> DataFrame:
    """Records of all the lens's logs as records of the log that its scripts are of."""
    return rows.withColumns({"log_id": F.lit("all"), "isolate": F.lit("iso")})
