"""Queries opN_<name> over the tables of a folder, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoor.llm import bpe, collocations, decontaminate, exact_dedup, line_dedup, merkle, mixing, pii, quality, secrets, simhash, token_counts, url_filter
from spoor.llm.common import table

#: The rules of the contract, as (verdict, host, path).
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
WEIGHTS = [3.0, 1.0, 2.0]
TOKEN_LIMIT = 4096
RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.keep_bitmaps(table(spark, sf_dir, "documents"), min_docs=10, keep_first=False, stored=True).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.scan(table(spark, sf_dir, "documents"), pii.labelled_table(spark))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans", "n_spans")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_counts.token_counts(table(spark, sf_dir, "documents"), limit=TOKEN_LIMIT)
    return found.select("doc_id", "n_bytes", "n_tokens", "over_limit", "within_limit", "prefix_counts")


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", F.array_join("mined_rule", " ").alias("mined_rule"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), WEIGHTS).select("doc_id", "size", "source_size", "target", "taken")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), stored=True)
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), "contaminated")


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secrets.scan(docs, secrets.samples_table(docs))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_spans")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = {"text": F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")}
    when = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    found = merkle.manifest(merkle.document_leaves(docs, tampered, when))
    proof = F.sha2(F.array_join("proof", "").cast("binary"), 256)
    return found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", "verified")


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.encoded(table(spark, sf_dir, "documents"), RANKS, back=True)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2("data", 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_line_dedup, op2_pii, op3_token_counts, op4_url_filters, op5_mixing, op6_exact_dedup, op7_quality, op8_decontamination, op9_secret_scans, op10_simhash, op11_collocations, op12_merkle, op13_byte_bpe)
}

def _merkle_sql(levels: int = 9, top_levels: int = 3) -> str:
    """Level by level: enough for 8 ** levels documents of a language and 8 ** top_levels languages."""
    fields = lambda text: ", ".join(f"coalesce(strlen({c}) || ':' || {c}, '-')" for c in ("doc_id::varchar", "source", "lang", "n_chars::varchar", text))
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    crc = "xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)), lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))))"
    out = f"""
with d as (select doc_id, case when lang is null then '0' else '1' || lang end as tree, sha256(concat({fields("text")})) as leaf, case when {crc} % 3 = 0 then sha256(concat({fields(lower)})) end as claim from documents),
n0 as (select tree, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by tree) as n, leaf as h from d),
p0 as (select doc_id, tree, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as i, leaf, '' as proof, coalesce(claim, leaf) as f from d)"""

    def up(k: int) -> str:
        return f""",
r{k} as (select tree, i // 8 as g, list(h order by i) as run, any_value(n) as n from n{k} where n > 1 group by tree, i // 8),
n{k + 1} as (select tree, g as i, (n + 7) // 8 as n, sha256(array_to_string(run, '')) as h from r{k} union all select tree, i, n, h from n{k} where n = 1),
p{k + 1} as (select p.* replace (p.i // 8 as i, p.proof || coalesce(array_to_string(run[1 : p.i % 8] || run[p.i % 8 + 2 : 8], ''), '') as proof,
             case when run is null then f else sha256(array_to_string(run[1 : p.i % 8], '') || f || array_to_string(run[p.i % 8 + 2 : 8], '')) end as f)
             from p{k} p left join r{k} r on p.tree = r.tree and p.i // 8 = r.g)"""

    for k in range(levels):
        out += up(k)
    k = levels + 1
    out += f""",
s as (select tree, h as subroot, row_number() over (order by tree) - 1 as i from n{levels}),
n{k} as (select 'top' as tree, i, (select count(*) from s) as n, subroot as h from s),
p{k} as (select p.doc_id, 'top' as tree, s.i, p.leaf, p.proof, p.f, s.subroot from p{levels} p join s using (tree))"""
    for k in range(levels + 1, levels + 1 + top_levels):
        out += up(k)
    k = levels + 1 + top_levels
    return out + f" select doc_id, leaf, subroot, h as root, sha256(proof) as proof_sha256, f as folded_root, f = h as verified from p{k} cross join (select h from n{k} limit 1)"


#: What the other queries compute (learned models, rounded copies, hashes with a seed, tokens) has no SQL.
ORACLES = {
    "op1_line_dedup": r"""
with d as (select doc_id, coalesce(text, '') as text, string_split(coalesce(text, ''), chr(10)) as lines from documents),
     l as (select doc_id, text, unnest(lines) as line, unnest(range(len(lines))) as pos from d),
     k as (select *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
     common as (select key from k where key <> '' group by key having count(distinct (doc_id, text)) >= 10),
     m as (select k.*, common.key is not null as gone from k left join common using (key))
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from m group by doc_id, text
""",
    "op6_exact_dedup": r"""
with d as (select doc_id, length(coalesce(text, '')) as n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256 from documents),
     r as (select *, first_value(doc_id) over w as keep_id, count(*) over (partition by text_sha256) as group_size, row_number() over w = 1 as kept
           from d window w as (partition by text_sha256 order by n desc, doc_id rows between unbounded preceding and unbounded following))
select doc_id, keep_id, group_size, kept, text_sha256 from r
""",
    "op8_decontamination": r"""
with iw as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
     win as (select distinct item_id, least(13, len(w)) as n, array_to_string(w[i + 1 : i + least(13, len(w))], ' ') as key
             from (select item_id, w, unnest(range(greatest(1, len(w) - 12))) as i from iw where len(w) > 0)),
     dw as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
     grams as (select doc_id, n, i, array_to_string(w[i + 1 : i + n], ' ') as key
               from (select doc_id, n, w, unnest(range(len(w) - n + 1)) as i from dw, (select distinct n from win) where len(w) >= n)),
     found as (select doc_id, item_id, i, g.n from grams g join win using (n, key)),
     hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from found) group by doc_id),
     items as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct doc_id, item_id::varchar as item_id from found) group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from dw left join hit using (doc_id) left join items using (doc_id)
""",
    "op11_collocations": r"""
with p as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
     w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from p),
     g as (select lang, m, array_to_string(w[i + 1 : i + m], ' ') as phrase from (select lang, w, m, unnest(range(len(w) - m + 1)) as i from w, (select unnest(range(1, 6)) as m) where len(w) >= m)),
     f as (select lang, m, phrase, count(*) as f from g group by all),
     n as (select lang, cast(sum(f) as bigint) as n from f where m = 1 group by lang),
     c as (select *, string_split(phrase, ' ') as w from f where m >= 2 and f >= 100),
     k as (select lang, m, phrase, f, unnest(range(1, m)) as k, w from c),
     s as (select k.lang, k.m, k.phrase, k.f as a, k.k, l.f as l, r.f as r, n.n, cast(1000::hugeint * k.f * n.n // (l.f::hugeint * r.f) as bigint) as score
           from k join f l on l.lang = k.lang and l.phrase = array_to_string(k.w[1 : k.k], ' ') join f r on r.lang = k.lang and r.phrase = array_to_string(k.w[k.k + 1 : k.m], ' ') join n on n.lang = k.lang),
     b as (select * from (select *, row_number() over (partition by lang, phrase order by score, k) as best from s) where best = 1),
     t as (select lang, f, w, m, unnest(range(2, m)) as size from c),
     d as (select lang, array_to_string(w[i + 1 : i + size], ' ') as phrase, max(f) as longer from (select *, unnest(range(m - size + 1)) as i from t) group by all)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score
from b left join d using (lang, phrase) where longer is null or 100 * longer < 100 * a
qualify rank <= 2000
""",
    "op12_merkle": _merkle_sql(),
}
