"""Where scripts come from: evals, inclusions, insertions, frames, and what stays unexplained.

Links are collected from the trace (rules), then scripts are resolved in stages, each over what the stages
before it left. mode "compat" takes the static stage before insertions; as every pooled script has a URL,
insertions and unknowns then stay empty. mode "intent" takes insertions first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spoor.functions import fields as f
from spoor.functions import hashes, html, urls
from spoor.session import written

NODE = ["log_id", "isolate", "script_id"]
EDGE = ["log_id", "genesis", "child_isolate", "child_id", "child_sha2", "child_frame", "parent_isolate", "parent_id", "parent_sha2", "parent_frame", "by_url", "n_includers", "n_sources"]


def links(trace: DataFrame) -> DataFrame:
    """log_id, isolate, script_id, origin, epoch, line_no, kind (include, insert, html, frame), text.

    The parts of records are written first: a filter on kind would otherwise be pushed below them, with
    every step of their codec in it as often as kind refers to them.
    """
    trace = trace.filter(F.col("op").isin("s", "c")).select(*NODE, "origin", "epoch", "line_no", "op", "tag", "member", F.slice("args", 1, 1).alias("args"))
    trace = written(trace, "causes")
    arg = F.get("args", F.lit(0))
    sets, calls = F.col("op") == "s", F.col("op") == "c"
    script, quoted = F.col("tag") == "HTMLScriptElement", f.has_pair(arg, '"', '"')
    kind = (
        F.when(sets & script & (F.col("member") == "src") & quoted, "include")
        .when(sets & script & F.col("member").isin("text", "innerText"), "insert")
        .when(calls & (F.col("tag") == "HTMLDocument") & F.col("member").isin("write", "writeln") & quoted, "html")
        .when(sets & F.col("member").isin("innerHTML", "outerHTML"), "html")
        .when(sets & (F.col("tag") == "HTMLIFrameElement") & (F.col("member") == "src"), "frame")
        .when(sets & (F.col("tag") == "HTMLIFrameElement") & (F.col("member") == "srcdoc"), "html")
        .when(sets & ((F.col("tag") == "Location") & (F.col("member") == "href") | (F.col("member") == "location")), "frame")
    )
    rows = trace.withColumns({"kind": kind, "text": f.strip_quotes(arg)}).filter("kind is not null and text is not null")
    return rows.select(*NODE, "origin", "epoch", "line_no", "kind", "text")


def streams(found: DataFrame) -> DataFrame:
    """NODE, origin, epoch, html: what a script wrote in one epoch of its origin, in order."""
    parts = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    return found.filter("kind = 'html'").groupBy(*NODE, "origin", "epoch").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "").alias("html"))


def causes(found: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(includes: NODE, key, url, by_write), (inserts: NODE, sha2, by_write), (frames: NODE, url)."""
    inner = html.tokenize(streams(found), [*NODE, "origin"], "html")
    includes = found.filter("kind = 'include'").select(*NODE, "origin", F.col("text").alias("url"), F.lit(False).alias("by_write"))
    includes = includes.unionByName(inner.filter("kind = 'src'").select(*NODE, "origin", F.col("text").alias("url"), F.lit(True).alias("by_write")))
    includes = includes.select(*NODE, urls.link_key(F.col("url"), F.col("origin")).alias("key"), "url", "by_write").distinct()
    inserts = found.filter("kind = 'insert'").select(*NODE, hashes.sha2(F.col("text")).alias("sha2"), F.lit(False).alias("by_write"))
    inserts = inserts.unionByName(inner.filter("kind in ('inline', 'handler')").select(*NODE, hashes.sha2(F.col("text")).alias("sha2"), F.lit(True).alias("by_write"))).distinct()
    return includes, inserts, found.filter("kind = 'frame'").select(*NODE, F.col("text").alias("url")).distinct()


def _parent(scripts: DataFrame) -> DataFrame:
    return scripts.select("log_id", F.col("isolate").alias("parent_isolate"), F.col("script_id").alias("parent_id"), F.col("sha2").alias("parent_sha2"))


def _edges(rows: DataFrame, **given) -> DataFrame:
    kinds = {"child_id": "int", "parent_id": "int", "child_frame": "boolean", "parent_frame": "boolean", "n_includers": "long", "n_sources": "long"}
    have = set(rows.columns)
    out = rows.withColumns({k: v for k, v in given.items()}) if given else rows
    missing = {c: F.lit(False if c.endswith("_frame") else None).cast(kinds.get(c, "string")) for c in EDGE if c not in have and c not in given}
    return (out.withColumns(missing) if missing else out).select(*EDGE)


def pool_of(scripts: DataFrame) -> DataFrame:
    """NODE, sha2, url, eval_parent_id, first_origin (empty where there is none), key (null without a URL) of scripts that aren't injected."""
    rows = scripts.filter("not is_injected").select(*NODE, "sha2", "url", "eval_parent_id", F.coalesce("first_origin", F.lit("")).alias("first_origin"))
    return rows.withColumn("key", F.when(F.col("url") != "", urls.link_key(F.col("url"), F.col("first_origin"))))


def _child() -> list[Column]:
    return [F.col("isolate").alias("child_isolate"), F.col("script_id").alias("child_id"), F.col("sha2").alias("child_sha2")]


def _as_parent() -> list[Column]:
    return [F.col("isolate").alias("parent_isolate"), F.col("script_id").alias("parent_id")]


def met(rest: DataFrame, includes: DataFrame) -> DataFrame:
    """Scripts of rest and the inclusions with their key, all with all, and how many there are on either side."""
    includer = includes.select("log_id", *_as_parent(), "key", F.col("url").alias("by_url"), "by_write")
    n_in = includes.groupBy("log_id", "key").agg(F.count("*").alias("n_includers"))
    n_src = rest.filter("key is not null").groupBy("log_id", "key").agg(F.count("*").alias("n_sources"))
    sized = rest.join(n_in, ["log_id", "key"]).join(n_src, ["log_id", "key"])
    return sized.select("log_id", "key", *_child(), "n_includers", "n_sources").join(includer, ["log_id", "key"])


def unmet(rest: DataFrame, includes: DataFrame) -> DataFrame:
    """Scripts of rest that no inclusion has the key of."""
    return rest.join(includes.select("log_id", "key").distinct(), ["log_id", "key"], "left_anti")


def inserted(rest: DataFrame, inserts: DataFrame) -> DataFrame:
    """Scripts of rest and the insertions of their code."""
    return rest.join(inserts.select("log_id", *_as_parent(), "sha2", "by_write"), ["log_id", "sha2"]).select("log_id", *_child(), "parent_isolate", "parent_id", "by_write")


def causality(trace: DataFrame, scripts: DataFrame, mode: str = "compat", root_domain: str = "") -> DataFrame:
    """EDGE columns: one row per link. Frames are nodes without a script, known by their URL in by_url."""
    pool = pool_of(scripts)
    includes, inserts, frames = causes(written(links(trace), "links"))
    includes, inserts = written(includes, "includes"), written(inserts, "inserts")
    parents = _parent(pool)
    on_parent = ["log_id", "parent_isolate", "parent_id"]
    write_or = lambda kind: F.when(F.col("by_write"), f"write_{kind}").otherwise(kind)

    evals = pool.filter("eval_parent_id is not null").select("log_id", *_child(), F.col("isolate").alias("parent_isolate"), F.col("eval_parent_id").alias("parent_id"))
    out = [_edges(evals.join(parents, on_parent, "left"), genesis=F.lit("eval"))]

    rest = written(pool.filter("eval_parent_id is null"), "pool")
    out.append(_edges(met(rest, includes).join(parents, on_parent, "left"), genesis=write_or("include")))
    left = unmet(rest, includes)

    framed = frames.select("log_id", *_as_parent(), F.col("url").alias("by_url")).join(parents, on_parent, "left")
    out.append(_edges(framed, genesis=F.lit("iframe"), child_frame=F.lit(True)))

    def insertions(rows: DataFrame) -> DataFrame:
        return _edges(inserted(rows, inserts).join(parents, on_parent, "left"), genesis=write_or("insert"))

    codes = inserts.select("log_id", "sha2").distinct()
    if mode == "intent":
        out.append(insertions(left))
        left = left.join(codes, ["log_id", "sha2"], "left_anti")
    static = left.filter("key is not null")
    at_root = F.col("first_origin") == root_domain
    known = frames.select("log_id", F.col("url").alias("first_origin")).distinct().withColumn("_known", F.lit(True))
    placed = static.join(known, ["log_id", "first_origin"], "left")
    in_frame = F.col("_known").isNotNull() | ~at_root
    out.append(_edges(placed.select("log_id", *_child(), in_frame.alias("parent_frame"), F.when(in_frame, F.col("first_origin")).alias("by_url")), genesis=F.lit("static")))
    new = placed.filter(F.col("_known").isNull() & ~at_root).select("log_id", F.col("first_origin").alias("by_url")).distinct()
    out.append(_edges(new, genesis=F.lit("static_iframe"), child_frame=F.lit(True)))
    if mode == "compat":
        unplaced = left.filter("key is null")
        out.append(insertions(unplaced))
        left = unplaced.join(codes, ["log_id", "sha2"], "left_anti")
    out.append(_edges(left.filter("key is null").select("log_id", *_child()), genesis=F.lit("unknown")))
    all_edges = out[0]
    for e in out[1:]:
        all_edges = all_edges.unionByName(e)
    return all_edges


def degrees(edges: DataFrame) -> DataFrame:
    """log_id, isolate, script_id, n_in, n_out of the scripts of a causality graph."""
    ins = edges.filter("child_id is not null").groupBy("log_id", F.col("child_isolate").alias("isolate"), F.col("child_id").alias("script_id")).agg(F.count("*").alias("n_in"))
    outs = edges.filter("parent_id is not null").groupBy("log_id", F.col("parent_isolate").alias("isolate"), F.col("parent_id").alias("script_id")).agg(F.count("*").alias("n_out"))
    return ins.join(outs, ["log_id", "isolate", "script_id"], "full").select("log_id", "isolate", "script_id", F.coalesce("n_in", F.lit(0)).cast("long").alias("n_in"), F.coalesce("n_out", F.lit(0)).cast("long").alias("n_out"))


#: Nodes or edges in a part of a document, some.
PART = 1000

#: What is said of nodes and edges: name, type. A number in this list is that of the key.
DATA = {
    ("node", "isRoot"): "boolean", ("node", "isolateKey"): "string", ("node", "scriptID"): "int", ("node", "bytes"): "int", ("node", "sha2"): "string", ("node", "url"): "string",
    ("node", "isIframe"): "boolean", ("node", "firstOrigin"): "string", ("edge", "action"): "string", ("edge", "url"): "string",
}
HEAD = "\n".join([
    '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">',
    *(f'  <key id="d{i}" for="{target}" attr.name="{name}" attr.type="{kind}" />' for i, ((target, name), kind) in enumerate(DATA.items())),
    '  <graph edgedefault="directed">',
])
FOOT = "  </graph>\n</graphml>"


def _element(target: str, head: Column, **data: Column) -> Column:
    """The lines of a node or edge; what is null isn't said."""
    lines = [F.concat(F.lit(f"    <{target} "), head, F.lit(">"))]
    for name, c in data.items():
        key, c = f'      <data key="d{list(DATA).index((target, name))}"', c.cast("string")
        for plain, coded in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            c = F.replace(c, F.lit(plain), F.lit(coded))
        lines.append(F.when(c == "", f"{key} />").when(c.isNotNull(), F.concat(F.lit(f"{key}>"), c, F.lit("</data>"))))
    return F.concat_ws("\n", *lines, F.lit(f"    </{target}>"))


def _script_key(isolate: str, number: str) -> Column:
    return F.concat(F.lit("s"), F.col(number).cast("long").cast("string"), F.lit(","), F.coalesce(F.concat(F.lit("1"), isolate), F.lit("0")))


def _frame_key() -> Column:
    return F.concat(F.lit("f"), F.coalesce(F.concat(F.lit("1"), "by_url"), F.lit("0")))


def _numbered(nodes: DataFrame, part: int) -> DataFrame:
    """log_id, key, id, part, text of nodes. Numbers go from 1 in each log, without gaps: nodes are dealt by a hash into parts, ordered within these, and parts count on from those before."""
    large = nodes.groupBy("log_id").agg(F.count("*").alias("_n")).filter(F.col("_n") > part)  # a row for PART nodes at most; by broadcast, as one log may have all nodes
    dealt = nodes.join(F.broadcast(large), "log_id", "left").withColumn("part", F.expr(f"pmod(xxhash64(key), cast(ceil(coalesce(_n, 1) / {part}) as bigint))")).drop("_n")
    counts = dealt.groupBy("log_id", "part").agg(F.count("*").alias("_n"))  # a row for PART nodes
    before = Window.partitionBy("log_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("log_id", "part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    nth = F.row_number().over(Window.partitionBy("log_id", "part").orderBy("_kind", "_a", "_b"))
    return dealt.withColumn("_nth", nth).join(starts, ["log_id", "part"]).select("log_id", "key", (F.col("_start") + F.col("_nth")).alias("id"), "part", "_kind", "_says")


def graphs(edges: DataFrame, scripts: DataFrame, part: int = PART) -> DataFrame:
    """log_id, part, value: the GraphML document of each log, in parts of some PART nodes or edges that a newline between them puts together, by part.

    Nodes are a root, scripts and frames, and come before edges, one for each pair of nodes; what no edge leads to is under the root. A small
    graph is one part and so its whole document. No log's graph comes together in one place.
    """
    scripts = scripts.filter("not is_injected and script_id is not null")
    child = F.when(F.col("child_frame"), _frame_key()).otherwise(_script_key("child_isolate", "child_id"))
    parent = F.when(F.col("parent_frame"), _frame_key()).otherwise(_script_key("parent_isolate", "parent_id"))
    order = F.struct(*(F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in ("genesis", "child_isolate", "child_id", "parent_isolate", "parent_id", "by_url")))
    framed = F.when(F.col("child_frame") | F.col("parent_frame"), _frame_key()).alias("frame")
    links = written(edges.filter("genesis is not null").select("log_id", child.alias("child"), parent.alias("parent"), framed, order.alias("order"), "genesis", "by_url"), "edges")

    of = {"isolateKey": "isolate", "scriptID": "script_id", "bytes": "size", "sha2": "sha2", "url": "url", "firstOrigin": "first_origin"}
    says = F.struct(*(F.col(c).cast("string").alias(k) for k, c in of.items()))
    nodes = scripts.select("log_id", _script_key("isolate", "script_id").alias("key"), F.lit(1).alias("_kind"), F.coalesce("isolate", F.lit("")).alias("_a"), F.col("script_id").cast("long").alias("_b"), says.alias("_says"))
    frame_says = F.struct(*((F.col("by_url") if k == "url" else F.lit(None).cast("string")).alias(k) for k in of))
    frames = links.filter("frame is not null").select("log_id", F.col("frame").alias("key"), F.lit(2).alias("_kind"), F.col("by_url").alias("_a"), F.lit(None).cast("long").alias("_b"), frame_says.alias("_says"))
    nodes = written(_numbered(nodes.unionByName(frames).dropDuplicates(["log_id", "key"]), part), "nodes")

    ids = lambda end: nodes.select("log_id", F.col("key").alias(end), F.col("id").alias(f"{end}_no"))
    both = links.join(ids("child"), ["log_id", "child"]).join(ids("parent"), ["log_id", "parent"], "left")
    both = both.withColumn("parent_no", F.coalesce("parent_no", F.lit(0))).filter("child_no <> parent_no")
    pairs = written(both.groupBy("log_id", "parent_no", "child_no").agg(F.min_by(F.struct("genesis", "by_url"), "order").alias("_first")).select("log_id", "parent_no", "child_no", "_first.*"), "pairs")
    under = nodes.select("log_id", F.col("id").alias("child_no")).join(pairs.select("log_id", "child_no"), ["log_id", "child_no"], "left_anti")
    arrows = pairs.unionByName(under.select("log_id", F.lit(0).cast("long").alias("parent_no"), "child_no", F.lit("unknown").alias("genesis"), F.lit(None).cast("string").alias("by_url")))

    # one edge at most for each pair, and one for each node; logs have their links' frames at least as nodes, so those without a node have only a root
    counted = nodes.groupBy("log_id").agg(F.count("*").alias("_n")).unionByName(links.groupBy("log_id").agg(F.lit(0).cast("long").alias("_n"))).groupBy("log_id").agg(F.sum("_n").alias("_n"))
    sizes = counted.join(pairs.groupBy("log_id").agg(F.count("*").alias("_e")), "log_id", "left").selectExpr("log_id", "_n", "_n + coalesce(_e, 0) as _e")
    small = F.col("_n") + F.col("_e") < part
    places = sizes.select("log_id", F.when(small, 0).otherwise(F.greatest(F.ceil(F.col("_n") / part), F.lit(1))).alias("_start"), F.when(small, 1).otherwise(F.greatest(F.ceil(F.col("_e") / part), F.lit(1))).alias("_parts"))
    row = lambda rows, at, kind, a, b, text: rows.select("log_id", at.cast("long").alias("part"), F.struct(F.lit(kind).alias("kind"), a.cast("long").alias("a"), b.cast("long").alias("b"), text.alias("text")).alias("row"))
    zero, said = F.lit(0), F.col("_says")
    script, frame = F.col("_kind") == 1, F.col("_kind") == 2
    node = lambda number, **data: _element("node", F.concat(F.lit('id="n'), number, F.lit('"')), **data)
    told = node(F.col("id"), isRoot=F.when(script, "false"), **{k: said[k] for k in ("isolateKey", "scriptID", "bytes", "sha2", "url")}, isIframe=F.when(script, "false").when(frame, "true"), firstOrigin=said["firstOrigin"])
    arrow = _element("edge", F.concat(F.lit('source="n'), "parent_no", F.lit('" target="n'), "child_no", F.lit('"')), action=F.col("genesis"), url=F.col("by_url"))
    out = row(places, zero, 0, zero, zero, F.concat(F.lit(f"{HEAD}\n"), node(zero, isRoot=F.lit("true"))))
    out = out.unionByName(row(nodes, F.col("part"), 1, F.col("id"), zero, told))
    large = F.broadcast(places.filter("_start > 0 or _parts > 1"))  # as few as those of nodes
    out = out.unionByName(row(arrows.join(large, "log_id", "left"), F.expr("coalesce(_start, 0) + pmod(xxhash64(parent_no, child_no), coalesce(_parts, 1))"), 2, F.col("parent_no"), F.col("child_no"), arrow))
    out = out.unionByName(row(places, F.col("_start") + F.col("_parts") - 1, 3, zero, zero, F.lit(FOOT)))
    lines = F.transform(F.array_sort(F.collect_list("row")), lambda x: x["text"])
    return out.repartition("log_id", "part").groupBy("log_id", "part").agg(F.array_join(lines, "\n").alias("value"))
