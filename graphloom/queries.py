"""The registered queries, each with its DuckDB equivalent where SQL has one."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import adapters as A
from graphloom.config import BudgetConfig, Coefficients
from graphloom.functions import parsing, scores, text
from graphloom.operators import datasets, findings, graph, ranking, reports, selection, spans
from graphloom.plans import assemble, tuning

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- scans, coercion, projections

@query("select d.doc_id, d.lang, d.n_chars from documents d join labels l using (doc_id) where l.quality = 1 and d.lang <> 'en' and d.n_chars >= 200")
def scan_project_filter(spark, sf):
    docs = A.table(spark, sf, "documents").filter("lang <> 'en' and n_chars >= 200")
    return docs.join(A.table(spark, sf, "labels").filter("quality = 1").select("doc_id"), "doc_id").select("doc_id", "lang", "n_chars")


@query("""
select event_id, case when user_id % 2 = 0 then 0 else user_id end::int as n, lower(trim(w)) in ('true', '1', 'yes') as flag
from (select *, case event_id % 4 when 0 then ' TRUE' when 1 then 'yes ' when 2 then 'no' else '1' end as w from events)""")
def coerce_rows(spark, sf):
    e = A.table(spark, sf, "events")
    number = F.concat(F.col("user_id").cast("string"), F.when(F.col("user_id") % 2 == 0, F.lit(".0")).otherwise(F.lit("")))
    word = F.element_at(F.array(*map(F.lit, (" TRUE", "yes ", "no", "1"))), (F.col("event_id") % 4 + 1).cast("int"))
    return e.select("event_id", parsing.to_int(number).alias("n"), parsing.to_bool(word).alias("flag"))


@query("select event_id, event_type, (props->>'$.k')::int as k from events where (props->>'$.k')::int >= 50")
def json_props(spark, sf):
    e = A.table(spark, sf, "events").withColumn("k", F.from_json("props", "k int")["k"])
    return e.filter("k >= 50").select("event_id", "event_type", "k")


@query("""
select page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) as host, regexp_extract(url, '^[a-z]+://[^/]+([^?#]*)', 1) as path,
  regexp_replace(regexp_replace(regexp_extract(url, '^[a-z]+://[^/]*/?(.*)$', 1), '(\\.git)?/*$', ''), '[^A-Za-z0-9._-]+', '_', 'g') as dir_name
from pages""")
def url_parse(spark, sf):
    p = A.table(spark, sf, "pages")
    return p.select("page_id", F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), F.regexp_extract("url", "^[a-z]+://[^/]+([^?#]*)", 1).alias("path"), text.repo_dir_name(F.col("url")).alias("dir_name"))


@query("""
select page_id, 'https://host/owner/' || page_id as repo_url, md5(url) as hash from pages where page_id % 3 <> 0""")
def commit_url_parse(spark, sf):
    p = A.table(spark, sf, "pages")
    kind = F.when(F.col("page_id") % 3 == 0, F.lit("tree")).otherwise(F.lit("commit"))
    url = F.concat(F.lit("https://host/owner/"), F.col("page_id").cast("string"), F.lit("/"), kind, F.lit("/"), F.md5(F.col("url").cast("binary")), F.lit("?x=1"))
    return p.select("page_id", parsing.commit_url(url).alias("c")).filter("c is not null").select("page_id", "c.*")


# ---------------------------------------------------------------- graph building

@query("""
select l_orderkey, l_linenumber, l_partkey, l_quantity from (
  select *, row_number() over (partition by l_orderkey, l_linenumber order by l_shipdate desc, l_partkey desc, l_suppkey desc, l_quantity desc, l_extendedprice desc) as rn from lineitem) where rn = 1""")
def node_upsert(spark, sf):
    rows = A.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    order = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    return graph.last_write(rows, ["l_orderkey", "l_linenumber"], order, per_property=False).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query(f"""with {A.TRADE_SQL},
more as (select * from edges union select 's:' || s_suppkey, 's:' || s_suppkey, 'USED_BY' from supplier where s_suppkey % 2 = 0),
known as (select identifier from nodes where not (kind = 'supplier' and substr(identifier, 3)::bigint % 5 = 0) and not (kind = 'orders' and substr(identifier, 3)::bigint % 3 = 0))
select src, dst, type from more where src in (select identifier from known) and dst in (select identifier from known)""")
def edge_merge_endpoints(spark, sf):
    """Self loops at every second supplier; every fifth supplier and third order is unknown, so edges dangle at either end."""
    number = F.substring("identifier", 3, 30).cast("long")
    unknown = (F.col("kind") == "supplier") & (number % 5 == 0) | (F.col("kind") == "orders") & (number % 3 == 0)
    own = F.concat(F.lit("s:"), F.col("s_suppkey").cast("string"))
    loops = A.table(spark, sf, "supplier").filter("s_suppkey % 2 = 0").select(own.alias("src"), own.alias("dst"), F.lit("USED_BY").alias("type"))
    edges = A.trade_edges(spark, sf).union(loops).withColumns({"operation": F.lit(None).cast("string"), "ord": F.lit(0).cast("long")})
    return graph.merge_edges(edges, A.trade_nodes(spark, sf).filter(~unknown)).select("src", "dst", "type")


@query(f"with {A.TRADE_SQL} select type, count(*) as n from edges group by 1")
def edge_type_counts(spark, sf):
    g = A.trade_graph(spark, sf)
    return g.edges.filter(F.col("type").isin(*g.types)).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- lookups and spans

_FINDINGS_SQL = """
f as (
  select 'A:' || l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey as id, 'bandit' as tool, l_orderkey::varchar as file, l_linenumber as line, case when l_quantity <= 16 then 'LOW' when l_quantity <= 33 then 'MEDIUM' else 'HIGH' end as severity,
    (l_partkey % 120)::int as cwe, null::int as issue from lineitem where l_returnflag = 'R'
  union
  select 'B:' || l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey, 'dlint', l_orderkey::varchar, l_linenumber, null, null, (100 + l_suppkey % 45)::int from lineitem where l_linestatus = 'F')"""


def _findings(spark, sf, repeats: bool = False) -> DataFrame:
    """Findings are made distinct as the numbers they are made of; with ``repeats`` they are not, for what drops repeats itself."""
    rows, keys = A.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    once = (lambda df: df) if repeats else DataFrame.distinct
    name = lambda tool: F.concat_ws(":", F.lit(tool), *[F.col(c).cast("string") for c in keys]).alias("id")
    where = [F.col("l_orderkey").cast("string").alias("file"), F.col("l_linenumber").alias("line_number")]
    grade = F.when(F.col("l_quantity") <= 16, "LOW").when(F.col("l_quantity") <= 33, "MEDIUM").otherwise("HIGH").alias("severity")
    a = once(rows.filter("l_returnflag = 'R'").select(*keys, grade)).select(name("A"), F.lit("bandit").alias("tool"), *where, "severity", F.expr("cast(l_partkey % 120 as int)").alias("cwe_id"), F.lit(None).cast("int").alias("issue_id"))
    b = once(rows.filter("l_linestatus = 'F'").select(*keys)).select(name("B"), F.lit("dlint").alias("tool"), *where, F.lit(None).cast("string").alias("severity"), F.lit(None).cast("int").alias("cwe_id"), F.expr("cast(100 + l_suppkey % 45 as int)").alias("issue_id"))
    return a.union(b)


_SPAN_NODES_SQL = """
sn as (select 'n:' || l_orderkey || ':' || l_linenumber as identifier, l_orderkey::varchar as file_path, l_linenumber as line_start, max(l_linenumber + (l_quantity::int % 3))::int as line_end from lineitem group by l_orderkey, l_linenumber)"""


def _span_nodes(spark, sf) -> DataFrame:
    rows = A.table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max(F.col("l_linenumber") + F.col("l_quantity").cast("int") % 3).cast("int").alias("line_end"))
    name = F.concat_ws(":", F.lit("n"), F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    return rows.select(name.alias("identifier"), F.col("l_orderkey").cast("string").alias("file_path"), F.col("l_linenumber").alias("line_start"), "line_end")


@query(f"with {_FINDINGS_SQL}, {_SPAN_NODES_SQL} select distinct id as src, identifier as dst from f join sn on file = file_path and line between line_start and line_end")
def point_interval_join(spark, sf):
    return findings.attach(_findings(spark, sf, repeats=True), _span_nodes(spark, sf))


@query("""
with f as (
  select case when l_linestatus = 'F' then 'dlint' else 'bandit' end as tool, l_suppkey::varchar as id, l_orderkey::varchar as file, l_linenumber::int as line_number, (l_partkey % 120)::int as cwe_id,
    case when l_quantity <= 16 then 'LOW' end as severity, (100 + l_suppkey % 45)::int as issue_id,
    row_number() over (partition by l_linestatus = 'F', l_suppkey order by l_shipdate desc, l_orderkey desc, l_linenumber desc, l_partkey desc, l_quantity desc) as rn
  from lineitem)
select tool, id, file, line_number, case when tool = 'bandit' then cwe_id end as cwe_id, case when tool = 'bandit' then severity end as severity, case when tool = 'dlint' then issue_id end as issue_id from f where rn = 1""")
def finding_upsert(spark, sf):
    """Every supplier is a finding of either tool, written once a line; the last one stands, its null severity too."""
    rows = A.table(spark, sf, "lineitem").select(
        F.when(F.col("l_linestatus") == "F", "dlint").otherwise("bandit").alias("tool"), F.col("l_suppkey").cast("string").alias("id"), F.col("l_orderkey").cast("string").alias("file"),
        F.col("l_linenumber").cast("int").alias("line_number"), F.expr("cast(l_partkey % 120 as int)").alias("cwe_id"), F.when(F.col("l_quantity") <= 16, "LOW").alias("severity"), F.expr("cast(100 + l_suppkey % 45 as int)").alias("issue_id"),
        F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity").alias("ord"),
    )
    return findings.merge(rows).drop("ord")


@query(f"""with {_FINDINGS_SQL}, {_SPAN_NODES_SQL},
hit as (select id as src, identifier as dst, severity from f join sn on file = file_path and line between line_start and line_end)
select distinct src, dst from hit where coalesce(severity, '') <> 'LOW' and dst not like '%:2'""")
def report_upsert(spark, sf):
    """Every edge comes twice; findings of low severity and nodes of a second line are unknown, so edges dangle at either end."""
    known, nodes = _findings(spark, sf, repeats=True), _span_nodes(spark, sf)
    edges = findings.attach(known, nodes).withColumn("_copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return findings.merge_reports(edges, known.filter("coalesce(severity, '') <> 'LOW'"), nodes.filter("identifier not like '%:2'"))


@query(f"""
with {_SPAN_NODES_SQL}, s as (select 'ctx:' || o_orderkey as context_id, o_orderkey::varchar as fp, 2 as a, 4 as b from orders where o_orderstatus = 'P')
select distinct context_id, identifier from sn join s on file_path = fp and line_start <= b and line_end >= a""")
def span_overlap_join(spark, sf):
    o = A.table(spark, sf, "orders").filter("o_orderstatus = 'P'")
    key = F.col("o_orderkey").cast("string")
    s = o.select(F.concat(F.lit("ctx:"), key).alias("context_id"), key.alias("file_path"), F.lit(2).alias("start_line"), F.lit(4).alias("end_line"))
    return graph.nodes_at_spans(_span_nodes(spark, sf), s)


@query("""
with l as (select distinct l_orderkey, l_linenumber from lineitem), g as (select *, l_linenumber - row_number() over (partition by l_orderkey order by l_linenumber) as run from l)
select l_orderkey, min(l_linenumber) as start_line, max(l_linenumber) as end_line from g group by l_orderkey, run""")
def span_islands(spark, sf):
    return spans.islands(A.table(spark, sf, "lineitem"), ["l_orderkey"], "l_linenumber")


@query("""
with s as (select l_orderkey::varchar as file_path, l_linenumber * 3 as a, l_linenumber * 3 + l_quantity::int % 4 as b from lineitem),
f as (select *, coalesce(a > max(b) over (partition by file_path order by a, b rows between unbounded preceding and 1 preceding) + 1, true)::int as fresh from s),
g as (select *, sum(fresh) over (partition by file_path order by a, b, fresh desc rows between unbounded preceding and current row) as run from f)
select file_path, min(a)::int as start_line, max(b)::int as end_line from g group by file_path, run""")
def span_merge(spark, sf):
    rows = A.table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("file_path"), (F.col("l_linenumber") * 3).alias("start_line"), (F.col("l_linenumber") * 3 + F.col("l_quantity").cast("int") % 4).alias("end_line"))
    return spans.merge(rows, ["file_path"])


# ---------------------------------------------------------------- traversals

def _customers(spark, sf) -> DataFrame:
    c = F.concat(F.lit("c:"), F.col("c_custkey").cast("string"))
    return A.table(spark, sf, "customer").select(F.concat(F.lit("seg:"), F.col("c_mktsegment")).alias("context_id"), c.alias("start_id"))


def _bfs_sql(seeds: str, depth: int) -> str:
    return f"""
with recursive {A.TRADE_SQL},
adj as (select src as at, dst as nxt from edges union select dst, src from edges),
seeds as ({seeds}),
walk as (
  select context_id, start_id, start_id as id, 0 as depth from seeds
  union select w.context_id, w.start_id, a.nxt, w.depth + 1 from walk w join adj a on a.at = w.id where w.depth < {depth}),
found as (select context_id, start_id, id, min(depth) as depth from walk group by 1, 2, 3)"""


_BIGGEST = "select 'one' as context_id, 'c:' || arg_max(c_custkey, c_acctbal * 1000000 + c_custkey) as start_id from customer"
_ALL_CUSTOMERS = "select 'seg:' || c_mktsegment as context_id, 'c:' || c_custkey as start_id from customer"


@query(_bfs_sql(_BIGGEST, 3) + " select context_id, start_id, id, depth from found")
def bfs_single(spark, sf):
    best = A.table(spark, sf, "customer").agg(F.max_by("c_custkey", F.col("c_acctbal") * 1000000 + F.col("c_custkey")).alias("k"))
    seed = best.select(F.lit("one").alias("context_id"), F.concat(F.lit("c:"), F.col("k").cast("string")).alias("start_id"))
    return graph.bfs(A.trade_graph(spark, sf), seed, 3)


@query(_bfs_sql(_ALL_CUSTOMERS, 2) + " select context_id, start_id, id, depth from found")
def bfs_batch(spark, sf):
    return graph.bfs(A.trade_graph(spark, sf), _customers(spark, sf), 2)


@query(_bfs_sql(_ALL_CUSTOMERS, 2) + " select context_id, id, min(depth) as depth, (count(*) - 1)::int as repeats from found group by 1, 2")
def bfs_collapse(spark, sf):
    return graph.collapse(graph.bfs(A.trade_graph(spark, sf), _customers(spark, sf), 2))


@query(f"""
with recursive {A.TRADE_SQL},
adj as (select src as at, dst as nxt, type from edges union select dst, src, type from edges),
seeds as (select 'seg:' || c_mktsegment as context_id, 'c:' || c_custkey as start_id from customer union all select 'nations', 'n:' || n_nationkey from nation),
walk as (
  select context_id, start_id, start_id as id, type as etype, 0 as depth from seeds, (select distinct type from edges)
  union select w.context_id, w.start_id, a.nxt, w.etype, w.depth + 1 from walk w join adj a on a.at = w.id and a.type = w.etype where w.depth < 2)
select context_id, id, etype, min(depth) as depth from walk group by 1, 2, 3""")
def bfs_edge_typed(spark, sf):
    nations = A.table(spark, sf, "nation").select(F.lit("nations").alias("context_id"), F.concat(F.lit("n:"), F.col("n_nationkey").cast("string")).alias("start_id"))
    return graph.bfs_typed(A.trade_graph(spark, sf), _customers(spark, sf).union(nations), 2)


@query(f"""
with recursive {A.TRADE_SQL},
back as (select dst as at, src as nxt from edges where type in ('FLOWS_TO', 'DEFINED_BY')),
walk as (
  select 'st:' || o_orderstatus as context_id, 'o:' || o_orderkey as id, 0 as hop from orders
  union select w.context_id, b.nxt, w.hop + 1 from walk w join back b on b.at = w.id where w.hop < 6)
select context_id, id, min(hop) as hop, case min(hop) when 1 then 1.0 when 2 then 0.7 when 3 then 0.5 when 4 then 0.35 else 0.2 end::double as taint_score from walk where hop > 0 group by 1, 2""")
def taint_backward(spark, sf):
    o = A.table(spark, sf, "orders")
    roots = o.select(F.concat(F.lit("st:"), F.col("o_orderstatus")).alias("context_id"), F.concat(F.lit("o:"), F.col("o_orderkey").cast("string")).alias("id"))
    return graph.taint(A.trade_graph(spark, sf), roots)


_MEMBERS_SQL = f"""with {A.TRADE_SQL},
m as (select 'seg:' || c_mktsegment as context_id, 'c:' || c_custkey as identifier from customer
  union select 'seg:' || c_mktsegment, 'o:' || o_orderkey from orders join customer on o_custkey = c_custkey
  union select 'seg:' || c_mktsegment, 'p:' || l_partkey from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey),
induced as (select distinct a.context_id, src, dst, type from edges join m a on src = a.identifier join m b on dst = b.identifier and a.context_id = b.context_id where type <> 'CONTAINS')"""


def _members(spark, sf) -> DataFrame:
    c, o, p = (F.concat(F.lit(x), F.col(k).cast("string")).alias("identifier") for x, k in (("c:", "c_custkey"), ("o:", "o_orderkey"), ("p:", "l_partkey")))
    segment = F.concat(F.lit("seg:"), F.col("c_mktsegment")).alias("context_id")
    customer = A.table(spark, sf, "customer")
    orders = A.table(spark, sf, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    lines = A.table(spark, sf, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return customer.select(segment, c).union(orders.select(segment, o)).union(lines.select(segment, p)).distinct()


@query(_MEMBERS_SQL + " select context_id, src, dst, type from induced")
def induced_edges(spark, sf):
    return graph.induced_edges(A.trade_graph(spark, sf), _members(spark, sf))


@query(_MEMBERS_SQL + """, both_ways as (select context_id, src as node, dst as other from induced where src <> dst union select context_id, dst, src from induced where src <> dst)
select context_id, node, count(*) as degree from both_ways group by 1, 2""")
def adjacency_degree(spark, sf):
    induced = graph.induced_edges(A.trade_graph(spark, sf), _members(spark, sf))
    return graph.undirected(induced).groupBy("context_id", F.col("at").alias("node")).agg(F.count(F.lit(1)).alias("degree"))


# ---------------------------------------------------------------- findings

@query(f"""
with {_FINDINGS_SQL}, {_SPAN_NODES_SQL},
r as (select distinct id, identifier from f join sn on file = file_path and line between line_start and line_end),
t as (select identifier, tool, cwe, case when tool = 'bandit' then severity when issue >= 100 and issue < 106 then 'HIGH' when issue >= 131 and issue < 138 then 'LOW' else 'MEDIUM' end as tier from r join f using (id)),
g as (select identifier, count(*) as n_findings, max(case tier when 'LOW' then 0.33 when 'MEDIUM' then 0.66 else 1.0 end)::double as s, max(case tier when 'LOW' then 0.3 when 'MEDIUM' then 0.6 else 0.9 end)::double as c,
  bool_or(tool = 'bandit') and bool_or(tool = 'dlint') as both_tools,
  coalesce(bool_or(tool = 'bandit' and cwe in (22, 77, 78, 79, 89, 94, 95, 98, 113, 185, 200, 209, 215, 259, 327, 338, 502, 611, 703, 918)), false) as high_risk from t group by 1)
select identifier, n_findings, least(1.0::double, round(0.5::double * s + 0.3::double * c + 0.2::double * (case when both_tools then 1.0 when n_findings > 1 then 0.3 else 0.0 end)::double, 6)) as finding_evidence_score, high_risk from g""")
def finding_evidence(spark, sf):
    return findings.evidence_at_lines(_findings(spark, sf), _span_nodes(spark, sf), Coefficients())


@query(f"with {_FINDINGS_SQL} select id, tool, severity from f where tool = 'dlint' or severity in ('MEDIUM', 'HIGH')")
def severity_filter(spark, sf):
    return findings.above(_findings(spark, sf), "MEDIUM").select("id", "tool", "severity")


@query(f"with {A.CANDIDATES_SQL} select identifier, least(1.0::double, round(0.35::double * sink::int + 0.25::double * src::int + 0.20::double * guard::int + 0.20::double * (case when k % 2 = 1 then greatest(sink::int, 0.7) else 0 end)::double, 6)) as security_path_score from cand")
def security_path_score(spark, sf):
    s = F.col("snippet")
    h = A.HINTS
    score = scores.security_path(text.contains_any(s, h.sink), text.contains_any(s, h.source), text.contains_any(s, h.guard), F.col("k") % 2 == 1, Coefficients())
    return A.chunks(spark, sf).select("identifier", score.alias("security_path_score"))


# ---------------------------------------------------------------- scores

C = Coefficients()
B = BudgetConfig()


@query(f"with {A.CANDIDATES_SQL} select context_id, identifier, ctx as context_score from final")
def context_score(spark, sf):
    return ranking.context_scores(A.context_nodes(spark, sf), C).select("context_id", "identifier", "context_score")


@query(f"with {A.CANDIDATES_SQL} select context_id, identifier, additive as score from final")
def final_score(spark, sf):
    return ranking.rank(A.context_nodes(spark, sf), "current").select("context_id", "identifier", "score")


@query(f"with {A.CANDIDATES_SQL} select context_id, identifier, boosted as score from final")
def boost_score(spark, sf):
    return ranking.rank(A.context_nodes(spark, sf), "multiplicative_boost").select("context_id", "identifier", "score")


@query(f"with {A.CANDIDATES_SQL} select identifier, edge_depth as depth_score from final")
def edge_aware_depth(spark, sf):
    return A.context_nodes(spark, sf).select("identifier", scores.edge_aware_depth(F.col("depth"), F.col("edge_depths"), C).alias("depth_score"))


@query(f"with {A.CANDIDATES_SQL} select context_id, identifier, sp2 as security_path_score from structural2")
def source_sink_bonus(spark, sf):
    return ranking.structural(A.context_nodes(spark, sf), C, hints=A.HINTS).select("context_id", "identifier", "security_path_score")


_BUDGET_SQL = f"""with {A.CANDIDATES_SQL},
b0 as (
  select *, case when length(snippet) = 0 then 0 else greatest(1, length(snippet) // 3) end as full_tokens,
    (d_flow is not null)::int + (d_san is not null)::int + (d_call is not null)::int as n_types from cand),
b1 as (
  select *, case when full_tokens > 220 then greatest(1, line_start - 3) else line_start end as clipped_start, case when full_tokens > 220 then line_start + 3 else line_end end as clipped_end,
    rtrim(case when full_tokens > 220 then array_to_string(string_split(snippet, chr(10))[1:4], chr(10)) else snippet end, ' ') as body from b0),
b2 as (
  select *, case when length(body) = 0 then 0 else greatest(1, length(body) // 3) end as tokens, contains(lower(body), 'license') as l_sink, contains(lower(body), 'und') as l_src, contains(lower(body), 'les') as l_guard,
    regexp_matches(lower(array_to_string(string_split(body, chr(10))[1:3], chr(10))), 'generated|auto-generated|do not edit') as made,
    case when n_types > 0 then greatest(coalesce(power(0.6::double, d_flow), 0), coalesce(power(0.6::double, d_san), 0), coalesce(power(0.6::double, d_call), 0)) else power(0.6::double, depth) end as distance,
    n_types / 7.0::double as confidence from b1),
b3 as (
  select *, list_sort(list_filter([case when depth = 0 then 'root' end, case when d_san is not null then 'sanitizer' end, case when d_flow is not null or taint > 0 then 'propagation' end, case when d_call is not null then 'caller' end,
    case when l_sink or fe >= 0.5 then 'sink' end, case when l_src then 'source' end, case when l_guard then 'guard' end], lambda x: x is not null)) as found from b2),
b4 as (
  select *, case when made then ['boilerplate'] when len(found) = 0 then ['enclosing_context'] else found end as roles,
    (d_san is not null or d_flow is not null or d_call is not null or taint > 0 or fe >= 0.5) as backed from b3),
b5 as (
  select *, (l_sink or l_src or l_guard or len(list_filter(roles, lambda r: r <> 'root')) = 0 or list_contains(roles, 'enclosing_context')) and not backed and not made as lexical,
    case when made then 0::double else least(1.0::double, greatest(0.0::double, 0.5::double * (0.55::double * (case kind when 'FunctionNode' then 1.0 when 'ClassNode' then 0.8 when 'CodeBlockNode' then 0.7 when 'VariableNode' then 0.4 else 0.2 end)::double + 0.45::double * least(1.0::double, repeats / greatest(most, 1)))
      + 0.5::double * (case when same_file then 0.7 when same_dir then 0.2 else 0.0 end)::double)) end as b_ctx,
    list_max(list_transform(roles, lambda r: (case r when 'root' then 1.0 when 'sink' then 0.95 when 'source' then 0.9 when 'sanitizer' then 0.85 when 'guard' then 0.85 when 'propagation' then 0.75 when 'caller' then 0.55 when 'enclosing_context' then 0.5 else 0.15 end)::double)) as role_prior from b4),
b6 as (
  select *, 1 - (1 - least(1.0::double, fe)) * (1 - least(1.0::double, taint)) * (1 - least(1.0::double, role_prior * distance)) * (1 - confidence) as security from b5),
b7 as (select *, 1 - (1 - least(1.0::double, security)) * (1 - least(1.0::double, 0.45::double * b_ctx)) as rel from b6),
b8 as (select *, case when lexical then least(rel, 0.4::double) else rel end as relevance from b7)"""


def _candidates(spark, sf) -> DataFrame:
    return ranking.candidates(A.context_nodes(spark, sf), B, C, A.HINTS)


@query(_BUDGET_SQL + " select identifier, round(distance, 6) as distance, round(confidence, 6) as confidence from b8")
def graph_distance(spark, sf):
    return _candidates(spark, sf).select("identifier", F.round("distance", 6).alias("distance"), F.round("confidence", 6).alias("confidence"))


@query(_BUDGET_SQL + " select identifier, array_to_string(roles, ',') as roles, lexical from b8")
def role_annotation(spark, sf):
    return _candidates(spark, sf).select("identifier", F.array_join("roles", ",").alias("roles"), "lexical")


@query(_BUDGET_SQL + " select context_id, identifier, round(relevance, 6) as relevance from b8")
def relevance_noisy_or(spark, sf):
    return _candidates(spark, sf).select("context_id", "identifier", F.round("score", 6).alias("relevance"))


@query(_BUDGET_SQL + " select identifier, clipped_start::int as clipped_start, clipped_end::int as clipped_end, tokens::int as tokens from b8")
def clip_lines(spark, sf):
    return _candidates(spark, sf).select("identifier", "clipped_start", "clipped_end", "tokens")


# ---------------------------------------------------------------- ranking

def _rank_sql(order: str, source: str = "final") -> str:
    return f"with {A.CANDIDATES_SQL} select context_id, identifier, row_number() over (partition by context_id order by {order}) as rank from {source}"


def _ranked(spark, sf, name: str, **options) -> DataFrame:
    return ranking.rank(A.context_nodes(spark, sf), name, **options).select("context_id", "identifier", F.col("rank").cast("long").alias("rank"))


@query(_rank_sql("depth <> 0, additive desc, depth, ord, identifier"))
def rank_current(spark, sf):
    return _ranked(spark, sf, "current")


@query(_rank_sql("depth <> 0, boosted desc, depth, ord, identifier"))
def rank_boost(spark, sf):
    return _ranked(spark, sf, "multiplicative_boost")


@query(_rank_sql("depth <> 0, depth, repeats desc, ctx desc, ord, identifier"))
def rank_depth_repeats(spark, sf):
    return _ranked(spark, sf, "depth_repeats_context")


@query(_rank_sql("depth <> 0, not (fe + sp2 > 0.5::double), structural_score desc, depth, file_path, line_start, ord, identifier", "structural2"))
def rank_structural(spark, sf):
    return _ranked(spark, sf, "cpg_structural", hints=A.HINTS)


@query(_rank_sql("ord, identifier"))
def rank_dummy(spark, sf):
    return _ranked(spark, sf, "dummy")


@query(_rank_sql("depth <> 0, md5('42:' || identifier), ord, identifier"))
def rank_random(spark, sf):
    return _ranked(spark, sf, "random_picking")


@query(f"""with {A.CANDIDATES_SQL}
select 'current' as strategy, context_id, identifier, row_number() over (partition by context_id order by depth <> 0, additive desc, depth, ord, identifier) as rank from final
union all select 'multiplicative_boost', context_id, identifier, row_number() over (partition by context_id order by depth <> 0, boosted desc, depth, ord, identifier) from final
union all select 'dummy', context_id, identifier, row_number() over (partition by context_id order by ord, identifier) from final""")
def multi_strategy_ranks(spark, sf):
    got = assemble.rank_all(A.context_nodes(spark, sf), ["current", "multiplicative_boost", "dummy"])
    return got.select("strategy", "context_id", "identifier", F.col("rank").cast("long").alias("rank"))


# A step a choice: the candidate with most gain that fits, given the lines shown and the roles covered so far.
_GREEDY_SQL = "with recursive" + _BUDGET_SQL.removeprefix("with") + f""",
cand_b as (select context_id, identifier, depth, ord, file_path, line_start, clipped_start as a, clipped_end as b, tokens, roles, relevance, greatest(1.0::double, power(tokens::double, {B.token_cost_power}::double)) as cost from b8),
picks as (
  select context_id, 0 as step, {max(1, int(2048 * B.budget_safety_ratio))}::bigint as room, []::varchar[] as chosen, []::varchar[] as covered, []::struct(f varchar, a bigint, b bigint)[] as shown from (select distinct context_id from cand_b)
  union all
  select context_id, step + 1, room - p.tokens, list_append(chosen, p.identifier), list_distinct(list_concat(covered, p.roles)), list_append(shown, {{'f': p.file_path, 'a': p.a, 'b': p.b}})
  from (
    select context_id, step, room, chosen, covered, shown,
      arg_min({{'identifier': identifier, 'tokens': tokens, 'roles': roles, 'file_path': file_path, 'a': a, 'b': b}}, (-gain, -relevance, file_path, line_start, ord, identifier)) as p
    from (
      select f.*, c.* exclude (context_id),
        relevance * (1 + {B.role_coverage_bonus}::double * len(list_filter(c.roles, lambda r: not list_contains(f.covered, r)))) * greatest(0.0::double, 1 - {B.novelty_penalty}::double * (case when both_n = 0 then 0.0::double else both_n::double / (b - a + 1 + seen_n - both_n) end)) / cost as gain
      from picks f join cand_b c on c.context_id = f.context_id and c.tokens <= f.room and not list_contains(f.chosen, c.identifier),
        lateral (select len(list_distinct(flatten(list_transform(list_filter(f.shown, lambda x: x.f = c.file_path), lambda x: range(x.a, x.b + 1))))) as seen_n,
          len(list_distinct(flatten(list_transform(list_filter(f.shown, lambda x: x.f = c.file_path), lambda x: range(greatest(x.a, c.a), least(x.b, c.b) + 1))))) as both_n))
    group by context_id, step, room, chosen, covered, shown)),
taken as (select context_id, unnest(chosen) as identifier, unnest(range(1, len(chosen) + 1)) as step from (select context_id, arg_max(chosen, step) as chosen from picks group by context_id))
select context_id, identifier, row_number() over (partition by context_id order by not (t.step is not null and depth = 0), coalesce(t.step, 1000000000000), ord, identifier)::int as rank, t.step is not null as selected
from cand_b left join taken t using (context_id, identifier)"""


@query(_GREEDY_SQL)
def select_budgeted(spark, sf):
    """Greedy gain under a budget of 2048 tokens in every context."""
    got = ranking.rank(A.context_nodes(spark, sf), "evidence_budgeted", budget=2048, hints=A.HINTS)
    return got.select("context_id", "identifier", "rank", "selected")


# ---------------------------------------------------------------- rendering and assembly

@query("select doc_id, line_no::int as line_no, regexp_replace(split_part(text, '#', 1), '\\s+$', '') as text from (select doc_id, unnest(string_split(text, chr(10))) as text, unnest(range(1, len(string_split(text, chr(10))) + 1)) as line_no from documents)")
def line_sanitize(spark, sf):
    return A.source_lines(spark, sf).select("doc_id", "line_no", text.sanitize_line(F.col("text")).alias("text"))


@query("select doc_id, greatest(1, length(text) // 3)::int as tokens from documents where greatest(1, length(text) // 3) <= 512")
def token_budget_filter(spark, sf):
    return datasets.within_budget(A.table(spark, sf, "documents"), 512).select("doc_id", text.tokens(F.col("text")).alias("tokens"))


@query(rf"""
with d as (select doc_id, lang || '/' || source || '/' || doc_id as file_path, unnest(string_split(text, chr(10))) as text, unnest(range(1, len(string_split(text, chr(10))) + 1)) as line_no from documents join labels using (doc_id) where toxic = 1),
s as (select 'ctx:' || doc_id as context_id, string_agg(regexp_replace(split_part(text, '#', 1), '\s+$', ''), chr(10) order by line_no) as text from d where line_no <= 5 group by doc_id)
select context_id, text, greatest(1, length(text) // 3)::int as tokens from s""")
def render_context(spark, sf):
    """The first chunk of each labelled document, rendered."""
    g = A.chunk_graph(spark, sf)
    roots = graph.nodes_at_spans(g.nodes, A.toxic_spans(spark, sf)).withColumn("rank", F.lit(1))
    return selection.render(roots, g.nodes, A.source_lines(spark, sf))


@query(f"with recursive {A.CURRENT_SQL} select context_id, id as identifier, rk as rank from selected")
def select_path_fill(spark, sf):
    """Path-fill of each labelled document's neighbourhood under 512 tokens."""
    return assemble.selected(A.chunk_graph(spark, sf), A.toxic_spans(spark, sf), A.source_lines(spark, sf), "current", depth=3, budget=512, hints=A.HINTS)


@query(f"with recursive {A.CURRENT_SQL} select context_id, text, greatest(1, length(text) // 3)::int as tokens from rendered")
def assemble_context(spark, sf):
    """The whole query: spans, roots, neighbourhood, taint, scores, selection, text."""
    return assemble.assemble(A.chunk_graph(spark, sf), A.toxic_spans(spark, sf), A.source_lines(spark, sf), "current", depth=3, budget=512, hints=A.HINTS)


@query(f"with recursive {A.STRUCTURAL_SQL} select context_id, text, greatest(1, length(text) // 3)::int as tokens from rendered")
def assemble_structural(spark, sf):
    return assemble.assemble(A.chunk_graph(spark, sf), A.toxic_spans(spark, sf), A.source_lines(spark, sf), "cpg_structural", depth=3, budget=512, hints=A.HINTS)


# ---------------------------------------------------------------- datasets, verdicts, reports

@query("""
select 'https://h/o/' || source as repo_url, md5(lang) as hash, min(doc_id) as first, count(*) as n_entries, sum(n_chars)::bigint as chars
from documents where length(trim(text)) > 0 group by 1, 2""")
def group_commits(spark, sf):
    docs = A.table(spark, sf, "documents").filter(F.length(F.trim("text")) > 0)
    url = F.concat(F.lit("https://h/o/"), F.col("source"), F.lit("/commit/"), F.md5(F.col("lang").cast("binary")))
    rows = docs.select(parsing.commit_url(url).alias("commit"), F.col("doc_id").alias("ord"), "n_chars")
    got = datasets.group_commits(rows)
    total = F.aggregate("entries", F.lit(0).cast("long"), lambda a, x: a + x["n_chars"])
    return got.select("repo_url", "hash", "first", F.size("entries").cast("long").alias("n_entries"), total.alias("chars"))


@query("""
select o.o_orderkey as hash, l.l_linenumber, c.c_name as description, n.n_name as cwe_id
from orders o join lineitem l on l.l_orderkey = o.o_orderkey left join customer c on c.c_custkey = o.o_custkey left join (select c_custkey as k, n_name from customer join nation on c_nationkey = n_nationkey where c_acctbal > 0) n on n.k = o.o_custkey
where l.l_returnflag = 'R'""")
def cve_style_join(spark, sf):
    fixes = A.table(spark, sf, "orders").select(F.col("o_custkey").alias("cve_id"), F.col("o_orderkey").alias("hash"))
    lines = A.table(spark, sf, "lineitem")
    changed = lines.select(F.col("l_orderkey").alias("hash"), "l_linenumber", F.when(F.col("l_returnflag") == "R", "Python").otherwise("C").alias("programming_language"), F.lit("{}").alias("diff_parsed"))
    customer = A.table(spark, sf, "customer")
    cve = customer.select(F.col("c_custkey").alias("cve_id"), F.col("c_name").alias("description"))
    cwe = customer.filter("c_acctbal > 0").join(A.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("cve_id"), F.col("n_name").alias("cwe_id"))
    return datasets.cve_rows(fixes, changed, cve, cwe).select("hash", "l_linenumber", "description", "cwe_id")


@query("""
select event_id, case event_id % 4 when 0 then (event_id % 900) || ',' || (event_id % 7) when 1 then (event_id % 900)::varchar when 2 then '' else user_id::varchar end as cwes
from events where event_id % 900 <> event_id % 7
union all select event_id, case event_id % 4 when 0 then (event_id % 900)::varchar when 1 then (event_id % 900)::varchar when 2 then '' else user_id::varchar end from events where event_id % 900 = event_id % 7""")
def cwe_parse(spark, sf):
    e = A.table(spark, sf, "events")
    n, m, u = (F.expr(x).cast("string") for x in ("event_id % 900", "event_id % 7", "user_id"))
    raw = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("['CWE-"), n, F.lit("', 'cwe-"), m, F.lit("']"))).when(F.col("event_id") % 4 == 1, n).when(F.col("event_id") % 4 == 2, F.lit("none")).otherwise(F.concat(F.lit("id "), u))
    return e.select("event_id", F.array_join(parsing.cwe_list(raw), ",").alias("cwes"))


@query("""
with d as (select text, coalesce(toxic, 0) as label, case when doc_id % 3 = 0 then 'CVE-' || (doc_id // 6) end as cve_id, doc_id as ord from documents left join labels using (doc_id)),
k as (select *, row_number() over (partition by case when cve_id is null then 'T:' || text || ':' || label else cve_id || '::' || label end order by ord) as rn from d)
select ord, cve_id, label from k where rn = 1""")
def dataset_merge_dedupe(spark, sf):
    docs = A.table(spark, sf, "documents").join(A.table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id", "left")
    cve = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("CVE-"), F.expr("doc_id div 6").cast("string")))
    rows = docs.select("text", F.coalesce("toxic", F.lit(0)).alias("label"), cve.alias("cve_id"), F.col("doc_id").alias("ord"))
    return datasets.merge_datasets(rows).select("ord", "cve_id", "label")


@query("select 'CWE-' || (p_size) as cwe, count(*) as n from part where p_size is not null group by 1")
def histogram(spark, sf):
    return datasets.cwe_histogram(A.table(spark, sf, "part"), "p_size")


@query("select cwe, sum(n)::bigint as n from (select 'CWE-' || p_size as cwe, count(*) as n from part group by 1 union all select 'CWE-' || l_linenumber, count(*) from lineitem group by 1) group by 1")
def histogram_sum(spark, sf):
    return datasets.sum_histograms(datasets.cwe_histogram(A.table(spark, sf, "part"), "p_size"), datasets.cwe_histogram(A.table(spark, sf, "lineitem"), "l_linenumber"))


def _responses(spark, sf) -> DataFrame:
    """An answer to every turn of every conversation: usable, buried, malformed or missing, by rule."""
    t = A.table(spark, sf, "conversations")
    kind = (F.col("conv_id") + F.col("turn")) % 5
    sev = F.element_at(F.array(*map(F.lit, ("critical", "HIGH", "low", "odd"))), (F.col("conv_id") % 4 + 1).cast("int"))
    full = F.concat(F.lit('{"vulnerable": '), F.when(F.col("conv_id") % 2 == 0, "true").otherwise("false"), F.lit(', "severity": "'), sev, F.lit('", "cwe_id": '), (F.col("turn") * 11).cast("string"), F.lit(', "description": " found "}'))
    answer = F.when(kind == 0, full).when(kind == 1, F.concat(F.lit('{"vulnerable": 1} then '), full, F.lit(" done"))).when(kind == 2, F.lit('{"vulnerable": "maybe"}')).when(kind == 3, F.lit("no verdict")).otherwise(F.lit('{"vulnerable": 0} {"other": 1}'))
    return t.select("conv_id", "turn", F.concat(F.col("text"), F.lit(" "), answer).alias("response"))


_RESPONSES_SQL = """
t as (select conv_id, turn, (conv_id + turn) % 5 as kind, case conv_id % 4 when 0 then 'CRITICAL' when 1 then 'HIGH' when 2 then 'LOW' end as sev, conv_id % 2 = 0 as yes, turn * 11 as cwe from conversations)"""


@query(f"""with {_RESPONSES_SQL}
select conv_id, turn, kind in (0, 1) and yes as vulnerable, case when kind in (0, 1) then sev end as severity, case when kind in (0, 1) then 'found' end as description, case when kind in (0, 1) then cwe::int end as cwe_id from t""")
def verdict_parse_review(spark, sf):
    return _responses(spark, sf).select("conv_id", "turn", parsing.review_verdict(F.col("response")).alias("v")).select("conv_id", "turn", "v.*")


@query(f"with {_RESPONSES_SQL} select conv_id, turn, case when kind in (0, 1) then yes when kind = 4 then false end as predicted from t")
def verdict_parse_judge(spark, sf):
    return _responses(spark, sf).select("conv_id", "turn", parsing.judge_verdict(F.col("response")).alias("predicted"))


@query(f"""with {_RESPONSES_SQL}, p as (select case when kind in (0, 1) then yes when kind = 4 then false end as predicted, conv_id % 3 = 0 as label from t)
select count(*) as n, count(*) filter (predicted is null) as invalid, round(sum(coalesce(predicted = label, false)::int) / count(*), 6) as accuracy from p""")
def judge_accuracy(spark, sf):
    rows = _responses(spark, sf).select(parsing.judge_verdict(F.col("response")).alias("predicted"), (F.col("conv_id") % 3 == 0).alias("label"))
    return datasets.accuracy(rows).withColumn("accuracy", F.round("accuracy", 6))


def _verdicts(spark, sf) -> DataFrame:
    v = _responses(spark, sf).select("conv_id", "turn", parsing.review_verdict(F.col("response")).alias("v"))
    return v.select(F.concat(F.lit("f/"), F.col("conv_id").cast("string"), F.lit(".py")).alias("file_path"), (F.col("turn") + 1).cast("int").alias("line_start"), (F.col("turn") + 2).cast("int").alias("line_end"), "v.*")


@query(f"""with {_RESPONSES_SQL}
select 'f/' || conv_id || '.py' as file_path, (turn + 1)::int as line_start, case when cwe <> 0 then 'CWE-' || cwe else 'SCANNER/UNKNOWN' end as rule_id,
  case sev when 'CRITICAL' then 'error' when 'HIGH' then 'error' when 'LOW' then 'note' else 'warning' end as level from t where kind in (0, 1) and yes""")
def sarif_results(spark, sf):
    return reports.sarif_results(_verdicts(spark, sf)).drop("result")


@query(f"with {_RESPONSES_SQL} select count(*) filter (kind in (0, 1) and yes) as vulnerabilities_found, count(*) as contexts_scanned from t")
def scan_summary(spark, sf):
    return reports.summary(_verdicts(spark, sf))


_GRID = [("a", 0.25, 0.20, 0.20, 0.35), ("b", 0.40, 0.20, 0.10, 0.30), ("c", 0.10, 0.30, 0.30, 0.30)]


@query(f"""with {A.CANDIDATES_SQL}, cfg(config_id, wf, ws, wt, wc) as (values {", ".join(f"('{n}', {a}::double, {b}::double, {c}::double, {d}::double)" for n, a, b, c, d in _GRID)}),
s as (select config_id, least(1.0::double, round(wf * fe + ws * sp + wt * taint + wc * ctx, 6)) >= 0.5::double as predicted, is_toxic as label from final, cfg)
select config_id, count(*) as n, count(*) filter (predicted is null) as invalid, round(sum((predicted = label)::int) / count(*), 6) as accuracy from s group by 1""")
def tune_grid(spark, sf):
    """Accuracy of three weightings at telling labelled chunks, all scored in one job."""
    nodes = ranking.context_scores(A.context_nodes(spark, sf), C).withColumn("label", F.col("finding_evidence_score") > 0.5)
    configs = {n: replace(C, combiner=replace(C.combiner, finding_evidence=a, security_path=b, taint=c, context=d)) for n, a, b, c, d in _GRID}
    return tuning.trials(nodes, configs, 0.5).withColumn("accuracy", F.round("accuracy", 6))
