"""Model tables made out of a star schema and a corpus, so that every operator can run on data at hand.

Trade graph: customers, orders, parts, suppliers, nations and regions as nodes, their references as edges of five types.
Chunk graph: five-line chunks of documents as nodes, their order and exact copies as edges.
Each has the same definition as text for DuckDB, in ``*_SQL``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.operators.graph import Graph, edge_types
from graphloom.operators.ranking import Hints
from graphloom.staging import materialize

#: Words that occur in the corpus, in place of the default hints.
HINTS = Hints(sink=("license",), source=("und",), guard=("les",))
LINES = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(prefix: str, column: str) -> Column:
    return F.concat(F.lit(prefix + ":"), F.col(column).cast("string"))


def trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged edges: pairs are made distinct as the numbers they are, before ids are made of them."""
    ends = [
        ("orders", "c", "o_custkey", "o", "o_orderkey", "CALLS"),
        ("lineitem", "p", "l_partkey", "o", "l_orderkey", "FLOWS_TO"),
        ("lineitem", "s", "l_suppkey", "p", "l_partkey", "DEFINED_BY"),
        ("supplier", "n", "s_nationkey", "s", "s_suppkey", "USED_BY"),
        ("nation", "r", "n_regionkey", "n", "n_nationkey", "CONTAINS"),
    ]
    out = None
    for name, a, src, b, dst, kind in ends:
        rows = table(spark, sf_dir, name).select(src, dst).distinct().select(_id(a, src).alias("src"), _id(b, dst).alias("dst"), F.lit(kind).alias("type"))
        out = rows if out is None else out.union(rows)
    return out


def trade_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = [("customer", "c", "c_custkey"), ("orders", "o", "o_orderkey"), ("part", "p", "p_partkey"), ("supplier", "s", "s_suppkey"), ("nation", "n", "n_nationkey"), ("region", "r", "r_regionkey")]
    out = None
    for name, prefix, key in keys:
        rows = table(spark, sf_dir, name).select(_id(prefix, key).alias("identifier"), F.lit(name).alias("kind"))
        out = rows if out is None else out.union(rows)
    return out


def trade_graph(spark: SparkSession, sf_dir: str) -> Graph:
    edges = materialize(trade_edges(spark, sf_dir), "edges")
    return Graph(trade_nodes(spark, sf_dir), edges, edge_types(edges))


TRADE_SQL = """
edges as (
  select 'c:' || o_custkey as src, 'o:' || o_orderkey as dst, 'CALLS' as type from orders
  union select 'p:' || l_partkey, 'o:' || l_orderkey, 'FLOWS_TO' from lineitem
  union select 's:' || l_suppkey, 'p:' || l_partkey, 'DEFINED_BY' from lineitem
  union select 'n:' || s_nationkey, 's:' || s_suppkey, 'USED_BY' from supplier
  union select 'r:' || n_regionkey, 'n:' || n_nationkey, 'CONTAINS' from nation),
nodes as (
  select 'c:' || c_custkey as identifier, 'customer' as kind from customer union all select 'o:' || o_orderkey, 'orders' from orders
  union all select 'p:' || p_partkey, 'part' from part union all select 's:' || s_suppkey, 'supplier' from supplier
  union all select 'n:' || n_nationkey, 'nation' from nation union all select 'r:' || r_regionkey, 'region' from region)"""


def _path() -> Column:
    return F.concat_ws("/", "lang", "source", F.col("doc_id").cast("string"))


def source_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", _path().alias("file_path"), F.posexplode(F.split("text", "\n")).alias("at", "text"))
    return docs.select("doc_id", "file_path", (F.col("at") + 1).alias("line_no"), "text")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``identifier, kind, name, file_path, line_start, line_end, snippet, doc_id, source, k, n`` of every chunk."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", _path().alias("file_path"), F.split("text", "\n").alias("_lines"))
    docs = docs.withColumn("n", F.size("_lines")).withColumn("k", F.explode(F.sequence(F.lit(0), F.expr("(n - 1) div 5").cast("int"))))
    kind = F.element_at(F.array(*map(F.lit, ("FunctionNode", "ClassNode", "CodeBlockNode", "VariableNode"))), F.col("k") % 4 + 1)
    body = F.array_join(F.slice("_lines", F.col("k") * LINES + 1, F.lit(LINES)), "\n")
    return docs.select(
        F.concat_ws(":", F.lit("chunk"), F.col("doc_id").cast("string"), F.col("k").cast("string")).alias("identifier"), kind.alias("kind"), F.concat(F.lit("chunk"), F.col("k").cast("string")).alias("name"), "file_path",
        (F.col("k") * LINES + 1).alias("line_start"), F.least(F.col("k") * LINES + LINES, F.col("n")).alias("line_end"), F.regexp_replace(body, r"\s+$", "").alias("snippet"), "doc_id", "source", "k", "n",
    )


def chunk_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """A chunk calls the next; the first chunk of a document flows to that of its next exact copy."""
    nodes = chunks(spark, sf_dir).withColumn("ord", F.col("doc_id") * 100000 + F.col("k"))
    last = F.expr("(n - 1) div 5")
    to = F.concat_ws(":", F.lit("chunk"), F.col("doc_id").cast("string"), (F.col("k") + 1).cast("string"))
    calls = nodes.filter(F.col("k") < last).select(F.col("identifier").alias("src"), to.alias("dst"), F.lit("CALLS").alias("type"))
    same = Window.partitionBy("h").orderBy("doc_id")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("h")).withColumn("next", F.lead("doc_id").over(same))
    first = lambda c: F.concat(F.lit("chunk:"), F.col(c).cast("string"), F.lit(":0"))
    flows = docs.filter("next is not null").select(first("doc_id"), first("next"), F.lit("FLOWS_TO"))
    return Graph(nodes, materialize(calls.union(flows), "edges"), ("CALLS", "FLOWS_TO"))


def toxic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three lines of every document labelled toxic, a context each."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id"), "doc_id")
    return docs.select(F.concat(F.lit("ctx:"), F.col("doc_id").cast("string")).alias("context_id"), _path().alias("file_path"), F.lit(1).alias("start_line"), F.lit(3).alias("end_line"))


def context_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk as a node of its source's context, with depths, repeats, evidence and edge depths by rule."""
    toxic = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    rows = chunks(spark, sf_dir).join(toxic, "doc_id", "left")
    is_toxic = F.coalesce(F.col("toxic") == 1, F.lit(False))
    depth = F.when(is_toxic, F.col("k")).otherwise(F.col("k") + 1)
    guarded = F.contains(F.lower("snippet"), F.lit("les"))
    entries = F.array_compact(F.array(
        F.when(depth <= 6, F.struct(F.lit("FLOWS_TO").alias("t"), depth.alias("d"))), F.when(guarded, F.struct(F.lit("SANITIZED_BY").alias("t"), (depth + 1).alias("d"))),
        F.when(F.col("k") > 0, F.struct(F.lit("CALLS").alias("t"), F.col("k").alias("d"))),
    ))
    taint = F.when(F.col("k") % 3 == 0, F.lit(0.0)).when(F.col("k") % 3 == 1, F.lit(1.0)).otherwise(F.lit(0.5))
    # The last digit keeps sums away from rounding ties, on which engines differ.
    evidence = F.when(is_toxic, F.lit(0.77000004)).when(F.col("quality") == 0, F.lit(0.40000004)).otherwise(F.lit(0.00000004))
    return rows.select(
        F.col("source").alias("context_id"), "identifier", "kind", "name", "file_path", "line_start", "line_end", depth.alias("depth"), (F.col("k") % 3).alias("repeats"), evidence.alias("finding_evidence_score"),
        F.round(0.35 * F.contains(F.lower("snippet"), F.lit("license")).cast("double") + 0.25 * F.contains(F.lower("snippet"), F.lit("und")).cast("double") + 0.20 * guarded.cast("double"), 6).alias("security_path_score"),
        taint.alias("taint_score"), F.map_from_entries(entries).alias("edge_depths"), "snippet", (F.col("doc_id") * 100000 + F.col("k")).alias("ord"),
    )


CHUNKS_SQL = r"""
docs as (select doc_id, source, lang, lang || '/' || source || '/' || doc_id as file_path, string_split(text, chr(10)) as lines from documents),
chunks as (
  select 'chunk:' || doc_id || ':' || k as identifier, (['FunctionNode', 'ClassNode', 'CodeBlockNode', 'VariableNode'])[(k % 4 + 1)::int] as kind, file_path, (k * 5 + 1)::int as line_start,
    least(k * 5 + 5, len(lines))::int as line_end, regexp_replace(array_to_string(lines[k * 5 + 1 : k * 5 + 5], chr(10)), '\s+$', '') as snippet, doc_id, lang, source, k::int as k, len(lines) as n
  from (select *, unnest(range((len(lines) - 1) // 5 + 1)) as k from docs))"""

CANDIDATES_SQL = CHUNKS_SQL + r""",
lab as (select doc_id, max(toxic) as toxic, min(quality) as quality from labels group by 1),
raw as (
  select c.source as context_id, identifier, kind, file_path, lang, line_start, line_end, coalesce(toxic = 1, false) as is_toxic, case when coalesce(toxic = 1, false) then k else k + 1 end as depth, k % 3 as repeats, k,
    case when coalesce(toxic = 1, false) then 0.77000004::double when quality = 0 then 0.40000004::double else 0.00000004::double end as fe, snippet, doc_id * 100000 + k as ord,
    contains(lower(snippet), 'license') as sink, contains(lower(snippet), 'und') as src, contains(lower(snippet), 'les') as guard,
    (case k % 3 when 0 then 0.0 when 1 then 1.0 else 0.5 end)::double as taint,
    regexp_matches(lower(array_to_string(string_split(snippet, chr(10))[1:3], chr(10))), 'generated|auto-generated|do not edit') as gen
  from chunks c left join lab using (doc_id)),
cand0 as (select *, round(0.35::double * sink::int + 0.25::double * src::int + 0.20::double * guard::int, 6) as sp, case when depth <= 6 then depth end as d_flow, case when guard then depth + 1 end as d_san, case when k > 0 then k end as d_call from raw),
low as (select context_id, min(depth) as least_depth, max(repeats) as most from cand0 group by 1),
anchors as (select distinct c.context_id, c.lang from cand0 c join low using (context_id) where depth = least_depth),
anchor_files as (select distinct c.context_id, c.file_path from cand0 c join low using (context_id) where depth = least_depth),
cand as (
  select c.*, most, (select count(*) from anchor_files a where a.context_id = c.context_id and a.file_path = c.file_path) > 0 as same_file,
    (select count(*) from anchors a where a.context_id = c.context_id and a.lang = c.lang) > 0 as same_dir
  from cand0 c join low using (context_id)),
parts as (
  select *, (case kind when 'FunctionNode' then 1.0 when 'ClassNode' then 0.8 when 'CodeBlockNode' then 0.7 when 'VariableNode' then 0.4 else 0.2 end)::double as kind_score,
    (case depth when 0 then 1.0 when 1 then 0.85 when 2 then 0.70 when 3 then 0.55 when 4 then 0.45 else 0.35 end)::double as hop
  from cand),
shaped as (
  select *, least(1.0::double, round(0.15::double * kind_score + 0.85::double * least(1.0::double, repeats / greatest(most, 1)), 6)) as structure,
    greatest(0.0::double, least(1.0::double, round(greatest(0.0::double, 0.70::double * same_file::int + 0.20::double * same_dir::int - 0.10::double * gen::int), 6))) as prior
  from parts),
scored as (
  select *, least(1.0::double, round(0.45::double * hop + 0.25::double * structure + 0.30::double * prior, 6)) as ctx,
    case when depth = 0 then 1.0::double when d_flow is null and d_san is null and d_call is null then hop
      else least(1.0::double, round(greatest(coalesce(1.0::double * power(0.85::double, d_flow), 0), coalesce(0.85::double * power(0.80::double, d_san), 0), coalesce(0.70::double * power(0.75::double, d_call), 0)), 6)) end as edge_depth
  from shaped),
final as (
  select *, least(1.0::double, round(0.25::double * fe + 0.20::double * sp + 0.20::double * taint + 0.35::double * ctx, 6)) as additive,
    least(1.0::double, round(ctx * (1 + 1.0::double * (fe + sp)), 6)) as boosted,
    least(1.0::double, round(0.45::double * edge_depth + 0.25::double * structure + 0.30::double * prior, 6)) as edge_ctx,
    bool_or(sink) over (partition by context_id) as any_sink, bool_or(src) over (partition by context_id) as any_src
  from scored),
bonused as (
  select *, case when any_sink and any_src and d_flow <= 4 then (case when d_san <= 4 then 0.125::double else 0.25::double end) else 0::double end as bonus from final),
structural as (
  select *, case when bonus > 0 then least(1.0::double, round(sp + bonus, 6)) else sp end as sp2 from bonused),
structural2 as (
  select *, least(1.0::double, round(0.25::double * fe + 0.20::double * sp2 + 0.20::double * taint + 0.35::double * edge_ctx, 6)) as structural_score from structural)"""


def _assembled_sql(found: str, scored: str, order: str, budget: int) -> str:
    """Contexts of the chunk graph, step by step: ``found`` and ``scored`` are what differs between strategies."""
    return CHUNKS_SQL + rf""",
copies as (select doc_id, lead(doc_id) over (partition by text order by doc_id) as nxt from documents),
edges as (
  select 'chunk:' || doc_id || ':' || k as src, 'chunk:' || doc_id || ':' || (k + 1) as dst, 'CALLS' as type from chunks where k < (n - 1) // 5
  union all select 'chunk:' || doc_id || ':0', 'chunk:' || nxt || ':0', 'FLOWS_TO' from copies where nxt is not null),
near as (select src as frm, dst as nxt, type from edges union select dst, src, type from edges),
roots as (select distinct 'ctx:' || doc_id as context_id, 'chunk:' || doc_id || ':0' as id from labels join documents using (doc_id) where toxic = 1),
{found},
back as (
  select context_id, id, 0 as hop from roots
  union select b.context_id, e.src, b.hop + 1 from back b join edges e on e.dst = b.id and e.type = 'FLOWS_TO' where b.hop < 6),
tainted as (select context_id, id, min(hop) as hop from back where hop > 0 group by 1, 2),
own as (
  select f.*, c.* exclude (identifier), c.doc_id * 100000 + c.k as ord, c.file_path = a.file_path as same, c.lang = a.lang and c.source = a.source as same_dir, c.lang = a.lang as same_lead,
    coalesce(case hop when 1 then 1.0 when 2 then 0.7 when 3 then 0.5 when 4 then 0.35 else case when hop > 4 then 0.2 end end, 0)::double as taint,
    (case c.kind when 'FunctionNode' then 1.0 when 'ClassNode' then 0.8 when 'CodeBlockNode' then 0.7 when 'VariableNode' then 0.4 else 0.2 end)::double as kind_score,
    (case depth when 0 then 1.0 when 1 then 0.85 when 2 then 0.70 else 0.55 end)::double as hop_score,
    regexp_matches(lower(array_to_string(string_split(c.snippet, chr(10))[1:3], chr(10))), 'generated|auto-generated|do not edit') as gen,
    contains(lower(c.snippet), 'license') as sink, contains(lower(c.snippet), 'und') as src
  from found f join chunks c on c.identifier = f.id join roots r on r.context_id = f.context_id join chunks a on a.identifier = r.id left join tainted t on t.context_id = f.context_id and t.id = f.id),
parts as (
  select *, round(0.15::double * kind_score, 6) as structure,
    greatest(0.0::double, least(1.0::double, round(greatest(0.0::double, 0.70::double * same::int + 0.20::double * (case when same_dir then 1.0 when same_lead then 0.5 else 0.0 end)::double - 0.10::double * gen::int), 6))) as prior from own),
{scored},
ranked as (select *, row_number() over (partition by context_id order by {order})::int as rk from scored),
-- the tree: levels over edges between members, the least neighbour of the level before as parent
inside as (select distinct a.context_id, frm, nxt from near join ranked a on a.id = frm join ranked b on b.id = nxt and b.context_id = a.context_id),
levels as (
  select context_id, id, 0 as lvl from roots
  union select l.context_id, i.nxt, l.lvl + 1 from levels l join inside i on i.context_id = l.context_id and i.frm = l.id where l.lvl < 8),
level as (select context_id, id, min(lvl) as lvl from levels group by 1, 2),
parent as (select l.context_id, l.id, l.lvl, min(p.id) as up from level l left join inside i on i.context_id = l.context_id and i.nxt = l.id left join level p on p.context_id = l.context_id and p.id = i.frm and p.lvl = l.lvl - 1 group by 1, 2, 3),
shown as (
  select context_id, id, list_transform(range(line_start, line_end + 1), lambda x: {{'f': file_path, 'x': x, 't': regexp_replace(split_part(d.lines[x], '#', 1), '\s+$', '')}}) as own
  from ranked join (select file_path as fp, lines from docs) d on fp = file_path),
ways as (
  select context_id, id, lvl, [{{'id': id, 'own': own}}] as way from parent join shown using (context_id, id) where lvl = 0
  union all select p.context_id, p.id, p.lvl, list_append(w.way, {{'id': p.id, 'own': s.own}}) from ways w join parent p on p.context_id = w.context_id and p.up = w.id and p.lvl = w.lvl + 1 join shown s on s.context_id = p.context_id and s.id = p.id),
turns as (
  select r.context_id, r.id, coalesce(w.way, [{{'id': r.id, 'own': s.own}}]) as way, row_number() over (partition by r.context_id order by rk) as turn
  from ranked r join shown s using (context_id, id) left join ways w using (context_id, id) where r.depth > 0),
fill as (
  select context_id, 0::bigint as turn, list(id) as chosen, list_distinct(flatten(list(own))) as seen from shown join roots using (context_id, id) group by context_id
  union all
  select context_id, turn, case when fits then list_distinct(list_concat(chosen, list_transform(way, lambda w: w.id))) else chosen end, case when fits then seen_new else seen end
  from (
    select *, greatest(1, (list_sum(list_transform(seen_new, lambda l: length(l.t)))::bigint + greatest(0, len(seen_new) - 1)) // 3) <= {budget} as fits
    from (select t.context_id, t.turn, t.way, f.chosen, f.seen, list_distinct(list_concat(f.seen, flatten(list_transform(t.way, lambda w: w.own)))) as seen_new from fill f join turns t on t.context_id = f.context_id and t.turn = f.turn + 1))),
final as (select context_id, arg_max(chosen, turn) as chosen from fill group by context_id),
selected as (select context_id, id, rk from ranked join final using (context_id) where list_contains(chosen, id)),
rendered as (
  select context_id, string_agg(t, chr(10) order by file_rank, f, x) as text
  from (select distinct context_id, l.f as f, l.x as x, l.t as t, min(rk) over (partition by context_id, l.f) as file_rank from (select s.context_id, rk, unnest(own) as l from selected s join shown using (context_id, id))) group by context_id)"""


_WALK = """
walk as (
  select context_id, id, 0 as depth from roots
  union select w.context_id, a.nxt, w.depth + 1 from walk w join near a on a.frm = w.id where w.depth < 3),
found as (select context_id, id, min(depth) as depth from walk group by 1, 2)"""
_TYPED = """
walk as (
  select context_id, id, t as type, 0 as depth from roots, (values ('CALLS'), ('FLOWS_TO')) k(t)
  union select w.context_id, a.nxt, w.type, w.depth + 1 from walk w join near a on a.frm = w.id and a.type = w.type where w.depth < 3),
found as (select context_id, id, min(depth) as depth, min(depth) filter (type = 'FLOWS_TO') as d_flow, min(depth) filter (type = 'CALLS') as d_call from walk group by 1, 2)"""
_CURRENT = """
scored as (
  select *, least(1.0::double, round(0.20::double * taint + 0.35::double * least(1.0::double, round(0.45::double * hop_score + 0.25::double * structure + 0.30::double * prior, 6)), 6)) as score from parts)"""
_STRUCTURAL = """
bonused as (
  select *, case when bool_or(sink) over (partition by context_id) and bool_or(src) over (partition by context_id) and d_flow <= 4 then 0.25::double else 0.0::double end as sp,
    case when depth = 0 then 1.0::double else least(1.0::double, round(greatest(coalesce(power(0.85::double, d_flow), 0), coalesce(0.70::double * power(0.75::double, d_call), 0)), 6)) end as by_edge from parts),
scored as (
  select *, least(1.0::double, round(0.20::double * sp + 0.20::double * taint + 0.35::double * least(1.0::double, round(0.45::double * by_edge + 0.25::double * structure + 0.30::double * prior, 6)), 6)) as score from bonused)"""

CURRENT_SQL = _assembled_sql(_WALK, _CURRENT, "depth <> 0, score desc, depth, ord, id", 512)
STRUCTURAL_SQL = _assembled_sql(_TYPED, _STRUCTURAL, "depth <> 0, not (sp > 0.5::double), score desc, depth, file_path, line_start, ord, id", 512)
