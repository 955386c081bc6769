"""Registered queries of sources and dataset building, over inputs that follow from the tables by rule."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom import adapters as A
from graphloom.operators import datasets, graph, ranking
from graphloom.operators.store import GraphStore
from graphloom.plans import benchmark, review
from graphloom.queries import query
from graphloom.sources import diffs, python_cpg
from graphloom.staging import materialize, shared_folder, spread

# ---------------------------------------------------------------- graph building

_MERGE_SQL = """
select identifier, arg_max(kind, ord) filter (where kind is not null) as kind, arg_max(name, ord) filter (where name is not null) as name from (
  select 'o:' || l_orderkey as identifier, case when l_partkey % 3 > 0 then 'k' || l_partkey end as kind, case when l_suppkey % 2 > 0 then 's' || l_suppkey end as name,
    l_linenumber * 1000000000000 + l_partkey * 1000000 + l_suppkey as ord from lineitem) group by 1"""


@query(_MERGE_SQL)
def node_merge(spark, sf):
    """Several writes of one node: each property keeps its last value that is not null."""
    lines = A.table(spark, sf, "lineitem")
    rows = lines.select(
        F.concat(F.lit("o:"), F.col("l_orderkey").cast("string")).alias("identifier"), F.when(F.col("l_partkey") % 3 > 0, F.concat(F.lit("k"), F.col("l_partkey").cast("string"))).alias("kind"),
        F.when(F.col("l_suppkey") % 2 > 0, F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))).alias("name"), F.expr("l_linenumber * 1000000000000 + l_partkey * 1000000 + l_suppkey").alias("ord"),
    )
    return graph.merge_nodes(rows).select("identifier", "kind", "name")


@query(f"with {A.TRADE_SQL} select distinct type from edges")
def graph_types(spark, sf):
    return spark.createDataFrame([(t,) for t in A.trade_graph(spark, sf).types], "type string")


@query(f"""with {A.CANDIDATES_SQL},
seen as (
  select context_id, identifier, depth, repeats, fe, ord from raw
  union all select context_id, identifier, greatest(depth - 1, 0), 0, 0.9::double, ord + 50000 from raw where ord % 2 = 0
  union all select context_id, identifier, depth + 2, 1, 0.8::double, ord - 50000 from raw where ord % 3 = 0)
select context_id, identifier, min(depth)::bigint as depth, (sum(repeats + 1) - 1)::bigint as repeats, arg_min(fe, ord) as evidence from seen group by 1, 2""")
def aggregate_candidates(spark, sf):
    """Nodes that a context holds up to three times, at several depths."""
    rows = A.context_nodes(spark, sf)
    nearer = rows.filter("ord % 2 = 0").withColumns({"depth": F.greatest(F.col("depth") - 1, F.lit(0)), "repeats": F.lit(0), "finding_evidence_score": F.lit(0.9), "ord": F.col("ord") + 50000})
    farther = rows.filter("ord % 3 = 0").withColumns({"depth": F.col("depth") + 2, "repeats": F.lit(1), "finding_evidence_score": F.lit(0.8), "ord": F.col("ord") - 50000})
    found = ranking.aggregate(rows.unionByName(nearer).unionByName(farther))
    return found.select("context_id", "identifier", F.col("depth").cast("long").alias("depth"), F.col("repeats").cast("long").alias("repeats"), F.col("finding_evidence_score").alias("evidence"))


def _stored(spark, sf) -> GraphStore:
    """The trade graph merged in three batches by number: edges often come before their ends, and every third order never comes.

    The last batch names all suppliers anew.
    """
    store = GraphStore.create(spark, f"{shared_folder(spark)}/graphloom/store-{uuid.uuid4().hex}", buckets=16)
    number = F.substring("identifier", 3, 30).cast("long")
    nodes = A.trade_nodes(spark, sf).withColumns({"n": number, "name": F.concat(F.lit("b"), (number % 3).cast("string")), "ord": F.lit(0).cast("long")}).filter("not (kind = 'orders' and n % 3 = 2)")
    edges = materialize(A.trade_edges(spark, sf).withColumns({"n": F.substring("src", 3, 30).cast("long"), "operation": F.lit(None).cast("string"), "ord": F.lit(0).cast("long")}), "edges")
    for k in range(3):
        rows = nodes.filter(F.col("n") % 3 == k)
        if k == 2:
            rows = rows.filter("kind <> 'supplier'").union(nodes.filter("kind = 'supplier'").withColumn("name", F.lit("last")))
        store.merge(rows.drop("n"), edges.filter(F.col("n") % 3 == k).drop("n"))
    return store


@query(f"""with {A.TRADE_SQL}, n as (select *, substr(identifier, 3)::bigint as n from nodes)
select identifier, kind, case when kind = 'supplier' then 'last' else 'b' || (n % 3) end as name from n where not (kind = 'orders' and n % 3 = 2)""")
def store_nodes(spark, sf):
    return _stored(spark, sf).graph().nodes.select("identifier", "kind", "name")


@query(f"""with {A.TRADE_SQL}, gone as (select identifier from nodes where kind = 'orders' and substr(identifier, 3)::bigint % 3 = 2)
select src, dst, type from edges where src not in (select identifier from gone) and dst not in (select identifier from gone)""")
def store_edges(spark, sf):
    return _stored(spark, sf).graph().edges.select("src", "dst", "type")


# ---------------------------------------------------------------- diffs

@query("""
with o as (select o_orderkey as context_id, o_orderkey % 3 + 1 as x, o_orderkey % 50 + 1 as s, 'd' || (o_orderkey % 3 + 1) || '/f' || (o_custkey % 7) || '.py' as file_path from orders)
select context_id, file_path, (s + 1)::int as start_line, (s + x)::int as end_line from o
union all select context_id, file_path, (s + 100)::int, (s + 100)::int from o""")
def diff_spans(spark, sf):
    """Unified diffs with two hunks, an added line that looks like a header, and a file that is gone."""
    x, s = "(o_orderkey % 3 + 1)", "(o_orderkey % 50 + 1)"
    diff = F.expr(f"""concat('diff --git a/f b/f\n--- a/old.py\n+++ b/d', {x}, '/f', o_custkey % 7, '.py\n@@ -1,3 +', {s}, ',', 2 + {x}, ' @@\n keep\n', repeat('+added\n', cast({x} as int)), '-gone\n keep\n',
      '@@ -90 +', {s} + 100, ' @@\n+++counter\n', '+++ /dev/null\n@@ -1 +1 @@\n+lost\n')""")
    return diffs.changed_spans(A.table(spark, sf, "orders").select(F.col("o_orderkey").alias("diff_id"), diff.alias("diff")))


# ---------------------------------------------------------------- Python files

_CODE = "from pkg.n{next} import fn as other\n\n\ndef fn(x):\n    y = x\n    return y\n\n\nv = fn(1)\nw = other(v)\n"
_FILES_SQL = "f as (select 'pkg/n' || lpad(n_nationkey::varchar, 2, '0') || '.py' as p, 'pkg/n' || lpad(((n_nationkey + 1) % 25)::varchar, 2, '0') || '.py' as q from nation)"


def _python_files(spark, sf) -> DataFrame:
    """A module a nation; each imports the function of the next."""
    before, after = _CODE.split("{next}")
    name = lambda k: F.lpad(k.cast("string"), 2, "0")
    code = F.concat(F.lit(before), name((F.col("n_nationkey") + 1) % 25), F.lit(after))
    return A.table(spark, sf, "nation").select(F.concat(F.lit("pkg/n"), name(F.col("n_nationkey")), F.lit(".py")).alias("file_path"), F.encode(code, "UTF-8").alias("content"))


@query(f"""
with {_FILES_SQL},
n(a, kind, b, start_line, end_line) as (values ('variable:v@', 'VariableNode', ':70', 9, 9), ('variable:w@', 'VariableNode', ':80', 10, 10), ('function:fn@', 'FunctionNode', ':34', 4, 6),
  ('variable:x@', 'VariableNode', ':41', 4, 4), ('variable:y@', 'VariableNode', ':49', 5, 5), ('code_block:v = fn(1)@', 'CodeBlockNode', ':70', 9, 10),
  ('call:fn(1)@', 'CallNode', ':74', 9, 9), ('call:other(v)@', 'CallNode', ':84', 10, 10))
select a || p || b as identifier, kind, start_line, end_line from f, n""")
def python_nodes(spark, sf):
    return python_cpg.build(_python_files(spark, sf))["nodes"].select("identifier", "kind", F.col("line_start").alias("start_line"), F.col("line_end").alias("end_line"))


@query(f"""
with {_FILES_SQL},
e(a, b, c, d, type) as (values ('function:fn@', ':34', 'variable:x@', ':41', 'DEFINED_BY'), ('variable:x@', ':41', 'variable:y@', ':49', 'DEFINED_BY'),
  ('code_block:v = fn(1)@', ':70', 'call:fn(1)@', ':74', 'CALLS'), ('call:fn(1)@', ':74', 'function:fn@', ':34', 'CALLED_BY'), ('call:fn(1)@', ':74', 'variable:v@', ':70', 'DEFINED_BY'),
  ('code_block:v = fn(1)@', ':70', 'call:other(v)@', ':84', 'CALLS'), ('variable:v@', ':70', 'call:other(v)@', ':84', 'FLOWS_TO'),
  ('call:other(v)@', ':84', 'variable:w@', ':80', 'DEFINED_BY'), ('variable:v@', ':70', 'variable:w@', ':80', 'DEFINED_BY'))
select a || p || b as src, c || p || d as dst, type from f, e
union all select 'call:other(v)@' || p || ':84', 'function:fn@' || q || ':34', 'CALLED_BY' from f""")
def python_edges(spark, sf):
    """Data flow and calls; the last kind of edge crosses files by an import."""
    return python_cpg.build(_python_files(spark, sf))["edges"].select("src", "dst", "type")


# ---------------------------------------------------------------- fix pairs and their samples

def _fixes(spark, sf) -> DataFrame:
    """Two changed functions a commit; some commits are tests or scored too low."""
    keys = spread(A.table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")  # a key makes rows that cost more than its bytes say
    rows = keys.select(F.col("o_orderkey").alias("k"), F.explode(F.array(F.lit(1), F.lit(2))).alias("i"))
    body = lambda word: F.concat(F.lit("def f"), F.col("i").cast("string"), F.lit(f"(x):\n    return {word}(x)"))
    return rows.select(
        body("bad").alias("func_before"), body("good").alias("func_after"), F.concat(F.lit("https://github.com/o/r/commit/"), F.lpad(F.lower(F.hex("k")), 12, "0")).alias("commit_url"),
        F.concat(F.lit("f"), F.col("i").cast("string"), F.lit(".py")).alias("file_name"), F.lit("CVE-1").alias("cve_id"), F.lit("py").alias("extension"), F.lit("fix").alias("commit_msg"), F.lit("['CWE-79']").alias("cwe_id"),
        F.when(F.col("k") % 11 == 0, "3").otherwise("5").alias("vulnerability_score"), F.when(F.col("k") % 7 == 0, "True").otherwise("False").alias("is_test"), (F.col("k") * 2 + F.col("i")).alias("ord"), "k", "i",
    )


def _checkouts(fixes: DataFrame) -> DataFrame:
    """Both sides' files; the first function is missing from every fifth commit, the second from every third."""
    there = F.when(F.col("i") == 1, F.col("k") % 5 != 0).otherwise(F.col("k") % 3 != 0)
    side = F.explode(F.array(F.struct(F.lit(True).alias("v"), F.concat(F.lit("import os\n\n"), F.col("func_before")).alias("text")), F.struct(F.lit(False).alias("v"), F.concat(F.lit("import os\nimport sys\n\n  "), F.regexp_replace("func_after", "\n", "  \n  ")).alias("text"))))
    rows = fixes.select(F.col("commit.repo_url").alias("repo_url"), F.col("commit.hash").alias("hash"), F.col("file_name").alias("file_path"), there.alias("there"), side.alias("s"))
    return rows.select("repo_url", "hash", F.col("s.v").alias("is_vulnerable"), "file_path", F.when(F.col("there"), F.col("s.text")).otherwise("pass").alias("content"))


def _pairs(spark, sf) -> DataFrame:
    fixes = materialize(datasets.usable_fixes(datasets.coerce_fixes(_fixes(spark, sf))), "fixes")
    return datasets.fix_pairs(fixes, _checkouts(fixes))


_PAIRS_SQL = """
o as (select o_orderkey as k, 'https://github.com/o/r@' || lpad(lower(hex(o_orderkey)), 12, '0') as pair_id from orders where o_orderkey % 7 <> 0 and o_orderkey % 11 <> 0),
f as (select k, pair_id, i from o, (values (1), (2)) t(i) where case i when 1 then k % 5 <> 0 else k % 3 <> 0 end),
p as (
  select k, pair_id, v as is_vulnerable, string_agg('def f' || i || '(x):' || chr(10) || '    return ' || case when v then 'bad' else 'good' end || '(x)', chr(10) order by i) as func_code,
    string_agg('f' || i || '.py:' || case when v then '3-4' else '4-5' end, ';' order by i) as files
  from f, (values (true), (false)) s(v) group by all)"""


@query(f"with {_PAIRS_SQL} select pair_id, is_vulnerable, func_code, files, 79 as cwe_id from p")
def fix_pairs(spark, sf):
    """Functions found exactly on one side and by collapsed white space on the other; commits lose functions or all."""
    where = F.array_join(F.transform("files", lambda f: F.concat(f["file_path"], F.lit(":"), F.array_join(F.transform(f["spans"], lambda s: F.concat_ws("-", s["start_line"].cast("string"), s["end_line"].cast("string"))), ","))), ";")
    return _pairs(spark, sf).select("pair_id", "is_vulnerable", "func_code", where.alias("files"), "cwe_id")


@query(f"""
with {_PAIRS_SQL},
ok as (select pair_id, row_number() over (order by min(k)) as rn from p where k % 13 <> 0 group by pair_id)
select 'bench-' || (2 * rn - is_vulnerable::int) as sample_id, strategy, is_vulnerable::int as label, pair_id from p join ok using (pair_id), (values ('current'), ('dummy')) s(strategy)""")
def compare_rankings(spark, sf):
    """Samples of two strategies, of the pairs for which both have text on both sides."""
    pairs = materialize(_pairs(spark, sf), "pairs")
    empty = (F.col("ord").bitwiseAND(1) == 1) & (F.floor(F.col("ord") / 2) % 13 == 0) | (F.col("ord").bitwiseAND(1) == 0) & ((F.col("ord") / 2 - 1) % 13 == 0)
    told = pairs.select(benchmark.context_id().alias("context_id"), F.explode(F.array(F.lit("current"), F.lit("dummy"))).alias("strategy"), empty.alias("empty"), "is_vulnerable")
    told = told.withColumn("text", F.when(F.col("empty") & (F.col("strategy") == "dummy") & ~F.col("is_vulnerable"), "").otherwise("code"))
    return benchmark.samples(pairs, told, ["current", "dummy"], "bench").select("sample_id", "strategy", "label", "pair_id")


@query("""
with p as (select doc_id, row_number() over (order by doc_id desc) as rn from documents)
select 'd-' || (2 * rn - label) as sample_id, label, doc_id from p, (values (1), (0)) s(label) where rn <= 50""")
def sample_numbers(spark, sf):
    """A limit of 101 samples: 50 whole pairs, numbered in order."""
    pairs = A.table(spark, sf, "documents").select("doc_id", (-F.col("doc_id")).alias("ord"))
    return datasets.number_samples(pairs, "d", 101).select("sample_id", "label", "doc_id")


@query("""
with o as (select o_orderkey as k from orders), f as (select k, i from o, (values (1), (2)) t(i)),
e as (
  select k, true as is_vulnerable, string_agg('old' || i || '.py:3-4,9-9', ';' order by i) as files from f where k % 2 = 0 group by k
  union all select k, false, string_agg('new' || i || '.py:' || case when k % 2 = 0 then '5-5' else '5-6' end, ';' order by i) from f group by k)
select 'CVE-2020-' || k as cve_id, k::varchar as hash, is_vulnerable, 79 as cwe_id, 'first of ' || k as description, files from e""")
def cve_entries(spark, sf):
    """Diffs as Python literals and as JSON, two files a fix, the description of the first."""
    rows = A.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.explode(F.array(F.lit(1), F.lit(2))).alias("i"))
    literal = """{'deleted': [['3', 'x'], [4, "y'"], ['9', 'z'], ['-1', 'w']], 'added': [['5', 'a']]}"""
    number = F.col("i").cast("string")
    rows = rows.select(
        F.concat(F.lit("CVE-2020-"), F.col("k").cast("string")).alias("cve_id"), F.lit("https://h.org/o/r").alias("repo_url"), F.col("k").cast("string").alias("hash"), F.concat(F.lit("old"), number, F.lit(".py")).alias("old_path"),
        F.concat(F.lit("new"), number, F.lit(".py")).alias("new_path"), F.lit("x").alias("filename"), F.when(F.col("k") % 2 == 0, F.lit(literal)).otherwise(F.lit('{"deleted": [], "added": [[5, "a"], [6, null]]}')).alias("diff_parsed"),
        F.lit("CWE-79").alias("cwe_id"), F.lit("HIGH").alias("cvss3_base_severity"), F.lit(None).cast("string").alias("severity"),
        F.when(F.col("i") == 1, F.concat(F.lit("first of "), F.col("k").cast("string"))).otherwise("second").alias("description"), (F.col("k") * 2 + F.col("i")).alias("ord"),
    )
    where = F.array_join(F.transform("files", lambda f: F.concat(f["file_path"], F.lit(":"), F.array_join(F.transform(f["spans"], lambda s: F.concat_ws("-", s["start_line"].cast("string"), s["end_line"].cast("string"))), ","))), ";")
    return datasets.cve_entries(rows).select("cve_id", "hash", "is_vulnerable", F.col("cwe_id").cast("int").alias("cwe_id"), "description", where.alias("files"))


@query("""
select doc_id::varchar as sample_id, case when doc_id % 3 <> 0 then 'answer ' || doc_id end as response, case when doc_id % 3 = 0 then 'no response' end as error from documents""")
def sample_responses(spark, sf):
    docs = A.table(spark, sf, "documents")
    answers = docs.filter("doc_id % 3 <> 0").select(F.col("doc_id").cast("string").alias("sample_id"), F.concat(F.lit("answer "), F.col("doc_id").cast("string")).alias("response"))
    return review.answered(docs.select(F.col("doc_id").cast("string").alias("sample_id")), answers).select("sample_id", "response", "error")


# ---------------------------------------------------------------- checkouts to datasets

def _commits(spark, sf) -> DataFrame:
    """A fix a customer, in a repository of its own, of one function that calls another file's."""
    rows = spread(A.table(spark, sf, "customer").select(F.col("c_custkey").alias("k")), "k")  # as in :func:`_fixes`
    body = lambda word: F.concat(F.lit(f"def run(x):\n    return helper({word}"), F.col("k").cast("string"), F.lit("(x))"))
    return rows.select(
        body("bad").alias("func_before"), body("good").alias("func_after"), F.concat(F.lit("https://github.com/o/r"), F.col("k").cast("string"), F.lit("/commit/abcdef1")).alias("commit_url"), F.lit("f1.py").alias("file_name"),
        F.lit("CVE-1").alias("cve_id"), F.lit("py").alias("extension"), F.lit("fix").alias("commit_msg"), F.lit("CWE-79").alias("cwe_id"), F.lit("5").alias("vulnerability_score"), F.lit("False").alias("is_test"), F.col("k").alias("ord"), "k",
    )


def _both_sides(commits: DataFrame) -> DataFrame:
    """Equal paths in every checkout; the called file tells the customer and the side, and every fifth commit lacks it."""
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    k = F.col("k").cast("string")
    side = F.explode(F.array(F.struct(F.lit(True).alias("v"), F.lit("").alias("head"), F.col("func_before").alias("code")), F.struct(F.lit(False).alias("v"), F.lit("import os\n").alias("head"), F.col("func_after").alias("code"))))
    rows = commits.select("commit.*", "k", side.alias("s")).select("repo_url", "hash", "k", "s.*")
    files = F.array(
        F.struct(F.lit("f1.py").alias("file_path"), text(F.col("head"), "from f2 import helper\n\n\n", F.col("code"), "\n").alias("content")),
        F.struct(F.lit("f2.py").alias("file_path"), text("def helper(y):\n    return y + ", k, F.when(F.col("v"), F.lit("0")).otherwise(F.lit("1")), "\n").alias("content")),
        F.struct(F.lit("tests/f2.py").alias("file_path"), F.lit("def helper(y):\n    return None\n").alias("content")),
    )
    rows = rows.select("repo_url", "hash", F.col("v").alias("is_vulnerable"), "k", F.explode(files).alias("f")).filter("not (k % 5 = 0 and f.file_path = 'f2.py')")
    return rows.select("repo_url", "hash", "is_vulnerable", "f.*")


@query("""
with s as (select c_custkey as k, v as is_vulnerable, row_number() over (partition by v order by c_custkey) as rn from customer, (values (true), (false)) t(v)),
t as (
  select *, 'def run(x):' || chr(10) || '    return helper(' || case when is_vulnerable then 'bad' else 'good' end || k || '(x))' as own,
    'def helper(y):' || chr(10) || '    return y + ' || k || case when is_vulnerable then '0' else '1' end as other from s)
select 'c-' || (2 * rn - is_vulnerable::int) as sample_id, strategy, is_vulnerable::int as label,
  case when k % 5 = 0 then own when strategy = 'current' then own || chr(10) || other else other || chr(10) || own end as code
from t, (values ('current'), ('dummy')) st(strategy)""")
def compare_checkouts(spark, sf):
    """From both checkouts of many repositories to a dataset a strategy: equal paths and node names, no context sees another's."""
    commits = materialize(datasets.usable_fixes(datasets.coerce_fixes(_commits(spark, sf))), "commits")
    files = _both_sides(commits)
    pairs = materialize(datasets.fix_pairs(commits, files), "pairs")
    return benchmark.compare(pairs, files, ["current", "dummy"], depth=2, budget=512, prefix="c").select("sample_id", "strategy", "label", "code")
