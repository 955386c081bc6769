"""Benchmarks that compare rankings: pairs of a commit's sides, a context of each strategy, numbered samples, entries, keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.config import Coefficients
from graphloom.functions import text
from graphloom.operators import datasets
from graphloom.plans import assemble, scan
from graphloom.sources import python_cpg
from graphloom.staging import materialize

#: The strategy whose dataset has the plain name.
PLAIN = "current"


def graph_id(of: Column | None = None) -> Column:
    """The checkout: a digest of repository, commit and side."""
    side = F.when(F.col("is_vulnerable") if of is None else of, F.lit("vuln")).otherwise(F.lit("fixed"))
    return F.md5(F.concat_ws("\n", "repo_url", "hash", side).cast("binary"))


def context_spans(pairs: DataFrame, of: Column | None = None) -> DataFrame:
    """``context_id, graph_id, file_path, start_line, end_line`` of both sides, for :func:`graphloom.plans.assemble.roots`; ``of`` names a context."""
    rows = pairs.select((context_id() if of is None else of).alias("context_id"), graph_id().alias("graph_id"), F.explode("files").alias("f"))
    rows = rows.select("context_id", "graph_id", "f.file_path", F.explode("f.spans").alias("s"))
    return rows.select("context_id", "graph_id", "file_path", "s.start_line", "s.end_line")


def context_id() -> Column:
    return F.concat_ws("#", "pair_id", F.when(F.col("is_vulnerable"), F.lit("vuln")).otherwise(F.lit("fixed")))


def checkouts(pairs: DataFrame, files: DataFrame) -> DataFrame:
    """``graph_id, file_path, content`` of the Python files of the pairs' checkouts; directories that are never scanned are left out."""
    side = ["repo_url", "hash", "is_vulnerable"]
    wanted = files.join(pairs.select(*side).distinct(), side, "left_semi").filter(F.endswith("file_path", F.lit(".py")))
    body = F.encode("content", "UTF-8") if dict(files.dtypes)["content"] == "string" else F.col("content")
    return wanted.filter(~python_cpg.excluded(F.col("file_path"))).select(graph_id().alias("graph_id"), "file_path", body.alias("content"))


def compare(
    pairs: DataFrame, files: DataFrame, strategies: list[str], depth: int = 3, budget: int = 2048, coefficients: Coefficients | None = None, findings: DataFrame | None = None,
    prefix: str = "sample", limit: int | None = None, **options
) -> DataFrame:
    """From the checkouts of all pairs to the samples of every strategy, in one plan.

    ``files`` are both sides, ``repo_url, hash, is_vulnerable, file_path, content``; ``findings``, of analyzers that ran on them, carry
    ``graph_id`` (see :func:`graph_id`). All checkouts make one graph, whose ids and lookups hold the checkout, so equal paths
    stay apart. Traversals run once and serve every strategy.
    """
    project = scan.build(materialize(checkouts(pairs, files), "checkouts"), findings, coefficients)
    near = assemble.around(project.graph, assemble.roots(project.graph, context_spans(pairs)), depth, strategies)
    told = assemble.contexts(near, project.graph.nodes, project.lines, strategies, budget, coefficients, **options)
    return samples(pairs, materialize(told, "told"), strategies, prefix, limit)


def samples(pairs: DataFrame, contexts: DataFrame, strategies: list[str], prefix: str = "sample", limit: int | None = None) -> DataFrame:
    """Numbered samples of every strategy, of the pairs for which each gave text on both sides.

    ``contexts`` has ``strategy, context_id, text``. A sample has the same id in every strategy.
    """
    sides = pairs.withColumn("context_id", context_id())
    told = contexts.filter(F.col("strategy").isin(strategies)).select("strategy", "context_id", "text")
    # Which pairs count, and their order, needs no text: that is read once, for them.
    full = told.select("context_id", (F.length("text") > 0).alias("full"))
    accepted = datasets.complete_pairs(sides.select("context_id", "pair_id", "ord").join(full, "context_id"), len(strategies))
    numbered = datasets.number_samples(accepted, prefix, limit).select("sample_id", "label", "pair_id")
    rows = sides.withColumn("label", F.col("is_vulnerable").cast("int")).join(numbered, ["pair_id", "label"]).join(told, "context_id")
    return rows.withColumns({"code": F.col("text"), "severity": F.lit("unknown"), "cwe_types": F.transform("cwe_ids", lambda n: F.concat(F.lit("CWE-"), n.cast("string")))})


def write(rows: DataFrame, path: str, name: str, strategies: list[str]) -> dict[str, str]:
    """A JSON dataset a strategy and one of entries, by which samples are joined back to their source; the paths."""
    about = F.struct("commit_url", F.col("commit_msg").alias("description"), F.col("cwe_id").alias("cwe_number"))
    out = {}
    for s in strategies:
        out[s] = f"{path}/{name}" if s == PLAIN else f"{path}/{name}_{s}"
        one = rows.filter(F.col("strategy") == s)
        one.select(F.col("sample_id").alias("id"), "code", "label", about.alias("metadata"), "cwe_types", "severity").write.mode("overwrite").json(out[s])
    out["entries"] = f"{path}/{name}_entries"
    entry = ["sample_id", "commit_url", "repo_url", F.col("hash").alias("fix_hash"), "file_name", "func_code", "cve_id", "cwe_id", "cwe_ids", "vulnerability_score", "commit_msg", "is_vulnerable"]
    rows.select(*entry).dropDuplicates(["sample_id"]).write.mode("overwrite").json(out["entries"])
    return out


def keyed(pairs: DataFrame, depth: int, **options: object) -> DataFrame:
    """``pairs`` with a ``cache_key`` of all that a prepared sample depends on."""
    spans = F.array_join(F.transform(F.array_sort("files"), lambda f: F.concat_ws(":", f["file_path"], F.array_join(F.transform(F.array_sort(f["spans"]), lambda s: F.concat_ws("-", s["start_line"].cast("string"), s["end_line"].cast("string"))), ","))), ";")
    rest = [F.lit(f"{k}={options[k]}") for k in sorted(options)]
    return pairs.withColumn("cache_key", text.cache_key([F.lit("1"), F.col("repo_url"), F.col("hash"), F.col("is_vulnerable"), F.lit(depth), spans, *rest]))
