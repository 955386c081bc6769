"""Command line: ``python -m graphloom.cli COMMAND``. Model servers stay outside; verdicts come from a table of responses."""

from __future__ import annotations

import argparse
import importlib
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import config
from graphloom.config import BudgetConfig, Coefficients
from graphloom.operators import datasets, findings, graph, reports
from graphloom.operators.ranking import STRATEGIES
from graphloom.operators.store import GraphStore, open_graph
from graphloom.plans import benchmark, scan, tuning
from graphloom.sources import analyzers, commits, json_datasets, python_cpg, tables
from graphloom.staging import materialize


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="graphloom")
    sub = p.add_subparsers(dest="command", required=True)
    load = sub.add_parser("load", help="write the graph of a source tree as Parquet")
    load.add_argument("src")
    load.add_argument("out")
    load.add_argument("--merge", action="store_true", help="into the stored graph there, which is made if need be, instead of over it")
    load.add_argument("--on-conflict", choices=["last", "error"], default="last", help="with --merge: other values for nodes that are there")
    load.add_argument("--buckets", type=int, default=64)
    p_ = sub.add_parser("checkouts", help="write both sides' files of a dataset's commits, out of local clones, as Parquet")
    p_.add_argument("dataset")
    p_.add_argument("clones", help="a folder of clones that all executors reach")
    p_.add_argument("out")
    p_.add_argument("--min-score", type=int, default=4)
    r = sub.add_parser("merge-runs", help="merge JSON datasets of several runs by file name")
    r.add_argument("root")
    r.add_argument("out")
    r.add_argument("--pattern", default="compare_rankings*")
    one = sub.add_parser("load-sample", help="write the graph of a single file as Parquet")
    one.add_argument("file")
    one.add_argument("out")
    s = sub.add_parser("scan", help="contexts and verdicts of findings, or of a diff's lines")
    s.add_argument("src")
    s.add_argument("--json-report")
    s.add_argument("--text-report")
    s.add_argument("--mode", choices=["full", "diff"], default="full")
    s.add_argument("--diff", help="a unified diff, for diff mode")
    s.add_argument("--strategy", choices=sorted(STRATEGIES), default="cpg_structural")
    s.add_argument("--min-severity", choices=["LOW", "MEDIUM", "HIGH"], default="HIGH")
    s.add_argument("--depth", type=int, default=3)
    s.add_argument("--budget", type=int, default=2048)
    s.add_argument("--coefficients")
    s.add_argument("--responses", help="Parquet of sample_id, response")
    s.add_argument("--contexts", help="where to write the contexts, to be answered elsewhere")
    s.add_argument("--json")
    s.add_argument("--sarif")
    s.add_argument("--no-fail", action="store_true")
    b = sub.add_parser("build-benchmark", help="usable fix pairs of a dataset as numbered samples")
    b.add_argument("dataset")
    b.add_argument("out")
    b.add_argument("--min-score", type=int, default=4)
    b.add_argument("--limit", type=int)
    c = sub.add_parser("compare-rankings", help="a dataset a strategy, and entries, from pairs and their contexts")
    c.add_argument("dataset")
    c.add_argument("files", help="Parquet of both checkouts: repo_url, hash, is_vulnerable, file_path, content")
    c.add_argument("out")
    c.add_argument("--contexts", help="Parquet of strategy, context_id, text, made elsewhere; else they are made of the checkouts")
    c.add_argument("--depth", type=int, default=3)
    c.add_argument("--coefficients")
    c.add_argument("--name", default="benchmark")
    c.add_argument("--strategies", default=",".join(sorted(STRATEGIES)))
    c.add_argument("--min-score", type=int, default=4)
    c.add_argument("--budget", type=int, default=2048)
    c.add_argument("--max-repo-bytes", type=int)
    c.add_argument("--limit", type=int)
    m = sub.add_parser("merge", help="merge JSON datasets, the first of equal samples stays")
    m.add_argument("inputs", nargs="+")
    m.add_argument("out")
    m.add_argument("--keep-duplicates", action="store_true")
    t = sub.add_parser("tune", help="search a strategy's weights over prepared contexts, or the combiner's over labelled, scored nodes")
    t.add_argument("input", help="a prepared folder, with --send; or Parquet of nodes with the four scores and a boolean label")
    t.add_argument("out")
    t.add_argument("--strategy", choices=sorted(tuning.SPACES), default="current")
    t.add_argument("--send", metavar="MODULE:FUNCTION", help="from a prompt to a model's answer")
    t.add_argument("--graph", help="the folder that load wrote, with --send")
    t.add_argument("--src", help="the source tree, with --send")
    t.add_argument("--labels", help="Parquet of context_id, label, with --send")
    t.add_argument("--json-report", help="with --send: findings, from which each weighting scores the nodes anew")
    t.add_argument("--text-report")
    t.add_argument("--budget", type=int, default=2048)
    t.add_argument("--base")
    t.add_argument("--batches", type=int, default=3)
    t.add_argument("--size", type=int, default=16)
    t.add_argument("--threshold", type=float, default=0.5)
    t.add_argument("--study", help="a folder of judged batches, to go on from")
    e = sub.add_parser("export-config", help="write a configuration with changed values")
    e.add_argument("kind", choices=["coefficients", "budget"])
    e.add_argument("out")
    e.add_argument("--base")
    e.add_argument("--set", action="append", default=[], metavar="KEY=VALUE")
    return p


def _reports(spark: SparkSession, a: argparse.Namespace) -> DataFrame | None:
    found = None
    for read, path in ((analyzers.json_report, a.json_report), (analyzers.text_report, a.text_report)):
        if path:
            rows = read(spark, path, a.src)
            found = rows if found is None else found.unionByName(rows)
    return found


def _scan(spark: SparkSession, a: argparse.Namespace) -> int:
    found = _reports(spark, a)
    weights = config.load(Coefficients, a.coefficients) if a.coefficients else None
    project = scan.load(spark, a.src, found, weights)
    if a.mode == "diff":
        with open(a.diff, encoding="utf-8") as f:
            roots = scan.diff_roots(project, f.read())
    else:
        roots = scan.finding_roots(project, a.min_severity)
    rows = scan.contexts(project, roots, a.strategy, a.depth, a.budget, weights)
    if a.contexts:
        rows.write.mode("overwrite").parquet(a.contexts)
        rows = spark.read.parquet(a.contexts)
    verdicts = scan.reviewed(rows, responses=spark.read.parquet(a.responses) if a.responses else None).cache()
    if a.json:
        verdicts.coalesce(1).write.mode("overwrite").json(a.json)
    if a.sarif:
        reports.write_sarif(verdicts, a.sarif, {"scanMode": a.mode, "strategy": a.strategy})
    print(json.dumps(reports.summary(verdicts).first().asDict()))
    return reports.exit_code(verdicts, a.no_fail)


def _tune(spark: SparkSession, a: argparse.Namespace) -> float:
    kind = BudgetConfig if a.strategy == "evidence_budgeted" else Coefficients
    base = config.load(kind, a.base) if a.base else kind()
    if a.send:
        module, name = a.send.split(":")
        send = getattr(importlib.import_module(module), name)
        nodes, labels = open_graph(spark, a.graph).nodes, spark.read.parquet(a.labels)
        lines = materialize(tables.source_lines(python_cpg.scan(spark, a.src)), "lines")
        edges, around = spark.read.parquet(f"{a.input}/edges"), spark.read.parquet(f"{a.input}/{'typed' if STRATEGIES[a.strategy].edge_paths else 'plain'}")
        space, rescore = tuning.SPACES[a.strategy], None
        if (found := _reports(spark, a)) is not None:
            found = materialize(findings.merge(found), "findings")
            links = materialize(findings.merge_reports(findings.attach(found, nodes), found, nodes), "reports")
            rescore = lambda rows, c: findings.score_nodes(rows, links, found, c)
        judge = lambda made: tuning.judged_contexts(around, edges, nodes, lines, labels, a.strategy, made, send, a.budget, rescore)
    else:
        if a.strategy != "current":
            raise SystemExit("labelled nodes tune the combiner of current only; other strategies need --send")
        nodes = spark.read.parquet(a.input)
        space = {k: v for k, v in tuning.SPACES[a.strategy].items() if k.startswith("combiner.")}
        judge = lambda made: tuning.trials(nodes, made, a.threshold)
    best, accuracy = tuning.search(base, space, judge, a.batches, a.size, study=a.study)
    config.save(best, a.out)
    return accuracy


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    if a.command == "export-config":
        kind = {"coefficients": Coefficients, "budget": BudgetConfig}[a.kind]
        changes = {k: json.loads(v) for k, v in (x.split("=", 1) for x in a.set)}
        config.save(config.overlay(config.load(kind, a.base) if a.base else kind(), changes), a.out)
        return 0
    spark = SparkSession.builder.appName("graphloom").getOrCreate()
    if a.command == "scan":
        return _scan(spark, a)
    if a.command == "load":
        project = scan.load(spark, a.src)
        if a.merge:
            at = GraphStore(spark, a.out) if GraphStore.exists(spark, a.out) else GraphStore.create(spark, a.out, a.buckets)
            got = at.merge(project.graph.nodes, project.graph.edges, a.on_conflict)
            print(json.dumps({"version": got.version, "conflicts": got.conflicts.count(), "pending": got.pending}))
        else:
            graph.write_graph(project.graph, a.out)
    elif a.command == "checkouts":
        rows = datasets.usable_fixes(datasets.coerce_fixes(tables.load(spark, a.dataset)), a.min_score)
        found = materialize(commits.files(rows.select("commit.repo_url", "commit.hash"), a.clones), "files")
        found.filter("error is null").drop("error").write.mode("overwrite").parquet(a.out)
        print(json.dumps({"files": found.filter("error is null").count(), "unreadable": [r.asDict() for r in found.filter("error is not null").select("repo_url", "hash", "is_vulnerable", "error").limit(20).collect()]}))
    elif a.command == "merge-runs":
        print(json.dumps([r.asDict() for r in json_datasets.merge(spark, a.root, a.out, a.pattern).orderBy("file_name").collect()]))
    elif a.command == "load-sample":
        folder, name = os.path.split(os.path.abspath(a.file))
        g = scan.load(spark, folder, only=name).graph
        graph.write_graph(g, a.out)
        print(json.dumps({"nodes": g.nodes.count(), "edges": g.edges.count()}))
    elif a.command == "build-benchmark":
        rows = datasets.coerce_fixes(tables.load(spark, a.dataset)).withColumn("ord", F.monotonically_increasing_id())
        pairs = datasets.usable_fixes(rows, a.min_score)
        samples = datasets.number_samples(pairs, "sample", a.limit)
        samples.withColumn("code", F.when(F.col("label") == 1, F.col("func_before")).otherwise(F.col("func_after"))).drop("func_before", "func_after").write.mode("overwrite").json(a.out)
    elif a.command == "compare-rankings":
        rows = datasets.coerce_fixes(tables.load(spark, a.dataset)).withColumn("ord", F.monotonically_increasing_id())
        files = spark.read.parquet(a.files)
        pairs = datasets.pairs_within_budget(datasets.fix_pairs(datasets.usable_fixes(rows, a.min_score), files), a.budget)
        if a.max_repo_bytes is not None:
            pairs = datasets.pairs_of_small_repositories(pairs, files, a.max_repo_bytes)
        names = a.strategies.split(",")
        if a.contexts:
            found = benchmark.samples(pairs, spark.read.parquet(a.contexts), names, limit=a.limit)
        else:
            weights = config.load(Coefficients, a.coefficients) if a.coefficients else None
            found = benchmark.compare(materialize(pairs, "pairs"), files, names, a.depth, a.budget, weights, limit=a.limit)
        found = materialize(found, "samples")
        print(json.dumps(benchmark.write(found, a.out, a.name, names)))
    elif a.command == "merge":
        rows = None
        for k, path in enumerate(a.inputs):
            one = spark.read.json(path).withColumn("ord", F.lit(k << 40) + F.monotonically_increasing_id())
            rows = one if rows is None else datasets.concat(rows, one)
        datasets.check_same_kind(rows)
        (rows if a.keep_duplicates else datasets.merge_datasets(rows)).drop("ord").write.mode("overwrite").json(a.out)
    elif a.command == "tune":
        print(json.dumps({"accuracy": _tune(spark, a)}))
    return 0


if __name__ == "__main__":
    sys.exit(main())
