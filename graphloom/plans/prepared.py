"""Prepared samples by key: what no weight changes is made once, and found again by all that it depends on.

A store is a folder of batches, each with the neighbourhoods, induced edges and source lines of new samples, and of ``keys``, which
name the batch of a sample and how many rows it has there. Keys are written last, so a batch that fails is never found. A
sample whose rows cannot all be read counts as missing, is told of, and made again.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from graphloom.config import Coefficients
from graphloom.plans import assemble, benchmark, scan
from graphloom.plans.assemble import Around
from graphloom.staging import materialize

_KEYS = "cache_key string, batch string, n_plain long, n_typed long, n_edges long, n_lines long, schemas map<string,string>"
_TABLES = ("plain", "typed", "edges", "lines")


def keys(spark: SparkSession, path: str) -> DataFrame:
    """``cache_key, batch`` and row counts of every prepared sample, the last batch of each; none where there is no store yet."""
    try:
        rows = spark.read.schema(_KEYS).parquet(f"{path}/keys")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _KEYS)
    counts = [c for c in rows.columns if c != "cache_key"]
    return rows.groupBy("cache_key").agg(F.max_by(F.struct(*counts), "batch").alias("b")).select("cache_key", "b.*")


def _rows(spark: SparkSession, path: str, name: str, wanted: DataFrame) -> DataFrame | None:
    """A table's rows of the wanted samples; files that cannot be read are passed over here, and told of by :func:`broken`."""
    batches = sorted(r[0] for r in wanted.select("batch").distinct().collect())  # a name a run
    if not batches:
        return None
    told = wanted.orderBy(F.desc("batch")).select("schemas").first()["schemas"]  # of the last batch; files may be past reading
    found = spark.read.schema(StructType.fromJson(json.loads(told[name]))).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).option("basePath", path).parquet(*[f"{path}/{b}/{name}" for b in batches])
    here = F.regexp_extract(F.col("_metadata.file_path"), f"/([^/]+)/{name}/[^/]*$", 1)
    return found.withColumn("_batch", here).join(wanted.select(F.col("cache_key").alias("context_id"), F.col("batch").alias("_batch")), ["context_id", "_batch"], "left_semi").drop("_batch")


def broken(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """``cache_key, error`` of prepared samples of ``wanted (cache_key)`` with rows that cannot be read."""
    there = materialize(keys(spark, path).join(wanted.select("cache_key").distinct(), "cache_key", "left_semi"), "there")
    out = there
    for name in _TABLES:
        rows = _rows(spark, path, name, there)
        n = there.select("cache_key").limit(0).withColumn("_n", F.lit(0).cast("long")) if rows is None else rows.groupBy(F.col("context_id").alias("cache_key")).agg(F.count(F.lit(1)).alias("_n"))
        out = out.join(n, "cache_key", "left").withColumn(f"_{name}", F.coalesce("_n", F.lit(0))).drop("_n")
    lost = [F.when(F.col(f"_{t}") < F.col(f"n_{t}"), F.concat(F.lit(f"{t}: "), (F.col(f"n_{t}") - F.col(f"_{t}")).cast("string"), F.lit(" rows cannot be read"))) for t in _TABLES]
    return out.select("cache_key", F.concat_ws("; ", *lost).alias("error")).filter("error <> ''")


def ensure(pairs: DataFrame, files: DataFrame, path: str, depth: int = 2, coefficients: Coefficients | None = None, repair: bool = True, **options: object) -> DataFrame:
    """``pairs`` with their ``cache_key``; samples that the store lacks are prepared and added, all others are left alone.

    If nothing is missing, no file is parsed and nothing is traversed. ``repair`` looks for rows that cannot be read.
    """
    spark = pairs.sparkSession
    keyed = materialize(benchmark.keyed(pairs, depth, **options), "keyed")
    have = keys(spark, path).select("cache_key")
    if repair:
        have = have.join(materialize(broken(spark, path, keyed), "broken"), "cache_key", "left_anti")
    missing = materialize(keyed.join(have, "cache_key", "left_anti"), "missing")
    if missing.isEmpty():
        return keyed
    project = scan.build(materialize(benchmark.checkouts(missing, files), "checkouts"), None, coefficients)
    # A sample is a context by its key; equal samples of several pairs are prepared once.
    spans = benchmark.context_spans(missing, F.col("cache_key"))
    near = assemble.around(project.graph, assemble.roots(project.graph, spans), depth)
    files_of = near.plain.unionByName(near.typed, allowMissingColumns=True).groupBy("context_id", "graph_id", "file_path").agg(F.min("line_start").alias("_from"), F.max("line_end").alias("_to"))
    lines = project.lines.join(files_of, ["graph_id", "file_path"]).filter("line_no between _from and _to").select("context_id", "graph_id", "file_path", "line_no", "text")
    batch = f"{len(keys(spark, path).select('batch').distinct().collect()):08d}-{uuid.uuid4().hex[:8]}"
    counted, schemas = missing.select("cache_key").distinct(), []
    for name, rows in (("plain", near.plain), ("typed", near.typed), ("edges", near.edges), ("lines", lines)):
        rows.write.parquet(f"{path}/{batch}/{name}")
        schemas += [F.lit(name), F.lit(rows.schema.json())]
        n = spark.read.schema(rows.schema).parquet(f"{path}/{batch}/{name}").groupBy(F.col("context_id").alias("cache_key")).agg(F.count(F.lit(1)).alias(f"n_{name}"))
        counted = counted.join(n, "cache_key", "left").withColumn(f"n_{name}", F.coalesce(f"n_{name}", F.lit(0).cast("long")))
    counted = counted.withColumns({"batch": F.lit(batch), "schemas": F.create_map(*schemas)})
    counted.select(*spark.createDataFrame([], _KEYS).columns).coalesce(1).write.mode("append").parquet(f"{path}/keys")
    return keyed


def samples(keyed: DataFrame, path: str, strategies: list[str], budget: int = 2048, coefficients: Coefficients | None = None, prefix: str = "sample", limit: int | None = None, **options: object) -> DataFrame:
    """The samples of every strategy out of the store, for pairs that :func:`ensure` has returned; without a parse or traversal."""
    spark = keyed.sparkSession
    wanted = materialize(keys(spark, path).join(keyed.select("cache_key").distinct(), "cache_key", "left_semi"), "wanted")
    tables = {name: _rows(spark, path, name, wanted) for name in _TABLES}
    if tables["plain"] is None:
        raise ValueError("none of these samples is prepared")
    tables = {name: materialize(rows, name) for name, rows in tables.items()}
    near = Around(tables["plain"], tables["typed"], tables["edges"])
    cut = ["identifier", "graph_id", "file_path", "line_start", "line_end"]
    nodes = near.plain.select(*cut).union(near.typed.select(*cut)).distinct()
    lines = tables["lines"].drop("context_id").distinct()
    told = assemble.contexts(near, nodes, lines, strategies, budget, coefficients, **options).withColumnRenamed("context_id", "cache_key")
    told = materialize(told, "told").join(keyed.select("cache_key", benchmark.context_id().alias("context_id")), "cache_key").drop("cache_key")
    return benchmark.samples(keyed.drop("cache_key"), told, strategies, prefix, limit)
