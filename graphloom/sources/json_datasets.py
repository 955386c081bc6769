"""JSON datasets of several runs, merged by file name, whatever shape their entries have.

A document is an object with ``metadata`` and ``samples``, or an array of entries. Documents are VARIANT values, so entries of
differing shape need no common schema. Each document is one row; its entries are rows from there on, and only they are
compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, root: str, pattern: str = "compare_rankings*", exclude: str = "") -> DataFrame:
    """``file_name, file_path, doc`` of ``*.json`` directly in the matching directories; ``exclude`` names one that is left out."""
    rows = spark.read.format("text").option("wholetext", True).load(f"{root.rstrip('/')}/{pattern}/*.json")
    rows = rows.select(F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_path").alias("file_path"), F.try_parse_json("value").alias("doc"))
    return rows.filter(~F.contains("file_path", F.lit(f"/{exclude.strip('/')}/"))) if exclude else rows


def _text(at: str) -> F.Column:
    """A member that is a string; null if it is none."""
    there = F.try_variant_get("doc", at, "variant")
    return F.when(F.schema_of_variant(there) == "STRING", F.try_variant_get("doc", at, "string"))


def shaped(docs: DataFrame) -> DataFrame:
    """``docs`` with ``kind`` (object or array), ``name``, ``task_type``, ``parts`` (the entries) and ``error``, null for a sound document."""
    shape = F.schema_of_variant("doc")
    kind = F.when(F.startswith(shape, F.lit("ARRAY")), "array").when(F.startswith(shape, F.lit("OBJECT")), "object")
    parts = F.when(kind == "array", F.expr("try_cast(doc as array<variant>)")).otherwise(F.expr("try_variant_get(doc, '$.samples', 'array<variant>')"))
    samples = F.schema_of_variant(F.try_variant_get("doc", "$.samples", "variant"))
    rows = docs.withColumns({"kind": kind, "parts": F.when(kind == "array", parts).when(F.startswith(samples, F.lit("ARRAY")), parts), "name": _text("$.metadata.name"), "task_type": _text("$.metadata.task_type")})
    plain = F.exists("parts", lambda p: ~F.startswith(F.schema_of_variant(p), F.lit("OBJECT")))
    error = (
        F.when(F.col("doc").isNull(), "is no JSON").when(F.col("kind").isNull(), "is neither an object nor an array")
        .when((F.col("kind") == "object") & (F.col("name").isNull() | F.col("task_type").isNull()), "lacks metadata.name or metadata.task_type")
        .when(F.col("parts").isNull(), "has no array of samples").when((F.col("kind") == "object") & plain, "has a sample that is no object")
    )
    return rows.withColumn("error", error)


def check(docs: DataFrame) -> None:
    """An error for documents that are unsound, or that share a file name and not their shape, name or task type."""
    rows = shaped(docs)
    if bad := rows.filter("error is not null").select("file_path", "error").orderBy("file_path").head(1):
        raise ValueError(f"{bad[0]['file_path']} {bad[0]['error']}")
    one = lambda c: F.count_distinct(F.coalesce(c, F.lit(""))).alias(c)
    differing = rows.groupBy("file_name").agg(*[one(c) for c in ("kind", "name", "task_type")])
    if bad := differing.filter("kind > 1 or name > 1 or task_type > 1").orderBy("file_name").head(1):
        what = next(c for c in ("kind", "name", "task_type") if bad[0][c] > 1)
        raise ValueError(f"{bad[0]['file_name']}: documents differ in {what}")


def entries(docs: DataFrame) -> DataFrame:
    """``file_name, kind, file_path, at, entry, key, cwe``: an entry a row, as JSON with sorted names; ``key`` says which are equal."""
    rows = shaped(docs).select("file_name", "kind", "file_path", F.posexplode("parts").alias("at", "e"))
    entry = F.to_json("e")
    cve = F.try_variant_get("e", "$.metadata.CVEFixes-Number", "variant")
    label = F.try_variant_get("e", "$.label", "variant")
    named = (F.col("kind") == "object") & (F.schema_of_variant(cve) == "STRING") & label.isNotNull() & ~F.is_variant_null(label)
    key = F.when(named, F.concat_ws("::", F.try_variant_get("e", "$.metadata.CVEFixes-Number", "string"), F.try_variant_get("e", "$.label", "string"))).otherwise(entry)
    number = F.try_variant_get("e", "$.metadata.cwe_number", "variant")
    text = F.when(F.schema_of_variant(number).isin("STRING", "BIGINT"), F.try_variant_get("e", "$.metadata.cwe_number", "string"))
    cwe = F.when(F.startswith(text, F.lit("CWE-")), text).otherwise(F.concat(F.lit("CWE-"), text))
    return rows.select("file_name", "kind", "file_path", "at", entry.alias("entry"), key.alias("key"), F.when(F.col("kind") == "object", cwe).alias("cwe"))


def merged(rows: DataFrame) -> DataFrame:
    """The first of equal entries of a file name, by path and place; ``file_name, kind, file_path, at, entry, cwe``."""
    first = F.min_by(F.struct("kind", "file_path", "at", "entry", "cwe"), F.struct("file_path", "at"))
    return rows.groupBy("file_name", F.sha2(F.col("key").cast("binary"), 256).alias("_k")).agg(first.alias("f")).select("file_name", "f.*")


def counts(rows: DataFrame) -> DataFrame:
    """``file_name, n_files, n_entries, n_unique, n_duplicates``."""
    key = F.sha2(F.col("key").cast("binary"), 256)
    out = rows.groupBy("file_name").agg(F.count_distinct("file_path").alias("n_files"), F.count(F.lit(1)).alias("n_entries"), F.count_distinct(key).alias("n_unique"))
    return out.withColumn("n_duplicates", F.col("n_entries") - F.col("n_unique"))


def metadata(docs: DataFrame, unique: DataFrame) -> DataFrame:
    """``file_name, name, task_type, total_samples, cwe_distribution`` of each merged dataset of objects."""
    named = shaped(docs).filter("kind = 'object'").groupBy("file_name").agg(F.min("name").alias("name"), F.min("task_type").alias("task_type"))
    found = unique.filter("kind = 'object'").groupBy("file_name", "cwe").agg(F.count(F.lit(1)).alias("n"))
    pairs = F.array_sort(F.collect_list(F.when(F.col("cwe").isNotNull(), F.struct("cwe", "n"))))
    told = found.groupBy("file_name").agg(F.sum("n").alias("total_samples"), F.map_from_entries(pairs).alias("cwe_distribution"))
    return named.join(told, "file_name", "left").withColumn("total_samples", F.coalesce("total_samples", F.lit(0).cast("long")))


def merge(spark: SparkSession, root: str, out: str, pattern: str = "compare_rankings*") -> DataFrame:
    """Writes the merged entries, a folder of JSON lines a file name in their order, and ``metadata``; the counts."""
    exclude = out.rstrip("/").rsplit("/", 1)[-1] if out.rstrip("/").rsplit("/", 1)[0] == root.rstrip("/") else ""
    docs = documents(spark, root, pattern, exclude)
    check(docs)
    rows = entries(docs)
    unique = merged(rows)
    parts = unique.repartitionByRange("file_name", "file_path", "at").sortWithinPartitions("file_name", "file_path", "at")
    parts.select("file_name", "entry").write.mode("overwrite").partitionBy("file_name").text(f"{out}/entries")
    metadata(docs, unique).write.mode("overwrite").json(f"{out}/metadata")
    return counts(rows)
