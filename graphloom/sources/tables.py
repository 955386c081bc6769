"""Dataset files: delimited text, Parquet, JSON documents, relational databases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import text


def load(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a ``.csv``, ``.tsv`` or ``.parquet`` path; all delimited columns are text. Another suffix is an error."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix in ("csv", "tsv"):
        return spark.read.csv(path, header=True, sep="\t" if suffix == "tsv" else ",", multiLine=True, quote='"', escape='"')
    if suffix == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"{path}: a .csv, .tsv or .parquet is needed")


def relational(spark: SparkSession, url: str, names: tuple[str, ...] = ("fixes", "file_change", "cve", "cwe_classification"), **options: str) -> dict[str, DataFrame]:
    """Tables of a JDBC database."""
    return {n: spark.read.format("jdbc").options(url=url, dbtable=n, **options).load() for n in names}


def source_lines(files: DataFrame) -> DataFrame:
    """``[graph_id,] file_path, line_no, text`` of ``files (file_path, content)``; bytes that are not UTF-8 are replaced."""
    body = text.decoded(files)
    keys = [c for c in ("graph_id", "file_path") if c in files.columns]
    rows = files.select(*keys, F.posexplode(F.split(body, "\r\n|\r|\n")).alias("at", "text"))
    return rows.select(*keys, (F.col("at") + 1).alias("line_no"), "text")
