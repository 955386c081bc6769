"""Line spans: runs of consecutive lines, and the union of overlapping or adjacent spans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.staging import dealt


def islands(lines: DataFrame, keys: list[str], line: str = "line") -> DataFrame:
    """``keys, start_line, end_line`` of each maximal run of consecutive lines; repeated lines count once."""
    w = Window.partitionBy(*keys).orderBy(line)
    runs = lines.select(*keys, line).distinct().withColumn("_run", F.col(line) - F.row_number().over(w))
    return runs.groupBy(*keys, "_run").agg(F.min(line).alias("start_line"), F.max(line).alias("end_line")).drop("_run")


def valid(spans: DataFrame, strict: bool = False) -> DataFrame:
    """Rows with a path and ``1 <= start <= end``; others are dropped, or with ``strict`` an error when they are read."""
    good = (F.trim("file_path") != "") & (F.col("start_line") >= 1) & (F.col("end_line") >= F.col("start_line"))
    good = F.coalesce(good, F.lit(False))
    if strict:
        return spans.withColumn("start_line", F.when(good, F.col("start_line")).otherwise(F.raise_error(F.lit("a span needs a path and 1 <= start <= end")).cast("int")))
    return spans.filter(good)


def merge(spans: DataFrame, keys: list[str], strict: bool = False) -> DataFrame:
    """The fewest spans that cover the same lines: those that overlap or touch become one."""
    w = Window.partitionBy(*keys).orderBy("start_line", "end_line")
    reach = F.max("end_line").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = dealt(valid(spans, strict).select(*keys, "start_line", "end_line"), *keys).withColumn("_new", F.coalesce((F.col("start_line") > reach + 1).cast("int"), F.lit(1)))
    again = Window.partitionBy(*keys).orderBy("start_line", "end_line", F.desc("_new"))  # of equal spans the first opens the group
    rows = rows.withColumn("_group", F.sum("_new").over(again.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "_group").agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line")).drop("_group")
