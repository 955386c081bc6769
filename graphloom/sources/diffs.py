"""Unified diffs to spans of added lines, with windows over the lines of each diff."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.operators import spans
from graphloom.staging import dealt

_HUNK = r"^@@ -[0-9]+(?:,[0-9]+)? \+([0-9]+)(?:,([0-9]+))? @@"


def added_lines(diffs: DataFrame) -> DataFrame:
    """``diff_id, file_path, line`` of every added line of ``diffs (diff_id, diff)``.

    ``+++ b/path`` names the file and any other ``+++`` none; within a hunk, whose header says how many new lines it has, a
    line that starts with ``++`` is an added line and ``\\`` marks nothing.
    """
    # Dealt while a diff is one row: all windows below are within a diff, and need no exchange of its lines.
    rows = dealt(diffs.select("diff_id", "diff"), "diff_id").select("diff_id", F.posexplode(F.split("diff", "\r?\n")).alias("at", "line"))
    upto = Window.partitionBy("diff_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    start = F.when(F.rlike("line", F.lit(_HUNK)), F.struct(F.col("at").alias("at"), F.regexp_extract("line", _HUNK, 1).cast("int").alias("first"), F.coalesce(F.nullif(F.regexp_extract("line", _HUNK, 2), F.lit("")).cast("int"), F.lit(1)).alias("n")))
    rows = rows.withColumn("hunk", F.last(start, ignorenulls=True).over(upto))
    inside = Window.partitionBy("diff_id", "hunk.at").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    # A new line is an added or a kept one; kept lines that are empty may have lost their leading blank.
    new = F.col("hunk").isNotNull() & (F.col("at") > F.col("hunk.at")) & ~F.startswith("line", F.lit("-")) & ~F.startswith("line", F.lit("\\"))
    rows = rows.withColumn("before", F.coalesce(F.sum(new.cast("int")).over(inside), F.lit(0)))
    rows = rows.withColumn("in_hunk", new & (F.col("before") < F.col("hunk.n")))
    header = F.startswith("line", F.lit("+++ ")) & ~F.col("in_hunk")
    named = F.when(header, F.when(F.startswith("line", F.lit("+++ b/")), F.regexp_replace(F.substring("line", 7, 1 << 30), r"\t.*$", "")).otherwise(F.lit("")))
    rows = rows.withColumn("file_path", F.last(named, ignorenulls=True).over(upto))
    added = rows.filter(F.col("in_hunk") & F.startswith("line", F.lit("+")) & (F.col("file_path") != ""))
    return added.select("diff_id", "file_path", (F.col("hunk.first") + F.col("before")).alias("line"))


def changed_spans(diffs: DataFrame) -> DataFrame:
    """``context_id, file_path, start_line, end_line``: runs of added lines, paths relative to the repository's root."""
    runs = spans.islands(added_lines(diffs), ["diff_id", "file_path"])
    return runs.select(F.col("diff_id").alias("context_id"), "file_path", F.col("start_line").cast("int"), F.col("end_line").cast("int"))
