"""A stream of findings joined with the static graph: each micro-batch is attached as it comes, without state."""

from __future__ import annotations

from pyspark.sql import DataFrame



def attach_stream(stream: DataFrame, nodes: DataFrame) -> DataFrame:
    """REPORTS edges of a streaming ``findings`` table; repeats across batches are the sink's to drop."""
    f = stream.selectExpr("id as src", "file", "line_number")
    n = nodes.selectExpr("identifier as dst", "file_path", "line_start", "line_end")
    return f.join(n, (f["file"] == n["file_path"]) & f["line_number"].between(n["line_start"], n["line_end"])).select("src", "dst")


