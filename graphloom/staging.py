"""Intermediate tables in the shared checkpoint folder: they cut lineage and outlive a lost executor."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []
_tables: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where it is unset and all is one process, as in tests, a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def spread(df: DataFrame, *keys: str | Column) -> DataFrame:
    """Rows dealt by ``keys`` to as many tasks as the session shuffles to, whatever their bytes.

    Groups that Python works on cost time, not bytes: left to itself, adaptive execution merges their small partitions into a task.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


#: Bytes of stored input to a task of :func:`dealt`; rows in memory take ten times as much, or more.
TASK_BYTES = 8 << 20


def estimated_bytes(df: DataFrame) -> int:
    """What the optimizer takes a table for, from the sizes of the files that it reads."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by ``keys`` to tasks that grow in number with the table, so that what one of them sorts does not grow."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(n, min(-(-estimated_bytes(df) // TASK_BYTES), 1 << 15)), *keys)


def materialize(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/graphloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """A table written in buckets by ``keys``, as many as the session shuffles to: a join on just these reads it without an exchange.

    Rows are dealt to the buckets' tasks first, so each bucket is one file.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"graphloom_{name}_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/graphloom/{table}"
    df.repartition(n, *keys).write.bucketBy(n, *keys).sortBy(*keys).option("path", path).saveAsTable(table)
    _written.append((spark, path))
    _tables.append((spark, table))
    return spark.table(table)


@atexit.register
def _clear() -> None:
    for spark, table in _tables:
        try:
            spark.sql(f"drop table if exists {table}")
        except Exception:  # noqa: BLE001  no session left, and no catalog of it
            break
    for spark, path in _written:
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  no session left: the folder is the cluster's to clear
            return
