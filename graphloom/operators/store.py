"""A stored graph into which batches of nodes and edges are merged.

Tables ``nodes``, ``edges`` and ``pending`` are split into buckets by a hash of a node id. A merge rewrites the buckets that its
batch touches, into a folder of its own, and then commits by one small file, the manifest, which names the folder of every
bucket. Readers follow the last manifest, so they see a whole version or none of it; a merge that fails or loses executors leaves
files that nothing names. Two writers of one version cannot both create its manifest: the later one fails and can merge again.

Merging in batches gives the graph of one load. A node's and an edge's properties keep the last value that is not null. An
edge whose ends are not both known waits in ``pending``, in the bucket of an end that is missing, and is tried again when that
node arrives. Values that a batch replaces by different ones are conflicts: reported, or refused.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from graphloom.operators import graph
from graphloom.operators.graph import Graph
from graphloom.staging import TASK_BYTES, estimated_bytes, materialize

TABLES = ("nodes", "edges", "pending")
#: What a row of each is one of.
KEYS = {"nodes": ["identifier"], "edges": ["src", "dst", "type"], "pending": ["missing", "src", "dst", "type"]}


@dataclass(frozen=True)
class Manifest:
    version: int
    buckets: int
    folders: dict[str, dict[int, str]]  # of each table, of each bucket that has rows
    schemas: dict[str, str]
    types: tuple[str, ...]

    def dump(self) -> str:
        return json.dumps({"version": self.version, "buckets": self.buckets, "folders": self.folders, "schemas": self.schemas, "types": self.types})

    @staticmethod
    def parse(text: str) -> Manifest:
        m = json.loads(text)
        return Manifest(m["version"], m["buckets"], {t: {int(b): f for b, f in x.items()} for t, x in m["folders"].items()}, m["schemas"], tuple(m["types"]))


@dataclass(frozen=True)
class Merged:
    version: int
    touched: dict[str, list[int]]  # rewritten buckets of each table
    conflicts: DataFrame  # identifier, property, before, after
    pending: int  # edges that wait


class ConflictError(ValueError):
    """A batch holds other values for nodes that are there; nothing was written."""


class GraphStore:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        if not (last := self.versions()):
            raise FileNotFoundError(f"no graph at {path}; create it first")
        self.manifest = Manifest.parse(self._read(self._manifest_path(last[-1])))

    @classmethod
    def create(cls, spark: SparkSession, path: str, buckets: int = 64) -> GraphStore:
        """An empty store; the number of buckets is fixed, so choose it for the size to come (about 100 MB a bucket)."""
        at = cls.__new__(cls)
        at.spark, at.path = spark, path.rstrip("/")
        at._write(at._manifest_path(0), Manifest(0, buckets, {t: {} for t in TABLES}, {}, ()).dump())
        return cls(spark, path)

    @classmethod
    def exists(cls, spark: SparkSession, path: str) -> bool:
        at = cls.__new__(cls)
        at.spark, at.path = spark, path.rstrip("/")
        return bool(at.versions())

    # -- files of the driver: manifests only
    def _manifest_path(self, version: int) -> str:
        return f"{self.path}/manifests/{version:08d}.json"

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _write(self, path: str, text: str) -> None:
        fs, p = self._fs(path)
        out = fs.create(p, False)  # an error if it is there
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def _read(self, path: str) -> str:
        return "\n".join(r[0] for r in self.spark.read.text(path, wholetext=True).collect())

    def versions(self) -> list[int]:
        fs, p = self._fs(f"{self.path}/manifests")
        return sorted(int(s.getPath().getName()[:8]) for s in fs.listStatus(p) if s.getPath().getName().endswith(".json")) if fs.exists(p) else []

    # -- reading
    def _bucket(self, key: str | Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.manifest.buckets)).cast("int")

    def table(self, name: str, buckets: list[int] | None = None) -> DataFrame | None:
        """A table of the last version, or some of its buckets; none if it has no rows yet. Only their folders are listed."""
        folders = [f"{self.path}/{f}" for b, f in sorted(self.manifest.folders[name].items()) if buckets is None or b in buckets]
        if name not in self.manifest.schemas:
            return None
        schema = StructType.fromJson(json.loads(self.manifest.schemas[name]))
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema).limit(0)  # so that plans know it has none

    def at(self, version: int) -> GraphStore:
        """The store as it was."""
        old = GraphStore.__new__(GraphStore)
        old.spark, old.path, old.manifest = self.spark, self.path, Manifest.parse(self._read(self._manifest_path(version)))
        return old

    def graph(self) -> Graph:
        nodes, edges = self.table("nodes"), self.table("edges")
        if nodes is None:
            raise ValueError("nothing has been merged yet")
        if edges is None:
            edges = self.spark.createDataFrame([], "src string, dst string, type string")
        return Graph(nodes, edges, self.manifest.types)

    # -- merging
    def merge(self, nodes: DataFrame, edges: DataFrame, on_conflict: str = "last") -> Merged:
        """Merges a batch; ``nodes`` have ``identifier`` and ``ord``, ``edges`` ``src, dst, type, ord``. ``on_conflict``: ``last`` or ``error``."""
        if on_conflict not in ("last", "error"):
            raise ValueError("on_conflict is last or error")
        version = self.manifest.version + 1
        fresh = materialize(graph.last_write(nodes, KEYS["nodes"], ["ord"], count="_rows").withColumn("_bucket", self._bucket("identifier")), "batch")
        many = fresh.filter("_rows > 1").select(F.col("identifier").alias("_id"))  # only these can differ within the batch
        inside = _differing(nodes.join(many, F.col("identifier").eqNullSafe(F.col("_id")), "left_semi"), ["ord"])
        fresh = fresh.drop("_rows")
        touched = _buckets(fresh, "_bucket")
        before = self.table("nodes", touched)
        clashes = inside if before is None else inside.unionByName(_replaced(before, fresh))
        clashes = materialize(clashes.distinct(), "conflicts")
        if on_conflict == "error" and (first := clashes.head(1)):
            raise ConflictError(f"{first[0]['identifier']}: {first[0]['property']} is {first[0]['before']} and {first[0]['after']}")

        rows = fresh if before is None else before.withColumns({"_bucket": self._bucket("identifier"), "_turn": F.lit(0)}).unionByName(fresh.withColumn("_turn", F.lit(1)), allowMissingColumns=True)
        if before is not None:
            rows = graph.last_write(self._dealt("nodes", rows, touched, before, fresh), [*_DEALT, *KEYS["nodes"]], ["_turn"]).drop("_turn")
        now = self._put(self.manifest, "nodes", rows, version, touched)

        # Edges of the batch, and those that waited for one of its nodes.
        batch = edges.withColumn("_turn", F.lit(version))
        waiting = self._of(now, "pending", touched)
        if waiting is not None:
            ids = fresh.select(F.col("identifier").alias("missing"))
            batch = waiting.join(ids, "missing", "left_semi").drop("missing").unionByName(batch, allowMissingColumns=True)
            stay = waiting.join(ids, "missing", "left_anti")
        # Dealt before they are grouped, for few come twice: they are sorted once then.
        batch = batch.withColumn("_at", F.struct("_turn", "ord")).repartition(*KEYS["edges"])
        batch = materialize(graph.last_write(batch, KEYS["edges"], ["_at"]).drop("_at"), "edges")
        near = _buckets(batch.select(F.explode(F.array_distinct(F.array(self._bucket("src"), self._bucket("dst")))).alias("_bucket")), "_bucket")
        there = self._of(now, "nodes", near)
        ids = there.select(F.col("identifier").alias("id")) if there is not None else batch.select(F.col("src").alias("id")).limit(0)
        left = batch.join(ids.select(F.col("id").alias("src"), F.lit(True).alias("_s")), "src", "left").join(ids.select(F.col("id").alias("dst"), F.lit(True).alias("_d")), "dst", "left")
        left = materialize(left.withColumn("missing", F.when(F.col("_s").isNull(), F.col("src")).when(F.col("_d").isNull(), F.col("dst"))).drop("_s", "_d"), "tried")

        # Where edges go, and their types: at most as many rows as there are buckets and types.
        whether = F.col("missing").isNull()
        found = left.select(whether.alias("known"), self._bucket(F.coalesce("missing", "src")).alias("bucket"), F.when(whether, F.col("type")).alias("type")).distinct().collect()
        known = left.filter("missing is null").drop("missing").withColumn("_bucket", self._bucket("src"))
        edge_buckets = sorted({r["bucket"] for r in found if r["known"]})
        types = tuple(sorted({*now.types, *(r["type"] for r in found if r["known"])}))  # those of older edges are in the manifest
        old = self._of(now, "edges", edge_buckets)
        if old is not None:
            both = old.withColumns({"_bucket": self._bucket("src"), "_turn": F.lit(0)}).unionByName(known, allowMissingColumns=True)
            known = graph.last_write(self._dealt("edges", both, edge_buckets, old, left), [*_DEALT, *KEYS["edges"]], ["_turn"])
        now = self._put(now, "edges", known.drop("_turn"), version, edge_buckets)

        lost = left.filter("missing is not null")
        if waiting is not None:  # what stays is in touched buckets
            lost = lost.unionByName(stay, allowMissingColumns=True)
        lost = lost.withColumn("_bucket", self._bucket("missing"))
        pending_buckets = sorted({*(r["bucket"] for r in found if not r["known"]), *(b for b in touched if b in now.folders["pending"])})
        untouched = self._of(now, "pending", [b for b in pending_buckets if b not in touched])
        if untouched is not None:  # edges that wait for other nodes of these buckets
            lost = lost.unionByName(untouched.withColumn("_bucket", self._bucket("missing")), allowMissingColumns=True)
        if waiting is not None or untouched is not None:  # else they are the batch's, which has each once
            lost = graph.last_write(self._dealt("pending", lost, pending_buckets, left, waiting, untouched), [*_DEALT, *KEYS["pending"]], ["_turn", "ord"])
        now = self._put(now, "pending", lost, version, pending_buckets)

        now = replace(now, version=version, types=types)
        self._write(self._manifest_path(version), now.dump())
        self.manifest = now
        waits = self.table("pending")
        return Merged(version, {"nodes": touched, "edges": edge_buckets, "pending": pending_buckets}, clashes, 0 if waits is None else waits.count())

    def _of(self, manifest: Manifest, name: str, buckets: list[int]) -> DataFrame | None:
        now = GraphStore.__new__(GraphStore)
        now.spark, now.path, now.manifest = self.spark, self.path, manifest
        return now.table(name, buckets)

    def _dealt(self, name: str, rows: DataFrame, buckets: list[int], *sources: DataFrame | None) -> DataFrame:
        """Rows by bucket, a task each, or as many tasks a bucket as the stored bytes of their ``sources`` ask for: ``_part`` is the task.

        Plans guess the bytes of a join; those of ``rows`` count where no sources are named. What is grouped by ``_DEALT`` and key after it is grouped in place, and written without another exchange.
        """
        n = max(1, len(buckets))
        size = sum(estimated_bytes(s) for s in sources or (rows,) if s is not None)
        parts = max(1, min(-(-size // (n * TASK_BYTES)), (1 << 15) // n))
        place = {b: k for k, b in enumerate(buckets)}
        at = F.get(F.array(*[F.lit(place.get(b, 0)) for b in range(self.manifest.buckets)]), F.col("_bucket"))
        part = at * parts + F.pmod(F.xxhash64(F.lit("part"), *KEYS[name]), F.lit(parts)).cast("int")
        return rows.withColumn("_part", part.cast("int")).repartitionById(n * parts, "_part")

    def _put(self, manifest: Manifest, name: str, rows: DataFrame, version: int, buckets: list[int]) -> Manifest:
        """Writes the new rows of ``buckets``, a folder each; a bucket without rows is named no more."""
        folder = f"{name}/v{version:08d}"
        known = StructType.fromJson(json.loads(manifest.schemas[name])) if name in manifest.schemas else StructType()
        schema = StructType([*known.fields, *[f for f in rows.drop(*_DEALT).schema.fields if f.name not in known.fieldNames()]])
        rows = rows if "_part" in rows.columns else self._dealt(name, rows, buckets)
        full = rows.select(*_DEALT, *[F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])
        order = "identifier" if name == "nodes" else "src"
        # Rows lie by bucket, so that a bucket is one file, or a few where it is large.
        full.sortWithinPartitions(*_DEALT, order).drop("_part").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        fs, p = self._fs(f"{self.path}/{folder}")
        there = {int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(p) if s.getPath().getName().startswith("_bucket=")}
        folders = {b: f for b, f in manifest.folders[name].items() if b not in buckets} | {b: f"{folder}/_bucket={b}" for b in sorted(there)}
        return replace(manifest, folders=manifest.folders | {name: folders}, schemas=manifest.schemas | {name: schema.json()})

    def vacuum(self, keep: int = 2) -> list[str]:
        """Removes manifests but the last ``keep``, and the folders of versions that none of those names; what was removed."""
        versions = self.versions()
        stay = versions[-keep:]
        named = {f.split("/_bucket=")[0] for v in stay for t in Manifest.parse(self._read(self._manifest_path(v))).folders.values() for f in t.values()}
        gone = [self._manifest_path(v) for v in versions if v not in stay]
        for name in TABLES:
            fs, p = self._fs(f"{self.path}/{name}")
            gone += [f"{self.path}/{f}" for s in (fs.listStatus(p) if fs.exists(p) else []) if (f := f"{name}/{s.getPath().getName()}") not in named and int(f.rpartition("v")[2]) <= stay[-1]]
        for path in gone:
            fs, p = self._fs(path)
            fs.delete(p, True)
        return gone


#: By what :meth:`GraphStore._dealt` has dealt.
_DEALT = ("_bucket", "_part")


def _buckets(rows: DataFrame, column: str) -> list[int]:
    return sorted(r[0] for r in rows.select(column).distinct().collect())  # at most as many as there are buckets


def _differing(rows: DataFrame, order: list[str]) -> DataFrame:
    """``identifier, property, before, after``: properties for which a node comes with several values, the first and the last."""
    names = [c for c in rows.columns if c not in ("identifier", "ord", "_old", "_bucket")]
    entries = F.array(*[F.struct(F.lit(c).alias("property"), F.to_json(F.struct(F.col(c).alias("v"))).alias("v"), F.col(c).isNotNull().alias("there")) for c in names])
    each = rows.select("identifier", F.struct(*order).alias("_at"), F.explode(entries).alias("e")).filter("e.there")
    told = each.groupBy("identifier", "e.property").agg(F.min("e.v").alias("_lo"), F.max("e.v").alias("_hi"), F.min_by("e.v", "_at").alias("before"), F.max_by("e.v", "_at").alias("after"))
    plain = lambda c: F.get_json_object(c, "$.v").alias(c)
    return told.filter("_lo <> _hi").select("identifier", "property", plain("before"), plain("after"))


def _replaced(before: DataFrame, fresh: DataFrame) -> DataFrame:
    """:func:`_differing` of two tables that have a node once each: a join of its two rows."""
    types = {f.name: f.dataType for f in before.limit(0).unionByName(fresh.limit(0), allowMissingColumns=True).schema.fields}
    names = [c for c in before.columns if c in fresh.columns and c not in ("identifier", "ord", "_old", "_bucket")]
    told = lambda c: F.when(F.col(c).isNotNull(), F.to_json(F.struct(F.col(c).cast(types[c]).alias("v"))))
    old = before.select(F.col("identifier").alias("_id"), *[told(c).alias(f"_before{k}") for k, c in enumerate(names)])
    new = fresh.select("identifier", *[told(c).alias(f"_after{k}") for k, c in enumerate(names)])
    plain = lambda c: F.get_json_object(c, "$.v")
    each = [F.when(F.col(f"_before{k}") != F.col(f"_after{k}"), F.struct(F.lit(c).alias("property"), plain(f"_before{k}").alias("before"), plain(f"_after{k}").alias("after"))) for k, c in enumerate(names)]
    none = F.array().cast("array<struct<property: string, before: string, after: string>>")
    rows = new.join(old, F.col("identifier").eqNullSafe(F.col("_id")))
    return rows.select("identifier", F.explode(F.array_compact(F.array(*each)) if each else none).alias("_e")).select("identifier", "_e.*")


def open_graph(spark: SparkSession, path: str) -> Graph:
    """The graph of a store, or of a folder that :func:`graphloom.operators.graph.write_graph` wrote."""
    if GraphStore.exists(spark, path):
        return GraphStore(spark, path).graph()
    edges = spark.read.parquet(f"{path}/edges")
    return Graph(spark.read.parquet(f"{path}/nodes"), edges, graph.edge_types(edges))
