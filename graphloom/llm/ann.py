"""Approximate nearest neighbours with a robust-pruned directed graph in each shard.

Equal vectors form one point that remembers its ``k + 1`` least ids (enough for exact ties), so a vector with a third of all
rows is one node. Points are dealt to shards of about ``SHARD`` by a hash; each shard builds its graph in one task: points
are inserted in batches, a greedy beam search over the graph so far proposes neighbours, and robust pruning keeps an edge
only if no kept neighbour is closer to its end by the factor ``ALPHA``. Queries meet every shard: a shard goes to its task once,
in front of all blocks of queries, which stream past it. A beam search finds candidates there, and the cosines of all of them are then computed on the original vectors. Distances are in double
precision throughout: in single precision, points within 1e-4 of each other cannot be told apart.

Defined results
---------------
* vectors that are null, empty, zero, or hold a null or non-finite component, and rows with a null id, take no part;
* vectors of different lengths are never compared; repeated rows count once, and an id with several vectors has the least of
  them, compared component by component, as query and as candidate; an id is never its own neighbour;
* ties go to the smaller ``vec_id``; fewer candidates than ``k``: all of them; an empty table gives an empty result;
* other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.llm import common

SHARD = 4096
DEGREE = 32
ALPHA = 1.2
BUILD_BEAM = 64
SEARCH_BEAM = 160
BATCH = 256
#: Points at which every search of a shard starts: a dense group of near-equal vectors keeps its edges to itself, so one
#: start inside of it would see nothing else.
STARTS = 64
#: Longest vectors that are handled BATCH at a time; of longer ones, so many fewer that a batch's copies stay as large.
BATCH_DIM = 64
#: Queries in a block.
QUERIES = 256


# ---------------------------------------------------------------- the graph, in numpy

def _merge(ids: np.ndarray, dist: np.ndarray, done: np.ndarray, new: np.ndarray, new_dist: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, dist = np.concatenate((ids, new), 1), np.concatenate((dist, new_dist), 1)
    done = np.concatenate((done, np.zeros(new.shape, bool)), 1)
    order = np.argsort(dist, axis=1, kind="stable")[:, :width]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1), np.take_along_axis(done, order, 1)


def beam_search(x: np.ndarray, graph: np.ndarray, start: np.ndarray, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``q`` up to ``width`` near points, nearest first, as ids (-1: none) and distances; all rows at once."""
    b, rows = len(q), np.arange(len(q))
    ids = np.full((b, width), -1, np.int32)
    dist = np.full((b, width), np.inf)
    k = min(width, len(start))
    ids[:, :k] = start[:k]
    dist[:, :k] = 2 - 2 * q @ x[start[:k]].T
    order = np.argsort(dist, axis=1, kind="stable")
    ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
    done = ids < 0
    while True:
        at = np.argmin(done, axis=1)
        live = ~done[rows, at]
        if not live.any():
            return ids, dist
        on = rows[live]
        done[on, at[live]] = True
        near = graph[ids[on, at[live]]]
        d = 2 - 2 * np.einsum("brd,bd->br", x[near], q[on])
        known = (near[:, :, None] == ids[on][:, None, :]).any(2)
        d[known | (near < 0)] = np.inf
        ids[on], dist[on], done[on] = _merge(ids[on], dist[on], done[on], np.where(np.isinf(d), -1, near), d, width)
        done |= ids < 0


def _batch(x: np.ndarray) -> int:
    return max(8, min(BATCH, BATCH * BATCH_DIM // x.shape[1]))


def robust_prune(x: np.ndarray, points: np.ndarray, cand: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each point at most ``degree`` diverse neighbours out of its candidates (-1: none), all points at once."""
    d = np.maximum(2 - 2 * np.einsum("bcd,bd->bc", x[cand], x[points]), 0)
    d[(cand < 0) | (cand == points[:, None])] = np.inf
    order = np.argsort(d, axis=1, kind="stable")
    cand, d = np.take_along_axis(cand, order, 1), np.take_along_axis(d, order, 1)
    alive = np.isfinite(d)
    alive[:, 1:] &= cand[:, 1:] != cand[:, :-1]  # one distance, one id: repeats stand side by side but for ties, which do no harm
    out = np.full((len(points), degree), -1, np.int32)
    vectors, rows = x[cand], np.arange(len(points))
    for r in range(degree):
        pick = np.argmax(alive, axis=1)
        has = alive[rows, pick]
        if not has.any():
            break
        out[has, r] = cand[rows, pick][has]
        to = np.maximum(2 - 2 * np.einsum("bcd,bd->bc", vectors, vectors[rows, pick]), 0)
        alive &= ~(alpha * alpha * to <= d)  # squared distances
        alive &= cand != cand[rows, pick][:, None]
    return out


def build(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The graph of unit vectors ``x`` (a row of neighbours each) and where searches start."""
    n, rng = len(x), np.random.default_rng(seed)
    graph = np.full((n, degree), -1, np.int32)
    medoid = int(np.argmax(x @ x.mean(0)))
    start = np.array([medoid], np.int32)
    order = rng.permutation(n).astype(np.int32)
    order = np.concatenate((start, order[order != medoid]))
    start = order[:STARTS].copy()
    at, size = 0, 1
    while at < n:  # batches double until they are whole, so that early points see most of their predecessors
        points = order[at : at + size]
        found, _ = beam_search(x, graph, start, x[points], beam)
        graph[points] = robust_prune(x, points, found, degree, alpha)
        _reverse(x, graph, points, degree, alpha)
        at, size = at + len(points), min(_batch(x), max(1, at + len(points)))
    for at in range(0, n, _batch(x)):  # a second look at every point, now over the whole graph
        points = order[at : at + _batch(x)]
        found, _ = beam_search(x, graph, start, x[points], beam)
        graph[points] = robust_prune(x, points, np.concatenate((found, graph[points]), 1), degree, alpha)
        _reverse(x, graph, points, degree, alpha)
    return _attach(x, graph, start, beam), start


def _attach(x: np.ndarray, graph: np.ndarray, start: np.ndarray, beam: int) -> np.ndarray:
    """Gives each point that no search can reach an edge from the nearest point that one does, in added columns."""
    while True:
        seen = np.zeros(len(x), bool)
        seen[start] = True
        front = start
        while len(front):
            front = np.unique(graph[front])
            front = front[(front >= 0)]
            front = front[~seen[front]]
            seen[front] = True
        lost = np.flatnonzero(~seen).astype(np.int32)
        if not len(lost):
            return graph
        lost = lost[: _batch(x)]
        found, _ = beam_search(x, graph, start, x[lost], beam)
        source = found[:, 0]
        rank = np.zeros(len(lost), np.int64)
        order = np.argsort(source, kind="stable")
        first = np.searchsorted(source[order], source[order])
        rank[order] = np.arange(len(lost)) - first
        wide = int(rank.max()) + 1
        graph = np.concatenate((graph, np.full((len(x), wide), -1, np.int32)), 1)
        graph[source, graph.shape[1] - wide + rank] = lost


def _reverse(x: np.ndarray, graph: np.ndarray, points: np.ndarray, degree: int, alpha: float) -> None:
    """Adds the edges back to ``points``; a node with too many is pruned."""
    to, back = graph[points].ravel(), np.repeat(points, degree)
    keep = to >= 0
    to, back = to[keep], back[keep]
    order = np.argsort(to, kind="stable")
    to, back = to[order], back[order]
    nodes, first, count = np.unique(to, return_index=True, return_counts=True)
    step = _batch(x)
    for lo in range(0, len(nodes), step):
        some, most = nodes[lo : lo + step], int(count[lo : lo + step].max(initial=0))
        cand = np.full((len(some), degree + most), -1, np.int32)
        cand[:, :degree] = graph[some]
        for i, (f, c) in enumerate(zip(first[lo : lo + step], count[lo : lo + step], strict=True)):
            new = back[f : f + c]
            new = new[~np.isin(new, cand[i, :degree])]
            cand[i, degree : degree + len(new)] = new
        full = (cand >= 0).sum(1) > degree
        if full.any():
            graph[some[full]] = robust_prune(x, some[full], cand[full], degree, alpha)
        for i in np.flatnonzero(~full):
            own = cand[i][cand[i] >= 0]
            graph[some[i], : len(own)] = own


# ---------------------------------------------------------------- Spark

def _valid(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    rows = rows.filter("id is not null and v is not null and size(v) > 0").filter(finite).filter(F.exists("v", lambda c: c != 0))
    return rows.groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(1, keepdims=True)  # neither overflow nor underflow of the squares
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _build_shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The graphs of one task's shards; a task has one shard, for each length of vectors."""
    rows = pd.concat([pd.DataFrame(columns=["dim", "shard"]), *batches])
    for _, part in rows.groupby(["dim", "shard"]):
        yield _build_shard(part.sort_values("id", kind="stable"))


def _build_shard(part: pd.DataFrame) -> pd.DataFrame:
    v = np.array(part["v"].to_list(), np.float64)
    graph, start = build(_unit(v))
    ids = part["ids"].to_list()
    return pd.DataFrame(
        {"dim": part["dim"].iloc[:1].to_list(), "shard": part["shard"].iloc[:1].to_list(), "n": [len(v)], "vectors": [v.tobytes()], "graph": [graph.tobytes()], "start": [start.tobytes()],
         "ids": [np.concatenate(ids).astype(np.int64).tobytes()], "n_ids": [np.array([len(i) for i in ids], np.int64).tobytes()]}
    )


_INDEX = "dim int, shard int, n int, vectors binary, graph binary, start binary, ids binary, n_ids binary"


class Shard:
    """One shard in a task, ready to be searched."""

    def __init__(self, row) -> None:
        n = int(row.n)  # beside rows of queries, which have none, a double
        self.v = np.frombuffer(row.vectors, np.float64).reshape(n, row.dim)
        self.x = _unit(self.v)
        self.graph, self.start = np.frombuffer(row.graph, np.int32).reshape(n, -1), np.frombuffer(row.start, np.int32)
        self.ids = np.split(np.frombuffer(row.ids, np.int64), np.cumsum(np.frombuffer(row.n_ids, np.int64))[:-1])

    def nearest(self, qid, q: np.ndarray, k: int) -> pd.DataFrame:
        """The ``k`` nearest points for each query of a block."""
        unit = _unit(q)
        found, _ = beam_search(self.x, self.graph, self.start, unit, SEARCH_BEAM)
        out = []
        for query, own, u, near in zip(qid, q, unit, found, strict=True):
            near = near[near >= 0]
            exact = np.clip((self.x[near] * u).sum(1), -1, 1)
            exact[(self.v[near] == own).all(1)] = 1.0
            hits = [(-s, int(i)) for s, p in zip(exact, near, strict=True) for i in self.ids[p] if i != query]
            out += [(int(query), i, -s) for s, i in sorted(hits)[:k]]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])


def index(vectors: DataFrame, k: int, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """One row a shard: its points, their ids and the graph. A staged table."""
    rows = _valid(vectors, vec_id, embedding)
    least = rows.withColumn("_rn", F.row_number().over(Window.partitionBy("v").orderBy("id"))).filter(F.col("_rn") <= k + 1)
    points = least.groupBy("v", "dim").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("id", F.col("ids")[0])
    points = common.stage(points, "points")
    shards = max(1, math.ceil(points.count() / SHARD))
    dealt = points.withColumn("shard", F.pmod(F.xxhash64("id", F.lit("shard")), F.lit(shards)).cast("int"))
    # Shards are small in bytes and costly to build, so each is a partition of its own, which adaptive execution keeps.
    return common.stage(dealt.repartitionById(shards, F.col("shard")).mapInPandas(_build_shards, _INDEX), "index")


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row of ``queries`` its ``k`` nearest rows of ``vectors`` but itself."""
    spark = vectors.sparkSession
    common.prepare(spark)
    graph = index(vectors, k, vec_id, embedding)
    asked = common.stage(_valid(queries, vec_id, embedding), "queries")
    blocks = max(1, math.ceil(asked.count() / QUERIES))
    packed = asked.withColumn("block", F.pmod(F.xxhash64("id", F.lit("block")), F.lit(blocks)))
    packed = packed.groupBy("dim", "block").agg(F.collect_list("id").alias("qid"), F.flatten(F.collect_list("v")).alias("q"))
    # A row of each shard and, behind it, one of each block of its vectors' length; the shards' numbers are few, their bytes are not sent.
    numbers = graph.select("dim", "shard").groupBy("dim").agg(F.collect_list("shard").alias("_s"))
    met = packed.join(numbers, "dim").withColumn("shard", F.explode("_s")).drop("_s")
    both = graph.withColumn("block", F.lit(-1).cast("long")).unionByName(met, allowMissingColumns=True)
    shards = max(1, graph.count())
    both = both.repartition(shards, "dim", "shard").sortWithinPartitions("dim", "shard", "block")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard = None
        for batch in batches:
            for row in batch.itertuples(index=False):
                if row.block < 0:
                    shard = Shard(row)
                else:
                    yield shard.nearest(row.qid, np.array(list(row.q), np.float64).reshape(-1, row.dim), k)

    hits = common.stage(both.mapInPandas(search, "query_id long, vec_id long, score double"), "hits")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(vectors.filter("vec_id % 50 = 0"), vectors)
