"""Centroid clustering with group bounds: exact Lloyd rounds that compute few distances.

The centroids are put into ``groups`` groups once, by a small clustering of the starting centroids. A vector remembers its
cluster, an upper bound of the distance to it, and for each group a lower bound of the distance to any other centroid of that
group. When centroids have moved, the bounds are widened by how far they went. A vector whose upper bound is below all lower
bounds keeps its cluster unseen (after one exact distance, where the bound alone is too loose); otherwise only groups whose
lower bound fails are looked at, and their centroids are scanned exactly.

Components are integers and distances exact, as 64-bit integers where they fit and as Python's own beyond; bounds are rounded
away from the truth, and a filter needs a strict inequality, so ties are always decided exactly, for the smaller centroid.

A round is one pass: each task writes its vectors with the new bounds and, as rows of the same table, sums and counts of its
clusters. The sums are added up by Spark; the driver sees ``k`` centroids, whose size is checked. Nothing is
shuffled but those sums, so no cluster's size matters.

Defined results
---------------
* vectors that are null, of another length than ``dims``, or hold a null or non-finite component take no part;
* each row is a vector of its own: repeated rows count as often as they occur and may start as several centroids; a null id has
  no hash, so it starts none; equal hashes go by the vector;
* fewer vectors than ``k``: as many centroids as vectors that can start one; none: all results are empty;
* a squared distance or an inertia that 64 bits cannot hold is null; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import common

#: Numbers that all centroids may hold together.
CENTROID_NUMBERS = 1 << 24
#: Components up to this size are handled as 64-bit integers.
SMALL = 1 << 24
#: Vectors handled at a time, times centroids.
CELLS = 1 << 16

_STATE = "sums boolean, id string, x array<double>, cluster int, upper double, lower array<double>, n long, total array<string>"


def whole(x: np.ndarray) -> np.ndarray:
    """Doubles that hold integers, exactly: 64-bit where small, else Python's integers."""
    return x.astype(np.int64) if np.abs(x).max(initial=0) <= SMALL else np.array([[int(v) for v in row] for row in x], object).reshape(x.shape)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row of ``x`` to each row of ``c``."""
    if x.dtype == object or c.dtype == object:
        x, c = x.astype(object), c.astype(object)
        return np.stack([((x - one) ** 2).sum(1) for one in c], 1)
    if x.shape[1] * (int(np.abs(x).max(initial=0)) + int(np.abs(c).max(initial=0))) ** 2 < 1 << 53:
        xf, cf = x.astype(np.float64), c.astype(np.float64)  # every sum below is an integer that a double holds
        return ((xf * xf).sum(1)[:, None] - 2 * (xf @ cf.T) + (cf * cf).sum(1)).astype(np.int64)
    return np.stack([((x - one) ** 2).sum(1) for one in c], 1)


_UP, _DOWN = 1 + 1e-12, 1 - 1e-12


def _root(d: np.ndarray, factor: float) -> np.ndarray:
    return np.sqrt(d.astype(np.float64)) * factor


def group_centroids(centroids: list[list[int]], groups: int, rounds: int = 5) -> np.ndarray:
    """The group of each centroid, by a few rounds over the centroids alone."""
    c = np.array(centroids, np.float64)
    scale = np.abs(c).max(initial=0) or 1.0
    c = c / scale
    heads = c[:: max(1, len(c) // groups)][:groups].copy()
    own = np.zeros(len(c), np.int64)
    for _ in range(rounds):
        own = (((c[:, None] - heads[None]) ** 2).sum(2)).argmin(1)
        for g in range(len(heads)):
            if (own == g).any():
                heads[g] = c[own == g].mean(0)
    return np.unique(own, return_inverse=True)[1]


class Round:
    """One assignment: the centroids, how far each has moved since the last one, and the groups."""

    def __init__(self, centroids: list[list[int]], before: list[list[int]] | None, group: np.ndarray) -> None:
        self.exact = np.array(centroids, object)
        self.c = self.exact.astype(np.int64) if max(abs(v) for row in centroids for v in row) <= SMALL else self.exact
        self.group, self.groups = group, int(group.max()) + 1
        moved = np.zeros(len(centroids))
        if before is not None:
            moved = np.array([math.sqrt(sum((a - b) ** 2 for a, b in zip(x, y, strict=True))) * _UP for x, y in zip(centroids, before, strict=True)])
        self.moved = moved
        self.most = np.array([moved[group == g].max() for g in range(self.groups)])

    def first(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Cluster, upper and lower bounds of vectors never seen, by a full scan, and how many distances that took."""
        d = distances(x, self.c)
        own = d.argmin(1)
        root = _root(d, _DOWN)
        rows = np.arange(len(x))
        upper = _root(d[rows, own], _UP)
        root[rows, own] = np.inf
        lower = np.stack([root[:, self.group == g].min(1) for g in range(self.groups)], 1)
        return own, upper, lower, d.size

    def again(self, x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """The same for vectors with bounds of the round before."""
        own, upper = own.copy(), (upper + self.moved[own]) * _UP
        lower = (lower - self.most) * np.where(lower > self.most, _DOWN, _UP)
        work = 0
        open_ = np.flatnonzero(upper >= lower.min(1))  # global filter
        if len(open_):
            near = self._own(x[open_], own[open_])
            work += len(open_)
            upper[open_] = _root(near, _UP)
            still = upper[open_] >= lower[open_].min(1)
            open_, near = open_[still], near[still]
        if not len(open_):
            return own, upper, lower, work
        old, old_near = own[open_].copy(), near
        best, best_at, best_lower = near.copy(), old.copy(), lower[open_].copy()
        fails = upper[open_][:, None] >= lower[open_]  # group filter
        others: list[tuple[int, np.ndarray, np.ndarray]] = []
        for g in range(self.groups):
            rows, members = np.flatnonzero(fails[:, g]), np.flatnonzero(self.group == g)
            if not len(rows):
                continue
            d = distances(x[open_[rows]], self.c[members])
            work += d.size
            others.append((g, rows, d))
            at = d.argmin(1)
            least, number = d[np.arange(len(rows)), at], members[at]
            better = (least < best[rows]) | ((least == best[rows]) & (number < best_at[rows]))
            best[rows[better]], best_at[rows[better]] = least[better], number[better]
        for g, rows, d in others:  # bounds of the groups that were scanned, without what is now the own centroid
            members = np.flatnonzero(self.group == g)
            root = _root(d, _DOWN)
            root[members[None, :] == best_at[rows][:, None]] = np.inf
            best_lower[rows, g] = root.min(1)
        # The former centroid is an other one now; where its group was not scanned, its distance is a bound.
        left = np.flatnonzero(best_at != old)
        g = self.group[old[left]]
        best_lower[left, g] = np.minimum(best_lower[left, g], _root(old_near[left], _DOWN))
        own[open_], upper[open_], lower[open_] = best_at, _root(best, _UP), best_lower
        return own, upper, lower, work

    def _own(self, x: np.ndarray, own: np.ndarray) -> np.ndarray:
        return ((x - self.c[own]) ** 2).sum(1)


def _floor(v: np.ndarray, scale: int) -> np.ndarray:
    """``floor(scale * v)`` for a power of two: exact in doubles, but where the product overflows (such a double is whole)."""
    with np.errstate(over="ignore"):
        x = np.floor(v * scale)
    return x if np.isfinite(x).all() else np.array([[int(a) * scale if abs(a) > 1e15 else math.floor(a * scale) for a in row] for row in v.tolist()], object)


def _vectors(frame: pd.DataFrame) -> np.ndarray:
    return np.stack(frame["x"].to_list()).astype(np.float64)


def _pass(state: DataFrame, now: Round, scale: int, seen: bool) -> DataFrame:
    """One round over all vectors: rows with new bounds, and rows with the sums of each task's clusters."""
    given = state.sparkSession.sparkContext.broadcast(now)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = given.value
        k = len(r.c)
        step = max(256, CELLS // k)
        total, count = np.zeros(r.exact.shape, object), np.zeros(k, np.int64)
        for batch in batches:
            for at in range(0, len(batch), step):
                part = batch.iloc[at : at + step]
                x = _floor(_vectors(part), scale)
                x = x if x.dtype == object else whole(x)
                if seen:
                    own, upper, lower, _ = r.again(x, part["cluster"].to_numpy(np.int64), part["upper"].to_numpy(np.float64), np.stack(part["lower"].to_list()))
                else:
                    own, upper, lower, _ = r.first(x)
                for c in np.unique(own):
                    total[c] += x[own == c].sum(0).astype(object)
                count += np.bincount(own, minlength=k)
                yield part[["id", "x"]].assign(sums=False, cluster=own, upper=upper, lower=list(lower), n=None, total=None)[_COLUMNS]
        some = np.flatnonzero(count)
        if not len(some):
            return
        empty = [None] * len(some)
        yield pd.DataFrame({"sums": True, "id": empty, "x": empty, "cluster": some, "upper": empty, "lower": empty, "n": count[some], "total": [[str(v) for v in total[c]] for c in some]})[_COLUMNS]

    return state.mapInPandas(assign, _STATE)


_COLUMNS = [c.split()[0] for c in _STATE.split(", ")]


def _summed(sums: DataFrame, spark: SparkSession) -> dict[int, tuple[int, list[int]]]:
    each = sums.select("cluster", "n", F.posexplode("total").alias("at", "v"))
    added = each.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).cast("string").alias("v"))
    if sums.filter(F.exists("total", lambda v: F.length(v) > 28)).isEmpty():
        rows = added.collect()
        found: dict[int, tuple[int, dict[int, int]]] = {}
        for r in rows:
            found.setdefault(r["cluster"], (r["n"], {}))[1][r["at"]] = int(r["v"])
    else:  # numbers beyond decimals: added as Python's integers, a row for each task and cluster
        found = {}
        for r in sums.select("cluster", "n", "total").toLocalIterator():
            n, total = found.get(r["cluster"], (0, {}))
            found[r["cluster"]] = n + r["n"], {i: total.get(i, 0) + int(v) for i, v in enumerate(r["total"])}
    return {c: (n, [total[i] for i in range(len(total))]) for c, (n, total) in found.items()}


def cluster(
    vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3, groups: int | None = None, vec_id: str = "vec_id", embedding: str = "embedding"
) -> tuple[DataFrame, list[list[int]]]:
    """``id, x, cluster`` of each vector, and the final centroids. ``groups`` is a fourth of ``k`` where it isn't given."""
    spark = vectors.sparkSession
    common.prepare(spark)
    if k * dims > CENTROID_NUMBERS:
        raise ValueError(f"{k} centroids of {dims} components are more than every task can hold")
    # Ids stay text within the rounds: a null beside them would turn numbers into doubles.
    kept = vectors.select(F.col(vec_id).cast("string").alias("id"), F.col(embedding).cast("array<double>").alias("x"))
    kept = kept.filter(F.size("x") == dims).filter(F.forall("x", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))))
    hashed = kept.filter("id is not null").select(F.sha2(F.concat(F.lit(f"{seed}:"), "id").cast("binary"), 256).alias("h"), "x")
    start = [_floor(np.array([r["x"]], np.float64), scale)[0].tolist() for r in hashed.orderBy("h", "x").limit(k).collect()]
    centroids = [[int(v) for v in row] for row in start]
    if not centroids:
        return kept.limit(0).withColumn("cluster", F.lit(0)), []
    group = group_centroids(centroids, min(len(centroids), groups or max(1, len(centroids) // 4)))
    before, state, table = None, kept, None
    for k_round in range(rounds + 1):
        old, table = table, common.stage(_pass(state, Round(centroids, before, group), scale, before is not None), "round")
        if old is not None:
            common.release(old)  # two rounds are on disk at most
        state = table.filter("not sums")
        if k_round < rounds:
            before, centroids = centroids, list(centroids)
            for c, (n, total) in _summed(table.filter("sums"), spark).items():  # no vector's components are read for these
                centroids[c] = [v // n for v in total]
    return state.select("id", "x", "cluster"), centroids


def measured(clustered: DataFrame, centroids: list[list[int]], scale: int = 1024) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256``."""
    spark = clustered.sparkSession
    given = spark.sparkContext.broadcast(np.array(centroids, object))
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]

    @F.pandas_udf("string")
    def distance(x: pd.Series, own: pd.Series) -> pd.Series:
        v, c = _floor(np.stack(x.to_list()).astype(np.float64), scale).astype(object), given.value
        v = np.vectorize(int, otypes=[object])(v)
        return pd.Series([str(d) for d in ((v - c[own.to_numpy()]) ** 2).sum(1)])

    long = lambda name: F.expr(f"try_cast({name} as bigint)")
    rows = common.stage(clustered.select("id", "cluster", distance("x", "cluster").alias("d")), "distances")
    # Beyond decimals a sum is null, as is a distance beyond a long.
    sums = rows.groupBy("cluster").agg(F.try_sum(F.expr("try_cast(d as decimal(38,0))")).alias("s"), F.count_if(F.expr("try_cast(d as decimal(38,0)) is null")).alias("lost")).collect()
    own = {r["cluster"]: None if r["lost"] or r["s"] is None else int(r["s"]) for r in sums}
    total = None if any(v is None for v in own.values()) else sum(own.values())
    fits = lambda v: v if v is not None and v < 1 << 63 else None
    known = spark.createDataFrame([(c, fits(own.get(c, 0)), fits(total), digest[c]) for c in range(len(centroids))], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = rows.join(F.broadcast(known), "cluster")  # k rows
    return out.select(F.col("id").cast("long").alias("vec_id"), "cluster", long("d").alias("distance"), "cluster_inertia", "inertia", "centroid_sha256")


def op13_yinyang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measured(*cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")))


def oracle(k: int = 8, rounds: int = 10, dims: int = 64) -> str:
    """Plain rounds: every vector against every centroid."""
    square = "list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint"
    steps = []
    for r in range(rounds + 1):
        steps.append(f"a{r} as materialized (select row, min_by(cluster, (d, cluster)) as cluster, min(d) as d from (select v.row, c.cluster, {square} as d from kept v cross join c{r} c) group by row)")
        if r < rounds:
            steps.append(
                f"n{r} as materialized (select cluster, list(s order by pos) as x from (select cluster, pos, floor_div(sum(x[pos])::hugeint, count(*)) as s from a{r} join kept using (row) cross join range(1, {dims + 1}) t(pos) group by cluster, pos) group by cluster), "
                f"c{r + 1} as materialized (select c.cluster, coalesce(n.x, c.x) as x from c{r} c left join n{r} n using (cluster))"
            )
    # Integer division of DuckDB truncates; the components of a centroid need a floor.
    text = ", ".join(steps).replace("floor_div(sum(x[pos])::hugeint, count(*))", "((sum(x[pos])::hugeint - ((sum(x[pos])::hugeint % count(*)) + count(*)) % count(*)) // count(*))::bigint")
    return f"""
with kept as materialized (
    select row_number() over () as row, vec_id, list_transform(embedding, lambda e: floor(1024 * e::double)::bigint) as x from embeddings
    where len(embedding) = {dims} and len(list_filter(embedding, lambda e: e is not null and isfinite(e))) = {dims}),
c0 as materialized (
    select (row_number() over (order by h, x) - 1)::int as cluster, x
    from (select sha256('3:' || vec_id::varchar) as h, x from kept where vec_id is not null order by h, x limit {k})),
{text},
own as (select cluster, sum(d)::bigint as cluster_inertia from a{rounds} group by cluster)
select vec_id, cluster, d::bigint as distance, cluster_inertia, (select sum(d)::bigint from a{rounds}) as inertia,
    sha256(array_to_string(c.x, ',')) as centroid_sha256
from a{rounds} join kept using (row) join own using (cluster) join c{rounds} c using (cluster)
"""
