"""Ranked lexical search: postings are traversed in windows of documents.

1. The terms of the items are few and known first. One Python pass over the whole texts keeps of each document its length and
   the frequencies of those terms (its postings, document by document); lengths and document frequencies of all documents are
   counted from that table.
2. A task turns the postings of ``WINDOW`` documents, in the order of ``doc_id``, term by term. For each item it scatter-adds
   the terms' impacts into one array of ``WINDOW`` sums, small enough for a core's cache, and notes in a bitset which runs of
   ``RUN`` documents were touched. Only these are harvested, into a heap of the item's ``k`` best that the task keeps over all
   of its windows, and only these are cleared.
3. A task's heaps are ``k`` rows an item at most. Two rounds of ranking, first by item and a salt, merge them.

Items go through in slices of ``ITEMS`` items and about ``ITEM_TERMS`` terms, so what a task knows of them is bounded however
many there are. No step brings documents or scores to the driver; the counts that it gets are one for each term of a slice.

Defined results
---------------
* null or empty text, or a text without terms: no document for the statistics, never returned; an item without terms: no rows;
* rows of one ``item_id`` (null is one as well) are one item with the terms of all; each row of ``documents`` is a document of
  its own, repeated rows too; a null ``doc_id`` comes last among equal scores;
* ties go to the smaller ``doc_id``; fewer than ``k`` documents with a score above 0: all of them;
* an empty table on either side gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.window import Window

from graphloom.llm import common, terms

#: Documents in a window: its sums take 128 KB.
WINDOW = 1 << 14
#: Documents that one bit of the occupancy bitset stands for.
RUN = 64
#: Items, and terms of items, that a task knows at a time.
ITEMS = 4096
ITEM_TERMS = 1 << 20


def _weight(n_documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_documents + 2) / (2 * df + 1)))


def item_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """``item_id, name, terms``: an item's distinct terms; ``name`` is the id as text."""

    @pandas_udf("array<binary>")
    def distinct(texts: pd.Series) -> pd.Series:
        return pd.Series([sorted({t for some in terms.split(x) for t in some}) for x in texts], dtype=object)

    rows = items.select(F.col(item_id).alias("item_id"), F.explode(distinct(F.col(text))).alias("term")).distinct()
    rows = rows.groupBy("item_id").agg(F.sort_array(F.collect_list("term")).alias("terms"))
    return rows.select("item_id", F.col("item_id").cast("string").alias("name"), "terms")


def postings(documents: DataFrame, vocabulary: dict[bytes, int], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n, term, tf`` of each row with a term: all its terms with repeats, and those of the vocabulary with their frequencies."""
    known = documents.sparkSession.sparkContext.broadcast(vocabulary)

    @pandas_udf("n long, term array<int>, tf array<int>")
    def count(texts: pd.Series) -> pd.DataFrame:
        out = []
        for x in texts:
            found = terms.numbers(x, known.value)
            term, tf = np.unique(found[found > 0], return_counts=True)
            out.append((len(found), term, tf.astype(np.int32)))
        return pd.DataFrame(out, columns=["n", "term", "tf"])

    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), count(F.col(text)).alias("_c"))
    return rows.select("doc_id", "_c.*").filter("n > 0")


class Scorer:
    """The items of one slice, and their best documents so far."""

    def __init__(self, items: list[tuple[str | None, list[int]]], weights: np.ndarray, n_documents: int, total: int, k: int) -> None:
        self.items, self.weights, self.n_documents, self.total, self.k = items, weights, n_documents, total, k
        self.heaps: list[list[tuple]] = [[] for _ in items]
        self.sums = np.zeros(WINDOW, np.int64)
        self.touched = np.zeros(WINDOW // RUN, bool)

    def _impacts(self, n: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray) -> np.ndarray:
        if int(n.max(initial=0)) * self.n_documents < 1 << 57:
            share = 50 * n * self.n_documents // self.total
        else:
            share = np.array([50 * int(x) * self.n_documents // self.total for x in n], np.int64)
        return self.weights[term] * (1_000_000_000 * tf // (1000 * tf + 20 * (50 + share)[doc]))

    def window(self, ids: list[int | None], n: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray) -> None:
        """Adds a window: its documents' ids and lengths, and their postings in any order."""
        order = np.argsort(term, kind="stable")
        doc, term, tf = doc[order], term[order], tf[order]
        impact = self._impacts(n, doc, term, tf)
        bound = np.searchsorted(term, np.arange(len(self.weights) + 1))
        runs = self.sums.reshape(-1, RUN)
        for heap, (_, wanted) in zip(self.heaps, self.items, strict=True):
            for t in wanted:
                lo, hi = bound[t], bound[t + 1]
                if lo < hi:
                    at = doc[lo:hi]
                    self.sums[at] += impact[lo:hi]  # a document has one posting of a term
                    self.touched[at // RUN] = True
            on = np.flatnonzero(self.touched)
            if len(on):
                self._harvest(heap, ids, on, runs[on])
                runs[on] = 0
                self.touched[on] = False

    def _harvest(self, heap: list[tuple], ids: list[int | None], on: np.ndarray, sums: np.ndarray) -> None:
        least = heap[0][0] if len(heap) == self.k else 1
        run, place = np.nonzero(sums >= least)
        score, at = sums[run, place], on[run] * RUN + place
        if len(at) > self.k:  # documents are in the order of their ids, so a stable sort breaks ties
            best = np.argsort(-score, kind="stable")[: self.k]
            score, at = score[best], at[best]
        for s, d in zip(score.tolist(), at.tolist(), strict=True):
            entry = (s, -math.inf if ids[d] is None else -ids[d])
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)

    def best(self) -> Iterator[tuple[str | None, int | None, int]]:
        for heap, (name, _) in zip(self.heaps, self.items, strict=True):
            for s, d in heap:
                yield name, None if d == -math.inf else -d, s


def _in_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    waiting, rows = [], 0

    def cut() -> tuple:
        ids = [d for b in waiting for d in b.column("doc_id").to_pylist()]
        n = np.concatenate([b.column("n").to_numpy() for b in waiting])
        size = np.concatenate([np.diff(b.column("term").offsets.to_numpy()) for b in waiting])
        term, tf = (np.concatenate([b.column(c).flatten().to_numpy() for b in waiting]) for c in ("term", "tf"))
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
        slot = np.empty(len(ids), np.int64)
        slot[order] = np.arange(len(ids))
        return [ids[i] for i in order], n[order], np.repeat(slot, size), term.astype(np.int64), tf.astype(np.int64)

    for batch in batches:
        for at in range(0, batch.num_rows, WINDOW):
            part = batch.slice(at, WINDOW)
            if rows + part.num_rows > WINDOW:
                yield cut()
                waiting, rows = [], 0
            waiting.append(part)
            rows += part.num_rows
    if waiting:
        yield cut()


def _slice(documents: DataFrame, items: list, k: int, doc_id: str, text: str) -> DataFrame:
    """``name, doc_id, score``: the best of each task for the items of a slice."""
    vocabulary = {t: i for i, t in enumerate(sorted({bytes(t) for r in items for t in r["terms"]}), 1)}
    rows = common.stage(postings(documents, vocabulary, doc_id, text), "postings")
    n_documents, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    weights = np.zeros(len(vocabulary) + 1, np.int64)
    for r in rows.select(F.explode("term").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect():
        weights[r["term"]] = _weight(n_documents, r["df"])
    known = [(r["name"], [vocabulary[bytes(t)] for t in r["terms"]]) for r in items]
    given = documents.sparkSession.sparkContext.broadcast((known, weights))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*given.value, n_documents, total, k)
        for window in _in_windows(batches):
            scorer.window(*window)
        found = list(scorer.best())
        columns = [pa.array([x[i] for x in found], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["name", "doc_id", "score"])

    return rows.filter("size(term) > 0").mapInArrow(score, "name string, doc_id long, score long")


def rank(items: DataFrame, documents: DataFrame, k: int = 50, item_id: str = "item_id", item_text: str = "text", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: for each item its ``k`` best documents."""
    spark = documents.sparkSession
    common.prepare(spark)
    asked = common.stage(item_terms(items, item_id, item_text), "items")
    n, size = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    kind = asked.schema["item_id"].dataType
    slices = max(math.ceil(n / ITEMS), math.ceil(size / ITEM_TERMS))
    number = F.pmod(F.xxhash64("name", F.lit("slice")), F.lit(max(1, slices)))
    found = spark.createDataFrame([], "name string, doc_id long, score long")
    for i in range(slices):
        some = asked.filter(number == i).select("name", "terms").collect()
        found = found.union(common.stage(_slice(documents, some, k, doc_id, text), "best"))
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    salt = F.pmod(F.xxhash64("doc_id", "score"), F.lit(64))
    part = found.withColumn("_salt", salt).withColumn("_at", F.row_number().over(Window.partitionBy("name", "_salt").orderBy(*order))).filter(F.col("_at") <= k)
    ranked = part.withColumn("rank", F.row_number().over(Window.partitionBy("name").orderBy(*order))).filter(F.col("rank") <= k)
    return ranked.select(F.col("name").cast(kind).alias("item_id"), "rank", "doc_id", "score")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return rank(spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"), documents)


ORACLE = r"""
with words as (
    select row_number() over () as row, doc_id,
        regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms
    from documents),
docs as (select row, doc_id, terms, len(terms) as n from words where len(terms) > 0),
stats as (select count(*) as n_docs, sum(n)::bigint as total from docs),
wanted as (
    select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
    from benchmark),
tf as (
    select row, term, count(*) as tf from (select row, unnest(terms) as term from docs)
    where term in (select term from wanted) group by row, term),
df as (select term, count(*) as df from tf group by term),
scored as (
    select item_id, tf.row, sum(floor(1000 * ln((2 * n_docs + 2)::double / (2 * df + 1)))::bigint * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * n_docs) // total)))))::bigint as score
    from wanted join df using (term) join tf using (term) join docs on docs.row = tf.row cross join stats
    group by item_id, tf.row),
ranked as (
    select item_id, row_number() over (partition by item_id order by score desc, doc_id asc nulls last)::int as rank, doc_id, score
    from scored join docs using (row) where score > 0)
select item_id, rank, doc_id, score from ranked where rank <= 50
"""
