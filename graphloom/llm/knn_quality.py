"""Quality by nearest-neighbour voting in a latent-semantic space.

A bounded sample of labelled documents (``PER_LABEL`` of each label) gives a term-document matrix over ``2**BITS`` hashed
terms; a truncated singular value decomposition of it, computed on the driver, gives the projection. The projection and the
projected labelled vectors are broadcast, both of fixed size. Every whole document is projected in Arrow batches, its exact
cosines with all labelled vectors come from blocked matrix products, and the labels of its ``NEIGHBOURS`` nearest vectors
vote, each weighing as its similarity.

Defined results
---------------
* null or empty text, or a text without any known direction: score 0.5 (no neighbour has a positive similarity);
* nothing to learn from: every score is 0.5; labels of one kind only: that label wins every vote;
* null ids count as held out and are never learned from; repeated rows: one result each, and of an id with several texts the
  one with the least hash is learned from; ties between equally near
  vectors go to the one fitted first (ascending doc_id); empty table, empty result; other columns, whatever
  their names, come back within ``row``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from graphloom.llm import common

BITS = 12
RANK = 64
NEIGHBOURS = 15
#: Labelled rows of each label used for fitting: the documented bound of the sample.
PER_LABEL = 1000
GOOD_AT = 0.3
#: Similarities computed at once: documents of a block times labelled vectors.
BLOCK = 256
_EXPONENT = 4


def _terms(text: str, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two blocks of hashed terms: character n-grams in the lower half, words and word pairs in the upper."""
    half = bits - 1
    a, n = common.term_counts(text, half, words=False)
    b, m = common.term_counts(text, half, chars=())
    return np.concatenate((a, b + (1 << half))), np.concatenate((n, m))


def _weights(at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Square roots of counts by rarity; each block has unit length, so that neither drowns the other."""
    v = np.sqrt(n) * idf[at]
    cut = int(np.searchsorted(at, len(idf) // 2))
    for block in (v[:cut], v[cut:]):
        block /= max(float(np.sqrt(block @ block)), 1e-12)
    return v.astype(np.float32)


@dataclass
class Model:
    idf: np.ndarray  # 2**BITS
    basis: np.ndarray  # 2**BITS x RANK
    vectors: np.ndarray  # labelled rows x RANK, unit length
    votes: np.ndarray

    def project(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.basis.shape[1]), np.float32)
        for i, t in enumerate(texts):
            at, n = _terms(t, BITS)
            out[i] = _weights(at, n, self.idf) @ self.basis[at]
        return _unit(out)

    def score(self, texts: list[str]) -> np.ndarray:
        scores = np.full(len(texts), 0.5)
        if not len(self.votes):
            return scores
        k = min(NEIGHBOURS, len(self.votes))
        for at in range(0, len(texts), BLOCK):
            sims = self.project(texts[at : at + BLOCK]) @ self.vectors.T
            top = _nearest(sims, k)
            weight = np.maximum(np.take_along_axis(sims, top, 1), 0).astype(float) ** _EXPONENT
            total = weight.sum(1)
            known = total > 1e-12
            scores[at : at + BLOCK][known] = ((weight * self.votes[top]).sum(1)[known] / total[known]).clip(0, 1)
        return scores


def _nearest(sims: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` most similar of each row; of equally similar ones the first."""
    least = np.partition(sims, sims.shape[1] - k, axis=1)[:, -k, None]
    over, equal = sims > least, sims == least
    take = over | (equal & (np.cumsum(equal, axis=1) <= k - over.sum(1, keepdims=True)))
    return np.nonzero(take)[1].reshape(len(sims), k)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)


def _svd_basis(x: np.ndarray, rank: int) -> np.ndarray:
    """Right singular vectors of the largest singular values, by subspace iteration from a seeded start."""
    rank = min(rank, *x.shape)
    q = np.linalg.qr(x.T @ (x @ np.random.default_rng(7).standard_normal((x.shape[1], min(rank + 16, x.shape[1]))).astype(np.float32)))[0]
    for _ in range(4):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ vt[:rank].T).astype(np.float32)


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality", per_label: int = PER_LABEL) -> Model:
    known = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_y")).filter("_id is not null and _y in (0, 1)")
    known = known.groupBy("_id").agg(F.min("_y").alias("_y"))
    sample, _ = common.bounded_sample(known, "_y", "_id", per_label, "knn")  # at most 2 * per_label rows of two numbers
    texts = common.sampled_texts(documents.select(F.col("doc_id").alias("_id"), F.col("text").alias("_x")), sample, ["_id"])
    rows = common.sparse_rows(texts, "_x", BITS, ["_id", "_y"], _terms).toPandas().sort_values("_id", kind="stable")
    dim = 1 << BITS
    if not len(rows):
        return Model(np.ones(dim), np.zeros((dim, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0))
    seen = np.bincount(common.flat(rows["idx"], np.int64), minlength=dim)
    idf = np.log((1 + len(rows)) / (1 + seen)) + 1
    x = np.zeros((len(rows), dim), np.float32)
    for i, (at, n) in enumerate(zip(rows["idx"], rows["tf"], strict=True)):
        at, n = np.asarray(at, np.int64), np.asarray(n, np.int64)
        x[i, at] = _weights(at, n, idf)
    x = _unit(x)
    basis = _svd_basis(x, RANK)
    return Model(idf, basis, _unit(x @ basis), rows["_y"].to_numpy(float))


def score(documents: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``row``, a document with all its columns, and ``score``: how likely its whole text is of good quality."""
    spark = documents.sparkSession
    common.prepare(spark)
    shared = spark.sparkContext.broadcast(model)

    def vote(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(shared.value.score([t if isinstance(t, str) else "" for t in texts]))

    return documents.select(common.whole_row(documents).alias("row"), pandas_udf(vote, "double")(F.col(text)).alias("score"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(docs, labels.filter(common.fold("doc_id", 5) != 0))
    held = (common.fold("row.doc_id", 5) == 0).alias("held_out")
    return score(docs, model).select("row.doc_id", held, "score", (F.col("score") >= GOOD_AT).cast("int").alias("predicted"))
