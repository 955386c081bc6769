"""Quality rules: counting rules, then a calibrated logistic regression over hashed word and character n-grams.

The model is fitted on the driver from a bounded sample of labelled rows (``PER_LABEL`` of each label); its weights,
``2**BITS`` floats, travel as a broadcast of fixed size. Every whole text is scored in Arrow batches.

Defined results
---------------
* null text: as the empty text - no words, base rule fails, not kept;
* null ``doc_id``: scored and returned like any other row; repeated rows: one result each;
* no labelled rows, or labels of one kind only: the model abstains (probability 1), the base rule alone decides;
* an empty table gives an empty result; further columns of the input, whatever their names, come back within ``row``.
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

BITS = 15
#: Labelled rows of each label used for fitting: the documented bound of the sample.
PER_LABEL = 1000
#: A document is kept if its calibrated probability of good quality is at least this.
KEEP_AT = 0.5
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"


@dataclass
class Model:
    weights: np.ndarray
    slope: float
    offset: float

    def probability(self, text: str) -> float:
        at, n = common.term_counts(text, BITS)
        v = np.log1p(n)
        z = float(self.weights[at] @ v) / max(float(np.sqrt(v @ v)), 1e-12) + float(self.weights[-1])
        return float(1 / (1 + np.exp(-np.clip(self.slope * z + self.offset, -30, 30))))


def _descend(rows: np.ndarray, idx: np.ndarray, val: np.ndarray, y: np.ndarray, dim: int, l2: float, steps: int) -> np.ndarray:
    """Full-batch logistic regression by accelerated gradient steps; rows have unit length, so 1/4+l2 bounds the curvature."""
    w = np.zeros(dim + 1)
    look, t, share = w.copy(), 1.0, np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    rate = 1 / (0.25 * 2 + l2)
    for _ in range(steps):
        z = np.bincount(rows, look[idx] * val, len(y)) + look[-1]
        g = share * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        grad = np.bincount(idx, g[rows] * val, dim + 1)
        grad[-1] = g.sum()
        new = look - rate * (grad + l2 * look)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return w


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality", per_label: int = PER_LABEL) -> Model | None:
    """Fits on at most ``per_label`` labelled rows of each label; a fifth of them calibrates the probability."""
    known = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_y")).filter("_id is not null and _y in (0, 1)")
    known = known.groupBy("_id").agg(F.min("_y").alias("_y"))
    sample, _ = common.bounded_sample(known, "_y", "_id", per_label)  # at most 2 * per_label rows of two numbers
    texts = common.sampled_texts(documents.select(F.col("doc_id").alias("_id"), F.col("text").alias("_x")), sample, ["_id"])
    rows = common.sparse_rows(texts, "_x", BITS, ["_id", "_y"]).toPandas().sort_values("_id", kind="stable")
    if rows["_y"].nunique() < 2:
        return None
    y = rows["_y"].to_numpy(float)
    lens = np.array([len(a) for a in rows["idx"]])
    at = np.repeat(np.arange(len(rows), dtype=np.int32), lens)
    idx = common.flat(rows["idx"], np.int32)
    val = np.log1p(common.flat(rows["tf"], np.float32))
    del rows
    val /= np.maximum(np.sqrt(np.bincount(at, val * val, len(y))), 1e-12)[at].astype(np.float32)
    dim = 1 << BITS
    held = np.arange(len(y)) % 5 == 4
    if min(y[~held].sum(), (1 - y[~held]).sum(), y[held].sum(), (1 - y[held]).sum()) < 1:
        held[:] = False
    new = (np.cumsum(~held) - 1).astype(np.int32)
    on = ~held[at]
    w = _descend(new[at[on]], idx[on], val[on], y[~held], dim, 1e-4, 150)
    z = np.bincount(at, w[idx] * val, len(y)) + w[-1]
    cal = held if held.any() else ~held
    a, b = _platt(z[cal], y[cal])
    return Model(w, a, b)


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a sigmoid on held-out margins, both classes weighing alike, by damped Newton steps."""
    pos, neg = max(y.sum(), 1), max((1 - y).sum(), 1)
    soft = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    share = np.where(y > 0, 0.5 / pos, 0.5 / neg)
    x, p = np.stack((z, np.ones_like(z))), np.array([1.0, 0.0])
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(p @ x, -30, 30)))
        grad = x @ (share * (q - soft)) + 1e-6 * p
        hess = (x * (share * q * (1 - q))) @ x.T + 1e-4 * np.eye(2)
        p = p - np.clip(np.linalg.solve(hess, grad), -5, 5)
    return float(max(p[0], 1e-3)), float(p[1])


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of one whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()
    word_chars = len(text) - sum(text.count(c) for c in BLANKS)
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    dup_lines = len(lines) - len(set(lines))
    repeated = 0
    if (n := len(words)) > 3:
        seen: dict[bytes, int] = {}
        ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
        if len(seen) < n:
            v = len(seen)
            pairs = ids[:-1] * v + ids[1:]
            if v < 2_000_000:
                windows = pairs[:-1] * v + ids[2:]
            else:
                windows = np.unique(pairs, return_inverse=True)[1][:-1] * v + ids[2:]
            _, inverse, count = np.unique(windows, return_inverse=True, return_counts=True)
            twice = np.flatnonzero(count[inverse] >= 2)
            covered = np.zeros(n, bool)
            for i in range(3):
                covered[twice + i] = True
            repeated = int(covered.sum())
    return n, word_chars, symbols, dup_lines, repeated


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def verdict(spark: SparkSession, model: Model | None):
    """A column function: text -> struct of counts, ``base_failed``, ``p_good`` and ``kept``."""
    shared = spark.sparkContext.broadcast(model)

    @pandas_udf(", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, p_good double, kept boolean")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for texts in batches:
            texts = [t if isinstance(t, str) else "" for t in texts]
            out = pd.DataFrame([base_counts(t) for t in texts], columns=COUNTS, dtype="int64")
            out["base_failed"] = (out.n_words < MIN_WORDS) | (100 * out.n_repeat_words > MAX_REPEAT_PERCENT * out.n_words)
            out["p_good"] = [1.0 if m is None else m.probability(t) for t in texts]
            out["kept"] = ~out.base_failed & (out.p_good >= KEEP_AT)
            yield out

    return judge


def apply_rules(documents: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """``row``, a document with all its columns, and ``rules``, the counts and verdict of its text."""
    spark = documents.sparkSession
    common.prepare(spark)
    return documents.select(common.whole_row(documents).alias("row"), verdict(spark, fit(documents, labels))(F.col(text)).alias("rules"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return apply_rules(docs, labels).select("row.doc_id", "rules.*")
