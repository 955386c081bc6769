"""Language identification: multinomial naive Bayes over hashed character n-grams.

The model is a matrix of log-probabilities, one row for each of ``2**BITS`` hash buckets and one column for each language,
fitted from a bounded sample (``PER_LANG`` documents of each language) and broadcast. Languages go through in blocks of
``BLOCK``, a broadcast each, so a task's memory does not grow with their number; a column of more than ``common.MAX_LABELS``
values is an error. Whole texts are scored in numpy, a slice of the text at a time, so memory does not grow with the longest text.

Defined results
---------------
* null text, or text without a letter (``str.isalpha``): ``und`` with score 0;
* rows without a language are never learned from but are predicted; a language seen only in the held-out fold cannot be
  predicted; with nothing to learn from every text is ``und``;
* null ids and repeated rows: one result a row, and of an id and language with several texts the one with the least hash is
  learned from; an empty table gives an empty result; other columns, whatever
  their names, come back within ``row``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from graphloom.llm import common

BITS = 15
NGRAMS = (1, 2, 3)
#: Documents of each language used for fitting: the documented bound of the sample.
PER_LANG = 1000
#: Code points scored at a time; slices overlap so that no n-gram is lost.
SLICE = 1 << 18
#: Languages of a block: 16 MB of log-probabilities.
BLOCK = 128
#: Added to each count.
SMOOTHING = 0.5
_LETTER = re.compile(r"[^\W\d_]")  # holds all letters, and some numerals that are none


def has_letter(text: str | None) -> bool:
    return any(m.group().isalpha() for m in _LETTER.finditer(text or ""))


def slices(text: str) -> Iterator[np.ndarray]:
    """Hashed n-grams of the whole lower-cased text."""
    text = text.lower()
    for at in range(0, max(len(text), 1), SLICE):
        yield from common.char_ngrams(common.code_points(text[at : at + SLICE + max(NGRAMS) - 1]), NGRAMS, BITS, SLICE)


def _counts(text: str, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return common.counted(slices(text), bits)


@dataclass
class Model:
    langs: list[str]
    log_p: np.ndarray  # buckets x languages
    prior: np.ndarray

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        return [(lang, float(np.exp(top - total))) if lang != "und" or total > -np.inf else ("und", 0.0) for lang, top, total in self.best(texts)]

    def best(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        """The likeliest language, its log-probability, and the logarithm of the sum over all languages of this model."""
        rows = [i for i, t in enumerate(texts) if self.langs and has_letter(t)]
        out: list[tuple[str, float, float]] = [("und", -np.inf, -np.inf)] * len(texts)
        if not rows:
            return out
        logs = np.tile(self.prior, (len(rows), 1))
        parts: list[np.ndarray] = []
        owner: list[int] = []
        held = 0

        def flush() -> None:
            nonlocal held
            full = [(o, p) for o, p in zip(owner, parts, strict=True) if len(p)]
            if full:
                starts = np.concatenate(([0], np.cumsum([len(p) for _, p in full])[:-1]))
                sums = np.add.reduceat(self.log_p[np.concatenate([p for _, p in full])], starts, axis=0, dtype=np.float64)
                np.add.at(logs, [o for o, _ in full], sums)
            parts.clear()
            owner.clear()
            held = 0

        for k, i in enumerate(rows):
            for h in slices(texts[i]):
                parts.append(h)
                owner.append(k)
                held += len(h)
                if held >= SLICE:
                    flush()
        flush()
        best, top = logs.argmax(1), logs.max(1)
        total = top + np.log(np.exp(logs - top[:, None]).sum(1))
        for k, i in enumerate(rows):
            out[i] = (self.langs[best[k]], float(top[k]), float(total[k]))
        return out

    def blocks(self) -> list[Model]:
        """The same languages in models of at most ``BLOCK`` each."""
        return [Model(self.langs[a : a + BLOCK], self.log_p[:, a : a + BLOCK], self.prior[a : a + BLOCK]) for a in range(0, max(1, len(self.langs)), BLOCK)]


def fit(documents: DataFrame, per_lang: int = PER_LANG) -> Model:
    """Fits on at most ``per_lang`` documents of each non-null language; priors are the languages' shares of all documents."""
    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang"), F.col("text").alias("_x")).filter("_lang is not null and _id is not null and _x is not null")
    sample, known = common.bounded_sample(rows.select("_id", "_lang"), "_lang", "_id", per_lang)
    counts = common.sparse_rows(common.sampled_texts(rows, sample, ["_id", "_lang"]), "_x", BITS, ["_lang"], _counts)
    cells = counts.select("_lang", F.explode(F.arrays_zip("idx", "tf")).alias("t")).groupBy("_lang", "t.idx").agg(F.sum("t.tf").alias("n"))
    lists = cells.groupBy("_lang").agg(F.collect_list(F.struct("idx", "n")).alias("t"))  # a cell for each of 2**BITS buckets at most
    lists = common.stage(lists.select("_lang", "t.idx", "t.n"), "cells")
    langs = sorted(r["_lang"] for r in lists.select("_lang").collect())  # MAX_LABELS at most, as the rows below
    log_p = np.empty((1 << BITS, len(langs)), np.float32)
    place = {lang: k for k, lang in enumerate(langs)}
    for r in lists.toLocalIterator():
        column = np.full(1 << BITS, SMOOTHING)
        column[np.asarray(r["idx"], np.int64)] += np.asarray(r["n"], float)
        log_p[:, place[r["_lang"]]] = np.log(column / column.sum())
    share = np.array([known[v] for v in langs], float)
    return Model(langs, log_p, np.log(share / share.sum()))


def predict(documents: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``row``, a document with all its columns, and a struct ``language`` of ``lang_pred`` and ``score``."""
    spark = documents.sparkSession
    common.prepare(spark)
    rows = documents.select(common.whole_row(documents).alias("row"), F.col(text).alias("_x"))
    names = []
    for part in model.blocks():
        names.append(f"_b{len(names)}")
        rows = rows.withColumn(names[-1], _scorer(spark.sparkContext.broadcast(part))("_x"))
    # Over the blocks: the likeliest, the first of equally likely ones, and its share of the sum.
    best = F.lit(None).cast("struct<lang: string, top: double, total: double>")
    for n in names:
        best = F.when(F.coalesce(best["top"] >= F.col(n)["top"], F.lit(False)), best).otherwise(F.col(n))
    rows = rows.select("row", *names, best.alias("_best"))
    total = sum((F.exp(F.col(n)["total"] - F.col("_best")["top"]) for n in names[1:]), F.exp(F.col(names[0])["total"] - F.col("_best")["top"]))
    known = F.col("_best")["lang"] != "und"
    score = F.when(known, F.least(F.lit(1.0), 1 / total)).otherwise(F.lit(0.0))
    return rows.select("row", F.struct(F.col("_best")["lang"].alias("lang_pred"), score.alias("score")).alias("language"))


def _scorer(shared):
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame(shared.value.best([t if isinstance(t, str) else None for t in texts]), columns=["lang", "top", "total"])

    return pandas_udf(score, "lang string, top double, total double")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit(docs.filter(common.fold("doc_id", 3) != 1))
    return predict(docs.select("doc_id", "text"), model).select("row.doc_id", (common.fold("row.doc_id", 3) == 1).alias("held_out"), "language.*")
