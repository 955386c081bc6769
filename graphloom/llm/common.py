"""What the training-data operators share: session preparation, staged tables, bounded samples, text hashing.

Conventions
-----------
* A *word* is a maximal run of characters other than space and ``\\x09-\\x0D``; ``bytes.split()`` splits on exactly those.
* Folds use ``crc32`` of the id written as text; a null id counts as the empty text.
* Intermediate tables go to the folder in ``spark.checkpoint.dir``, which all executors share, so a lost executor costs a
  recomputation of its own tasks and never a missing file. The folder is removed when the driver process ends.
"""

from __future__ import annotations

import atexit
import itertools
import math
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.window import Window

#: Rows in one Arrow batch handed to Python. Texts can be very long, so batches are kept short.
ARROW_ROWS = 256
ARROW_BYTES = 16 << 20
#: Rows of two or three numbers in one staged file.
ROWS_PER_FILE = 250_000
#: A column of more different labels is no set of labels, and an error.
MAX_LABELS = 4096
#: Code points, or bytes of words, hashed at a time.
SLICE = 1 << 18

_staged: list[tuple[SparkSession, str]] = []


def prepare(spark: SparkSession) -> str:
    """Bounds the Arrow batches of documents and returns the shared folder for intermediate tables."""
    for key, most in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = re.fullmatch(r"(\d+)[bB]?", spark.conf.get(key))  # anything else is no limit, or one with a unit
        if not now or not 0 < int(now[1]) <= most:
            spark.conf.set(key, str(most))
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="graphloom-")  # one process, as in tests
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def _drop_staged() -> None:
    for spark, path in _staged:
        try:
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
        except Exception:  # noqa: BLE001  the session may be gone at exit; the folder is then the cluster's to clear
            return


atexit.register(_drop_staged)


def stage(df: DataFrame, name: str, rows: int | None = None, narrow: bool = False) -> DataFrame:
    """Writes a table to the shared folder and reads it back: cuts lineage and computes costly rows once.

    A ``narrow`` table, of a few numbers a row, is written by two tasks a core at most, so that many shuffle partitions do
    not become as many tiny files. Where its number of ``rows`` is known beforehand, that sets the tasks.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(4, math.ceil(rows / ROWS_PER_FILE)))
    elif narrow:
        df = df.coalesce(max(8, 2 * spark.sparkContext.defaultParallelism))
    path = f"{prepare(spark)}/graphloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _staged.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def release(staged: DataFrame) -> None:
    """Removes a staged table that no later step reads."""
    spark, path = staged.sparkSession, staged.staged_at
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    _staged.remove((spark, path))


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, so that an operator's own columns beside it can have any name; ``row.*`` gives them back."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns])


def fold(doc_id: str | Column, folds: int) -> Column:
    """``crc32(id as text) mod folds``."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.encode(F.coalesce(c.cast("string"), F.lit("")), "UTF-8")) % F.lit(folds)


def bounded_sample(keys: DataFrame, label: str, key: str, per_label: int, seed: str = "s1") -> tuple[DataFrame, dict]:
    """At most ``per_label`` rows of each label, the least by a seeded hash of ``key``; how many rows each label has.

    A first pass counts the labels; a hash threshold then cuts each label to about four times its bound before the exact
    cut, so that no label, however frequent, meets in one task. Equal rows of ``keys`` count in the counts, and once in the sample.
    """
    counted = keys.groupBy(label).agg(F.count(F.lit(1)).alias("n")).limit(MAX_LABELS + 1)
    counts = {r[label]: r["n"] for r in counted.collect()}
    if len(counts) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} different values are no labels")
    if not counts:
        return keys.limit(0), counts
    h = F.xxhash64(F.lit(seed), F.col(key).cast("string"))
    unit = F.pmod(h, F.lit(1 << 30)) / F.lit(float(1 << 30))
    shares = keys.sparkSession.createDataFrame([(v, min(1.0, 4.0 * per_label / n)) for v, n in counts.items()], keys.select(F.col(label), F.lit(0.0).alias("_share")).schema)
    w = Window.partitionBy(label).orderBy(h, F.col(key))
    cut = keys.join(F.broadcast(shares), label).filter(unit <= F.col("_share")).select(*keys.columns).distinct()
    return cut.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= per_label).drop("_rn"), counts


def sampled_texts(documents: DataFrame, sample: DataFrame, keys: list[str], text: str = "_x") -> DataFrame:
    """``documents`` of the sampled ``keys``, one row each: of repeated keys the text with the least hash stands for all.

    A key's rows are reduced to one within each task first, so however often it repeats, what is fitted stays within the bound.
    """
    rows = documents.join(F.broadcast(sample), keys)  # a bounded sample
    others = [c for c in sample.columns if c not in keys]
    return rows.groupBy(*keys, *others).agg(F.min_by(text, F.struct(F.xxhash64(text), F.length(text))).alias(text))


# ---------------------------------------------------------------- hashing of texts in numpy

_P = np.uint64(0x9E3779B97F4A7C15)
#: Of the word hashes, so that no one text was made to collide.
_SEED = 0x5851F42D4C957F2D


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the output."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def words_of(text: str, lower: bool = False) -> Iterator[list[bytes]]:
    """The words of a whole text as UTF-8, in lists of about ``SLICE`` bytes; a longer word stays whole, as one object."""
    plain = text.encode("utf-8", "surrogatepass")
    plain = plain.lower() if lower else plain  # A-Z only
    at, end = 0, 0
    while at < len(plain):
        end = len(plain)
        if end - at > SLICE and (blank := _BLANK.search(plain, at + SLICE)):
            end = blank.start()
        yield plain[at:end].split()
        at = end


_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def word_hashes(text: str, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word's bytes, A-Z lower-cased on demand; a word of any length costs its bytes."""
    return np.frombuffer(b"".join(h for some in words_of(text, lower) for h in map(xxhash.xxh3_64_digest, some, itertools.repeat(_SEED))), np.uint64)


_K = [np.uint64(k) for k in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]


_K32 = [np.uint32(k) for k in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)]


def char_ngrams(cp: np.ndarray, sizes: tuple[int, ...], bits: int, most: int | None = None) -> Iterator[np.ndarray]:
    """Hashed character n-grams, ``bits`` wide, of each of the ascending sizes; of the first ``most`` places only. A size goes on from the one before."""
    x = cp[:0]
    for n in range(1, sizes[-1] + 1):
        if len(cp) < n:
            return
        x = (cp ^ _K32[3] if n == 1 else x[:-1] ^ cp[n - 1 :]) * _K32[n % 4]
        x ^= x >> np.uint32(15)
        if n in sizes:
            yield ((x[:most] * _K32[2]) >> np.uint32(32 - bits)).astype(np.int64)


def term_counts(text: str, bits: int, chars: tuple[int, ...] = (1, 2, 3), words: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed character and word n-grams of a whole text and how often each occurs.

    Word bigrams that repeat a word are hashed as a back-reference, so that repetition looks alike whatever the word.
    """
    return counted(_term_hashes(text, bits, chars, words), bits)


def _term_hashes(text: str, bits: int, chars: tuple[int, ...], words: bool) -> Iterator[np.ndarray]:
    for at in range(0, len(text) if chars else 0, SLICE):
        yield from char_ngrams(code_points(text[at : at + SLICE + max(chars) - 1]), chars, bits, SLICE)
    if words and len(w := word_hashes(text)):
        shift = np.uint64(64 - bits)
        yield (mix(w + _K[1]) >> shift).astype(np.int64)
        if len(w) > 1:
            pair = np.where(w[1:] == w[:-1], _K[2], mix(w[:-1] * _K[0] + w[1:]))
            yield (mix(pair + _K[3]) >> shift).astype(np.int64)


def counted(hashes: Iterator[np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values below ``2**bits`` and how often each occurs: sorted where they are few, else in an array of counts."""
    waiting, held, total = [], 0, None
    for h in hashes:
        waiting.append(h)
        held += len(h)
        if held >= SLICE:
            now = np.bincount(np.concatenate(waiting), minlength=1 << bits)
            total = now if total is None else total + now
            waiting, held = [], 0
    if held:
        rest = np.concatenate(waiting)
        if total is None and held << 4 < 1 << bits:
            return np.unique(rest, return_counts=True)
        now = np.bincount(rest, minlength=1 << bits)
        total = now if total is None else total + now
    at = np.flatnonzero(total) if total is not None else np.zeros(0, np.int64)
    return at, total[at] if total is not None else at


def flat(lists: pd.Series, dtype: type) -> np.ndarray:
    """All elements of a column of arrays; an empty array has no type of its own."""
    return np.concatenate([np.asarray(a, dtype) for a in lists]) if len(lists) else np.zeros(0, dtype)


def sparse_rows(df: DataFrame, text: str, bits: int, keep: list[str], featurize: Callable | None = None) -> DataFrame:
    """``keep`` columns plus arrays ``idx`` and ``tf`` of each text's hashed terms."""
    f = featurize or term_counts

    @pandas_udf("idx array<int>, tf array<int>")
    def terms(s: pd.Series) -> pd.DataFrame:
        got = [f(t if isinstance(t, str) else "", bits) for t in s]
        return pd.DataFrame({"idx": [a.astype(np.int32) for a, _ in got], "tf": [b.astype(np.int32) for _, b in got]})

    return df.select(*keep, terms(F.col(text)).alias("_t")).select(*keep, "_t.idx", "_t.tf")
