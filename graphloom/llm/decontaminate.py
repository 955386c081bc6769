"""Benchmark decontamination with suffix arrays of the training texts.

The terms of the test items are numbered; any other term of a document is 0, which nothing matches. Each Arrow batch of whole
documents is a shard. Its suffix array is sparse: it holds those suffixes of the documents that open with the first ``SEED``
terms of some test window (of all its terms, where it has fewer), sorted term by term to the length of the longest item. Every
test suffix that holds a window is searched in it by bisection, one term deeper at a time. Where the interval is as deep as the
window, it names all places of that window; where it becomes empty, the interval before is the longest verbatim match of
that suffix in the shard, with its locations. Documents with a place of a window are contaminated.

Numbers stand for terms one to one, without hashing, so a match needs no confirmation. Documents are not shuffled, whatever
repeats in them. Items are the side that is broadcast, in slices of about ``TEST_TERMS`` terms; longer items are cut into pieces
that overlap by a window less a term, so that no window is lost (a longest match ends with its piece). Each slice adds to what
the ones before have found.

Defined results
---------------
* null or empty text: no terms; a document without terms is never hit, an item without terms never occurs;
* an item of fewer terms than a window is one window; a null ``item_id`` is an item by the name of ``''``; rows of one
  ``item_id`` are one item with several texts;
* each row is a document of its own, repeated rows and null ids included; an empty benchmark hits nothing;
* :func:`find` and :func:`decontaminate` carry all other columns, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from graphloom.llm import common, terms

WINDOW = 10
#: Terms by which suffixes are chosen for the array.
SEED = 4
#: Terms of items in a slice, and in a piece of an item.
TEST_TERMS = 1 << 21
PIECE = 1 << 17

_FOUND = "n_words long, spans array<struct<start: long, end: long>>, items array<string>, longest array<struct<item: string, item_at: long, at: long, words: long>>"


def _member(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """The place of each value in an ordered array of distinct ones, from 1; 0 if it isn't there."""
    if not len(ordered):
        return np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return np.where(ordered[at] == values, at + 1, 0)


def _shifted(x: np.ndarray, by: int) -> np.ndarray:
    return np.concatenate((x[by:], np.zeros(min(by, len(x)), x.dtype)))


class Tests:
    """Numbered test texts, each followed by a 0, their windows, and the seeds that open one."""

    def __init__(self, pieces: list[tuple[str, int, list[bytes]]], window: int) -> None:
        self.vocabulary = {t: i for i, t in enumerate(sorted({t for _, _, words in pieces for t in words}), 1)}
        self.names = sorted({name for name, _, _ in pieces})
        number = {name: i for i, name in enumerate(self.names)}
        text, start, item, offset, size = [], [], [], [], []
        for name, at, words in pieces:
            w = min(window, len(words))
            if not w:
                continue
            for i in range(len(words) - w + 1):
                start.append(len(text) + i)
                item.append(number[name])
                offset.append(at + i)
                size.append(w)
            text += [self.vocabulary[t] for t in words] + [0]
        self.text = np.array([*text, 0], np.int64)
        self.start, self.item, self.offset, self.size = (np.array(x, np.int64) for x in (start, item, offset, size))
        self.depth = max((len(words) for _, _, words in pieces), default=0)
        # Seeds of 1 to SEED terms, each term added to the number of what precedes it.
        self.grams: list[np.ndarray] = []
        self.seeds: dict[int, np.ndarray] = {}
        own = self.text
        for n in range(1, SEED + 1):
            if n > 1:
                key = self._key(own, _shifted(self.text, n - 1))
                self.grams.append(np.unique(key[key > 0]))
                own = _member(key, self.grams[-1])
            self.seeds[n] = np.unique(own[self.start[np.minimum(self.size, SEED) == n]])

    def _key(self, gram: np.ndarray, term: np.ndarray) -> np.ndarray:
        return np.where((gram > 0) & (term > 0), gram * (len(self.vocabulary) + 1) + term, 0)

    def opens(self, text: np.ndarray) -> np.ndarray:
        """The places of a text at which some window's seed stands."""
        at = np.flatnonzero(text)
        gram, out = text[at], []
        for n in range(1, SEED + 1):
            if n > 1:
                term = np.where(at + n - 1 < len(text), text[np.minimum(at + n - 1, len(text) - 1)], 0)
                gram = _member(self._key(gram, term), self.grams[n - 2])
                at, gram = at[gram > 0], gram[gram > 0]
            out.append(at[_member(gram, self.seeds[n]) > 0])
        return np.unique(np.concatenate(out))


def suffix_array(text: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """``places`` in the order of the suffixes that begin there, compared to ``depth`` terms; ``text`` ends in a 0."""
    rank, tied = np.zeros(len(places), np.int64), np.arange(len(places))
    last, width = len(text) - 1, int(text.max(initial=0)) + 1
    for d in range(depth):
        if not len(tied):
            break
        term = text[np.minimum(places[tied] + d, last)]
        key, group, count = np.unique(rank[tied] * width + term, return_inverse=True, return_counts=True)
        # A rank is how many places come before its group, so a group can be split without a look at the others.
        base, before = key // width, np.cumsum(count) - count
        rank[tied] = (base + before - before[np.searchsorted(base, base)])[group]
        tied = tied[(count[group] > 1) & (term > 0)]  # those that end here stay equal
    return places[np.argsort(rank, kind="stable")]


def _bisect(text: np.ndarray, array: np.ndarray, lo: np.ndarray, hi: np.ndarray, d: int, term: np.ndarray, right: bool) -> np.ndarray:
    """For each interval the first place in it whose term at depth ``d`` isn't less (``right``: is more) than ``term``."""
    lo, hi, last = lo.copy(), hi.copy(), len(text) - 1
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        at = text[np.minimum(array[np.minimum(mid, len(array) - 1)] + d, last)]
        below = (at <= term if right else at < term) & open_
        lo, hi = np.where(below, mid + 1, lo), np.where(open_ & ~below, mid, hi)
    return lo


def search(tests: Tests, text: np.ndarray, array: np.ndarray) -> tuple[list, list]:
    """Intervals of the array: ``(suffixes, from, to)`` with all places of their windows, and ``(suffixes, from, to, words)`` of their longest matches."""
    suffix = np.arange(len(tests.start))
    lo, hi = np.zeros(len(suffix), np.int64), np.full(len(suffix), len(array), np.int64)
    windows, longest, d = [], [], 0
    while len(suffix):
        term = tests.text[tests.start[suffix] + d]
        new_lo = _bisect(text, array, lo, hi, d, term, False)
        new_hi = _bisect(text, array, new_lo, hi, d, term, True)
        on = (new_lo < new_hi) & (term > 0)
        done = ~on & (d >= tests.size[suffix])
        if done.any():
            longest.append((suffix[done], lo[done], hi[done], np.full(int(done.sum()), d)))
        suffix, lo, hi, d = suffix[on], new_lo[on], new_hi[on], d + 1
        full = tests.size[suffix] == d
        if full.any():
            windows.append((suffix[full], lo[full], hi[full]))
    return windows, longest


def _spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each interval's number and places, one after another."""
    size = hi - lo
    own = np.repeat(np.arange(len(lo)), size)
    return own, np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size) + lo[own]


def scan(tests: Tests, texts: list[str | None]) -> list[tuple[int, list, list, list]]:
    """Of each text of a shard: terms, hit spans, names of the items that occur, longest matches."""
    parts = [terms.numbers(t, tests.vocabulary) for t in texts]
    n = np.array([len(p) for p in parts], np.int64)
    first = np.cumsum(n + 1) - (n + 1)
    text = np.zeros(int(n.sum()) + len(n) + 1, np.int64)
    for at, p in zip(first, parts, strict=True):
        text[at : at + len(p)] = p
    out = [(int(x), [], [], []) for x in n]
    array = suffix_array(text, tests.opens(text), tests.depth)
    if not len(array):
        return out
    windows, longest = search(tests, text, array)
    if not windows:
        return out
    edge, held = np.zeros(len(text) + 1, np.int64), []
    for suffix, lo, hi in windows:
        own, at = _spread(lo, hi)
        place, own = array[at], suffix[own]
        np.add.at(edge, place, 1)
        np.add.at(edge, place + tests.size[own], -1)
        held.append(np.unique((np.searchsorted(first, place, "right") - 1) * len(tests.names) + tests.item[own]))
    for pair in np.unique(np.concatenate(held)).tolist():
        out[pair // len(tests.names)][2].append(tests.names[pair % len(tests.names)])
    hit = np.diff(np.concatenate(([0], (np.cumsum(edge) > 0).view(np.int8), [0])))
    for a, b in zip(np.flatnonzero(hit == 1).tolist(), np.flatnonzero(hit == -1).tolist(), strict=True):
        doc = int(np.searchsorted(first, a, "right") - 1)
        out[doc][1].append((a - int(first[doc]), b - int(first[doc])))
    if longest:
        found = []
        for suffix, lo, hi, words in longest:
            own, at = _spread(lo, hi)
            place = array[at]
            doc = np.searchsorted(first, place, "right") - 1
            found.append(np.stack((doc, tests.item[suffix[own]], -words[own], tests.offset[suffix[own]], place - first[doc])))
        doc, item, words, offset, at = np.concatenate(found, 1)
        order = np.lexsort((at, offset, words, item, doc))
        new = np.concatenate(([True], (np.diff(doc[order]) != 0) | (np.diff(item[order]) != 0)))
        for i in order[new]:
            out[doc[i]][3].append((tests.names[item[i]], int(offset[i]), int(at[i]), -int(words[i])))
    return out


def _pieces(benchmark: DataFrame, window: int, item_id: str, text: str) -> DataFrame:
    """``name, at, words``: the items' terms in pieces that overlap by a window less a term."""

    @pandas_udf("array<struct<at: long, words: array<binary>>>")
    def cut(texts: pd.Series) -> pd.Series:
        out = []
        for x in texts:
            words = [t for some in terms.split(x) for t in some]
            ends = range(0, max(1, len(words) - window + 1), PIECE)
            out.append([{"at": at, "words": words[at : at + PIECE + window - 1]} for at in ends if words])
        return pd.Series(out, dtype=object)

    name = F.coalesce(F.col(item_id).cast("string"), F.lit(""))
    rows = benchmark.select(name.alias("name"), F.col(text).alias("_x")).distinct()
    return rows.select("name", F.explode(cut("_x")).alias("_p")).select("name", "_p.*")


def _merged(a: list, b: list) -> list:
    """Spans of both, sorted, those that overlap or touch joined."""
    out: list = []
    for lo, hi in sorted((s["start"], s["end"]) if isinstance(s, dict) else tuple(s) for s in [*a, *b]):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _add(tests: Tests, text: Column, before: Column | None, spark: SparkSession) -> Column:
    known = spark.sparkContext.broadcast(tests)

    def first(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame(scan(known.value, texts.tolist()), columns=["n_words", "spans", "items", "longest"])

    def later(batches: Iterator[tuple[pd.Series, pd.DataFrame]]) -> Iterator[pd.DataFrame]:
        for texts, old in batches:
            rows = scan(known.value, texts.tolist())
            rows = [(n, _merged(o.spans, s), sorted({*o.items, *i}), [*o.longest, *l]) for (n, s, i, l), o in zip(rows, old.itertuples(), strict=True)]
            yield pd.DataFrame(rows, columns=["n_words", "spans", "items", "longest"])

    return pandas_udf(first, _FOUND)(text) if before is None else pandas_udf(later, _FOUND)(text, before)


def find(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``row, found``: each document as it is, and what occurs in it.

    ``found`` has ``n_words``, the hit ``spans`` (terms, end exclusive), the ``items`` with occurring windows, and ``longest``:
    for an item whose longest match in the shard is in this document, where it begins in both and how many terms it has.
    """
    spark = documents.sparkSession
    common.prepare(spark)
    pieces = common.stage(_pieces(benchmark, window, item_id, item_text), "pieces")
    slices = max(1, math.ceil((pieces.agg(F.sum(F.size("words"))).first()[0] or 0) / TEST_TERMS))
    number = F.pmod(F.xxhash64("name", "at", F.lit("slice")), F.lit(slices))
    rows = documents.select(common.whole_row(documents).alias("row"))
    x = F.col("row").getField(text).alias("_x")
    for i in range(slices):
        some = pieces.filter(number == i).orderBy("name", "at").collect()
        tests = Tests([(r["name"], r["at"], [bytes(w) for w in r["words"]]) for r in some], window)
        rows = rows.select("row", _add(tests, x, F.col("found") if i else None, spark).alias("found"))
        if i < slices - 1:
            rows = common.stage(rows, "found")
    return rows


def longest_matches(found: DataFrame) -> DataFrame:
    """``item, item_at, row, at, words``: the longest verbatim match of each item in all shards, and where it is."""
    each = found.select("row", F.explode("found.longest").alias("m")).select("m.*", "row")
    order = F.struct("words", -F.col("item_at"), -F.col("at"))
    return each.groupBy("item").agg(F.max_by(F.struct("item_at", "row", "at", "words"), order).alias("b")).select("item", "b.*")


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text") -> DataFrame:
    """The documents in which no window of a test item occurs, all columns as they are."""
    return find(documents, benchmark, window, text).filter(F.size("found.spans") == 0).select("row.*")


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find(documents, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))
    n_hit = F.aggregate("found.spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    digest = F.sha2(F.array_join(F.array_sort("found.items"), ",").cast("binary"), 256)
    out = found.select("row.doc_id", "found.n_words", n_hit.alias("n_hit"), F.size("found.items").cast("long").alias("n_items"), digest.alias("items_sha256"))
    return out.withColumn("contaminated", F.col("n_hit") > 0)


ORACLE = r"""
with docs as (
    select row_number() over () as row, doc_id,
        coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as words
    from documents),
items as (
    select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words
    from benchmark),
tests as (select item_id, words, least(10, len(words)) as size from items where len(words) > 0),
windows as (
    select distinct item_id, size, array_to_string(words[i : i + size - 1], ' ') as w
    from (select item_id, words, size, unnest(range(1, len(words) - size + 2)) as i from tests)),
sizes as (select distinct size from windows),
places as (
    select row, size, i, array_to_string(words[i : i + size - 1], ' ') as w
    from (select row, words, size, unnest(range(1, len(words) - size + 2)) as i from docs cross join sizes where len(words) >= size)),
hits as (select row, item_id, i, size from places join windows using (size, w)),
words_hit as (select row, count(distinct p) as n_hit from (select row, unnest(range(i, i + size)) as p from hits) group by row),
named as (
    select row, count(*) as n_items, sha256(string_agg(name, ',' order by name)) as items_sha256
    from (select distinct row, coalesce(item_id::varchar, '') as name from hits) group by row)
select doc_id, len(words)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
    coalesce(items_sha256, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs left join words_hit using (row) left join named using (row)
"""
