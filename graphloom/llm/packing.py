"""Best-fit packing of tokenized documents into sequences, by bin completion.

Lengths are at most ``capacity``, so a histogram of at most ``capacity`` rows describes any corpus. The driver solves the
packing on that histogram alone; a plan of patterns (which lengths share a sequence, how many such sequences) comes back,
and each piece finds its place from its rank among the pieces of its length. Ranks come from salted windows, so no length,
however frequent, meets in one task.

The search (``plan``) is bin completion with branch and bound. The largest remaining length opens a bin; its undominated
fillings are enumerated, best-filled first, and each is used as often as the histogram allows. A filling is dominated if some
of its items could be exchanged for one larger unused item that still fits (of more than six items, the test covers single
items and pairs). A node is pruned when the bins used plus the
waste bound - remaining tokens over capacity, or the number of remaining lengths over half the capacity - reach the
incumbent. Best-fit decreasing on the histogram gives the first incumbent, and every leaf may replace it.

The search is bounded by default, so the plan is not always optimal, but it packs every piece in any case. A node tries
``Search.fillings`` fillings at most: waste-free ones first, of which the first that a pair or three items close are looked up,
and otherwise the best-filled of those met in ``Search.steps`` steps and of a greedy one. The search ends at the lower bound,
``Search.after_leaf`` nodes after the last better leaf, or after ``Search.nodes`` nodes, and returns the incumbent. Each bound is
a parameter; with ``EXHAUSTIVE``, which has none, every undominated filling is tried and the plan is optimal.

Defined results
---------------
* null text: as the empty text, one piece of the closing id alone;
* longer documents are cut into pieces of ``capacity`` from their end, so that only the first piece may be shorter;
* null ids and repeated rows: each row is packed as a document of its own; an empty table gives an empty result;
* other columns are ignored.
"""

from __future__ import annotations

import bisect
import sys
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.window import Window

from graphloom.llm import common

CAPACITY = 2048
TOKENIZER = "byte_bpe_50k.json"
CLOSING_ID = 0


@dataclass(frozen=True)
class Search:
    """Bounds of the search; none is no bound, and without all four the plan is optimal, in exponential time."""

    nodes: int | None = 6_000
    after_leaf: int | None = 1_000  # nodes after the last improvement at a leaf
    fillings: int | None = 5  # tried at one node; bounded, fillings without waste go before all others
    steps: int | None = 1_500  # spent on enumerating the fillings of one node


EXHAUSTIVE = Search(None, None, None, None)
_MOST = sys.maxsize


# ---------------------------------------------------------------- the search

Pattern = tuple[int, ...]  # lengths of one sequence, descending


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing on a histogram: each length goes where it leaves the least room."""
    rooms: dict[int, dict[Pattern, int]] = {}
    order: list[int] = []  # rooms with open bins, ascending

    def put(room: int, pattern: Pattern, n: int) -> None:
        if room not in rooms:
            rooms[room] = {}
            bisect.insort(order, room)
        rooms[room][pattern] = rooms[room].get(pattern, 0) + n

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            i = bisect.bisect_left(order, length)
            if i == len(order):
                k = capacity // length
                full, some = divmod(left, k)
                if full:
                    put(capacity - k * length, (length,) * k, full)
                if some:
                    put(capacity - some * length, (length,) * some, 1)
                break
            room = order[i]
            pattern, n = rooms[room].popitem()
            # Each bin takes as many as fit, one after the other, as the one just used is then the best fit again.
            k = room // length
            full, some = divmod(min(left, n * k), k)
            used = full + bool(some)
            if n > used:
                rooms[room][pattern] = n - used
            if not rooms[room]:
                del rooms[room], order[i]
            if full:
                put(room - k * length, pattern + (length,) * k, full)
            if some:
                put(room - some * length, pattern + (length,) * some, 1)
            left -= full * k + some
    return [(p, n) for found in rooms.values() for p, n in found.items()]


def fillings(counts: dict[int, int], lengths: list[int], room: int, search: Search) -> list[Pattern]:
    """Undominated multisets of ``lengths`` (ascending, with ``counts`` each) that fit into ``room``, best-filled first."""
    limit, most_steps = _MOST if search.fillings is None else search.fillings, _MOST if search.steps is None else search.steps
    usable = lengths[: bisect.bisect_right(lengths, room)]
    if not usable:
        return [()]
    if counts.get(room):
        return [(room,)]  # one item that fills the room dominates every other filling
    exact = search.fillings is not None and [p for p in _exact(counts, usable, room, limit) if not _dominated(p, 0, counts, usable)]
    if exact:
        return sorted(exact, key=lambda p: (len(p), tuple(-x for x in p)))[:limit]
    found: list[Pattern] = []
    steps = 0

    def extend(chosen: list[int], left: int, top: int) -> bool:
        """Chooses items not larger than ``usable[top]``; true once a limit is reached."""
        nonlocal steps
        steps += 1
        i = min(top, bisect.bisect_right(usable, left) - 1)
        any_fits = False
        while i >= 0:
            item = usable[i]
            if counts[item] - chosen.count(item) > 0:
                any_fits = True
                chosen.append(item)
                stop = extend(chosen, left - item, i)
                chosen.pop()
                if stop:
                    return True
            i -= 1
        if not any_fits and not _dominated(tuple(chosen), left, counts, usable):
            found.append(tuple(chosen))
        return steps >= most_steps or len(found) >= limit * 2

    extend([], room, len(usable) - 1)
    found.append(_greedy(counts, usable, room))
    return sorted(set(found), key=lambda p: (-sum(p), len(p), tuple(-x for x in p)))[:limit]


def _exact(counts: dict[int, int], usable: list[int], room: int, limit: int) -> list[Pattern]:
    """Fillings without waste: largest items first, closed by a pair or three items of exactly the rest."""
    have = np.zeros(room + 1, bool)
    have[usable] = True
    out: list[Pattern] = []

    def pairs(rest: int, lead: tuple[int, ...]) -> None:
        top = min(lead[-1] if lead else rest, rest - 1, usable[-1])
        low = (rest + 1) // 2
        if top < low:
            return
        x = np.arange(low, top + 1)
        for a in x[have[low : top + 1] & have[rest - x]][::-1][:limit].tolist():
            p = (*lead, a, rest - a)
            if all(p.count(i) <= counts[i] for i in set(p)):
                out.append(p)

    lead: tuple[int, ...] = ()
    while True:
        rest = room - sum(lead)
        if rest <= 0:
            break
        if lead and rest <= lead[-1] and have[rest] and counts[rest] > lead.count(rest):
            out.append((*lead, rest))
        pairs(rest, lead)
        if len(out) >= limit:
            break
        for a in reversed(usable[: bisect.bisect_right(usable, min(rest, lead[-1] if lead else rest))][-limit:]):
            if 3 * a < rest:
                break
            if counts[a] > lead.count(a):
                pairs(rest - a, (*lead, a))
            if len(out) >= limit:
                break
        if len(out) >= limit:
            break
        fits = usable[: bisect.bisect_right(usable, min(rest, lead[-1] if lead else rest))]
        nxt = next((a for a in reversed(fits) if counts[a] > lead.count(a)), None)
        if nxt is None:
            break
        lead = (*lead, nxt)
    return list(dict.fromkeys(out))


def _greedy(counts: dict[int, int], usable: list[int], room: int) -> Pattern:
    out: list[int] = []
    for item in reversed(usable):
        k = min(counts[item], room // item)
        out += [item] * k
        room -= k * item
    return tuple(out)


def _dominated(chosen: Pattern, left: int, counts: dict[int, int], usable: list[int]) -> bool:
    """Whether one unused item can take the place of some of the chosen ones, and is larger than they together."""
    sums = {0}
    if len(chosen) <= 6:
        for x in chosen:
            sums |= {s + x for s in sums}
    else:
        sums |= {x + y for i, x in enumerate(chosen) for y in chosen[:i]} | set(chosen)
    single = set(chosen)
    for s in sums:
        if not left and (s in single or not s):
            continue  # nothing larger fits in its place
        i = bisect.bisect_right(usable, s) if s in single or not s else bisect.bisect_left(usable, s)
        while i < len(usable) and usable[i] <= s + left:
            if counts[usable[i]] - chosen.count(usable[i]) > 0:
                return True
            i += 1
    return False


def plan(counts: dict[int, int], capacity: int = CAPACITY, search: Search = Search()) -> list[tuple[Pattern, int]]:
    """Patterns and how many sequences take each; together they use exactly the histogram."""
    nodes, after_leaf = (_MOST if x is None else x for x in (search.nodes, search.after_leaf))
    counts = {k: v for k, v in counts.items() if v}
    fixed = []
    if n := counts.pop(capacity, 0):
        fixed.append(((capacity,), n))
    incumbent = best_fit(counts, capacity)
    best = sum(n for _, n in incumbent)
    total = sum(k * v for k, v in counts.items())
    bound = max(-(-total // capacity), sum(v for k, v in counts.items() if 2 * k > capacity))
    if best <= bound or not counts:
        return fixed + incumbent
    rest = dict(counts)
    lengths = sorted(rest)
    chosen: list[tuple[Pattern, int]] = []

    def take(p: Pattern, n: int) -> None:
        for x in set(p):
            if not rest[x]:
                bisect.insort(lengths, x)
            rest[x] -= n * p.count(x)
            if not rest[x]:
                lengths.pop(bisect.bisect_left(lengths, x))

    # Depth-first with an explicit stack of untried choices; a choice is (depth, pattern, times).
    stack: list[tuple[int, Pattern, int]] = []
    used, left, large = 0, total, sum(v for k, v in counts.items() if 2 * k > capacity)
    visited, last = 0, nodes

    def branch() -> None:
        top = lengths[-1]
        rest[top] -= 1
        gone = not rest[top]
        if gone:
            lengths.pop()
        options = fillings(rest, lengths, capacity - top, search)
        if gone:
            lengths.append(top)
        rest[top] += 1
        for p in reversed(options):
            p = (top, *p)
            stack.append((len(chosen), p, min(rest[x] // p.count(x) for x in set(p))))

    branch()
    while stack and visited < min(nodes, last) and best > bound:
        visited += 1
        depth, p, n = stack.pop()
        while len(chosen) > depth:
            q, m = chosen.pop()
            for x in set(q):
                if not rest[x]:
                    bisect.insort(lengths, x)
                rest[x] += m * q.count(x)
            used, left, large = used - m, left + m * sum(q), large + m * sum(2 * x > capacity for x in q)
        take(p, n)
        chosen.append((p, n))
        used, left, large = used + n, left - n * sum(p), large - n * sum(2 * x > capacity for x in p)
        if used + max(-(-left // capacity), large) >= best:
            last = min(last, visited + after_leaf)
            continue
        if not lengths:
            best, incumbent, last = used, list(chosen), visited + after_leaf
            continue
        # Best fit completes the partial packing: a cheap incumbent at every node of the first dives.
        if visited % 64 == 1:
            tail = best_fit({k: rest[k] for k in lengths}, capacity)
            if (m := used + sum(n for _, n in tail)) < best:
                best, incumbent = m, chosen + tail
                if best <= bound:
                    break
        branch()
    return fixed + incumbent


# ---------------------------------------------------------------- tokens

_loaded: dict[str, tuple] = {}


def _encoders(path: str) -> tuple:
    """The file's tokenizer, and a faster byte-level BPE with the same ranks for texts where both agree by construction."""
    if path not in _loaded:
        import json

        import tiktoken
        from tokenizers import Tokenizer

        full = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        special = {t.content for t in full.get_added_tokens_decoder().values()}
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        char = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in visible)}
        ranks = {bytes(char[c] for c in token): i for token, i in vocab.items() if token not in special}
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        _loaded[path] = full, fast, special
    return _loaded[path]


def token_ids(text: str, path: str) -> np.ndarray:
    """The ids of the file's tokenizer without its special framing.

    Texts within Latin-1 and without a special token's string go to an equal but faster encoder of the same vocabulary and
    merge ranks (beyond Latin-1 the libraries' Unicode tables could differ); all others to the tokenizer itself.
    """
    full, fast, special = _encoders(path)
    if not any(s in text for s in special):
        try:
            text.encode("latin-1")
            return np.array(fast.encode_ordinary(text), np.uint32)
        except UnicodeEncodeError:
            pass
    return np.array(full.encode(text, add_special_tokens=False).ids, np.uint32)


def pieces(documents: DataFrame, path: str, capacity: int = CAPACITY, text: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every piece of every row."""

    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for t in texts:
                ids = np.append(token_ids(t if isinstance(t, str) else "", path), np.uint32(CLOSING_ID)).astype("<u4")
                ends = range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)
                out.append([{"start": max(0, e - capacity), "length": e - max(0, e - capacity), "ids_crc32": zlib.crc32(ids[max(0, e - capacity) : e].tobytes())} for e in ends])
            yield pd.Series(out)

    cuts = pandas_udf(cut, "array<struct<start long, length long, ids_crc32 long>>")(F.col(text))
    return documents.select("doc_id", F.posexplode(cuts).alias("piece", "_p")).select("doc_id", "piece", "_p.*")


# ---------------------------------------------------------------- placing


def place(rows: DataFrame, capacity: int = CAPACITY, search: Search = Search()) -> DataFrame:
    """``rows`` (staged, with ``length``) plus ``sequence_id`` and ``offset`` by the plan of their histogram."""
    spark = rows.sparkSession
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity rows
    slots: dict[int, list[tuple[int, int, int, int]]] = {}  # length -> (first rank, first sequence, a sequence's share, first offset)
    filled: dict[int, int] = dict.fromkeys(counts, 0)
    sequence = 0
    for pattern, n in plan(counts, capacity, search):
        offset = 0
        for length in sorted(set(pattern), reverse=True):
            share = pattern.count(length)
            slots.setdefault(length, []).append((filled[length], sequence, share, offset))
            filled[length] += n * share
            offset += share * length
        sequence += n
    table = {k: np.array(v, np.int64) for k, v in slots.items()}  # bounded by the patterns: a few for each length
    shared = spark.sparkContext.broadcast(table)

    def seat(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for lengths, ranks in batches:
            out = np.zeros((len(lengths), 2), np.int64)
            for length in lengths.unique():
                at = np.flatnonzero(lengths.to_numpy() == length)
                slot, rank = shared.value[length], ranks.to_numpy()[at]
                s = slot[np.searchsorted(slot[:, 0], rank, "right") - 1]
                k = rank - s[:, 0]
                out[at, 0] = s[:, 1] + k // s[:, 2]
                out[at, 1] = s[:, 3] + k % s[:, 2] * length
            yield pd.DataFrame(out, columns=["sequence_id", "offset"])

    # Ranks among the pieces of a length: within salted groups, then shifted by the groups before.
    salts = max(64, sum(counts.values()) // 100_000)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    groups = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    shifts = common.stage(groups.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift")), "shifts")
    within = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32", "start")
    ranked = salted.withColumn("_rank", F.row_number().over(within) - 1).join(shifts, ["length", "_salt"])
    seated = pandas_udf(seat, "sequence_id long, offset long")(F.col("length"), (F.col("_rank") + F.col("_shift")).cast("long"))
    return ranked.withColumn("_seat", seated).select(*rows.columns, "_seat.sequence_id", "_seat.offset")


def pack(documents: DataFrame, path: str, capacity: int = CAPACITY, search: Search = Search()) -> DataFrame:
    """Every piece of ``documents`` with its place."""
    common.prepare(documents.sparkSession)
    return place(common.stage(pieces(documents.select("doc_id", "text"), path, capacity), "pieces"), capacity, search)


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(docs, tokenizer_path())
