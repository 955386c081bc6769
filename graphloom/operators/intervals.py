"""Interval joins as equi-joins on dyadic bins of lines.

Lines are dealt into blocks of ``BLOCK``. The blocks of an interval are covered by O(log n) aligned bins of 1, 2, 4 ... blocks,
each block by exactly one; a point meets the bins of all sizes around its block. So a point and an interval share one key
if the point's block is one of the interval's, and none otherwise: no pair comes twice, a comparison within the block
decides, and a file of any size is spread over its bins instead of comparing all of its points with all of its intervals.
Bounds are inclusive; an interval that ends before it starts, or has a null bound, holds nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lines of a block, as a power of two: most code entities lie in one or two.
BLOCK_BITS = 4


def _shift(x: Column, k: Column) -> Column:
    return F.call_function("shiftright", x, k)


def _top(blocks: Column) -> Column:
    """The largest bins in a cover of so many blocks: a quarter or half of it, so that short ones have bins of one size only."""
    return F.greatest(F.lit(0), F.floor(F.log2(F.greatest(blocks, F.lit(1)).cast("double"))).cast("int") - 1)


def cover(start: Column, end: Column) -> Column:
    """The bins that an interval's blocks consist of, as an array of ``level, bin``; null or turned bounds give an empty one."""
    lo, hi = F.shiftright(start.cast("long"), BLOCK_BITS), F.shiftright(end.cast("long"), BLOCK_BITS) + 1
    low = lambda k: _shift(lo + F.call_function("shiftleft", F.lit(1).cast("long"), k) - 1, k)
    bin_ = lambda k, at: F.struct(k.alias("level"), at.alias("bin"))
    odd = lambda x: F.pmod(x, F.lit(2)) == 1
    top = _top(hi - lo)
    # Below the top, an odd bin at either side; at the top, all that is left between them.
    sides = lambda k: F.array(F.when(odd(low(k)), bin_(k, low(k))), F.when(odd(_shift(hi, k)), bin_(k, _shift(hi, k) - 1)))
    lower = F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), top - 1), sides)))
    rest = F.transform(F.sequence(low(top), _shift(hi, top) - 1), lambda at: bin_(top, at))
    parts = F.when(top == 0, rest).otherwise(F.concat(lower, rest))
    return F.when(start <= end, parts).otherwise(F.array().cast("array<struct<level: int, bin: bigint>>"))


def points_in(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, start: str, end: str) -> DataFrame:
    """Rows of ``points`` beside each row of ``intervals`` with equal ``keys`` that holds ``at``; other columns must differ in name.

    Points meet bins up to those of the longest interval only, which is a scalar of the same plan: code rarely has long ones.
    """
    # Both readings of the intervals keep the same rows, so that what makes them is exchanged once for the two.
    held = intervals.filter(reduce(Column.__and__, [F.col(k).isNotNull() for k in keys], F.col(start) <= F.col(end)))
    most = held.agg(F.max(_top(F.shiftright(F.col(end).cast("long"), BLOCK_BITS) - F.shiftright(F.col(start).cast("long"), BLOCK_BITS) + 1)))
    bins = held.withColumn("_bin", F.explode(cover(F.col(start), F.col(end)))).select(*intervals.columns, F.col("_bin.level").alias("_level"), F.col("_bin.bin").alias("_at"))
    levels = F.explode(F.sequence(F.lit(0), F.coalesce(most.scalar(), F.lit(0))))
    dealt = points.withColumn("_level", levels).withColumn("_at", _shift(F.shiftright(F.col(at).cast("long"), BLOCK_BITS), F.col("_level")))
    return dealt.join(bins, [*keys, "_level", "_at"]).filter(F.col(at).between(F.col(start), F.col(end))).drop("_level", "_at")
