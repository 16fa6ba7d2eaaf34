"""Half-open intervals [lo, hi) per key: overlap join, merge, subtraction, clusters and dense stretches.

Null bounds and empty intervals (hi <= lo) take no part. An overlap join spreads each interval over the
bins that it touches, short ones over fine bins and long ones over coarse bins, joins on (key, bin) and keeps a
pair only in the first bin that both touch, so no distinct is needed and no inequality join is planned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


SPAN, COARSE = 64, 4096  # bins that an interval may touch at its level, and how much wider the bins of the next level are


def _binned(df: DataFrame, lo: str, hi: str, width: int) -> DataFrame:
    """Adds the level of an interval and one row per bin, at its own level and at each coarser one.

    Level 0 has bins of ``width``, level 1 bins ``COARSE`` times as wide, level 2 one bin for all; an interval lies
    on the first level where it touches at most ``SPAN`` bins or so, so no interval, however long, becomes many rows.
    """
    valid = df.where(F.col(lo).isNotNull() & F.col(hi).isNotNull() & (F.col(hi) > F.col(lo)))
    size = F.coalesce(F.try_subtract(F.col(hi).cast("long"), F.col(lo).cast("long")), F.lit((1 << 63) - 1))
    level = F.when(size <= width * SPAN, 0).when(size <= width * COARSE * SPAN, 1).otherwise(2)
    bins = lambda at, w: F.when(F.col("__level") <= at, F.transform(F.sequence(F.floor(F.col(lo) / w), F.floor((F.col(hi) - 1) / w)), lambda b: F.struct(F.lit(at).alias("l"), b.alias("b"))))
    none = F.array().cast("array<struct<l: int, b: bigint>>")
    last = F.array(F.struct(F.lit(2).alias("l"), F.lit(0).cast("long").alias("b")))
    laid = valid.withColumn("__level", level)
    return laid.withColumn("__bin", F.explode(F.concat(F.coalesce(bins(0, width), none), F.coalesce(bins(1, width * COARSE), none), last)))


def overlap_join(left: DataFrame, right: DataFrame, key: str, left_bounds: tuple[str, str], right_bounds: tuple[str, str], width: int) -> DataFrame:
    """All pairs of overlapping intervals of one key. Other column names must differ between the sides.

    A pair is made at the coarser of the two levels, in the first bin there that both touch. ``__side`` keeps rows that both stand
    at a coarser level than their own apart: 0 is the left's own level, 1 its coarser ones, and the right's rows go to
    the sides that they may meet, so short intervals meet long ones in a coarse bin, but not one another.
    """
    (a, b), (c, d) = left_bounds, right_bounds
    own = F.col("__bin.l") == F.col("__level")
    one = _binned(left, a, b, width).withColumn("__side", F.when(own, 0).otherwise(1)).withColumnRenamed("__level", "__a")
    two = _binned(right, c, d, width).withColumn("__side", F.explode(F.when(own, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).withColumnRenamed("__level", "__b")
    pairs = one.join(two, [key, "__bin", "__side"])
    meet = (F.col(a) < F.col(d)) & (F.col(c) < F.col(b))
    begin = F.greatest(F.col(a), F.col(c))
    first = F.when(F.col("__bin.l") == 0, F.floor(begin / width)).when(F.col("__bin.l") == 1, F.floor(begin / (width * COARSE))).otherwise(0)
    return pairs.where(meet & (F.col("__bin.b") == first)).drop("__bin", "__a", "__b", "__side")


def islands(df: DataFrame, keys: list[str], lo: str, hi: str, gap: Column | int = 0, tie: list[str] | None = None) -> DataFrame:
    """Adds ``island``: intervals of one key that overlap, or lie at most ``gap`` apart, share a number from 0."""
    order = W.partitionBy(*keys).orderBy(lo, hi, *(tie or []))
    before = F.max(hi).over(order.rowsBetween(W.unboundedPreceding, -1))
    new = F.coalesce((F.col(lo) > before + gap).cast("int"), F.lit(0))
    return df.withColumn("__new", new).withColumn("island", F.sum("__new").over(order.rowsBetween(W.unboundedPreceding, 0))).drop("__new")


def merge(df: DataFrame, keys: list[str], lo: str, hi: str, gap: int = 0) -> DataFrame:
    """(*keys, lo, hi, n): the union of the intervals of each key, with how many went into each."""
    valid = df.where(F.col(lo).isNotNull() & F.col(hi).isNotNull() & (F.col(hi) > F.col(lo)))
    return islands(valid, keys, lo, hi, gap).groupBy(*keys, "island").agg(
        F.min(lo).alias("lo"), F.max(hi).alias("hi"), F.count(F.lit(1)).alias("n")
    ).drop("island")


def subtract(df: DataFrame, holes: DataFrame, key: str, lo: str, hi: str, hole_lo: str, hole_hi: str) -> DataFrame:
    """(key, lo, hi): the merged intervals of ``df`` without those of ``holes``; a sweep over all bounds of a key."""
    sides = [(merge(df, [key], lo, hi), 1, 0), (merge(holes, [key], hole_lo, hole_hi), 0, 1)]
    marks = None
    for side, kept, hole in sides:
        ends = F.array(F.struct(F.col("lo").alias("at"), F.lit(kept).alias("kept"), F.lit(hole).alias("hole")),
                       F.struct(F.col("hi").alias("at"), F.lit(-kept).alias("kept"), F.lit(-hole).alias("hole")))
        part = side.select(key, F.inline(ends))
        marks = part if marks is None else marks.unionByName(part)
    at = marks.groupBy(key, "at").agg(F.sum("kept").alias("kept"), F.sum("hole").alias("hole"))
    along = W.partitionBy(key).orderBy("at")
    state = at.withColumn("in_kept", F.sum("kept").over(along)).withColumn("in_hole", F.sum("hole").over(along)).withColumn("to", F.lead("at").over(along))
    pieces = state.where("in_kept > 0 and in_hole = 0 and to is not null").select(key, F.col("at").alias("lo"), F.col("to").alias("hi"))
    return merge(pieces, [key], "lo", "hi").drop("n")


def dense(df: DataFrame, keys: list[str], pos: str, span: int, least: int) -> DataFrame:
    """(*keys, pos, n): positions that begin a stretch of ``span`` with at least ``least`` positions."""
    ahead = W.partitionBy(*keys).orderBy(pos).rangeBetween(0, span - 1)
    return df.withColumn("n", F.count(F.lit(1)).over(ahead)).where(F.col("n") >= least).select(*keys, pos, "n")
