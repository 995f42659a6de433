"""Closed intervals: overlap, coalescing, labelling of points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import ranges

HIGH = 2**63 - 1


def overlaps(a_lo: Column, a_hi: Column, b_lo: Column, b_hi: Column) -> Column:
    return (a_lo <= b_hi) & (b_lo <= a_hi)


def _shift(intervals: DataFrame) -> int:
    """A block size under which a block begins about a thousand intervals, from one small aggregate."""
    low, high, n = intervals.agg(F.min("lo").cast("double"), F.max("lo").cast("double"), F.count(F.lit(1))).first()
    return 1 if low is None else min(62, max(1, int((high - low) / n * 1024).bit_length()))


def coalesce(intervals: DataFrame, key: str = "device", shift: int | None = None) -> DataFrame:
    """``key, lo, hi``: overlapping and adjacent intervals of a key joined; inverted ones dropped.

    Time is cut into blocks by where intervals begin.  How far the blocks before reach, and where the last joined
    interval began in them, is carried from block to block; the intervals of a block are walked in one task, those of a
    key in many.
    """
    rows = intervals.filter("lo <= hi").select(key, "lo", "hi")
    shift = _shift(rows) if shift is None else shift
    rows = rows.withColumn("__b", F.shiftright("lo", shift))
    before = W.partitionBy(key).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    reach = rows.groupBy(key, "__b").agg(F.max("hi").alias("__m")).select(key, "__b", F.max("__m").over(before).alias("__carry"))
    inside = W.partitionBy(key, "__b").orderBy("lo", "hi")
    far = F.greatest(F.col("__carry"), F.max("hi").over(inside.rowsBetween(W.unboundedPreceding, -1)))
    begins = far.isNull() | ((far < F.lit(HIGH)) & (F.col("lo") > F.when(far < F.lit(HIGH), far + 1)))
    rows = rows.join(reach, [key, "__b"]).withColumn("__start", F.when(begins, F.col("lo")))
    last = rows.groupBy(key, "__b").agg(F.max("__start").alias("__s")).select(key, "__b", F.max("__s").over(before).alias("__open"))
    own = F.last("__start", ignorenulls=True).over(inside.rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("__own", own).join(last, [key, "__b"]).groupBy(key, F.coalesce("__own", "__open").alias("lo")).agg(F.max("hi").alias("hi"))


def label_points(points: DataFrame, notes: DataFrame, shifts: tuple[int, ...] | None = None) -> DataFrame:
    """``points`` (a row per device and time) with ``label``: of the notes (``id, device, lo, hi, label``) that cover
    a point, the one with the largest id; null where none does.  Points and notes meet by device and block of time."""
    named = notes.select("device", "lo", "hi", F.struct("id", "label").alias("note"))
    out = ranges.greatest(points, named, "note", "__note", shifts)
    return out.select(*points.columns, F.col("__note.label").alias("label"))
