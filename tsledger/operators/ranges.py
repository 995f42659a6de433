"""Closed ranges of time met by equal keys: what covers a point is found without comparing every point to every range.

Time is cut into blocks of several sizes, each a power of two; ``shifts`` are their exponents, from 1 on.  Where no range
is as long as a block of the smallest size, edges alone are met.  A range is the union of
the largest whole blocks within it and of at most two edges that fill no smallest block.  Of the whole blocks only the
greatest value of each is kept, combined before any shuffle, so ranges of any length and number come to at most one
row a block; edges are met by device and smallest block.  A point looks its blocks up, one join on (device, block) for
each size.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits between two sizes of blocks.
STEP = 10
#: Smallest blocks are some eight times as long as half of the ranges.
SPARE = 3


class Shifts(tuple):
    """Exponents of the block sizes that ranges may wholly cover, and ``edge``, that of the blocks edges are met by."""

    edge: int

    def __new__(cls, whole, edge: int | None = None):
        out = super().__new__(cls, whole)
        out.edge = out[0] if edge is None else edge
        return out


def shifts_for(length: int, longest: int) -> Shifts:
    """For ranges of a usual and a greatest length (ends less starts)."""
    first = min(62, max(length, 0).bit_length() + SPARE)
    whole = [first] if 1 << first <= longest + 1 else []
    while whole and whole[-1] < 62 and 1 << whole[-1] + STEP <= longest + 1:
        whole.append(min(62, whole[-1] + STEP))
    return Shifts(whole, first)


def shifts_of(ranges: DataFrame) -> Shifts:
    """:func:`shifts_for` the ranges of a table (``lo, hi``), from one small aggregate over them."""
    length = F.col("hi").cast("double") - F.col("lo").cast("double")
    usual, longest = ranges.filter("lo <= hi").agg(F.percentile_approx(length, 0.5), F.max(length)).first()
    return shifts_for(int(usual or 0), int(longest or 0))


def _given(shifts, ranges: DataFrame) -> Shifts:
    return shifts_of(ranges) if shifts is None else shifts if isinstance(shifts, Shifts) else Shifts(shifts)


def block(t: Column, shift: int) -> Column:
    return F.shiftright(t, shift)


def _whole(lo: Column, hi: Column, shift: int) -> tuple[Column, Column]:
    """First and last block that lie wholly in a range; none if the first is later."""
    mask = F.lit((1 << shift) - 1)
    first = block(lo, shift) + F.when(lo.bitwiseAND(mask) == 0, 0).otherwise(1)
    last = block(hi, shift) - F.when(hi.bitwiseAND(mask) == mask, 0).otherwise(1)
    return first, last


def _stretch(a: Column, b: Column) -> Column:
    return F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<long>"))


def cut(ranges: DataFrame, shifts: Shifts, value: str) -> tuple[list[DataFrame], DataFrame]:
    """For each shift ``device, block, value`` (the greatest one of the ranges that cover the block and no larger one),
    and the edges ``device, block, lo, hi, value`` by smallest block.  Ranges have ``device, lo, hi`` and the value."""
    lo, hi = F.col("lo"), F.col("hi")
    rows = ranges.filter("lo <= hi").select("device", "lo", "hi", F.col(value).alias("value"))
    levels = []
    for k, shift in enumerate(shifts):
        first, last = _whole(lo, hi, shift)
        own = _stretch(first, last)
        if k + 1 < len(shifts):
            up, down = _whole(lo, hi, shifts[k + 1])
            size = F.lit(1 << (shifts[k + 1] - shift))
            own = F.when(up <= down, F.concat(_stretch(first, up * size - 1), _stretch((down + 1) * size, last))).otherwise(own)
        levels.append(rows.select("device", "value", F.explode(own).alias("block")).groupBy("device", "block").agg(F.max("value").alias("value")))
    first, last = _whole(lo, hi, shifts.edge)
    mask, none = F.lit((1 << shifts.edge) - 1), F.lit(None).cast("struct<lo:bigint,hi:bigint>")
    part = lambda a, b: F.struct(a.alias("lo"), b.alias("hi"))
    left = F.when(lo.bitwiseAND(mask) != 0, part(lo, lo.bitwiseOR(mask))).otherwise(none)
    right = F.when(hi.bitwiseAND(mask) != mask, part(hi.bitwiseAND(F.bitwise_not(mask)), hi)).otherwise(none)
    ends = F.when(first > last, F.array(part(lo, hi))).otherwise(F.array(left, right))
    # an edge without a whole block between its ends may lie in two blocks
    edges = rows.select("device", "value", F.explode(F.filter(ends, lambda e: e.isNotNull())).alias("e")).select("device", "value", "e.*")
    return levels, edges.select("device", "lo", "hi", "value", F.explode(F.sequence(block(F.col("lo"), shifts.edge), block(F.col("hi"), shifts.edge))).alias("block"))


def above_blocks(points: DataFrame, levels: list[DataFrame], shifts: tuple[int, ...], name: str) -> DataFrame:
    """``points`` (``device, t``) with ``name``: the greatest value of whole blocks that cover a point, null without one."""
    names = []
    if not levels:
        return points.withColumn(name, F.lit(None))
    for k, (level, shift) in enumerate(zip(levels, shifts)):
        names.append(f"{name}{k}")
        own = level.select(F.col("device").alias("__d"), F.col("block").alias("__b"), F.col("value").alias(names[-1]))
        points = points.join(own, (F.col("device") == F.col("__d")) & (block(F.col("t"), shift) == F.col("__b")), "left").drop("__d", "__b")
    best = F.greatest(*names) if len(names) > 1 else F.col(names[0])
    return points.withColumn(name, best).drop(*names)


def uncovered(points: DataFrame, ranges: DataFrame, value: str, shifts: tuple[int, ...] | None = None) -> DataFrame:
    """The ``points`` (``device, t`` and ``value``) that no range with a greater value covers."""
    shifts = _given(shifts, ranges)
    levels, edges = cut(ranges, shifts, value)
    kept = points
    if levels:
        kept = above_blocks(points, levels, shifts, "__above").filter(F.col("__above").isNull() | (F.col("__above") <= F.col(value))).drop("__above")
    e = edges.select(F.col("device").alias("__d"), F.col("block").alias("__b"), F.col("lo").alias("__lo"), F.col("hi").alias("__hi"), F.col("value").alias("__v"))
    near = (F.col("device") == F.col("__d")) & (block(F.col("t"), shifts.edge) == F.col("__b"))
    return kept.join(e, near & F.col("t").between(F.col("__lo"), F.col("__hi")) & (F.col("__v") > F.col(value)), "left_anti")


def greatest(points: DataFrame, ranges: DataFrame, value: str, name: str, shifts: tuple[int, ...] | None = None) -> DataFrame:
    """``points`` (a row per ``device, t``) with ``name``: the greatest value of the ranges that cover a point, null
    without one.  Only keys and values of points at an edge are aggregated."""
    shifts = _given(shifts, ranges)
    levels, edges = cut(ranges, shifts, value)
    out = above_blocks(points, levels, shifts, "__whole")
    e = edges.select(F.col("device").alias("__d"), F.col("block").alias("__b"), F.col("lo").alias("__lo"), F.col("hi").alias("__hi"), "value")
    near = (F.col("device") == F.col("__d")) & (block(F.col("t"), shifts.edge) == F.col("__b")) & F.col("t").between(F.col("__lo"), F.col("__hi"))
    at = points.select("device", "t").join(e, near).groupBy(F.col("device").alias("__ed"), F.col("t").alias("__et")).agg(F.max("value").alias("__edge"))
    out = out.join(at, (F.col("device") == F.col("__ed")) & (F.col("t") == F.col("__et")), "left")
    return out.withColumn(name, F.greatest("__whole", "__edge") if levels else F.col("__edge")).drop("__whole", "__edge", "__ed", "__et")


def covered_keys(keys: DataFrame, ranges: DataFrame, shifts: tuple[int, ...] | None = None) -> DataFrame:
    """The ``keys`` (``device, t``) that some range covers."""
    shifts = _given(shifts, ranges)
    levels, edges = cut(ranges.withColumn("__one", F.lit(1)), shifts, "__one")
    e = edges.select(F.col("device").alias("__d"), F.col("block").alias("__b"), F.col("lo").alias("__lo"), F.col("hi").alias("__hi"))
    near = (F.col("device") == F.col("__d")) & (block(F.col("t"), shifts.edge) == F.col("__b"))
    at_edge = keys.join(e, near & F.col("t").between(F.col("__lo"), F.col("__hi")), "left_semi")
    if not levels:
        return at_edge
    return above_blocks(keys, levels, shifts, "__in").filter("__in is not null").drop("__in").unionByName(at_edge)
