"""History: commits, versions at a moment, differences of versions, the hash chain."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidArgumentError
from . import ranges
from .snapshot import as_of, newest, visible

#: What stands before a commit's body when it is hashed.
DOMAIN = b"tsledger-commit-1\n"
ORIGIN = "0" * 64


def same(a: Column, b: Column, floating: bool) -> Column:
    """Equal as stored: nulls equal nulls, NaN equals NaN, and for floats zeros of either sign differ."""
    equal = a.eqNullSafe(b)
    if not floating:
        return equal
    return equal & (a.isNull() | (a != 0) | (a.cast("string") == b.cast("string")))


def _touched(log: DataFrame, deletions: DataFrame | None, start: int, end: int | None, shifts: tuple[int, ...] | None) -> DataFrame:
    """Keys that rows or deletions of the commits in between concern; others cannot differ."""
    between = lambda x: as_of(x, end).filter(F.col("cno") > F.lit(start))
    keys = between(log).select("device", "t")
    if deletions is not None:
        keys = keys.unionByName(ranges.covered_keys(as_of(log, start).select("device", "t"), between(deletions).select("device", "lo", "hi"), shifts))
    return keys.distinct()


def diff(log: DataFrame, deletions: DataFrame | None, start: int, end: int | None = None, columns: Sequence[str] | None = None, touched_only: bool = True, shifts: tuple[int, ...] | None = None) -> DataFrame:
    """``device, t, kind`` (added, removed, changed), and each column before and after, of points that differ.

    ``touched_only``: rows of keys that no commit in between concerns are left out before either version is resolved.
    """
    if end is not None and start > end:
        raise InvalidArgumentError("the first version is later than the second")
    values = [c for c in log.columns if c not in ("device", "t", "seq", "cno")] if columns is None else list(columns)
    rows = log.select("device", "t", "seq", "cno", *values)
    if deletions is not None and shifts is None:
        shifts = ranges.shifts_of(deletions)
    if touched_only:
        rows = rows.join(_touched(log, deletions, start, end, shifts), ["device", "t"], "left_semi")

    def at(version: int | None, side: str) -> DataFrame:
        kept = visible(as_of(rows, version), None if deletions is None else as_of(deletions, version), shifts)
        return newest(kept).select("device", "t", F.lit(True).alias(side), *(F.col(c).alias(f"{side}_{c}") for c in values))

    both = at(start, "before").join(at(end, "after"), ["device", "t"], "full_outer")
    kind = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").otherwise("changed")
    floats = {f.name for f in log.schema if f.dataType.simpleString() in ("float", "double")}
    equal = reduce(lambda x, y: x & y, (same(F.col(f"before_{c}"), F.col(f"after_{c}"), c in floats) for c in values), F.lit(True))
    differs = F.col("before").isNull() | F.col("after").isNull() | ~equal
    return both.filter(differs).select("device", "t", kind.alias("kind"), *(f"{side}_{c}" for c in values for side in ("before", "after")))


def commit_changes(log: DataFrame, deletions: DataFrame | None = None, notes: DataFrame | None = None, commits: DataFrame | None = None) -> DataFrame:
    """``cno`` with rows written (replacing ones too), first and last time, ranges deleted, annotation operations.

    One aggregate over the union of the logs, so each is read once; commits without rows have zeros where
    ``commits`` (``cno``) is given.
    """
    none = F.lit(None).cast("long")
    shape = lambda x, rows, ranges, ops, t: x.select("cno", F.lit(rows).alias("r"), F.lit(ranges).alias("d"), F.lit(ops).alias("o"), t.alias("t"))
    parts = [shape(log, 1, 0, 0, F.col("t"))]
    if deletions is not None:
        parts.append(shape(deletions, 0, 1, 0, none))
    if notes is not None:
        parts.append(shape(notes, 0, 0, 1, none))
    if commits is not None:
        parts.append(shape(commits, 0, 0, 0, none))
    total = lambda c: F.sum(c).cast("long")
    return reduce(DataFrame.unionAll, parts).groupBy("cno").agg(total("r").alias("rows_written"), F.min("t").alias("t_min"), F.max("t").alias("t_max"), total("d").alias("ranges_deleted"), total("o").alias("annotation_ops"))


def commit_at(commits: DataFrame, time_ns: int | Column) -> DataFrame:
    """``version``: the largest number among commits not later than a moment, 0 without one; clocks may go back."""
    return commits.filter(F.col("time_ns") <= time_ns).agg(F.coalesce(F.max("cno"), F.lit(0).cast("long")).cast("long").alias("version"))


def metadata_as_of(metadata: DataFrame, version: int | None = None) -> DataFrame:
    """``key, value`` of the newest map (``cno, seq, entries``) as of a version."""
    last = as_of(metadata, version).agg(F.max_by("entries", "seq").alias("entries"))
    return last.select(F.explode("entries").alias("key", "value"))


def commit_hash(body: bytes) -> str:
    return hashlib.sha256(DOMAIN + body).hexdigest()


def hash_column(body: Column) -> Column:
    """:func:`commit_hash` of a column of texts."""
    return F.sha2(F.concat(F.lit(DOMAIN), F.encode(body, "UTF-8")), 256)


def chain_faults(commits: DataFrame, origin: str = ORIGIN) -> DataFrame:
    """Commits (``cno, prev_hash, hash`` and, where there is one, ``body``) whose previous hash is not that of the commit
    one number before, that have no such commit, or whose hash is not that of their body.

    Each commit meets the one before by number, so a long chain is checked in as many tasks as there are.
    """
    before = commits.select((F.col("cno") + 1).alias("__n"), F.col("hash").alias("__h"))
    both = commits.join(before, F.col("cno") == F.col("__n"), "left")
    expected = F.when(F.col("cno") == 1, F.lit(origin)).otherwise(F.col("__h"))
    wrong = ~F.col("prev_hash").eqNullSafe(expected)
    if "body" in commits.columns:
        wrong = wrong | ~F.col("hash").eqNullSafe(hash_column(F.col("body")))
    return both.filter(wrong).drop("__n", "__h")
