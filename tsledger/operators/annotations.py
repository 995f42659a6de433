"""Annotations as a log of operations: ``id, op, device, lo, hi, label, note, seq, cno``; ``op`` is put or remove."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .snapshot import as_of, newest

FIELDS = ("device", "lo", "hi", "label", "note")


def state(ops: DataFrame, version: int | None = None, device: str | None = None) -> DataFrame:
    """Annotations as of a version: the newest operation of each id, unless it removes."""
    rows = newest(as_of(ops, version), ["id"]).filter("op = 'put'")
    if device is not None:
        rows = rows.filter(F.col("device") == device)
    return rows.select("id", *FIELDS)


def diff(ops: DataFrame, start: int, end: int | None = None) -> DataFrame:
    """``id, kind`` and the fields before and after, of annotations that differ between two versions."""
    a = state(ops, start).select(F.col("id").alias("__a"), F.struct(*FIELDS).alias("before"))
    b = state(ops, end).select(F.col("id").alias("__b"), F.struct(*FIELDS).alias("after"))
    both = a.join(b, F.col("__a") == F.col("__b"), "full_outer")
    kind = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").otherwise("changed")
    changed = ~F.col("before").eqNullSafe(F.col("after"))
    fields = [F.col(f"{side}.{f}").alias(f"{side}_{f}") for side in ("before", "after") for f in FIELDS]
    return both.filter(changed).select(F.coalesce("__a", "__b").alias("id"), kind.alias("kind"), *fields)


def faults(ops: DataFrame) -> DataFrame:
    """Operations that cannot be: removals of an id that is not there, inverted intervals, ids below one."""
    from pyspark.sql import Window as W

    before = F.lag("op").over(W.partitionBy("id").orderBy("seq"))
    absent = (F.col("op") == "remove") & ~before.eqNullSafe(F.lit("put"))
    return ops.withColumn("__absent", absent).filter(F.col("__absent") | (F.col("lo") > F.col("hi")) | (F.col("id") < 1)).drop("__absent")
