"""Sizes and statistics of column encodings, as analytics over a table.

Each function takes the columns that name a block (``keys``), the column that orders it, and a value column, and works
with windows and aggregates per block; only the XOR window, whose state depends on all values before, runs in Python,
one block at a time.
"""

from __future__ import annotations

import enum
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import InvalidArgumentError, UnsupportedError
from ..types import DataType

#: Deltas that share a minimum and a bit width.
GROUP = 128
WIDE = "decimal(38,0)"


class Encoding(enum.IntEnum):
    PLAIN = 0
    DELTA_BIT_PACK = 1
    DELTA_OF_DELTA = 2
    RLE = 3
    XOR = 4
    DICTIONARY = 5

    @property
    def label(self) -> str:
        return {1: "delta-bitpack", 2: "delta-of-delta"}.get(int(self), self.name.lower())

    @classmethod
    def from_code(cls, code: int) -> Encoding:
        try:
            return cls(code)
        except ValueError:
            raise UnsupportedError(f"unknown encoding code {code}") from None

    @classmethod
    def candidates(cls, type: DataType | None) -> tuple[Encoding, ...]:
        """What fits a type (None: time stamps), the classic one first; earlier ones win ties."""
        if type is None:
            return (cls.DELTA_OF_DELTA, cls.DELTA_BIT_PACK, cls.PLAIN)
        if type is DataType.BOOL:
            return (cls.RLE, cls.PLAIN)
        if type.is_int:
            return (cls.DELTA_BIT_PACK, cls.RLE, cls.PLAIN)
        return (cls.XOR if type.is_float else cls.DICTIONARY, cls.PLAIN)


class EncodingPolicy(enum.Enum):
    ADAPTIVE = "adaptive"
    CLASSIC = "classic"
    PLAIN = "plain"

    @classmethod
    def parse(cls, value) -> EncodingPolicy:
        if isinstance(value, cls):
            return value
        try:
            return cls(str(value).lower())
        except ValueError:
            raise InvalidArgumentError(f"unknown encoding policy {value!r}") from None

    def candidates(self, type: DataType | None) -> tuple[Encoding, ...]:
        every = Encoding.candidates(type)
        return {"adaptive": every, "classic": every[:1], "plain": (Encoding.PLAIN,)}[self.value]


# ---- scalars


def zigzag(x: Column) -> Column:
    """Signed to unsigned, small sizes to small numbers; as 64 bits."""
    return F.shiftleft(x, 1).bitwiseXOR(F.shiftright(x, 63))


def bit_length(x: Column) -> Column:
    """Of 64 bits taken as unsigned; 0 for 0."""
    return F.when(x == 0, F.lit(0)).otherwise(F.length(F.bin(x)))


def varint_length(x: Column) -> Column:
    """Bytes of an unsigned number in groups of seven bits."""
    return F.greatest(F.lit(1), F.ceil((bit_length(x)) / F.lit(7))).cast("long")


def wrapped(x: Column) -> Column:
    """A decimal reduced to signed 64 bits."""
    half, full = F.lit(str(2**63)).cast(WIDE), F.lit(str(2**64)).cast(WIDE)
    return (F.pmod(x + half, full) - half).cast("long")


def ceil8(bits: Column) -> Column:
    return F.ceil(bits / F.lit(8)).cast("long")


def _minus(a: Column, b: Column) -> Column:
    return wrapped(a.cast(WIDE) - b.cast(WIDE))


# ---- blocks and deltas


def blocks(rows: DataFrame, keys: Sequence[str], order: str, size: int) -> DataFrame:
    """``rows`` with ``block``: runs of ``size`` rows per key in order.

    The rows of a key are numbered in one task; for keys with very many rows take :func:`time_blocks`.
    """
    place = F.row_number().over(W.partitionBy(*keys).orderBy(order)) - 1
    return rows.withColumn("block", F.floor(place / F.lit(size)).cast("long"))


def time_blocks(rows: DataFrame, order: str, span: int) -> DataFrame:
    """``rows`` with ``block``: equal spans of the order column; needs no shuffle, so any number of rows will do."""
    at = F.col(order)
    return rows.withColumn("block", F.call_function("div", at - F.pmod(at, F.lit(span)), F.lit(span)).cast("long"))


def deltas(rows: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """``rows`` with ``pos`` (from 0), ``delta`` and ``dod``, the delta of deltas; all modulo 2 to the 64."""
    w = W.partitionBy(*keys).orderBy(order)
    out = rows.withColumn("pos", F.row_number().over(w) - 1).withColumn("delta", _minus(F.col(value), F.lag(value).over(w)))
    return out.withColumn("dod", _minus(F.col("delta"), F.lag("delta").over(w)))


def undelta(rows: DataFrame, keys: Sequence[str], order: str, first: str, delta: str) -> DataFrame:
    """``rows`` with ``value`` restored: the first value and the running sum of deltas, modulo 2 to the 64."""
    w = W.partitionBy(*keys).orderBy(order)
    start = F.first(first).over(w.rowsBetween(W.unboundedPreceding, 0))
    run = F.sum(F.coalesce(F.col(delta), F.lit(0)).cast("decimal(20,0)")).over(w.rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("value", wrapped(start.cast(WIDE) + run.cast(WIDE)))


def dod_bits(dod: Column) -> Column:
    """Bits of a delta of deltas: prefix and payload by the size of its zigzag."""
    n = bit_length(zigzag(dod))
    return F.when(n == 0, F.lit(1)).when(n <= 8, F.lit(10)).when(n <= 16, F.lit(19)).when(n <= 32, F.lit(36)).otherwise(F.lit(68))


def delta_of_delta_size(rows: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """``keys, n, dod_bits, bytes``."""
    d = deltas(rows, keys, order, value)
    head = F.sum(F.when(F.col("pos") == 0, varint_length(zigzag(F.col(value)))).when(F.col("pos") == 1, varint_length(zigzag(F.col("delta")))).otherwise(F.lit(0)))
    bits = F.coalesce(F.sum(F.when(F.col("pos") >= 2, dod_bits(F.col("dod")))), F.lit(0)).cast("long")
    return d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), bits.alias("dod_bits"), (head + ceil8(bits)).cast("long").alias("bytes"))


def bitpack_groups(rows: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """``keys, grp, n, low, width, bytes`` of each group of deltas."""
    d = deltas(rows, keys, order, value).filter("pos >= 1").withColumn("grp", F.floor((F.col("pos") - 1) / F.lit(GROUP)).cast("long"))
    g = d.groupBy(*keys, "grp").agg(F.count(F.lit(1)).alias("n"), F.min("delta").alias("low"), F.max("delta").alias("high"))
    width = bit_length(_minus(F.col("high"), F.col("low"))).cast("int")
    return g.withColumn("width", width).withColumn("bytes", varint_length(zigzag(F.col("low"))) + 1 + ceil8(F.col("n") * F.col("width"))).drop("high")


def delta_bitpack_size(rows: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """``keys, n, bytes``."""
    groups = bitpack_groups(rows, keys, order, value).groupBy(*keys).agg(F.sum("bytes").alias("g"))
    first = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min_by(value, order).alias("v"))
    return first.join(groups, list(keys), "left").select(*keys, "n", (varint_length(zigzag(F.col("v"))) + F.coalesce("g", F.lit(0))).cast("long").alias("bytes"))


# ---- runs, dictionaries, plain


def runs(rows: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """``keys, run, start, length, value``: runs of equal values; ``run`` counts from 0, ``start`` is the first place."""
    w = W.partitionBy(*keys).orderBy(order)
    before = F.lag(value).over(w)
    place = F.row_number().over(w) - 1
    new = F.when((place == 0) | ~F.col(value).eqNullSafe(before), 1).otherwise(0)
    marked = rows.withColumn("__place", place).withColumn("__new", new).withColumn("run", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)) - 1)
    return marked.groupBy(*keys, "run").agg(F.min("__place").alias("start"), F.count(F.lit(1)).alias("length"), F.first(value).alias("value"))


def expand_runs(run_rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, pos, value`` from runs."""
    return run_rows.select(*keys, F.explode(F.sequence(F.col("start").cast("long"), F.col("start").cast("long") + F.col("length") - 1)).alias("pos"), "value")


def rle_size(rows: DataFrame, keys: Sequence[str], order: str, value: str, boolean: bool = False) -> DataFrame:
    """``keys, runs, bytes``: a length and a value per run; a boolean's value is one byte."""
    per = varint_length(F.col("length")) + (F.lit(1) if boolean else varint_length(zigzag(F.col("value").cast("long"))))
    return runs(rows, keys, order, value).groupBy(*keys).agg(F.count(F.lit(1)).alias("runs"), F.sum(per).cast("long").alias("bytes"))


def dictionary_codes(rows: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """``keys, value, code``: distinct values numbered in the order of their first place."""
    first = rows.groupBy(*keys, F.col(value).alias("value")).agg(F.min(order).alias("__first"))
    rank = F.row_number().over(W.partitionBy(*keys).orderBy("__first")) - 1
    return first.withColumn("code", rank).drop("__first")


def _text_bytes(value: Column) -> Column:
    return varint_length(F.octet_length(value).cast("long")) + F.octet_length(value)


def dictionary_size(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``keys, n, distinct, bytes``: the distinct texts, then one code of equal width per row."""
    counts = rows.groupBy(*keys, F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("c"))
    out = counts.groupBy(*keys).agg(F.sum("c").cast("long").alias("n"), F.count(F.lit(1)).alias("distinct"), F.sum(_text_bytes(F.col("value"))).alias("texts"))
    width = bit_length(F.col("distinct") - 1)
    return out.select(*keys, "n", "distinct", (varint_length(F.col("distinct")) + F.col("texts") + ceil8(F.col("n") * width)).cast("long").alias("bytes"))


def plain_size(rows: DataFrame, keys: Sequence[str], value: str, type: DataType | None) -> DataFrame:
    """``keys, bytes`` without encoding (None: time stamps)."""
    if type is DataType.STRING:
        size = F.sum(_text_bytes(F.col(value)))
    elif type is DataType.BOOL:
        size = ceil8(F.count(F.lit(1)))
    else:
        size = F.count(F.lit(1)) * (8 if type is None else type.plain_width)
    return rows.groupBy(*keys).agg(size.cast("long").alias("bytes"))


# ---- XOR of floats


def xor_bits(values: np.ndarray, width: int) -> int:
    """Bits of a block's values: the first whole, then each one's difference from the one before within a window of
    leading and trailing zeros that is kept while it fits."""
    if not len(values):
        return 0
    bits = np.ascontiguousarray(values, f"<f{width // 8}").view(f"<u{width // 8}").tolist()
    field, total, lead, trail = (6 if width == 64 else 5), width, None, None
    for a, b in zip(bits, bits[1:]):
        x = a ^ b
        if not x:
            total += 1
            continue
        left, right = width - x.bit_length(), (x & -x).bit_length() - 1
        total += 2
        if lead is None or left < lead or right < trail:
            lead, trail = left, right
            total += 2 * field
        total += width - lead - trail
    return total


def xor_size(rows: DataFrame, keys: Sequence[str], order: str, value: str, type: DataType = DataType.FLOAT64) -> DataFrame:
    """``keys, n, bits, bytes``; a block at a time, so blocks should be bounded (see :func:`blocks`)."""
    width = 32 if type is DataType.FLOAT32 else 64
    names = list(keys)
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in names)

    def size(pdf: pd.DataFrame) -> pd.DataFrame:
        total = xor_bits(pdf.sort_values(order)[value].to_numpy(), width)
        return pd.DataFrame({**{k: pdf[k].iloc[:1].to_numpy() for k in names}, "n": [len(pdf)], "bits": [total], "bytes": [-(-total // 8)]})

    return rows.filter(F.col(value).isNotNull()).select(*names, order, value).groupBy(*names).applyInPandas(size, f"{kinds}, n long, bits long, bytes long")


# ---- choice and statistics


def encoding_sizes(rows: DataFrame, keys: Sequence[str], order: str, value: str, type: DataType | None, policy="adaptive") -> DataFrame:
    """``keys, encoding, rank, bytes`` of each candidate over the values that are not null."""
    own, out = rows.filter(F.col(value).isNotNull()), []
    if type is not None and type.is_int:
        own = own.withColumn(value, F.col(value).cast("long"))
    for rank, e in enumerate(EncodingPolicy.parse(policy).candidates(type)):
        if e is Encoding.PLAIN:
            sizes = plain_size(own, keys, value, type)
        elif e is Encoding.DELTA_OF_DELTA:
            sizes = delta_of_delta_size(own, keys, order, value)
        elif e is Encoding.DELTA_BIT_PACK:
            sizes = delta_bitpack_size(own, keys, order, value)
        elif e is Encoding.RLE:
            sizes = rle_size(own, keys, order, value, type is DataType.BOOL)
        elif e is Encoding.DICTIONARY:
            sizes = dictionary_size(own, keys, value)
        else:
            sizes = xor_size(own, keys, order, value, type)
        out.append(sizes.select(*keys, F.lit(e.label).alias("encoding"), F.lit(rank).alias("rank"), "bytes"))
    return reduce(DataFrame.unionAll, out)


def choose_encoding(rows: DataFrame, keys: Sequence[str], order: str, value: str, type: DataType | None, policy="adaptive") -> DataFrame:
    """``keys, encoding, bytes``: the smallest candidate, the earlier one on a tie."""
    best = F.min(F.struct("bytes", "rank", "encoding")).alias("best")
    return encoding_sizes(rows, keys, order, value, type, policy).groupBy(*keys).agg(best).select(*keys, "best.encoding", "best.bytes")


def segment_stats(rows: DataFrame, keys: Sequence[str], value: str, type: DataType | None) -> DataFrame:
    """``keys, rows, nulls, min, max``: of values that are not null; NaN is left out, texts have no bounds."""
    v = F.col(value)
    if type is DataType.STRING:
        low = high = F.lit(None).cast("double")
    else:
        own = F.when(~F.isnan(v), v) if type is not None and type.is_float else v.cast("int") if type is DataType.BOOL else v
        low, high = F.min(own).cast("double"), F.max(own).cast("double")
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.count_if(v.isNull()).alias("nulls"), low.alias("min"), high.alias("max"))
