"""CSV, JSON lines and text tables."""

from __future__ import annotations

import csv
import json
import os
from collections.abc import Iterable, Iterator
from typing import TextIO

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidArgumentError, TypeMismatchError
from ..functions import timeconv
from ..types import DataType, DeviceSchema


def parse_cell(name: str, type: DataType, text: str):
    """A cell from a command line: empty and ``null`` are null; bools are true/false, yes/no, 1/0."""
    if text in ("", "null"):
        return None
    try:
        if type is DataType.BOOL:
            return {"true": True, "yes": True, "1": True, "false": False, "no": False, "0": False}[text.lower()]
        return text if type is DataType.STRING else int(text) if type.is_int else float(text)
    except (KeyError, ValueError):
        raise TypeMismatchError(f"{text!r} is not a value of column {name!r} of type {type}") from None


def format_cell(value) -> str:
    if value is None:
        return ""
    return str(value).lower() if isinstance(value, bool) else repr(value) if isinstance(value, float) else str(value)


def kind_counts(c: Column, name: str) -> list[Column]:
    """Aggregates that tell a text column's type: how many cells are bools, whole numbers, numbers, anything else."""
    some = c.isNotNull() & (c != "")
    low = F.lower(c)
    is_bool = low.isin("true", "false")
    is_int = F.trim(c).rlike(r"^[+-]?\d+$")
    is_float = F.trim(low).rlike(r"^[+-]?(\d+\.?\d*([e][+-]?\d+)?|\.\d+([e][+-]?\d+)?|inf|infinity|nan)$") & ~is_int
    other = ~is_bool & ~is_int & ~is_float
    return [F.count_if(some & kind).alias(f"{name}_{k}") for k, kind in (("b", is_bool), ("i", is_int), ("f", is_float), ("s", other))]


def type_of_counts(b: int, i: int, f: int, s: int) -> DataType:
    if s or not (b or i or f) or (b and (i or f)):
        return DataType.STRING
    return DataType.BOOL if b else DataType.FLOAT64 if f else DataType.INT64


def infer_types(frame: DataFrame, names: Iterable[str]) -> dict[str, DataType]:
    """Types of text columns, in one aggregate."""
    names = list(names)
    if not names:
        return {}
    row = frame.agg(*(x for k, n in enumerate(names) for x in kind_counts(F.col(f"`{n}`"), f"c{k}"))).first()
    return {n: type_of_counts(*(row[f"c{k}_{x}"] for x in "bifs")) for k, n in enumerate(names)}


def read_csv(spark: SparkSession, path: str, time_column: str | None = None, unit: str | None = None, delimiter: str = ",") -> tuple[DataFrame, str, str | None, int]:
    """A typed frame with ``ord``, the time column's name, its unit (None: texts) and the number of rows.

    All cells are read as texts; one aggregate finds ragged lines, empty times and the types of all columns.
    """
    reader = spark.read.option("sep", delimiter).option("quote", '"').option("escape", '"').option("multiLine", True)
    # the header line alone says how many fields a line has
    first = spark.read.text(path, lineSep="\n").limit(1).collect()
    if not first or not first[0][0].strip("\ufeff\r "):
        raise InvalidArgumentError(f"{path} is empty")
    header = next(csv.reader([first[0][0].lstrip("\ufeff").rstrip("\r")], delimiter=delimiter))
    if len(set(header)) != len(header):
        raise InvalidArgumentError("the CSV header has duplicate column names")
    time_name = time_column or header[0]
    if time_name not in header:
        raise InvalidArgumentError(f"the CSV has no column {time_name!r}")
    own = [f"c{k}" for k in range(len(header))]
    shape = T.StructType([T.StructField(c, T.StringType()) for c in [*own, "_bad"]])
    cells = reader.option("header", True).option("enforceSchema", True).option("columnNameOfCorruptRecord", "_bad").schema(shape).csv(path)
    cells = cells.withColumn("ord", F.monotonically_increasing_id())
    t = f"c{header.index(time_name)}"
    rest = [c for c in own if c != t]
    ragged = F.col("_bad").isNotNull()
    whole = F.col(t).rlike(r"^-*\d+$")
    facts = [F.count(F.lit(1)).alias("n"), F.count_if(ragged).alias("ragged"), F.count_if(~ragged & F.col(t).isNull()).alias("empty"), F.count_if(whole).alias("whole"), timeconv.guess_unit(F.expr(f"try_cast({t} as bigint)")).alias("unit")]
    row = cells.agg(*facts, *(x for c in rest for x in kind_counts(F.col(c), c))).first()
    if row["ragged"]:
        raise InvalidArgumentError(f"{row['ragged']} lines do not have the header's {len(header)} fields")
    if row["empty"]:
        raise InvalidArgumentError("the time column has empty cells")
    types = {c: type_of_counts(*(row[f"{c}_{x}"] for x in "bifs")) for c in rest}
    numeric = row["n"] > 0 and row["whole"] == row["n"]
    names = dict(zip(own, header))
    columns = [(F.col(t).cast("long") if numeric else F.col(t)).alias(time_name)]
    for c in rest:
        text = F.col(c)
        value = F.trim(text).cast(types[c].spark) if types[c] is not DataType.STRING else text
        columns.append(value.alias(names[c]))
    return cells.select(*columns, "ord"), time_name, (unit or row["unit"]) if numeric else None, row["n"]


def import_csv(source: str, target: str, device: str | None = None, time_column: str | None = None, unit: str | None = None, delimiter: str = ",", append: bool = False, force: bool = False, message=None, author=None, spark=None, **options) -> int:
    """A CSV file into a store; gives the number of rows.  Of equal times the later line wins."""
    from ..edit import Writer
    from ..plans.files import Files
    from ..store import session, write

    spark = session(spark)
    there = Files(spark, target).exists()
    if there and not (append or force):
        raise InvalidArgumentError(f"{target} exists; append to it or force it")
    frame, time_name, own, n = read_csv(spark, source, time_column, unit, delimiter)
    if not n and not there:
        raise InvalidArgumentError("the CSV has no rows, so its types are unknown")
    name = device or os.path.splitext(os.path.basename(source))[0] or "device"
    message = message or f"import {os.path.basename(source)}"
    if own is None:
        # texts: the zone and the unit come from the times themselves
        data = _text_times(frame, time_name)
        write(target, data, name, time_column=time_name, mode="a" if append else "w", message=message, author=author, order_by="ord", spark=spark, **options)
    else:
        write(target, frame, name, time_column=time_name, unit=own, mode="a" if append else "w", message=message, author=author, order_by="ord", spark=spark, **options)
    return n


def _text_times(frame: DataFrame, time_name: str):
    """The frame with its texts parsed: a Source whose unit is the coarsest that fits and whose zone is the first
    line's offset."""
    from .adapters import Source, _from_spark, _zone_of_text

    c = F.col(f"`{time_name}`")
    nanos = timeconv.parse_column(c)
    aware = c.rlike(r"([Zz]|\d[+-]\d{2}:?\d{2})$") & c.rlike(r"\d:\d")
    row = frame.agg(timeconv.coarsest_unit(nanos).alias("unit"), F.count_if(aware).alias("aware"), F.count(F.lit(1)).alias("n"), F.min_by(c, "ord").alias("first")).first()
    if 0 < row["aware"] < row["n"]:
        raise InvalidArgumentError("the time column mixes times with and without an offset")
    out: Source = _from_spark(frame, time_name)
    out.columns = [x for x in out.columns if x.name != "ord"]
    from ..types import TimeUnit

    out.device_unit = TimeUnit.parse(row["unit"])
    out.timezone = _zone_of_text(row["first"]) if row["aware"] else None
    out.naive = not row["aware"]
    return out


def rows_of(frame: DataFrame, schema: DeviceSchema, raw_time: bool, limit: int | None) -> Iterator[list]:
    """Rows in the order of time, the time as text; with a limit only the first rows are sorted out."""
    stamp = F.col("t").cast("string") if raw_time else timeconv.format_column(F.col("t"), schema.time_unit, schema.timezone)
    own = frame.orderBy("t")
    if limit is not None:
        own = own.limit(max(0, limit))
    values = [c for c in frame.columns if c != "t"]
    for row in own.select(stamp.alias("__stamp"), *values).toLocalIterator():
        yield list(row)


def export_csv(frame: DataFrame, schema: DeviceSchema, out: TextIO, raw_time: bool = False, delimiter: str = ",", limit: int | None = None) -> int:
    """Write rows to a text stream on the driver; gives their number."""
    writer, n = csv.writer(out, delimiter=delimiter, lineterminator="\n"), 0
    writer.writerow([schema.time_name, *(c for c in frame.columns if c != "t")])
    for stamp, *values in rows_of(frame, schema, raw_time, limit):
        writer.writerow([stamp, *map(format_cell, values)])
        n += 1
    return n


def export_csv_files(frame: DataFrame, schema: DeviceSchema, path: str, raw_time: bool = False, delimiter: str = ",") -> None:
    """The same as a folder of CSV files, in the order of time over the files' names; written by the executors."""
    stamp = F.col("t").cast("string") if raw_time else timeconv.format_column(F.col("t"), schema.time_unit, schema.timezone)
    frame.orderBy("t").select(stamp.alias(schema.time_name), *(c for c in frame.columns if c != "t")).write.option("header", True).option("sep", delimiter).csv(path)


def export_json(frame: DataFrame, schema: DeviceSchema, out: TextIO, raw_time: bool = False, limit: int | None = None) -> int:
    """One JSON object a line."""
    names, n = [c for c in frame.columns if c != "t"], 0
    for stamp, *values in rows_of(frame, schema, raw_time, limit):
        out.write(json.dumps({schema.time_name: int(stamp) if raw_time else stamp, **dict(zip(names, values))}, ensure_ascii=False) + "\n")
        n += 1
    return n


def render_table(header: list[str], rows: Iterable[list]) -> str:
    """Columns padded to their widest cell."""
    cells = [header, *([format_cell(v) for v in r] for r in rows)]
    widths = [max(len(r[k]) for r in cells) for k in range(len(header))]
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(r, widths)).rstrip() for r in cells)
