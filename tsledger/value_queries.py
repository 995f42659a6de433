"""Queries for what works on single values and batches on the driver - times, types, columns, codecs - beside SQL that
states the results or computes them from the same table."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
from pyspark.sql import functions as F

from .errors import LedgerError
from .functions import codecs, encodings, timeconv
from .queries import _table, query
from .sources import adapters, text
from .sources.batch import Batch, Column, convert
from .types import ColumnSchema, DataType, DeviceSchema, TimeUnit


def _said(call) -> str:
    """A result as text, or the kind of error."""
    try:
        out = call()
    except (LedgerError, TypeError, ValueError) as e:
        return f"error: {type(e).__name__}"
    return str(out)


def _cases(name: str, cases, doc: str):
    """Register a query over ``(case, call, expected text)``."""
    sql = "SELECT * FROM (VALUES " + ", ".join(f"({k!r}, {v!r})" for k, _, v in cases).replace('"', "'") + ") v(what, said)"

    def run(spark, sf_dir):
        return spark.createDataFrame([(k, _said(call)) for k, call, _ in cases], "what string, said string")

    run.__doc__ = doc
    return query(name, sql)(run)


# ---- times

_CASES = [
    ("text with offset", lambda: timeconv.to_nanos("2026-10-08T10:00:00.5+03:00"), "1791442800500000000"),
    ("date in a zone", lambda: timeconv.to_nanos("2026-10-08", "Europe/Moscow"), "1791406800000000000"),
    ("datetime", lambda: timeconv.to_nanos(dt.datetime(1970, 1, 1, 0, 0, 1, 5)), "1000005000"),
    ("numpy", lambda: timeconv.to_nanos(np.datetime64("1970-01-01T00:00:00.000000007", "ns")), "7"),
    ("gap", lambda: timeconv.to_nanos("2026-03-29 02:30", "Europe/Berlin"), "error: InvalidArgumentError"),
    ("overlap", lambda: timeconv.format_time(timeconv.to_raw("2026-10-25 02:30", "s", "Europe/Berlin"), "s", "Europe/Berlin"), "2026-10-25T02:30:00+02:00"),
    ("floor", lambda: timeconv.to_raw("1970-01-01T00:00:01.123456789Z", "ms", None, "floor"), "1123"),
    ("ceil", lambda: timeconv.to_raw("1970-01-01T00:00:01.123456789Z", "ms", None, "ceil"), "1124"),
    ("exact", lambda: timeconv.to_raw("1970-01-01T00:00:01.123456789Z", "ms", None, "exact"), "error: InvalidArgumentError"),
    ("raw", lambda: timeconv.to_raw(17, "ms"), "17"),
    ("bool", lambda: timeconv.to_raw(True, "ms"), "error: TypeError"),
    ("to datetime", lambda: timeconv.to_datetime(1_700_000_000_000, "ms", "+03:00").isoformat(), "2023-11-15T01:13:20+03:00"),
    ("naive", lambda: timeconv.to_datetime(-1, "s").isoformat(), "1969-12-31T23:59:59"),
    ("nanos", lambda: timeconv.format_time(1, "ns"), "1970-01-01T00:00:00.000000001Z"),
    ("before 1970", lambda: timeconv.format_time(-1, "s"), "1969-12-31T23:59:59Z"),
    ("no zone", lambda: timeconv.zone("Nowhere/Else"), "error: InvalidArgumentError"),
    ("unit algebra", lambda: [TimeUnit.parse("us").to_nanos(3), TimeUnit.parse("ms").from_nanos(-1), TimeUnit.SECOND.nanos], "[3000, -1, 1000000000]"),
    ("datetime64", lambda: Batch([0, 1500], {}, DeviceSchema("d", "ms", ())).datetimes()[1], "1970-01-01T00:00:01.500"),
    ("coarsest", lambda: [adapters.coarsest_unit(np.array(x)).label for x in ([0, 10**9], [10**6], [1000], [1])], "[ms, ms, us, ns]"),
]
_CASES = [(k, (lambda c=c: str(c()).replace("'", "")) if k == "coarsest" else c, v) for k, c, v in _CASES]
time_values = _cases("time_values", _CASES, "Conversions of single times, and what is refused.")

# ---- types and schemas

_S = DeviceSchema.build("d", "s", {"a": "int", "b": "double"})
type_values = _cases(
    "type_values",
    [
        *((f"type {n}", lambda n=n: DataType.parse(n).label, v) for n, v in (("int", "int32"), ("long", "int64"), ("float", "float32"), ("double", "float64"), ("utf8", "string"), ("bool_", "bool"))),
        ("python type", lambda: DataType.parse(float).label, "float64"),
        ("no type", lambda: DataType.parse("decimal"), "error: InvalidArgumentError"),
        *((f"unit {n}", lambda n=n: TimeUnit.parse(n).label, v) for n, v in (("seconds", "s"), ("µs", "us"), ("MS", "ms"), ("nanosecond", "ns"))),
        ("no unit", lambda: TimeUnit.parse("hour"), "error: InvalidArgumentError"),
        ("build", lambda: " ".join(f"{c.name}:{c.type.label}" for c in _S.columns), "a:int32 b:float64"),
        ("with column", lambda: " ".join(_S.with_column("c", str).column_names), "a b c"),
        ("no columns", lambda: DeviceSchema.build("d", "s", {}).validate(), "error: SchemaError"),
        ("twice", lambda: DeviceSchema("d", "s", [ColumnSchema("a", "int"), ColumnSchema("a", "int")]).validate(), "error: SchemaError"),
        ("time name again", lambda: DeviceSchema.build("d", "s", {"time": "int"}).validate(), "error: SchemaError"),
        ("same layout", lambda: _S.same_layout(DeviceSchema.build("other", "s", {"a": "int32", "b": "f64"}, timezone="UTC")), "True"),
        ("other layout", lambda: _S.same_layout(DeviceSchema.build("d", "ms", {"a": "int32", "b": "f64"})), "False"),
        ("metadata", lambda: DeviceSchema.from_json(DeviceSchema("d", "s", [ColumnSchema("a", "int", {"unit": "K"})]).to_json()).columns[0].metadata["unit"], "K"),
    ],
    "Types, units and schemas from their names, and what is refused.",
)

# ---- values and cells

value_rules = _cases(
    "value_rules",
    [
        ("whole float", lambda: convert(2.0, DataType.INT32), "2"),
        ("float in int", lambda: convert(2.5, DataType.INT32), "error: TypeMismatchError"),
        ("too large", lambda: convert(2**31, DataType.INT32), "error: TypeMismatchError"),
        ("int in float", lambda: convert(3, DataType.FLOAT64), "3.0"),
        ("bool in int", lambda: convert(True, DataType.INT64), "error: TypeMismatchError"),
        ("text in float", lambda: convert("1", DataType.FLOAT64), "error: TypeMismatchError"),
        ("null", lambda: convert(None, DataType.STRING), "None"),
        ("cell bool", lambda: text.parse_cell("a", DataType.BOOL, "yes"), "True"),
        ("cell null", lambda: text.parse_cell("a", DataType.INT32, ""), "None"),
        ("cell float", lambda: text.parse_cell("a", DataType.FLOAT64, "1e3"), "1000.0"),
        ("cell refused", lambda: text.parse_cell("a", DataType.INT32, "1.5"), "error: TypeMismatchError"),
        ("guess time", lambda: adapters.guess_time_column(["a", "Timestamp", "b"]), "Timestamp"),
        ("guess by type", lambda: adapters.guess_time_column(["a", "b"], ["b"]), "b"),
        ("no guess", lambda: adapters.guess_time_column(["a", "b"]), "error: InvalidArgumentError"),
        ("object column", lambda: adapters.object_type(["a", None, "b"], "x").label, "string"),
        ("offset of texts", lambda: adapters.normalize({"time": ["2026-10-08T10:00:00+03:00", "2026-10-08T11:00:00+03:00"], "v": [1, 2]}).timezone, "+03:00"),
        ("inferred", lambda: " ".join(f"{c.name}:{c.type.label}" for c in adapters.infer_device("d", adapters.normalize({"time": ["2026-10-08T10:00:00Z"], "v": [1], "s": ["x"], "ok": [True], "f": [0.5]})).columns), "v:int64 s:string ok:bool f:float64"),
        ("localised", lambda: int(adapters.localize(np.array([0]), "Europe/Moscow")[0]), "-10800000000000"),
        ("units", lambda: adapters.convert_unit(np.array([1, 2]), TimeUnit.SECOND, TimeUnit.MILLISECOND).tolist(), "[1000, 2000]"),
        ("finer unit", lambda: adapters.convert_unit(np.array([1]), TimeUnit.MILLISECOND, TimeUnit.SECOND).tolist(), "error: UnsupportedError"),
        ("table", lambda: len(text.render_table(["t", "v"], [[1, 2.5], [2, None]]).splitlines()), "3"),
    ],
    "Which values fit a type, cells of texts, guesses about sources.",
)


@query(
    "batch_operations",
    """WITH e AS (SELECT event_id, CASE WHEN value > 100 THEN NULL ELSE value END AS v, user_id, event_type FROM events), n AS (SELECT count(*) AS n FROM e)
  SELECT 'rows' AS what, n::double AS result FROM n UNION ALL SELECT 'nulls', count(*) - count(v) FROM e UNION ALL SELECT 'valid', count(v) FROM e
  UNION ALL SELECT 'sum of dense', round(sum(v), 3) FROM e UNION ALL SELECT 'slice', sum(user_id) FROM e WHERE event_id BETWEEN 10 AND 19
  UNION ALL SELECT 'take', sum(user_id) FROM e WHERE event_id IN (5, 7) UNION ALL SELECT 'select', 1 UNION ALL SELECT 'concat', 2 * n FROM n
  UNION ALL SELECT 'equal', 1 UNION ALL SELECT 'not equal', 0 UNION ALL SELECT 'row', user_id FROM e WHERE event_id = 3 UNION ALL SELECT 'dict', n FROM n
  UNION ALL SELECT 'numpy nan', count(*) - count(v) FROM e UNION ALL SELECT 'empty', 0 UNION ALL SELECT 'pandas nulls', count(*) - count(v) FROM e UNION ALL SELECT 'arrow', n FROM n""",
)
def batch_operations(spark, sf_dir):
    """Columns and batches over the events in order, larger values as nulls."""
    e = _table(spark, sf_dir, "events").orderBy("event_id").select("event_id", F.when(F.col("value") <= 100, F.col("value")).alias("v"), "user_id", "event_type").toArrow()
    schema = DeviceSchema.build("events", "s", {"v": "double", "user_id": "long", "event_type": "string"})
    b = Batch(e.column("event_id").to_pylist(), {"v": Column.from_values("double", e.column("v").to_pylist()), "user_id": Column("long", e.column("user_id")), "event_type": Column.from_values("string", e.column("event_type").to_pylist())}, schema)
    v, users = b["v"], b["user_id"]
    rows = [
        ("rows", len(b)), ("nulls", v.null_count), ("valid", v.valid_mask().sum()), ("sum of dense", round(math.fsum(v.dense()), 3)),
        ("slice", sum(b.slice(10, 20)["user_id"])), ("take", sum(users.take([5, 7]))), ("select", len(b.select(["v"]).names)), ("concat", len(Batch.concat([b, b]))),
        ("equal", b == Batch.concat([b.slice(0, 9), b.slice(9, len(b))])), ("not equal", b.take(range(9, -1, -1)) == b.slice(0, 10)), ("row", b.row(3)["user_id"]), ("dict", len(b.to_dict()["time"])),
        ("numpy nan", np.isnan(v.to_numpy()).sum()), ("empty", len(Batch.empty(schema.types, schema))), ("pandas nulls", b.to_pandas("numpy_nullable")["v"].isna().sum()), ("arrow", b.to_arrow().num_rows),
    ]
    return spark.createDataFrame([(k, float(x)) for k, x in rows], "what string, result double")


# ---- codecs

checksums = _cases(
    "checksums",
    [
        ("crc32c check", lambda: codecs.crc32c(b"123456789"), "3808858755"),
        ("crc32c empty", lambda: codecs.crc32c(b""), "0"),
        ("crc32c zeros", lambda: codecs.crc32c(bytes(32)), "2324772522"),
        ("crc32c parts", lambda: codecs.crc32c(b"6789" * 40, codecs.crc32c(b"12345" * 99)) == codecs.crc32c(b"12345" * 99 + b"6789" * 40), "True"),
        ("packed bits", lambda: codecs.unpack_bits(codecs.pack_bits([5, 0, 7, 3], [3] * 4), 3, 4).tolist(), "[5, 0, 7, 3]"),
        ("varint", lambda: codecs.read_varint(codecs.varint(300), 0), "(300, 2)"),
        ("signed varint", lambda: codecs.read_signed(codecs.signed_varint(-65), 0), "(-65, 2)"),
        ("bitmap", lambda: codecs.decode_bitmap(codecs.encode_bitmap(np.array([True, False, True])), 3).tolist(), "[True, False, True]"),
        ("delta of delta", lambda: len(codecs.encode_delta_of_delta(np.arange(1, 101) * 1000)), "17"),
        ("xor", lambda: codecs.decode_xor(codecs.encode_xor(np.array([1.5, 1.5, -2.25]), 64), 3, 64).tolist(), "[1.5, 1.5, -2.25]"),
    ],
    "Checksums of known texts, bit packing, variable-length numbers, small blocks.",
)


def _coded(name: str, column: str, kind: DataType, expression: str, doc: str):
    """Blocks of each user's values, coded with the smallest encoding and read back, nulls in their places."""
    sql = f"SELECT user_id, cast(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS bigint) AS pos, {expression} AS value FROM events"

    def run(spark, sf_dir):
        e = _table(spark, sf_dir, "events").select("user_id", "event_id", F.expr(column).alias("x"))
        return codecs.decode_blocks(codecs.encode_blocks(e, ["user_id"], "event_id", "x", kind), ["user_id"], kind).select("user_id", "pos", "value")

    run.__doc__ = doc
    return query(name, sql)(run)


_coded("coded_floats", "CASE WHEN value <= 100 THEN value END", DataType.FLOAT64, "CASE WHEN value <= 100 THEN value END", "XOR or plain floats with nulls.")
_coded("coded_bools", "CASE WHEN value <= 100 THEN event_type = 'click' END", DataType.BOOL, "CASE WHEN value <= 100 THEN event_type = 'click' END", "Runs or bitmaps of bools with nulls.")
_coded("coded_ints", "CASE WHEN value <= 100 THEN event_id END", DataType.INT64, "CASE WHEN value <= 100 THEN event_id END", "Deltas, runs or plain integers with nulls.")
_coded("coded_texts", "CASE WHEN value <= 100 THEN event_type END", DataType.STRING, "CASE WHEN value <= 100 THEN event_type END", "Dictionary or plain texts with nulls.")


@query("bool_sizes", "WITH r AS (SELECT user_id, event_id, event_type = 'click' AS b, lag(event_type = 'click') OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) SELECT user_id, count(*) FILTER (p IS DISTINCT FROM b) AS runs FROM r GROUP BY user_id")
def bool_sizes(spark, sf_dir):
    """Runs of a flag."""
    e = _table(spark, sf_dir, "events").withColumn("flag", F.col("event_type") == "click")
    return encodings.runs(e, ["user_id"], "event_id", "flag").groupBy("user_id").agg(F.count(F.lit(1)).alias("runs"))


@query("plain_sizes", "SELECT event_type, 8 * count(value) AS bytes FROM events GROUP BY event_type")
def plain_sizes(spark, sf_dir):
    return encodings.plain_size(_table(spark, sf_dir, "events"), ["event_type"], "value", DataType.FLOAT64).select("event_type", "bytes")


@query("to_arrow_columns", "SELECT count(*) AS rows, sum(o_orderkey)::bigint AS keys, count(DISTINCT o_orderstatus) AS states FROM orders")
def to_arrow_columns(spark, sf_dir):
    """A Spark table as a source: normalised, its schema inferred, cast and put into rows."""
    o = _table(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("time"), "o_orderkey", "o_totalprice", "o_orderstatus")
    source = adapters.normalize(o)
    schema = adapters.infer_device("orders", source)
    rows = adapters.to_rows(source, schema, None, spark)
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.sum("o_orderkey").cast("long").alias("keys"), F.count_distinct("o_orderstatus").alias("states"))
