import datetime as dt

import pytest

from tsledger import DataType, DeviceSchema, InvalidArgumentError, SchemaError, TimeUnit, UnknownColumnError, device_schema, format_time, to_datetime, to_raw
from tsledger import errors
from tsledger.functions import timeconv


def test_names_of_types():
    assert DataType.parse("float") is DataType.FLOAT32 and DataType.parse("int") is DataType.INT32
    assert DataType.parse(float) is DataType.FLOAT64 and DataType.parse("utf8") is DataType.STRING
    assert [t.label for t in DataType] == ["bool", "int32", "int64", "float32", "float64", "string"]
    with pytest.raises(InvalidArgumentError):
        DataType.parse("decimal")
    assert TimeUnit.parse("µs") is TimeUnit.MICROSECOND and TimeUnit.parse("s").nanos == 10**9


def test_schema_rules():
    s = device_schema("d", "ms", {"x": "double", "n": "int"}, timezone="+03:00")
    assert s.column_names == ["x", "n"] and s.column_index("n") == 1 and s.column_index("y") is None
    assert s.with_column("y", "bool").column_names == ["x", "n", "y"]
    assert DeviceSchema.from_json(s.to_json()) == s
    assert s.same_layout(device_schema("e", "ms", {"x": "f64", "n": "i32"}))
    assert not s.same_layout(device_schema("d", "s", {"x": "f64", "n": "i32"}))
    for bad in (device_schema("", "s", {"x": "int"}), device_schema("d", "s", {}), device_schema("d", "s", {"time": "int"}), device_schema("d", "s", {"": "int"})):
        with pytest.raises(SchemaError):
            bad.validate()
    with pytest.raises(InvalidArgumentError):
        device_schema("d", "s", {"x": "int"}, timezone="Mars/Base").validate()


def test_errors_keep_their_builtins():
    assert issubclass(errors.UnknownDeviceError, KeyError) and issubclass(errors.TypeMismatchError, TypeError)
    assert issubclass(errors.InvalidArgumentError, ValueError) and issubclass(errors.PointNotFoundError, KeyError)
    assert str(UnknownColumnError("d", "x")) == "device 'd' has no column 'x'"


@pytest.mark.parametrize(
    "value, unit, tz, rounding, raw",
    [
        ("2026-10-08T10:00:00+03:00", "s", None, "floor", 1791442800),
        ("2026-10-08 10:00:00", "ms", "Europe/Moscow", "floor", 1791442800000),
        ("2026-10-08", "s", None, "floor", 1791417600),
        ("1970-01-01 00:00:01,123456789", "ms", None, "floor", 1123),
        ("1970-01-01 00:00:01.123456789", "ms", None, "ceil", 1124),
        ("2026-10-25 02:30", "s", "Europe/Berlin", "floor", 1792888200),
        (dt.date(1970, 1, 2), "s", None, "floor", 86400),
        (dt.datetime(1970, 1, 1, 3, tzinfo=dt.timezone(dt.timedelta(hours=3))), "s", None, "exact", 0),
        (17, "ns", "UTC", "exact", 17),
    ],
)
def test_to_raw(value, unit, tz, rounding, raw):
    assert to_raw(value, unit, tz, rounding) == raw


def test_to_raw_refuses():
    for value, tz in (("2026-03-29 02:30", "Europe/Berlin"), ("yesterday", None), ("2026-13-01", None), ("2026-10-08T10", None)):
        with pytest.raises(InvalidArgumentError):
            to_raw(value, "s", tz)
    with pytest.raises(InvalidArgumentError):
        to_raw("1970-01-01 00:00:00.5", "s", None, "exact")
    with pytest.raises(TypeError):
        to_raw(True, "s")


def test_format():
    assert format_time(1, "ns") == "1970-01-01T00:00:00.000000001Z"
    assert format_time(-1, "s") == "1969-12-31T23:59:59Z"
    assert format_time(1791442800500, "ms", "+03:00") == "2026-10-08T10:00:00.500+03:00"
    assert to_datetime(0, "s") == dt.datetime(1970, 1, 1) and to_datetime(0, "s", "+02:00").utcoffset() == dt.timedelta(hours=2)


@pytest.fixture(params=["UTC", "America/New_York"])
def zone(request, spark):
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_columns_agree_with_values(spark, zone):
    from pyspark.sql import functions as F

    stamps = [0, 1, -1, 1710037800000, 1710041400000, 1791442800500, -1791442800501, 1792888200000, 1774746000000]
    frame = spark.createDataFrame([(x,) for x in stamps], "t long")
    for unit in ("s", "ms", "us", "ns"):
        for tz in (None, "Europe/Berlin", "-03:30", "UTC"):
            got = {r[0]: r[1] for r in frame.filter(F.lit(unit != "s") | (F.abs("t") < 10**11)).select("t", timeconv.format_column(F.col("t"), unit, tz)).collect()}
            assert got == {t: format_time(t, unit, tz) for t in got}
    texts = ["2026-10-08T10:00:00+03:00", "2026-10-08 10:00", "2026-10-08", "1970-01-01 00:00:01,123456789", "2026-10-25 02:30", "1969-12-31T23:59:59.5Z", "2026-01-01 00:00 -0330"]
    frame = spark.createDataFrame([(x,) for x in texts], "x string")
    for tz in (None, "Europe/Berlin", "+05:30"):
        got = {r[0]: r[1] for r in frame.select("x", timeconv.parse_column(F.col("x"), tz)).collect()}
        assert got == {x: timeconv.text_nanos(x, tz) for x in texts}
    for bad in ("yesterday", "2026-03-29 02:30"):
        with pytest.raises(Exception, match="time|skipped"):
            spark.createDataFrame([(bad,)], "x string").select(timeconv.parse_column(F.col("x"), "Europe/Berlin")).collect()


def test_units_in_columns(spark):
    from pyspark.sql import functions as F

    frame = spark.createDataFrame([(-7,), (7,), (2000,)], "t long")
    got = frame.select(timeconv.convert_units(F.col("t"), "ms", "s", "floor"), timeconv.convert_units(F.col("t"), "ms", "s", "ceil"), timeconv.convert_units(F.col("t"), "ms", "us")).collect()
    assert [tuple(r) for r in got] == [(-1, 0, -7000), (0, 1, 7000), (2, 2, 2000000)]
    with pytest.raises(Exception, match="finer than the unit"):
        frame.select(timeconv.convert_units(F.col("t"), "ms", "s")).collect()
    with pytest.raises(Exception, match="(?i)overflow"):
        spark.createDataFrame([(2**62,)], "t long").select(timeconv.convert_units(F.col("t"), "s", "ns")).collect()
    assert frame.agg(timeconv.guess_unit(F.col("t") * 10**12)).first()[0] == "us"
