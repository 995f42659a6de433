import datetime as dt
import io

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

import tsledger as ts
from tsledger.cli import main
from tsledger.sources import adapters, text
from tsledger.types import DataType, TimeUnit


def test_time_columns():
    assert adapters.guess_time_column(["v", "Time", "ts"]) == "Time" and adapters.guess_time_column(["a", "b"], ["b"]) == "b"
    with pytest.raises(ts.InvalidArgumentError):
        adapters.guess_time_column(["a"])
    s = adapters.normalize({"time": ["2026-10-08T10:00:00+03:00", "2026-10-08T10:00:00.5+03:00"], "v": [1, 2.5]})
    assert (s.device_unit, s.timezone, s.naive) == (TimeUnit.MILLISECOND, "+03:00", False) and s.columns[0].type is DataType.FLOAT64
    with pytest.raises(ts.UnsupportedError):
        adapters.normalize({"time": ["2026-10-08", "2026-10-08T10:00Z"], "v": [1, 2]})
    with pytest.raises(ts.UnsupportedError):
        adapters.normalize({"time": [1, 2], "v": [1, "x"]})
    with pytest.raises(ts.UnsupportedError):
        adapters.infer_device("d", adapters.normalize({"time": [1], "v": [1]}))
    with pytest.raises(ts.UnsupportedError):
        adapters.infer_device("d", adapters.normalize({"time": [1], "v": [None]}), "s")
    with pytest.raises(TypeError):
        adapters.normalize(5)
    d = adapters.normalize({"date": [dt.date(1970, 1, 2)], "v": [True]})
    assert d.time.tolist() == [86400 * 10**9] and d.columns[0].type is DataType.BOOL


def test_pandas_and_arrow_sources():
    index = pd.date_range("2026-01-01", periods=3, freq="h", tz="Europe/Berlin", name="when")
    f = pd.DataFrame({"a": [1.0, np.nan, 3.0], "b": pd.Categorical(["x", None, "y"]), "c": np.array([1, 2, 3], np.int8), "d": [True, None, False]}, index=index)
    s = adapters.normalize(f)
    assert s.time_name == "when" and s.timezone == "Europe/Berlin" and [c.type for c in s.columns] == [DataType.FLOAT64, DataType.STRING, DataType.INT32, DataType.BOOL]
    assert s.columns[0].values.null_count == 1 and s.columns[1].values.to_pylist() == ["x", None, "y"]
    t = pa.table({"ts": pa.array([1, 2], pa.timestamp("ms", "UTC")), "x": pa.array([1.5, float("nan")], pa.float16()), "u": pa.array([1, 2], pa.uint32())})
    s = adapters.normalize(t)
    assert s.unit is TimeUnit.MILLISECOND and [c.type for c in s.columns] == [DataType.FLOAT32, DataType.INT64] and s.columns[0].values.null_count == 0
    assert adapters.normalize(t.to_reader()).time.tolist() == [1, 2] and len(list(adapters.iter_source(t.to_reader(max_chunksize=1)))) == 2
    with pytest.raises(ts.UnsupportedError):
        adapters.normalize(pa.table({"ts": pa.array([1], pa.timestamp("s")), "t2": pa.array([1], pa.timestamp("s"))}), "ts")


def test_units_zones_and_casts():
    assert adapters.convert_unit(np.array([1500]), TimeUnit.MILLISECOND, TimeUnit.MICROSECOND).tolist() == [1500000]
    for values, a, b in (([1500], "ms", "s"), ([2**60], "s", "ms")):
        with pytest.raises(ts.UnsupportedError):
            adapters.convert_unit(np.array(values), TimeUnit.parse(a), TimeUnit.parse(b))
    wall = np.array([0, 90 * 10**9], np.int64)
    assert adapters.localize(wall, "Europe/Moscow").tolist() == [-3 * 3600 * 10**9, -3 * 3600 * 10**9 + 90 * 10**9]
    c = lambda v, t: adapters.SourceColumn("x", t, pa.array(v))
    assert adapters.cast_column(c([1.0, None], DataType.FLOAT64), DataType.INT32).to_pylist() == [1, None]
    assert adapters.cast_column(c([1, 2], DataType.INT64), DataType.FLOAT32).to_pylist() == [1.0, 2.0]
    for values, source, target in (([1.5], DataType.FLOAT64, DataType.INT32), ([2**40], DataType.INT64, DataType.INT32), ([True], DataType.BOOL, DataType.INT32), (["1"], DataType.STRING, DataType.INT64), ([float("nan")], DataType.FLOAT64, DataType.INT64)):
        with pytest.raises(ts.TypeMismatchError):
            adapters.cast_column(c(values, source), target)


def test_batches():
    s = ts.device_schema("d", "s", {"x": "double", "s": "string"})
    b = ts.Batch([1, 2, 3], {"x": ts.Column.from_values("double", [1, None, float("nan")]), "s": ts.Column.from_values("string", ["a", "b", None])}, s)
    assert b == b.take([0, 1, 2]) and b != b.take([0, 2, 1]) and b.slice(1, 3).times.tolist() == [2, 3] and b["x"].null_count == 1
    assert ts.Column.from_values("double", [0.0]) != ts.Column.from_values("double", [-0.0]) and ts.Column.from_values("double", [float("nan")]) == ts.Column.from_values("double", [float("nan")])
    assert b.row(0) == {"x": 1.0, "s": "a"} and b.to_dict()["time"] == [1, 2, 3] and b.select(["s"]).names == ["s"] and len(list(b["x"].dense())) == 2
    assert ts.Batch.concat([b, b]).times.tolist() == [1, 2, 3] * 2 and len(ts.Batch.empty(s.types, s)) == 0
    assert b.to_arrow().schema.field("time").type == pa.timestamp("s") and b.to_arrow().schema.metadata[b"device"] == b"d"
    p = b.to_pandas(dtype_backend="numpy_nullable")
    assert p["x"].isna().tolist() == [False, True, False] or p["x"].isna().tolist() == [False, True, True]
    for t, v in (("int32", 2**31), ("int32", 1.5), ("bool", 1), ("string", 1), ("int64", True)):
        with pytest.raises(ts.TypeMismatchError):
            ts.Column.from_values(t, [v])


def test_write_tables(spark, tmp_path):
    path = str(tmp_path / "s")
    ts.write(path, {"time": [3, 1, 3], "v": [1, 2, 30]}, "d", unit="s", spark=spark)
    assert ts.read(path, spark=spark).to_dict() == {"time": [1, 3], "v": [2, 30]}
    with pytest.raises(FileExistsError):
        ts.write(path, {"time": [1], "v": [1]}, "d", unit="s", mode="x", spark=spark)
    frame = spark.createDataFrame([(5, 1, 1), (5, 2, 2), (6, 3, 1)], "time long, v long, at long")
    f = ts.open(path, spark)
    with pytest.raises(ts.InvalidArgumentError):
        f.write(frame.drop("at"), "d", unit="s")
    assert f.head.number == 1 and not f.reader().catalog.unreferenced()
    f.write(frame, "d", unit="s", order_by="at")
    assert f.read().to_dict()["v"] == [2, 30, 2, 3]
    with pytest.raises(Exception, match="int64 does not hold"):
        f.write(spark.createDataFrame([(9, 1.5)], "time long, v double"), "d", unit="s")
    f.write(spark.createDataFrame([(9, 4.0)], "time long, v double"), "d", unit="s")
    with pytest.raises(ts.UnknownColumnError):
        f.write({"time": [1], "w": [1]}, "d", unit="s")
    stamps = spark.sql("select timestamp '2026-01-01 00:00:00' as at, 1.5d as x")
    g = ts.open(path, spark)
    g.write(stamps, "e")
    assert g.read("e").times.tolist() == [1767225600 * 10**6]
    assert g.read_batches("d").read_all().num_rows == 5 and g.read_arrow("e").num_rows == 1
    view = g.query("d").view("points")
    assert spark.sql("select max(v) from points").first()[0] == 30 and view.columns == ["t", "v"]


CSV = """when,temperature,humidity,ok,state,n
2026-10-08T10:00:00+03:00,21.5,40,true,warm,null
2026-10-08T10:01:00+03:00,,41,false,,1
2026-10-08T10:01:00+03:00,22,42,true,"a,b",2
"""


def test_csv_and_cli(spark, tmp_path, capsys):
    source, path = tmp_path / "room1.csv", str(tmp_path / "s")
    source.write_text(CSV)
    assert main(["convert", str(source), path]) == 0
    f = ts.open(path, spark)
    d = f.device()
    assert d.name == "room1" and d.timezone == "+03:00" and d.time_unit is TimeUnit.MILLISECOND
    assert [c.type.label for c in d.columns] == ["float64", "int64", "bool", "string", "string"]
    assert f.read()["temperature"].to_list() == [21.5, 22.0] and f.read()["state"].to_list() == ["warm", "a,b"]
    capsys.readouterr()
    assert main(["cat", path, "--limit", "1"]) == 0
    assert capsys.readouterr().out == "when,temperature,humidity,ok,state,n\n2026-10-08T10:00:00.000+03:00,21.5,40,true,warm,null\n"
    assert main(["insert", path, "--time", "2026-10-08T11:00:00+03:00", "ok=yes", "humidity=null"]) == 0
    assert main(["update", path, "--time", "2026-10-08T11:00:00+03:00", "humidity=9", "--message", "up"]) == 0
    assert main(["delete", path, "--to", "2026-10-08T10:00:30+03:00"]) == 0
    assert main(["annotate", path, "--start", "2026-10-08T10:00:00+03:00", "--label", "x"]) == 0
    assert main(["annotations", path]) == 0 and main(["log", path]) == 0 and main(["diff", path, "--from", "1"]) == 0 and main(["info", path]) == 0
    out = capsys.readouterr().out
    assert "commit 5" in out and "humidity" in out and "bit/point" in out and "- 2026-10-08T10:00:00" in out
    assert main(["cat", path, "--format", "json", "--raw-time"]) == 0 and '"humidity": 9' in capsys.readouterr().out
    assert main(["cat", path, "--format", "table", "--columns", "ok"]) == 0 and "true" in capsys.readouterr().out
    assert main(["verify", path]) == 0 and main(["compact", path, str(tmp_path / "c")]) == 0 and main(["recover", path]) == 0
    assert main(["convert", path, str(tmp_path / "out.csv")]) == 0 and (tmp_path / "out.csv").read_text().startswith("when,")
    for bad in (["cat", path, "--columns", "zz"], ["delete", path], ["update", path, "--time", "1", "ok=1"], ["cat", str(tmp_path / "no")], ["insert", path, "--time", "x", "ok=1"], ["unannotate", path, "77"], ["convert", str(source), path]):
        assert main(bad) == 2, bad
        assert "Traceback" not in capsys.readouterr().err


def test_csv_rules(spark, tmp_path):
    def read(content, **options):
        (tmp_path / "x.csv").write_text(content)
        return text.read_csv(spark, str(tmp_path / "x.csv"), **options)

    frame, name, unit, n = read("t,v\n1700000000,1\n1700000001,x\n")
    assert (name, unit, n) == ("t", "s", 2) and frame.schema["v"].dataType.simpleString() == "string"
    for bad in ("", "t,t\n1,2\n", "t,v\n1\n", "t,v\n1,2,3\n", "t,v\n,2\n"):
        with pytest.raises(ts.InvalidArgumentError):
            read(bad)
    with pytest.raises(ts.InvalidArgumentError):
        read("t,v\n1,2\n", time_column="z")
    assert [text.type_of_counts(*c).label for c in ((1, 0, 0, 0), (0, 1, 0, 0), (0, 1, 1, 0), (1, 1, 0, 0), (0, 0, 0, 0))] == ["bool", "int64", "float64", "string", "string"]
    out = io.StringIO()
    schema = ts.device_schema("d", "s", {"v": "double"})
    assert text.export_json(spark.createDataFrame([(1, 2.5)], "t long, v double"), schema, out) == 1 and out.getvalue() == '{"time": "1970-01-01T00:00:01Z", "v": 2.5}\n'
