"""From text times to a compacted store, as a user would go."""

import pytest

import tsledger as ts


def test_days_of_a_room(spark, tmp_path):
    path = str(tmp_path / "room")
    minutes = [f"2026-10-{d:02d}T{m // 60:02d}:{m % 60:02d}:00+03:00" for d in (8, 9) for m in range(0, 1440, 10)]
    half = len(minutes) // 2
    ts.write(path, {"when": minutes[:half], "temperature": [20 + k % 7 / 10 for k in range(half)]}, "room1", time_column="when", message="day one", spark=spark)
    f = ts.open(path, spark)
    d = f.device()
    assert (d.time_name, d.timezone, d.time_unit.label) == ("when", "+03:00", "ms")
    f.write({"when": minutes[half:], "temperature": [21.0] * half}, "room1", message="day two")
    assert f.count() == 2 * half and f.count(start="2026-10-09", end="2026-10-09 23:59") == half
    with f.edit("repair", "me") as tx:
        tx.update("room1", "2026-10-08 10:00", temperature=19.5)
        tx.delete_range("room1", "2026-10-09 12:00", "2026-10-09 13:00")
        tx.annotate("room1", "2026-10-08 09:00", "2026-10-08 11:00", "window open")
        tx.set_metadata("place", "hall")
    assert f.count() == 2 * half - 7 and f.count(as_of=2) == 2 * half
    found = f.diff(2, 3)
    assert [p.kind for p in found.points].count("removed") == 7 and found.annotations[0].after.label == "window open"
    assert f.labelled().filter("label is not null").count() == 13
    with pytest.raises(ts.InvalidArgumentError):
        f.to_raw("2026-10-08 10:00:00.0005", rounding="exact")
    assert str(f.to_datetime(f.to_raw("2026-10-08 10:00"))) == "2026-10-08 10:00:00+03:00"
    g = f.compact(str(tmp_path / "small"))
    assert g.read() == f.read() and g.metadata["place"] == "hall" and len(g.commits()) == 1
    p = g.read_pandas(columns=["temperature"], start="2026-10-08 10:00", end="2026-10-08 10:00")
    assert p["temperature"].tolist() == [19.5] and str(p.index[0]) == "2026-10-08 10:00:00+03:00"


def test_several_devices(spark, tmp_path):
    path = str(tmp_path / "many")
    frame = spark.range(300).selectExpr("id as time", "cast(id % 5 as float) as cpu", "id * 2 as ram", "cast(id as string) as state", "id % 2 = 0 as up")
    w = ts.Writer.create(path, spark=spark)
    for k in range(3):
        w.write_table(f"vm{k}", frame.filter(f"time % 3 = {k}"), unit="s", create=True)
    w.annotate("vm1", 0, 10, "a")
    second = w.annotate("vm1", 5, 15, "b")
    w.commit()
    w.remove_annotation(second)
    assert w.annotate("vm2", 1, 1, "c") == 3
    w.commit()
    w.close()
    f = ts.open(path, spark)
    assert list(f.devices) == ["vm0", "vm1", "vm2"] and [f.count(d) for d in f.devices] == [100] * 3 and f.head.changes.annotation_ops == 2
    assert [a.id for a in f.annotations()] == [1, 3] and [a.id for a in f.annotations("vm1", as_of=1)] == [1, 2]
    with pytest.raises(ts.InvalidArgumentError):
        f.read()
    with pytest.raises(ts.UnknownDeviceError):
        f.read("vm9")
    assert f.reader().segments("vm0").filter("column = 'state'").first().rows == 100
    assert f.read("vm2", columns=["up", "cpu"]).slice(0, 2).to_dict() == {"time": [2, 5], "up": [True, False], "cpu": [2.0, 0.0]}
    batches = list(f.query("vm0").batches(30))
    assert [len(b) for b in batches] == [30, 30, 30, 10] and ts.Batch.concat(batches) == f.read("vm0")
