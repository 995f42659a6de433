"""Operators against naive versions, and every registered query against its SQL."""

import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tsledger import DataType, queries, store_queries, value_queries  # noqa: F401
from tsledger.functions import encodings as enc
from tsledger.operators import annotations, history, intervals, ranges, snapshot

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_its_sql(spark, name):
    c = duckdb.connect()
    for t in ("events", "orders", "lineitem"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF).toArrow()
    want = c.sql(queries.ORACLES[name]).to_arrow_table()
    columns = sorted(want.column_names)
    assert sorted(got.column_names) == columns
    assert sorted(map(repr, got.select(columns).to_pylist())) == sorted(map(repr, want.select(columns).to_pylist()))


def test_ranges():
    assert snapshot.bounds(None, None) == (-(2**63), 2**63 - 1) and snapshot.bounds(2, 1) is None and snapshot.bounds(-(2**70), 5) == (-(2**63), 5)


def test_coalesce_against_sets(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice("ab"), lo := rnd.randrange(200), lo + rnd.randrange(-2, 8)) for _ in range(60)] + [("c", 1, 2**63 - 1), ("c", 5, 6)]
    frame = spark.createDataFrame(rows, "device string, lo long, hi long")
    got = sorted(map(tuple, intervals.coalesce(frame).select("device", "lo", "hi").collect()))
    for shift in (1, 3, 62):
        assert sorted(map(tuple, intervals.coalesce(frame, shift=shift).select("device", "lo", "hi").collect())) == got
    want = [("c", 1, 2**63 - 1)]
    for d in "ab":
        on = sorted({x for k, lo, hi in rows if k == d for x in range(lo, hi + 1)})
        start = None
        for x, after in zip(on, [*on[1:], None]):
            start = x if start is None else start
            if after != x + 1:
                want.append((d, start, x))
                start = None
    assert got == sorted(want)


def test_many_deletions_by_bucket(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice("ab"), rnd.randrange(-500, 500), k, 1) for k in range(300)]
    gone = [(rnd.choice("ab"), lo := rnd.randrange(-500, 500), lo + rnd.choice([0, 3, 900]), rnd.randrange(300), 1) for _ in range(12)]
    r = spark.createDataFrame(rows, "device string, t long, seq long, cno long")
    d = spark.createDataFrame(gone, "device string, lo long, hi long, seq long, cno long")
    want = sorted((x[0], x[1], x[2]) for x in rows if not any(x[0] == g[0] and g[1] <= x[1] <= g[2] and g[3] > x[2] for g in gone))
    for shifts in (None, (1, 11), (5,)):
        assert sorted((x.device, x.t, x.seq) for x in snapshot.visible(r, d, shifts).collect()) == want


def test_ranges_against_all_pairs(spark):
    """Short, long and open-ended ranges at the ends of 64 bits, under several block sizes."""
    rnd, low, high = random.Random(1), -(2**63), 2**63 - 1
    own = [(rnd.choice("ab"), lo := rnd.randrange(-3000, 3000), lo + rnd.choice([0, 1, 3, 7, 15, 40, 600, -1]), rnd.randrange(1000)) for _ in range(100)]
    own += [("a", low, -2900, 5), ("b", 2900, high, 700), ("a", -500, high, 300), ("a", low, high, 20)]
    points = {(rnd.choice("abc"), rnd.choice([rnd.randrange(-3300, 3300)] * 9 + [low, high, 2**40])): rnd.randrange(1000) for _ in range(1500)}
    p = spark.createDataFrame([(*k, v) for k, v in points.items()], "device string, t long, seq long")
    for shifts, given in ((None, own), ((1, 9, 19, 29, 39, 49, 59, 62), own), ((5, 15), [x for x in own if abs(x[1]) < 2**60 > abs(x[2])])):
        r = spark.createDataFrame(given, "device string, lo long, hi long, seq long")
        over = {(d, t): [v for e, lo, hi, v in given if e == d and lo <= t <= hi] for d, t in points}
        assert sorted(map(tuple, ranges.uncovered(p, r, "seq", shifts).collect())) == sorted((*k, v) for k, v in points.items() if not any(x > v for x in over[k]))
        assert {(x.device, x.t): x.m for x in ranges.greatest(p, r, "seq", "m", shifts).collect()} == {k: max(v, default=None) for k, v in over.items()}
        assert {tuple(x) for x in ranges.covered_keys(p.select("device", "t"), r, shifts).collect()} == {k for k, v in over.items() if v}


def test_equality_of_floats(spark):
    log = spark.createDataFrame([("d", 1, 1, 1, 0.0), ("d", 2, 2, 1, float("nan")), ("d", 3, 3, 1, None), ("d", 1, 4, 2, -0.0), ("d", 2, 5, 2, float("nan")), ("d", 3, 6, 2, None)], "device string, t long, seq long, cno long, v double")
    assert [(r.t, r.kind) for r in history.diff(log, None, 1, 2).collect()] == [(1, "changed")]


def test_annotation_faults_and_chain(spark):
    ops = spark.createDataFrame([(1, "remove", "d", 1, 2, "x", None, 1, 1), (2, "put", "d", 3, 2, "x", None, 2, 1), (3, "put", "d", 1, 2, "x", None, 3, 1), (3, "remove", "d", 1, 2, "x", None, 4, 1)], "id long, op string, device string, lo long, hi long, label string, note string, seq long, cno long")
    assert sorted(r.id for r in annotations.faults(ops).collect()) == [1, 2]
    commits = spark.createDataFrame([(1, history.ORIGIN, "a"), (2, "a", "b"), (4, "b", "c"), (5, "x", "d")], "cno long, prev_hash string, hash string")
    assert [r.cno for r in history.chain_faults(commits).collect()] == [4, 5]
    assert history.commit_changes(spark.createDataFrame([], "cno long, t long"), commits=commits).filter("rows_written = 0").count() == 4


def _varint(z):
    return max(1, -(-z.bit_length() // 7))


def _zz(x):
    return 2 * x if x >= 0 else -2 * x - 1


def _wrap(x):
    return (x + 2**63) % 2**64 - 2**63


def _dod(values):
    d = [_wrap(b - a) for a, b in zip(values, values[1:])]
    bits = 0
    for z in (_zz(_wrap(b - a)) for a, b in zip(d, d[1:])):
        bits += 1 if z == 0 else 10 if z < 2**8 else 19 if z < 2**16 else 36 if z < 2**32 else 68
    return sum(_varint(_zz(x)) for x in [*values[:1], *d[:1]]) + -(-bits // 8)


def _pack(values):
    d, size = [_wrap(b - a) for a, b in zip(values, values[1:])], _varint(_zz(values[0]))
    for k in range(0, len(d), 128):
        g = d[k : k + 128]
        width = ((max(g) - min(g)) % 2**64).bit_length()
        size += _varint(_zz(min(g))) + 1 + -(-len(g) * width // 8)
    return size


def test_sizes_of_encodings(spark):
    rnd = random.Random(5)
    series = {"regular": [1000 * k for k in range(100)], "const": [7] * 300, "noise": [rnd.randrange(-(2**62), 2**62) for _ in range(200)], "extreme": [-(2**63), 2**63 - 1, 0, -(2**63)], "one": [5]}
    rows = spark.createDataFrame([(k, n, v) for k, values in series.items() for n, v in enumerate(values)], "k string, n long, v long")
    size = lambda frame: {r.k: r.bytes for r in frame.collect()}
    assert size(enc.delta_of_delta_size(rows, ["k"], "n", "v")) == {k: _dod(v) for k, v in series.items()}
    assert size(enc.delta_bitpack_size(rows, ["k"], "n", "v")) == {k: _pack(v) for k, v in series.items()}
    assert _dod(series["regular"]) == 1 + 2 + 13
    restored = enc.undelta(enc.deltas(rows, ["k"], "n", "v"), ["k"], "n", "v", "delta")
    assert restored.filter("value <> v").count() == 0
    runs = {k: sum(_varint(n) + _varint(_zz(x)) for x, n in _runs(v)) for k, v in series.items()}
    assert size(enc.rle_size(rows, ["k"], "n", "v")) == runs
    best = {r.k: r.encoding for r in enc.choose_encoding(rows, ["k"], "n", "v", DataType.INT64).collect()}
    assert best["const"] == "rle" and best["noise"] == "plain" and best["regular"] == "delta-bitpack"
    assert enc.choose_encoding(rows, ["k"], "n", "v", None).filter("k = 'regular'").first().encoding in ("delta-of-delta", "delta-bitpack")
    assert {r.block for r in enc.blocks(rows.filter("k = 'const'"), ["k"], "n", 128).collect()} == {0, 1, 2}


def _runs(values):
    out = []
    for v in values:
        if out and out[-1][0] == v:
            out[-1][1] += 1
        else:
            out.append([v, 1])
    return out


def test_texts_bools_and_statistics(spark):
    rows = spark.createDataFrame([("a", n, "xyz"[n % 3] * 5, n % 2 == 0, [float("nan"), 2.0, -1.0, None][n % 4]) for n in range(12)], "k string, n long, s string, b boolean, f double")
    s = enc.dictionary_size(rows, ["k"], "s").first()
    assert (s.n, s.distinct, s.bytes) == (12, 3, 1 + 3 * 6 + 3)
    assert enc.plain_size(rows, ["k"], "s", DataType.STRING).first().bytes == 72 and enc.plain_size(rows, ["k"], "b", DataType.BOOL).first().bytes == 2
    assert enc.choose_encoding(rows, ["k"], "n", "b", DataType.BOOL).first().encoding == "plain"
    st = enc.segment_stats(rows, ["k"], "f", DataType.FLOAT64).first()
    assert (st.nulls, st.min, st.max) == (3, -1.0, 2.0)
    assert enc.segment_stats(rows.filter("isnan(f)"), ["k"], "f", DataType.FLOAT64).first().min is None
    assert {r.value: r.code for r in enc.dictionary_codes(rows, ["k"], "n", "s").collect()} == {"xxxxx": 0, "yyyyy": 1, "zzzzz": 2}


def test_xor_windows():
    assert enc.xor_bits(np.full(800, 1.5), 64) == 64 + 799
    assert enc.xor_bits(np.zeros(0), 64) == 0 and enc.xor_bits(np.array([1.0], np.float32), 32) == 32
    # 1.0 and 2.0 differ in bits 52 to 62: a new window of 11 bits
    assert enc.xor_bits(np.array([1.0, 2.0]), 64) == 64 + 2 + 12 + 11
    # the same difference again fits the window
    assert enc.xor_bits(np.array([1.0, 2.0, 1.0]), 64) == 64 + 2 + 12 + 11 + 2 + 11


def test_spark_stays_out_of_python(spark):
    if os.path.isdir(SF):
        plan = queries.snapshot_latest(spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and F is not None
