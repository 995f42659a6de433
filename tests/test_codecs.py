import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tsledger import CorruptedError, DataType, Encoding
from tsledger.functions import codecs, encodings

from .test_operators import _dod, _pack, _runs, _varint, _zz

INT = st.integers(-(2**63), 2**63 - 1)
KINDS = {None: INT, DataType.INT64: st.one_of(INT, st.integers(-3, 3)), DataType.INT32: st.integers(-(2**31), 2**31 - 1), DataType.BOOL: st.booleans(), DataType.FLOAT64: st.floats(), DataType.FLOAT32: st.floats(width=32), DataType.STRING: st.sampled_from(["", "a", "é", "long " * 9]) | st.text(max_size=5)}


def bits(type, values):
    if type is not None and type.is_float:
        return np.asarray(values, type.numpy).view(f"u{type.plain_width}").tolist()
    return list(values) if type is DataType.STRING else np.asarray(values).tolist()


@settings(max_examples=40, deadline=None)
@given(st.data())
def test_round_trip(data):
    type = data.draw(st.sampled_from(list(KINDS)))
    values = data.draw(st.lists(KINDS[type], max_size=300))
    own = values if type is DataType.STRING else np.array(values, np.int64 if type is None or type.is_int else type.numpy)
    for e in Encoding.candidates(type):
        out = codecs.encode(type, e, own)
        assert bits(type, codecs.decode(type, e, out, len(values))) == bits(type, own)
        for wrong in (out + b"\x01", out[:-1] if out else b"\x00"):
            try:
                codecs.decode(type, e, wrong, len(values))
            except CorruptedError:
                continue
            raise AssertionError(f"{type} {e.label}: damage was not noticed")


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=60), st.integers(0, 20))
def test_garbage_never_crashes(data, n):
    for type in KINDS:
        for e in Encoding.candidates(type):
            try:
                assert len(codecs.decode(type, e, data, n)) == n
            except CorruptedError:
                pass


@settings(max_examples=40, deadline=None)
@given(st.lists(KINDS[DataType.INT64], min_size=1, max_size=400))
def test_sizes_are_those_of_the_naive_forms(values):
    own = np.array(values, np.int64)
    assert len(codecs.encode_delta_of_delta(own)) == _dod(values) and len(codecs.encode_delta_bitpack(own)) == _pack(values)
    assert len(codecs.encode_rle(own)) == sum(_varint(n) + _varint(_zz(v)) for v, n in _runs(values))
    floats = own.astype(float)
    assert len(codecs.encode_xor(floats, 64)) == -(-encodings.xor_bits(floats, 64) // 8)


def test_choice():
    pick = lambda type, values: codecs.smallest(type, np.array(values))[0].label
    rnd = np.random.default_rng(1)
    assert pick(DataType.INT64, [7] * 500) == "rle" and pick(DataType.INT64, range(500)) == "delta-bitpack"
    assert pick(DataType.INT64, rnd.integers(-(2**62), 2**62, 500)) == "plain"
    assert codecs.smallest(DataType.STRING, ["on", "off"] * 50)[0].label == "dictionary" and codecs.smallest(DataType.STRING, [])[0].label == "plain"
    with pytest.raises(CorruptedError):
        codecs.decode(DataType.STRING, Encoding.XOR, b"", 0)


def test_blocks_of_a_table(spark):
    rows = [("a" if k % 3 else "b", k, k * 1000, None if k % 5 == 0 else k % 2 == 0, None if k % 7 == 0 else f"s{k % 4}", None if k % 4 == 0 else float("nan") if k % 11 == 0 else k / 8, None if k % 6 == 0 else 2**60 + k) for k in range(400)]
    frame = encodings.blocks(spark.createDataFrame(rows, "d string, k long, t long, b boolean, s string, f double, i long"), ["d"], "k", 64)
    for name, type in (("t", None), ("b", DataType.BOOL), ("s", DataType.STRING), ("f", DataType.FLOAT64), ("i", DataType.INT64)):
        blocks = codecs.encode_blocks(frame, ["d", "block"], "k", name, type)
        got = sorted((r.d, r.block, r.pos, repr(r.value)) for r in codecs.decode_blocks(blocks, ["d", "block"], type).collect())
        want, seen = [], {}
        for r in rows:
            n = seen[r[0]] = seen.get(r[0], -1) + 1
            want.append((r[0], n // 64, n % 64, repr(r[["d", "k", "t", "b", "s", "f", "i"].index(name)])))
        assert got == sorted(want), name
        assert blocks.filter("nulls > 0 and validity is null").count() == 0


def test_checksum(spark):
    assert codecs.crc32c(b"123456789") == 0xE3069283 and codecs.crc32c(b"6789", codecs.crc32c(b"12345")) == 0xE3069283 and codecs.crc32c(b"") == 0
    assert spark.createDataFrame([(b"123456789",), (None,)], "x binary").select(codecs.crc32c_column("x")).collect()[0][0] == 0xE3069283
