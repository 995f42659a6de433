"""Byte forms of the column encodings, and blocks of a table encoded and decoded on the executors.

Bits are packed from the lowest of each byte.  Numbers of unknown size are groups of seven bits, lowest first; signed
ones are zigzagged before.  All decoders raise CorruptedError on bytes that cannot be.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import CorruptedError
from ..types import DataType
from .encodings import GROUP, Encoding, EncodingPolicy

_U64 = (1 << 64) - 1
#: Size classes of a delta of deltas: code (first bit lowest), bits of the code, bits of the payload.
_CLASSES = ((0b0, 1, 0), (0b01, 2, 8), (0b011, 3, 16), (0b0111, 4, 32), (0b1111, 4, 64))


# ---- bits and numbers


def pack_bits(values, widths) -> bytes:
    """Fields of different widths, one after another."""
    widths = np.asarray(widths, np.int64)
    total = int(widths.sum())
    if not total:
        return b""
    place = np.arange(total) - np.repeat(np.cumsum(widths) - widths, widths)
    bits = (np.repeat(np.asarray(values, np.uint64), widths) >> place.astype(np.uint64)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def unpack_bits(data: bytes, width: int, n: int) -> np.ndarray:
    """``n`` fields of one width; bits after them must be zero."""
    if len(data) != -(-n * width // 8):
        raise CorruptedError(f"{len(data)} bytes for {n} fields of {width} bits")
    bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")
    if bits[n * width :].any():
        raise CorruptedError("bits after the last field")
    weights = np.uint64(1) << np.arange(width, dtype=np.uint64)
    return (bits[: n * width].reshape(n, width).astype(np.uint64) * weights).sum(axis=1, dtype=np.uint64)


class Bits:
    """Bits one after another."""

    def __init__(self, data: bytes):
        self.bits, self.at = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little"), 0

    def take(self, width: int) -> int:
        part = self.bits[self.at : self.at + width]
        if len(part) < width:
            raise CorruptedError("the bits end early")
        self.at += width
        return int.from_bytes(np.packbits(part, bitorder="little").tobytes(), "little")

    def finish(self) -> None:
        if len(self.bits) - self.at >= 8 or self.bits[self.at :].any():
            raise CorruptedError("bits after the last value")


def varint(x: int) -> bytes:
    out = bytearray()
    while x > 127:
        out.append(x & 127 | 128)
        x >>= 7
    out.append(x)
    return bytes(out)


def signed_varint(x: int) -> bytes:
    return varint(x * 2 if x >= 0 else -x * 2 - 1)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    """The number and where the next byte is."""
    x = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise CorruptedError("a number does not end")
        b = data[at]
        x |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            if x > _U64:
                raise CorruptedError("a number does not fit 64 bits")
            return x, at


def read_signed(data: bytes, at: int) -> tuple[int, int]:
    z, at = read_varint(data, at)
    return (z >> 1) ^ -(z & 1), at


def wrap(x: int) -> int:
    return (x + (1 << 63) & _U64) - (1 << 63)


# ---- whole numbers


def encode_plain_ints(values: np.ndarray, width: int) -> bytes:
    return np.asarray(values).astype(f"<i{width}").tobytes()


def decode_plain_ints(data: bytes, n: int, width: int) -> np.ndarray:
    if len(data) != n * width:
        raise CorruptedError(f"{len(data)} bytes for {n} values of {width}")
    return np.frombuffer(data, f"<i{width}").astype(np.int64)


def _deltas(values: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.diff(np.asarray(values, np.int64).view(np.uint64)).view(np.int64)


def encode_delta_of_delta(values: np.ndarray) -> bytes:
    values = np.asarray(values, np.int64)
    d = _deltas(values)
    head = b"".join(signed_varint(int(x)) for x in (*values[:1], *d[:1]))
    dd = _deltas(d)
    z = ((dd << 1) ^ (dd >> 63)).view(np.uint64)
    kind = (z >= 1).astype(int) + (z >= 1 << 8) + (z >= 1 << 16) + (z >= 1 << 32)
    code, size, payload = (np.array(c)[kind] for c in zip(*_CLASSES))
    return head + pack_bits(np.stack([code.astype(np.uint64), z], 1).reshape(-1), np.stack([size, payload], 1).reshape(-1))


def decode_delta_of_delta(data: bytes, n: int) -> np.ndarray:
    if not n:
        return _empty(data)
    value, at = read_signed(data, 0)
    out = [value]
    if n > 1:
        delta, at = read_signed(data, at)
        out.append(wrap(value + delta))
        bits = Bits(data[at:])
        for _ in range(n - 2):
            kind = 0
            while kind < 4 and bits.take(1):
                kind += 1
            z = bits.take(_CLASSES[kind][2]) if kind else 0
            delta = wrap(delta + ((z >> 1) ^ -(z & 1)))
            out.append(wrap(out[-1] + delta))
        bits.finish()
    elif at != len(data):
        raise CorruptedError("bytes after the last value")
    return np.array(out, np.int64)


def _empty(data: bytes) -> np.ndarray:
    if data:
        raise CorruptedError("bytes without values")
    return np.zeros(0, np.int64)


def encode_delta_bitpack(values: np.ndarray) -> bytes:
    values = np.asarray(values, np.int64)
    if not len(values):
        return b""
    out, d = [signed_varint(int(values[0]))], _deltas(values)
    for k in range(0, len(d), GROUP):
        g = d[k : k + GROUP]
        low = int(g.min())
        with np.errstate(over="ignore"):
            offsets = g.view(np.uint64) - np.int64(low).astype(np.uint64)
        width = int(offsets.max()).bit_length()
        out += [signed_varint(low), bytes([width]), pack_bits(offsets, np.full(len(g), width))]
    return b"".join(out)


def decode_delta_bitpack(data: bytes, n: int) -> np.ndarray:
    if not n:
        return _empty(data)
    first, at = read_signed(data, 0)
    parts = [np.array([first], np.int64).view(np.uint64)]
    for k in range(0, n - 1, GROUP):
        m = min(GROUP, n - 1 - k)
        low, at = read_signed(data, at)
        if at >= len(data) or data[at] > 64:
            raise CorruptedError("no bit width")
        width = data[at]
        end = at + 1 + -(-m * width // 8)
        with np.errstate(over="ignore"):
            parts.append(unpack_bits(data[at + 1 : end], width, m) + np.int64(low).astype(np.uint64))
        at = end
    if at != len(data):
        raise CorruptedError("bytes after the last value")
    return np.cumsum(np.concatenate(parts), dtype=np.uint64).view(np.int64)


def _runs(values: np.ndarray):
    starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, int)
    return values[starts], np.diff(np.r_[starts, len(values)])


def encode_rle(values: np.ndarray, boolean: bool = False) -> bytes:
    one = (lambda v: bytes([int(v)])) if boolean else (lambda v: signed_varint(int(v)))
    return b"".join(varint(int(n)) + one(v) for v, n in zip(*_runs(np.asarray(values))))


def decode_rle(data: bytes, n: int, boolean: bool = False) -> np.ndarray:
    values, lengths, at, total = [], [], 0, 0
    while total < n:
        m, at = read_varint(data, at)
        if boolean:
            if at >= len(data) or data[at] > 1:
                raise CorruptedError("not a bool")
            v, at = data[at], at + 1
        else:
            v, at = read_signed(data, at)
        total += m
        if not 0 < m or total > n:
            raise CorruptedError("runs of a wrong length")
        values.append(v)
        lengths.append(m)
    if at != len(data):
        raise CorruptedError("bytes after the last run")
    return np.repeat(np.array(values, bool if boolean else np.int64), lengths) if values else np.zeros(0, bool if boolean else np.int64)


def encode_bitmap(values: np.ndarray) -> bytes:
    return np.packbits(np.asarray(values, bool), bitorder="little").tobytes()


def decode_bitmap(data: bytes, n: int) -> np.ndarray:
    return unpack_bits(data, 1, n).astype(bool)


# ---- floats


def encode_plain_floats(values: np.ndarray, width: int) -> bytes:
    return np.asarray(values).astype(f"<f{width // 8}").tobytes()


def decode_plain_floats(data: bytes, n: int, width: int) -> np.ndarray:
    if len(data) != n * width // 8:
        raise CorruptedError(f"{len(data)} bytes for {n} values of {width} bits")
    return np.frombuffer(data, f"<f{width // 8}").copy()


def encode_xor(values: np.ndarray, width: int) -> bytes:
    """The first value whole; then a 0 for an equal one, 10 and the bits of the kept window, or 11, a new window (its
    leading zeros and its size less one) and its bits."""
    words = np.ascontiguousarray(values, f"<f{width // 8}").view(f"<u{width // 8}").tolist()
    field = 6 if width == 64 else 5
    fields, lead, trail = [(words[0], width)] if words else [], None, None
    for a, b in zip(words, words[1:]):
        x = a ^ b
        if not x:
            fields.append((0, 1))
            continue
        left, right = width - x.bit_length(), (x & -x).bit_length() - 1
        if lead is None or left < lead or right < trail:
            lead, trail = left, right
            fields += [(0b11, 2), (lead, field), (width - lead - trail - 1, field)]
        else:
            fields.append((0b01, 2))
        fields.append((x >> trail, width - lead - trail))
    return pack_bits(*zip(*fields)) if fields else b""


def decode_xor(data: bytes, n: int, width: int) -> np.ndarray:
    if not n:
        return _empty(data).astype(f"<f{width // 8}")
    bits, field, window = Bits(data), (6 if width == 64 else 5), None
    out = [bits.take(width)]
    for _ in range(n - 1):
        x = 0
        if bits.take(1):
            if bits.take(1):
                lead, size = bits.take(field), bits.take(field) + 1
                if lead + size > width:
                    raise CorruptedError("a window outside the value")
                window = (size, width - lead - size)
            if window is None:
                raise CorruptedError("no window yet")
            x = bits.take(window[0]) << window[1]
        out.append(out[-1] ^ x)
    bits.finish()
    return np.array(out, f"<u{width // 8}").view(f"<f{width // 8}")


# ---- texts


def encode_plain_texts(values: Sequence[str]) -> bytes:
    return b"".join(varint(len(b)) + b for b in (v.encode() for v in values))


def _read_texts(data: bytes, at: int, n: int) -> tuple[list[str], int]:
    out = []
    for _ in range(n):
        size, at = read_varint(data, at)
        if at + size > len(data):
            raise CorruptedError("a text ends early")
        try:
            out.append(data[at : at + size].decode())
        except UnicodeDecodeError as e:
            raise CorruptedError(f"not a text: {e}") from e
        at += size
    return out, at


def decode_plain_texts(data: bytes, n: int) -> list[str]:
    out, at = _read_texts(data, 0, n)
    if at != len(data):
        raise CorruptedError("bytes after the last text")
    return out


def encode_dictionary(values: Sequence[str]) -> bytes:
    codes: dict[str, int] = {}
    own = [codes.setdefault(v, len(codes)) for v in values]
    if not own:
        return b""
    width = (len(codes) - 1).bit_length()
    return varint(len(codes)) + encode_plain_texts(list(codes)) + pack_bits(own, np.full(len(own), width))


def decode_dictionary(data: bytes, n: int) -> list[str]:
    if not n:
        return _empty(data).tolist()
    size, at = read_varint(data, 0)
    if not 0 < size <= n:
        raise CorruptedError("a dictionary of a wrong size")
    texts, at = _read_texts(data, at, size)
    codes = unpack_bits(data[at:], (size - 1).bit_length(), n)
    if len(codes) and codes.max() >= size:
        raise CorruptedError("a code outside the dictionary")
    return [texts[c] for c in codes]


# ---- by type


def encode(type: DataType | None, encoding: Encoding, values) -> bytes:
    """Values without nulls; type None: time stamps."""
    if encoding is Encoding.DELTA_OF_DELTA:
        return encode_delta_of_delta(values)
    if encoding is Encoding.DELTA_BIT_PACK:
        return encode_delta_bitpack(values)
    if encoding is Encoding.XOR:
        return encode_xor(values, 8 * type.plain_width)
    if encoding is Encoding.DICTIONARY:
        return encode_dictionary(values)
    if encoding is Encoding.RLE:
        return encode_rle(values, type is DataType.BOOL)
    if type is DataType.STRING:
        return encode_plain_texts(values)
    if type is DataType.BOOL:
        return encode_bitmap(values)
    if type is not None and type.is_float:
        return encode_plain_floats(values, 8 * type.plain_width)
    return encode_plain_ints(values, 8 if type is None else type.plain_width)


def decode(type: DataType | None, encoding: Encoding, data: bytes, n: int):
    if encoding not in Encoding.candidates(type):
        raise CorruptedError(f"encoding {encoding.label} is not one of {'time' if type is None else type}")
    if encoding is Encoding.DELTA_OF_DELTA:
        return decode_delta_of_delta(data, n)
    if encoding is Encoding.DELTA_BIT_PACK:
        return decode_delta_bitpack(data, n)
    if encoding is Encoding.XOR:
        return decode_xor(data, n, 8 * type.plain_width)
    if encoding is Encoding.DICTIONARY:
        return decode_dictionary(data, n)
    if encoding is Encoding.RLE:
        return decode_rle(data, n, type is DataType.BOOL)
    if type is DataType.STRING:
        return decode_plain_texts(data, n)
    if type is DataType.BOOL:
        return decode_bitmap(data, n)
    if type is not None and type.is_float:
        return decode_plain_floats(data, n, 8 * type.plain_width)
    return decode_plain_ints(data, n, 8 if type is None else type.plain_width)


def smallest(type: DataType | None, values, policy="adaptive") -> tuple[Encoding, bytes]:
    """The candidate with the fewest bytes, the earlier one on a tie; plain if there is no value."""
    candidates = EncodingPolicy.parse(policy).candidates(type) if len(values) else (Encoding.PLAIN,)
    return min(((e, encode(type, e, values)) for e in candidates), key=lambda x: len(x[1]))


# ---- blocks of a table


def encode_blocks(rows: DataFrame, keys: Sequence[str], order: str, value: str, type: DataType | None, policy="adaptive") -> DataFrame:
    """``keys, n, nulls, encoding, validity, data`` of each block: keys should name bounded blocks (see
    :func:`tsledger.functions.encodings.blocks`).  ``validity`` is a bitmap, null where no value is."""
    names = list(keys)
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in names)
    blank = F.lit("" if type is DataType.STRING else False if type is DataType.BOOL else 0).cast(rows.schema[value].dataType)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        valid = pdf["__ok"].to_numpy(bool)
        dense = pdf["__v"].to_numpy()[valid]
        dense = dense.tolist() if type is DataType.STRING else dense.astype(np.int64 if type is None or type.is_int else type.numpy)
        e, data = smallest(type, dense, policy)
        nulls = int((~valid).sum())
        return pd.DataFrame({**{k: pdf[k].iloc[:1].to_numpy() for k in names}, "n": [len(pdf)], "nulls": [nulls], "encoding": [e.label], "validity": [encode_bitmap(valid) if nulls else None], "data": [data]})

    # nulls would turn whole numbers into floats on the way, so values go beside a mask
    own = rows.select(*names, order, F.coalesce(F.col(value), blank).alias("__v"), F.col(value).isNotNull().alias("__ok"))
    return own.groupBy(*names).applyInPandas(run, f"{kinds}, n long, nulls long, encoding string, validity binary, data binary")


def decode_blocks(blocks: DataFrame, keys: Sequence[str], type: DataType | None) -> DataFrame:
    """``keys, pos, value`` of every row of encoded blocks, nulls included; a block at a time, no shuffle."""
    import pyarrow as pa

    from ..sources.batch import ARROW

    names = list(keys)
    kind = ARROW[DataType.INT64 if type is None else type]
    kinds = ", ".join(f"`{k}` {blocks.schema[k].dataType.simpleString()}" for k in names)
    by_label = {e.label: e for e in Encoding}

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                row = {f: batch.column(f)[r] for f in ("n", "nulls", "encoding", "validity", "data")}
                n, nulls = row["n"].as_py(), row["nulls"].as_py()
                dense = decode(type, by_label[row["encoding"].as_py()], row["data"].as_py(), n - nulls)
                if nulls:
                    valid = decode_bitmap(row["validity"].as_py(), n)
                    if valid.sum() != n - nulls:
                        raise CorruptedError("validity does not have its number of nulls")
                    at = np.full(n, -1)
                    at[valid] = np.arange(n - nulls)
                    values = pa.array(dense, kind).take(pa.array(np.where(valid, at, 0), mask=~valid)) if n > nulls else pa.nulls(n, kind)
                else:
                    values = pa.array(dense, kind)
                same = [pa.array([batch.column(k)[r].as_py()] * n, batch.schema.field(k).type) for k in names]
                yield pa.RecordBatch.from_arrays([*same, pa.array(np.arange(n), pa.int64()), values], [*names, "pos", "value"])

    value = "bigint" if type is None else type.spark.simpleString()
    return blocks.select(*names, "n", "nulls", "encoding", "validity", "data").mapInArrow(run, f"{kinds}, pos long, value {value}")


# ---- checksum


def _crc_table() -> list[int]:
    """Of the Castagnoli polynomial, lowest bit first."""
    out = []
    for x in range(256):
        for _ in range(8):
            x = x >> 1 ^ (0x82F63B78 if x & 1 else 0)
        out.append(x)
    return out


_CRC = np.array(_crc_table(), np.uint32)


def _moved(crcs: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Registers after some zero bytes; ``table`` has the result for each byte at each of the four places."""
    return table[0][crcs & 255] ^ table[1][crcs >> 8 & 255] ^ table[2][crcs >> 16 & 255] ^ table[3][crcs >> 24]


def _doubled(table: np.ndarray) -> np.ndarray:
    """The table for twice as many zero bytes."""
    return np.stack([_moved(row, table) for row in table])


def _one_zero() -> np.ndarray:
    own = np.arange(256, dtype=np.uint32)
    places = [own << np.uint32(8 * k) for k in range(4)]
    return np.stack([x >> np.uint32(8) ^ _CRC[x & 255] for x in places])


_ZERO = [_one_zero()]


def crc32c(data: bytes, before: int = 0) -> int:
    """Registers of single bytes are joined in pairs, then pairs of pairs: a register is linear in its input."""
    n = len(data)
    if n < 64:
        x = before ^ 0xFFFFFFFF
        for b in data:
            x = x >> 8 ^ int(_CRC[(x ^ b) & 255])
        return x ^ 0xFFFFFFFF
    own = np.zeros(1 << (n - 1).bit_length(), np.uint32)
    own[len(own) - n :] = _CRC[np.frombuffer(data, np.uint8)]  # zeros before do not change a register of zero
    level = 0
    while len(own) > 1:
        if level == len(_ZERO):
            _ZERO.append(_doubled(_ZERO[-1]))
        own = _moved(own[0::2], _ZERO[level]) ^ own[1::2]
        level += 1
    start, level = np.array([before ^ 0xFFFFFFFF], np.uint32), 0
    while n >> level:
        if level == len(_ZERO):
            _ZERO.append(_doubled(_ZERO[-1]))
        if n >> level & 1:
            start = _moved(start, _ZERO[level])
        level += 1
    return int(own[0] ^ start[0]) ^ 0xFFFFFFFF


def crc32c_column(column):
    """Of a binary column."""

    @F.pandas_udf("long")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else crc32c(v))

    return run(column)

