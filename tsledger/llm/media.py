"""Media columns: payloads as progressive JPEG, decoded by accumulating scans into coefficient arrays.

A payload's bytes, less 128, are the quantised DCT coefficients of an image, in zigzag order; the quantisation
tables are all ones, so the format keeps them exactly.  A unit of 576 bytes is one MCU of 16 x 16 pixels: four blocks
of Y, four of Cb, one of Cr, whose plane has half the resolution.  Units fill a grid; a comment segment holds the
payload's length.  The scans: DC with the lowest bit held back, per component AC 1-5 with the lowest bit held back and
AC 6-63 whole, then the lowest bits of AC 1-5 and of DC.  Every MCU ends with a restart marker, so the decoder walks
all segments of many images in step with numpy instead of symbol by symbol.

The decoder adds each scan to the coefficients, then inverse-transforms in exact integer arithmetic (so equal
payloads give equal tensors wherever they run), doubles the Cr plane and converts to RGB at full resolution.  It reads
the profile written here - progressive, restart interval 1, these sampling factors - with any Huffman tables, and
raises ValueError for other files.

:func:`store_media` writes the media column to the shared folder, and beside it, unless told not to, a table of tensors
decoded from the written media; :func:`read_media` and :func:`read_tensors` read them back, :func:`read_features` takes
the features from the stored tensors.

Defined cases: a null or empty text is one unit of padding; a very long text is coded and decoded whole, in parts;
equal texts give equal media; repeated or null ids are treated row by row; an empty table gives an empty result;
further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import MADE, claim, require, table_path

UNIT, PAD = 576, 255
#: Units side by side in the grid, at most.
WIDE = 64
#: Units that are coded or decoded in step, about; bounds a worker's memory beside its longest text.
STEP = 1500
#: Segments of a scan that are coded or read at a time, so a very long text costs no more working memory.
CHUNK = 32_768
#: Level of zstd for stored media; tensors gain nothing by more than the usual one.
LEVEL = 6
#: Pixels of a tensor that are summed at a time.
PIXELS = 1 << 18
#: Sampling factors (horizontal, vertical) of Y, Cb, Cr.
FACTORS = ((2, 2), (2, 2), (1, 1))
#: (components, first, last coefficient, high, low bit) of each scan.
SCANS = (
    ((0, 1, 2), 0, 0, 0, 1),
    *(((c,), 1, 5, 0, 1) for c in range(3)),
    *(((c,), 6, 63, 0, 0) for c in range(3)),
    *(((c,), 1, 5, 1, 0) for c in range(3)),
    ((0, 1, 2), 0, 0, 1, 0),
)


def _zigzag() -> np.ndarray:
    """Natural position of each coefficient of the zigzag: diagonals, walked up and down in turn."""
    order = sorted(range(64), key=lambda p: (p // 8 + p % 8, p // 8 if (p // 8 + p % 8) % 2 else p % 8))
    return np.array(order)


ZIGZAG = _zigzag()


def _huffman(lengths: dict[int, int]):
    """Canonical codes: the table's bytes, and code and length by symbol."""
    symbols = sorted(lengths, key=lambda s: (lengths[s], s))
    counts = [0] * 17
    codes, sizes = np.zeros(256, np.int64), np.zeros(256, np.int64)
    code = last = 0
    for s in symbols:
        code <<= lengths[s] - last
        last = lengths[s]
        codes[s], sizes[s] = code, last
        counts[last] += 1
        code += 1
    return bytes(counts[1:]) + bytes(symbols), codes, sizes


#: A code and the bits after it make a byte, or two after one zero, so the bytes of a text stay apart in the file and the
#: table's compression finds what repeats; any other run and size is possible.
_LENGTHS = {(r << 4) | s: 16 for r in range(16) for s in range(1, 9)} | {0xF0: 16, 0x00: 9} | {s: 8 - s for s in range(1, 8)} | {0x10 | s: 16 - s for s in range(1, 8)}
AC_TABLE, AC_CODES, AC_SIZES = _huffman(_LENGTHS)
DC_TABLE, DC_CODES, DC_SIZES = _huffman({s: 4 for s in range(12)})
BITS = np.array([int(x).bit_length() for x in range(2048)], np.int64)


def _signed(v: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bits that follow a size: the value, or its ones' complement when negative."""
    return np.where(v < 0, v + (1 << size) - 1, v)


def _ac_tokens() -> tuple[np.ndarray, np.ndarray]:
    """Bits and their number of each (run << 8 | value + 128)."""
    run, v = np.divmod(np.arange(16 * 256), 256)
    v -= 128
    size = BITS[np.abs(v)]
    symbol = run << 4 | size
    return AC_CODES[symbol] << size | _signed(v, size), AC_SIZES[symbol] + size


AC_VALUES, AC_LENGTHS = _ac_tokens()


@lru_cache(maxsize=4096)
def _orders(wide: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each component, the blocks (unit * 9 + number) of a grid in the raster order of its plane."""
    unit = np.arange(high * wide).reshape(high, wide)
    square = lambda first: (unit[:, None, :, None] * 9 + first + np.arange(4).reshape(1, 2, 1, 2)).reshape(-1)
    return square(0), square(4), (unit * 9 + 8).reshape(-1)


def grid(units: int) -> tuple[int, int]:
    """Units side by side and rows of them."""
    wide = min(units, WIDE)
    return wide, -(-units // wide)


# ---- coding


def _pack(values: np.ndarray, sizes: np.ndarray, segment: np.ndarray, doc: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of bits to bytes: each segment padded with ones, FF followed by 00, a restart marker between the
    segments of a document.  ``doc``: document of each segment, ``number``: its place in it.  Gives the bytes and where
    each segment's begin."""
    segments = len(doc)
    through = np.cumsum(sizes, dtype=np.int64)
    last = np.searchsorted(segment, np.arange(segments), "right") - 1
    ends = through[last]
    per = np.diff(ends, prepend=0)
    held = (per + 7) >> 3
    starts = np.cumsum(held) - held
    at = through - sizes + np.repeat(8 * starts - (ends - per), np.diff(last, prepend=-1))
    wide = values.astype(np.uint64) << (64 - (at & 31) - sizes).astype(np.uint64)
    at >>= 5
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    wide = np.add.reduceat(wide, first)  # bits of tokens do not overlap
    total = int(held.sum())
    words = np.zeros(total // 4 + 2, np.uint64)
    words[at[first]] += wide >> np.uint64(32)
    words[at[first] + 1] += wide & np.uint64(0xFFFFFFFF)
    out = words.astype(">u4").view(np.uint8)[:total].copy()
    out[starts + held - 1] |= ((1 << (8 * held - per)) - 1).astype(np.uint8)
    markers = np.cumsum(np.r_[False, doc[1:] == doc[:-1]])
    stuffed = out == 255
    ff = np.flatnonzero(stuffed)
    before = np.zeros(segments + 1, np.int64)
    before[:-1] = np.searchsorted(ff, starts)
    before[-1] = len(ff)
    place = np.arange(total) + np.repeat(2 * markers, held)
    place[1:] += np.cumsum(stuffed)[:-1]
    final = np.zeros(total + len(ff) + 2 * int(markers[-1]), np.uint8)
    final[place] = out
    begins = starts + before[:-1] + 2 * markers
    inner = np.flatnonzero(doc[1:] == doc[:-1]) + 1
    final[begins[inner] - 2] = 255
    final[begins[inner] - 1] = 0xD0 + ((number[inner] - 1) & 7)
    return final, begins


def _ac_first(blocks: np.ndarray, first: int, last: int, low: int):
    n, width = len(blocks), last - first + 1
    v = blocks[:, first : last + 1]
    if low:
        v = np.sign(v) * (np.abs(v) >> low)
    there = v != 0
    count = there.sum(axis=1)
    v = v[there]
    at = np.flatnonzero(there)
    row = np.repeat(np.arange(0, n * width, width), count)
    run = np.diff(at, prepend=0) - 1
    heads = (np.cumsum(count) - count)[count > 0]
    run[heads] = at[heads] - row[heads]
    long = run >> 4
    final = np.full(n, -1)
    ends = np.cumsum(count)[count > 0] - 1
    final[count > 0] = at[ends] - row[ends]
    eob = final < width - 1
    token = (run & 15) << 8 | (v + 128)
    values, sizes = AC_VALUES[token], AC_LENGTHS[token]
    if not eob.any() and not long.any():
        return values, sizes, np.repeat(np.arange(n), count)
    extra = np.zeros(n, np.int64)
    np.add.at(extra, row[long > 0] // width, long[long > 0])
    per = count + extra + eob
    place = np.cumsum(1 + long) - 1 + np.repeat(np.cumsum(eob) - eob, count)
    total = int(per.sum())
    all_values, all_sizes = np.full(total, AC_CODES[0xF0]), np.full(total, AC_SIZES[0xF0])
    all_values[place], all_sizes[place] = values, sizes
    tail = (np.cumsum(per) - 1)[eob]
    all_values[tail], all_sizes[tail] = AC_CODES[0], AC_SIZES[0]
    return all_values, all_sizes, np.repeat(np.arange(n), per)


def _ac_refine(blocks: np.ndarray, first: int, last: int, low: int):
    """Bands shorter than a run of 16."""
    n, width = len(blocks), last - first + 1
    values, sizes = np.zeros((n, width + 1), np.int64), np.zeros((n, width + 1), np.int64)
    run, held, held_n = (np.zeros(n, np.int64) for _ in range(3))
    for j in range(width):
        v = blocks[:, first + j]
        mag = np.abs(v) >> low
        old, new = mag > 1, mag == 1
        symbol = (run << 4) | 1
        code = ((AC_CODES[symbol] << 1) | (v > 0)) << held_n | held
        values[:, j] = np.where(new, code, 0)
        sizes[:, j] = np.where(new, AC_SIZES[symbol] + 1 + held_n, 0)
        run = np.where(new, 0, run + (mag == 0))
        held = np.where(new, 0, np.where(old, held << 1 | (mag & 1), held))
        held_n = np.where(new, 0, held_n + old)
    tail = (run > 0) | (held_n > 0)
    values[:, width] = np.where(tail, AC_CODES[0] << held_n | held, 0)
    sizes[:, width] = np.where(tail, AC_SIZES[0] + held_n, 0)
    used = sizes > 0
    return values[used], sizes[used], np.nonzero(used)[0]


def _dc(blocks: np.ndarray, high: int, low: int):
    """``blocks``: units x 9 DC coefficients."""
    n = len(blocks)
    if high:
        return ((blocks >> low) & 1).reshape(-1), np.ones(9 * n, np.int64), np.repeat(np.arange(n), 9)
    t = (blocks >> low).astype(np.int64)
    d = t.copy()
    d[:, 1:4] -= t[:, 0:3]
    d[:, 5:8] -= t[:, 4:7]
    size = BITS[np.abs(d)]
    values = (DC_CODES[size] << size) | _signed(d, size)
    return values.reshape(-1), (DC_SIZES[size] + size).reshape(-1), np.repeat(np.arange(n), 9)


def _coded(blocks: np.ndarray, doc: np.ndarray, scan) -> tuple[bytes, np.ndarray]:
    """The entropy-coded bytes of one scan of many documents, and where each document's begin."""
    parts, first, last, high, low = scan
    heads = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    number = np.arange(len(doc)) - heads[doc - doc[0]]
    out, begins, size = [], [], 0
    for a in range(0, len(doc), CHUNK):
        part = slice(a, a + CHUNK)
        tokens = _dc(blocks[part], high, low) if first == 0 else (_ac_refine if high else _ac_first)(blocks[part], first, last, low)
        data, at = _pack(*tokens, doc[part], number[part])
        if number[a]:
            out.append(bytes((255, 0xD0 + (int(number[a]) - 1 & 7))))
            size += 2
        out.append(data.tobytes())
        begins.append(at + size)
        size += len(data)
    return b"".join(out), np.concatenate(begins)[heads]


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, marker, len(body) + 2) + body


@lru_cache(maxsize=4096)
def _head(size: int, wide: int, high: int) -> bytes:
    frame = struct.pack(">BHHB", 8, 16 * high, 16 * wide, 3) + b"".join(bytes((c + 1, h << 4 | v, 0)) for c, (h, v) in enumerate(FACTORS))
    return b"\xff\xd8" + _segment(0xFE, b"payload=%d" % size) + _segment(0xDB, bytes(1) + bytes([1] * 64)) + _segment(0xC2, frame) + _segment(0xC4, b"\x00" + DC_TABLE) + _segment(0xC4, b"\x10" + AC_TABLE) + _segment(0xDD, b"\x00\x01")


@lru_cache(maxsize=64)
def _scan_head(scan) -> bytes:
    parts, first, last, high, low = scan
    return _segment(0xDA, bytes([len(parts)]) + b"".join(bytes((c + 1, 0)) for c in parts) + bytes((first, last, high << 4 | low)))


def encode(payloads: list[bytes]) -> list[bytes]:
    """A progressive JPEG for each payload, whose size is a positive multiple of UNIT."""
    grids = [grid(len(p) // UNIT) for p in payloads]
    units = np.array([w * h for w, h in grids])
    base = np.cumsum(units) - units
    coefs = np.zeros((int(units.sum()) * 9, 64), np.int32)
    flat = coefs.reshape(-1)
    for p, b in zip(payloads, base):
        flat[b * UNIT : b * UNIT + len(p)] = np.frombuffer(p, np.uint8).astype(np.int32) - 128
    files = [[_head(len(p), w, h)] for p, (w, h) in zip(payloads, grids)]
    order = [np.concatenate([_orders(w, h)[c] + 9 * b for (w, h), b in zip(grids, base)]) for c in range(3)]
    planes = [coefs[o] for o in order]
    for scan in SCANS:
        parts, first = scan[:2]
        per = 1 if first == 0 else FACTORS[parts[0]][0] * FACTORS[parts[0]][1]
        doc = np.repeat(np.arange(len(payloads)), units * per)
        raw, begins = _coded(coefs[:, 0].reshape(-1, 9) if first == 0 else planes[parts[0]], doc, scan)
        at, head = [*begins.tolist(), len(raw)], _scan_head(scan)
        for k, f in enumerate(files):
            f += [head, raw[at[k] : at[k + 1]]]
    return [b"".join(f) + b"\xff\xd9" for f in files]


# ---- decoding


@lru_cache(maxsize=64)
def _lookup(table: bytes) -> np.ndarray:
    """Of 16 bits: symbol and code length, as length << 8 | symbol."""
    out, code, at = np.zeros(1 << 16, np.int32), 0, 16
    for length in range(1, 17):
        for _ in range(table[length - 1]):
            low = code << (16 - length)
            out[low : low + (1 << (16 - length))] = length << 8 | table[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


_MARK = re.compile(rb"\xff[^\x00\xff\xd0-\xd7]", re.DOTALL)


@lru_cache(maxsize=4096)
def _parsed(head: bytes) -> tuple:
    """Payload size, units across and down, Huffman tables: of all segments before the first scan."""
    at, size, high, wide, restart, factors, tables = 2, None, 0, 0, 0, (), {}
    while at < len(head):
        mark, n = head[at + 1], int.from_bytes(head[at + 2 : at + 4], "big")
        body, at = head[at + 4 : at + 2 + n], at + 2 + n
        if mark == 0xFE and body.startswith(b"payload="):
            size = int(body[8:])
        elif mark == 0xDB and (body[0] or body[1:65] != bytes([1] * 64)):
            raise ValueError("quantisation is not all ones")
        elif mark == 0xC2:
            high, wide = (x // 16 for x in struct.unpack(">HH", body[1:5]))
            factors = tuple((b >> 4, b & 15) for b in body[7::3])
        elif mark == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                tables[body[0]], body = body[1:n], body[n:]
        elif mark == 0xDD:
            restart = int.from_bytes(body, "big")
        elif 0xC0 <= mark <= 0xCF:
            raise ValueError("not a progressive JPEG file")
    if restart != 1 or factors != FACTORS or size is None:
        raise ValueError("not of the profile that is written here")
    return size, wide, high, tables


@lru_cache(maxsize=64)
def _parsed_scan(body: bytes) -> tuple:
    """The scan's kind, and the number of its Huffman table."""
    n = body[0]
    first, last, bits = body[1 + 2 * n : 4 + 2 * n]
    if bits >> 4 and bits & 15 != (bits >> 4) - 1:
        raise ValueError("not of the profile that is written here")
    return (tuple(body[1 + 2 * k] - 1 for k in range(n)), first, last, bits >> 4, bits & 15), 0x10 | body[2] & 15 if first else body[2] >> 4


class File:
    """Frame, tables and scans of one file."""

    def __init__(self, data: bytes):
        at = data.find(b"\xff\xda")
        if data[:2] != b"\xff\xd8" or at < 0:
            raise ValueError("not a JPEG file")
        self.size, self.wide, self.high, tables = _parsed(data[:at])
        self.scans = []
        while data[at + 1] == 0xDA:
            begin = at + 2 + int.from_bytes(data[at + 2 : at + 4], "big")
            kind, table = _parsed_scan(data[at + 4 : begin])
            found = _MARK.search(data, begin)
            if not found:
                raise ValueError("the file ends inside a scan")
            at = found.start()
            self.scans.append((kind, tables.get(table, b""), data[begin:at]))
        if data[at + 1] != 0xD9:
            raise ValueError("not of the profile that is written here")


def _scan_parts(parts: list[bytes], counts: list[int]):
    """The segments of one scan of many files, some at a time: first and last segment, and their bits."""
    data = np.frombuffer(b"".join(parts) + bytes(8), np.uint8)
    sizes = np.array([len(p) for p in parts])
    ends = np.cumsum(sizes)
    ff = np.flatnonzero(data[:-1] == 255)
    after = data[ff + 1]
    restart = ff[(after >= 0xD0) & (after <= 0xD7)]
    starts = np.sort(np.concatenate([ends - sizes, restart + 2]))
    if len(starts) != sum(counts):
        raise ValueError("restart markers are missing")
    drop = np.sort(np.concatenate([ff[after == 0] + 1, restart, restart + 1]))
    for a in range(0, len(starts), CHUNK):
        b = min(a + CHUNK, len(starts))
        low, high = int(starts[a]), int(starts[b]) if b < len(starts) else len(data) - 8
        x, y = np.searchsorted(drop, (low, high))
        yield a, b, _Bits(data[low:high], starts[a:b] - low, drop[x:y] - low)


class _Bits:
    """Segments to be read in step: without stuffed bytes and markers."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, drop: np.ndarray):
        kept = np.concatenate([np.delete(data, drop), np.zeros(8, np.uint8)]).astype(np.uint32)
        self.pos = (starts - np.searchsorted(drop, starts)) * 8
        self.words = kept[:-3] << 24 | kept[1:-2] << 16 | kept[2:-1] << 8 | kept[3:]

    def peek(self, pos: np.ndarray) -> np.ndarray:
        return self.words[pos >> 3] << (pos & 7).astype(np.uint32)


def _value(w: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Signed value of the ``size`` bits at the front of each word."""
    v = (w >> np.uint32(1) >> (31 - size).astype(np.uint32)).astype(np.int32)
    one = np.int32(1)
    return np.where(v < (one << size >> one), v - (one << size) + one, v)


def _read_ac_first(bits: _Bits, table: np.ndarray, out: np.ndarray, first: int, last: int, low: int) -> None:
    """``out``: coefficients x segments."""
    n = out.shape[1]
    flat, seg = out.reshape(-1), np.arange(n)
    pos, k = bits.pos.copy(), np.full(n, first)
    while len(seg):
        w = bits.peek(pos)
        hit = table[w >> 16]
        length, size, run = hit >> 8, hit & 15, (hit >> 4) & 15
        v = _value(w << length.astype(np.uint32), size)
        k += run
        pos += length + size
        zero = size == 0
        if zero.any():
            end = zero & (run < 15)
            put = ~zero & (k <= last)
            flat[k[put] * n + seg[put]] = v[put] << low
            k += 1
            go = ~end & (k <= last)
        else:
            flat[k * n + seg] = v << low
            k += 1
            go = k <= last
        if not go.all():
            seg, pos, k = seg[go], pos[go], k[go]


def _read_ac_refine(bits: _Bits, table: np.ndarray, out: np.ndarray, first: int, last: int, low: int) -> None:
    n = out.shape[1]
    pos, seg, k = bits.pos.copy(), np.arange(n), np.full(n, first)
    one = 1 << low
    while len(seg):
        w = bits.peek(pos)
        hit = table[w >> 16]
        length, size, run = hit >> 8, hit & 15, (hit >> 4) & 15
        new = np.where((w << length.astype(np.uint32)) >> np.uint32(31) == 1, one, -one)
        end = (size == 0) & (run < 15)
        pos += length + size
        left = np.where(end, 1 << 20, run)
        open_ = np.ones(len(seg), bool)
        for j in range(first, last + 1):
            here = open_ & (k == j)
            if not here.any():
                continue
            c = out[j, seg]
            old = here & (c != 0)
            bit = (bits.peek(pos) >> np.uint32(31)).astype(np.int32)
            put = here & (c == 0) & (left == 0)
            c = np.where(old & (bit == 1), c + np.where(c > 0, one, -one), np.where(put & (size > 0), new, c))
            out[j, seg] = np.where(here, c, out[j, seg])
            pos += old
            left -= here & ~old & ~put
            open_ &= ~put
            k += here
        go = ~end & (k <= last)
        seg, pos, k = seg[go], pos[go], k[go]


def _read_dc(bits: _Bits, table: np.ndarray | None, out: np.ndarray, high: int, low: int) -> None:
    """``out``: units x 9 DC coefficients."""
    pos = bits.pos.copy()
    before = np.zeros((len(pos), 3), np.int32)
    for j in range(9):
        w = bits.peek(pos)
        if high:
            out[:, j] |= (w >> np.uint32(31)).astype(np.int32) << low
            pos += 1
            continue
        hit = table[w >> 16]
        length, size = hit >> 8, hit & 255
        c = (0, 0, 0, 0, 1, 1, 1, 1, 2)[j]
        before[:, c] += _value(w << length.astype(np.uint32), size)
        out[:, j] = before[:, c] << low
        pos += length + size


def coefficients(files: list[File]) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (units x 9 x 64, zigzag order) of many files, scan by scan, and the first unit of each file."""
    units = np.array([f.wide * f.high for f in files])
    base = np.cumsum(units) - units
    coefs = np.zeros((int(units.sum()) * 9, 64), np.int32)
    kinds = [(s, t) for s, t, _ in files[0].scans]
    if any([(s, t) for s, t, _ in f.scans] != kinds for f in files):
        raise ValueError("files of different scans")
    order = [np.concatenate([_orders(f.wide, f.high)[c] + 9 * b for f, b in zip(files, base)]) for c in range(3)]
    planes = [np.zeros((64, len(o)), np.int32) for o in order]
    dc = np.zeros((int(units.sum()), 9), np.int32)
    for k, ((parts, first, last, high, low), table) in enumerate(kinds):
        per = 1 if len(parts) > 1 else FACTORS[parts[0]][0] * FACTORS[parts[0]][1]
        for a, b, bits in _scan_parts([f.scans[k][2] for f in files], [u * per for u in units]):
            if len(parts) > 1:
                _read_dc(bits, _lookup(table) if table else None, dc[a:b], high, low)
            else:
                own = np.ascontiguousarray(planes[parts[0]][:, a:b])
                (_read_ac_refine if high else _read_ac_first)(bits, _lookup(table), own, first, last, low)
                planes[parts[0]][:, a:b] = own
    for o, plane in zip(order, planes):
        coefs[o] = plane.T
    coefs[:, 0] = dc.reshape(-1)
    return coefs.reshape(-1, 9, 64), base


def _transform() -> np.ndarray:
    """From 64 zigzag coefficients to 64 samples, in units of 2 to the -14."""
    one = np.array([[(np.sqrt(0.5) if u == 0 else 1.0) / 2 * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
    both = np.einsum("ux,vy->uvxy", one, one).reshape(64, 64)
    return np.rint(both[ZIGZAG] * 16384).astype(np.float32)


_T = _transform()


def samples(coefs: np.ndarray) -> np.ndarray:
    """Units x 9 x 8 x 8 samples, 0 to 255.  With coefficients of 8 bits all sums are integers below 2 to the 24,
    so they are exact in whatever order they are formed."""
    s = np.floor((coefs.reshape(-1, 64).astype(np.float32) @ _T) * np.float32(2.0**-14) + np.float32(128.5))
    return np.clip(s, 0, 255, out=s).astype(np.int32).reshape(-1, 9, 8, 8)


def unit_rgb(s: np.ndarray) -> np.ndarray:
    """Units x 16 x 16 x 3 from samples: Cr is doubled, then the usual conversion in integers."""
    n = len(s)
    wide = lambda four: four.reshape(n, 2, 2, 8, 8).transpose(0, 1, 3, 2, 4).reshape(n, 16, 16)
    y, cb, cr = wide(s[:, 0:4]), wide(s[:, 4:8]) - 128, s[:, 8].repeat(2, axis=1).repeat(2, axis=2) - 128
    out = np.empty((n, 16, 16, 3), np.uint8)
    out[..., 0] = np.clip(y + ((91881 * cr + 32768) >> 16), 0, 255)
    out[..., 1] = np.clip(y - ((22554 * cb + 46802 * cr + 32768) >> 16), 0, 255)
    out[..., 2] = np.clip(y + ((116130 * cb + 32768) >> 16), 0, 255)
    return out


def feature_of(rgb: np.ndarray, height: int, width: int) -> str:
    """Size, means of red, green and blue, mean square of green; the pixels (... x 3) may come in any order."""
    flat = rgb.reshape(-1, 3)
    total, square = np.zeros(3, np.int64), 0
    for a in range(0, len(flat), PIXELS):
        part = flat[a : a + PIXELS].T.astype(np.int64, order="C")
        total += part.sum(axis=1)
        square += int(part[1] @ part[1])
    return f"{height}x{width}:" + ",".join(f"{x / len(flat):.3f}" for x in total.tolist()) + f":{square / len(flat):.2f}"


def _ranges(sizes, step: int):
    """Runs of items of about ``step`` in all."""
    begin = total = 0
    for k, n in enumerate(sizes):
        total += n
        if total >= step:
            yield begin, k + 1
            begin, total = k + 1, 0
    if begin < len(sizes):
        yield begin, len(sizes)


def decode(media: list[bytes], tensors: bool = False) -> list[tuple]:
    """Of each file: payload, height, width, feature string, and the RGB tensor's bytes if asked for."""
    files = [File(m) for m in media]
    coefs, base = coefficients(files)
    rgb = unit_rgb(samples(coefs))
    data = (coefs + 128).astype(np.uint8).tobytes()
    out = []
    for f, b in zip(files, base.tolist()):
        n = f.wide * f.high
        feature = feature_of(rgb[b : b + n], 16 * f.high, 16 * f.wide)
        tensor = rgb[b : b + n].reshape(f.high, f.wide, 16, 16, 3).transpose(0, 2, 1, 3, 4).tobytes() if tensors else None
        out.append((data[b * UNIT : b * UNIT + f.size], 16 * f.high, 16 * f.wide, feature, tensor))
    return out


# ---- operators


def payload_of(text: str | None) -> bytes:
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + bytes([PAD]) * (UNIT - len(data) if not data else -len(data) % UNIT)


def media_columns(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, media`` of every text.  No shuffle."""
    require(docs, ("doc_id", "text"))

    def run(batches):
        claim()
        for batch in batches:
            texts = [t.as_py() for t in batch.column(1)]
            for a, b in _ranges([len(t or "") // UNIT + 1 for t in texts], STEP):
                payloads = [payload_of(t) for t in texts[a:b]]
                sizes = [len((t or "").encode("utf-8", "surrogatepass")) for t in texts[a:b]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sizes, pa.int64()), pa.array(encode(payloads), pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def read_media(media: DataFrame, tensors: bool = False) -> DataFrame:
    """``doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, height, width, feature`` and,
    if asked for, ``tensor`` (RGB bytes, rows first) from stored media."""
    ddl = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, height int, width int, feature string"

    def run(batches):
        claim()
        for batch in batches:
            stored = batch.column(2).to_pylist()
            for a, b in _ranges([len(m) // UNIT + 1 for m in stored], STEP):
                rows = []
                for m, (payload, high, wide, feature, tensor) in zip(stored[a:b], decode(stored[a:b], tensors)):
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(m), hashlib.sha256(m).hexdigest(), high, wide, feature, *([tensor] if tensors else [])))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), *columns], names)

    names = [x.split()[0] for x in (ddl + (", tensor binary" if tensors else "")).split(", ")]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.binary()]
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, ddl + (", tensor binary" if tensors else ""))


@dataclass(frozen=True)
class Stored:
    """Places of stored media and of their tensors."""

    media: str
    tensors: str

    @classmethod
    def at(cls, path: str) -> Stored:
        return cls(f"{path}/media", f"{path}/tensors")


def store_media(docs: DataFrame, place: Stored, tensors: bool = True) -> Stored:
    """Write ``doc_id, n_bytes, media`` of every text, and, decoded from the written media, each row's digests (the columns
    of :func:`read_media` but the feature) with its ``tensor``."""
    media_columns(docs).write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", LEVEL).parquet(place.media)
    if tensors:
        decoded = read_media(docs.sparkSession.read.parquet(place.media), True)
        decoded.drop("feature").write.option("compression", "zstd").parquet(place.tensors)
    return place


def read_tensors(spark, place: Stored) -> DataFrame:
    """The stored full-resolution RGB tensors: ``height`` x ``width`` x 3 bytes each, rows first."""
    return spark.read.parquet(place.tensors)


def read_features(tensors: DataFrame) -> DataFrame:
    """The columns of a table of tensors, with the feature of each in the tensor's place.  No shuffle."""
    require(tensors, ("height", "width", "tensor"))
    kept = tensors.drop("tensor").schema

    def run(batches):
        claim()
        for batch in batches:
            sizes = zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("height", "width")))
            at = batch.schema.get_field_index("tensor")
            features = [feature_of(np.frombuffer(t.as_buffer(), np.uint8), h, w) for t, (h, w) in zip(batch.column(at), sizes)]
            columns = [c for k, c in enumerate(batch.columns) if k != at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(features, pa.string())], [*kept.names, "feature"])

    return tensors.mapInArrow(run, StructType([*kept.fields, StructField("feature", StringType())]))


def op9_media(spark, sf_dir: str) -> DataFrame:
    """Every row of ``documents``: media are written to the shared folder, read back from there and decoded to tensors,
    which are written beside them; the features come from the stored tensors."""
    path = table_path(spark, "media")
    MADE.append(path)
    place = store_media(spark.read.parquet(f"{sf_dir}/documents.parquet"), Stored.at(path))
    return read_features(read_tensors(spark, place))
