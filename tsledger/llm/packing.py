"""Best-fit packing of tokenised documents into sequences of fixed length.

Bounded-space online best fit: at most ``open_bins`` bins are open; a bitset has a bit for each free space that some
open bin has, so the tightest bin that still fits is one bit scan away.  When one bin too many is open, the fullest
closes.  Every input partition packs its own documents while it tokenises them, without a shuffle.  Bins that are
still open when a partition ends are opened again: their pieces, and only those, are dealt by hash into groups of
bounded size and packed once more, where they arrive in runs by hash, the longest of a run first.  Every piece is placed
when it arrives; none is held back.

Token identifiers are those of the vocabulary file's library.  A text is parted at its spaces; identifiers of chunks
and of pattern pieces are kept in bounded tables per worker.  A text in which white space other than single spaces
and inner line ends occurs goes to the library whole.

Defined cases: a null text is empty; every document ends with ``END``, so an empty one is one piece of length 1; a
document longer than a sequence is cut, its first piece being the shorter, however long it is; a repeated or null
``doc_id`` is packed like any other; an empty table gives an empty result; further columns, whatever their names, are
ignored.
"""

from __future__ import annotations

import json
import math
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Recent, claim, require, trim, written

LENGTH = 1024
END = 2
OPEN_BINS = 2048
#: Pieces that one task of the second round packs, about.
GROUP_PIECES = 20_000
#: Pieces of a run of the second round, about: fewer than the bins that may be open.
RUN_PIECES = 2000
VOCABULARY = "byte_bpe_50k.json"
_ODD_SPACE = re.compile(r"[^\S\n]|\n\n|\A\n|\n\Z")


class Tokens:
    """Token identifiers under one byte-level vocabulary file, as bytes of little-endian unsigned 32-bit numbers.

    Where the file numbers its merges in order, as rank vocabularies do, single chunks go through the rank tokeniser,
    which gives the same identifiers in a third of the time; else, and for whole texts, through the file's library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.ranked = self._ranked(path)
        self.chunks = Recent(self._chunk)

    @staticmethod
    def _ranked(path: str):
        import tiktoken
        from public_tokenizers import PATTERN

        from .tokens import byte_symbols

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, byte = model["vocab"], {c: b for b, c in enumerate(byte_symbols())}
        if any(vocab["".join(m)] != 256 + k for k, m in enumerate(model["merges"])) or len(vocab) != 256 + len(model["merges"]):
            return None
        ranks = {bytes(byte[c] for c in word): n for word, n in vocab.items()}
        return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def whole(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _chunk(self, chunk: str) -> bytes | None:
        """Of a space and ``chunk``; None if its white space needs the whole text."""
        if not chunk or _ODD_SPACE.search(chunk):
            return None
        if self.ranked is None or max(chunk) >= "ɐ" or any(s in chunk for s in self.special):
            return self.whole(" " + chunk)
        return array("I", self.ranked(" " + chunk)).tobytes()

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        first, *rest = text.split(" ")
        if not first or _ODD_SPACE.search(first):
            return self.whole(text)
        try:
            return self.whole(first) + b"".join(map(self.chunks.__getitem__, rest))
        except TypeError:  # a None among them
            return self.whole(text)


@lru_cache(maxsize=2)
def tokens(path: str) -> Tokens:
    """The worker's tables for a vocabulary file."""
    return Tokens(path)


def cuts(n: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """Start and length of the pieces of n tokens: whole ones, after a first one that may be shorter."""
    first = (n - 1) % length + 1
    return [(0, first)] + [(at, length) for at in range(first, n, length)]


class BestFit:
    """Open bins by free space.  ``add`` and ``finish`` give closed bins as (number, [(item, offset)])."""

    def __init__(self, length: int, open_bins: int):
        self.length, self.most = length, open_bins
        self.bits, self.bins, self.count, self.next = 0, [[] for _ in range(length + 1)], 0, 0

    def _new(self) -> int:
        self.next += 1
        return self.next - 1

    def add(self, item, size: int) -> list:
        if size >= self.length:
            return [(self._new(), [(item, 0)])]
        fits = self.bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            own = self.bins[free].pop()
            if not self.bins[free]:
                self.bits &= ~(1 << free)
            self.count -= 1
        else:
            free, own = self.length, (self._new(), [])
        own[1].append((item, self.length - free))
        free -= size
        if not free:
            return [own]
        self.bins[free].append(own)
        self.bits |= 1 << free
        self.count += 1
        return [self._close()] if self.count > self.most else []

    def _close(self):
        free = (self.bits & -self.bits).bit_length() - 1
        own = self.bins[free].pop(0)
        if not self.bins[free]:
            self.bits &= ~(1 << free)
        self.count -= 1
        return own

    def finish(self) -> list:
        return [self._close() for _ in range(self.count)]


PIECES = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())]
_PLACE = [("sequence_id", pa.int64()), ("offset", pa.int64()), ("open", pa.bool_())]
_DDL = "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long, open boolean"


class _Rows:
    """Rows of closed bins, as record batches."""

    def __init__(self, fields, second: bool, most: int = 4000):
        self.schema = pa.schema([*fields, *_PLACE])
        self.base = (TaskContext.get().partitionId() << 33) | (int(second) << 32)
        self.rows, self.most = [], most

    def put(self, closed, open_: bool) -> None:
        for number, items in closed:
            self.rows += [(*item, self.base | number, offset, open_) for item, offset in items]

    def full(self):
        if len(self.rows) >= self.most:
            yield self.rest()

    def rest(self):
        columns = list(zip(*self.rows)) or [()] * len(self.schema)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.schema)], schema=self.schema)


def pack_partitions(docs: DataFrame, vocabulary: str | None = None, length: int = LENGTH, end: int = END, open_bins: int = OPEN_BINS) -> DataFrame:
    """Tokenise, cut and pack, each partition for itself.  A row per piece with its ``ids`` and place; ``open``: its
    bin was still open at the partition's end."""
    require(docs, ("doc_id", "text"))
    tail = np.array([end], "<u4").tobytes()

    def run(batches):
        from .tokens import vocabulary_path

        claim("packing", tokens.cache_clear)
        table = tokens(vocabulary or vocabulary_path(VOCABULARY))
        of, packer, out = table.ids, BestFit(length, open_bins), _Rows(PIECES, False)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = of(text.as_py()) + tail
                for k, (start, n) in enumerate(cuts(len(ids) // 4, length)):
                    out.put(packer.add((doc_id, k, start, n, ids[4 * start : 4 * (start + n)]), n), False)
                yield from out.full()
        out.put(packer.finish(), True)
        table.chunks.forget()
        trim()
        yield out.rest()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _DDL)


def repack(pieces: DataFrame, length: int = LENGTH, open_bins: int = OPEN_BINS, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Second round: pieces of open bins are packed anew in groups; the others stay where they are.

    ``pieces``: a written table of :func:`pack_partitions`; other columns pass through.
    """
    kept = [c for c in pieces.columns if c not in ("sequence_id", "offset", "open")]
    left = pieces.filter("open")
    n = left.count()
    at = kept.index("length")
    key = F.xxhash64("doc_id", "piece", "length")
    many = max(1, math.ceil(n / group_pieces))
    run = F.pmod(F.shiftright(key, 16), F.lit(max(1, math.ceil(n / many / RUN_PIECES))))
    groups = left.select(*kept).repartition(many, key).sortWithinPartitions(run, F.col("length").desc(), key, "doc_id", "piece")
    schema = groups.schema
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), "sequence_id long", "offset long", "open boolean"])

    def run(batches):
        packer, out = BestFit(length, open_bins), None
        for batch in batches:
            out = out or _Rows([(f.name, f.type) for f in batch.schema], True)
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                out.put(packer.add(row, row[at]), False)
            yield from out.full()
        if out:
            out.put(packer.finish(), False)
            yield out.rest()

    again = groups.mapInArrow(run, ddl)
    return pieces.filter("not open").select(*kept, "sequence_id", "offset").unionAll(again.select(*kept, "sequence_id", "offset"))


def pack_documents(docs: DataFrame, columns: dict | None = None, **options) -> DataFrame:
    """A row per piece: ``doc_id, piece, start, length``, the columns asked for, ``sequence_id, offset``.

    ``columns``: expressions over ``ids`` to keep, by name; by default the identifiers themselves.
    """
    columns = columns or {"ids": F.col("ids")}
    first = pack_partitions(docs, **options)
    slim = written(first.select("doc_id", "piece", "start", "length", *[c.alias(k) for k, c in columns.items()], "sequence_id", "offset", "open"), "packed")
    return repack(slim, **{k: v for k, v in options.items() if k in ("length", "open_bins")})


def pack_digests(docs: DataFrame) -> DataFrame:
    """:func:`pack_documents` with ``ids_crc32`` in place of the identifiers."""
    return pack_documents(docs, {"ids_crc32": F.crc32("ids")})


def op5_packing(spark, sf_dir: str) -> DataFrame:
    """Every row of ``documents``."""
    return pack_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
