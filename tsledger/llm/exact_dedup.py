"""Exact dedup by a minimal perfect hash over historical distinct digests.

Documents arrive in the order of their ids.  The *history* is the earlier part of that order; its distinct digests
are dealt by digest prefix into small buckets, and each bucket holds a minimal perfect hash whose slots carry the
full 32-byte digest and the locator of the winning row.  Digests of the *incoming* part are looked up in the bucket
of their prefix; a hit counts only when all 32 bytes of the slot agree.  Hits are repeats of the slot's winner,
digests that are not members form groups of their own.

:func:`store_index` keeps the hashes of a history and :func:`dedup_batch` looks later batches up in them.

Defined cases: a null text is the empty text; a very long text is hashed whole; a null ``doc_id`` loses to every other id; of rows that repeat id and
text one stays; an empty table gives an empty result; further input
columns, whatever their names, are ignored, and kept by :func:`keep_first`.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, drop_table, free_name, require, text_of, without, written

#: Distinct historical digests that one perfect hash holds, about; bounds the memory of a task.
BUCKET_DIGESTS = 32_768
#: Bits of a level for each key that is still unplaced.
GAMMA = 2.0
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9))


def _words(digests: np.ndarray) -> np.ndarray:
    """Digests (bytes objects of 32) as an array of n x 4 words."""
    return np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 4)


def _position(words: np.ndarray, level: int, size: int) -> np.ndarray:
    """Where a level puts each key."""
    with np.errstate(over="ignore"):
        x = words[:, level % 4] + words[:, (level + 1) % 4] * np.uint64(2 * level + 1)
        x = (x ^ (x >> np.uint64(31))) * _MIX[level % 2]
        x ^= x >> np.uint64(29)
    return (x % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Levels of bit arrays: a key belongs to the first level where no other remaining key shares its bit.

    A key's slot is the number of set bits before its own, so n keys fill exactly the slots 0 to n-1.
    """

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.before, total = [], 0
        for bits in levels:
            self.before.append(total + np.cumsum(bits) - bits)
            total += int(bits.sum())
        self.size = total

    @classmethod
    def build(cls, words: np.ndarray) -> PerfectHash:
        """``words``: distinct keys, n x 4."""
        levels, rest = [], words
        while len(rest):
            if len(levels) > 200:
                raise ValueError("the keys are not distinct")
            size = max(64, int(GAMMA * len(rest)))
            at = _position(rest, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone.astype(np.int64))
            rest = rest[~alone[at]]
        return cls(levels)

    def slots(self, words: np.ndarray) -> np.ndarray:
        """Slot of each key; -1 where no level claims it.  Keys outside the set may get any slot."""
        out = np.full(len(words), -1, np.int64)
        open_ = np.arange(len(words))
        for k, bits in enumerate(self.levels):
            if not len(open_):
                break
            at = _position(words[open_], k, len(bits))
            hit = bits[at] == 1
            out[open_[hit]] = self.before[k][at[hit]]
            open_ = open_[~hit]
        return out

    def dump(self) -> tuple[bytes, list[int]]:
        return b"".join(np.packbits(b.astype(np.uint8)).tobytes() for b in self.levels), [len(b) for b in self.levels]

    @classmethod
    def load(cls, data: bytes, sizes) -> PerfectHash:
        levels, at = [], 0
        for n in map(int, sizes):
            step = (n + 7) // 8
            levels.append(np.unpackbits(np.frombuffer(data, np.uint8, step, at))[:n].astype(np.int64))
            at += step
        return cls(levels)


def _digest():
    return F.unhex(F.sha2(F.regexp_replace(text_of(), SPACE_CLASS, " "), 256))


def digests(docs: DataFrame) -> DataFrame:
    """A row per document: ``doc_id``, ``digest`` (32 bytes of SHA-256 of the normalised text) and ``row``, a locator."""
    require(docs, ("doc_id", "text"))
    return docs.select(F.col("doc_id").cast("long"), _digest().alias("digest"), F.monotonically_increasing_id().alias("row"))


def _grouped(rows: DataFrame, buckets: int) -> DataFrame:
    """Distinct digests with winner (smallest id, null last, then first row) and count; combined before the shuffle."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))
    out = rows.groupBy("digest").agg(first.alias("win"), F.count(F.lit(1)).alias("n"))
    prefix = F.conv(F.substring(F.hex("digest"), 1, 8), 16, 10).cast("long")
    return out.select("digest", "n", F.col("win.doc_id").alias("win_id"), F.col("win.row").alias("win_row"), F.floor(prefix * F.lit(buckets) / F.lit(2**32)).cast("int").alias("bucket"))


INDEX_SCHEMA = "bucket int, levels binary, sizes array<int>, slots binary, win_id array<long>, win_row array<long>, n array<long>"
FOUND_SCHEMA = "digest binary, win_id long, win_row long, n long, member boolean"


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    words = _words(pdf["digest"].to_numpy())
    table = PerfectHash.build(words)
    order = np.argsort(table.slots(words))
    data, sizes = table.dump()
    own = pdf.iloc[order]
    ids = [None if pd.isna(x) else int(x) for x in own["win_id"]]
    return pd.DataFrame({"bucket": [int(pdf["bucket"].iloc[0])], "levels": [data], "sizes": [sizes], "slots": [words[order].tobytes()], "win_id": [ids], "win_row": [own["win_row"].tolist()], "n": [own["n"].tolist()]})


def build_index(history: DataFrame, buckets: int) -> DataFrame:
    """A row per bucket: the perfect hash, and in slot order full digests, winners and counts.

    ``history`` comes from :func:`digests`.  Digests are spread evenly, so a bucket's size is bounded by ``buckets``.
    """
    return _grouped(history, buckets).groupBy("bucket").applyInPandas(_build, INDEX_SCHEMA)


def _look_up(new: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    out = []
    words = _words(new["digest"].to_numpy()) if len(new) else np.zeros((0, 4), "<u8")
    member = np.zeros(len(new), bool)
    if len(index):
        own = index.iloc[0]
        slots = np.frombuffer(own["slots"], "<u8").reshape(-1, 4)
        at = PerfectHash.load(own["levels"], own["sizes"]).slots(words)
        member = (at >= 0) & (slots[at] == words).all(axis=1)  # all 32 bytes
        count = np.array(own["n"], np.int64)
        np.add.at(count, at[member], new["n"].to_numpy()[member])
        out.append(pd.DataFrame({"digest": [x.tobytes() for x in slots], "win_id": pd.array(list(own["win_id"]), "Int64"), "win_row": list(own["win_row"]), "n": count, "member": True}))
    rest = new[~member]
    out.append(pd.DataFrame({"digest": rest["digest"], "win_id": rest["win_id"].astype("Int64"), "win_row": rest["win_row"], "n": rest["n"], "member": False}))
    return pd.concat([x for x in out if len(x)] or out[-1:], ignore_index=True)


def look_up(index: DataFrame, incoming: DataFrame, buckets: int) -> DataFrame:
    """A row per distinct digest of either side: winner, group size, and whether the index holds it.

    Repeats are combined per digest before the shuffle, so a hot digest costs one row a task.
    """
    return _grouped(incoming, buckets).groupBy("bucket").cogroup(index.groupBy("bucket")).applyInPandas(_look_up, FOUND_SCHEMA)


def classes(rows: DataFrame, bucket_digests: int = BUCKET_DIGESTS) -> DataFrame:
    """Winner and size of every distinct digest of ``rows`` (a written table of :func:`digests`)."""
    low, high, n = rows.agg(F.min("doc_id"), F.max("doc_id"), F.count(F.lit(1))).first()
    cut = 0 if low is None else (low + high) // 2
    earlier = F.coalesce(F.col("doc_id") <= F.lit(cut), F.lit(False))
    buckets = max(1, math.ceil(n / bucket_digests))
    return look_up(build_index(rows.filter(earlier), buckets), rows.filter(~earlier), buckets)


def exact_dedup(docs: DataFrame, bucket_digests: int = BUCKET_DIGESTS) -> DataFrame:
    """A row per document: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    rows = written(digests(docs), "digests")
    found = classes(rows, bucket_digests)
    return rows.join(found, "digest").select(
        "doc_id", F.col("win_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("row") == F.col("win_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def keep_first(docs: DataFrame, bucket_digests: int = BUCKET_DIGESTS) -> DataFrame:
    """The documents that stay, with all their columns.

    Rows that repeat another's text under another id go by id and digest, so texts are shuffled only where those are
    very many; rows that repeat id and text are made one only where such rows exist.
    """
    rows = written(digests(docs), "digests")
    gone = rows.join(classes(rows, bucket_digests).filter("n > 1"), "digest").filter(~F.col("doc_id").eqNullSafe(F.col("win_id")))
    gone = written(gone.select(F.col("doc_id").alias("id"), "digest"), "gone")
    again = rows.groupBy("doc_id", "digest").count().filter("count > 1").limit(1).count()
    drop_table(docs.sparkSession, rows)
    out = without(docs, gone, _digest())
    if not again:
        return out
    text, one = free_name(docs, "__digest"), free_name(docs, "__first")
    return out.withColumn(text, _digest()).withColumn(one, F.struct("doc_id", text)).dropDuplicates([one]).drop(one, text)


def store_index(docs: DataFrame, path: str, bucket_digests: int = BUCKET_DIGESTS) -> str:
    """Build the perfect hashes of a whole history and write them to ``path``, for batches to come."""
    rows = written(digests(docs), "digests")
    buckets = max(1, math.ceil(rows.count() / bucket_digests))
    build_index(rows, buckets).withColumn("buckets", F.lit(buckets)).write.parquet(path)
    drop_table(docs.sparkSession, rows)
    return path


def dedup_batch(docs: DataFrame, path: str) -> DataFrame:
    """A row per document of a batch, ``doc_id, keep_id, group_size, kept, text_sha256``, against a stored index.

    A text that the history has is a repeat of the history's winner and not kept; of others the batch's own winner
    stays.  ``group_size`` counts both.  An index of an empty history has no rows, and all texts are new.
    """
    index = docs.sparkSession.read.parquet(path)
    first = index.select("buckets").first()
    rows = written(digests(docs), "digests")
    found = look_up(index.drop("buckets"), rows, first.buckets if first else 1)
    both = rows.join(found, "digest")
    kept = ~F.col("member") & (F.col("row") == F.col("win_row"))
    return both.select("doc_id", F.col("win_id").alias("keep_id"), F.col("n").alias("group_size"), kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Every row of ``documents``."""
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, h AS text_sha256
FROM d WINDOW w AS (PARTITION BY h)
"""
