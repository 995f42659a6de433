"""SimHash near-dedup: pigeonhole blocks, joined, then verified by Hamming distance.

Fingerprints of 64 bits are cut into blocks.  Two that differ in at most ``distance`` bits agree in all but that many
blocks, so they meet under at least one choice of the others; each choice is a key.  Work is done on distinct
fingerprints: copies meet in one row before anything is compared.  Under a key, fingerprints are compared by distance
and only a spanning set of links leaves the group, never all pairs.  A key with more than ``heavy`` distinct
fingerprints is not compared in one task: each of its fingerprints meets the others through the 65 patterns that
differ from it in at most one bit, which finds exactly the pairs at distance two or less, whatever the group's size.
For distances other than two such a key's fingerprints are compared in parts, every two parts in a task of their own.

The pipeline's stage (:func:`keep_one`) links these pairs and those whose five-word shingles share 0.8.  Fingerprints
cannot find the latter, whose 64 bits differ in ten places and more; bands of least hashes find them, and their whole
sets are compared.

Defined cases: a null text has no words; no words give fingerprint zero, linked like any other; fewer words than a
shingle are one shingle; very long texts are hashed whole, in parts; rows that repeat a ``doc_id`` each get a row; a
null ``doc_id`` counts as larger than all others and gets a component like any other row, whose id is null where no
member has one; an empty table gives an empty result; further columns are ignored by :func:`simhash_dedup` and kept by
:func:`keep_one`, whatever their names.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, drop_table, free_name, require, small, text_of, without, written
from .components import components

SHINGLE = 3
DISTANCE = 2
#: Distinct fingerprints under one key that a task compares directly.
HEAVY = 4096
#: Similarity of five-word shingles that the pipeline's stage links at.
SIMILARITY = 0.8
#: Bands of a set and least hashes in each: 1 - (1 - 0.8 ** 6) ** 24 = 0.9993 of pairs that share just 0.8 meet.
BANDS, ROWS = 24, 6
#: What a pair's sketches may agree in less than its sets must: four standard deviations.
SLACK = 0.14
#: Rows under one band that are compared in one group, and shingles for each of them.
TOGETHER, SHINGLES = 2048, 2000
_CHUNK = 1 << 15
_XOR, _ODD = np.random.default_rng(11).integers(0, 1 << 32, (2, BANDS * ROWS), np.uint32)
_ODD |= 1


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _grams(words: list[bytes], shingle: int) -> np.ndarray:
    """Hashes of a text's shingles in their order; fewer words than a shingle are one, no words none."""
    of = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([of(joined, 42)] if words else [], dtype="<u8")
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    begins = (ends - lengths)[: len(words) - shingle + 1].tolist()
    ends = ends[shingle - 1 :].tolist()
    return np.array([of(joined[a:b], 42) for a, b in zip(begins, ends)], dtype="<u8")


def _majority(hashes: np.ndarray) -> int:
    set_ = np.zeros(64, np.int64)
    for k in range(0, len(hashes), _CHUNK):
        part = hashes[k : k + _CHUNK]
        set_ += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * set_ > len(hashes)).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a text, unsigned."""
    return _majority(_grams(_words(text), shingle))


def five_shingles(words: list[bytes], threes: np.ndarray) -> np.ndarray:
    """The sorted set of a text's five-word shingles, hashed; ``threes`` are the hashes of its three-word ones.

    The three-word shingles at k and k + 2 hold the five words from k on, so their hashes are mixed.
    """
    if len(words) < 5:
        return _grams(words, 5).view(np.int64)
    with np.errstate(over="ignore"):
        x = threes[:-2] * np.uint64(0x9E3779B97F4A7C15) + threes[2:] * np.uint64(0xC2B2AE3D27D4EB4F)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique((x ^ (x >> np.uint64(29))).view(np.int64))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fp`` (signed long) of every document."""
    require(docs, ("doc_id", "text"))

    def run(batches):
        claim()
        for batch in batches:
            values = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def _block(k: int, blocks: int):
    low, high = 64 * k // blocks, 64 * (k + 1) // blocks
    return low, high


def block_keys(fps: DataFrame, distance: int, blocks: int) -> DataFrame:
    """``fps`` with a row for each key: ``choice`` (which blocks) and ``key`` (their bits)."""
    keys = []
    for k, own in enumerate(combinations(range(blocks), blocks - distance)):
        mask = sum(((1 << h) - (1 << l)) for l, h in (_block(b, blocks) for b in own))
        mask = mask - (1 << 64) if mask >= 1 << 63 else mask
        keys.append(F.struct(F.lit(k).alias("choice"), F.col("fp").bitwiseAND(F.lit(mask)).alias("key")))
    return fps.withColumn("__k", F.explode(F.array(*keys))).select(*fps.columns, "__k.choice", "__k.key")


def _spanning(nodes: np.ndarray, fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that join every set of fingerprints connected within the group: one fewer than its size."""
    links, rest = [], np.arange(len(fps))
    while len(rest):
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            at = frontier.pop()
            near = np.bitwise_count(fps[rest] ^ fps[at]) <= distance
            if near.any():
                found = rest[near]
                links += [(int(nodes[at]), int(nodes[x])) for x in found]
                frontier += found.tolist()
                rest = rest[~near]
    return links


def _groups(batches, distance: int):
    """Groups of equal (choice, key) of sorted rows; a group may cross batches."""
    held: list[np.ndarray] = []

    def flush(rows):
        starts = np.flatnonzero(np.any(rows[1:, :2] != rows[:-1, :2], axis=1)) + 1
        links = []
        for part in np.split(rows, starts):
            if len(part) > 1:
                links += _spanning(part[:, 2], part[:, 3].view(np.uint64), distance)
        at = np.array(links, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(at[:, 0]), pa.array(at[:, 1])], ["u", "v"])

    for batch in batches:
        rows = np.stack([np.asarray(batch.column(k).to_numpy(zero_copy_only=False), np.int64) for k in range(4)], axis=1)
        if not len(rows):
            continue
        rows = np.ascontiguousarray(np.concatenate([*held, rows]))
        last = np.flatnonzero(np.any(rows[:, :2] != rows[-1, :2], axis=1))
        cut = last[-1] + 1 if len(last) else 0
        if cut:
            yield flush(rows[:cut])
        held = [rows[cut:]]
    if held and len(held[0]):
        yield flush(held[0])


def links(fps: DataFrame, distance: int = DISTANCE, blocks: int | None = None, heavy: int = HEAVY) -> DataFrame:
    """Links ``u, v`` that connect distinct fingerprints (``node, fp``) wherever some pair is near enough.

    ``blocks``: two more than ``distance`` unless given.  Keys under which only one fingerprint stands are dropped by
    counts that are combined before the shuffle.
    """
    blocks = distance + 2 if blocks is None else blocks
    if not 0 <= distance < blocks <= 64:
        raise ValueError("a fingerprint has more blocks than its distance, and 64 at most")
    keyed = block_keys(fps, distance, blocks)
    counts = keyed.groupBy(F.col("choice").alias("__c"), F.col("key").alias("__k")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = written(keyed.join(counts, (F.col("choice") == F.col("__c")) & (F.col("key") == F.col("__k"))).select("choice", "key", "node", "fp", "n"), "blocks")
    light = met.filter(F.col("n") <= heavy).select("choice", "key", "node", "fp")
    many = met.filter(F.col("n") > heavy)
    if distance != 2:
        # every two parts of a heavy key meet in a group of their own
        parts = F.ceil(F.col("n") / F.lit(heavy)).cast("int")
        own = many.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        pair = F.xxhash64("choice", "key", F.least("part", "other"), F.greatest("part", "other"))
        light = light.unionAll(own.select(F.lit(-1).alias("choice"), pair.alias("key"), "node", "fp"))
    out = light.repartition("choice", "key").sortWithinPartitions("choice", "key", "node").mapInArrow(lambda batches: _groups(batches, distance), "u long, v long")
    if distance != 2:
        return out
    flips = F.array(F.lit(0).cast("long"), *[F.lit((1 << b) - (1 << 64) if b == 63 else 1 << b).cast("long") for b in range(64)])
    hubs = many.select("node", "fp").distinct().select("node", "fp", F.explode(flips).alias("flip")).select("node", F.col("fp").bitwiseXOR(F.col("flip")).alias("hub"))
    first = hubs.groupBy(F.col("hub").alias("__h")).agg(F.min("node").alias("u"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    through = hubs.join(first, F.col("hub") == F.col("__h")).filter("u <> node").select("u", F.col("node").alias("v"))
    return out.unionAll(through)


def near_classes(prints: DataFrame, distance: int = DISTANCE, blocks: int | None = None, heavy: int = HEAVY) -> DataFrame:
    """``fp, root, component`` for every distinct fingerprint of ``prints`` (``doc_id, fp``, a written table).

    A fingerprint is its own node, so rows without an id stay apart.  ``root`` is the component's least fingerprint,
    ``component`` its smallest id, null where no row of it has one.
    """
    fps = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fps")
    found = components(links(fps.select("fp", F.col("fp").alias("node")), distance, blocks, heavy).distinct())
    return _least_ids(fps.join(found, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("component", "fp").alias("root"), "least"))


def _least_ids(rooted: DataFrame) -> DataFrame:
    """``fp, root, component`` of ``fp, root, least``."""
    rooted = written(rooted, "rooted")
    ids = rooted.groupBy(F.col("root").alias("__root")).agg(F.min("least").alias("component"))
    return rooted.join(ids, F.col("root") == F.col("__root")).select("fp", "root", "component")


def simhash_dedup(docs: DataFrame, **options) -> DataFrame:
    """A row per document: ``doc_id, fingerprint, component_id``."""
    prints = written(fingerprints(docs), "prints")
    classes = near_classes(prints, **options)
    return prints.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def _digest():
    return F.unhex(F.sha2(text_of(), 256))


def minima(own: np.ndarray) -> np.ndarray:
    """The least value of a set of 32-bit hashes under each of BANDS x ROWS permutations."""
    out = np.full(len(_XOR), 0xFFFFFFFF, np.uint32)
    for k in range(0, len(own), 1024):
        out = np.minimum(out, ((own[None, k : k + 1024] ^ _XOR[:, None]) * _ODD[:, None]).min(axis=1))
    return out


MARKS = "row long, doc_id long, digest binary, fp long, sid long, n int, shingles array<int>, bands array<long>, sketch binary"


def _marked(words: list[bytes]) -> tuple:
    threes = _grams(words, SHINGLE)
    own = np.unique((five_shingles(words, threes).view(np.uint64) >> np.uint64(32)).astype(np.uint32))
    least = minima(own)
    bands = [xxhash.xxh64_intdigest(least[k * ROWS : (k + 1) * ROWS].tobytes(), k) for k in range(BANDS)]
    sid = xxhash.xxh64_intdigest(own.tobytes(), 7)
    return _majority(threes), sid, own.view(np.int32), bands, least.astype(np.uint8).tobytes()


def marks(docs: DataFrame) -> DataFrame:
    """A row per document: locator, id, digest of the text, fingerprint; its set of five-word shingles as 32-bit hashes,
    the set's hash ``sid`` and size ``n``; the keys of its bands and its sketch, a byte of each minimum."""
    require(docs, ("doc_id", "text"))

    def run(batches):
        claim()
        for batch in batches:
            for part in (batch.slice(k, 1024) for k in range(0, batch.num_rows, 1024)):
                fps, sids, sets, bands, sketches = zip(*(_marked(_words(t.as_py())) for t in part.column(3)))
                signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
                sizes = np.array([len(x) for x in sets], np.int32)
                ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                keys = pa.ListArray.from_arrays(pa.array(np.arange(0, BANDS * len(fps) + 1, BANDS, dtype=np.int32)), signed([k for own in bands for k in own]))
                columns = [signed(fps), signed(sids), pa.array(sizes), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets))), keys, pa.array(sketches, pa.binary())]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *columns], ["row", "doc_id", "digest", "fp", "sid", "n", "shingles", "bands", "sketch"])

    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), _digest().alias("digest"), F.col("text").cast("string")).mapInArrow(run, MARKS)


def _chosen(own: DataFrame, rows: DataFrame, *columns: str) -> DataFrame:
    """``row`` and the columns of the wanted ``rows`` (a written table); sets are shuffled only where they are many."""
    side = small(rows.select(F.col("row").alias("__r")), 8)
    return own.select("row", *columns).join(side, F.col("row") == F.col("__r"), "left_semi")


def _verified(pairs: DataFrame, marked: DataFrame, similarity: float) -> DataFrame:
    """Links ``u, v`` between fingerprints of the pairs (``a, b``: rows) whose whole sets are similar enough."""
    needed = written(pairs.select(F.col("a").alias("row")).unionAll(pairs.select("b")).distinct(), "needed")
    own = written(_chosen(marked, needed, "fp", "shingles"), "sets")
    a, b = (own.select(F.col("row").alias(f"{x}_row"), F.col("fp").alias(f"{x}_fp"), F.col("shingles").alias(f"{x}_set")) for x in "ab")
    both = pairs.join(a, F.col("a") == F.col("a_row")).join(b, F.col("b") == F.col("b_row"))
    shared = F.size(F.array_intersect("a_set", "b_set"))
    alike = shared >= F.lit(similarity - 1e-9) * (F.size("a_set") + F.size("b_set") - shared)
    out = written(both.filter(alike).select(F.col("a_fp").alias("u"), F.col("b_fp").alias("v")).filter("u <> v").distinct(), "alike")
    for spent in (needed, own):
        drop_table(marked.sparkSession, spent)
    return out


def _rooted(fps: DataFrame, edges: DataFrame) -> DataFrame:
    """``fp, root`` of distinct ``fps`` under links ``u, v``."""
    found = components(edges)
    return written(fps.join(found, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("component", "fp").alias("root")), "rooted")


class _Group:
    """Rows under one band: links between its components are found without looking at pairs within one."""

    def __init__(self, table: pa.Table, similarity: float):
        self.part, self.low, self.high, self.root, self.fp = (table.column(k).to_numpy() for k in ("part", "low", "high", "root", "fp"))
        self.sets = [x.values.to_numpy() for x in table.column("shingles")]
        self.n = np.array([len(x) for x in self.sets])
        self.sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(len(self.n), -1)
        self.similarity, self.enough = similarity, (similarity - SLACK) * BANDS * ROWS

    def alike(self, at: int, other: np.ndarray) -> np.ndarray:
        """Those of ``other`` whose whole sets are as similar to that of ``at`` as asked for."""
        other = other[np.minimum(self.n[other], self.n[at]) >= self.similarity * np.maximum(self.n[other], self.n[at]) - 1e-9]
        other = other[(self.sketch[other] == self.sketch[at]).sum(axis=1) >= self.enough]
        if not len(other):
            return other
        own, theirs = np.sort(self.sets[at]), np.concatenate([self.sets[k] for k in other])
        hit = own[np.minimum(np.searchsorted(own, theirs), len(own) - 1)] == theirs
        shared = np.add.reduceat(hit, np.concatenate([[0], np.cumsum(self.n[other])[:-1]]))
        return other[shared >= (self.similarity - 1e-9) * (self.n[other] + self.n[at] - shared)]

    def links(self, own: np.ndarray) -> list[tuple[int, int]]:
        """Links that join what belongs together among the rows ``own`` of one band and pair of parts."""
        left, right = own[self.part[own] == self.low[own]], own[self.part[own] == self.high[own]]
        found, root = [], self.root.copy()
        for k, at in enumerate(left):
            # within one part each pair once
            other = right[k + 1 :] if self.low[at] == self.high[at] else right
            for x in self.alike(at, other[root[other] != root[at]]):
                if root[x] != root[at]:
                    found.append((int(self.fp[at]), int(self.fp[x])))
                    root[own[root[own] == root[x]]] = root[at]
        return found


def _linked(batches, similarity: float):
    """Links ``u, v`` between fingerprints of sorted rows ``key, low, high, part, row, root, fp, shingles, sketch``."""
    claim()
    held: list[pa.RecordBatch] = []

    def links(table: pa.Table):
        group = np.stack([table.column(k).to_numpy() for k in ("key", "low", "high")], axis=1)
        rows, out = _Group(table, similarity), []
        for own in np.split(np.arange(len(group)), np.flatnonzero(np.any(group[1:] != group[:-1], axis=1)) + 1):
            out += rows.links(own)
        at = np.array(out, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(at[:, 0]), pa.array(at[:, 1])], ["u", "v"])

    for whole in batches:
        for batch in (whole.slice(k, 1024) for k in range(0, whole.num_rows, 1024)):
            # all but the last group is complete
            same = np.ones(batch.num_rows, bool)
            for k in ("key", "low", "high"):
                own = batch.column(k).to_numpy()
                same &= own == own[-1]
            cut = batch.num_rows - int(same.sum())
            if cut or (held and any(held[-1].column(k)[-1].as_py() != batch.column(k)[0].as_py() for k in ("key", "low", "high"))):
                yield links(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
    if held:
        yield links(pa.Table.from_batches(held))


def similar_classes(own: DataFrame, similarity: float = SIMILARITY, together: int = TOGETHER, **options) -> DataFrame:
    """``fp, root`` of every distinct fingerprint of ``own`` (a written table of :func:`marks`).

    Two rows belong together when their fingerprints differ in at most DISTANCE bits or their sets of five-word
    shingles share ``similarity`` (Jaccard), and so on along chains.  Candidates for the latter meet under a band of
    least hashes; whole sets decide.  Under each band all rows are held against two of them; then, where more than one
    component is left under a band, rows of different components that their sketches do not rule out are held against
    one another, and only links that join components leave the band.  Bands with more than ``together`` rows, or very
    large sets, are compared in parts of about that size.
    """
    spark = own.sparkSession
    fps = written(own.select("fp").distinct(), "fps")
    near = links(fps.select("fp", F.col("fp").alias("node")), **options).distinct()
    heads = written(own.groupBy("sid").agg(F.min("row").alias("head"), F.min("fp").alias("u"), F.count(F.lit(1)).alias("c")), "heads")
    equal = own.select("fp", "sid").join(heads.filter("c > 1").select("sid", "u"), "sid").filter("u <> fp").select("u", F.col("fp").alias("v"))
    single = own.filter("n > 0").select("row", "fp", "n", "bands").join(heads.select("head"), F.col("row") == F.col("head"), "left_semi")
    keyed = single.select("row", "fp", "n", F.explode("bands").alias("key"))
    keys = keyed.groupBy(F.col("key").alias("__k")).agg(F.min("row").alias("low"), F.max("row").alias("high"), F.count(F.lit(1)).alias("c"), F.sum("n").alias("size")).filter("c > 1")
    met = written(keyed.drop("n").join(keys, F.col("key") == F.col("__k")).drop("__k"), "met")
    star = written(met.select(F.col("low").alias("a"), F.col("row").alias("b")).unionAll(met.select("row", "high")).filter("a <> b").distinct(), "star")
    alike = _verified(star, own, similarity)
    edges = written(near.unionAll(equal).unionAll(alike), "edges")
    rooted = _rooted(fps, edges)
    open_ = met.select("key", "row", "fp", "c", "size").join(rooted, "fp")
    mixed = open_.groupBy(F.col("key").alias("__k")).agg(F.min("root").alias("r"), F.max("root").alias("s")).filter("r <> s").select("__k")
    parts = F.ceil(F.greatest(F.col("c") / F.lit(together), F.col("size") / F.lit(together * SHINGLES))).cast("int")
    open_ = open_.join(mixed, F.col("key") == F.col("__k"), "left_semi").select("key", "row", "fp", "root", parts.alias("parts"))
    part = F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")
    spread = open_.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    spread = written(spread.select("key", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "row", "fp", "root"), "open")
    needed = written(spread.select("row").distinct(), "needed")
    sets = _chosen(own, needed, "shingles", "sketch").withColumnRenamed("row", "__s")
    dealt = spread.join(sets, F.col("row") == F.col("__s")).drop("__s").repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "row")
    late = written(dealt.mapInArrow(lambda batches: _linked(batches, similarity), "u long, v long").distinct(), "late")
    out = _rooted(fps, edges.unionAll(late)) if late.limit(1).count() else rooted
    for spent in (met, star, alike, edges, spread, needed, late, heads, fps, *([rooted] if out is not rooted else [])):
        drop_table(spark, spent)
    return out


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, **options) -> DataFrame:
    """One document of each component of :func:`similar_classes`, the one with the smallest id, with all columns.

    The row that stays is found again by id and digest: ids may be null or repeat.  Rows that share both are made one
    only where such rows exist.
    """
    own = written(marks(docs), "marks")
    classes = similar_classes(own, similarity, **options)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest")).alias("win")
    slim = own.select("doc_id", "digest", "fp")
    rooted = slim.join(classes, "fp")
    # only groups of several rows lose any; both sides of the join are plain, so a large group's rows may be split
    stay = written(rooted.groupBy(F.col("root").alias("__r")).agg(first, F.count(F.lit(1)).alias("c")).filter("c > 1"), "stay")
    won = F.col("doc_id").eqNullSafe(F.col("win.doc_id")) & (F.col("digest") == F.col("win.digest"))
    gone = rooted.join(stay, F.col("root") == F.col("__r")).filter(~won).select(F.col("doc_id").alias("id"), "digest")
    gone = written(gone, "gone")
    again = slim.groupBy("doc_id", "digest").count().filter("count > 1").limit(1).count()
    for spent in (own, classes, stay):
        drop_table(docs.sparkSession, spent)
    out = without(docs, gone, _digest())
    if not again:
        return out
    text, one = free_name(docs, "__digest"), free_name(docs, "__first")
    return out.withColumn(text, _digest()).withColumn(one, F.struct("doc_id", text)).dropDuplicates([one]).drop(one, text)


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    """Every row of ``documents``."""
    return simhash_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
