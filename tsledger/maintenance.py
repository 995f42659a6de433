"""Verification, recovery and compaction."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .errors import CorruptedError, LedgerError, NotAStoreError
from .operators.history import ORIGIN
from .plans.files import Files
from .plans.lock import Lock
from .plans.manifest import HEAD, LOG, Catalog, Manifest, current, name_of
from .plans.read import DevicePlan
from .store import Reader, session


@dataclass
class VerifyReport:
    commits: int = 0
    files: int = 0
    rows: int = 0
    problems: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)

    @property
    def ok(self) -> bool:
        return not self.problems

    def __bool__(self) -> bool:
        return self.ok


@dataclass
class RecoverReport:
    removed_files: int = 0
    removed_bytes: int = 0
    removed_commits: int = 0


@dataclass
class CompactReport:
    rows: int = 0
    annotations: int = 0
    source_bytes: int = 0
    target_bytes: int = 0
    source_hash: str = ORIGIN


def damaged_files(catalog: Catalog) -> Iterator[tuple[str, str]]:
    """(path, problem) of listed data files that are missing or whose bytes changed; hashed on the executors."""
    known = {f.path: f for m in catalog.manifests for f in m.files}
    there = {n for n, _ in catalog.files.walk("points")}
    yield from ((p, "is missing") for p in sorted(set(known) - there))
    found = [p for p in known if p in there]
    if found:
        spark = catalog.files.spark
        listed = spark.createDataFrame([(catalog.files.url(p).rsplit("/points/", 1)[1], known[p].sha256) for p in found], "name string, sha string")
        # binaryFile's own path column ends with the name below points/
        hashed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(catalog.files.url("points")).select(F.regexp_extract("path", "/points/(.*)$", 1).alias("name"), F.sha2("content", 256).alias("now"))
        for r in listed.join(hashed, "name", "left").filter(~F.col("sha").eqNullSafe(F.col("now"))).orderBy("name").collect():
            yield f"points/{r.name}", "has other bytes than its commit recorded"


def verify(path: str, spark: SparkSession | None = None) -> VerifyReport:
    """Check the chain of commits, the hashes of all files and that every row can be read in its bounds."""
    spark, out = session(spark), VerifyReport()
    files = current(Files(spark, str(path)))
    try:
        catalog = Catalog.open(files)
    except CorruptedError as e:
        out.problems.append(str(e))
        return out
    before, devices, seq = catalog.origin, set(), 1
    for m in catalog.manifests:
        name = f"commit {m.number}"
        if m.prev_hash != before:
            out.problems.append(f"{name} does not continue the one before")
        if type(m)(**(vars(m) | {"hash": ""})).seal().hash != m.hash:
            out.problems.append(f"{name} does not have its hash")
        before = m.hash
        devices |= {d["name"] for d in m.devices}
        for f in m.files:
            if f.device not in devices:
                out.problems.append(f"{name} writes to an unknown device")
        for d in m.deletions:
            if d[0] not in devices or d[1] > d[2] or not seq <= d[3] < m.next_seq:
                out.problems.append(f"{name} has a deletion that cannot be")
        live = {}
        for n in m.notes:
            if n[2] not in devices or n[3] > n[4]:
                out.problems.append(f"{name} has an annotation that cannot be")
            live[n[0]] = n[1]
        seq = m.next_seq
        out.commits += 1
        out.files += len(m.files)
        out.rows += sum(f.rows for f in m.files)
    seen: set[int] = set()
    for m in catalog.manifests:
        for n in m.notes:
            if n[1] == "remove" and n[0] not in seen:
                out.problems.append(f"commit {m.number} removes annotation {n[0]}, which is not there")
            (seen.add if n[1] == "put" else seen.discard)(n[0])
    bad = dict(damaged_files(catalog))
    out.problems += [f"{p} {why}" for p, why in bad.items()]
    for schema in catalog.schemas.values():
        own = [f for m in catalog.manifests for f in m.files if f.device == schema.name and f.path not in bad]
        if own:
            plan = DevicePlan(catalog, schema)
            rows = spark.read.schema(plan._scan([], schema.column_names).drop("device").schema).parquet(*[files.url(f.path) for f in own])
            facts = rows.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("lo"), F.max("t").alias("hi"), F.count_distinct("t").alias("times"), *(F.count(f"`{c}`") for c in schema.column_names))
            got = {r["path"][r["path"].rindex("/points/") + 1 :]: (r["n"], r["lo"], r["hi"], r["times"]) for r in facts.collect()}
            out.problems += [f"{f.path} has other rows than its commit recorded" for f in own if got.get(f.path) != (f.rows, f.t_min, f.t_max, f.rows)]
    left = catalog.unreferenced()
    if left or catalog.unfinished:
        out.warnings.append(f"{len(left) + len(catalog.unfinished)} files of an unfinished commit")
    return out


def recover(path: str, force: bool = False, spark: SparkSession | None = None) -> RecoverReport:
    """Remove what an unfinished commit, a replaced store or a dead writer left; no writer may be at work.

    A last manifest that breaks off is the tail of an unfinished commit and goes.  Any other damaged or missing
    manifest or data file is an error; with ``force`` it and all commits after it go.
    """
    spark, out = session(spark), RecoverReport()
    files = current(Files(spark, str(path)))
    if not files.exists(HEAD):
        raise NotAStoreError(f"{path} is not a store")
    lock = Lock(files)
    try:
        _recover(files, force, out)
    finally:
        lock.release()
    whole = Files(spark, str(path))
    if whole.root != files.root:
        for name in whole.names(""):
            if name != HEAD and whole.url(name) != files.root:
                sizes = [s for _, s in whole.walk(name)]
                out.removed_files += len(sizes)
                out.removed_bytes += sum(sizes)
                whole.delete(name)
    return out


def _breaks_off(text: str) -> bool:
    """Whether a manifest's text ends before it is complete."""
    try:
        json.loads(text)
    except ValueError as e:
        return getattr(e, "pos", 0) >= len(text.rstrip()) - 1 or not text.rstrip().endswith("}")
    return False


def _recover(files: Files, force: bool, out: RecoverReport) -> None:

    names = files.names(LOG)
    good, before = 0, None
    sizes = dict(files.walk())
    for k, n in enumerate((x for x in names if x.endswith(".json")), 1):
        try:
            m = Manifest.from_text(files.read(f"{LOG}/{n}"), n)
            if m.number != k or (before is not None and m.prev_hash != before) or any(f.path not in sizes for f in m.files):
                break
            if type(m)(**(vars(m) | {"hash": ""})).seal().hash != m.hash:
                break
        except LedgerError:
            break
        good, before = k, m.hash
    later = [n for n in names if n.endswith(".json") and n > name_of(good).rsplit("/", 1)[1]]
    if len(later) == 1 and later[0] == name_of(good + 1).rsplit("/", 1)[1] and _breaks_off(files.read(f"{LOG}/{later[0]}")):
        force = True
    if later and not force:
        raise CorruptedError(f"commit {good + 1} is damaged; force cuts it and all later ones", f"{LOG}/{later[0]}")
    for n in later:
        out.removed_commits += 1
        files.delete(f"{LOG}/{n}")
    catalog = Catalog.open(files)
    for n in catalog.unfinished:
        files.delete(n)
        out.removed_files += 1
    for n, size in catalog.unreferenced():
        files.delete(n)
        out.removed_files += 1
        out.removed_bytes += size


def compact(source: str, target: str, as_of: int | None = None, overwrite: bool = False, spark: SparkSession | None = None, **options) -> CompactReport:
    """One version as a new store without history, whose chain starts at the source's hash.

    Rows go through one shuffle, dealt and sorted by time, so the new files do not overlap and later reads need none.
    """
    from .edit import Writer

    spark = session(spark)
    with Reader(str(source), spark) as reader:
        commits = reader.catalog.upto(as_of)
        out = CompactReport(source_hash=commits[-1].hash if commits else ORIGIN)
        out.source_bytes = sum(s for _, s in reader.catalog.files.walk())
        w = Writer.create(str(target), overwrite=overwrite, origin=out.source_hash, spark=spark, **options)
        try:
            from .types import DeviceSchema

            for d in (d for m in commits for d in m.devices):
                schema = w.create_device(DeviceSchema.from_json(d))
                rows = DevicePlan(reader.catalog, schema, as_of).rows(schema.column_names)
                w._stage(schema.name).items.append(("frame", rows.withColumn("ord", F.lit(0).cast("long")), False))
            for a in reader.annotations(as_of=as_of if as_of is not None else None):
                w.restore_annotation(a.id, a.device, a.start, a.end, a.label, a.note)
                out.annotations += 1
            w.update_metadata(reader.catalog.metadata(as_of) | {"compacted_from": str(source), "compacted_commit": str(len(commits)), "compacted_hash": out.source_hash})
            info = w.commit("compact")
            out.rows = info.changes.rows_written
        finally:
            w.close()
    out.target_bytes = sum(s for _, s in Files(spark, str(target)).walk())
    return out
