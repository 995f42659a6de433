"""Reading a store: pinned versions, queries, history; and the module functions users start from."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import InvalidArgumentError, NotAStoreError, NotFinalizedError, UnknownColumnError, UnknownDeviceError
from .functions.timeconv import to_datetime, to_nanos, to_raw
from .operators import annotations as notes
from .operators import history, snapshot
from .plans.files import Files
from .plans.manifest import HEAD, LAYOUT, Catalog, CommitInfo
from .plans.read import DevicePlan, note_rows
from .sources.batch import Batch
from .types import DeviceSchema

#: Rows of one batch of an iteration.
BATCH_ROWS = 65_536


def session(spark: SparkSession | None = None) -> SparkSession:
    """The session given, the active one, or a local one."""
    return spark or SparkSession.getActiveSession() or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _as_streams(batches):
    """Each batch as one row: the bytes of an Arrow stream."""
    for batch in batches:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema) as writer:
            writer.write_batch(batch)
        yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["stream"])


@dataclass(frozen=True)
class Annotation:
    id: int
    device: str
    start: int
    end: int
    label: str
    note: str | None = None


@dataclass(frozen=True)
class BlockInfo:
    """One file of rows."""

    commit: int
    path: str
    rows: int
    t_min: int
    t_max: int
    size: int


@dataclass(frozen=True)
class Query:
    """A device, columns, a closed range of raw times and a version; every method gives a new query."""

    reader: Reader
    schema: DeviceSchema
    names: tuple[str, ...] | None = None
    start: int | None = None
    end: int | None = None
    version: int | None = None

    def columns(self, names: Iterable[str]) -> Query:
        own = tuple(names)
        for n in own:
            if self.schema.column_index(n) is None:
                raise UnknownColumnError(self.schema.name, n)
        return replace(self, names=own)

    def time_range(self, start: int | None = None, end: int | None = None) -> Query:
        return replace(self, start=start, end=end)

    def as_of(self, commit: int | None) -> Query:
        self.reader.catalog.upto(commit)
        return replace(self, version=commit)

    @property
    def device(self) -> DeviceSchema:
        return self.schema

    @property
    def selected(self) -> list[str]:
        return self.schema.column_names if self.names is None else list(self.names)

    @property
    def result_schema(self) -> DeviceSchema:
        own = {c.name: c for c in self.schema.columns}
        return replace(self.schema, columns=tuple(own[n] for n in self.selected))

    def plan(self) -> DevicePlan:
        return DevicePlan(self.reader.catalog, self.schema, self.version, self.start, self.end)

    def dataframe(self) -> DataFrame:
        """``t`` and the columns, lazily and in no order, to go on with in Spark."""
        return self.plan().rows(self.selected)

    def view(self, name: str) -> DataFrame:
        """:meth:`dataframe` as a temporary view for Spark SQL."""
        out = self.dataframe()
        out.createOrReplaceTempView(name)
        return out

    def collect(self) -> Batch:
        return Batch.from_arrow(self.dataframe().orderBy("t").toArrow(), self.result_schema)

    def batches(self, rows: int = BATCH_ROWS) -> Iterator[Batch]:
        """Batches in the order of time; one partition at a time is on the driver, as Arrow batches."""
        from .sources.batch import ARROW

        types, own = self.schema.types, self.dataframe().orderBy("t")
        shape = pa.schema([("t", pa.int64()), *((n, ARROW[types[n]]) for n in own.columns[1:])])
        held: list[pa.RecordBatch] = []

        def upto(n: int) -> Batch:
            table = pa.Table.from_batches(held, held[0].schema).cast(shape)
            held[:] = table.slice(n).to_batches()
            return Batch.from_arrow(table.slice(0, n), self.result_schema)

        for row in own.mapInArrow(_as_streams, "stream binary").toLocalIterator(prefetchPartitions=True):
            held += pa.ipc.open_stream(bytes(row.stream)).read_all().to_batches()
            while sum(b.num_rows for b in held) >= rows:
                yield upto(rows)
        if sum(b.num_rows for b in held):
            yield upto(rows)

    def count(self) -> int:
        return self.plan().times().count()


class Reader:
    """A store as it was when it was opened; later commits do not show."""

    def __init__(self, path: str, spark: SparkSession | None = None, strict: bool = False, verify_checksums: bool = False):
        self.path = str(path)
        self.spark = session(spark)
        self.catalog = Catalog.open(Files(self.spark, self.path))
        if strict and (self.catalog.unfinished or self.catalog.unreferenced()):
            raise NotFinalizedError(f"{path} has files of an unfinished commit")
        if verify_checksums:
            from .maintenance import damaged_files

            for problem in damaged_files(self.catalog):
                from .errors import CorruptedError

                raise CorruptedError(*reversed(problem))

    def __enter__(self) -> Reader:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        pass

    @property
    def metadata(self) -> dict[str, str]:
        return self.catalog.metadata()

    def metadata_as_of(self, commit: int) -> dict[str, str]:
        return self.catalog.metadata(commit)

    @property
    def devices(self) -> list[DeviceSchema]:
        return list(self.catalog.schemas.values())

    @property
    def device_names(self) -> list[str]:
        return list(self.catalog.schemas)

    def device(self, name: str) -> DeviceSchema:
        try:
            return self.catalog.schemas[name]
        except KeyError:
            raise UnknownDeviceError(name) from None

    def device_exists_at(self, name: str, commit: int) -> bool:
        return any(d["name"] == name for m in self.catalog.upto(commit) for d in m.devices)

    def commits(self) -> list[CommitInfo]:
        return [m.info() for m in self.catalog.manifests]

    def commit_of(self, seq: int) -> int | None:
        """The commit that wrote a place of the log; None beyond the last one."""
        return self.catalog.commit_of(seq)

    def commit(self, number: int) -> CommitInfo:
        if number < 1:
            from .errors import UnknownCommitError

            raise UnknownCommitError(number)
        return self.catalog.upto(number)[-1].info()

    @property
    def head(self) -> CommitInfo | None:
        return self.catalog.manifests[-1].info() if self.catalog.manifests else None

    def commit_at(self, time_ns: int) -> int:
        """The largest number among commits not later than a moment; 0 if there is none."""
        return max((m.number for m in self.catalog.manifests if m.time_ns <= time_ns), default=0)

    def annotations_frame(self, version: int | None = None, device: str | None = None) -> DataFrame:
        return notes.state(note_rows(self.catalog, version), None, device)

    def annotations(self, device: str | None = None, as_of: int | None = None) -> list[Annotation]:
        if device is not None:
            self.device(device)
        return [Annotation(r.id, r.device, r.lo, r.hi, r.label, r.note) for r in self.annotations_frame(as_of, device).orderBy("id").collect()]

    def diff_frame(self, device: str, start: int, end: int | None = None, columns: Iterable[str] | None = None) -> DataFrame:
        """Points that differ between two versions; see :func:`tsledger.operators.history.diff`.

        Only files that overlap what the commits in between wrote or deleted are read.
        """
        schema = self.device(device)
        last = self.catalog.head if end is None else end
        if start > last:
            raise InvalidArgumentError("the first version is later than the second")
        self.catalog.upto(start)
        between = self.catalog.upto(last)[start:]
        spans = [(f.t_min, f.t_max) for m in between for f in m.files if f.device == device] + [(d[1], d[2]) for m in between for d in m.deletions if d[0] == device]
        low, high = (min(a for a, _ in spans), max(b for _, b in spans)) if spans else (1, 0)
        plan = DevicePlan(self.catalog, schema, last, low, high)
        plan.files = [f for f in plan.files if any(f.t_min <= b and a <= f.t_max for a, b in spans)]
        values = schema.column_names if columns is None else list(columns)
        return history.diff(plan.log(values), plan.deletion_rows() if plan.deletions else None, start, last, values, shifts=plan.shifts).drop("device")

    def annotation_diff_frame(self, start: int, end: int | None = None) -> DataFrame:
        return notes.diff(note_rows(self.catalog, end), start)

    def diff(self, device: str, start: int, end: int | None = None) -> Diff:
        frame = self.diff_frame(device, start, end).orderBy("t")
        names = self.device(device).column_names
        side = lambda r, s: {n: r[f"{s}_{n}"] for n in names}
        points = [PointChange(r.kind, r.t, None if r.kind == "added" else side(r, "before"), None if r.kind == "removed" else side(r, "after")) for r in frame.collect()]
        note = lambda r, s: Annotation(r.id, r[f"{s}_device"], r[f"{s}_lo"], r[f"{s}_hi"], r[f"{s}_label"], r[f"{s}_note"])
        changes = self.annotation_diff_frame(start, end).filter((F.col("before_device") == device) | (F.col("after_device") == device)).orderBy("id")
        marks = [AnnotationChange(r.kind, r.id, None if r.kind == "added" else note(r, "before"), None if r.kind == "removed" else note(r, "after")) for r in changes.collect()]
        return Diff(device, points, marks)

    def blocks(self, device: str) -> list[BlockInfo]:
        self.device(device)
        return [BlockInfo(m.number, f.path, f.rows, f.t_min, f.t_max, f.size) for m in self.catalog.manifests for f in m.files if f.device == device]

    def segments(self, device: str) -> DataFrame:
        """A row per file and column: sizes, nulls, encodings, codec and bounds, from the files' footers."""
        from .sources.footers import segments

        self.device(device)
        return segments(self.catalog, device)

    def query(self, device: str) -> Query:
        return Query(self, self.device(device))

    def read(self, device: str, columns: Iterable[str] | None = None, start: int | None = None, end: int | None = None, as_of: int | None = None) -> Batch:
        return _narrow(self.query(device), columns, start, end, as_of).collect()


@dataclass(frozen=True)
class PointChange:
    kind: str
    time: int
    before: dict | None
    after: dict | None


@dataclass(frozen=True)
class AnnotationChange:
    kind: str
    id: int
    before: Annotation | None
    after: Annotation | None


@dataclass(frozen=True)
class Diff:
    device: str
    points: list[PointChange]
    annotations: list[AnnotationChange]

    def __bool__(self) -> bool:
        return bool(self.points or self.annotations)


def _narrow(query: Query, columns, start, end, as_of) -> Query:
    query = query.time_range(start, end).as_of(as_of)
    return query if columns is None else query.columns(columns)


class File:
    """A store with times in any form; each call reads the latest version unless ``as_of`` is given."""

    def __init__(self, path: str, spark: SparkSession | None = None):
        self.path, self.spark = str(path), session(spark)
        self.reload()

    def __repr__(self) -> str:
        return f"tsledger.File({self.path!r}, devices={list(self.devices)})"

    def reload(self) -> None:
        reader = self.reader()
        self.metadata, self.devices = reader.metadata, {d.name: d for d in reader.devices}
        self.finalized = not reader.catalog.unfinished
        self.size = sum(f.size for m in reader.catalog.manifests for f in m.files)

    def reader(self) -> Reader:
        return Reader(self.path, self.spark)

    def device(self, name: str | None = None) -> DeviceSchema:
        """The named device, or the only one."""
        if name is None:
            if not self.devices:
                raise KeyError("the store has no device")
            if len(self.devices) > 1:
                raise InvalidArgumentError(f"the store has several devices, name one of {list(self.devices)}")
            name = next(iter(self.devices))
        if name not in self.devices:
            raise UnknownDeviceError(name)
        return self.devices[name]

    def to_raw(self, value, device: str | None = None, rounding: str = "floor") -> int:
        d = self.device(device)
        return to_raw(value, d.time_unit, d.timezone, rounding)

    def to_datetime(self, raw: int, device: str | None = None):
        d = self.device(device)
        return to_datetime(raw, d.time_unit, d.timezone)

    def query(self, device: str | None = None, columns: Iterable[str] | None = None, start=None, end=None, as_of: int | None = None) -> Query:
        """Bounds are rounded inwards to the device's unit."""
        d = self.device(device)
        low = None if start is None else to_raw(start, d.time_unit, d.timezone, "ceil")
        high = None if end is None else to_raw(end, d.time_unit, d.timezone, "floor")
        return _narrow(self.reader().query(d.name), columns, low, high, as_of)

    def dataframe(self, device: str | None = None, **query) -> DataFrame:
        return self.query(device, **query).dataframe()

    def iter_batches(self, device: str | None = None, **query) -> Iterator[Batch]:
        return self.query(device, **query).batches()

    def read(self, device: str | None = None, **query) -> Batch:
        return self.query(device, **query).collect()

    def read_arrow(self, device: str | None = None, **query) -> pa.Table:
        return self.read(device, **query).to_arrow()

    def read_batches(self, device: str | None = None, **query) -> pa.RecordBatchReader:
        own = self.query(device, **query)
        shape = Batch.empty({c.name: c.type for c in own.result_schema.columns}, own.result_schema).to_arrow().schema
        return pa.RecordBatchReader.from_batches(shape, (b for x in own.batches() for b in x.to_arrow().to_batches()))

    def read_pandas(self, device: str | None = None, dtype_backend: str = "numpy", **query):
        return self.read(device, **query).to_pandas(dtype_backend)

    def read_polars(self, device: str | None = None, **query):
        return self.read(device, **query).to_polars()

    def count(self, device: str | None = None, **query) -> int:
        return self.query(device, **query).count()

    def time_range(self, device: str | None = None) -> tuple[int, int] | None:
        """First and last time of the points that are there."""
        low, high = self.query(device).plan().times().agg(F.min("t"), F.max("t")).first()
        return None if low is None else (low, high)

    def labelled(self, device: str | None = None, **query) -> DataFrame:
        """Points with the label of the last annotation that covers them."""
        from .operators.intervals import label_points

        own = self.query(device, **query)
        points = own.dataframe().withColumn("device", F.lit(own.schema.name))
        return label_points(points, own.reader.annotations_frame(own.version, own.schema.name)).drop("device")

    def write(self, data, device: str, **options) -> CommitInfo | None:
        out = write(self.path, data, device, mode="a", spark=self.spark, **options)
        self.reload()
        return out

    def edit(self, message: str | None = None, author: str | None = None):
        from .edit import Transaction

        return Transaction(self, message, author)

    def writer(self, options=None, **kwargs):
        from .edit import Writer

        return Writer.open(self.path, options, spark=self.spark, **kwargs)

    def commits(self) -> list[CommitInfo]:
        return self.reader().commits()

    @property
    def head(self) -> CommitInfo | None:
        return self.reader().head

    def commit(self, number: int) -> CommitInfo:
        return self.reader().commit(number)

    def commit_at(self, when) -> int:
        return self.reader().commit_at(when if isinstance(when, int) else to_nanos(when, None))

    def annotations(self, device: str | None = None, as_of: int | None = None) -> list[Annotation]:
        return self.reader().annotations(device, as_of)

    def diff(self, start: int, end: int | None = None, device: str | None = None) -> Diff:
        return self.reader().diff(self.device(device).name, start, end)

    def blocks(self, device: str | None = None) -> list[BlockInfo]:
        return self.reader().blocks(self.device(device).name)

    def verify(self):
        from .maintenance import verify

        return verify(self.path, self.spark)

    def compact(self, target: str, as_of: int | None = None, overwrite: bool = False) -> File:
        from .maintenance import compact

        compact(self.path, target, as_of=as_of, overwrite=overwrite, spark=self.spark)
        return File(target, self.spark)


# ---- module functions


def open(path: str, spark: SparkSession | None = None) -> File:  # noqa: A001
    return File(path, spark)


def read(path: str, device: str | None = None, spark=None, **query) -> Batch:
    return File(path, spark).read(device, **query)


def iter_batches(path: str, device: str | None = None, spark=None, **query) -> Iterator[Batch]:
    return File(path, spark).iter_batches(device, **query)


def read_batches(path: str, device: str | None = None, spark=None, **query) -> pa.RecordBatchReader:
    return File(path, spark).read_batches(device, **query)


def read_arrow(path: str, device: str | None = None, spark=None, **query) -> pa.Table:
    return File(path, spark).read_arrow(device, **query)


def read_pandas(path: str, device: str | None = None, spark=None, **query):
    return File(path, spark).read_pandas(device, **query)


def read_polars(path: str, device: str | None = None, spark=None, **query):
    return File(path, spark).read_polars(device, **query)


def create(path: str, *devices: DeviceSchema, metadata=None, overwrite: bool = False, message=None, author=None, spark=None) -> File:
    """A store with devices and metadata, in one commit if there are any."""
    from .edit import Writer

    with Writer.create(path, overwrite=overwrite, spark=spark) as w:
        for d in devices:
            w.create_device(d)
        if metadata:
            w.update_metadata(metadata)
        w.commit(message, author)
    return File(path, spark)


def write(path: str, data, device: str, time_column: str | None = None, unit=None, mode: str = "w", message=None, author=None, order_by: str | None = None, spark=None, **options) -> CommitInfo | None:
    """Write a table to a device in one commit.

    ``mode``: ``w`` replaces the store as a whole, at once: a new store is written beside the old one's commits, then the
    head is pointed to it; ``x`` makes a new one, ``a`` adds to it.
    """
    from .edit import Writer

    if mode not in ("w", "x", "a"):
        raise InvalidArgumentError(f"no mode {mode!r}")
    spark = session(spark)
    files = Files(spark, path)
    there = files.exists()
    if mode == "x" and there:
        raise FileExistsError(path)
    add = mode == "a" and there
    if there and not add and not files.exists(HEAD):
        raise NotAStoreError(f"{path} is not a store")
    generation = f"generation-{uuid.uuid4().hex}"
    target = str(path) if add else files.url(generation) if there else f"{str(path).rstrip('/')}.{uuid.uuid4().hex}.tmp"
    made = Files(spark, target)
    try:
        with (Writer.open if add else Writer.create)(target, spark=spark, **options) as w:
            w.write_table(device, data, time_column=time_column, unit=unit, order_by=order_by, create=True)
            out = w.commit(message, author)
        if there and not add:
            files.replace(HEAD, json.dumps({"layout": LAYOUT, "generation": generation}))
        elif not add and not made.fs.rename(made.path(), files.path()):
            raise FileExistsError(path)
    except BaseException:
        if not add:
            made.delete()
        raise
    if there and not add:
        for name in files.names(""):
            if name not in (HEAD, generation):
                files.delete(name)
    return out
