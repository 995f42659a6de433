"""Plans that read a device at a version from its files."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import ranges, snapshot
from ..types import DeviceSchema
from .manifest import Catalog, DataFile

DELETIONS = T.StructType([T.StructField("device", T.StringType()), *(T.StructField(n, T.LongType()) for n in ("lo", "hi", "seq", "cno"))])
NOTES = T.StructType([T.StructField("id", T.LongType()), T.StructField("op", T.StringType()), T.StructField("device", T.StringType()), T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType()), T.StructField("label", T.StringType()), T.StructField("note", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("cno", T.LongType())])


#: Spans of time in a plan, at most; nearer ones are joined, which only sends more rows through the merge.
SPANS = 64


def contested(files: Sequence[DataFile]) -> list[tuple[int, int]]:
    """Spans of time that two files or more have rows in, by their bounds.

    Rows elsewhere need no merge: a time stamp occurs once in a file, so they are read without a shuffle.
    """
    out: list[list[int]] = []
    reach = None
    for f in sorted(files, key=lambda f: (f.t_min, f.t_max)):
        if reach is not None and f.t_min <= reach:
            high = min(f.t_max, reach)
            if out and f.t_min <= out[-1][1] + 1:
                out[-1][1] = max(out[-1][1], high)
            else:
                out.append([f.t_min, high])
        reach = f.t_max if reach is None else max(reach, f.t_max)
    if len(out) > SPANS:
        gaps = sorted(range(1, len(out)), key=lambda k: out[k][0] - out[k - 1][1], reverse=True)
        cuts = [0, *sorted(gaps[: SPANS - 1]), len(out)]
        out = [[out[a][0], out[b - 1][1]] for a, b in zip(cuts, cuts[1:])]
    return [tuple(x) for x in out]


def merged_deletions(rows: list[list]) -> list[list]:
    """Deletions of one sequence number joined where they overlap or touch, as there is no row between them."""
    out: list[list] = []
    for device, lo, hi, seq, cno in sorted(rows, key=lambda r: (r[3], r[1])):
        if out and out[-1][3] == seq and lo <= min(out[-1][2], snapshot.HIGH - 1) + 1:
            out[-1][2] = max(out[-1][2], hi)
        else:
            out.append([device, lo, hi, seq, cno])
    return out


class DevicePlan:
    """Files and deletions that a version of a device has within a range of time."""

    def __init__(self, catalog: Catalog, schema: DeviceSchema, version: int | None = None, start: int | None = None, end: int | None = None):
        self.catalog, self.schema, self.start, self.end = catalog, schema, start, end
        own = snapshot.bounds(start, end)
        low, high = own or (1, 0)
        commits = catalog.upto(version)
        self.files = [f for m in commits for f in m.files if f.device == schema.name and f.t_max >= low and f.t_min <= high] if own else []
        gone = [[*d, m.number] for m in commits for d in m.deletions if d[0] == schema.name and d[2] >= low and d[1] <= high] if own else []
        self.deletions = merged_deletions(gone)

    @property
    def spark(self):
        return self.catalog.files.spark

    def _scan(self, files: Sequence[DataFile], columns: Sequence[str], source: bool = False) -> DataFrame:
        """One scan of the files; ``source``: with ``__file``, the name of each row's file."""
        types = self.schema.types
        shape = T.StructType([T.StructField("t", T.LongType()), T.StructField("seq", T.LongType()), *(T.StructField(c, types[c].spark) for c in columns)])
        if not files:
            return self.spark.createDataFrame([], shape).withColumn("device", F.lit(self.schema.name))
        rows = self.spark.read.schema(shape).parquet(*[self.catalog.files.url(f.path) for f in files])
        if source:
            rows = rows.select("*", F.col("_metadata.file_name").alias("__file"))
        return rows.filter(snapshot.in_range(F.col("t"), self.start, self.end)).withColumn("device", F.lit(self.schema.name))

    def _gone(self, files: Sequence[DataFile]) -> DataFrame | None:
        """Deletions that may concern the files."""
        if not files or not self.deletions:
            return None
        low, high = min(f.t_min for f in files), max(f.t_max for f in files)
        rows = [tuple(d) for d in self.deletions if d[2] >= low and d[1] <= high]
        return self.spark.createDataFrame(rows, DELETIONS) if rows else None

    @property
    def shifts(self) -> tuple[int, ...] | None:
        """Sizes of the blocks of time that rows and deletions meet by."""
        lengths = sorted(d[2] - d[1] for d in self.deletions)
        return ranges.shifts_for(lengths[len(lengths) // 2], lengths[-1]) if lengths else None

    def _parts(self, columns: Sequence[str]) -> tuple[DataFrame, DataFrame | None]:
        """Visible rows that need no merge, and those that do, if there are any."""
        spans = contested(self.files)
        rows, gone = self._scan(self.files, columns), self._gone(self.files)
        if not spans:
            return snapshot.visible(rows, gone, self.shifts), None
        inside = reduce(lambda a, b: a | b, (F.col("t").between(low, high) for low, high in spans))
        many = [f for f in self.files if any(f.t_min <= high and low <= f.t_max for low, high in spans)]
        return snapshot.visible(rows.filter(~inside), gone, self.shifts), snapshot.visible(self._scan(many, columns).filter(inside), self._gone(many), self.shifts)

    def rows(self, columns: Sequence[str]) -> DataFrame:
        """``t`` and the columns, of every point, in no order."""
        alone, shared = self._parts(columns)
        alone = alone.select("t", *columns)
        return alone if shared is None else alone.unionAll(snapshot.newest(shared).select("t", *columns))

    def times(self) -> DataFrame:
        """``t`` of every point; no value is read."""
        alone, shared = self._parts([])
        return alone.select("t") if shared is None else alone.select("t").unionAll(shared.select("t").distinct())

    def log(self, columns: Sequence[str]) -> DataFrame:
        """Every row written, with ``seq`` and ``cno``, for differences of versions.

        One scan, however many commits there are; a row's commit is that of its file, whose name is unique.
        """
        if not self.files:
            return self._scan([], columns).withColumn("cno", F.lit(0).cast("long"))
        numbers = {f.path: m.number for m in self.catalog.manifests for f in m.files}
        by_file = self.spark.createDataFrame([(f.path.rsplit("/", 1)[-1], numbers[f.path]) for f in self.files], "__name string, cno long")
        rows = self._scan(self.files, columns, True)
        return rows.join(by_file, F.col("__file") == F.col("__name")).drop("__file", "__name")

    def deletion_rows(self) -> DataFrame:
        return self.spark.createDataFrame([tuple(d) for d in self.deletions], DELETIONS)


def note_rows(catalog: Catalog, version: int | None = None) -> DataFrame:
    rows = [(*n, m.number) for m in catalog.upto(version) for n in m.notes]
    return catalog.files.spark.createDataFrame(rows, NOTES)
