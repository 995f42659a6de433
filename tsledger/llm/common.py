"""Shared helpers of the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every contract of this package: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
WORD_CLASS = r"[^\x20\x09-\x0D]+"

#: Bytes of a table that may be sent to all tasks; its rows are counted first.
BROADCAST_BYTES = 64 << 20
#: Entries of each of the two generations of a worker's tables.
KEPT = 400_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or a local one where that is unset (tests)."""
    own = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if own:
        return own.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), f"tsledger-{os.getuid()}")


def table_path(spark: SparkSession, name: str) -> str:
    """A new path for a table in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Tables that this process has written to shared folders.
MADE: list[str] = []


def remove(spark: SparkSession, paths: Iterable[str]) -> None:
    """Remove tables that nothing will read any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name in list(paths):
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)
        if name in MADE:
            MADE.remove(name)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, and lost executors do not lose it."""
    spark = df.sparkSession
    path = table_path(spark, name)
    MADE.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(spark: SparkSession, df: DataFrame) -> None:
    """Remove the files of a table that :func:`written` made, once nothing will read them any more."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
        MADE[:] = [m for m in MADE if m.rsplit("/", 1)[-1] != folder.rsplit("/", 1)[-1]]


@atexit.register
def _sweep_last() -> None:
    """Tables that results still read are of no use once this process ends."""
    spark = SparkSession.getActiveSession()
    if spark is not None and MADE:
        try:
            remove(spark, MADE)
        except Exception:  # the session may have ended before its process
            MADE.clear()


def free_name(df: DataFrame, want: str) -> str:
    """``want``, made longer until the table has no such column."""
    taken = {c.lower() for c in df.columns}
    while want.lower() in taken:
        want += "_"
    return want


def located(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` as a written table with a column that numbers its rows, and that column's name.

    A locator is worth nothing unless it is stored: a lost executor's rows could be numbered anew otherwise.
    """
    row = free_name(df, "__row")
    return written(df.withColumn(row, F.monotonically_increasing_id()), name), row


def small(df: DataFrame, width: int) -> DataFrame:
    """A written table, marked for broadcast if its counted rows of ``width`` bytes stay within BROADCAST_BYTES; larger
    ones are shuffled."""
    return F.broadcast(df) if df.count() * width <= BROADCAST_BYTES else df.hint("shuffle_hash")


def without(df: DataFrame, gone: DataFrame, digest) -> DataFrame:
    """The rows of ``df`` that are not in ``gone`` (``id, digest``, a written table); ``digest`` is the column of ``df``
    to compare.  Texts are shuffled only where ``gone`` is large."""
    own, key = free_name(df, "__digest"), free_name(df, "__key")
    left = df.withColumn(own, digest).withColumn(key, F.xxhash64(F.col("doc_id").cast("long"), own))
    right = small(gone.select(F.struct(F.xxhash64("id", "digest").alias("key"), "id", "digest").alias("__gone")).select("__gone"), 80)
    g = lambda c: F.col("__gone")[c]
    same = (F.col(key) == g("key")) & (F.col(own) == g("digest")) & F.col("doc_id").cast("long").eqNullSafe(g("id"))
    return left.join(right, same, "left_anti").drop(key, own)


def require(df: DataFrame, columns: Iterable[str]) -> None:
    """Raise ValueError at once when a needed column is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_of(column: str = "text"):
    """The text, null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def word_count(text):
    """Number of words of a text column; JVM only."""
    return F.regexp_count(text, F.lit(WORD_CLASS)).cast("long")


def beside(df: DataFrame, new: Iterable[str]) -> list[str]:
    """The input's columns that a result may keep beside its own ``new`` ones (any case)."""
    own = {c.lower() for c in new}
    return [c for c in df.columns if c.lower() not in own]


#: In a worker: what frees each operator's tables.
_TABLES: dict[str, Callable[[], None]] = {}


def claim(name: str | None = None, clear: Callable[[], None] | None = None) -> None:
    """At the start of a task: free the tables that other operators have left in this worker, so that it never holds
    those of two."""
    freed = [_TABLES.pop(other)() for other in list(_TABLES) if other != name]
    if clear is not None:
        _TABLES[name] = clear
    if freed:
        trim()


def trim() -> None:
    """Give freed memory back to the system."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


class Recent(dict):
    """A table of two generations: when the young one is full the old one is dropped, entries still in use move up."""

    def __init__(self, make, size: int = KEPT):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key):
        value = self.old.get(key, self)
        if value is self:
            value = self.make(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        if len(key) <= 100:
            self[key] = value
        return value

    def forget(self) -> None:
        """At the end of a task: an idle worker should hold no large table."""
        self.clear()
        self.old = {}
