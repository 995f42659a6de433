"""Files of a store through Spark's own file systems, so any path that Spark reads will do."""

from __future__ import annotations

import os
import tempfile
import time
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share (``spark.checkpoint.dir``), or a local one in local mode."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = "file://" + os.path.join(tempfile.gettempdir(), f"tsledger-{os.getuid()}")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Files:
    """A folder and what lies in it."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.jvm = spark, spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        path = self.jvm.org.apache.hadoop.fs.Path(root)
        self.fs = path.getFileSystem(self.conf)
        self.root = self.fs.makeQualified(path).toString().rstrip("/")

    def path(self, name: str = ""):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def url(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self.path(name))

    def names(self, folder: str) -> list[str]:
        """Names in a folder, sorted; none if there is no such folder."""
        if not self.exists(folder):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(folder)))

    def walk(self, folder: str = "") -> list[tuple[str, int]]:
        """Every file below a folder with its size, by name relative to the root."""
        if not self.exists(folder):
            return []
        out, found = [], self.fs.listFiles(self.path(folder), True)
        while found.hasNext():
            status = found.next()
            out.append((status.getPath().toString()[len(self.root) + 1 :], status.getLen()))
        return sorted(out)

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def read_all(self, folder: str, names: list[str], few: int = 32) -> list[str]:
        """Texts of many small files; beyond a few they are read by tasks instead of one after another."""
        if len(names) <= few:
            return [self.read(f"{folder}/{n}") for n in names]
        rows = self.spark.read.option("wholetext", True).text([self.url(f"{folder}/{n}") for n in names]).select("value", "_metadata.file_name").collect()
        found = {r["file_name"]: r["value"] for r in rows}
        return [found[n] for n in names]

    def create(self, name: str, text: str) -> bool:
        """Write a new file; False if there is one already."""
        try:
            stream = self.fs.create(self.path(name), False)
        except Exception as e:
            if "already exist" in str(e).lower() or "FileAlreadyExists" in str(e):
                return False
            raise
        try:
            stream.write(bytearray(text.encode()))
            stream.hflush()
        finally:
            stream.close()
        return True

    def publish(self, name: str, text: str) -> bool:
        """Make a whole file appear at once; False if another one has the name."""
        if self.exists(name):
            return False
        draft = f"{name}.{self.jvm.java.util.UUID.randomUUID().toString()}.tmp"
        self.create(draft, text)
        target = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path(name).toUri(), self.conf)
        none = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        none[0] = self.jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            target.rename(self.path(draft), self.path(name), none)
        except Exception as e:
            self.delete(draft)
            if "exist" in str(e).lower():
                return False
            raise
        return True

    def replace(self, name: str, text: str) -> None:
        """Put a whole file in place of another at once: readers see the old one or the new one."""
        draft = f"{name}.{uuid.uuid4().hex}.tmp"
        self.create(draft, text)
        target = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path(name).toUri(), self.conf)
        over = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        over[0] = self.jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        target.rename(self.path(draft), self.path(name), over)

    def rename(self, old: str, new: str) -> bool:
        return self.fs.rename(self.path(old), self.path(new))

    def touch(self, name: str) -> None:
        self.fs.setTimes(self.path(name), int(time.time() * 1000), -1)

    def age(self, name: str) -> float:
        """Seconds since a file was last touched."""
        return time.time() - self.fs.getFileStatus(self.path(name)).getModificationTime() / 1000

    def delete(self, name: str = "") -> None:
        self.fs.delete(self.path(name), True)
