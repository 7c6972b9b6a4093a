"""Files of any store that Spark reads, through Hadoop's file systems, and a folder for scratch tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession):
        self.spark, self.jvm = spark, spark._jvm

    def _at(self, path: str):
        at = self.jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def exists(self, path: str) -> bool:
        system, at = self._at(path)
        return system.exists(at)

    def folders(self, path: str) -> list[str] | None:
        """Names of the folders in a folder, sorted; None if it can't be read."""
        system, at = self._at(path)
        if not system.exists(at) or not system.getFileStatus(at).isDirectory():
            return None
        return sorted(x.getPath().getName() for x in system.listStatus(at) if x.isDirectory())

    def files(self, path: str) -> list[str]:
        system, at = self._at(path)
        return sorted(x.getPath().getName() for x in system.listStatus(at) if x.isFile()) if system.exists(at) else []

    def read(self, path: str) -> str | None:
        system, at = self._at(path)
        if not system.exists(at):
            return None
        stream = system.open(at)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """Puts a whole file in place by one renaming over what is there, so a reader sees the old or the new one."""
        own = f"{path}.{uuid.uuid4().hex}"
        system, at = self._at(own)
        stream = system.create(at, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        fs = self.jvm.org.apache.hadoop.fs
        kind = getattr(fs, "Options$Rename")
        over = self.spark.sparkContext._gateway.new_array(kind, 1)
        over[0] = kind.OVERWRITE
        fs.FileContext.getFileContext(at.toUri(), self.spark._jsc.hadoopConfiguration()).rename(at, fs.Path(path), over)

    def folder(self, path: str) -> None:
        """Makes a folder, where there is none."""
        system, at = self._at(path)
        system.mkdirs(at)

    def rename(self, path: str, to: str) -> None:
        """Gives a file or folder another name in the same store."""
        system, at = self._at(path)
        if not system.rename(at, self.jvm.org.apache.hadoop.fs.Path(to)):
            raise OSError(f"{path} can't be renamed to {to}")

    def delete(self, path: str) -> None:
        system, at = self._at(path)
        system.delete(at, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names; a local session without one has a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tidegrid-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/tidegrid/{name}-{uuid.uuid4().hex}"
