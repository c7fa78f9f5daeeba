"""Versioned folders: what is written never changes, and one small pointer file names the current version.

    <path>/versions/<id>/...     written first
    <path>/CURRENT               the id, put in place by one rename

A writer that breaks off leaves the pointer on the old version.  One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

POINTER = "CURRENT"


class Folder:
    """A versioned folder in any store that Spark can write."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.gateway, self.root = spark._jvm, spark.sparkContext._gateway, path.rstrip("/")
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self.at().getFileSystem(self.conf)

    def at(self, *parts: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def current(self) -> str | None:
        if not self.fs.exists(self.at(POINTER)):
            return None
        stream = self.fs.open(self.at(POINTER))
        try:
            return stream.readLine().strip()
        finally:
            stream.close()

    def point_to(self, version: str) -> None:
        new = f"{POINTER}.{version}"
        stream = self.fs.create(self.at(new), True)
        stream.writeBytes(version + "\n")
        stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.makeQualified(self.at()).toUri(), self.conf)
        rename = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        overwrite = self.gateway.new_array(rename, 1)
        overwrite[0] = rename.OVERWRITE
        context.rename(self.at(new), self.at(POINTER), overwrite)

    def drop_old(self, *kept: str | None) -> None:
        for found in self.fs.listStatus(self.at("versions")):
            if found.getPath().getName() not in kept:
                self.fs.delete(found.getPath(), True)
