"""File operations of commits and clean-ups."""

from __future__ import annotations

import uuid

from pyspark import SparkContext
from pyspark.sql import SparkSession


class Files:
    """The few file operations a commit needs, by the file system that Spark itself uses for the path."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.root = spark._jvm, path.rstrip("/")
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            self.path("").toUri(), spark._jsc.hadoopConfiguration()
        )

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        if not self.context.util().exists(self.path(folder)):
            return []
        return [s.getPath().getName() for s in self.context.util().listStatus(self.path(folder))]

    def write_new(self, folder: str, name: str, data: bytes) -> bool:
        """Write a file whole or not at all; False if there is one of this name."""
        fs = self.jvm.org.apache.hadoop.fs
        part = self.path(f"{folder}/.{uuid.uuid4().hex}")
        flags = self.jvm.java.util.EnumSet.of(fs.CreateFlag.CREATE)
        out = self.context.create(part, flags, self._array(fs.Options.CreateOpts, fs.Options.CreateOpts.createParent()))
        out.write(data)
        out.close()
        try:
            self.context.rename(part, self.path(f"{folder}/{name}"), self._array(fs.Options.Rename))
        except Exception as e:
            self.context.delete(part, False)
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True

    def _array(self, kind, *items):
        array = SparkContext._gateway.new_array(kind, len(items))  # variable arguments of Java
        for i, item in enumerate(items):
            array[i] = item
        return array

    def delete(self, name: str) -> None:
        self.context.delete(self.path(name), True)

    def delete_uri(self, uri: str) -> None:
        """Delete a folder named by the address Spark reports for its files."""
        self.context.delete(self.jvm.org.apache.hadoop.fs.Path(self.jvm.java.net.URI(uri)), True)
