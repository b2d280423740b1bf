"""The few file operations that plain writers lack, through the file system that Spark itself uses."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def create_once(self, path: str, text: str) -> bool:
        """Write a file that must not be there yet; False if another writer was first."""
        try:
            out = self._fs.create(self._path(path), False)
        except Py4JJavaError as error:
            if "AlreadyExists" in error.java_exception.getClass().getName() or self._fs.exists(self._path(path)):
                return False
            raise
        try:
            out.write(bytearray(text, "utf-8"))
        finally:
            out.close()
        return True

    def read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
        finally:
            stream.close()

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)
