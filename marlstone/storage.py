"""Files through Hadoop's FileSystem, so that tables can be in any store that Spark reads."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Store:
    def __init__(self, spark: SparkSession):
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def size(self, path: str) -> int:
        """Bytes of a file or of all files in a folder."""
        fs, p = self._at(path)
        return fs.getContentSummary(p).getLength() if fs.exists(p) else 0

    def write_new(self, path: str, text: str) -> None:
        """Create path with text, whole or not at all; FileExistsError if it is there, also if another writer was first.

        A part file of its own name is written first. It takes its place by a link on local disks, where renaming would
        replace what is there, and elsewhere by renaming, which a store like HDFS refuses where the name is taken.
        """
        fs, p = self._at(path)
        part = self._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.part")
        stream = fs.create(part, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        try:
            if fs.getScheme() == "file":
                self._jvm.java.nio.file.Files.createLink(self._local(p), self._local(part))
            elif fs.exists(p) or not fs.rename(part, p):
                raise FileExistsError(path)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                raise FileExistsError(path) from None
            raise
        finally:
            fs.delete(part, False)

    def _local(self, path):
        return self._jvm.java.io.File(path.toUri().getPath()).toPath()
