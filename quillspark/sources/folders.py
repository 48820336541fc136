"""Small files in any Hadoop file system, and the folder that all machines of a cluster share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.  Without one, a session on one machine gets a temporary folder; on a
    cluster that is an error, as a machine's own folder isn't seen by the others."""
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not shared and not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return (shared or tempfile.gettempdir()).rstrip("/")


def scratch(spark: SparkSession, name: str = "quill") -> str:
    """A new folder name below the shared one."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


class Folder:
    """What durable indexes need of a file system: bytes written whole, names swapped at once."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._jvm, self._gateway, self._conf = spark._jvm, spark.sparkContext._gateway, spark._jsc.hadoopConfiguration()
        self.path = path.rstrip("/")
        self._fs = self._at("").getFileSystem(self._conf)

    def _at(self, name: str):  # noqa: ANN202
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def make(self, name: str = "") -> None:
        self._fs.mkdirs(self._at(name))

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def names(self, name: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(name))) if self.exists(name) else []

    def stamp(self, name: str = "") -> tuple[int, int]:
        """(time of the last change, length)."""
        s = self._fs.getFileStatus(self._at(name))
        return s.getModificationTime(), s.getLen()

    def read(self, name: str) -> bytes:
        stream = self._fs.open(self._at(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def write(self, name: str, data: bytes) -> None:
        """Under another name first, synced, and then in place of what was there."""
        folder, _, last = name.rpartition("/")
        temp = f"{folder}/_{last}.{uuid.uuid4().hex}".lstrip("/")
        stream = self._fs.create(self._at(temp), True)
        try:
            stream.write(bytearray(data))
            stream.hsync()
        finally:
            stream.close()
        kind = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self._gateway.new_array(kind, 1)
        how[0] = kind.OVERWRITE
        at = self._at(name)
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(self._at(temp), at, how)

    def remove(self, name: str) -> None:
        self._fs.delete(self._at(name), True)
