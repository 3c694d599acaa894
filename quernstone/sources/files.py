"""Small files on any file system that Spark can open."""

from __future__ import annotations

import os
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import SparkSession

from quernstone.errors import EngineError


def scratch_dir(spark: SparkSession) -> str:
    """A new folder that driver and executors share: in ``spark.checkpoint.dir``, or a temporary one in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return f"{base.rstrip('/')}/quernstone-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise EngineError("set spark.checkpoint.dir to a folder that driver and executors share")
    return "file://" + tempfile.mkdtemp(prefix="quernstone-")


class Files:
    """The few operations that a manifest needs."""

    def __init__(self, spark: SparkSession, root: str):
        self.root = (root if urlparse(root).scheme else f"file://{os.path.abspath(root)}").rstrip("/")
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.local = self.root[len("file://") :] if self.root.startswith("file:///") else None
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def uri(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def make(self, name: str) -> None:
        self._fs.mkdirs(self._path(name))

    def names(self, name: str, folders: bool = False) -> list[str]:
        if not self.exists(name):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(name)) if s.isDirectory() == folders)

    def changed(self, name: str) -> float:
        """When it was changed last, in seconds since 1970; of a folder, when it or what lies in it was."""
        at = self._path(name)
        status = self._fs.getFileStatus(at)
        inner = [s.getModificationTime() for s in self._fs.listStatus(at)] if status.isDirectory() else []
        return max([status.getModificationTime(), *inner]) / 1000

    def rename(self, name: str, new: str) -> None:
        if not self._fs.rename(self._path(name), self._path(new)):
            raise EngineError(f"can't rename {name}")

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

    def read(self, name: str) -> str:
        if self.local is not None:
            with open(f"{self.local}/{name}", encoding="utf-8") as f:
                return f.read()
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> bool:
        """Write a new file as a whole and durably; False where its name is taken already."""
        tmp = f"{name}.{uuid.uuid4().hex}.tmp"
        if self.local is not None:
            with open(f"{self.local}/{tmp}", "w", encoding="utf-8") as f:
                f.write(text)
                f.flush()
                os.fsync(f.fileno())
            try:
                os.link(f"{self.local}/{tmp}", f"{self.local}/{name}")
            except FileExistsError:
                return False
            finally:
                os.unlink(f"{self.local}/{tmp}")
            folder = os.open(os.path.dirname(f"{self.local}/{name}"), os.O_RDONLY)
            try:
                os.fsync(folder)
            finally:
                os.close(folder)
            return True
        out = self._fs.create(self._path(tmp), False)
        out.write(bytearray(text.encode()))
        out.hsync()
        out.close()
        if self.exists(name) or not self._fs.rename(self._path(tmp), self._path(name)):
            self._fs.delete(self._path(tmp), False)
            return False
        return True
