"""Small driver-side file work through the session's Hadoop file systems."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class FileExists(FileExistsError):
    """Another writer has created the file first."""


class Files:
    """Listing, reading and writing of single small files on any file system Spark reaches."""

    def __init__(self, spark: SparkSession):
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        hadoop_path = self._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop_path.getFileSystem(self._conf), hadoop_path

    def exists(self, path: str) -> bool:
        fs, at = self._at(path)
        return fs.exists(at)

    def is_directory(self, path: str) -> bool:
        fs, at = self._at(path)
        return fs.exists(at) and fs.getFileStatus(at).isDirectory()

    def glob(self, pattern: str) -> list[str]:
        """Paths of the plain files that match, in order."""
        fs, at = self._at(pattern)
        found = fs.globStatus(at)
        return sorted(status.getPath().toString() for status in (found or []) if status.isFile())

    def any(self, pattern: str) -> bool:
        """Whether anything matches; one listing, and nothing per file."""
        fs, at = self._at(pattern)
        return len(fs.globStatus(at) or []) > 0

    def names(self, folder: str) -> list[str]:
        fs, at = self._at(folder)
        if not fs.exists(at):
            return []
        return sorted(status.getPath().getName() for status in fs.listStatus(at))

    def size(self, path: str) -> int:
        """Bytes of all files under a path."""
        fs, at = self._at(path)
        return fs.getContentSummary(at).getLength() if fs.exists(at) else 0

    def read(self, path: str) -> str:
        fs, at = self._at(path)
        stream = fs.open(at)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """Write or replace a small text file."""
        fs, at = self._at(path)
        stream = fs.create(at, True)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()

    def write_new(self, path: str, text: str) -> None:
        """Write a file that must not exist yet; readers see all of it or nothing."""
        fs, at = self._at(path)
        draft = self._jvm.org.apache.hadoop.fs.Path(at.getParent(), f".{uuid.uuid4().hex}.tmp")
        self.write(draft.toString(), text)
        if fs.exists(at) or not fs.rename(draft, at):
            fs.delete(draft, False)
            raise FileExists(path)

    def remove(self, path: str) -> None:
        """Remove a folder that this run has made."""
        fs, at = self._at(path)
        fs.delete(at, True)
