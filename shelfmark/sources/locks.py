"""Locks as files, on any file system all writers share.

A lock is a file that only one writer can create.  Its owner renews it while it
works; one that has not been renewed for a while belonged to a process that died,
and may be taken over.
"""

from __future__ import annotations

import threading
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Busy(RuntimeError):
    """Another writer holds the lock."""


class Lock:
    every, dead_after = 10.0, 60.0  # seconds

    def __init__(self, spark: SparkSession, path: str, wait: float = 600.0) -> None:
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path(path)
        self._files = self._path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._wait, self._owner, self._ended = wait, uuid.uuid4().hex, threading.Event()

    def __enter__(self) -> Lock:
        give_up = time.monotonic() + self._wait
        while not self._take():
            if time.monotonic() >= give_up:
                raise Busy(self._path.toString())
            time.sleep(0.1)
        threading.Thread(target=self._renew, daemon=True).start()
        return self

    def __exit__(self, *_) -> None:
        self._ended.set()
        if self.held():
            self._files.delete(self._path, False)

    def held(self) -> bool:
        """Is it still ours?  Not if we were taken for dead."""
        for _ in range(5):
            if self._read(self._path) == self._owner:
                return True
            time.sleep(0.1)  # it may just be being renewed
        return False

    def _take(self) -> bool:
        self._files.mkdirs(self._path.getParent())
        if self._create():
            self._write()
            return True
        self._bury()
        return False

    def _create(self) -> bool:
        uri = self._path.toUri()
        try:
            if uri.getScheme() in (None, "file"):
                return self._jvm.java.io.File(uri.getPath()).createNewFile()
            self._files.create(self._path, False).close()
            return True
        except Py4JJavaError:  # it exists
            return False

    def _bury(self) -> None:
        """Moves a dead owner's lock away; only one of several writers can."""
        try:
            seen = self._read(self._path)
            age = self._jvm.System.currentTimeMillis() - self._files.getFileStatus(self._path).getModificationTime()
            if age < self.dead_after * 1000:
                return
            grave = self._path.suffix(f".{uuid.uuid4().hex}")
            if self._files.rename(self._path, grave):
                if self._read(grave) != seen:  # it was a new owner's after all
                    self._files.rename(grave, self._path)
                else:
                    self._files.delete(grave, False)
        except Py4JJavaError:  # gone meanwhile
            return

    def _renew(self) -> None:
        while not self._ended.wait(self.every):
            if not self.held():
                return
            try:
                self._files.setTimes(self._path, self._jvm.System.currentTimeMillis(), -1)
            except Py4JJavaError:  # a store whose files have no times to set
                self._write()

    def _write(self) -> None:
        out = self._files.create(self._path, True)
        out.writeBytes(self._owner)
        out.close()

    def _read(self, path) -> str | None:
        try:
            found = self._files.open(path)
            text = found.readLine()
            found.close()
            return text
        except Py4JJavaError:
            return None
