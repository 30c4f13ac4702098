"""Numbered commit files in a folder: each number is taken once, and a file is there whole or not at all."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Commits:
    """Small JSON files named by number, on any file system that Spark writes to.

    A file is written aside and then given its final name, which fails where
    that is taken: by a hard link on a local disk, by a rename that overwrites
    nothing elsewhere (HDFS does that atomically; object stores need a layer that does).
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(self._conf)

    def numbers(self) -> list[int]:
        at = self._path(self.folder)
        if not self._fs.exists(at):
            return []
        return sorted(int(n) for f in self._fs.listStatus(at) if (n := f.getPath().getName()).isdigit())

    def path(self, number: int) -> str:
        return f"{self.folder}/{number:012d}"

    def get(self, number: int) -> dict:
        return json.loads(self.spark.read.text(self.path(number)).first()[0])

    def put(self, number: int, content: dict) -> bool:
        """Whether the number was free and now holds ``content``."""
        temporary, final = self._path(f"{self.folder}/_tmp-{uuid.uuid4().hex}"), self._path(self.path(number))
        self._fs.mkdirs(final.getParent())
        out = self._fs.create(temporary)
        out.write(bytearray(json.dumps(content, default=str).encode()))
        out.close()
        try:
            if self._fs.getScheme() == "file":
                local = lambda p: self._jvm.java.io.File(p.toUri().getPath()).toPath()
                self._jvm.java.nio.file.Files.createLink(local(final), local(temporary))
            else:
                rename = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
                options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
                options[0] = rename
                self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(temporary.toUri(), self._conf).rename(temporary, final, options)
        except Exception as e:
            if self._fs.exists(final):
                return False
            raise e
        finally:
            self._fs.delete(temporary, False)
        return True

    def append(self, content: dict) -> int:
        """Commit under the next free number, whoever else commits meanwhile."""
        number = max(self.numbers(), default=0) + 1
        while not self.put(number, content):
            number += 1
        return number
