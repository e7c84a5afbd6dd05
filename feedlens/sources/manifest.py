"""A log of small JSON manifests in a shared folder; the newest one tells what is there. Publishing is a rename, so it happens or does not."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


class Log:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def at(self, path: str):
        """(file system, path) of Hadoop."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def names(self, path: str) -> list[str]:
        fs, where = self.at(path)
        return [x.getPath().getName() for x in fs.listStatus(where)] if fs.exists(where) else []

    def remove(self, path: str) -> None:
        fs, where = self.at(path)
        fs.delete(where, True)

    def numbers(self) -> list[int]:
        return sorted(int(x.removesuffix(".json")) for x in self.names(self.folder) if x.endswith(".json"))

    def read(self, n: int) -> dict:
        fs, where = self.at(f"{self.folder}/{n:012d}.json")
        stream = fs.open(where)
        text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return json.loads(text)

    def publish(self, n: int, said: dict) -> None:
        fs, temp = self.at(f"{self.folder}/_{n:012d}.tmp")
        out = fs.create(temp, True)
        out.write(bytearray(json.dumps(said).encode()))
        out.close()
        if not fs.rename(temp, self.at(f"{self.folder}/{n:012d}.json")[1]):
            raise RuntimeError(f"manifest {n} of {self.folder} could not be published")

    def drop(self, n: int) -> None:
        self.remove(f"{self.folder}/{n:012d}.json")
