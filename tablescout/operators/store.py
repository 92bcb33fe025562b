"""Versioned relations on shared storage: a reader always sees a complete version."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


class Store:
    """Every write creates the next version folder; the newest one with a success mark is current."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        p, fs = self._fs(path)
        return fs.exists(p)

    def is_file(self, path: str) -> bool:
        p, fs = self._fs(path)
        return fs.exists(p) and fs.getFileStatus(p).isFile()

    def drop(self, path: str) -> None:
        """Remove an unpublished folder below this store."""
        if not path.startswith(self.root + "/"):
            raise ValueError(f"{path} is not below {self.root}")
        p, fs = self._fs(path)
        fs.delete(p, True)

    def versions(self, name: str) -> list[int]:
        p, fs = self._fs(f"{self.root}/{name}")
        if not fs.exists(p):
            return []
        found = [re.fullmatch(r"v(\d+)", s.getPath().getName()) for s in fs.listStatus(p)]
        return sorted(int(m.group(1)) for m in found if m)

    def _complete(self, name: str) -> list[int]:
        return [v for v in self.versions(name) if self.exists(f"{self.root}/{name}/v{v}/_SUCCESS")]

    def has(self, name: str) -> bool:
        return bool(self._complete(name))

    def read(self, name: str, schema: str) -> DataFrame:
        done = self._complete(name)
        if not done:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}/v{done[-1]}")

    def write(self, name: str, df: DataFrame) -> None:
        following = max(self.versions(name), default=0) + 1
        df.write.parquet(f"{self.root}/{name}/v{following}")
