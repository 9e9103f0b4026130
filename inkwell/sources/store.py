"""Tables in versioned folders: a new version is written aside and then named current, so readers never see half of one.

Parquet tables have no MERGE, so an upsert writes what stays and what is new as the next version. Appends add a part.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

MARK = "_current"
ROW_GROUP = 16 << 20


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share, spark.checkpoint.dir; where that is unset, a new one, on a single machine only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return root or tempfile.mkdtemp(prefix="inkwell-")


class Store:
    """Named tables under one root on any file system that Hadoop reads."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _versions(self, name: str) -> list[int]:
        fs, p = self._fs(f"{self.root}/{name}")
        if not fs.exists(p):
            return []
        found = [re.fullmatch(rf"{MARK}-(\d+)", s.getPath().getName()) for s in fs.listStatus(p)]
        return sorted(int(m[1]) for m in found if m)

    def version(self, name: str) -> int:
        """The number of the current version, 0 without one."""
        return (self._versions(name) or [0])[-1]

    def generations(self, name: str) -> list[int]:
        """Numbers of the generations that the current version is kept in, if it is."""
        fs, p = self._fs(self.path(name))
        found = [re.fullmatch(r"gen=(\d+)", s.getPath().getName()) for s in fs.listStatus(p)]
        return sorted(int(m[1]) for m in found if m)

    def exists(self, name: str) -> bool:
        return bool(self._versions(name))

    def path(self, name: str) -> str:
        return f"{self.root}/{name}/v{self._versions(name)[-1]}"

    def read(self, name: str, schema: T.StructType | str | None = None) -> DataFrame:
        """The current version; an empty table of the schema if there is none yet."""
        if not self.exists(name):
            return self.spark.createDataFrame([], schema)
        return (self.spark.read.schema(schema) if schema else self.spark.read).parquet(self.path(name))

    def overwrite(self, name: str, df: DataFrame, gen: int | None = None) -> None:
        """df as the next version, of a first generation if given; df may read the current one. Older ones but the last are dropped."""
        versions = self._versions(name)
        new = (versions[-1] if versions else 0) + 1
        self._write(df, f"{self.root}/{name}/v{new}" + ("" if gen is None else f"/gen={gen}"))
        fs, mark = self._fs(f"{self.root}/{name}/{MARK}-{new}")
        fs.create(mark, True).close()
        for old in versions[:-1]:
            for gone in (f"{MARK}-{old}", f"v{old}"):
                fs.delete(self._fs(f"{self.root}/{name}/{gone}")[1], True)

    @staticmethod
    def _write(df: DataFrame, path: str) -> None:
        """Row groups are small, so that a file can be read by several tasks."""
        df.write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(path)

    def add(self, name: str, df: DataFrame, gen: int) -> None:
        """df as a generation of the current version, in place of an earlier one of that number; read has it in column gen."""
        self._write(df, f"{self.path(name)}/gen={gen}")

    def drop(self, name: str) -> None:
        fs, p = self._fs(f"{self.root}/{name}")
        fs.delete(p, True)

    def append(self, name: str, df: DataFrame) -> None:
        if not self.exists(name):
            self.overwrite(name, df)
        else:
            df.write.mode("append").parquet(self.path(name))

    def put(self, name: str, batch: int, df: DataFrame) -> None:
        """df as a batch beside the table, in place of an earlier one of that number."""
        df.write.mode("overwrite").parquet(f"{self.root}/{name}/_batches/{batch}.parquet")

    def merge(self, name: str, schema: T.StructType | str, reduced: Callable[[DataFrame], DataFrame]) -> None:
        """The table and all batches beside it, reduced, as the next version; then the batches go. What is cut short is merged by the next run."""
        fs, p = self._fs(f"{self.root}/{name}/_batches")
        if fs.exists(p):
            found = [s.getPath().toString() for s in fs.listStatus(p)]
            rows = self.spark.read.schema(schema).parquet(*found)
            self.overwrite(name, reduced(self.read(name, schema).unionByName(rows)))
            fs.delete(p, True)

    def scratch(self) -> str:
        """A folder for a query's own state."""
        return f"{self.root}/_scratch-{uuid.uuid4().hex}"
