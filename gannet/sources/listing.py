"""Listings: files under a prefix as rows, through Spark's own readers or a data source of prefixes."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gannet.sources.heads import failure

SCHEMA = "key string, size_bytes long, last_modified timestamp"


def list_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """Key, size and time of all files below a path that Spark can read; contents aren't read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select(F.col("path").alias("key"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("last_modified"))


def head_bytes(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The first n bytes of each file below any path that Spark reads; whole files are read. heads.heads() reads no more than it is asked for, below a root that executors mount."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return rows.select(F.col("path").alias("key"), F.substring("content", 1, n).alias("head"), F.col("length").alias("size_bytes"))


class _Prefix(InputPartition):
    pass


class PrefixReader(DataSourceReader):
    """One partition for each prefix; a prefix that can't be listed is a row with an error."""

    def __init__(self, root: str, prefixes: list[str]):
        self.root, self.prefixes = root, prefixes

    def partitions(self) -> list[InputPartition]:
        return [_Prefix(p) for p in self.prefixes]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import datetime

        base = os.path.realpath(self.root)
        top = os.path.realpath(os.path.join(base, partition.value))
        if os.path.commonpath([base, top]) != base:
            yield (partition.value, None, None, None, "access_denied")
            return
        errors: list[OSError] = []
        for folder, _, names in os.walk(top, onerror=errors.append):
            for name in sorted(names):
                path = os.path.join(folder, name)
                try:
                    s = os.stat(path)
                except OSError as e:
                    errors.append(e)
                    continue
                yield (partition.value, os.path.relpath(path, base), s.st_size, datetime.datetime.fromtimestamp(s.st_mtime, datetime.UTC), None)
        for e in errors:
            yield (partition.value, None, None, None, failure(e))


class PrefixSource(DataSource):
    """spark.read.format("prefix_listing").option("root", ...).option("prefixes", "a/,b/"): for roots every executor mounts."""

    @classmethod
    def name(cls) -> str:
        return "prefix_listing"

    def schema(self) -> str:
        return "prefix string, " + SCHEMA + ", error string"

    def reader(self, schema) -> DataSourceReader:
        return PrefixReader(self.options["root"], [p for p in self.options.get("prefixes", "").split(",")])
