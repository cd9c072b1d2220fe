"""A directory tree as a Spark data source: ``spark.read.format("cairn_tree").option("root", ...)``."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "relative_path string, basename string, size long, mtime_ns long, device decimal(20,0), inode decimal(20,0), is_dir boolean"


class TreeReader(DataSourceReader):
    """One partition for each top-level entry; links are not followed, excluded directory names are left out."""

    def __init__(self, options: dict):
        self.root = options["root"]
        self.excluded = {x for x in options.get("exclude", "").split(",") if x}

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(e.name) for e in sorted(os.scandir(self.root), key=lambda e: e.name) if e.name not in self.excluded]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from decimal import Decimal

        stack = [partition.value]
        while stack:
            relative = stack.pop()
            path = os.path.join(self.root, relative)
            if os.path.islink(path):
                continue
            s = os.stat(path, follow_symlinks=False)
            is_dir = os.path.isdir(path)
            yield relative, os.path.basename(path), s.st_size, s.st_mtime_ns, Decimal(s.st_dev), Decimal(s.st_ino), is_dir
            if is_dir:
                stack += [f"{relative}/{n}" for n in sorted(os.listdir(path), reverse=True) if n not in self.excluded]


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "cairn_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:  # noqa: ANN001
        return TreeReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TreeSource)
