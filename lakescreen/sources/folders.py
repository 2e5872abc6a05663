"""Files of a folder that driver and tasks see, as a table: sub-folders are partitions, each walked by a task of its own."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Partitions that the driver looks for before tasks take over.
PARTITIONS = 64
SCHEMA = "path string, relative_path string, file_size long, modified timestamp"


@dataclass
class Part(InputPartition):
    folder: str
    depth: int
    alone: bool  # without its sub-folders


class FolderReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = os.path.abspath(options["path"])
        self.deep, self.most = int(options["depth"]), int(options["most"])
        self.excluded, self.suffixes = set(options["excluded"].lower().split("/")), tuple(options["suffixes"].split("/"))

    def _entries(self, folder: str) -> tuple[list[os.DirEntry], list[os.DirEntry]]:
        """Supported files and sub-folders to walk, each by name whatever its case; none of a folder that cannot be read."""
        try:
            with os.scandir(folder) as found:
                entries = sorted(found, key=lambda e: e.name.lower())
        except OSError:
            return [], []
        files = [e for e in entries if not e.is_dir() and e.is_file() and e.name.lower().endswith(self.suffixes)]
        inner = [e for e in entries if e.is_dir() and not e.is_symlink() and not e.name.startswith(".") and e.name.lower() not in self.excluded]
        return files, inner

    def partitions(self) -> list[Part]:
        done, todo = [], [Part(self.root, 0, alone=False)]
        while todo and len(todo) + len(done) < PARTITIONS:
            first = todo.pop(0)
            done.append(Part(first.folder, first.depth, alone=True))
            if first.depth < self.deep:
                todo += [Part(e.path, first.depth + 1, alone=False) for e in self._entries(first.folder)[1]]
        return done + todo

    def read(self, partition: Part) -> Iterator[tuple]:
        """Files in the order of a walk, no more than the whole walk may give."""
        todo, n = [(partition.folder, partition.depth)], 0
        while todo:
            folder, depth = todo.pop()
            files, inner = self._entries(folder)
            for e in files:
                if n == self.most:
                    return
                n += 1
                stat = e.stat()
                yield f"file:{e.path}", os.path.relpath(e.path, self.root), stat.st_size, datetime.fromtimestamp(stat.st_mtime, UTC)
            if not partition.alone and depth < self.deep:
                todo += [(e.path, depth + 1) for e in reversed(inner)]


class FolderFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "folder_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> FolderReader:
        return FolderReader(self.options)


def files(spark: SparkSession, folder: str, depth: int, most: int, excluded: tuple[str, ...], suffixes: tuple[str, ...]) -> DataFrame:
    """(path, relative_path, file_size, modified) of supported files down to ``depth``, at least the first ``most`` of a walk.

    A walk takes a folder's files before its sub-folders. Hidden and excluded folders and links to folders are left out.
    """
    spark.dataSource.register(FolderFiles)
    options = {"depth": depth, "most": most, "excluded": "/".join(excluded), "suffixes": "/".join(suffixes)}
    return spark.read.format("folder_files").options(**options).load(folder)
