"""A file tree as a table, listed by the tasks that read it; directories that are left out are never listed.

The driver lists directories from the top, level by level, only until there are enough of them to share out. Each
becomes a partition, whose task lists and reads what is below. The tree must be mounted on every executor.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gitstrata.rules import languages

SPLITS, BATCH_BYTES = 64, 8 << 20
SCHEMA = "path string, content string, n_bytes bigint"


@dataclass
class Branch(InputPartition):
    """A directory below the root; ``whole`` with all below it, otherwise only its own files."""

    folder: str
    whole: bool

    def __post_init__(self) -> None:
        super().__init__(self.folder)


class TreeReader(DataSourceReader):
    def __init__(self, root: str, view: str, splits: int) -> None:
        self.root, self.view, self.splits = root, view, splits

    def left_out(self, name: str) -> bool:
        if self.view == "architecture":
            return name in languages.ARCHITECTURE_SKIPPED_DIRS
        return name.startswith(".") or name in languages.SNAPSHOT_SKIPPED_DIRS

    def listed(self, folder: str) -> tuple[list[str], list[str]]:
        """Directories to go into and files of one directory, by name; links to directories are not followed."""
        folders, files = [], []
        with os.scandir(os.path.join(self.root, folder)) as entries:
            for entry in entries:
                if entry.is_dir(follow_symlinks=False):
                    if not self.left_out(entry.name):
                        folders.append(os.path.join(folder, entry.name))
                elif entry.is_file():
                    files.append(os.path.join(folder, entry.name))
        return sorted(folders), sorted(files)

    def partitions(self) -> list[Branch]:
        """Whole directories, at least ``splits`` of them where the tree has as many, and the files above them."""
        level, above = [""], []
        while level and len(level) < self.splits:
            above += level
            level = [child for folder in level for child in self.listed(folder)[0]]
        return [*[Branch(f, False) for f in above], *[Branch(f, True) for f in level]]

    def read(self, partition: Branch) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[str, str, int]] = []
        held, left = 0, [partition.folder]
        while left:
            folders, files = self.listed(left.pop())
            if partition.whole:
                left += reversed(folders)
            for name in files:
                with open(os.path.join(self.root, name), "rb") as file:
                    content = file.read()
                rows.append((name, content.decode("utf-8", "replace"), len(content)))
                held += len(content)
                if held >= BATCH_BYTES:
                    yield self.batch(rows)
                    rows, held = [], 0
        if rows:
            yield self.batch(rows)

    def batch(self, rows: list[tuple[str, str, int]]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)], ["path", "content", "n_bytes"])


class TreeSource(DataSource):
    """Options: ``path``, ``view`` (``snapshot`` or ``architecture``: which directories are left out), ``splits``."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> TreeReader:
        return TreeReader(self.options["path"], self.options.get("view", "snapshot"), int(self.options.get("splits", SPLITS)))


def read_tree(spark: SparkSession, path: str, view: str = "snapshot", splits: int = SPLITS) -> DataFrame:
    """Every file below ``path`` as ``path`` (from there), ``content`` (bytes that are not UTF-8 replaced) and ``n_bytes``."""
    root = path.removeprefix("file://") if path.startswith("file:///") else path.removeprefix("file:")
    if "://" in root:
        raise ValueError("a tree is read through the file system: mount it, or keep its files as a table")
    spark.dataSource.register(TreeSource)
    return spark.read.format("source_tree").options(path=root.rstrip("/"), view=view, splits=splits).load()
