"""A data source that lists a folder tree: folders and files, empty ones too, without skipped subtrees.

Spark's file source leaves out empty files and knows no folders, and lists a
subtree before a filter can drop it. Here each reader partition lists one
subtree, and a skipped folder is never opened.
"""

from __future__ import annotations

import datetime as dt
import sys
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# The reader travels with its tasks, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCHEMA = "path STRING, kind STRING, length BIGINT, modificationTime TIMESTAMP, children BIGINT"
_ARROW = pa.schema(
    [
        ("path", pa.string()),
        ("kind", pa.string()),
        ("length", pa.int64()),
        ("modificationTime", pa.timestamp("us", "UTC")),
        ("children", pa.int64()),
    ]
)
ROWS = 10_000


def _system(root: str):
    """The file system that a path's scheme names, and the path inside it."""
    from pyarrow import fs

    if "://" in root or root.startswith("file:"):
        return fs.FileSystem.from_uri(root)
    return fs.LocalFileSystem(), root


class Subtree(InputPartition):
    """Folders whose whole subtrees one task lists; entries already listed come along."""

    def __init__(self, folders: Sequence[str], known: Sequence[tuple] = ()) -> None:
        self.folders, self.known = list(folders), list(known)


class FolderReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.root = options["path"].rstrip("/")
        self.skip = {s.rstrip("/") for s in options.get("skip", "").split("\n") if s}
        self.names = {s for s in options.get("skipNames", "").split("\n") if s}
        self.subtrees = int(options.get("subtrees", "64"))

    def _open(self, system, folder: str) -> tuple[list[tuple], list[str], tuple]:
        """Files of a folder, the folders in it that are not skipped, and its own row."""
        from pyarrow import fs

        files, inside, all_entries = [], [], system.get_file_info(fs.FileSelector(folder))
        for e in sorted(all_entries, key=lambda e: e.path):
            if e.type == fs.FileType.Directory:
                if e.path not in self.skip and e.base_name not in self.names:
                    inside.append(e.path)
            else:
                at = None if e.mtime is None else e.mtime.astimezone(dt.timezone.utc)
                files.append((e.path, "file", e.size, at, None))
        return files, inside, (folder, "folder", None, None, len(all_entries))

    def partitions(self) -> Sequence[InputPartition]:
        """Open folders from the root down until there are enough subtrees to list in parallel."""
        system, root = _system(self.root)
        level, known = [root], []
        # Only a bounded number of folders is opened here; everything below is left to the tasks.
        opened = 0
        while level and len(level) < self.subtrees and opened < self.subtrees:
            below = []
            for folder in level:
                files, inside, own = self._open(system, folder)
                known += [own, *files]
                below += inside
                opened += 1
            level = below
        parts = [Subtree([], known[a : a + ROWS]) for a in range(0, len(known), ROWS)]
        return parts + [Subtree([f]) for f in level] or [Subtree([])]

    def read(self, partition: Subtree) -> Iterator[pa.RecordBatch]:
        system, _ = _system(self.root)
        rows, todo = list(partition.known), list(partition.folders)
        while todo:
            files, inside, own = self._open(system, todo.pop())
            rows += [own, *files]
            todo += inside
            while len(rows) >= ROWS:
                yield self._batch(rows[:ROWS])
                rows = rows[ROWS:]
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


class FolderSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "folder_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FolderReader(self.options)


def folder_tree(
    spark: SparkSession, root: str, skip: Sequence[str] = (), skip_names: Sequence[str] = (), subtrees: int = 64
) -> DataFrame:
    """(path, kind, length, modificationTime, children) of all files and folders below root, root included.

    `skip` names whole paths and `skip_names` folder names whose subtrees are not
    opened; `children` counts all entries of a folder, skipped ones too.
    """
    spark.dataSource.register(FolderSource)
    options = {"skip": "\n".join(skip), "skipNames": "\n".join(skip_names), "subtrees": str(subtrees)}
    return spark.read.format("folder_tree").options(**options).load(root)


def tree_files(tree: DataFrame) -> DataFrame:
    """The files of a tree in the columns of `listing.file_listing`, empty ones included."""
    return tree.where("kind = 'file'").select("path", "length", "modificationTime")


def empty_folders(tree: DataFrame, name: str = "Unknown") -> DataFrame:
    """(path, is_empty) of the folders of this name: those without any entry can be removed."""
    named = F.element_at(F.split("path", "/"), -1) == name
    return tree.where((F.col("kind") == "folder") & named).select("path", (F.col("children") == 0).alias("is_empty"))
