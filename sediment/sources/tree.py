"""File trees as tables: files, directories and links with mode and time, which ``binaryFile`` leaves out.

The walk lists a folder's children by name and drops sockets, pipes and devices. It runs where the tree is, one
partition per root; contents are read by the executors, which must see the same paths.
"""

from __future__ import annotations

import json
import os
import stat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.paths import archive_path
from ..operators.chunking import file_windows
from ..model import DIRECTORY, FILE, SYMLINK, UnsafePath

SCHEMA = "disk string, path string, kind tinyint, mode bigint, mtime bigint, size bigint, link_target string"


def normal(path: str) -> str:
    """The archive path of a disk path."""
    kept: list[str] = []
    for part in path.replace(os.sep, "/").split("/"):
        if part == "..":
            kept[-1:] = []
        elif part not in ("", "."):
            kept.append(part)
    if not kept:
        raise UnsafePath(path)
    return "/".join(kept)


def _row(disk: str, path: str, info: os.stat_result, kind: int) -> tuple:
    target = os.readlink(disk).encode("utf-8", "replace").decode() if kind == SYMLINK else None
    return disk, path, kind, stat.S_IMODE(info.st_mode), max(0, int(info.st_mtime)), info.st_size if kind == FILE else 0, target


def walk(root: str, path: str, follow: bool = False):
    """Rows of a root and all below it, folders before their children, children by name."""
    info = os.stat(root) if follow else os.lstat(root)
    if stat.S_ISLNK(info.st_mode):
        yield _row(root, path, info, SYMLINK)
    elif stat.S_ISREG(info.st_mode):
        yield _row(root, path, info, FILE)
    elif stat.S_ISDIR(info.st_mode):
        yield _row(root, path, info, DIRECTORY)
        for name in sorted(os.listdir(root)):
            safe = name.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
            yield from walk(os.path.join(root, name), f"{path}/{safe}", follow)


class _Root(InputPartition):
    def __init__(self, disk: str, path: str):
        self.disk, self.path = disk, path


class _TreeReader(DataSourceReader):
    def __init__(self, roots: list[str], follow: bool):
        self.roots, self.follow = roots, follow

    def partitions(self):
        return [_Root(r, normal(r)) for r in self.roots]

    def read(self, partition):
        yield from walk(partition.disk, partition.path, self.follow)


class _NamedReader(_TreeReader):
    def partitions(self):
        return [_Root(disk, path) for disk, path in self.roots]


class TreeSource(DataSource):
    """``spark.read.format("file_tree").option("roots", "a:b")``; ``follow`` reads through links. ``named``, a JSON list
    of disk and archive paths, may stand for ``roots``."""

    @classmethod
    def name(cls):
        return "file_tree"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        follow = self.options.get("follow", "false") == "true"
        if "named" in self.options:
            return _NamedReader(json.loads(self.options["named"]), follow)
        return _TreeReader(self.options["roots"].split(os.pathsep), follow)


def scan(spark: SparkSession, roots: list[str], follow_symlinks: bool = False, keep_going: bool = False) -> DataFrame:
    """A row per file, directory and link below the roots; ``keep_going`` passes over roots that don't exist."""
    found = [r for r in roots if os.path.lexists(r)]
    if len(found) < len(roots) and not keep_going:
        raise FileNotFoundError(next(r for r in roots if r not in found))
    spark.dataSource.register(TreeSource)
    return spark.read.format("file_tree").option("named", json.dumps([(os.path.abspath(r), normal(r)) for r in found])).option("follow", str(follow_symlinks).lower()).load()


def with_content(rows: DataFrame) -> DataFrame:
    """The rows with ``content``, a value below 2 GB; the size is that of the bytes read. Null for other kinds.

    ``write_archive`` takes rows without it too, and then reads files of any size from where they are.
    """

    def run(batches):
        for b in batches:
            at = b.schema.get_field_index("disk"), b.schema.get_field_index("kind"), b.schema.get_field_index("size")
            for i in range(len(b)):
                disk, kind, size = (b.column(k)[i].as_py() for k in at)
                data = None
                if kind == FILE:
                    data = b"".join(file_windows(disk))
                    size = len(data)
                one = b.slice(i, 1).set_column(at[2], "size", pa.array([size], pa.int64()))
                yield pa.RecordBatch.from_arrays([*one.columns, pa.array([data], pa.binary())], [*one.schema.names, "content"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{fields}, content binary")


__all__ = ["TreeSource", "archive_path", "normal", "scan", "walk", "with_content"]
