"""Files by path or address, for the driver and for tasks: whatever pyarrow's file systems open; and folders
of tables, on the file systems of Spark."""

from __future__ import annotations

import hashlib
import os

from pyarrow import fs

CHUNK = 1 << 22


def _of(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))


def names(folder: str) -> list[str]:
    """The files of a folder."""
    where, p = _of(folder)
    return sorted(f.base_name for f in where.get_file_info(fs.FileSelector(p)) if f.type == fs.FileType.File)


def exists(path: str) -> bool:
    where, p = _of(path)
    return where.get_file_info(p).type == fs.FileType.File


def open_stream(path: str):
    """The whole file in order."""
    where, p = _of(path)
    return where.open_input_stream(p)


def open_ranges(path: str):
    """A file that is read at places."""
    where, p = _of(path)
    return where.open_input_file(p)


def digests(path: str) -> tuple[str, str]:
    """(MD5, SHA-256) in one pass."""
    both = hashlib.md5(), hashlib.sha256()
    with open_stream(path) as f:
        while chunk := f.read(CHUNK):
            for h in both:
                h.update(chunk)
    return both[0].hexdigest(), both[1].hexdigest()


def spark_path(path: str) -> str:
    """The address that Spark's readers take: a plain path is one of a mounted folder, whatever their default."""
    return path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}"


def mounted(path: str) -> str:
    """The plain path of a mounted file; raises for stores that don't take writes at offsets."""
    where, p = _of(path)
    if not isinstance(where, fs.LocalFileSystem):
        raise ValueError(f"{path} isn't in a mounted folder; write there and copy the files")
    return p


def _hadoop(spark, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def spark_exists(spark, path: str) -> bool:
    p, where = _hadoop(spark, path)
    return where.exists(p)


def spark_rename(spark, old: str, new: str) -> bool:
    """Rename a folder; false if something of the new name is there."""
    p, where = _hadoop(spark, old)
    to = _hadoop(spark, new)[0]
    return not where.exists(to) and where.rename(p, to)


def spark_delete(spark, path: str) -> None:
    p, where = _hadoop(spark, path)
    where.delete(p, True)


def spark_folders(spark, path: str) -> list[tuple[str, int]]:
    """(name, time of change) of the folders in a folder."""
    p, where = _hadoop(spark, path)
    return [(s.getPath().getName(), s.getModificationTime()) for s in where.listStatus(p) if s.isDirectory()] if where.exists(p) else []
