"""Paths of any file system that Arrow knows, for sources and sinks that name their own files."""

from __future__ import annotations

from pyarrow import fs


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """(file system, path in it) of a plain path or of one with a scheme; ``file:/x`` is a local path, as Hadoop writes it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return (fs.FileSystem.from_uri(path)) if "://" in path else (fs.LocalFileSystem(), path.rstrip("/"))


def remove(files: fs.FileSystem, folder: str) -> None:
    if files.get_file_info(folder).type == fs.FileType.Directory:
        files.delete_dir(folder)
