"""Files by path or URI, for the data source's driver side and its tasks."""

from __future__ import annotations

import io
import posixpath

from pyarrow import fs

#: Names that start like this are no data.
HIDDEN = ("_", ".")


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a URI (file, hdfs, s3, gs, ...) or of a plain local path, and the path in it."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path[len("file:") :])
    return fs.LocalFileSystem(), path


def sized(path: str) -> list[tuple[str, int]]:
    """The data files at a path, in order of name, with their sizes; a file is itself."""
    store, at = open_store(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = store.get_file_info(fs.FileSelector(at, recursive=True))
    names = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and not posixpath.basename(f.path).startswith(HIDDEN))
    prefix = path[: len(path) - len(at.rstrip("/"))] if path.rstrip("/").endswith(at.rstrip("/")) else ""
    return [(prefix + n, size) for n, size in names]


def listed(path: str) -> list[str]:
    """The data files at a path, in order of name; a file is itself."""
    return [p for p, _ in sized(path)]


def open_read(path: str) -> io.BufferedIOBase:
    store, at = open_store(path)
    return store.open_input_file(at)


def open_new(path: str) -> io.RawIOBase:
    """A new file to write to, in a folder that is made if need be."""
    store, at = open_store(path)
    store.create_dir(posixpath.dirname(at), recursive=True)
    return store.open_output_stream(at)


def write_new(path: str, data: bytes) -> None:
    with open_new(path) as f:
        f.write(data)


def remove(path: str) -> None:
    store, at = open_store(path)
    if store.get_file_info(at).type == fs.FileType.File:
        store.delete_file(at)
