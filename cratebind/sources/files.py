"""Files on whatever file system holds them, opened by executors: by range for reading, whole and at once for writing."""

from __future__ import annotations

import re
import urllib.parse
from collections.abc import Callable

import pyarrow.fs as fs

SCHEME = re.compile(r"^([A-Za-z][A-Za-z0-9+.-]+):(?://[^/]*)?(?=/)")


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path within it. A path is as it reads, with blanks and percent signs of its own."""
    found = SCHEME.match(path)
    if found is None:
        return fs.LocalFileSystem(), path
    if found[1] == "file":
        return fs.LocalFileSystem(), "/" + path[found.end() :].lstrip("/")
    return fs.FileSystem.from_uri(found[0] + urllib.parse.quote(path[found.end() :]))


def ranges_of(path: str) -> tuple[int, Callable[[int, int], bytes], Callable[[], None]]:
    """A file's size, a function (offset, length) that reads a part of it, and one that closes it."""
    system, inner = located(path)
    handle = system.open_input_file(inner)

    def take(offset: int, length: int) -> bytes:
        return handle.read_at(max(0, length), offset) if offset < size and length > 0 else b""

    size = handle.size()
    return size, take, handle.close


def put(path: str, mark: str, data: bytes) -> None:
    """Write a file beside its place and move it there, so that readers see the old or the new one."""
    system, inner = located(path)
    folder, _, name = inner.rpartition("/")
    system.create_dir(folder or "/", recursive=True)
    hidden = f"{folder}/.{name}.{mark}"
    with system.open_output_stream(hidden) as out:
        out.write(data)
    system.move(hidden, inner)
