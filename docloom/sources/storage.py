"""File systems by the scheme of a path, for the tasks that read and write files.

A path without a scheme, ``file://`` and ``dbfs:/`` are folders that driver and
executors both mount. ``s3a://`` and ``s3n://`` are Spark's names for what pyarrow calls ``s3://``. All other
schemes go to pyarrow (``hdfs``, ``viewfs``, ``gs``, ``abfss`` ...), and ``register`` adds own ones. A
``Store`` takes what it needs along to the tasks, so a scheme is registered once, on the driver.
"""

from __future__ import annotations

import contextlib
import os
import re
from collections.abc import Callable, Iterator
from urllib.parse import unquote

import pyarrow.fs as pafs

#: A scheme's factory: a path to (pyarrow file system, path within it).
Factory = Callable[[str], tuple[pafs.FileSystem, str]]

_OWN: dict[str, Factory] = {}
_ALIASES = {"s3a": "s3", "s3n": "s3"}


def register(scheme: str, factory: Factory) -> None:
    """Make paths of ``scheme`` known; the factory runs in the tasks, so it must be picklable."""
    _OWN[scheme] = factory


class Store:
    """The files below one root."""

    def __init__(self, root: str):
        found = re.match(r"([A-Za-z][A-Za-z0-9+.-]+):(?=/)(.*)", root, re.DOTALL)
        self.root, self.scheme, rest = root, found[1].lower() if found else "", found[2] if found else root
        self.factory = _OWN.get(self.scheme)
        self.local = self.factory is None and self.scheme in ("", "file", "dbfs")
        if self.local:
            path = unquote(re.sub("^//[^/]*", "", rest)) if self.scheme == "file" else rest
            self.top = os.path.abspath(f"/dbfs{path}" if self.scheme == "dbfs" else path)
        else:
            self.uri = f"{_ALIASES[self.scheme]}:{rest}" if self.scheme in _ALIASES else root
        self._opened, self._folders = None, set()

    def __getstate__(self):
        return self.__dict__ | {"_opened": None, "_folders": set()}

    def opened(self) -> tuple[pafs.FileSystem, str]:
        """(file system, path of the root); opened once in each process."""
        if self._opened is None:
            self._opened = (pafs.LocalFileSystem(), self.top) if self.local else (self.factory or pafs.FileSystem.from_uri)(self.uri)
        return self._opened

    def folder(self, path: str | None = None) -> Iterator[tuple[str, str, bool, int]]:
        """(path, name, whether it is a folder, size) of a folder's entries; none where there is no folder. Links to folders are left out, links to files are files."""
        fs, top = self.opened()
        path = top if path is None else path
        if self.local:
            with contextlib.suppress(FileNotFoundError, NotADirectoryError), os.scandir(path) as entries:
                for entry in entries:
                    if entry.is_dir(follow_symlinks=False):
                        yield entry.path, entry.name, True, 0
                    elif entry.is_file():
                        yield entry.path, entry.name, False, entry.stat().st_size
            return
        for found in fs.get_file_info(pafs.FileSelector(path, recursive=False, allow_not_found=True)):
            if found.type != pafs.FileType.NotFound:
                yield found.path, found.base_name, found.type == pafs.FileType.Directory, found.size or 0

    def read(self, path: str) -> bytes:
        if self.local:
            with open(path, "rb") as file:
                return file.read()
        with self.opened()[0].open_input_stream(path, compression=None) as file:
            return file.read()

    def size(self, path: str) -> int | None:
        """Bytes of a file; null where there is none."""
        found = self.opened()[0].get_file_info(path)
        return found.size if found.type == pafs.FileType.File else None

    def span(self, path: str, start: int, length: int) -> bytes:
        """Bytes of a file from ``start`` on, fewer at its end."""
        with self.opened()[0].open_input_file(path) as file:
            file.seek(start)
            return file.read(length)

    def write(self, path: str, content: bytes) -> None:
        """One whole file, folders included; what was there goes."""
        with self.create(path) as out:
            out.write(content)

    def create(self, path: str):
        fs, _ = self.opened()
        folder = path.rpartition("/")[0]
        if folder not in self._folders:  # made once in each process and task
            fs.create_dir(folder, recursive=True)
            if len(self._folders) >= 10_000:
                self._folders.clear()
            self._folders.add(folder)
        return fs.open_output_stream(path, compression=None)
