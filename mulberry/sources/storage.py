"""File systems by path, as tasks open them."""

from __future__ import annotations

import io
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path as Spark gives it, local or any other that Arrow knows, and the path in it."""
    parts = urlsplit(path)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    root = f"{parts.scheme}://{parts.netloc}"
    system, base = fs.FileSystem.from_uri(f"{root}/")
    return system, base.rstrip("/") + path[len(root) :]


class Ranged(io.RawIOBase):
    """A file of any file system as Python's readers want it: places before its start are errors of the system."""

    def __init__(self, path: str) -> None:
        system, inside = file_system(path)
        self._file: pa.NativeFile = system.open_input_file(inside)
        self._size, self._at = self._file.size(), 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        at = offset + (0, self._at, self._size)[whence]
        if at < 0:
            raise OSError("a place before the file's start")
        self._at = at
        return at

    def tell(self) -> int:
        return self._at

    def readinto(self, buffer: memoryview) -> int:
        n = max(0, min(len(buffer), self._size - self._at))
        if n:
            buffer[:n] = self._file.read_at(n, self._at)
            self._at += n
        return n

    def close(self) -> None:
        if not self.closed:
            self._file.close()
        super().close()
