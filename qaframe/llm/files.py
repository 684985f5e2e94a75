"""Binary files in the shared folder, written and range-read inside tasks.

Spark has no sink for raw binary files.  Tasks write them through the file
system that the folder's URI names, under a name of their own first and then
moved, so a task that runs again after a lost executor replaces its file by the
same bytes and no reader ever sees half a file.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyarrow import fs as pafs


def resolve(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else "file://" + uri[5:])


def write_file(uri: str, parts: Iterable[bytes]) -> int:
    """Write a file whole or not at all; returns its size."""
    fs, path = resolve(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    own = f"{path}.{uuid.uuid4().hex}"
    size = 0
    with fs.open_output_stream(own, compression=None) as out:
        for p in parts:
            out.write(p)
            size += len(p)
    fs.move(own, path)
    return size


class RangeReader:
    """Reads byte ranges of a file; counts what it reads."""

    def __init__(self, uri: str):
        fs, path = resolve(uri)
        self.file = fs.open_input_file(path)
        self.size = self.file.size()
        self.bytes_read = 0

    def read(self, start: int, length: int) -> bytes:
        if start < 0 or length < 0 or start + length > self.size:
            raise ValueError(f"range {start}+{length} is outside a file of {self.size} bytes")
        data = self.file.read_at(length, start)
        self.bytes_read += len(data)
        return data

    def close(self) -> None:
        self.file.close()

    def __enter__(self) -> "RangeReader":
        return self

    def __exit__(self, *_) -> None:
        self.close()
