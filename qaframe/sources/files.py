"""Small binary files in the shared folder, such as a model, written on the driver
and read inside tasks through the file system that their URI names."""

from __future__ import annotations

import uuid

from pyarrow import fs as pafs


def _resolve(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:") and "://" not in uri:
        uri = "file://" + uri[len("file:"):]
    return pafs.FileSystem.from_uri(uri)


def write_bytes(uri: str, data: bytes) -> None:
    """Write a file whole: under a name of its own, then moved."""
    fs, path = _resolve(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    own = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(own, compression=None) as out:
        out.write(data)
    fs.move(own, path)


def read_bytes(uri: str) -> bytes:
    fs, path = _resolve(uri)
    with fs.open_input_stream(path, compression=None) as f:
        return f.read()
