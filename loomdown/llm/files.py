"""Files in the shared folder written and read by tasks: any file system that pyarrow opens by its address."""

from __future__ import annotations

import uuid

from pyarrow import fs


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        uri = "file://" + uri
    return fs.FileSystem.from_uri(uri if not uri.startswith("file:/") or uri.startswith("file://") else "file://" + uri[5:])


class TemporaryFile:
    """A file under a name of its own until ``commit`` gives it its final one: a failed or repeated attempt leaves no half file."""

    def __init__(self, folder: str, name: str):
        self.folder, self.name = folder, name
        self.fs, root = open_fs(folder)
        self.temp = f"_temporary/{name}.{uuid.uuid4().hex}"
        self.fs.create_dir(f"{root}/_temporary", recursive=True)
        self.stream = self.fs.open_output_stream(f"{root}/{self.temp}")

    def write(self, data: bytes) -> None:
        self.stream.write(data)

    def close(self) -> None:
        self.stream.close()


def commit(folder: str, temp: str, name: str) -> None:
    """Gives a temporary file its final name; doing it again after a success changes nothing."""
    f, root = open_fs(folder)
    if f.get_file_info(f"{root}/{temp}").type == fs.FileType.NotFound and f.get_file_info(f"{root}/{name}").type == fs.FileType.File:
        return
    f.move(f"{root}/{temp}", f"{root}/{name}")
