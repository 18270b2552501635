"""Objects of a folder that driver and executors share: any file system that pyarrow opens by its address."""

from __future__ import annotations

import uuid

from pyarrow import fs

BLOCK = 4 << 20


class Folder:
    """A folder by its address (a plain path counts as a local or mounted one)."""

    def __init__(self, address: str):
        self.address = address.rstrip("/")
        full = self.address if "://" in self.address else "file://" + self.address.removeprefix("file:")
        self.fs, self.root = fs.FileSystem.from_uri(full)

    def size(self, name: str) -> int | None:
        info = self.fs.get_file_info(f"{self.root}/{name}")
        return info.size if info.type == fs.FileType.File else None

    def names(self, below: str) -> list[str]:
        found = self.fs.get_file_info(fs.FileSelector(f"{self.root}/{below}", allow_not_found=True))
        return sorted(x.base_name for x in found)

    def reader(self, name: str):
        return self.fs.open_input_stream(f"{self.root}/{name}", compression=None)

    def writer(self, name: str):
        self.fs.create_dir(f"{self.root}/{name}".rpartition("/")[0], recursive=True)
        return self.fs.open_output_stream(f"{self.root}/{name}", compression=None)

    def replace(self, name: str, chunks) -> int:
        """Writes an object under a temporary name, then gives it its own: readers see the old or the new one whole."""
        temp, n = f"_temporary/{uuid.uuid4().hex}", 0
        with self.writer(temp) as out:
            for chunk in chunks:
                out.write(chunk)
                n += len(chunk)
        self.move(temp, name)
        return n

    def move(self, old: str, new: str) -> None:
        self.fs.create_dir(f"{self.root}/{new}".rpartition("/")[0], recursive=True)
        self.fs.move(f"{self.root}/{old}", f"{self.root}/{new}")

    def drop(self, below: str) -> None:
        if self.fs.get_file_info(f"{self.root}/{below}").type == fs.FileType.Directory:
            self.fs.delete_dir(f"{self.root}/{below}")

    def head(self, name: str, limit: int):
        """The first ``limit`` bytes of an object, block by block."""
        with self.reader(name) as src:
            while limit > 0:
                data = src.read(min(BLOCK, limit))
                if not data:
                    raise OSError(f"{name} is shorter than expected")
                limit -= len(data)
                yield data

    def whole(self, name: str):
        with self.reader(name) as src:
            while data := src.read(BLOCK):
                yield data
