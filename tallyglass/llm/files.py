"""Files that tasks write to and read from the shared scratch folder."""

from __future__ import annotations

from pyarrow import fs


def open_folder(path: str) -> tuple[fs.FileSystem, str]:
    """File system and plain path of a folder named by a path or URI."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if path.startswith("/"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def make_folder(path: str) -> None:
    system, plain = open_folder(path)
    system.create_dir(plain, recursive=True)


class Reader:
    """Reads byte ranges and keeps the last file open."""

    def __init__(self, folder: str) -> None:
        self.system, self.plain = open_folder(folder)
        self.name, self.file = None, None

    def read(self, name: str, offset: int, length: int) -> bytes:
        if name != self.name:
            self.close()
            self.name, self.file = name, self.system.open_input_file(f"{self.plain}/{name}")
        self.file.seek(offset)
        return self.file.read(length)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.name, self.file = None, None
