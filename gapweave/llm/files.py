"""Files of the shared folder, as tasks open them."""

from __future__ import annotations

import uuid
from urllib.parse import urlparse

import pyarrow.fs as pafs


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI or a local path."""
    return pafs.FileSystem.from_uri(uri if urlparse(uri).scheme else f"file://{uri}")


class Writer:
    """Blocks of bytes in one file of a folder, under a name of this attempt alone. Rows that tell where blocks lie may
    leave the task only after ``close``; a file whose rows are not committed is never read."""

    def __init__(self, folder: str, part: int):
        self._fs, root = opened(folder)
        name = f"part-{part}-{uuid.uuid4().hex}"
        self._to, self.path, self._at, self._out = f"{root}/{name}", f"{folder}/{name}", 0, None

    def put(self, raw: bytes) -> tuple[str, int, int]:
        """Path, first byte and size of the block."""
        if self._out is None:
            self._fs.create_dir(self._to.rpartition("/")[0], recursive=True)
            self._out = self._fs.open_output_stream(self._to, compression=None)
        self._out.write(raw)
        self._at += len(raw)
        return self.path, self._at - len(raw), len(raw)

    def close(self) -> None:
        if self._out is not None:
            self._out.close()


def block(path: str, at: int, size: int) -> bytes:
    fs, name = opened(path)
    with fs.open_input_file(name) as f:
        f.seek(at)
        return f.read(size)
