"""Files in the shared folder, from executors: through pyarrow's file systems, under a final name only when whole."""

from __future__ import annotations

import uuid

from pyarrow import fs


def resolve(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def put(uri: str, data: bytes) -> None:
    """Write under a name of this attempt, then rename: a repeated or parallel attempt leaves the same whole file."""
    system, path = resolve(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    attempt = f"{path}.{uuid.uuid4().hex}"
    with system.open_output_stream(attempt) as f:
        f.write(data)
    system.move(attempt, path)


def get(uri: str) -> bytes:
    system, path = resolve(uri)
    with system.open_input_stream(path) as f:
        return f.read()


class Ranges:
    """Random reads of one file."""

    def __init__(self, uri: str):
        system, path = resolve(uri)
        self.size = system.get_file_info(path).size
        self._file = system.open_input_file(path)

    def read(self, start: int, n: int) -> bytes:
        return self._file.read_at(n, start)

    def close(self) -> None:
        self._file.close()
